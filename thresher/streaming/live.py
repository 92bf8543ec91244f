"""The live per-rule view as a streaming job.

    result messages (JSON text; Kafka on a cluster, files here)
      -> normalise (legacy names, defaults, JSON decoding)
      -> streaming aggregation per (rule, group, window):
           max_by(row, (isFinal, seq)), min(seq)        -- state store
      -> update mode: the keys changed in this micro-batch
      -> foreachBatch: merge into the bounded view (upsert, per-rule cap,
         leading-run prune), written as one snapshot per epoch

The view is bounded (cap rows per rule), so rewriting it per micro-batch
costs O(view), not O(history).  A snapshot is keyed by the epoch id, so a
replayed epoch after a failure overwrites its own snapshot: the job is
idempotent and restarts from its checkpoint.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.functions.timeutil import ntz_to_instant, parse_window_start_col
from thresher.operators.livestate import KEY, cap_per_rule, prune_leading
from thresher.sources.results import normalise_results

STATE_COLS = ["ruleId", "groupKey", "windowStart", "windowEnd", "aggResult", "cnt", "total", "thresholdBreached", "isFinal", "seq"]


def keyed_latest(normalised: DataFrame, retention_hours: float | None = None) -> DataFrame:
    """Streaming upsert: the state store keeps one row per key.

    With a retention, the parsed window start joins the key with a
    watermark of that delay: state of windows older than the newest window
    start minus the retention is evicted, and messages for such windows are
    dropped -- the stream form of the retention prune, and what keeps the
    state bounded.  Messages whose window start does not parse are dropped
    when a retention is set (they could never be evicted)."""
    others = [c for c in STATE_COLS if c not in KEY]
    best = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(F.col("isFinal"), F.col("seq")))
    keys = list(KEY)
    src = normalised
    if retention_hours is not None:
        ws = ntz_to_instant(parse_window_start_col(F.col("windowStart")))
        src = src.withColumn("__ws", ws).where(F.col("__ws").isNotNull()) \
            .withWatermark("__ws", f"{int(retention_hours * 3600)} seconds")
        keys.append("__ws")
    agg = src.groupBy(*keys).agg(best.alias("__r"), F.min("seq").alias("first_seq"))
    return agg.select(*KEY, *[F.col(f"__r.{c}").alias(c) for c in others], "first_seq")


def message_stream(spark: SparkSession, directory: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Raw result messages as (value: JSON text, seq: arrival offset) --
    the shape of a Kafka record's value and offset -- normalised."""
    raw = spark.readStream.schema("value string, seq long") \
        .option("maxFilesPerTrigger", str(max_files_per_trigger)).json(directory)
    return normalise_results(raw)


class ViewMerger:
    """foreachBatch target: merge the changed keys into the view snapshot."""

    def __init__(self, base_path: str, cap: int | None = None, cutoff: dt.datetime | None = None,
                 initial: DataFrame | None = None, retention_hours: float | None = None):
        """With `retention_hours`, rows go whose window started that long
        before the newest window of the view (rows whose start can't be read
        stay).  `initial`: a start-up state (e.g. the results table's recent rows,
        upserted) that replaces the view before the first micro-batch."""
        self.base_path = base_path.rstrip("/")
        self.cap = cap
        self.cutoff = cutoff
        self.initial = initial
        self.retention_hours = retention_hours
        self.last_epoch: int | None = None

    def snapshot_path(self, epoch: int) -> str:
        return f"{self.base_path}/epoch={epoch}"

    def __call__(self, changed: DataFrame, epoch: int) -> None:
        spark = changed.sparkSession
        prev = self._previous(spark, epoch)
        merged = changed if prev is None else prev.unionByName(changed)
        # a key seen again keeps its first arrival; the newer version wins
        others = [c for c in merged.columns if c not in KEY + ["first_seq"]]
        best = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(F.col("isFinal"), F.col("seq")))
        view = merged.groupBy(*KEY).agg(best.alias("__r"), F.min("first_seq").alias("first_seq")) \
            .select(*KEY, *[F.col(f"__r.{c}").alias(c) for c in others], "first_seq")
        view = cap_per_rule(view, self.cap)
        if self.cutoff is not None:
            view = prune_leading(view, self.cutoff)
        if self.retention_hours is not None:
            started = parse_window_start_col(F.col("windowStart"))
            oldest = view.agg(F.max(started)).scalar() - F.make_dt_interval(secs=F.lit(self.retention_hours * 3600))
            view = view.where(started.isNull() | (started >= oldest))
        view.write.mode("overwrite").parquet(self.snapshot_path(epoch))
        self.last_epoch = epoch

    def _previous(self, spark: SparkSession, epoch: int) -> DataFrame | None:
        """The newest finished snapshot before `epoch` (a restarted job finds
        what an earlier run wrote), else the start-up state.  Errors of
        reading one are raised."""
        from thresher.session import finished_epochs

        done = [e for e in finished_epochs(spark, self.base_path) if e < epoch]
        if done:
            return spark.read.parquet(self.snapshot_path(max(done)))
        return None if self.initial is None else self.initial.select(*STATE_COLS, "first_seq")


def arrival_order(time: str, partition: str, offset: str):
    """The order of records of several partitions, as a struct that compares by
    record time, then partition, then offset (offsets of different partitions
    alone can't be compared, and no number has room for all three)."""
    return F.struct(F.col(time).alias("time"), F.col(partition).cast("long").alias("partition"), F.col(offset).cast("long").alias("offset"))


def kafka_message_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
                         max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Result (or anomaly) messages from a Kafka topic: the record value as
    JSON text and an arrival order over all partitions (`seq`, see
    `arrival_order`), ready for
    `normalise_results` / `normalise_anomalies`.  `maxOffsetsPerTrigger`
    bounds a micro-batch (back-pressure).  Needs the Kafka connector jar."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", starting))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    seq = arrival_order("timestamp", "partition", "offset")
    return r.load().select(F.col("value").cast("string").alias("value"), seq.alias("seq"),
                           F.col("partition"), F.col("offset"), F.col("timestamp").alias("kafka_ts"))


def publish_to_kafka(records: DataFrame, servers: str, topic: str) -> None:
    """Write (key, value) records -- e.g. `operators.rulestore.publish_records`
    -- to a Kafka topic with all-replica acknowledgement."""
    (records.select(F.col("key").cast("string"), F.col("value").cast("string"))
     .write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
     .option("kafka.acks", "all").save())


class DeltaPublisher:
    """foreachBatch target for push deltas: each micro-batch is one flush.

    Within the batch, updates of one (rule, group, window) coalesce to one
    row (a final row is never replaced by a partial one), first-arrival
    order is kept in `first_seq`, and with `max_rows` a rule keeps at most
    so many rows per flush (the oldest first arrivals are dropped).  Optionally the
    batch's consumption-delay histogram is written too.  Output is keyed
    by epoch, so a replayed epoch overwrites its own files."""

    def __init__(self, path: str, max_rows: int | None = None, metrics_path: str | None = None,
                 consumed_col: str | None = None):
        self.path = path.rstrip("/")
        self.max_rows = max_rows
        self.metrics_path = metrics_path.rstrip("/") if metrics_path else None
        self.consumed_col = consumed_col

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        from thresher.operators.livestate import delta_batches
        from thresher.operators.metrics import delay_histogram

        batch.persist()
        try:
            flushed = delta_batches(batch.withColumn("flush", F.lit(epoch).cast("long")), "flush", self.max_rows)
            flushed.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
            if self.metrics_path and self.consumed_col:
                hist = delay_histogram(batch.withColumn("__topic", F.lit("results")), "__topic", "producedAt",
                                       self.consumed_col)
                hist.write.mode("overwrite").parquet(f"{self.metrics_path}/epoch={epoch}")
        finally:
            batch.unpersist()
