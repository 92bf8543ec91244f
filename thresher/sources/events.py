"""The raw event table: scan, flat names, and latest-delivery dedup.

On a cluster the event table is a lake table (`spark.table(...)`, or
`spark.read.format("iceberg").load(...)`), whose catalog handles snapshots,
manifests, delete files and partition pruning.  Here it is Parquet.

The stand-in `events` table has columns (event_id, ts, user_id, event_type,
value, props).  `ts` is the event time, `event_id` the ingestion order, and
`props` the nested JSON payload (`_data.k` -> column `k`).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thresher.functions.timeutil import bucket_start, ntz_literal
from thresher.spec import column_for

# The stand-in event types that become 0/1 flag columns.
EVENT_TYPES = ("signup", "purchase", "error", "view", "click")
GRAIN_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass(frozen=True)
class EventSource:
    """How to read an event table for rules.

    time_col     event time (TIMESTAMP_NTZ, UTC)
    dedup_keys   columns identifying one event; deliveries of the same event
                 collapse to the newest one (by `order_col`, nulls last)
    dedup_grain  if set, the time column joins the dedup key truncated to
                 this unit ('hour', 'day', ...) instead of as is
    order_col    ingestion order; `tiebreak` makes the pick deterministic
    payload_col  JSON text holding the nested `_data` payload
    payload_fields  payload keys exposed as flat columns
    """

    time_col: str = "ts"
    dedup_keys: tuple[str, ...] = ("user_id",)
    dedup_grain: str | None = "hour"
    order_col: str = "event_id"
    tiebreak: tuple[str, ...] = ()
    payload_col: str | None = "props"
    payload_fields: tuple[tuple[str, str], ...] = (("k", "long"),)
    flag_source: str | None = "event_type"
    flag_values: tuple[str, ...] = EVENT_TYPES
    dedup: bool = True
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def dedup_key_cols(self) -> list[Column]:
        keys = [F.col(k) for k in self.dedup_keys]
        if self.dedup_grain:
            keys.append(bucket_start(F.col(self.time_col), GRAIN_SECONDS[self.dedup_grain]).alias("__dedup_t"))
        else:
            keys.append(F.col(self.time_col))
        return keys

    def prefilter_bounds(self, start: dt.datetime, end: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
        """Bounds that keep whole dedup groups: the exact range when the raw
        time is part of the key, else the range widened to the grain."""
        if not self.dedup or not self.dedup_grain:
            return start, end
        from thresher.functions.timeutil import BUCKET_ORIGIN_EPOCH_SECONDS

        width = GRAIN_SECONDS[self.dedup_grain.lower()]
        origin = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=BUCKET_ORIGIN_EPOCH_SECONDS % width)

        def floor(t: dt.datetime) -> dt.datetime:
            steps = (t - origin) // dt.timedelta(seconds=width)
            return origin + steps * dt.timedelta(seconds=width)

        return floor(start), floor(end) + dt.timedelta(seconds=width) - dt.timedelta(microseconds=1)


STANDIN_SOURCE = EventSource()


def flat_events(raw: DataFrame, source: EventSource = STANDIN_SOURCE) -> DataFrame:
    """Expose payload fields and 0/1 flags as flat, lower-case columns.

    These are plain projections: Catalyst prunes the ones a query does not
    read, so the JSON is only parsed when a rule references a payload field.
    """
    cols = [F.col(c) for c in raw.columns]
    if source.payload_col and source.payload_col in raw.columns:
        for name, typ in source.payload_fields:
            cols.append(F.get_json_object(F.col(source.payload_col), f"$.{name}").try_cast(typ).alias(name.lower()))
    if source.flag_source and source.flag_source in raw.columns:
        for v in source.flag_values:
            cols.append((F.col(source.flag_source) == F.lit(v)).cast("double").alias(f"flag_{v}"))
    return raw.select(*cols)


def nested_events(raw: DataFrame, source: EventSource = STANDIN_SOURCE) -> DataFrame:
    """The message form of an event: envelope fields prefixed with "_" and
    the payload as a `_data` struct (what producers send)."""
    from thresher.spec import ENVELOPE_FIELDS

    payload_schema = ", ".join(f"{n} {t}" for n, t in source.payload_fields)
    envelope = [F.col(c).alias(f"_{c}") for c in raw.columns if c in ENVELOPE_FIELDS]
    body = [c for c in raw.columns if c not in ENVELOPE_FIELDS and c != source.payload_col]
    parsed = F.from_json(F.col(source.payload_col), payload_schema)
    data = F.struct(*[F.col(c) for c in body],
                    *[parsed[n].alias(n) for n, _ in source.payload_fields]).alias("_data")
    return raw.select(*envelope, data)


def flatten_message(msg: DataFrame) -> DataFrame:
    """Nested message -> flat columns by the name rule (`_data.X` -> `x`,
    `_event_id` -> `event_id`); the inverse of `nested_events`."""
    cols = []
    for f in msg.schema.fields:
        if f.name == "_data":
            for sub in f.dataType.fields:
                cols.append(F.col(f"_data.{sub.name}").alias(column_for(f"_data.{sub.name}")))
        else:
            cols.append(F.col(f.name).alias(column_for(f.name)))
    return msg.select(*cols)


def latest_deliveries(df: DataFrame, source: EventSource = STANDIN_SOURCE) -> DataFrame:
    """Keep the newest delivery per event key (`order_col` DESC NULLS LAST).

    A row_number() = 1 filter; Catalyst plans it as a WindowGroupLimit, which
    keeps one row per key inside each map task before the shuffle, so a key
    repeated a billion times ships one row per task.  Filters placed on the
    key columns above this are pushed below it (and into the scan).
    """
    if not source.dedup:
        return df
    order = [F.col(source.order_col).desc_nulls_last()] + [F.col(c).asc_nulls_last() for c in source.tiebreak]
    keys = source.dedup_key_cols()
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def matched_events(raw: DataFrame, source: EventSource, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Flat, deduplicated events whose time lies in the closed range.

    The range is applied twice: widened to whole dedup groups below the dedup
    (reaches the Parquet scan as pushed filters), then exactly above it.
    """
    t = F.col(source.time_col)
    lo, hi = source.prefilter_bounds(start, end)
    pre = raw.where(t.between(ntz_literal(lo), ntz_literal(hi)))
    deduped = latest_deliveries(pre, source)
    return flat_events(deduped.where(t.between(ntz_literal(start), ntz_literal(end))), source)


def read_lake_table(spark: SparkSession, name: str) -> DataFrame:
    """The event table from the catalog (an Iceberg/Delta table on a
    cluster): snapshots, manifests, delete files and partition pruning are
    the catalog's job; filters placed on the result reach its scan."""
    return spark.table(name)
