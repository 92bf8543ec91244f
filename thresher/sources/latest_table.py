"""The results table as latest versions: a base and deltas by cell, merged on read.

A key (rule, group, window) belongs to one cell: the day of its window start
and a hash bucket of the key.  A micro-batch is cut to one row per key and
written as a delta, cell by cell.  Every few epochs the cells that got a delta
since the last time are merged into a new base; the others keep theirs, so a
late row rewrites its cell and not the history.  A read thus meets, for each
key, at most one base row and a few deltas.

Next to the rows stand counts (cell, rule, keys).  They tell which cells hold a
rule, and how many keys at least: the newest windows of a rule are read from
its newest days, just enough of them to hold the number asked for.  They are
also the commit: an epoch is there once its counts are.

Defined cases: an epoch that is run again overwrites its own folders and reads
earlier ones alone; an epoch that died before its counts is not seen; an empty
batch makes an epoch without rows; window starts that don't begin with a date
(null too) share the cells of no day, which every read takes in; null rules
and groups are keys like others; extra columns are kept if the schema has them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.operators.results import KEY, LIVE_MAX, latest_versions, newest_windows
from thresher.session import delete_folder, finished_epochs

NO_DAY = "other"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
_CELL = ["day", "bucket"]
_COUNTS = "kind string, epoch long, day string, bucket int, ruleId string, keys long"


def day_of(window_start: Column) -> Column:
    return F.when(window_start.rlike(_DATE), F.left(window_start, F.lit(10))).otherwise(F.lit(NO_DAY))


class LatestTable:
    """Latest versions under one folder of the shared file system.

    `buckets`: cells a day, over which the keys of a busy rule are dealt;
    `base_every`: epochs from one merge to the next.  `buckets` is fixed for
    the life of a table."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = 16, base_every: int = 16) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.buckets, self.base_every = buckets, base_every

    # ---------------------------------------------------------------- write ---

    def fold(self, batch: DataFrame, epoch: int) -> None:
        """Take in one micro-batch; a foreachBatch function."""
        for kind in ("base", "delta"):  # of a run of this epoch before
            delete_folder(self.spark, f"{self.path}/counts/{kind}/epoch={epoch}")
        self._write(latest_versions(batch.select(*self.schema.names)), "delta", epoch)
        self._counted("delta", epoch).write.mode("overwrite").parquet(f"{self.path}/counts/delta/epoch={epoch}")
        if (epoch + 1) % self.base_every == 0:
            self._merge(epoch)

    def _write(self, rows: DataFrame, kind: str, epoch: int) -> None:
        key = F.xxhash64(*KEY)
        celled = rows.withColumns({"__day": day_of(F.col("windowStart")), "__bucket": F.pmod(key, F.lit(self.buckets)).cast("int")})
        # rebalancing splits a cell too big for one writer; sorted by rule, a file's statistics tell rules apart
        celled.hint("rebalance", "__day", "__bucket").sortWithinPartitions("__day", "__bucket", "ruleId", "windowStart") \
            .write.mode("overwrite").partitionBy("__day", "__bucket").parquet(f"{self.path}/{kind}/epoch={epoch}")

    def _counted(self, kind: str, epoch: int) -> DataFrame:
        """Keys by cell and rule, of a folder just written."""
        schema = T.StructType([*self.schema.fields, T.StructField("__day", T.StringType()), T.StructField("__bucket", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/epoch={epoch}")
        counted = rows.groupBy(F.col("__day").alias("day"), F.col("__bucket").alias("bucket"), "ruleId").agg(F.count(F.lit(1)).alias("keys"))
        return counted.select(F.lit(kind).alias("kind"), F.lit(epoch).cast("long").alias("epoch"), *_CELL, "ruleId", "keys")

    def _merge(self, epoch: int) -> None:
        """New bases for the cells with deltas; the counts of all bases."""
        live = self._live(epoch)
        touched = live.where("kind = 'delta'").select(*_CELL).distinct()
        self._write(latest_versions(self._rows_of(live.join(touched, _CELL, "left_semi"))), "base", epoch)
        kept = live.where("kind = 'base'").join(touched, _CELL, "left_anti").select("kind", "epoch", *_CELL, "ruleId", "keys")
        kept.unionByName(self._counted("base", epoch)).repartitionByRange("ruleId", "day").sortWithinPartitions("ruleId", "day") \
            .write.mode("overwrite").parquet(f"{self.path}/counts/base/epoch={epoch}")

    def expire(self, keep: int = 2) -> None:
        """Delete what no read of the last `keep` merges, or later, can meet."""
        merges = finished_epochs(self.spark, f"{self.path}/counts/base")
        if len(merges) < keep:
            return
        oldest, needed = merges[-keep], set()
        for n in merges[-keep:]:
            counts = self.spark.read.schema(_COUNTS).parquet(f"{self.path}/counts/base/epoch={n}")
            needed |= {r.epoch for r in counts.select("epoch").distinct().collect()}
        for kind, gone in (("counts/delta", lambda n: n <= oldest), ("delta", lambda n: n <= oldest),
                           ("counts/base", lambda n: n < oldest), ("base", lambda n: n < oldest and n not in needed)):
            for n in finished_epochs(self.spark, f"{self.path}/{kind}"):
                if gone(n):
                    delete_folder(self.spark, f"{self.path}/{kind}/epoch={n}")

    # ----------------------------------------------------------------- read ---

    def _live(self, epoch: int | None = None) -> DataFrame:
        """Counts of the folders that make up the table after `epoch` (by
        default the last): all bases as of the last merge, deltas since."""
        due = lambda n: epoch is None or n <= epoch
        base = max((n for n in finished_epochs(self.spark, f"{self.path}/counts/base") if due(n)), default=None)
        deltas = [n for n in finished_epochs(self.spark, f"{self.path}/counts/delta") if due(n) and (base is None or n > base)]
        folders = ([] if base is None else [f"{self.path}/counts/base/epoch={base}"]) + [f"{self.path}/counts/delta/epoch={n}" for n in deltas]
        if not folders:
            return self.spark.createDataFrame([], _COUNTS)
        return self.spark.read.schema(_COUNTS).parquet(*folders)

    def _rows_of(self, live: DataFrame) -> DataFrame:
        """The rows of the cells of `live`, a folder each; their number is days
        x buckets x folders of a cell, whatever the number of rows."""
        cells = live.select("kind", "epoch", *_CELL).distinct().collect()
        if not cells:
            return self.spark.createDataFrame([], self.schema)
        folders = sorted(f"{self.path}/{c.kind}/epoch={c.epoch}/__day={c.day}/__bucket={c.bucket}" for c in cells)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def rows(self, rule_ids: Iterable[str] | None = None, first_day: str | None = None, last_day: str | None = None,
             epoch: int | None = None) -> DataFrame:
        """The stored rows of some rules (by default all) with windows that
        start from `first_day` to `last_day` (local yyyy-MM-dd, closed), and of
        no day: one base row and a few deltas a key.  The operators of
        `operators.results` take them as they take the whole table."""
        live = self._live(epoch)
        if rule_ids is not None:
            live = live.where(F.col("ruleId").isin(list(rule_ids)))
        if first_day is not None:
            live = live.where((F.col("day") >= first_day) | (F.col("day") == NO_DAY))
        if last_day is not None:
            live = live.where((F.col("day") <= last_day) | (F.col("day") == NO_DAY))
        rows = self._rows_of(live)
        return rows if rule_ids is None else rows.where(F.col("ruleId").isin(list(rule_ids)))

    def read(self, epoch: int | None = None) -> DataFrame:
        """One row per key: its latest version."""
        return latest_versions(self.rows(epoch=epoch))

    def newest(self, rule_id: str, limit: int) -> DataFrame:
        """The newest `limit` windows of a rule (1 to 1000, else an error),
        read from its newest days.  A key stands in one cell, so the days hold
        at least the largest count of each cell, however many of the deltas'
        keys are the base's own."""
        if not 1 <= limit <= LIVE_MAX:
            raise ValueError(f"limit must be between 1 and {LIVE_MAX}")
        live = self._live().where(F.col("ruleId") == rule_id)
        days = live.where(F.col("day") != NO_DAY).groupBy(*_CELL).agg(F.max("keys").alias("keys")).groupBy("day").agg(F.sum("keys").alias("keys"))
        held, oldest = 0, None
        for day in days.orderBy(F.col("day").desc()).limit(limit).collect():  # a day holds one key at least
            held, oldest = held + day["keys"], day["day"]
            if held >= limit:
                break
        return newest_windows(latest_versions(self.rows([rule_id], first_day=oldest)), limit)
