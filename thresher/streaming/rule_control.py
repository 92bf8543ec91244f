"""Rule control as a stream: the status of every rule, kept by epoch.

A micro-batch of rule changes (rule_id, seq, action) is folded to one
transition map per rule, which moves that rule's stored state on; maps compose,
so no action is ever folded twice.  Epoch N writes the rules it changed; every
few epochs the whole table is written as a base, so that a read meets one base
and a few deltas.  An epoch reads only epochs before it and overwrites its own
folder: a replayed micro-batch gives the same table.

Events are gated by the status that holds at the end of their micro-batch, read
inside it, so a change takes effect at once, without a restart.

Defined cases: the changes of a rule come in order of seq, over micro-batches
too (one log partition per rule); invalid actions change nothing; an event whose
rule is not known, or null, does not pass; an empty batch writes an empty epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.operators.rulestore import advanced
from thresher.session import finished_epochs
from thresher.streaming.evaluate import gate_by_rule_status

STATUS_SCHEMA = "rule_id string, status string, version long, actions long, ever_active boolean"


class RuleStatusTable:
    """The rules' states by epoch, under one folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, base_every: int = 16) -> None:
        self.spark, self.path, self.base_every = spark, path.rstrip("/"), base_every

    def _folders(self, epoch: int | None) -> list[str]:
        """The last base up to `epoch`, and the deltas after it."""
        due = lambda n: epoch is None or n <= epoch
        base = max((n for n in finished_epochs(self.spark, f"{self.path}/base") if due(n)), default=None)
        deltas = [n for n in finished_epochs(self.spark, f"{self.path}/delta") if due(n) and (base is None or n > base)]
        return ([] if base is None else [f"{self.path}/base/epoch={base}"]) + [f"{self.path}/delta/epoch={n}" for n in deltas]

    def read(self, epoch: int | None = None) -> DataFrame:
        """Every rule's state after `epoch` (by default the last)."""
        folders = self._folders(epoch)
        if not folders:
            return self.spark.createDataFrame([], STATUS_SCHEMA)
        rows = self.spark.read.schema(STATUS_SCHEMA + ", at_epoch long").parquet(*folders)
        state = F.max_by(F.struct("status", "version", "actions", "ever_active"), "at_epoch").alias("s")
        return rows.groupBy("rule_id").agg(state).select("rule_id", "s.*")

    def fold(self, changes: DataFrame, epoch: int) -> None:
        """Move the states on by one micro-batch of changes."""
        after = advanced(self.read(epoch - 1), changes).withColumn("at_epoch", F.lit(epoch).cast("long"))
        after.write.mode("overwrite").parquet(f"{self.path}/delta/epoch={epoch}")
        if (epoch + 1) % self.base_every == 0:
            self.read(epoch).withColumn("at_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/base/epoch={epoch}")


def admit(status: RuleStatusTable, changes: Callable[[DataFrame], DataFrame], rule_key: Column, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a stream that carries rule changes and
    events: folds the batch's changes (`changes` of it), then writes the events
    whose rule is ACTIVE, with their rule's id as __rule_id, to
    `path`/epoch=N, from where rules are evaluated as a stream."""
    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            status.fold(changes(batch), epoch)
            gate_by_rule_status(batch, status.read(epoch), rule_key).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        finally:
            batch.unpersist()

    return run
