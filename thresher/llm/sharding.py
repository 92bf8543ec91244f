"""Sharding by fixed virtual slots.

Records are hashed into SLOTS slots; bytes are added up per slot; a versioned
table maps slots to shards.  Version 1 deals the slots out in turn.  A later
version is the one before with as few slots moved as it takes: rebalancing
moves or swaps slots between the fullest and the emptiest shard while that
brings the two nearer, and a new shard takes slots only into itself.  The map
has SLOTS rows whatever the size of the table; records never meet the driver.

Within its shard a record has a place, numbered from 0 without gaps: slots one
after the other, within a slot by sub-slot (a second hash, as many as keep a
piece at about PIECE rows), within a sub-slot by order.  So no task numbers
more than a piece.

Defined cases: a null text has no bytes and counts 8 for its record; records
are hashed by doc_id and text, so null or repeated ids spread; rows equal in both are
counted and their copies dealt to one slot after the other, so that no slot is
theirs (which copy goes where is all one); an empty table has the map of version 1
and no rows.  Where the path holds a map already, its last version is edited.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thresher.llm.shared import stored

SLOTS = 4096
PIECE = 20_000
OVERHEAD = 8  # bytes of a record beside its text
COPIES = 10_000  # copies of one row that a task deals at a time


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    return {s: s % shards for s in range(slots)}


def rebalanced(held: dict[int, int], size: dict[int, int], shards: int, moves: int | None = None) -> dict[int, int]:
    """The map edited so that the shards' bytes are near equal: as long as it
    helps, the fullest shard gives the emptiest a slot, or swaps one with it,
    such that their difference gets smallest."""
    held = dict(held)
    inside: list[dict[int, int]] = [{} for _ in range(shards)]
    for s, shard in held.items():
        inside[shard][s] = size.get(s, 0)
    load = [sum(x.values()) for x in inside]
    for _ in range(moves if moves is not None else 4 * len(held)):
        lo = min(range(shards), key=lambda i: (load[i], i))
        best = None
        for hi in sorted(range(shards), key=lambda i: (-load[i], i))[:2]:
            gap = load[hi] - load[lo]
            if gap <= 1:
                continue
            give = sorted(((b, s) for s, b in inside[hi].items() if b))
            take = [(0, -1), *sorted((b, s) for s, b in inside[lo].items() if b)]
            j = 0
            for b, s in give:  # for each slot given, the one taken back that leaves the least difference
                while j + 1 < len(take) and take[j + 1][0] <= b - gap / 2:
                    j += 1
                for t in take[j:j + 2]:
                    after = abs(gap - 2 * (b - t[0]))
                    if after < gap and (best is None or after < best[0]):
                        best = (after, hi, s, t[1])
            if best:
                break
        if not best:
            break
        _, hi, s, t = best
        for slot, a, b in ((s, hi, lo), (t, lo, hi)):
            if slot >= 0:
                w = inside[a].pop(slot)
                inside[b][slot] = w
                load[a] -= w
                load[b] += w
                held[slot] = b
    return held


def grown(held: dict[int, int], size: dict[int, int], shards: int) -> dict[int, int]:
    """The map with one more shard (number `shards`), which takes slots from the
    fullest shards until it has its share; no other slot moves."""
    held = dict(held)
    inside: list[dict[int, int]] = [{} for _ in range(shards)]
    for s, shard in held.items():
        inside[shard][s] = size.get(s, 0)
    load = [sum(x.values()) for x in inside]
    share, got = sum(load) / (shards + 1), 0
    while got < share:
        hi = max(range(shards), key=lambda i: (load[i], -i))
        fits = [(b, s) for s, b in inside[hi].items() if 0 < b <= share - got]
        if not fits:
            break
        b, s = max(fits, key=lambda x: (x[0], -x[1]))
        inside[hi].pop(s)
        load[hi] -= b
        got += b
        held[s] = shards
    return held


class SlotMap:
    """The stored map: a table (version, slot, shard), one folder per version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, version: int, held: dict[int, int]) -> DataFrame:
        rows = self.spark.createDataFrame(sorted(held.items()), "slot int, shard int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return self.read(version)

    def last(self) -> int:
        """The last whole version; 0 without any."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = [n for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max((int(n.removeprefix("version=")) for n in whole), default=0)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.path}/version={version}")


def hashed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and a hash of each record.  Rows
    equal in doc_id and text are counted first; copy i is dealt i slots further
    on and has a hash of its own.  A row of very many copies is dealt in blocks,
    by several tasks."""
    text = F.col("text").cast("string")
    records = docs.select(F.col("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
                          F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id", text).alias("hash"))
    counted = records.groupBy("doc_id", "size", "text_crc32", "hash").agg(F.count("*").alias("copies"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}")))).repartition("hash", "block")
    first = F.col("block") * COPIES
    copy = F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1)
    dealt = blocks.select("doc_id", "size", "text_crc32", "hash", F.explode(copy).alias("copy"))
    own = F.when(F.col("copy") == 0, F.col("hash")).otherwise(F.xxhash64("hash", "copy"))
    return dealt.select("doc_id", "size", "text_crc32", own.alias("hash"), F.pmod(F.pmod("hash", F.lit(slots)) + F.col("copy"), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes of each slot: at most SLOTS rows."""
    return {r.virtual_slot: r.b for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()}


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """The records with `shard` and `slot`, their place in it."""
    n = records.count()
    pieces = max(1, n // (SLOTS * PIECE))
    sub = F.pmod(F.xxhash64("hash"), F.lit(pieces)).cast("int")
    cells = (records.withColumn("sub", sub).groupBy("virtual_slot", "sub").agg(F.count("*").alias("n")))
    by_slot = cells.groupBy("virtual_slot").agg(F.sum("n").alias("total")).join(F.broadcast(slot_map), F.col("virtual_slot") == F.col("slot")).drop("slot")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # of SLOTS rows, then of the pieces of one slot
    starts = by_slot.withColumn("start", F.coalesce(F.sum("total").over(before.partitionBy("shard").orderBy("virtual_slot")), F.lit(0)))
    inner = cells.withColumn("inner", F.coalesce(F.sum("n").over(before.partitionBy("virtual_slot").orderBy("sub")), F.lit(0)))
    offsets = inner.join(starts.select("virtual_slot", "shard", "start"), "virtual_slot").select("virtual_slot", "sub", "shard", (F.col("start") + F.col("inner")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "sub").orderBy("hash", "doc_id", "size"))
    return (records.withColumn("sub", sub).withColumn("nth", nth).join(offsets, ["virtual_slot", "sub"])
            .withColumn("slot", (F.col("start") + F.col("nth") - 1).cast("long")).drop("start", "nth", "sub"))


def shard(docs: DataFrame, path: str, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot: the records dealt by
    a new version of the map at `path`: the last one there (else version 1, the
    slots in turn) rebalanced by the records' bytes."""
    records = stored(hashed(docs), "records")
    slots = SlotMap(docs.sparkSession, path)
    last = slots.last()
    if not last:
        slots.write(1, first_map(shards))
        last = 1
    held = {r.slot: r.shard for r in slots.read(last).collect()}  # SLOTS rows
    current = slots.write(last + 1, rebalanced(held, slot_bytes(records), shards))
    return placed(records, current).drop("hash")


def shard_loads(held: dict[int, int], size: dict[int, int], shards: int) -> list[int]:
    load = [0] * shards
    for s, of in held.items():
        load[of] += size.get(s, 0)
    return load


def moved(before: dict[int, int], after: dict[int, int]) -> Iterable[int]:
    """Slots that an edit of the map has moved."""
    return (s for s, of in after.items() if before.get(s) != of)
