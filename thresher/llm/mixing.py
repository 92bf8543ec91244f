"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target /
source size.  Its whole part is taken outright; the fractional parts are
rounded together: two documents at a time, mass (copies times size) moves from
one to the other, by a fair random choice, until one fraction is 0 or 1.  The
expected copies of every document stay as they were, and the mass of the
source stays exactly its target while any fraction is left.

The rounding is a distributed reduction tree: documents of a source are dealt
by hash into groups of about GROUP rows, each group is one small task that
leaves one fraction and those it holds back, one for each of some 50 classes of
size, and the fractions of FAN_IN groups meet on the next level, until one
group per source is left.  There the last fractions are rounded largest first,
each carrying its error to the next, a little smaller one, which leaves an
error of about the smallest document; turning one or two of them around
brings it down to a few words.  A hot source is many
groups; nothing is gathered in one task but the fractions.

Defined cases: a null or blank text has size 0 and adds no words; a null source is a
source, the last; rows with equal doc_id are rows of their own; draws depend on
the source, the group and the documents in it, so reruns agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thresher.llm.shared import stored

GROUP = 4096
FAN_IN = 64
RESERVE = 1.25  # ratio of the size classes of which one document each is held back
_ROUNDED = "doc_id long, source string, size long, salt long, grp long, p double, extra int"


def words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`sources` (source, source_size) with `target`.  By code point, null last,
    sources weigh `weights`, repeating, and share `share` times all sizes; none
    gets over `most` times its size, and what is cut off is shared again by
    weight until none is above.

    A source that reaches its limit at some level stays there as the level
    rises, so the rounds of sharing end; each is one aggregate of the sources."""
    spark = sources.sparkSession
    ordered = sources.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    numbered = ordered.select("source", "source_size").rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[1]))
    weight = F.array(*[F.lit(float(w)) for w in weights])
    known = stored(spark.createDataFrame(numbered, "source string, source_size long, nth long").select(
        "source", "source_size", F.get(weight, (F.col("nth") % len(weights)).cast("int")).alias("weight")), "sources")
    total = float(known.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1.0
    while level > before:
        capped = F.col("source_size") * most < F.col("weight") * level
        left, w = known.agg(F.sum(F.when(capped, F.col("source_size") * most).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not w:
            break
        before, level = level, (share * total - left) / w
    return known.select("source", "source_size", F.least(F.col("source_size") * float(most), F.col("weight") * level).alias("target"))


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")


def pivotal(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round fractions in turn against the one that is left: each step keeps the
    pair's mass and every expectation, and makes one of the two 0 or 1."""
    p = p.copy()
    draws = rng.random(len(p))
    held = 0
    for i in range(1, len(p)):
        a, b, wa, wb = p[held], p[i], size[held], size[i]
        up = min((1 - a) * wa, b * wb)  # mass that can move to the held one
        down = min(a * wa, (1 - b) * wb)
        if draws[i] * (up + down) < down:
            m, a_ends = up, (1 - a) * wa <= b * wb
            p[held], p[i] = (1.0, b - m / wb) if a_ends else (a + m / wa, 0.0)
        else:
            m, a_ends = down, a * wa <= (1 - b) * wb
            p[held], p[i] = (0.0, b + m / wb) if a_ends else (a - m / wa, 1.0)
        for k in (held, i):
            if p[k] < 1e-12 or p[k] > 1 - 1e-12:
                p[k] = round(p[k])
        if p[held] in (0.0, 1.0):
            held = i
    return p


def _settled(size: np.ndarray, taken: np.ndarray, missing: float) -> np.ndarray:
    """The last roundings with one or two turned around at a time, as long as
    that brings the mass nearer to its target (`missing` is still to be taken)."""
    taken = taken.copy()
    while len(taken):
        change = np.append(np.where(taken > 0, -size, size), 0.0)  # the last place: nothing more
        both = np.abs(missing - (change[:, None] + change)) + np.where(np.eye(len(change), dtype=bool), np.inf, 0)
        i, j = np.unravel_index(both.argmin(), both.shape)
        if both[i, j] >= abs(missing) - 1e-9:
            break
        missing -= change[i] + change[j]
        for k in (i, j):
            if k < len(taken):
                taken[k] = 1 - taken[k]
    return taken


def _reduce(root: bool):
    """Round one group's fractions, but for a few; at the root, all."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "salt", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
        size, p = rows["size"].to_numpy(float), rows["p"].to_numpy(float)
        rng = np.random.default_rng(_seed(key, len(rows), int(rows["salt"].to_numpy(np.int64).sum())))
        # held back: the first document of each size class
        step = np.floor(np.log(size) / np.log(RESERVE))
        free = np.flatnonzero(np.append(False, step[1:] == step[:-1]))
        if len(free) > 1:
            p[free] = pivotal(size[free], p[free], rng)
        if root:
            carry, last = 0.0, []
            for i in range(len(p)):
                if 0 < p[i] < 1:
                    want = p[i] + carry / size[i]
                    taken = 1.0 if want >= 0.5 else 0.0
                    carry += (p[i] - taken) * size[i]
                    p[i] = taken
                    last.append(i)
            p[last] = _settled(size[last], p[last], carry)
        done = (p == 0) | (p == 1)
        rows["extra"] = pd.array(np.where(done, p, -1).astype(np.int32), dtype="int32")
        rows["p"] = p
        rows["grp"] = rows["grp"] // FAN_IN
        return rows[["doc_id", "source", "size", "salt", "grp", "p", "extra"]]

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, source, size,
    source_size, target, salt (a hash of the text), copies and taken."""
    lean = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              words(F.col("text").cast("string")).alias("size"), F.xxhash64("doc_id", "text").alias("salt")), "sizes")
    totals = stored(lean.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "totals")
    targets = stored(source_targets(totals, weights, share, most), "targets")
    of = targets.join(totals.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).select("_s", "source_size", "target", "n")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = stored(lean.join(of, lean.source.eqNullSafe(F.col("_s")))
                     .select("doc_id", "source", "size", "salt", "source_size", "target", F.floor(rate).cast("int").alias("whole"), (rate - F.floor(rate)).alias("p"),
                             F.pmod(F.hash("salt", "size"), F.ceil(F.col("n") / GROUP)).cast("long").alias("grp")), "planned")
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    level = planned.filter(open_).select("doc_id", "source", "size", "salt", "grp", "p")
    groups = -(-(totals.agg(F.max("n")).first()[0] or 0) // GROUP)
    done: list[DataFrame] = []
    while True:
        root = groups <= 1
        rounded = stored(level.groupBy("source", "grp").applyInPandas(_reduce(root), _ROUNDED), "level")
        done.append(rounded.filter("extra >= 0").select("doc_id", "source", "size", "salt", "extra"))
        if root:
            break
        level = rounded.filter("extra < 0").drop("extra")
        groups = -(-groups // FAN_IN)
    extra = done[0]
    for more in done[1:]:
        extra = extra.unionByName(more)
    # rows that agree in all of these are the same document; which of them gets the extra copy doesn't matter
    same = ["doc_id", "source", "size", "salt"]
    taken = extra.groupBy(*same).agg(F.sum("extra").alias("extra"), F.count("*").alias("rows"))
    one = planned.groupBy(*same, "source_size", "target", "whole").agg(F.count("*").alias("rows"))
    joined = one.alias("a").join(taken.alias("b"), (F.col("a.salt") == F.col("b.salt")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
                                 & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")), "left")
    each = joined.select("a.doc_id", "a.source", "a.size", "a.salt", "source_size", "target", "whole", F.coalesce("extra", F.lit(0)).alias("extra"),
                         F.explode(F.sequence(F.lit(1), F.col("a.rows"))).alias("nth"))
    copies = (F.col("whole") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", "salt", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, **settings: object) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; columns as they were."""
    times = stored(mix(docs, **settings).groupBy("doc_id", "salt").agg(F.sum("copies").alias("_total"), F.count("*").alias("_rows"))
                   .filter("_total > 0").select(F.col("doc_id").alias("_id"), F.col("salt").alias("_key"), "_total", "_rows"), "times")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("salt"))
    joined = whole.join(times, (F.col("salt") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    if times.filter("_rows > 1").isEmpty():
        copies = F.col("_total")
    else:  # rows equal in doc_id and text share their copies evenly, the first ones what is left over
        joined = joined.withColumn("nth", F.row_number().over(Window.partitionBy("salt", "doc_id").orderBy("row")))
        copies = F.floor(F.col("_total") / F.col("_rows")) + F.when(F.col("nth") <= F.col("_total") % F.col("_rows"), 1).otherwise(0)
    return (joined.select("row", copies.cast("int").alias("n")).filter("n > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*"))
