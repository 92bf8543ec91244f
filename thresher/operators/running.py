"""Running (prefix) aggregates within groups, safe for hot groups.

A plain `Window.partitionBy(group).orderBy(o)` sorts a whole group inside one
task, so a group holding a third of all rows would sit in one task.  Here a
group is cut into chunks of the ordering column (`o div width`); each chunk
holds at most `width` rows when `o` is unique, as an ingestion id is.

    1. per (group, chunk) totals             hash aggregate, map-side combine
    2. exclusive prefix of the chunk totals   window over one row per chunk
    3. join offsets back on (group, chunk)    keys bounded by `width` rows
    4. running sum inside (group, chunk)      window over <= width rows

Only steps 2 and 4 are windows, and neither sees more than one row per
chunk (2) or `width` rows (4).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_WIDTH = 1 << 20


def running_sums(df: DataFrame, group_cols: list[str], order_col: str, values: dict[str, Column],
                 chunk_width: int = DEFAULT_CHUNK_WIDTH, last_flag: str | None = "__is_last") -> DataFrame:
    """Add one inclusive running-sum column per entry of `values`, in
    `order_col` order within each group, and (optionally) a boolean column
    telling whether the row is its group's last one.

    `order_col` must be unique within a group (ties would make the order,
    and so the prefix, arbitrary).  Null group keys form their own group.
    """
    chunk = F.floor(F.col(order_col) / F.lit(chunk_width)).cast("long")
    tmp = {name: f"__v_{name}" for name in values}
    base = df.select("*", chunk.alias("__chunk"), *[v.alias(tmp[n]) for n, v in values.items()])

    totals = base.groupBy(*group_cols, "__chunk").agg(
        *[F.sum(tmp[n]).alias(f"__t_{n}") for n in values],
        F.max(order_col).alias("__chunk_last"),
    )
    before = Window.partitionBy(*group_cols).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    offsets = totals.select(
        *[F.col(c).alias(f"__g_{c}") for c in group_cols], F.col("__chunk").alias("__g_chunk"),
        *[F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in values],
        F.max("__chunk_last").over(whole).alias("__group_last"),
    )
    cond = functools.reduce(
        lambda a, b: a & b,
        [base[c].eqNullSafe(offsets[f"__g_{c}"]) for c in group_cols] + [base["__chunk"] == offsets["__g_chunk"]],
    )
    joined = base.join(offsets, cond, "inner")
    inside = Window.partitionBy(*group_cols, "__chunk").orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out_cols = [F.col(c) for c in df.columns]
    for n in values:
        zero = F.lit(0).cast(offsets.schema[f"__o_{n}"].dataType)
        out_cols.append((F.sum(tmp[n]).over(inside) + F.coalesce(F.col(f"__o_{n}"), zero)).alias(n))
    if last_flag:
        out_cols.append((F.col(order_col) == F.col("__group_last")).alias(last_flag))
    return joined.select(*out_cols)
