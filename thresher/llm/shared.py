"""Tables that cut lineage, kept in the cluster's shared folder, and small
helpers for reading text columns inside tasks."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  A local session without the
    setting (tests) gets a scratch folder; a cluster session without it is an
    error, since no other folder is known to be shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="thresher-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's source, as --py-files would (once
    per application)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="thresher-src-")) / "thresher.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)


#: Spark's setting that a query's shuffle files go as it ends, and not when the driver next collects its garbage.
_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: later
    plans start from the files, which survive the loss of any executor, and
    what was shuffled for them is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FILES_GO, None)
    spark.conf.set(_FILES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FILES_GO) if before is None else spark.conf.set(_FILES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


BITS = 1 << 25  # of a bitmap, 4 MB in all whatever the table; a fuller one lets more rows through
_PIECE = 1 << 15  # bits of one bitmap_construct_agg


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """`rows` with a boolean column: false where the number `key` is surely not
    among those of `keys` (one column).  The answer comes from a bitmap that is
    broadcast, so wide rows can be left out before they are moved; a join has
    to settle what it lets through."""
    place = F.pmod(F.col(keys.columns[0]), F.lit(BITS))
    places = keys.select(F.floor(place / _PIECE).cast("int").alias("__piece"), F.pmod(place, F.lit(_PIECE)).alias("__bit"))
    pieces = places.repartition("__piece").groupBy("__piece").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    at = F.pmod(F.col(key), F.lit(BITS))
    asked = rows.withColumns({"__at": F.pmod(at, F.lit(_PIECE)).cast("int"), "__of": F.floor(at / _PIECE).cast("int")})
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, F.pmod("__at", F.lit(8))) == 1, F.lit(False))
    found = asked.join(F.broadcast(pieces), F.col("__of") == F.col("__piece"), "left")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], is_set.alias(flag))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform.startswith("linux") else None


def give_back() -> None:
    """Freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(scan: Callable) -> Callable:
    """A task function that gives the memory it has freed back to the machine
    at its end: a worker runs many tasks, of several stages, and both the Arrow
    pool and the C library would else keep their largest size of all."""
    @functools.wraps(scan)
    def run(*args):
        try:
            yield from scan(*args)
        finally:
            give_back()

    return run


def plus(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    """A schema with more columns."""
    return T.StructType([*schema.fields, *(T.StructField(name, kind) for name, kind in kinds.items())])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (shift-xor-multiply, two rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
