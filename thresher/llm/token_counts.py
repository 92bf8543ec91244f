"""Token counts by an exact length histogram.

Documents are encoded (byte-level BPE of a public vocabulary file) and only
counted: the table becomes (length, documents).  Suffix sums over that
histogram answer, for every context limit, how many documents are as long or
longer, how many tokens they hold, what is left of all documents when they are
cut at the limit, and which share of documents is shorter; so totals and any
quantile come from one small table.

The suffix sums are made in two steps, by bands of BAND lengths: sums within a
band, and sums over the bands, so no task sorts the whole histogram.

Defined cases: a null or empty text has length 0; special tokens in a text are
ordinary text; equal texts count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.llm.shared import plus, stored

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The fixed split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BAND = 1024
PIECE = 1 << 16  # characters encoded at once, cut where the pattern cuts anyway
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of bounded size, each beginning with one blank
    between two letters, where no token goes across."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut > at and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1:cut + 2].isalpha()):
            cut -= 1
        if cut == at:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_lengths(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """`docs` without text, with n_tokens.  The file must be at `path` on every executor."""
    kept = [c for c in docs.columns if c not in ("text", "n_tokens")]
    lean = docs.select(*kept, docs["text"].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            counts = [sum(len(encoder.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in batch.column("_text").cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(counts, pa.int64())], [*kept, "n_tokens"])

    return lean.mapInArrow(run, plus(lean.drop("_text").schema, n_tokens=T.LongType()))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length: n_tokens, n_docs, and suffix sums docs_ge, tokens_ge
    (documents of this length or longer, and their tokens), truncated_total (all
    tokens when documents are cut at this length) and quantile (the share of
    documents of at most this length)."""
    hist = stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("band", F.floor(F.col("n_tokens") / BAND)), "histogram")
    after = Window.rowsBetween(1, Window.unboundedFollowing)
    bands = hist.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    wide = bands.withColumn("wide", F.floor(F.col("band") / BAND))
    far = wide.groupBy("wide").agg(F.sum("d").alias("wd"), F.sum("t").alias("wt"))
    # lengths are below 2^31, so there are at most 2^11 wide bands to go through in order
    beyond_wide = far.select("wide", F.coalesce(F.sum("wd").over(after.orderBy("wide")), F.lit(0)).alias("wd"), F.coalesce(F.sum("wt").over(after.orderBy("wide")), F.lit(0)).alias("wt"),
                             F.sum("wd").over(Window.partitionBy()).alias("all_docs"), F.sum("wt").over(Window.partitionBy()).alias("all_tokens"))
    inside = after.partitionBy("wide").orderBy("band")
    beyond = wide.select("wide", "band", F.coalesce(F.sum("d").over(inside), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(inside), F.lit(0)).alias("t")).join(beyond_wide, "wide")
    up = Window.partitionBy("band").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    whole = hist.withColumns({"d0": F.sum("n_docs").over(up), "t0": F.sum(F.col("n_docs") * F.col("n_tokens")).over(up)}).join(
        beyond.select("band", (F.col("d") + F.col("wd")).alias("d1"), (F.col("t") + F.col("wt")).alias("t1"), "all_docs", "all_tokens"), "band")
    ge, tokens = F.col("d0") + F.col("d1"), F.col("t0") + F.col("t1")
    return whole.select(
        "n_tokens", "n_docs", ge.alias("docs_ge"), tokens.alias("tokens_ge"), (F.col("all_tokens") - tokens + ge * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("all_docs") - ge + F.col("n_docs")) / F.col("all_docs")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens over it, and the total when
    documents are cut at it.  Any limit works, whether a document has it or not."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    sums = [F.struct(F.lit(x).cast("long").alias("limit"), F.sum(F.when(n > x, d).otherwise(0)).alias("docs_over"),
                     F.sum(F.when(n > x, (n - x) * d).otherwise(0)).alias("tokens_cut"), F.sum(F.least(n, F.lit(x)) * d).alias("truncated_total")) for x in limits]
    return histogram.agg(F.array(*sums).alias("a")).select(F.inline("a"))
