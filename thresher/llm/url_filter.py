"""URL filters: rules first, then logistic regression on hashed character
n-grams of host and path.

Rules are host and path prefixes; a rule fits its host and all subdomains, and
the longest that fits decides.  What no rule decides, the model does.  It is
trained here on a small labelled table of URLs, at most LABELLED rows (by
default those of the table that a rule decides, half of each verdict, smallest
hash first), with features hashed into DIM buckets.

Scoring is one scan without a shuffle; the model is a few hundred KB.  Defined
cases: a URL that is null or has no `://` has an empty host and path, which no
rule fits; without labelled rows of both kinds the model allows everything
unless all labelled rows are blocked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.llm.shared import mix64, plus

# (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DIM = 1 << 15
GRAMS = (3, 4, 5)
LABELLED = 4000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*+", 0), upper, lower), F.lit("")),
            F.coalesce(F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*+", ""), r"^[^?#]*+", 0), F.lit("")))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict (null: none)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def features(hosts: list[str], paths: list[str]) -> list[np.ndarray]:
    """The distinct buckets of each URL's n-grams; host and path are kept apart."""
    out = []
    for h, p in zip(hosts, paths, strict=True):
        parts = []
        for mark, text in ((1, f"^{h}$"), (2, f"^{p}$")):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            for n in GRAMS:
                k = len(points) - n + 1
                if k > 0:
                    code = np.full(k, mark * 31 + n, np.uint64)
                    for j in range(n):
                        code = code * np.uint64(0x100000001B3) + points[j:j + k]
                    parts.append(mix64(code) % np.uint64(DIM))
        out.append(np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.empty(0, np.int64))
    return out


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def block_probability(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        rows = features(hosts, paths)
        score = np.array([self.weights[r].sum() / np.sqrt(max(len(r), 1)) for r in rows]) + self.bias
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def train(hosts: list[str], paths: list[str], block: np.ndarray, *, epochs: int = 12, rate: float = 0.5, l2: float = 1e-4, seed: int = 3) -> UrlModel:
    """Logistic regression by adaptive gradient steps, one URL at a time."""
    rows = features(hosts, paths)
    w, g2, bias, b2 = np.zeros(DIM), np.full(DIM, 1e-6), 0.0, 1e-6
    if len(block) == 0 or block.min() == block.max():
        return UrlModel(w, 4.0 if len(block) and block[0] else -4.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, scale = rows[i], 1 / np.sqrt(max(len(rows[i]), 1))
            p = 1 / (1 + np.exp(-np.clip(w[r].sum() * scale + bias, -40, 40)))
            g = (p - block[i]) * scale + l2 * w[r]
            g2[r] += g * g
            w[r] -= rate * g / np.sqrt(g2[r])
            b2 += (p - block[i]) ** 2
            bias -= rate * (p - block[i]) / np.sqrt(b2)
    return UrlModel(w, float(bias))


def labelled_by_rules(parsed: DataFrame, rows: int = LABELLED) -> DataFrame:
    """A small labelled table: of the URLs that a rule decides, at most rows / 2
    for each verdict."""
    half = [parsed.filter(F.col("_ruled") == v).select("host", "path", F.lit(v).alias("verdict")).distinct()
            .orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows // 2) for v in ("allow", "block")]
    return half[0].unionByName(half[1])


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_probability (the model's) of
    every row.  `labelled` (host, path, verdict) must be a small table; of a
    larger one, LABELLED rows are learnt from."""
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": name, "_ruled": verdict})
    table = labelled.select("host", "path", "verdict").orderBy(F.xxhash64("host", "path"), "host", "path").limit(LABELLED) if labelled is not None else labelled_by_rules(parsed)
    known = table.orderBy("host", "path", "verdict").toPandas()  # LABELLED rows at most
    model = train(known["host"].tolist(), known["path"].tolist(), (known["verdict"] == "block").to_numpy(float))
    given = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = given.value.block_probability(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "block_probability"])

    scored = parsed.mapInArrow(run, plus(parsed.schema, block_probability=T.DoubleType()))
    chosen = F.coalesce("_ruled", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", chosen.alias("verdict"), "block_probability")
