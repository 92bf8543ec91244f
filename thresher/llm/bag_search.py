"""Ranked lexical search with bag deduplication.

Each query item gets its k best documents by an integer BM25.  A document's
score depends only on its length term m and on how often it holds each of the
items' words, so documents that agree in both are one class:

1. Restriction: one scan cuts every document to its bag, the items' terms that
   it holds with their counts (looked up in the broadcast vocabulary of the
   items, by hash and then by bytes), and counts all its terms.
2. Corpus figures: N, L and the terms' document frequencies over all documents.
3. Classes: rows are hashed by (m, bag) and grouped by the hash and then the
   whole bag.  A class keeps its k smallest doc_ids: no other member can be
   among the k best of any item, as members score alike and ties go to the
   smaller doc_id.  They are cut in the map tasks first, so a bag that a third
   of all rows share moves k rows a task.
4. Scores: each class is scored once against all items by postings of the
   terms; tasks keep the k best per item by raising a level per item, and
   expand classes to members by ascending doc_id.
5. The tasks' lists meet per item.

Items are asked in blocks whose vocabulary is bounded, so what is broadcast is.

Defined cases: null or wordless documents hold no term and count nowhere; rows
of one item_id are one item with all their terms (null is an item_id like
others); an item without terms has no rows; a repeated document is ranked row
by row; a document without doc_id counts in N, L and the frequencies but can't
be named in a ranking; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thresher.llm.shared import lean, slices, stored, text_bytes
from thresher.llm.words import LOWER, LOWER_TEXT, PATTERN, UPPER_TEXT, Vocabulary, word_spans

K = 10
PAIRS_PER_BLOCK = 1_000_000  # (item, term) pairs asked at once
CELLS = 1 << 21  # scores held at once in a task
STEPS = 1 << 21  # additions made at once in a task
PIECE = 1 << 16  # candidate classes expanded to members at once


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct rows (item_id, term)."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), UPPER_TEXT, LOWER_TEXT), F.lit(PATTERN), F.lit(0))
    return items.select(F.col(id_col).alias("item_id"), F.explode(words).alias("term")).distinct()


def _bags(shipped) -> object:
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shipped.value
        size = np.int64(max(len(vocabulary.words), 1))
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                lowered, off = LOWER[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i]
                starts, lengths, row = word_spans(lowered, off)
                n = np.bincount(row, minlength=j - i)
                at, word = vocabulary.find(lowered, starts, lengths)
                held, tf = np.unique(row[at] * size + word, return_counts=True)
                edge = pa.array(np.append(0, np.cumsum(np.bincount(held // size, minlength=j - i))).astype(np.int32))
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(edge, pa.array((held % size).astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(tf.astype(np.int64)))],
                    ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return scan


class Asked:
    """A block of items: postings of their terms, and the terms' weights."""

    def __init__(self, vocabulary: Vocabulary, pairs: pa.Table, weight: np.ndarray):
        ids = pairs.column("item_id").combine_chunks().dictionary_encode("encode")
        self.items = ids.dictionary
        number = {w: i for i, w in enumerate(vocabulary.words)}
        term = np.array([number[w] for w in pairs.column("term").to_pylist()], np.int64)
        order = np.argsort(term, kind="stable")
        self.posting = np.asarray(ids.indices).astype(np.int64)[order]
        self.at = np.searchsorted(term[order], np.arange(len(vocabulary.words) + 1))
        self.weight = weight


class _Best:
    """The k best (score, doc_id) per item so far; levels[i] is the least score that can still enter."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.levels = np.ones(n, np.int64)
        self.rows = np.empty((0, 3), np.int64)  # item, score, doc_id

    def add(self, item: np.ndarray, score: np.ndarray, members: np.ndarray, doc_ids: np.ndarray) -> None:
        """Candidates: `members` is a class's [first, end) range in `doc_ids`."""
        many = members[:, 1] - members[:, 0]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(members[:, 0], many)
        rows = np.concatenate([self.rows, np.stack([np.repeat(item, many), np.repeat(score, many), doc_ids[at]], axis=1)])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], np.arange(self.n))
        rank = np.arange(len(rows)) - first[rows[:, 0]]
        self.rows = rows[rank < self.k]
        last = self.rows[rank[rank < self.k] == self.k - 1]
        self.levels[last[:, 0]] = np.maximum(last[:, 1], 1)


def _score(shipped, k: int) -> object:
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shipped.value
        n_items = len(asked.items)
        best = _Best(n_items, k)
        together = max(1, CELLS // max(n_items, 1))
        for batch in batches:
            m = np.asarray(batch.column("m"))
            term_at, terms = _flat(batch.column("terms"))
            _, tfs = _flat(batch.column("tfs"))
            member_at, doc_ids = _flat(batch.column("doc_ids"))
            owner = np.repeat(np.arange(len(m)), np.diff(term_at))
            gain = asked.weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owner]))
            steps = np.append(0, np.cumsum(asked.at[terms + 1] - asked.at[terms]))  # additions before each entry
            i = 0
            while i < len(m):  # some classes at once: bounded in scores and in additions
                j = int(np.searchsorted(steps[term_at], steps[term_at[i]] + STEPS, "right")) - 1
                j = min(max(j, i + 1), i + together, len(m))
                scores = np.zeros((j - i) * n_items, np.int64)
                a, b = term_at[i], term_at[j]
                # one class of very many terms is added up in pieces
                while a < b:
                    c = min(max(int(np.searchsorted(steps, steps[a] + STEPS, "right")) - 1, a + 1), b)
                    many = asked.at[terms[a:c] + 1] - asked.at[terms[a:c]]
                    entry = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(asked.at[terms[a:c]], many)
                    np.add.at(scores, np.repeat(owner[a:c] - i, many) * n_items + asked.posting[entry], np.repeat(gain[a:c], many))
                    a = c
                grid = scores.reshape(j - i, n_items)
                of_class, item = np.nonzero(grid >= best.levels)
                while len(item):  # in pieces, as each raises the levels for the rest
                    c, now = of_class[:PIECE], item[:PIECE]
                    best.add(now, grid[c, now], np.stack([member_at[c + i], member_at[c + i + 1]], axis=1), doc_ids)
                    of_class, item = of_class[PIECE:], item[PIECE:]
                    still = grid[of_class, item] >= best.levels[item]
                    of_class, item = of_class[still], item[still]
                i = j
        yield pa.RecordBatch.from_arrays([asked.items.take(pa.array(best.rows[:, 0])), pa.array(best.rows[:, 2]), pa.array(best.rows[:, 1])], ["item_id", "doc_id", "score"])

    return scan


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets).astype(np.int64)
    return offsets - offsets[0], np.asarray(column.values.slice(offsets[0], offsets[-1] - offsets[0]))


def _weights(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)


def _block(spark: SparkSession, texts: DataFrame, pairs: pa.Table, k: int) -> DataFrame:
    vocabulary = Vocabulary(sorted(set(pairs.column("term").to_pylist())))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    bags = stored(texts.mapInArrow(_bags(spark.sparkContext.broadcast(vocabulary)), f"doc_id {id_type}, n long, terms array<int>, tfs array<long>"), "bags")
    n_docs, n_terms = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    seen = bags.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    frequency = np.zeros(len(vocabulary.words), np.int64)
    frequency[np.asarray(seen.column("term"))] = np.asarray(seen.column("count"))
    m = F.expr(f"100 - 90 + ((90 * n * {n_docs}L) div {max(n_terms, 1)}L)")
    same = ["h", "m", "terms", "tfs"]
    rows = bags.where((F.size("terms") > 0) & F.col("doc_id").isNotNull()).select(m.alias("m"), "terms", "tfs", F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.select(F.xxhash64("m", "terms", "tfs").alias("h"), "m", "terms", "tfs", "doc_id")
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("doc_id"))
    classes = rows.withColumn("nth", nth).where(F.col("nth") <= k).groupBy(*same).agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    asked = spark.sparkContext.broadcast(Asked(vocabulary, pairs, _weights(frequency, n_docs)))
    schema = f"item_id {spark_type(pairs)}, doc_id long, score long"
    return classes.select("m", "terms", "tfs", "doc_ids").mapInArrow(_score(asked, k), schema)


def spark_type(pairs: pa.Table) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(pairs.schema.field("item_id").type).simpleString()


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
           per_block: int = PAIRS_PER_BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents, score above 0.
    `doc_id` must be a whole number."""
    spark = docs.sparkSession
    pairs = stored(item_terms(items, item_id, text), "item-terms")
    blocks = max(1, -(-pairs.count() // per_block))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = None
    for b in range(blocks):
        asked = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        part = _block(spark, texts, asked, k)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
