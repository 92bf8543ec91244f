"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of `size` consecutive words (an item
of fewer words is one window).  A document contains a window when it holds the
window's words in a row.  A window is the set of its shingles (five words in a
row; all its words where it has fewer), and containment asks for all of them,
so the necessary prefix of a window, in an order of shingles by rarity, is its
rarest shingle alone:

1. Rarity: one scan counts how often the documents hold each shingle of the
   windows (counted in the tasks, summed per shingle).
2. Join: a second scan looks the documents' shingles up among the windows'
   prefix shingles.  A match proposes one place of the window in the document;
   length and position bounds drop places that begin before the document or
   end after it.
3. Verification, exact: the words' hashes in order, then the words' bytes, over
   a stretch as long as the window.

Windows are asked in blocks of bounded size and bytes, each broadcast; documents
are never shuffled, so a passage that many documents share costs no more than
its occurrences.  With more than one block the documents' hits so far are
written in between, and the next scan goes on from them.

Defined cases: null or wordless documents have no words and no hits; null or
wordless items have no windows; an item without id marks words, but is not
listed; rows of one item_id are one item; a repeated document is judged row by
row; only the id and text columns of either table are read, so further columns
of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thresher.llm.shared import lean, mix64, slices, stored, text_bytes
from thresher.llm.words import LOWER, LOWER_TEXT, PATTERN, UPPER_TEXT, HashTable, runs, same_bytes, word_hashes, word_spans

WINDOW = 10
SHINGLE = 5
WINDOWS_PER_BLOCK = 200_000
BYTES_PER_BLOCK = 64_000_000
_PLACE = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct rows (item, window): the item's id as text, and the window's words joined by blanks."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), UPPER_TEXT, LOWER_TEXT), F.lit(PATTERN), F.lit(0))
    rows = items.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    window = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))),
                         lambda i: F.array_join(F.slice(F.col("w"), i, size), " "))
    return rows.select("item", F.explode(window).alias("window")).distinct()


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each word on (they may cross texts)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * _PLACE[0]
    for j in range(1, width):
        total += words[j:j + n] * _PLACE[j]
    return mix64(total + np.uint64(width))


class Windows:
    """A block of windows: their words, shingles, and the items of each."""

    def __init__(self, texts: list[str], items: list[str | None]):
        distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        self.data, offsets = text_bytes(pa.array(list(distinct), pa.large_string()))
        self.starts, self.lengths, row = word_spans(self.data, offsets)
        self.words = word_hashes(self.data, self.starts, self.lengths)
        self.size = np.bincount(row, minlength=len(distinct))  # words of each window
        self.first = np.cumsum(self.size) - self.size
        # the items of each window, one run after the other
        self.item_ids = sorted({i for i in items if i is not None})
        number = {x: i for i, x in enumerate(self.item_ids)}
        pairs = sorted((distinct[t], number[i]) for t, i in zip(texts, items) if i is not None)
        self.item_of = np.array([i for _, i in pairs], np.int64)
        self.items_at = np.searchsorted(np.array([w for w, _ in pairs], np.int64), np.arange(len(distinct) + 1))
        # (shingle, window, place in the window) by width
        self.widths = sorted({min(int(s), SHINGLE) for s in self.size})
        self.shingles = {}
        for width in self.widths:
            at = shingle_hashes(self.words, width)
            owner = row[: len(at)]
            place = np.arange(len(at)) - self.first[owner]
            use = (place + width <= self.size[owner]) & (np.minimum(self.size[owner], SHINGLE) == width)
            self.shingles[width] = (at[use], owner[use], place[use])

    def vocabulary(self) -> dict[int, HashTable]:
        return {width: HashTable(np.unique(s)) for width, (s, _, _) in self.shingles.items()}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle (ties: the first), by the counts of `vocabulary`."""
        self.prefix = {}
        for width, (shingle, owner, place) in self.shingles.items():
            keys = np.unique(shingle)
            rarity = counts[width][np.searchsorted(keys, shingle)]
            order = np.lexsort((place, rarity, owner))
            rarest = order[np.append(True, owner[order][1:] != owner[order][:-1])] if len(order) else order
            # windows by their prefix shingle, one run after the other
            by = rarest[np.argsort(shingle[rarest], kind="stable")]
            used, at = np.unique(shingle[by], return_index=True)
            self.prefix[width] = (HashTable(used), np.append(at, len(by)), owner[by], place[by])
        del self.shingles


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column("text"))
    for i, j in slices(offsets):
        yield i, j, LOWER[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i]


def _count(vocabulary) -> object:
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary.value
        counts = {width: np.zeros(len(t.keys), np.int64) for width, t in tables.items()}
        for batch in batches:
            for _, _, data, offsets in _texts(batch):
                starts, lengths, row = word_spans(data, offsets)
                words = word_hashes(data, starts, lengths)
                for width, t in tables.items():
                    hashes = shingle_hashes(words, width)
                    at, key = t.find(hashes)
                    inside = row[at] == row[at + width - 1]
                    counts[width] += np.bincount(key[inside], minlength=len(t.keys))
        for width, c in counts.items():
            seen = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), width, np.int32)), pa.array(seen.astype(np.int32)), pa.array(c[seen])], ["width", "key", "n"])

    return scan


def occurrences(windows: Windows, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every place where a window's words stand in a row."""
    words = word_hashes(data, starts, lengths)
    found_at, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for width, (table, runs_at, owner, place) in windows.prefix.items():
        at, key = table.find(shingle_hashes(words, width))
        many = runs_at[key + 1] - runs_at[key]
        entry = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(runs_at[key], many)
        window, begin = owner[entry], np.repeat(at, many) - place[entry]
        last = begin + windows.size[window] - 1
        # length and position: the window lies inside one text
        inside = (begin >= 0) & (last < len(row))
        begin, window, last = begin[inside], window[inside], last[inside]
        inside = row[begin] == row[last]
        begin, window = begin[inside], window[inside]
        for k in range(int(windows.size[window].max()) if len(window) else 0):
            here = windows.size[window] > k
            same = np.ones(len(window), bool)
            mine, its = begin[here] + k, windows.first[window[here]] + k
            same[here] = (words[mine] == windows.words[its]) & (lengths[mine] == windows.lengths[its])
            begin, window = begin[same], window[same]
        for k in range(int(windows.size[window].max()) if len(window) else 0):
            here = windows.size[window] > k
            same = np.ones(len(window), bool)
            mine, its = begin[here] + k, windows.first[window[here]] + k
            same[here] = same_bytes(data, starts[mine], windows.data, windows.starts[its], lengths[mine])
            begin, window = begin[same], window[same]
        found_at.append(begin)
        found.append(window)
    return np.concatenate(found_at), np.concatenate(found)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row starts and the flat values of a list column (no nulls)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    return offsets - offsets[0], column.values.slice(offsets[0], offsets[-1] - offsets[0])


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _probe(block) -> object:
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = block.value
        ids = pa.array(windows.item_ids, pa.string())
        for batch in batches:
            span_at, spans = _lists(batch.column("spans"))
            item_at, items = _lists(batch.column("items"))
            for i, j, data, offsets in _texts(batch):
                n = j - i
                starts, lengths, row = word_spans(data, offsets)
                n_words = np.bincount(row, minlength=n)
                base = np.cumsum(n_words) - n_words
                begin, window = occurrences(windows, data, starts, lengths, row)
                # hits so far and new ones, as one mark per word
                edge = np.zeros(len(row) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + windows.size[window], -1)
                old = spans.slice(span_at[i], span_at[j] - span_at[i])
                owner = np.repeat(np.arange(n), np.diff(span_at[i:j + 1]))
                np.add.at(edge, np.asarray(old.field("start")) + base[owner], 1)
                np.add.at(edge, np.asarray(old.field("end")) + base[owner], -1)
                hit = np.cumsum(edge[:-1]) > 0
                # a stretch of hits ends with its text
                bounds = np.append(base, len(row))
                s, e = runs(hit, bounds)
                of = row[s]
                new_spans = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(s - base[of]), pa.array(e - base[of])], fields=list(_SPAN)))
                # items: those so far, and those of the windows found
                many = windows.items_at[window + 1] - windows.items_at[window]
                entry = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(windows.items_at[window], many)
                pairs = np.unique(np.repeat(row[begin], many) * np.int64(max(len(ids), 1)) + windows.item_of[entry])
                doc, item = pairs // max(len(ids), 1), pairs % max(len(ids), 1)
                new_items = _merged(n, item_at[i:j + 1], items, doc, ids.take(pa.array(item)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), batch.column("text").slice(i, n), pa.array(n_words.astype(np.int64)), new_spans, new_items],
                    ["doc_id", "text", "n_words", "spans", "items"])

    return scan


def _merged(n: int, old_at: np.ndarray, old: pa.Array, doc: np.ndarray, new: pa.Array) -> pa.Array:
    """Per row, the sorted distinct items of both."""
    counts = np.bincount(doc, minlength=n)
    if old_at[-1] == old_at[0]:  # ids were sorted as text, so each row's are
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), new)
    new_at = np.append(0, np.cumsum(counts))
    rows = [sorted(set(old.slice(old_at[r], old_at[r + 1] - old_at[r]).to_pylist()) | set(new.slice(new_at[r], counts[r]).to_pylist()))
            for r in range(n)]
    return pa.array(rows, pa.list_(pa.string()))


def contaminated_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", item_id: str = "item_id",
                       text: str = "text", per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """Per document row: its id (as `doc_id`), n_words, spans (array of word
    ranges [start, end) that lie in occurrences of item windows, merged) and
    items (sorted ids, as text, of the items with such windows)."""
    spark = docs.sparkSession
    windows = stored(item_windows(items, size, item_id, text), "windows")
    total, length = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window") + 64), F.lit(0))).first()
    blocks = max(1, -(-total // per_block), -(-length // BYTES_PER_BLOCK))
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType()))])
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    state = texts.select("doc_id", "text", F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b).toArrow()
        block = Windows(rows.column("window").to_pylist(), rows.column("item").to_pylist())
        tables = block.vocabulary()
        shipped = spark.sparkContext.broadcast(tables)
        seen = texts.select("text").mapInArrow(_count(shipped), "width int, key int, n long").groupBy("width", "key").agg(F.sum("n").alias("n")).toArrow()
        shipped.unpersist()
        counts = {width: np.zeros(len(t.keys), np.int64) for width, t in tables.items()}
        for width in counts:
            mine = np.asarray(seen.column("width")) == width
            counts[width][np.asarray(seen.column("key"))[mine]] = np.asarray(seen.column("n"))[mine]
        block.choose(counts)
        state = state.select("doc_id", "text", "spans", "items").mapInArrow(_probe(spark.sparkContext.broadcast(block)), schema)
        if b < blocks - 1:
            state = stored(state, "hits")
    return state.drop("text")
