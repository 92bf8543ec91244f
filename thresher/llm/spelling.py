"""Spelling variants: words one edit apart, found by walking a trie as a join.

The words (runs of letters that occur often enough in all documents) make a
trie, kept as a distributed table of edges (depth, node, letter, child); a word
ends with an edge of no letter.  A frontier of states (word, position, node,
edits) goes through it level by level: at each depth it meets that depth's
edges on the node.  A state without an edit follows its next letter, or spends
its edit on another letter (in place of its own, or before it) or on leaving
its own out; a state with its edit spent follows only its own letters.  States
that reach a word's end with one edit are neighbours.

* Two tries halve the walk.  An edit lies in the second half of a word or, read
  backwards, in the second half of the reversed word; so a walk starts at the
  node of its own first half, in the trie of words and in that of reversed
  words.  No state ever stands at the root, where all words would meet, and a
  node has at most an alphabet of edges: a node that a third of all words pass
  gives each of them that many states and no pairs among them.
* Edges carry what lies below: the lengths left and the next letters, as bits.
  A state whose rest fits neither is not written.
* Long words (over `LONG` letters) have their tails compressed to one edge,
  (node, hash of the rest) to word, so that the number of levels stays bounded:
  one join on the node makes their edits, one on (node, rest) ends the walk.
* Nodes are 64-bit hashes of prefixes.  Equal hashes only join nodes, which adds
  states but loses none, and every neighbour is confirmed on the words themselves.

A word's form is its most frequent neighbour if that occurs `ratio` times as
often or more.  Forms are followed to the last by pointer doubling; as n at
least doubles with each step, some six rounds end it.

Defined cases: null texts and texts without letters have no words; a null
doc_id is written as nothing before the colon; repeated rows count again; only
the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thresher.llm.shared import lean, mix64, slices, stored, text_bytes
from thresher.llm.words import LOWER, runs

LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
DAMAGE = 97  # one run in so many loses a letter
LONG = 32
COUNTED_TOGETHER = 400_000  # distinct words that a task holds before it writes them
_STEPWISE = 64  # bytes of a run whose checksum is taken for all runs at once
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1))


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths (bytes) and rows of the maximal runs of letters."""
    lead = data == _LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends = runs(inside, offsets)
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def checksums(lowered: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes, going on from the checksums `before`."""
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for j in range(min(int(size[0]) if len(size) else 0, _STEPWISE)):
        k = int(np.searchsorted(-size, -j, "left"))  # runs of more than j bytes
        state[:k] = _CRC[(state[:k] ^ lowered[at[:k] + j]) & np.uint32(255)] ^ (state[:k] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -_STEPWISE, "left"))):
        state[i] = zlib.crc32(lowered[at[i] + _STEPWISE:at[i] + size[i]].tobytes(), int(state[i]))
    out = np.empty(len(starts), np.uint32)
    out[order] = state
    return out


def _words_of(lowered: np.ndarray, offsets: np.ndarray, ids: list, least: int) -> pa.Array:
    """The results of all runs that keep `least` letters, in any order."""
    starts, lengths, row = letter_runs(lowered, offsets)
    if not len(starts):
        return pa.array([], pa.large_string())
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    checks = checksums(lowered, starts, lengths, prefix[row])
    twos = np.append(0, np.cumsum(lowered == _LEAD))
    letters = lengths - (twos[starts + lengths] - twos[starts])
    hurt = checks % np.uint32(DAMAGE) == 0
    changed = []
    for i in np.flatnonzero(hurt & (letters > least)):
        word = lowered[starts[i]:starts[i] + lengths[i]].tobytes().decode()
        at = int(checks[i]) % len(word)
        changed.append(word[:at] + word[at + 1:])
    whole = ~hurt & (letters >= least)
    mark = np.zeros(len(lowered) + 1, np.int8)
    mark[starts[whole]] += 1
    np.add.at(mark, starts[whole] + lengths[whole], -1)
    data = lowered[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    ends = np.append(0, np.cumsum(lengths[whole])).astype(np.int64)
    kept = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))
    return pa.concat_arrays([kept, pa.array(changed, pa.large_string())])


def _count(least: int) -> object:
    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def written(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=50_000)

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in slices(offsets):
                words = _words_of(LOWER[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i], ids[i:j], least)
                held.append(summed([pa.table({"word": words, "n": np.ones(len(words), np.int64)})]))
                if sum(t.num_rows for t in held) > COUNTED_TOGETHER:
                    held = [summed(held)]
                    if held[0].num_rows > COUNTED_TOGETHER // 2:
                        yield from written(held.pop())
        if held:
            yield from written(summed(held))

    return scan


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n over all documents."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(_count(least_letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- the trie of words up to LONG letters -----------------------------------------------------

def _both_ways(words: DataFrame) -> DataFrame:
    """Each word as it is (way 0) and reversed (way 1), with its length."""
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("text")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("text"))))
    return words.select("word", ways.alias("w")).select("word", "w.way", "w.text", F.length("word").alias("size"))


def _node(way: Column, prefix: Column) -> Column:
    return F.xxhash64(way, prefix)


def _letter(text: Column, at: Column) -> Column:
    """The letter at a place from 0 on; nothing at the end."""
    return text.substr(at + 1, F.lit(1))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def trie_edges(words: DataFrame) -> DataFrame:
    """depth, node, letter, child, word (at its end), and what lies below the
    child: lengths left (`lengths`) and next letters (`letters`), as bits.
    Only depths that a walk can reach: from the last letter of the first half on."""
    w = _both_ways(words).withColumn("depth", F.explode(F.sequence(F.expr("(size - 1) div 2").cast("int"), F.col("size"))))
    letter = _letter(F.col("text"), F.col("depth"))
    at_end = F.col("depth") == F.col("size")
    e = w.select(
        "depth", _node(F.col("way"), F.left("text", F.col("depth"))).alias("node"), letter.alias("letter"),
        F.when(~at_end, _node(F.col("way"), F.left("text", F.col("depth") + 1))).alias("child"), F.when(at_end, F.col("word")).alias("word"),
        _bit(F.greatest(F.col("size") - F.col("depth") - 1, F.lit(0))).alias("lengths"), _bit(F.ascii(_letter(F.col("text"), F.col("depth") + 1))).alias("letters"))
    # a word's end is one row a word and way; hashes of two words may meet there
    return e.groupBy("depth", "node", "letter", "child", "word").agg(F.bit_or("lengths").alias("lengths"), F.bit_or("letters").alias("letters"))


def _walk(words: DataFrame) -> DataFrame:
    """Rows (word, other) of words one edit apart, from the level-by-level walk."""
    edges = stored(trie_edges(words).repartitionByRange("depth", "node").sortWithinPartitions("depth", "node"), "trie")
    starts = _both_ways(words)
    half = F.when(F.col("way") == 0, F.expr("size div 2")).otherwise(F.expr("size - size div 2")).cast("int")
    starts = starts.withColumn("position", half)
    starts = stored(starts.select("position", "way", "text", _node(F.col("way"), F.left("text", F.col("position"))).alias("node"), F.lit(0).alias("edits")), "starts")
    bounds = starts.agg(F.min("position"), F.max(F.length("text"))).first()
    ends, frontier = None, None
    for depth in range(bounds[0] or 0, (bounds[1] or -1) + 1):
        states = starts.where(F.col("position") == depth)
        states = states if frontier is None else states.unionByName(frontier)
        # leave the own letter out (of equal letters in a row, the last)
        own, following = _letter(F.col("text"), F.col("position")), _letter(F.col("text"), F.col("position") + 1)
        left_out = (F.col("edits") == 0) & (own != "") & (own != following)
        both = F.when(left_out, F.array(F.struct("position", "edits"), F.struct((F.col("position") + 1).alias("position"), F.lit(1).alias("edits")))) \
            .otherwise(F.array(F.struct("position", "edits")))
        states = states.withColumn("s", F.explode(both)).select("way", "text", "node", "s.position", "s.edits", _letter(F.col("text"), F.col("s.position")).alias("own"))
        here = edges.where(F.col("depth") == depth).select(F.col("node").alias("at"), "letter", "child", "word", "lengths", "letters")
        fits = F.when(F.col("edits") == 1, F.col("letter") == F.col("own")).otherwise(F.col("letter") != "")
        met = states.join(here, (F.col("node") == F.col("at")) & fits)

        def option(step, edits):
            return F.struct((F.col("position") + step).alias("position"), F.lit(edits).alias("edits"))

        options = F.when(F.col("edits") == 1, F.array(option(1, 1))).when(F.col("letter") == F.col("own"), F.array(option(1, 0))) \
            .when(F.col("own") == "", F.array(option(0, 1))).otherwise(F.array(option(0, 1), option(1, 1)))
        moved = met.withColumn("s", F.explode(options)).select("way", "text", "child", "word", "lengths", "letters", "s.position", "s.edits")
        rest = F.length("text") - F.col("position")
        below = (F.col("lengths").bitwiseAND(_bit(rest)) != 0) & (F.col("letters").bitwiseAND(_bit(F.ascii(_letter(F.col("text"), F.col("position"))))) != 0)
        alive = F.col("word").isNotNull() | (F.col("edits") == 0) | below
        level = stored(moved.where(alive).select("position", "way", "text", F.col("child").alias("node"), "edits", "word"), "frontier")
        frontier = level.where(F.col("word").isNull()).drop("word")
        done = level.where(F.col("word").isNotNull()).select(F.when(F.col("way") == 0, F.col("text")).otherwise(F.reverse("text")).alias("word"), F.col("word").alias("other"))
        ends = done if ends is None else ends.unionByName(done)
    return words.select("word", F.col("word").alias("other")).limit(0) if ends is None else ends


# -- long words: tails compressed to one edge --------------------------------------------------

_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_TAILS = "id long, way int, size long, place long, node long, rest long, letter long, child long, child_rest long"


@lean
def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and way, and each place from the first half's last letter
    on: the node there, the hash of the rest, the next letter (0 at the end),
    and node and rest after it.  A row's size doesn't grow with its word."""
    for batch in batches:
        for key, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
            whole = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
            size = len(whole)
            powers = np.append(np.uint64(1), np.cumprod(np.full(size, _STEP), dtype=np.uint64))
            back = np.append(np.uint64(1), np.cumprod(np.full(size, _BACK), dtype=np.uint64))
            place = np.arange(size + 1, dtype=np.uint64)
            start = (size - 1) // 2
            for way, letters in ((0, whole), (1, whole[::-1])):
                sums = np.append(np.uint64(0), np.cumsum((letters + np.uint64(1)) * powers[:-1], dtype=np.uint64))
                node = mix64(sums + place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(way)).view(np.int64)
                rest = mix64((sums[-1] - sums) * back + (np.uint64(size) - place)).view(np.int64)
                n = size + 1 - start
                columns = [np.full(n, key), np.full(n, way, np.int32), np.full(n, size), np.arange(start, size + 1), node[start:], rest[start:],
                           np.append(letters, np.uint64(0)).astype(np.int64)[start:], np.append(node[1:], 0)[start:], np.append(rest[1:], 0)[start:]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _TAILS.split(", ")])


def _long_pairs(words: DataFrame) -> DataFrame:
    """Rows (word, other) of words of at least LONG letters that are one edit apart."""
    long = words.where(F.length("word") >= LONG).select(F.xxhash64("word").alias("id"), "word")
    path = stored(long.mapInArrow(_tails, _TAILS), "tails")
    mine = path.where(F.col("place") >= F.when(F.col("way") == 0, F.floor(F.col("size") / 2)).otherwise(F.ceil(F.col("size") / 2)))
    edges = path.where("letter <> 0").select(F.col("node").alias("at"), F.col("letter").alias("other_letter"), F.col("child").alias("other_child")).distinct()
    met = mine.join(edges, (F.col("node") == F.col("at")) & (F.col("letter") != F.col("other_letter")))
    def edit(rows, node, rest, letter, skipped):
        return rows.select("id", "way", "place", F.col(node).alias("node"), F.col(rest).alias("rest"), letter.alias("put"), F.lit(skipped).alias("skipped"))

    put = F.chr("other_letter")
    edits = edit(met, "other_child", "rest", put, 0).unionByName(edit(met.where("letter <> 0"), "other_child", "child_rest", put, 1)) \
        .unionByName(edit(mine.where("letter <> 0"), "node", "child_rest", F.lit(""), 1))
    ends = path.select("node", "rest", F.col("id").alias("other_id"))
    pairs = edits.join(ends, ["node", "rest"]).where("id <> other_id").join(long, "id") \
        .join(long.select(F.col("word").alias("other"), F.col("id").alias("other_id")), "other_id")
    # hashes proposed them; the edit itself confirms them
    text = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
    edited = F.concat(F.left(text, F.col("place").cast("int")), "put", text.substr((F.col("place") + F.col("skipped") + 1).cast("int"), F.length("word")))
    return pairs.where(F.col("other") == F.when(F.col("way") == 0, edited).otherwise(F.reverse(edited))).select("word", "other")


# -- neighbours, forms, roots ------------------------------------------------------------------

def neighbours(words: DataFrame) -> DataFrame:
    """Distinct rows (word, other): words of `words` that differ by one
    inserted, deleted or replaced letter, both ways round."""
    found = _walk(words.where(F.length("word") <= LONG).select("word")).where(F.levenshtein("word", "other", 1) == 1)
    if not words.where(F.length("word") >= LONG).isEmpty():
        found = found.unionByName(_long_pairs(words))
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) without cycles: pointers doubled
    until none moves."""
    to = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not to.where("moved").isEmpty():
        beyond = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        to = stored(to.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return to.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
             ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents."""
    words = stored(word_counts(docs, doc_id, text, least_letters, least_count), "words")
    near = neighbours(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    told = words.join(best, "word", "left")
    chosen = -F.col("best.less") >= ratio * F.col("n")
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.other")).alias("form"),
                              F.when(chosen, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(told.where(F.col("form").isNotNull()).select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
