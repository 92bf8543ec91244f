"""SentencePiece encoding and decoding by batched numpy Viterbi.

The vocabulary file's pieces and scores are read as a unigram model: a text's
tokens are the segmentation of highest total score, characters that no piece
covers become byte pieces, and every blank is written as U+2581 after one
dummy blank at the start, as the file says.

* No piece goes past the start of a run of U+2581, so texts fall apart into
  words there, and each distinct word is encoded once (a bounded memory of
  words per worker, kept as id bytes).
* New words of one length form a matrix and advance together: the substring
  hashes of all their positions and lengths probe the sorted piece keys at
  once, then one vectorised maximum per position stores the back-pointers.
* Decoding joins the pieces' bytes.  A U+2581 that a text holds itself is
  written as its three bytes, so decode(encode(text)) is the text.

Each task works by itself on whole texts; nothing is shuffled.  Defined cases:
a null text has null ids and decodes to null; an empty text has none.  Words of
any length work (time grows with the length, memory too).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from thresher.llm.shared import lean, mix64, plus

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MEMORY = 32_000_000  # bytes of words that a worker remembers, about
TOGETHER = 1 << 15  # characters of words advanced at once
LONG = 1 << 15  # a longer word is walked by itself, in pieces of so many characters
_ENTRY = 250  # bytes of a remembered word beside its letters and ids, about
BLANK = "▁"
OWN_BLANK = "\ud800"  # stands for a U+2581 of the text itself: a lone surrogate, which no UTF-8 text can hold
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNKNOWN_PENALTY = 10.0


def read_pieces(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces, scores and types (1 normal, 2 unknown, 3 control, 6 byte) of a
    vocabulary file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [p.piece for p in model.pieces], np.array([p.score for p in model.pieces]), np.array([p.type for p in model.pieces])


class Unigram:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, pieces: list[str], scores: np.ndarray, types: np.ndarray) -> None:
        self.size = len(pieces)
        self.byte_ids = np.zeros(256, np.int32)
        normal = np.flatnonzero(types == 1)
        for i in np.flatnonzero(types == 6):
            self.byte_ids[int(pieces[i][3:5], 16)] = i
        crossing = [pieces[i] for i in normal if re.search(f"[^{BLANK}]{BLANK}", pieces[i])]
        if crossing:
            raise ValueError(f"pieces across words are not supported: {crossing[:3]}")
        self.longest = max(len(pieces[i]) for i in normal)
        keys = np.array([int(self._hash(pieces[i])) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], normal[order].astype(np.int32), scores[normal][order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, bool)  # a look here spares most probes that would find nothing
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.unknown = float(scores[normal].min()) - _UNKNOWN_PENALTY
        self.bytes = [b""] * len(pieces)
        for i, (p, t) in enumerate(zip(pieces, types, strict=True)):
            self.bytes[i] = bytes([int(p[3:5], 16)]) if t == 6 else p.replace(BLANK, " ").encode() if t == 1 else b""
        self.byte_set = set(self.byte_ids.tolist())
        self.lines = any("\n" in pieces[i] for i in normal)
        self.words: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of `words`, about

    @staticmethod
    def _hash(text: str) -> np.uint64:
        code = np.zeros(1, np.uint64)
        for c in text:
            code = code * _STEP + np.uint64(ord(c) + 1)
        return mix64(code)[0]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Encode words: those of one length together."""
        words = sorted(words, key=len)
        lengths = np.array([len(w) for w in words])
        found: dict[str, bytes] = {}
        at = 0
        while at < len(words):
            n = int(lengths[at])
            if n > LONG:
                found[words[at]] = self._viterbi_of_one(words[at])
                at += 1
                continue
            end = min(int(np.searchsorted(lengths, n, "right")), at + max(1, TOGETHER // n))
            found |= zip(words[at:end], self._viterbi(words[at:end], n), strict=True)
            at = end
        return found

    def _viterbi(self, words: list[str], n: int) -> list[bytes]:
        """Ids (as int32 bytes) of words of `n` characters."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        chars = points.astype(np.uint64) + np.uint64(1)
        widest = min(n, self.longest)
        gain = np.full((widest, n, len(words)), -np.inf)  # by length - 1, start, word
        piece = np.full((widest, n, len(words)), -1, np.int32)
        code = np.zeros((len(words), n), np.uint64)
        for k in range(widest):
            code = code[:, : n - k] * _STEP + chars[:, k:]
            probe = mix64(code).T.ravel()
            at = np.flatnonzero(self.maybe[(probe >> np.uint64(44)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.keys, probe[at]), len(self.keys) - 1)
            same = self.keys[slot] == probe[at]
            at, slot = at[same], slot[same]
            gain[k, : n - k].reshape(-1)[at] = self.scores[slot]
            piece[k, : n - k].reshape(-1)[at] = self.ids[slot]
        alone = piece[0] < 0
        gain[0][alone] = self.unknown
        ascii_ = points.T < 128
        piece[0][alone & ascii_] = self.byte_ids[points.T[alone & ascii_]]
        best = np.full((n + 1, len(words)), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, len(words)), np.int16 if n < 32000 else np.int32)
        who = np.arange(len(words))
        for end in range(1, n + 1):
            ks = np.arange(min(widest, end))[::-1]  # the longest first: of equal sums it wins
            sums = best[end - 1 - ks] + gain[ks, end - 1 - ks]
            pick = sums.argmax(0)
            best[end] = sums[pick, who]
            back[end] = ks[pick] + 1
        ends = np.full(len(words), n)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        live = who
        while len(live):
            width = back[ends[live], live].astype(np.int64)
            ends[live] -= width
            steps.append((live, piece[width - 1, ends[live], live]))
            live = live[ends[live] > 0]
        token_word = np.concatenate([s[0] for s in steps])
        token = np.concatenate([s[1] for s in steps])
        place = np.concatenate([np.full(len(s[0]), -i) for i, s in enumerate(steps)])
        order = np.lexsort((place, token_word))
        token, token_word = token[order], token_word[order]
        cut = np.searchsorted(token_word, np.arange(len(words) + 1))
        whole = token.astype("<i4").tobytes()
        out = [whole[a:b] for a, b in pairwise((4 * cut).tolist())]
        for w in np.unique(token_word[token < 0]).tolist():
            out[w] = self._with_bytes(words[w], token[cut[w]:cut[w + 1]]).astype("<i4").tobytes()
        return out

    def _viterbi_of_one(self, word: str) -> bytes:
        """As `_viterbi` for one long word: pieces are looked up for a stretch of
        starts at a time, and each start hands its best sum on to the ends of
        its pieces; 14 bytes a character are kept."""
        n = len(word)
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        best, width, token = array("d", [-np.inf]) * (n + 1), array("h", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for begin in range(0, n, LONG):
            starts = min(LONG, n - begin)
            here = points[begin:begin + starts + self.longest]
            chars = here.astype(np.uint64) + np.uint64(1)
            code, found = np.zeros(starts, np.uint64), []
            for k in range(min(self.longest, len(here))):
                count = min(starts, len(here) - k)
                code = code[:count] * _STEP + chars[k:k + count]
                probe = mix64(code)
                at = np.flatnonzero(self.maybe[(probe >> np.uint64(44)).astype(np.int64)])
                slot = np.minimum(np.searchsorted(self.keys, probe[at]), len(self.keys) - 1)
                same = self.keys[slot] == probe[at]
                at, slot = at[same], slot[same]
                found.append((at, np.full(len(at), k + 1), self.ids[slot], self.scores[slot]))
                if k == 0:  # characters that are no piece stand alone
                    alone = np.ones(count, bool)
                    alone[at] = False
                    at = np.flatnonzero(alone)
                    ids = np.full(len(at), -1, np.int32)
                    low = here[at] < 128
                    ids[low] = self.byte_ids[here[at][low]]
                    found.append((at, np.ones(len(at), np.int64), ids, np.full(len(at), self.unknown)))
            at, size, ids, gain = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(at, kind="stable")
            for start, k, i, g in zip((at[order] + begin).tolist(), size[order].tolist(), ids[order].tolist(), gain[order].tolist()):
                total, end = best[start] + g, start + k
                if total > best[end]:  # of equal sums the first, with the longest piece, stays
                    best[end], width[end], token[end] = total, k, i
        out, end = [], n
        while end:
            out.append(token[end])
            end -= width[end]
        ids = np.array(out[::-1], np.int32)
        return (self._with_bytes(word, ids) if (ids < 0).any() else ids).astype("<i4").tobytes()

    def _with_bytes(self, word: str, ids: np.ndarray) -> np.ndarray:
        """The ids with each uncovered character (-1) as its bytes."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append([i])
                at += 1 if i in self.byte_set else len(self.bytes[i].decode())
            else:
                char = BLANK if word[at] == OWN_BLANK else word[at]
                out.append(self.byte_ids[list(char.encode("utf-8", "surrogatepass"))])
                at += 1
        return np.concatenate(out)

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text, as int32 bytes."""
        split = [None if t is None else self._split(t) for t in texts]
        wanted = set().union(*(words for words in split if words))
        missing = wanted.difference(self.words)
        known = {w: self.old[w] for w in missing if w in self.old}
        self.words |= known
        self.words |= self._learn(list(missing.difference(known)))
        get = self.words.__getitem__
        out = [None if words is None else b"".join(map(get, words)) for words in split]
        self.held += sum(len(w) + len(self.words[w]) + _ENTRY for w in missing)
        if self.held > MEMORY // 2:  # words not met again by the next time are forgotten
            self.old, self.words, self.held = self.words if self.held < MEMORY else {}, {"": b""}, 0
        return out

    def _split(self, text: str) -> list[str]:
        """Words, each with the blanks before it; line ends, which no piece
        holds, stand alone."""
        if not text:
            return []
        if BLANK in text:
            text = text.replace(BLANK, OWN_BLANK)
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+$", (" " + text).replace(" ", BLANK))
            return words if self.lines else [p for w in words for p in re.split("(\n)", w)]
        marked = BLANK + text.replace(" ", " " + BLANK)
        return (marked if self.lines else marked.replace("\n", " \n ")).split(" ")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the dummy blank at the start goes."""
        whole = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


_MODELS: dict[str, Unigram] = {}


def load(path: str) -> Unigram:
    """The model of a file, once per worker."""
    if path not in _MODELS:
        _MODELS[path] = Unigram(*read_pieces(path))
    return _MODELS[path]


def _portions(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def encode(docs: DataFrame, path: str = MODEL, column: str = "text") -> DataFrame:
    """`docs` without `column`, with token_ids (array of int), n_tokens and
    round_trip: whether the ids decode to the very text.  The vocabulary file
    must be at `path` on every executor."""
    kept = [c for c in docs.columns if c not in (column, "token_ids", "n_tokens", "round_trip")]
    texts_of = docs.select(*kept, docs[column].cast("string").alias("_text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            at = 0
            for texts in _portions(batch.column("_text").cast(pa.string()).to_pylist()):
                coded = model.encode(texts)
                ids = [None if c is None else np.frombuffer(c, "<i4") for c in coded]
                counts = np.array([0 if c is None else len(c) for c in ids])
                flat = np.concatenate([c for c in ids if c is not None] or [np.empty(0, np.int32)])
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32), mask=np.append([c is None for c in ids], False))
                same = [None if c is None else model.decode(c) == t for c, t in zip(ids, texts, strict=True)]
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), pa.ListArray.from_arrays(offsets, pa.array(flat)),
                     pa.array([None if c is None else len(c) for c in ids], pa.int64()), pa.array(same, pa.bool_())],
                    [*kept, "token_ids", "n_tokens", "round_trip"])

    schema = plus(texts_of.drop("_text").schema, token_ids=T.ArrayType(T.IntegerType()), n_tokens=T.LongType(), round_trip=T.BooleanType())
    return texts_of.select(*kept, "_text").mapInArrow(run, schema)


def decode(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """`coded` with the text of its token_ids, as column text."""
    kept = [c for c in coded.columns if c != "text"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(np.array(ids, np.int64)) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(texts, pa.string())], [*kept, "text"])

    return coded.select(*kept).mapInArrow(run, plus(coded.select(*kept).schema, text=T.StringType()))
