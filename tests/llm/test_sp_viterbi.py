import random

import numpy as np
import pytest

from thresher.llm import sp_viterbi as V

ODD = [None, "", " ", "  ", " a", "a ", "a  b", "\n", "a \n b\n\nc", "héé\n\nx", "日本語テキスト", "😀😀x", "▁a▁ b", "a" * 5000, " " * 40 + "x", "a\tb\r\n", "\x00x", "e\u0301 ﷺ", "\u2028\u00a0x", "ab\ufffd"]


def best_score(model, word):
    """Plain dynamic programme over one word: the best total score."""
    table = {k: s for k, s in zip(model.keys.tolist(), model.scores.tolist(), strict=True)}
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - model.longest), end):
            s = table.get(int(model._hash(word[start:end])), model.unknown if end - start == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def score_of(model, word, ids):
    by_id = dict(zip(model.ids.tolist(), model.scores.tolist(), strict=True))
    covered = {c for c in word if int(model._hash(c)) not in set(model.keys.tolist())}
    return sum(by_id[i] for i in ids if i in by_id) + model.unknown * sum(c in covered for c in word)


def test_best_segmentation_of_each_word():
    model = V.load(V.MODEL)
    rng = random.Random(1)
    words = [V.BLANK + "".join(rng.choices("etaoinshrdlé$1", k=rng.randrange(1, 14))) for _ in range(400)] + [V.BLANK, "the", V.BLANK * 3 + "a"]
    for w, ids in model._learn(words).items():
        assert score_of(model, w, np.frombuffer(ids, "<i4").tolist()) == pytest.approx(best_score(model, w), rel=1e-9), w


def test_round_trip_and_columns(spark, documents):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("ab é\n▁😀 ", k=rng.randrange(60))) for _ in range(200)]
    df = documents(list(enumerate(texts))).withColumns({"token_ids": F.lit("x"), "n_tokens": F.lit("y"), "_text": F.lit("z")}).drop("_text")
    coded = V.encode(df)
    rows = coded.collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert r.round_trip is (None if t is None else True), t
        assert (r.token_ids is None) == (t is None) and r.n_tokens == (None if t is None else len(r.token_ids))
    assert {r.doc_id: r.text for r in V.decode(coded).select("doc_id", "text").collect()} == dict(enumerate(texts))
    assert V.encode(documents([])).collect() == []


def test_every_code_point_is_itself(spark, documents):
    """U+2581 of a text, noncharacters and the ends of the planes: ids of their own, and back."""
    texts = ["\ufdd0", "▁", "a\ufdd0▁b", "\ufdd0 \ufdd0\n▁ ▁", "\ufdef\ufffe\uffff", "\ud7ff\ue000\U0010ffff\U0010fffe"]
    coded = V.encode(documents(list(enumerate(texts))))
    rows = {r.doc_id: r for r in coded.collect()}
    assert [rows[i].round_trip for i in range(len(texts))] == [True] * len(texts)
    assert rows[0].token_ids != rows[1].token_ids
    assert {r.doc_id: r.text for r in V.decode(coded).select("doc_id", "text").collect()} == dict(enumerate(texts))


def test_memory_turns_over(monkeypatch):
    monkeypatch.setattr(V, "MEMORY", 20)
    model = V.Unigram(*V.read_pieces(V.MODEL))
    texts = [f"word{i} the the word{i % 7}" for i in range(100)]
    fresh = V.load(V.MODEL)
    assert [model.encode([t]) for t in texts] == [fresh.encode([t]) for t in texts]


def test_words_of_a_text_are_independent():
    """Splitting at blanks and line ends loses nothing: the same ids as for the whole text as one word."""
    model = V.load(V.MODEL)
    text = "the quick brown  fox\njumps over"
    whole = model._learn([(" " + text).replace(" ", V.BLANK)])
    assert b"".join(whole.values()) == model.encode([text])[0]


def test_a_long_word_is_coded_as_a_short_one_would_be(monkeypatch):
    rng = random.Random(12)
    model = V.Unigram(*V.read_pieces(V.MODEL))
    words = [V.BLANK + "".join(rng.choice("etaoin shrdlu日é\u0001😀ßxqz".replace(" ", "")) for _ in range(n)) for n in (5, 40, 300, 2000)]
    want = [model._viterbi([w], len(w))[0] for w in words]
    for stretch in (7, 64, 1 << 15):
        monkeypatch.setattr(V, "LONG", stretch)
        assert [model._viterbi_of_one(w) for w in words] == want


def test_a_very_long_word_keeps_its_memory(monkeypatch):
    """A word of 200,000 letters: coded in a stretch at a time, and back."""
    import tracemalloc

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    model = V.load(V.MODEL)
    tracemalloc.start()
    ids = np.frombuffer(model.encode([text])[0], "<i4")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.decode(ids) == text and peak < 60_000_000
