import random
import zlib

import numpy as np
import pytest

from thresher.llm import langid as L

SYLLABLES = {"aa": ["ta", "ti", "ko", "mu", "ren"], "bb": ["schi", "lich", "ung", "ver", "ein"], "cc": ["ción", "ado", "los", "que", "rr"]}


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        out.append((i, text, lang, "s"))
    return out


def test_held_out_accuracy_and_contract(documents):
    data = rows(900) + [(5000, None, "aa"), (5001, "12 34 !!", "aa"), (5002, "", "bb"), (5003, "x" * 300_000, None), (None, "lich ung ein", None)]
    got = {r.doc_id: r for r in L.identify(documents(data)).collect()}
    assert len(got) == len(data)
    right = [got[r[0]].lang_pred == r[2] for r in data[:900] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean(right) > 0.97
    for d, r in got.items():
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert got[5000].lang_pred == got[5001].lang_pred == got[5002].lang_pred == "und" and got[5000].score == 0
    assert got[5003].lang_pred in SYLLABLES


def test_reruns_agree_and_labels_of_held_out_rows_do_not_matter(documents):
    data = rows(300)
    other = [(i, t, ("aa" if zlib.crc32(str(i).encode()) % 3 == 1 else lang), s) for i, t, lang, s in data]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in L.identify(documents(d)).collect()) for d in (data, other))
    assert a == b


def test_a_repeated_row_leaves_room_for_every_language(documents, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 60)
    data = rows(300, seed=4)
    learned = [r for r in data if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    few = [r for r in learned if r[2] == "aa"][:6]
    data = [r for r in data if r[2] != "aa"] + few + few[:1] * 200
    got = L.identify(documents(data)).collect()
    assert len(got) == len(data) and {r.lang_pred for r in got} == {"aa", "bb", "cc"}
    lang = {r[0]: r[2] for r in data}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.9


def test_more_languages_than_the_sample_has_rows(documents, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 2)
    with pytest.raises(ValueError, match="languages"):
        L.identify(documents(rows(30)))


def test_nothing_to_learn_from(documents):
    assert L.identify(documents([])).collect() == []
    assert {(r.lang_pred, r.score) for r in L.identify(documents([(1, "ab"), (3, "cd")])).collect()} == {("und", 0.0)}
    one = [(i, t, "aa", s) for i, t, _, s in rows(30)]
    assert {r.lang_pred for r in L.identify(documents(one)).collect()} == {"aa"}


def test_keeping_rows(documents):
    from pyspark.sql import functions as F

    data = rows(300) + [(5001, "12 34", "aa"), (5002, None, "aa")]
    df = documents(data).withColumns({"lang_pred": F.lit("mine"), "score": F.lit("x"), "pick": F.lit(1)})
    kept = L.keep_identified(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert {r.doc_id for r in got} >= set(range(300)) - {r[0] for r in data if len(r[1] or "") < 12} and not {5001, 5002} & {r.doc_id for r in got}
    assert {r.lang_pred for r in got} == {"mine"}


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 1, 1], 4000)
    y = np.array([rng.choice(3, p=r) for r in p])
    assert abs(L.fit_temperature(np.log(p) * 4, y) - 4) < 0.4


def test_elastic_net_leaves_zeros():
    rng = np.random.default_rng(0)
    x = np.zeros((200, L.DIM), np.float32)
    y = rng.integers(0, 2, 200)
    x[np.arange(200), y] = 1
    x[:, 5] = 0.01 * rng.normal(size=200)
    w, b = L.train_ftrl(lambda r: x[r], y, 2, l1=0.01)
    assert (np.argmax(x @ w + b, 1) == y).all() and np.count_nonzero(w) <= 6
