import random
import re
import zlib
from collections import Counter

import numpy as np

from thresher.llm import spelling as S


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words_of(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(n):
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def run(spark, docs):
    d = spark.createDataFrame([(*r, "x", 2) for r in docs], "doc_id long, text string, word string, n int")
    return sorted(tuple(r) for r in S.variants(d).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abé×xy") for _ in range(rng.choice([4, 5, 6, 7, 9, 14, 31, 32, 33, 40]))) for _ in range(25)] + ["aaaaa", "aaaaaa", "ababab"]

    def edited(w):
        i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        return w[:i] + (rng.choice("abéxy") if kind < 2 else "") + w[i + (kind > 0):]

    pool = base + [edited(w) for w in base * 6]
    pool += [edited(w) for w in pool[28:100]]
    docs = [(i, rng.choice([" ", "\n", "1", "ß-"]).join(rng.choice(["{}", "{}", "{}"]).format(rng.choice([w, w.upper() if w.isascii() else w])) for w in rng.choices(pool, [1 + 8 * (k % 7 == 0) for k in range(len(pool))], k=60))) for i in range(60)]
    docs += [(None, None), (7, None), (8, ""), (9, "123 ..."), (1, docs[1][1]), (1, docs[2][1]), (None, docs[3][1])]
    want = brute(words_of(docs))
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want) and any(len(r[0]) > 32 and r[4] for r in want)
    assert run(spark, docs) == want


def test_very_long_words(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abcd") for _ in range(60_000))
    b, c, d = a[:100] + "z" + a[101:], a[:59_000] + a[59_001:], a + "q"
    docs = [(i, " ".join([a] * 2 + [b, c, d, a[:-2]])) for i in range(4)]
    n = words_of(docs)
    got = {r[0]: r for r in run(spark, docs)}
    assert set(got) == set(n)
    assert got[a][4] == 3 and all(got[w][1] == a and got[w][4] == 1 for w in (b, c, d)) and got[a[:-2]][4] == 0


def test_many_words_share_a_stem(spark):
    stem = "qwertz"
    words = [stem + "".join(chr(97 + (i // 26 ** k) % 26) for k in range(3)) for i in range(1500)]
    docs = [(i, " ".join(words)) for i in range(4)]
    assert run(spark, docs) == brute(words_of(docs))


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "one two")]) == []


def test_checksums_go_on():
    rng = random.Random(3)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 2, 63, 64, 65, 66, 500, 7)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(texts))], np.uint32)
    got = S.checksums(data, np.cumsum(sizes) - sizes, sizes, before)
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + t) for i, t in enumerate(texts)]
