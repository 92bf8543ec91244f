import random
import re

from thresher.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in got if x is not None}
        out.append((doc, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, window string, spans int")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, item string")
    rows = D.contaminated_spans(d, i, **kw).collect()
    return sorted(((r.doc_id, r.n_words, tuple(w for s in r.spans for w in range(s.start, s.end)), tuple(r["items"])) for r in rows), key=repr)


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é1", "日本", "ÀB"]

    def text(k):
        return rng.choice(["", "  ", "!"]) + "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(k))

    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(25)]
    items += [(3, items[4][1]), (None, items[5][1]), (90, None), (91, "?!"), (92, items[6][1]), (93, items[6][1].upper())]
    docs = []
    for i in range(n):
        parts = [text(rng.randrange(0, 40))]
        if rng.random() < 0.6:
            item = words(rng.choice(items)[1])
            cut = rng.randrange(len(item) + 1) if item else 0
            parts += [" ".join(item[cut // 2:]), text(rng.randrange(10))]
        docs.append((i, " ".join(parts)))
    docs += [(None, None), (500, None), (501, ""), (502, "\u0000 !"), (1, docs[1][1]), (1, docs[2][1]), (None, docs[3][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert sum(bool(r[2]) for r in want) > 20
    assert run(spark, docs, items) == want


def test_blocks_agree(spark):
    docs, items = corpus(seed=6, n=40)
    assert run(spark, docs, items, per_block=60) == brute(docs, items)


def test_very_long_text_and_common_passage(spark):
    rng = random.Random(1)
    item = " ".join(f"q{i}" for i in range(14))
    long = " ".join(f"u{rng.randrange(500)}" for _ in range(600_000)) + " " + item
    docs = [(0, long), (1, "z" * 3_000_000)] + [(i, f"a{i} {item} b") for i in range(2, 400)] + [(900, "same")] * 300
    got = run(spark, docs, [(7, item), (8, "same")])
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert by[0][0][1] == 600_014 and by[0][0][2] == tuple(range(600_000, 600_014)) and by[0][0][3] == ("7",)
    assert by[1][0][1:] == (1, (), ())
    assert all(by[i][0][2] == tuple(range(1, 15)) for i in range(2, 400))
    assert len(by[900]) == 300 and all(r[2:] == ((0,), ("8",)) for r in by[900])


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, (), ())]


def test_prefix_is_the_rarest_shingle():
    w = D.Windows(["a b c d e f g h i j", "x y"], ["1", "2"])
    tables = w.vocabulary()
    counts = {width: D.np.full(len(t.keys), 9) for width, t in tables.items()}
    keys = D.np.unique(w.shingles[5][0])
    counts[5][D.np.searchsorted(keys, w.shingles[5][0][3])] = 1
    w.choose(counts)
    assert w.prefix[5][2].tolist() == [0] and w.prefix[5][3].tolist() == [3] and w.prefix[2][2].tolist() == [1]
