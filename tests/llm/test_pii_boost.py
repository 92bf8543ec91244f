import hashlib
import random
import re

import pytest

from thresher.llm import pii_boost as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, rx in PLAIN.items():
        for m in re.finditer(rx, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d or "0"), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "no data here", "mail a.b+c@x.example.com, or d@e.f.g_h@i.jk!", "@a.b a@b a@b. a@.b a@@b.c x@y-.z", "a@b.com_x@c.org@d.net",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5 0001.002.3.255 9999999999999999999999.1.1.1 1.2.3 é1.1.1.1é", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 4701438808373738",
    "4111  1111 1111 1111", "call +1 (555) 555-0199 now +1 234 +49.30.1234567 ( +12345678901234567 +1) 2", "+1 555 555 0100+1 555 555 0101", "💳 4111111111111111 💳 a@b.co 💳",
    "tel 555-123-4567 (555) 123-4567 joe (at) example (dot) com 10[.]0[.]0[.]1 4111/1111/1111/1111", "1 " * 50, "a" * 50_000 + "@", "1." * 20_000, "+1" + " " * 20_000,
    ("x@y.example.com 10.0.0.1 " * 700), "4" * 40, "\n+1 555 555 0100\n", "a@b.c" + ".d" * 5000,
]


def test_base_spans(spark, documents):
    rng = random.Random(2)
    alphabet = ["a", "1", "@", ".", "-", " ", "+", "_", "(", ")", "é", "\n", "25", "4111", "%"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    got = {r.doc_id: r for r in P.find_pii(documents(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want, r = base(t), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, t[:100], want[:5], r.spans[:100])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in P.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        order = [(P.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)


def test_plans_hold_no_python(spark, documents):
    df = P.find_pii(documents([(1, "a@b.com")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def planted(rng, n=1500):
    """Texts in which words announce what follows, with plain spans only."""
    def digits(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = digits(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    kinds = [lambda: f"tel +1 {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"visa {card()}", lambda: f"isbn {digits(13)[:12]}x", lambda: f"order no. {digits(10)}",
             lambda: f"host 10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(1, 256)}", lambda: f"version {digits(2)} of", lambda: f"mail {digits(2)}a@b{digits(2)}.com"]
    return [(i, "some words " + rng.choice(kinds)() + " and more words " + rng.choice(kinds)() + " here") for i in range(n)]


WIDE_CASES = [  # text, what the surroundings let in
    ("words tel 555-123-4567 words", "phone:10:22"), ("words order no. 555-123-4567 words", ""), ("words 555-123-4567 words", ""),
    ("words visa 4111/1111/1111/1111 words", "card:11:30"), ("words isbn 4111/1111/1111/1111 words", ""), ("words visa 4111/1111/1111/1112 words", ""),
    ("words host 10[.]0[.]0[.]1 words", "ip:11:25"), ("words version 10[.]0[.]0[.]1 words", ""), ("words host 300[.]0[.]0[.]1 words", ""),
    ("words mail joe (at) example (dot) com", "email:11:37"), ("words mail 555-123-4567 (at) example (dot) com", "email:11:46"), ("nothing at all", ""),
]


def test_surroundings_select_wide_spans(spark, documents):
    rows = planted(random.Random(4)) + [(5000 + i, t) for i, (t, _) in enumerate(WIDE_CASES)]
    got = {r.doc_id: r.spans for r in P.find_pii(documents(rows)).collect()}
    assert {t: got[5000 + i] for i, (t, _) in enumerate(WIDE_CASES)} == dict(WIDE_CASES)


def test_labels_are_no_function_of_the_features(spark, documents):
    """The same surroundings before a valid and a failing match: the model
    is as sure as their share, and a share below the precision adds nothing."""
    rows = [(i, f"visa 411111111111111{1 if i % 2 else 2} end") for i in range(400)] + [(900, "visa 4111/1111/1111/1111 end")]
    assert {r.doc_id: r.spans for r in P.find_pii(documents(rows)).collect()}[900] == ""


def test_redaction(spark, documents):
    rows = [(1, "write a@b.com or +1 (555) 555-0199."), (2, None), (3, "clean"), (4, ""), (5, "é a@b.com 10.0.0.1"), (6, "1.1.1.1")]
    out = {r.doc_id: r for r in P.redact(documents(rows)).collect()}
    assert out[1].text == "write [EMAIL] or [PHONE]." and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[3].text, out[4].text, out[5].text, out[6].text) == (None, "clean", "", "é [EMAIL] [IP]", "[IP]")
    assert P.redact(documents(rows)).columns == documents(rows).columns


def test_empty_table_and_clashing_columns(spark, documents):
    from pyspark.sql import functions as F

    assert P.find_pii(documents([])).collect() == []
    df = documents([(1, "a@b.com")]).withColumns({"kind": F.lit(1), "pii_spans": F.lit("x"), "base_spans": F.lit("y"), "_found": F.lit("z")})
    assert P.find_pii(df).first().n_email == 1
    out = P.redact(df)
    assert out.columns == df.columns and out.first().pii_spans == "x" and out.first().text == "[EMAIL]"


@pytest.mark.parametrize("rounds", [10, 30])
def test_boosted_trees_fit_counts(rounds):
    import numpy as np

    x = np.array([[a, b] for a in range(4) for b in range(5)])
    n = np.full(len(x), 100.0)
    yes = n * ((x[:, 0] >= 2) & (x[:, 1] != 3))
    trees, bias = P.boost(x, n, yes, rounds=rounds)
    p = 1 / (1 + np.exp(-(bias + sum(P._walk(t, x) for t in trees))))
    assert ((p > 0.5) == (yes > 50)).all()
