import random
import re

import numpy as np

from thresher.llm import url_filter as U


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "://", "http://A.Example.NET/en/x?y#z", "http://example.net/EN/", "http://example.net", "http://net/", "http://internet/", "https://x.example.com/de/1",
        "https://example.com/de", "http://a.org/fr/?q=://b.net/", "x://y://z.net/", "http://É.net/é?ü", "http://a\nb.net/\nc", "http://x.net?/en/", "http://x.net#/en/", "http://.net/", "u://" + "h" * 50_000 + ".net/" + "p" * 50_000]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")


def made(n, seed=1):
    rng = random.Random(seed)
    return [f"http://{rng.choice(['www', 'm', 'blog'])}.{rng.choice(['aa', 'bb', 'cc'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(99999)}" for _ in range(n)]


def test_rules_and_parts(spark):
    urls = URLS + made(500)
    got = {r.page_id: r for r in U.judge(pages(spark, urls)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = plain(u)
        name, verdict = rule(host, path)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, name), u
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_model_learns_from_a_small_table(spark):
    bad, good = ([f"{w}{i}.site.zz" for i in range(60)] for w in ("casino", "museum"))
    labelled = spark.createDataFrame([(h, "/", v) for hs, v in ((bad, "block"), (good, "allow")) for h in hs], "host string, path string, verdict string")
    got = {r.host: r.verdict for r in U.judge(pages(spark, ["http://casino999.other.zz/", "http://museum777.other.zz/"]), labelled).collect()}
    assert got == {"casino999.other.zz": "block", "museum777.other.zz": "allow"}


def test_empty_and_one_sided_tables(spark):
    assert U.judge(pages(spark, [])).collect() == []
    assert [r.verdict for r in U.judge(pages(spark, ["http://a.zz/", None])).collect()] == ["allow", "allow"]


def test_training_separates():
    hosts = [f"a{i}.net" for i in range(50)] + [f"b{i}.org" for i in range(50)]
    m = U.train(hosts, ["/"] * 100, np.repeat([1.0, 0.0], 50))
    p = m.block_probability(hosts, ["/"] * 100)
    assert (p[:50] > 0.9).all() and (p[50:] < 0.1).all()
