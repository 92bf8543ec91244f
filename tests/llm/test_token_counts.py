import random

from thresher.llm import token_counts as C

LETTERS = ["the", " quick", "\n\n", "é", "12345", " ", "'ll", "😀", "<|endoftext|>", "ab", " fox", "\t"]


def test_histogram_against_brute_force(documents, monkeypatch):
    monkeypatch.setattr(C, "BAND", 8)
    rng = random.Random(1)
    texts = [None, "", *("".join(rng.choices(LETTERS, k=rng.randrange(300))) for _ in range(200))] * 2
    encoder = C._encoder(C.RANKS)
    lengths = [len(encoder.encode_ordinary(t)) if t else 0 for t in texts]
    counted = C.token_lengths(documents(list(enumerate(texts))))
    assert sorted((r.doc_id, r.n_tokens) for r in counted.select("doc_id", "n_tokens").collect()) == list(enumerate(lengths))
    histogram = C.length_histogram(counted)
    got = {r.n_tokens: r for r in histogram.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r.n_docs == lengths.count(n) and r.docs_ge == sum(x >= n for x in lengths) and r.tokens_ge == sum(x for x in lengths if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths) and abs(r.quantile - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    for r in C.at_limits(histogram, [0, 7, 100, 10**6]).collect():
        assert r.docs_over == sum(x > r.limit for x in lengths) and r.truncated_total == sum(min(x, r.limit) for x in lengths)
        assert r.tokens_cut + r.truncated_total == sum(lengths)


def test_pieces_of_a_long_text_count_the_same(monkeypatch):
    rng = random.Random(2)
    words = ["alpha", "beta", "été", "x1", "don't", "12", "...", "\n", "  "]
    text = " ".join(rng.choices(words, k=4000))
    encoder = C._encoder(C.RANKS)
    whole = len(encoder.encode_ordinary(text))
    monkeypatch.setattr(C, "PIECE", 101)
    assert "".join(C._pieces(text)) == text
    assert sum(len(encoder.encode_ordinary(p)) for p in C._pieces(text)) == whole


def test_empty_table_and_clashing_columns(documents):
    from pyspark.sql import functions as F

    assert C.length_histogram(C.token_lengths(documents([]))).collect() == []
    df = documents([(1, "a b")]).withColumns({"n_tokens": F.lit("x"), "band": F.lit(1)})
    assert C.token_lengths(df).first().n_tokens == 2
