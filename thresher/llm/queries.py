"""One query per operator, over its whole table, with production parameters;
where SQL can say the same, the DuckDB SQL for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thresher.llm.shared import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) >= 1 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
sides AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT u AS node, v AS other FROM sides UNION SELECT reach.node, sides.v FROM reach JOIN sides ON reach.other = sides.u),
least AS (SELECT node, min(other) AS smallest FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(smallest, doc_id))::BIGINT AS component_id
FROM sets LEFT JOIN least ON node = doc_id
"""


@query("op9_jaccard_join", JACCARD_SQL)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thresher.llm.jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op1_ann_posting_lists")
def op1_ann_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thresher.llm.ann_posting import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query("op2_source_mix")
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thresher.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thresher.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op4_slot_sharding")
def op4_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from uuid import uuid4

    from pyspark.sql import functions as F

    from thresher.llm.shared import shared_dir
    from thresher.llm.sharding import shard

    dealt = shard(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/slot-map-{uuid4().hex}")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op5_token_lengths")
def op5_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thresher.llm.token_counts import length_histogram, token_lengths

    return length_histogram(token_lengths(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thresher.llm.sp_viterbi import encode

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thresher.llm.pii_boost import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


@query("op8_url_filter")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thresher.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


TOPK_SQL = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM kept q JOIN kept c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op10_exact_topk", TOPK_SQL)
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thresher.llm.topk_bond import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"))

TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH docs AS (SELECT doc_id, {TOKENS} AS w FROM documents),
items AS (SELECT item_id, {TOKENS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS win
  FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win
  FROM docs, sizes WHERE len(w) >= size),
found AS (SELECT DISTINCT p.doc_id, p.pos, p.size, b.item_id FROM places p JOIN windows b ON p.size = b.size AND p.win = b.win),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM (SELECT DISTINCT doc_id, pos, size FROM found)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits ON docs.doc_id = hits.doc_id LEFT JOIN listed ON docs.doc_id = listed.doc_id
"""


@query("op11_decontamination", DECONTAMINATION_SQL)
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from thresher.llm.decontaminate import contaminated_spans

    found = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SEARCH_SQL = f"""
WITH docs AS (SELECT doc_id, {TOKENS} AS w FROM documents),
sized AS (SELECT doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, big_n),
scored AS (
  SELECT a.item_id, c.doc_id, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 90 + (90 * s.n * big_n) // big_l))))::BIGINT AS score
  FROM asked a JOIN weights w ON a.term = w.term JOIN counts c ON a.term = c.term JOIN sized s ON s.doc_id = c.doc_id, whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_bag_search", SEARCH_SQL)
def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thresher.llm.bag_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The checksum's table follows from its polynomial; runs go through it byte by byte.
SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, b)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode(key))), lambda i: ('0x' || substr(hex(encode(key)), 2 * i + 1, 2))::BIGINT),
    lambda r, b: xor(r // 256, t[xor(r, b) % 256 + 1]), 4294967295)) AS h
  FROM (SELECT run, n, concat(doc_id, ':', run) AS key FROM runs), crc),
results AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, unnest(range(1, length(word) + 1)) AS i, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS cut FROM words),
apart AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.cut = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.cut = w.word),
near AS (SELECT a.word, a.other, b.n AS other_n FROM apart a JOIN words b ON a.other = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
told AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
follow AS (SELECT word, word AS last FROM told UNION SELECT f.word, t.form FROM follow f JOIN told t ON f.last = t.word WHERE t.form IS NOT NULL)
SELECT told.word, told.form, f.last AS root, told.n, told.n_near, told.form_n
FROM told JOIN follow f ON told.word = f.word JOIN told l ON f.last = l.word WHERE l.form IS NULL
"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thresher.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
