"""The queries opN_* over the corpus tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslice, html, language, mixing, packing, pii, simhash, toxicity, urls, vectors
from .common import read

TOKENIZER = "word_bpe_49k.json"
#: The key of the query's pseudonyms; a real run passes its own.
PII_KEY = "tessera-example-key"
URL_RULES: list[urls.Rule] = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
MIX_SEED, MIX_EXPONENT = 7, 0.5


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _remainder(divisor: int, id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path)
    return pieces.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), exponent=MIX_EXPONENT, seed=MIX_SEED).select("doc_id", "source", "copy", "shuffle_key", "text")


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", html.main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)
    return found.select("doc_id", "text", "private", F.size("private").cast("long").alias("n_private"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs.where(_remainder(4) != 2))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(_remainder(5) != 0))
    scored = docs.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), toxicity.toxicity(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {f.__name__: f for f in (op1_pack, op2_mix, op3_extract, op4_neighbours, op5_pseudonyms, op6_simhash, op7_urls, op8_language, op9_topk, op10_toxicity)}

ORACLES = {
    "op2_mix": f"""
        WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, '')) + 1) AS DOUBLE) AS size FROM documents GROUP BY source),
        rates AS (SELECT source, pow(size, {MIX_EXPONENT}) / sum(pow(size, {MIX_EXPONENT})) OVER () * sum(size) OVER () / size AS rate FROM sizes),
        steps AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM rates, range(0, 400) t(k)),
        drawn AS (SELECT doc_id, source, text, CAST('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
        counted AS (SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.cdf <= d.u) AS n FROM drawn d)
        SELECT doc_id, source, CAST(c.copy AS INTEGER) AS copy, CAST('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || c.copy), 1, 15) AS BIGINT) AS shuffle_key, text
        FROM counted, LATERAL (SELECT unnest(range(0, n)) AS copy) c""",
    "op7_urls": """
        WITH parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        rules(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        fits AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, verdict) AS n
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts q LEFT JOIN fits f ON f.page_id = q.page_id AND n = 1""",
    "op9_topk": """
        WITH ints AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
