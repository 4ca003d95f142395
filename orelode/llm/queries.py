"""The numbered operators on the shared tables, whole and with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm import (
    decontaminate, language, licenses, neighbours, packing, pii, quality, ranked, simhash, tokens, urlfilter, variants, warc)
from orelode.llm.shared import prepare, remainder, settle

#: Key of the pseudonyms here; a real run takes it from a secret store.
PII_KEY = "a key of the corpus"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.drop("bucket")


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_warc", """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages),
    f AS (
        SELECT payload_digest AS digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM p LEFT JOIN f ON payload_digest = digest AND payload_bytes >= 100""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = language.fit(docs.where(~held_out).select("text", "lang"))
    found = docs.select("doc_id", held_out.alias("held_out"), language.identify(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 5)
    rows = settle(docs.select("doc_id", fold.alias("fold"), quality.statistics_of(F.col("text")).alias("stats")), "stats")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    labelled = rows.where("fold <> 0").join(labels, "doc_id").select(
        "stats", "label", (F.col("fold") == 1).alias("calibrate"))
    scored = rows.withColumn("score", quality.score(F.col("stats"), quality.fit(labelled)))
    return scored.select(
        "doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


@query("op8_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_token_output")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.matrices(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.segments(settle(rows, "tokens"))


@query("op11_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


# The rules (host, path, block) that pages are judged by.
URL_RULES = [
    ("com", "/", False), ("example.com", "/en/", True), ("www.example.com", "/en/", False),
    ("net", "/es/", True), ("net", "/fr/", True),
]


@query("op12_url_filter", """
    WITH rules(r_host, r_path, kind) AS (
        VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
               ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    u AS (
        SELECT row_number() OVER () AS row, page_id,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
        FROM pages),
    fit AS (
        SELECT row, r_host || r_path AS rule, kind FROM u JOIN rules
            ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
        QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) = 1)
    SELECT page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM u LEFT JOIN fit USING (row)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, block boolean")
    return urlfilter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@query("op13_ranked_search", r"""
    WITH d AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (
        SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
    q AS (SELECT item, item_id, unnest(w) AS term FROM b),
    tf AS (
        SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d)
        WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    weighted AS (
        SELECT q.item, q.item_id, term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
        FROM q JOIN df USING (term), s),
    impact AS (
        SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)) AS i
        FROM tf, s),
    scored AS (
        SELECT item, item_id, row, doc_id, sum(w * i)::BIGINT AS score FROM weighted JOIN impact USING (term)
        GROUP BY ALL HAVING score > 0)
    SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row)::INTEGER AS rank, doc_id, score
    FROM scored QUALIFY rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
