"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm import decontaminate, language, nearcopies, packing, pii, queries
from orelode.llm.shared import prepare, remainder, settle

#: A text of which less is in the language it is most like is rejected; mixed and noisy texts are well above.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay, with the language found.

    Learned as in the query. Rejected are texts without a letter and those that are in none
    of the languages. Repeated rows and null ids are judged like others.
    """
    prepare(spark)
    model = language.fit(docs.where(remainder(F.col("doc_id"), 3) != 1).select("text", "lang"))
    found = docs.withColumn("__found", language.identify(F.col("text"), model))
    kept = found.where((F.col("__found.lang_pred") != language.UNKNOWN) & (F.col("__found.score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("__found.lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id.

    Near copies have sets of five-word shingles with a Jaccard similarity of 0.8 or more. Candidates are texts whose SimHash
    fingerprints differ in at most 2 bits, by the anchors of ``op3_simhash``. Most near copies differ in
    some 10 of 64 bits, beyond any covering code of use, so texts that share a min-hash
    bucket are candidates as well, and every link is checked on the shingles (``orelode.llm.nearcopies``).
    Texts without words are one class. Of repeated rows one stays, of rows that tie that with the smallest hash of text, and a
    null id comes after all others.
    """
    prepare(spark)
    return nearcopies.first_of_each(docs, width=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item stay.

    Null and empty texts contain none. Rows are judged one by one, so repeated rows and null ids share their
    text's fate; without items all documents stay.
    """
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with pseudonyms for personal data; ``n_chars`` follows the text.

    A null text stays null, with a null ``n_chars``; repeated rows and null ids stay as they are.
    """
    changed = docs.withColumn("text", pii.pseudonymised(F.col("text"), queries.PII_KEY))
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts as token sequences of power-of-two lengths.

    A null text is an empty one, which is the end token alone. Each row is packed by itself, so repeated rows and null
    ids give pieces of their own.
    """
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", pseudonyms),
    ("packing", pack_tokens),
]

#: SQL cannot express the stages: models that are fitted, a hash it lacks, look-around patterns, a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
