import pytest

LONG = "word another " * 40_000


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows, and columns named like results."""
    rows = [
        (1, "The first text, under the MIT License.", "en", "a"), (1, "The first text, under the MIT License.", "en", "a"),
        (2, None, "en", None), (3, "", None, "a"), (4, " \n\t ", "en", "a"), (None, "A text without an id", "en", "a"),
        (None, None, None, None), (5, "12 34 !!", "fr", "b"), (6, LONG, "en", "b"), (7, "une phrase", None, "b"),
        (8, "x\x00y \x1c z", "en", "b"), (9, "ÀÉ ßü İ 漢字", "de", "b")]
    extra = ("score", "held_out", "lang_pred", "fingerprint", "component_id", "labels", "fp", "words", "key", "stats",
             "start", "bucket", "vector", "changed", "place", "n")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), *["taken"] * len(extra)) for r in rows], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def no_docs(spark, docs_schema):
    return spark.createDataFrame([], docs_schema)
