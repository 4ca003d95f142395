import numpy as np
from pyspark.sql import functions as F

from orelode.llm import language, queries


def plain_grams(text):
    low = "".join(chr(c) for c in language.letters()[[ord(x) for x in text]]) if text else ""
    line = f" {low} "
    return [line[i - 1:i + 2] for i in range(1, len(line) - 1) if line[i] != " "]


def packed(gram):
    return sum(ord(c) << s for c, s in zip(gram, (42, 21, 0), strict=True))


def test_grams(monkeypatch):
    for text in ("", "a", "It's 5 Über-Dinge!", "  x  y ", "漢字 kana", "ab" * 50):
        for piece in (1 << 19, 7, 3):
            monkeypatch.setattr(language, "PIECE", piece)
            got = np.concatenate([*language.grams(text), np.zeros(0, np.uint64)]).tolist()
            assert got == [packed(g) for g in plain_grams(text)], (text, piece)


def test_filters_keep_all_typical_grams_and_decide(spark):
    texts = {"aa": "anna hatte bananen", "bb": "quick fox jumps", "cc": "ñandú veloz corre"}
    rows = spark.createDataFrame([(t, k) for k, t in texts.items() for _ in range(3)] + [(None, "aa"), ("lost", None)],
                                 "text string, lang string")
    model = language.fit(rows)
    assert model.languages == ["aa", "bb", "cc"]
    for k, text in enumerate(texts.values()):
        n, found = model.counts(text)
        assert found[k] == n == len(plain_grams(text))
        assert model.decide(text)[0] == model.languages[k]
        assert model.decide(text)[1] > 0.99
    assert model.decide("12 !") == model.decide(None) == ("und", 0.0)
    assert model.decide("漢字")[0] in model.languages


def test_many_languages(spark):
    """More than one word of bit masks."""
    names = [f"l{i:02d}" for i in range(40)]
    text = {n: " ".join(chr(0x4E00 + 40 * j + i) * 3 for j in range(5)) for i, n in enumerate(names)}
    model = language.fit(spark.createDataFrame([(t, n) for n, t in text.items()], "text string, lang string"))
    assert model.masks.shape[1] == 2
    assert all(model.decide(t)[0] == n for n, t in text.items())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.QUERIES["op6_language_id"](spark, sf).join(docs, "doc_id").where("held_out")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_awkward_rows(spark, awkward, no_docs):
    model = language.fit(awkward)
    rows = awkward.select("doc_id", language.identify(F.col("text"), model).alias("f")).collect()
    assert len(rows) == awkward.count()
    assert all((r.f.lang_pred == "und") == (r.doc_id in (2, 3, 4, 5)) for r in rows if r.doc_id is not None)
    assert all(0 <= r.f.score <= 1 for r in rows)
    nothing = language.fit(no_docs)
    assert nothing.decide("a text") == ("und", 0.0)
    assert no_docs.select(language.identify(F.col("text"), model)).count() == 0
