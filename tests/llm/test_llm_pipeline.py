import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from orelode.llm import decontaminate, queries
from test_llm_nearcopies import kept_by_brute_force

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = __spark_entry__.queries()
    assert {x.split("_")[0] for x in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.SQL) <= set(__spark_entry__.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "SimHash near-dedup", "benchmark decontamination", "PII", "packing"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, as written and read again."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        folder = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark, stages):
    docs, spoken, single, clean, safe, packed = stages
    assert all(x.columns == COLUMNS for x in stages[:5])
    before, kept = by_id(docs), by_id(spoken)
    assert all(any(c.isalpha() for c in r.text) for r in kept.values()) and len(kept) > 0.95 * len(before)
    want = kept_by_brute_force({d: r.text for d, r in kept.items()})
    assert set(by_id(single)) == want and len(want) == single.count() < len(kept)
    items = [b" ".join(decontaminate.words_of(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    held = {d for d, r in by_id(single).items() if any(i in b" ".join(decontaminate.words_of(r.text)) for i in items)}
    gone = set(by_id(single)) - set(by_id(clean))
    assert held and held <= gone and len(gone - held) <= 2
    texts = by_id(safe)
    assert set(texts) == set(by_id(clean)) and all(r.n_chars == len(r.text) for r in texts.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids: dict[int, bytes] = {}
    for r in packed.orderBy("doc_id", "start").collect():
        ids[r.doc_id] = ids.get(r.doc_id, b"") + r.ids
    assert ids == {d: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes()
                   for d, r in texts.items()}


def test_run_is_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "start", "ids_crc32").collect()
    want = stages[-1].select("doc_id", "start", "ids_crc32").collect()
    assert sorted(rows) == sorted(want)


def test_awkward_rows(spark, awkward, docs_schema, no_docs):
    sf = "/root/testdata/sf0.001"
    docs = awkward.select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.collect() is not None
        assert stage(spark, no_docs, sf).count() == 0
        if out.columns == COLUMNS:
            assert out.dtypes == docs.dtypes
