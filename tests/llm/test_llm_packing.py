import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orelode.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a b", "a  b\n c ", "x \n y\t z", "a  b 　c", "<|endoftext|> a b<|endoftext|>", "it's  \r\n ok 123 ,.;",
       " ", " \n", "\x1c a \x1d", "ü  ß  x", "a " * 5 + "\n", "漢字 kana かな", "word " * 3000]


def encoded(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END] for t in texts]


def test_ids_equal_the_tokenizer(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [np.array(x[:-1], "<u4").tobytes() for x in encoded(texts)]
    assert list(packing.ids_of(PATH).of(texts)) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 2047, 2048, 2049, 5000, 8191])
def test_cut(n):
    pieces = packing.cut(n)
    assert sum(length for _, length in pieces) == n
    assert [s for s, _ in pieces] == list(np.cumsum([0] + [x for _, x in pieces])[:-1])
    assert all(x & (x - 1) == 0 and x <= 2048 for _, x in pieces)
    assert len([x for _, x in pieces if x < 2048]) == bin(n % 2048).count("1")


def test_pieces_cover_every_document(spark, awkward, no_docs):
    rows = packing.pack(awkward, PATH).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    of = defaultdict(list)
    for r in rows:
        assert r.offset == 0 and r.length == 1 << r.bucket and len(r.ids) == 4 * r.length
        assert zlib.crc32(r.ids) == r.ids_crc32
        of[r.doc_id].append(r)
    texts = {r.doc_id: r.text for r in awkward.collect() if r.doc_id not in (None, 1)}
    for doc_id, (want,) in zip(texts, zip(encoded(texts.values())), strict=True):
        got = sorted(of[doc_id], key=lambda r: r.start)
        assert b"".join(r.ids for r in got) == np.array(want, "<u4").tobytes()
        assert {r.doc_tokens for r in got} == {len(want)}
    assert sorted(r.start for r in of[1])[:2] == [0, 0]  # both copies are packed
    assert packing.pack(no_docs, PATH).count() == 0


def test_buckets(spark, awkward, tmp_path):
    packed = packing.pack(awkward, PATH)
    packing.write_buckets(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == packed.count()
    assert back.where("length(ids) <> 4 * shiftleft(1, bucket) or cu_seqlens[1] <> shiftleft(1, bucket)").count() == 0


def test_bad_size(awkward):
    with pytest.raises(ValueError):
        packing.pack(awkward, PATH, largest=1000)
