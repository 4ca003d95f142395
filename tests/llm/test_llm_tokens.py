import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from orelode.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_best_fit_equals_a_plain_search():
    draw = random.Random(2)
    for most in (1, 7, 64, 2048):
        lengths = [draw.randrange(1, most + 1) for _ in range(200)]
        rows, room = [], []
        for k in sorted(range(200), key=lambda i: -lengths[i]):
            fits = [r for r in room if r >= lengths[k]]
            if fits:
                at = max(i for i, r in enumerate(room) if r == min(fits))
            else:
                at = len(rows)
                rows.append([])
                room.append(most)
            rows[at].append(k)
            room[at] -= lengths[k]
        got = tokens.best_fit(lengths, most)
        assert sorted(k for r in got for k in r) == list(range(200))
        assert all(sum(lengths[k] for k in r) <= most for r in got) and len(got) == len(rows)


def test_matrices_hold_every_document(awkward, no_docs):
    tokenizer = Tokenizer.from_file(PATH)
    rows = tokens.matrices(awkward, PATH, length=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    got = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.position_resets == r.cu_seqlens[:-1]
        for s, low, high in zip(r.segments, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert zlib.crc32(ids[low:high].tobytes()) == s.ids_crc32 and high - low == s.length
            got.setdefault(s.doc_id, []).append((s.start, ids[low:high].tolist()))
        assert not ids[r.cu_seqlens[-1]:].any()
    for r in awkward.collect():
        if r.doc_id not in (None, 1):
            want = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
            assert [x for _, part in sorted(got[r.doc_id]) for x in part] == want
    assert tokens.segments(tokens.matrices(no_docs, PATH)).count() == 0
