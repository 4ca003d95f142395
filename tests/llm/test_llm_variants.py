import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np

from orelode.llm import queries, variants


def words_of(rows):
    out = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if own is None else own}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += len(run) >= 5
    return {w: n for w, n in out.items() if n >= 3}


def by_brute_force(words):
    """Rows by word; near words by what is left when a letter is deleted from either or both."""
    near, holes = defaultdict(set), defaultdict(list)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1:]].append(w)
            if (cut := w[:k] + w[k + 1:]) in words:
                near[w].add(cut)
                near[cut].add(w)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if a != b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return out


def table(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r for r in rows}


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = by_brute_force(words_of(rows))
    assert any(x[1] for x in want.values()) and table(queries.QUERIES["op11_variants"](spark, sf)) == want


def test_small_blocks_ties_and_long_words(spark, monkeypatch):
    """Blocks of a few words, chains of forms, ties, letters beyond ASCII and words too long for single precision."""
    draw = random.Random(3)
    words = Counter()
    for base in ("abcde", "abcdé", "ÿþýüûú", "straße", "x" * 2500, "mineral"):
        base = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in base)
        words[base] = 40
        for _ in range(60):
            w = list(base)
            for _ in range(draw.randrange(1, 4)):
                k = draw.randrange(len(w))
                w[k:k + 1] = draw.choice([[], [draw.choice("abcdeéÿ")], [w[k], draw.choice("abxyz")]])
            words["".join(w)] = draw.choice([3, 3, 6, 12, 13, 30])
    words = {w: n for w, n in words.items() if len(w) >= 5}
    monkeypatch.setattr(variants, "LETTERS", 40)
    rows = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    near = {r.word: (r.n_near, r.best_n, r.best) for r in variants.near_words(rows).collect()}
    want = by_brute_force(words)
    assert {w: x[0] for w, x in near.items()} == {w: x[4] for w, x in want.items() if x[4]}
    for w, (_, n, best) in near.items():
        assert words[best] == n and (want[w][1] in (None, best)) and (want[w][1] is None) == (n < 2 * words[w])


def test_edits_by_blocks():
    def block(words):
        return variants.Block(len(words[0]), "".join(words).encode("latin-1"), np.ones(len(words), np.int64).tobytes())

    a, b, c = block(["abcde", "abced", "bbcde"]), block(["abcde", "xbcde"]), block(["aabcde", "abcdex", "edcbaa"])
    assert list(zip(*map(list, variants.near_pairs(a, a, True)), strict=True)) == [(0, 2)]
    assert set(zip(*map(list, variants.near_pairs(a, b, False)), strict=True)) == {(0, 1), (2, 0), (2, 1)}
    assert set(zip(*map(list, variants.near_pairs(a, c, False)), strict=True)) == {(0, 0), (0, 1)}


def test_roots_of_long_chains(spark):
    rows = [(f"w{k:03}", f"w{k + 1:03}") for k in range(100)] + [("x", "w050"), ("y", "x")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {w: "w100" for w, _ in rows}


def test_awkward_rows(spark, awkward, no_docs):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert table(variants.spelling_variants(awkward)) == by_brute_force(words_of(rows))
    assert variants.spelling_variants(no_docs).count() == 0
