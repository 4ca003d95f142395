import difflib
import random

import numpy as np
import pytest

from orelode.llm import decontaminate


def test_common_equals_dynamic_programming():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.randrange(6) for _ in range(draw.randrange(1, 20))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        item = decontaminate.Item(1, np.array(a), np.array(a[:1]))
        assert decontaminate.common(item.masks, len(a), b) == best[-1][-1]


@pytest.mark.parametrize("n", range(1, 200))
def test_windows_hold_items_whole(n):
    wide = decontaminate.steps_for(n)
    assert wide * decontaminate.STEP >= n + decontaminate.STEP - 1


def prose(draw, n):
    words = [f"{a}{b}" for a in ("tor", "mel", "sa", "qui", "ven", "dra", "lo", "pim") for b in ("na", "ste", "ro", "lik", "wen", "u")]
    rare = [f"{draw.choice(words)}{draw.choice(words)}{draw.choice(words)}" for _ in range(n)]
    return " ".join(draw.choice(["the", "of", x, x, draw.choice(words), draw.choice(words) + "s"]) for x in rare)


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(9)
    items = [(i, prose(draw, 25) + ". " + prose(draw, 5) + ".") for i in range(12)] + [(90, None), (91, ""), (92, "!!"), (None, prose(draw, 30))]
    rows, planted = [], {}
    for d in range(160):
        text = prose(draw, draw.randrange(5, 300))
        if d % 8 == 0:
            i = d // 8 % 12
            words = text.split()
            at = draw.randrange(len(words) + 1)
            passage = items[i][1].split()
            if d % 16 == 0:
                passage = [w.upper() if k % 3 else w for k, w in enumerate(passage) if k % 6]  # a paraphrase
            text = " ".join(words[:at] + passage + words[at:])
            planted[d] = i
        rows.append((d, text))
    return (spark.createDataFrame(rows, "doc_id long, text string").repartition(4),
            spark.createDataFrame(items, "item_id long, text string"), planted)


def test_planted_passages_are_found_and_others_left(corpus):
    docs, items, planted = corpus
    rows = decontaminate.leaks(docs, items).collect()
    assert {r.doc_id: r.item_id for r in rows} == planted and len(rows) == len(planted)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        window = decontaminate.words_of(text[r.doc_id])[r.place:]
        assert r.common_words >= 0.7 * r.item_words and len(window) >= r.common_words
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == set(text) - set(planted)


def test_blocks_of_items_give_the_same(corpus, monkeypatch):
    docs, items, planted = corpus
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == set(planted.items())


def test_verbatim_items_of_the_tables(spark):
    """Every document that holds the words of an item is found; difflib agrees with the shares of the others."""
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    line = {r.doc_id: b" %s " % b" ".join(decontaminate.words_of(r.text)) for r in docs.collect()}
    item = {r.item_id: b" %s " % b" ".join(decontaminate.words_of(r.text)) for r in items.collect()}
    want = {(d, i) for d, t in line.items() for i, w in item.items() if w in t}
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items).collect()}
    assert want and want <= set(got)
    for (d, i), r in got.items():
        words, own = line[d].split()[r.place:r.place + 2 * r.item_words], item[i].split()
        blocks = difflib.SequenceMatcher(None, own, words, autojunk=False).get_matching_blocks()
        assert sum(b.size for b in blocks) >= 0.5 * len(own)


def test_awkward_rows(spark, awkward, no_docs):
    items = spark.createDataFrame([(1, "the first text under the mit license"), (2, None), (3, ""), (4, "word another word")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(awkward, items).collect()}
    assert got == {(1, 1), (6, 4)}
    assert decontaminate.clean(awkward, items).columns == awkward.columns
    assert decontaminate.leaks(no_docs, items).count() == 0
    assert decontaminate.leaks(awkward, items.where("false")).count() == 0
    assert decontaminate.clean(awkward, items.where("false")).count() == awkward.count()


def weak_leaks(seed, items, each):
    """Texts with an item planted as weakly as the rules allow: 70% of its words, or half of them and the answer."""
    draw = random.Random(seed)
    for i, text in items:
        words, answer = text.split(), text.rstrip(".").rsplit(". ", 1)[1].split()
        n, body = len(words), len(words) - len(answer)
        for _ in range(each):
            seven = sorted(draw.sample(range(n), -(-7 * n // 10)))
            half = sorted(draw.sample(range(body), max(0, -(-n // 2) - len(answer))))
            for passage in ([words[k] for k in seven], [words[k] if k in seven else prose(draw, 1) for k in range(n)],
                            [*(words[k] for k in half), *answer]):
                around = prose(draw, draw.randrange(60, 250)).split()
                at = draw.randrange(len(around))
                yield i, " ".join(around[:at] + passage + around[at:])


def by_brute_force(texts, items):
    """Common words by (text, item) of a search of every window."""
    made = [decontaminate.item_of(*x) for x in items]
    want = {}
    for d, words in enumerate(decontaminate.hashed(texts)):
        words = words.tolist()
        for item in made:
            wide = decontaminate.steps_for(len(item.words)) * decontaminate.STEP
            best = max(decontaminate.leaked(item, words[s:s + wide]) for s in range(0, len(words), decontaminate.STEP))
            if best:
                want[d, item.item_id] = best
    return want


def test_recall_at_the_limits_of_the_rules(spark):
    """Of the leaks that a search of every window finds, planted at 70% of the words and half plus answer, nearly all."""
    draw = random.Random(21)
    items = [(i, prose(draw, draw.randrange(12, 40)) + ". " + prose(draw, draw.randrange(3, 9)) + ".") for i in range(30)]
    planted = list(weak_leaks(4, items, 4))
    docs = spark.createDataFrame([(d, t) for d, (_, t) in enumerate(planted)], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = by_brute_force([t for _, t in planted], items)
    assert {(d, i) for d, (i, _) in enumerate(planted)} <= set(want)

    def found(**how):
        return {(r.doc_id, r.item_id): r.common_words for r in decontaminate.leaks(docs, asked, **how).collect()}

    assert found(near=decontaminate.EVERY) == want
    got = found()
    assert all(want[k] >= n for k, n in got.items())  # nothing is found that the search of every window does not find
    shares = [sum((d, planted[d][0]) in got for d in range(k, len(planted), 3)) / len(planted) * 3 for k in range(3)]
    assert min(shares) >= 0.95, shares
    # what else it finds here shares hardly more than the most frequent words with an item, and these weigh nothing
    assert len(got) >= 0.8 * len(want)
