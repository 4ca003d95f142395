import math
import random
import re
from collections import Counter

import pytest

from checks.compare import compare
from orelode.llm import queries, ranked

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_brute_force(docs, items, top=10):
    """Sorted rows (item_id, rank, doc_id, score) of all documents scored one by one."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    count = sum(1 for _, b in bags if b)
    total = sum(b.total() for _, b in bags)
    holding = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            score = 0
            m = 100 - 75 + 75 * b.total() * count // max(1, total)
            for t in terms(text):
                if b[t]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * holding[t] + 1)))
                    score += w * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_equals_sql(spark, sf):
    rows, _, problem = compare(spark, sf, queries.QUERIES["op13_ranked_search"], queries.SQL["op13_ranked_search"])
    assert rows and not problem, problem


@pytest.mark.parametrize("sizes", [{}, {"FIRST": 20, "HELD": 16, "BUCKET": 4, "GROUP": 3, "FOCUS": 2, "ITEMS": 10}])
def test_equals_brute_force(spark, monkeypatch, sizes):
    """Copies, ties beyond the result, rare and common words; with tiny buckets every bound is at work."""
    for name, value in sizes.items():
        monkeypatch.setattr(ranked, name, value)
    draw = random.Random(11)
    words = [f"w{k}" for k in range(120)]
    pick = lambda n: " ".join(draw.choices(words, [1 / (k + 1) for k in range(120)], k=n))
    docs = [(k, pick(draw.choice([1, 5, 30, 200]))) for k in range(400)]
    docs += [(k, docs[7][1]) for k in range(400, 460)] + [(500, "W3, W3!"), (500, "W3, W3!"), (None, docs[7][1])]
    items = [(k, pick(draw.choice([1, 4, 20]))) for k in range(25)] + [(3, "w1 w1 w2"), (None, "w119"), (99, "unknown")]
    got = ranked.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                        spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == by_brute_force(docs, items)


def test_buckets_are_left_out(spark, monkeypatch):
    """Short vectors are not even read once the longest have given a bound."""
    monkeypatch.setattr(ranked, "FIRST", 20)
    scored = []
    keep = ranked._search
    monkeypatch.setattr(ranked, "_search", lambda v, *a: scored.append(v.count()) or keep(v, *a))
    docs = [(k, "rare rare word") for k in range(20)] + [(k, "word " + "long " * 400) for k in range(20, 300)]
    items = [(1, "rare word")]
    got = ranked.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == by_brute_force(docs, items) and scored == [20, 0]


def test_awkward_rows(spark, awkward, no_docs):
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    items = [(1, "text"), (2, None), (3, ""), (4, "another WORD word"), (1, "text"), (None, "an id é")]
    asked = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, score string, rank int")
    assert rows_of(ranked.ranked(awkward, asked)) == by_brute_force(docs, items)
    assert ranked.ranked(no_docs, asked).count() == 0 and ranked.ranked(awkward, asked.limit(0)).count() == 0
