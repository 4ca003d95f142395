import random
import re

import pytest
import xxhash

from orelode.llm import simhash
from orelode.llm.graph import _large_star, _small_star, star_forest
from orelode.llm.shared import settle


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace(
        "\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ps = sorted(root)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in ps}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


TEXTS = [None, "", " \n", "one", "One two", "a b c", "a b c d", "A\x0bb\x0cc\td", "x\x1cy z w", "ü Ü ß k", "a b c " * 500]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_every_point_has_one_home(spark):
    draw = random.Random(3)
    points = [draw.getrandbits(64) for _ in range(300)]
    prints = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    homes = {}
    for r in simhash._at_anchors(prints, 1).collect():
        homes.setdefault(r.fp, []).append(r.anchor)
    assert all(len(x) == 2 and len({a >> 31 for a in x}) == 2 for x in homes.values())
    visits = simhash._at_anchors(prints, 2).count()
    assert visits <= 32 * len(points)


def clustered(seed):
    draw = random.Random(seed)
    out = {0, 2**64 - 1}
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(25):
            p = centre
            for _ in range(draw.randrange(5)):
                p ^= 1 << draw.randrange(64)
            out.add(p)
    chain = draw.getrandbits(64)
    for i in range(0, 40, 2):
        chain ^= 3 << i
        out.add(chain)
    return out


@pytest.mark.parametrize("seed, crowd", [(1, 64), (2, 3), (3, 0)])
def test_links_give_all_components(spark, seed, crowd, monkeypatch):
    """At the usual size of a hot anchor, at a small one, and with every anchor hot."""
    points = clustered(seed)
    monkeypatch.setattr(simhash, "links", lambda p, f=simhash.links: f(p, crowd))
    rows = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(sorted(points))], "doc_id long, fp long")
    want = plain_components(points)
    number = {p: i for i, p in enumerate(sorted(points))}
    lowest = {}
    for p, r in want.items():
        lowest[r] = min(lowest.get(r, 10**9), number[p])
    got = {r.fp: r.component_id for r in simhash.components(rows).collect()}
    assert got == {signed(p): lowest[want[p]] for p in points}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_never_broadcast(spark):
    """Spark takes the 32 visits and 65 points of a fingerprint for one row, and would send all of a short table through the driver."""
    prints = settle(spark.range(2000).selectExpr("xxhash64(id) AS fp"), "prints")
    found = simhash.links(prints)
    assert "Generate" in plan_of(found) and not re.search("BroadcastHashJoin .*Inner", plan_of(found))
    edges = settle(spark.range(2000).selectExpr("id + 1 AS u", "id AS v"), "edges")
    for stars in (_large_star(edges), _small_star(edges)):
        assert "SortMergeJoin" in plan_of(stars) and "BroadcastHashJoin" not in plan_of(stars)
    assert "BroadcastHashJoin" in plan_of(_large_star(edges, 2000))


def test_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: plain_print(r.text) for r in docs.collect()}
    want = plain_components(set(prints.values()))
    lowest = {}
    for d, p in prints.items():
        lowest[want[p]] = min(lowest.get(want[p], d), d)
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        d: (f"{p:016x}", lowest[want[p]]) for d, p in prints.items()}


def test_awkward_rows(awkward, no_docs):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}
    assert [r.component_id for r in rows if r.fingerprint != "0" * 16 and r.doc_id is None] == [None]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_class_stays(spark, awkward, no_docs):
    kept = simhash.first_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i or -1 for i in ids) == [-1, 1, 2, 5, 6, 7, 8, 9]
    assert simhash.first_of_each(no_docs).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(None, 2)], [(i, i + 1) for i in range(60)],
                                   [(0, i) for i in range(1, 50)] + [(50, 51), (51, 50), (7, 50), (60, 61)]])
def test_star_forest(spark, edges):
    rows = star_forest(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {x: x for e in edges if None not in e for x in e}
    for _ in root:
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert {(r.u, r.v) for r in rows} == {(x, r) for x, r in root.items() if x != r}
