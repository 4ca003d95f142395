import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orelode import session
from orelode.llm import nearcopies


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(texts, least=0.8):
    """Ids of the smallest of each class, by the Jaccard similarity of all pairs; ``texts`` by id."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            p, q = sets[a], sets[b]
            if p == q or len(p & q) >= least * len(p | q):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_stage_equals_brute_force(spark, name):
    """The stage drops near copies far more than 2 of 64 SimHash bits apart, and keeps what is less alike."""
    sf = f"/root/testdata/{name}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = kept_by_brute_force({r.doc_id: r.text for r in docs.collect()})
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_large_groups_and_chains(spark, rounds):
    """Groups larger than a crowd, near copies around the threshold, and chains whose ends are not alike."""
    draw = random.Random(5)
    texts = {}

    def put(words):
        texts[len(texts)] = " ".join(words)

    for size, words in ((60, 300), (40, 120), (30, 60)):
        base = [f"w{draw.randrange(10_000)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randrange(0, words // 30)):
                copy[draw.randrange(words)] = f"x{draw.randrange(10_000)}"
            put(copy)
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        chain = chain[3:] + [f"d{i}{k}" for k in range(3)]
        put(chain)
    order = list(texts)
    draw.shuffle(order)
    texts = {n: texts[k] for n, k in enumerate(order)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in nearcopies.first_of_each(docs, rounds=rounds, crowd=2).collect()} == kept_by_brute_force(texts)


def test_awkward_rows(awkward, no_docs):
    kept = nearcopies.first_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 5, 6, 7, 8, 9]
    assert nearcopies.first_of_each(no_docs).count() == 0


def test_fingerprints_give_candidates(spark):
    """SimHash alone brings texts together: the same fingerprint, and fingerprints 2 bits apart."""
    draw = random.Random(7)
    words = [f"w{draw.randrange(10_000)}" for _ in range(3000)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(words[::-1]), " ".join([*words, *words]), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", nearcopies.sketch_of(F.col("text"), 5).alias("sketch")).select("doc_id", "sketch.*").collect()
    sketches = spark.createDataFrame(rows).select("set", "fp", "size")
    by_id = {r.doc_id: r for r in rows}
    apart = {(a.set, b.set): ((a.fp ^ b.fp) & (1 << 64) - 1).bit_count() for a in rows for b in rows if a.size and b.size and a.set > b.set}
    got = {(r.u, r.v) for r in nearcopies.by_prints(sketches).collect()}
    assert got and all(apart[p] <= 2 for p in got)
    reached = {frozenset(p) for p in got}
    assert {frozenset(p) for p, bits in apart.items() if bits <= 2 and by_id[2].set not in p} and all(by_id[2].set not in p for p in reached)


def test_copies_below_the_threshold_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies that were each changed on their own are some 0.7 alike: none is linked, and few pairs are taken to the shingles."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(80):
        copy = list(base)
        for at in draw.sample(range(0, 300, 6), 9):
            copy[at] = f"x{i}y{at}"
        texts[i] = " ".join(copy)
    checked = []
    links = nearcopies._links

    def counted(pairs, *rest):
        checked.append(pairs.distinct().count())
        return links(pairs, *rest)

    monkeypatch.setattr(nearcopies, "_links", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.first_of_each(docs).collect()} == kept_by_brute_force(texts)
    assert sum(checked) < 4 * len(texts)


def test_a_round_without_a_link_is_not_repeated(spark, monkeypatch):
    """Copies that share buckets and no link: the middles, one round of single members, then the last round."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(40):
        copy = list(base)
        for at in draw.sample(range(0, 300, 6), 9):
            copy[at] = f"x{i}y{at}"
        texts[i] = " ".join(copy)
    rounds = []
    links = nearcopies._links

    def counted(*args):
        rounds.append(args)
        return links(*args)

    monkeypatch.setattr(nearcopies, "_links", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.first_of_each(docs, rounds=5).collect()} == kept_by_brute_force(texts)
    assert len(rounds) <= 3


def test_members_are_never_broadcast(spark, monkeypatch):
    """Members repeat the traits of their set, so their files are far smaller than their rows."""
    plans = {}

    def settled(df, name, f=nearcopies.settle):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return f(df, name)

    monkeypatch.setattr(nearcopies, "settle", settled)
    monkeypatch.setattr(session, "FEW", 0)
    base = [f"w{k}" for k in range(200)]
    copies = [" ".join([*base[:k], f"x{k}", *base[k + 1:]]) for k in range(0, 200, 5)]
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    assert [r.doc_id for r in nearcopies.first_of_each(docs).collect()] == [0]
    pairs = [x for x in plans["pairs"] + plans["mixed"] if "bucket" in x]
    assert len(pairs) >= 2
    for plan in pairs:
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin [bucket" in x]
