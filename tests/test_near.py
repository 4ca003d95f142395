import random

from orelode.operators import near


def words_of(text):
    return "".join(c.lower() for c in text or "").split()


def classes(texts, least=0.8):
    """Smallest id of the class of each text, by the Jaccard similarity of all pairs."""
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else None
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_groups_chains_and_awkward_texts(spark, monkeypatch):
    draw = random.Random(2)
    texts = [None, "", " \n\t", "one", "One", "one two three four five", "one two three four"]
    for size, n in ((40, 200), (30, 60), (8, 30)):
        base = [f"w{draw.randrange(5000)}" for _ in range(n)]
        texts += [" ".join(base)] * 3
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randrange(0, max(2, n // 30))):
                copy[draw.randrange(n)] = f"x{draw.randrange(5000)}"
            texts.append(" ".join(copy))
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        chain = chain[3:] + [f"d{k}{j}" for j in range(3)]
        texts.append(" ".join(chain))
    texts.append("word " * 50_000)
    draw.shuffle(texts)
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for rounds in (0, 2):
        monkeypatch.setattr(near, "ROUNDS", rounds)
        assert {r.doc_id: r.class_id for r in near.near_copies(docs).collect()} == classes(texts)


def test_empty(spark):
    assert near.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 200 + k) for k in range(30)] + [(7, 7), (300, 299)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in (100, *range(200, 230))} | {300: 299, 299: 299}


def test_copies_below_the_threshold_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies that were each changed on their own are some 0.7 alike: none is linked, and few pairs are taken to the shingles."""
    draw = random.Random(3)
    texts = {}
    for i in range(60):
        copy = [f"w{k}" for k in range(300)]
        for at in draw.sample(range(0, 300, 6), 9):
            copy[at] = f"x{i}y{at}"
        texts[i] = " ".join(copy)
    taken = []
    checked = near._checked

    def counted(pairs, *rest):
        taken.append(pairs.distinct().count())
        return checked(pairs, *rest)

    monkeypatch.setattr(near, "_checked", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near.near_copies(docs).collect()} == classes(texts)
    assert sum(taken) < 4 * len(texts)
