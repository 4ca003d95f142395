from collections import Counter

from orelode.operators import preparation


def test_boilerplate_needs_a_share_and_different_texts(spark):
    """A line must be in five texts and over 1% of the documents; five copies of a text make none of its lines frequent."""
    rows = [(i, f"own {i}\nfooter" if i < 8 else f"own {i}\nchance" if i < 14 else f"own {i}") for i in range(700)]
    rows += [(700 + i, "copied\nwhole") for i in range(9)] + [(800, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    n = Counter(line for t in {t for _, t in rows if t} for line in set(t.split("\n")))
    frequent = {line for line, k in n.items() if k >= 5 and k > 0.01 * len(rows)}
    assert frequent == {"footer"}
    got = {r.doc_id: (r.text, r.dropped) for r in preparation.without_boilerplate(docs, 5).collect()}
    assert got == {i: (t, None if t is None else 0) if t is None or "footer" not in t else (f"own {i}", 1) for i, t in rows}
