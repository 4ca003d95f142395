import random

import pytest
from pyspark.sql import functions as F

from checks.compare import compare
from orelode.llm import queries, urlfilter


def by_brute_force(url, rules):
    """(host, path, rule, verdict) of a URL."""
    _, colon, rest = (url or "").partition("://")
    stop = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:stop])
    path = rest[stop:]
    path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    host, path = (host, path) if colon else ("", "")
    fit = [(-len(h + p), -len(h), not block, h + p) for h, p, block in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, default=None)
    return host, path, best and best[3], "block" if best and not best[2] else "allow"


def test_query_equals_sql(spark, sf):
    rows, _, problem = compare(spark, sf, queries.QUERIES["op12_url_filter"], queries.SQL["op12_url_filter"])
    assert rows and not problem, problem


@pytest.mark.parametrize("passes", [False, True])
def test_many_rules_against_brute_force(spark, monkeypatch, passes):
    """Hundreds of rules over thousands of URLs, as one filter and as many parts asked in several passes."""
    if passes:
        monkeypatch.setattr(urlfilter, "PART_KEYS", 50)
        monkeypatch.setattr(urlfilter, "BROADCAST", 600)
    draw = random.Random(7)
    names = ["a", "b", "www", "x", "é", "shop"]

    def host():
        return ".".join([*draw.choices(names, k=draw.randrange(0, 4)), draw.choice(["com", "net", "co.uk"])])

    def path():
        return "".join(f"/{draw.choice(names)}" for _ in range(draw.randrange(0, 4))) + draw.choice(["", "/", "/ind"])

    rules = [(host(), path(), draw.random() < 0.5) for _ in range(400)]
    urls = [f"http{draw.choice(['', 's'])}://{host().upper() if draw.random() < 0.2 else host()}{path()}"
            f"{draw.choice(['', '?q=/a', '#/b'])}" for _ in range(3000)]
    urls += ["no scheme", "", None, "://", "http://", "a://b://c.com/", "http://com", "http://.com/", "http://x..com/a"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").repartition(4)
    found = urlfilter.judged(pages, spark.createDataFrame(rules, "host string, path string, block boolean"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got == {k: by_brute_force(u, rules) for k, u in enumerate(urls)}
    assert {v for *_, v in got.values()} == {"allow", "block"}


def test_cascade_has_levels_and_is_exact(spark):
    """Filters mistake keys, and the levels mend all of it; the filters are far smaller than the universe."""
    keys = spark.range(200_000).select(F.xxhash64("id").alias("h"), F.xxhash64(F.lit(1), "id").alias("g"),
                                       (F.col("id") % 50 == 0).alias("listed"))
    cascade = urlfilter.Cascade.build(keys)
    assert len(cascade.levels) > 3 and sum(x.bits * x.parts for x in cascade.levels) < 20 * 4000
    marked = cascade.mark(keys.select(F.array("h").alias("h"), F.array("g").alias("g"), "listed"), "h", "g", "found")
    assert marked.where(F.col("listed") != F.col("found")[0]).count() == 0


def test_awkward_rows(spark):
    none = spark.createDataFrame([], "host string, path string, block boolean")
    rules = spark.createDataFrame([("com", "/", True), (None, "/", True), ("x.com", None, False), ("y.com", "/", None),
                                   ("Z.com", "/", False), ("z.com", "/", True), ("w.com", "/", False), ("w.com", "/", False)],
                                  none.schema)
    rows = [(1, "http://a.com/", "k"), (1, "http://a.com/", "k"), (None, "http://a.com/", None), (2, None, None), (3, "", ""),
            (4, "http://z.COM/" + "a/" * 50_000, "k"), (5, "http://" + "a." * 20_000 + "com/x", "k"), (6, "http://w.com/", "k")]
    extra = ("rule", "host", "h", "g", "key")
    pages = spark.createDataFrame([(*r, *["taken"] * len(extra)) for r in rows],
                                  "page_id long, url string, verdict string, " + ", ".join(f"{c} string" for c in extra))
    got = urlfilter.judged(pages, rules)
    assert got.columns == ["page_id", "url", "h", "g", "key", "host", "path", "rule", "verdict"]
    assert [r.verdict for r in got.orderBy(F.length("url"), "url").collect()].count("block") == 5
    assert {(r.page_id, r.rule, r.verdict) for r in got.where("page_id in (2, 3, 4, 6)").collect()} == {
        (2, None, "allow"), (3, None, "allow"), (4, "z.com/", "block"), (6, "w.com/", "allow")}
    assert {r.verdict for r in urlfilter.judged(pages, none).collect()} == {"allow"}
    assert urlfilter.judged(pages.limit(0), rules).count() == 0
