"""Column functions against Python's own text, URL and HTML tools."""

import hashlib
import html as pyhtml
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from orelode.functions import html as H
from orelode.functions import keys, text, times, urls
from tests.conftest import one

TEXTS = [
    "plain", "  a  b\t\nc  ", "AT&amp;T &lt;b&gt; &quot;x&quot; &#39;y&#39; &#x20AC; &#233;", "&nbsp;a&nbsp;&nbsp;b",
    "&bogus; & alone &amp", "&copy &reg; &eacute;t&eacute; &hellip;", "x y z", "", "&#128512; ok", "a;b&;c&#;d",
    "tail &amp;amp; tail &amp;lt;",
]


def py_clean(s):
    return re.sub(r"\s+", " ", pyhtml.unescape(s).replace("\xa0", " ")).strip()


@pytest.mark.parametrize("s", TEXTS)
def test_clean_text(spark, s):
    assert one(spark, text.clean_text(F.col("c")), c=s) == py_clean(s)


@pytest.mark.parametrize("s,n", [("alpha beta gamma", 12), ("alphabetagamma", 5), ("short", 9), ("a b", 2), ("ab cd ef", 5)])
def test_trim_text(spark, s, n):
    want = s if len(s) <= n else s[:n].rsplit(" ", 1)[0]
    assert one(spark, text.trim_text(F.col("c"), n), c=s) == want


def test_split_text_lines(spark):
    assert one(spark, text.split_text_lines(F.col("c")), c="a b\n\n c&amp;d   e\r\nf \t g") == ["a b", "c&d", "e", "f g"]


@pytest.mark.parametrize("base", ["https://a.com", "https://a.com/b/c", "https://a.com/b/c/", "http://a.com/x/y;p?q=1#f"])
@pytest.mark.parametrize("ref", ["", "/p", "p/q", "../z", "./k/../m", "?q=2", "#top", "//c.d/e", "https://x.y/z", "mailto:a@b",
                                 "/a/./b/../c/", "../../../up", "d/..", "/x/y.html?u=/../v"])
def test_join_url(spark, base, ref):
    got = one(spark, urls.join_url(F.col("b"), F.col("r")), b=base, r=ref)
    want = urljoin(base, ref)
    if ref == "?q=2" and ";p" in base:  # urllib drops nothing, RFC 3986 keeps the base path
        want = "http://a.com/x/y;p?q=2"
    if ref == "":
        want = base
    assert got == want


@pytest.mark.parametrize("url,homepage,page", [
    ("example.com", "https://example.com/", "https://example.com/"),
    ("HTTP://Example.com/a?b=1#c", "http://Example.com/a", "http://Example.com/a?b=1"),
    ("https://e.com/a/b;v=1?x=1;y=2", "https://e.com/a/b", "https://e.com/a/b?x=1;y=2"),
    ("https://e.com?x=1", "https://e.com/", "https://e.com/?x=1"),
    ("https://e.com/a?", "https://e.com/a", "https://e.com/a"),
])
def test_normal_forms(spark, url, homepage, page):
    assert one(spark, urls.normalize_homepage(F.col("c")), c=url) == homepage
    assert one(spark, urls.normalize_url(F.col("c")), c=url) == page


@pytest.mark.parametrize("a,b,same", [
    ("https://www.x.com/", "https://x.com/p", True), ("https://x.com", "https://ir.x.com/", True),
    ("https://ir.x.com", "https://X.com/", True), ("https://x.com", "https://notx.com/", False),
    ("https://x.com", "mailto:a@x.com", False), ("", "https://x.com", False),
])
def test_same_site(spark, a, b, same):
    assert one(spark, urls.same_site(F.col("a"), F.col("b")), a=a, b=b) is same


@pytest.mark.parametrize("url,bad", [
    ("https://newsroom.x.com/gold", True), ("https://x.com/gold.pdf", False), ("https://x.com/a.JPG", True),
    ("https://x.com/a.docx?v=1", True), ("https://x.com/a.jpgs", False), ("https://x.com/projects/", False),
])
def test_unwanted_url(spark, url, bad):
    assert one(spark, urls.unwanted_url(F.col("c")), c=url) is bad


def test_link_score_counts_plural_twice(spark):
    score = urls.link_score(F.col("t"), F.col("u"))
    assert one(spark, score, t="assets", u="https://x.com/") == 4
    assert one(spark, score, t="Gold mine", u="https://x.com/") == 2 * 2 + 4
    assert one(spark, score, t="x", u="https://gold.com/y") == 0  # the host does not count


def test_stable_id(spark):
    got = one(spark, keys.stable_id("run", F.col("f"), F.lit(None)), f="a.yml")
    assert got == hashlib.sha1(b"run|a.yml|").hexdigest()[:24]


@pytest.mark.parametrize("s,want", [
    ("2024-01-05T01:02:03Z", "2024-01-05 01:02:03"), ("2024-01-05T01:02:03+02:00", "2024-01-04 23:02:03"),
    ("2024-01-05", "2024-01-05 00:00:00"), ("2024-01-05 01:02:03", "2024-01-05 01:02:03"), ("soon", None), ("", None),
])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_time_in_any_session_zone(spark, s, want, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, times.parse_time(F.col("c")).cast("string"), c=s) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ages_and_durations(spark):
    then = times.parse_time(F.col("c"))
    assert one(spark, times.hours_since(then, "2024-01-05T12:30:00Z"), c="2024-01-05T00:00:00Z") == 12.5
    assert one(spark, times.hours_since(then, "2024-01-04T12:30:00Z"), c="2024-01-05T00:00:00Z") == 0.0
    assert one(spark, times.hours_since(then, "2024-01-04T12:30:00Z"), c="x") is None
    span = times.duration_between(times.parse_time(F.col("a")), times.parse_time(F.col("b")))
    assert one(spark, span, a="2024-01-05T00:00:00Z", b="2024-01-05T00:00:01.9Z") == 1
    assert one(spark, span, a="2024-01-05T00:00:09Z", b="2024-01-05T00:00:01Z") == 0
    assert one(spark, times.normalize_latest(F.col("c")), c="2024-01-05") == "2024-01-05T00:00:00Z"
    assert one(spark, times.normalize_latest(F.col("c")), c="") is None


@pytest.mark.parametrize("v,want", [(" 12 ", 12), ("12.5", None), ("x", None), (None, None)])
def test_integer_or_none(spark, v, want):
    assert one(spark, keys.integer_or_none(F.col("c").cast("string")), c=v) == want


@pytest.mark.parametrize("verbatim,s,want", [
    (False, "The mine is 51% owned by A. More", "51% owned by A"), (True, "The mine is 51% owned by A. More", ""),
    (True, "The mine is 51%owned by A. More", "51%owned by A"), (False, "wholly owned by B", "wholly owned by B"),
    (False, "A 2.5% royalty. x", "2.5% royalty"),
])
def test_ownership(spark, verbatim, s, want):
    assert one(spark, text.first_match(F.col("c"), text.ownership_pattern(verbatim)), c=s) == want


def test_mining_fields(spark):
    s = ("The Hope project is located in northern Nevada. It is an Open Pit operation in production. Measured and Indicated "
         "resources are 1.2 Moz. Inferred resources are 3 Moz. Gold is hosted in quartz. See the NI 43-101 technical report "
         "at https://x.com/reports/hope.pdf today.")
    assert one(spark, text.first_match(F.col("c"), text.LOCATION), c=s) == "located in northern Nevada"
    assert one(spark, text.first_match(F.col("c"), text.STATUS), c=s) == "production"
    assert one(spark, text.first_match(F.col("c"), text.MINING_STYLE), c=s) == "Open Pit"
    assert one(spark, text.resource_text(F.col("c"), "measured"), c=s) == "Measured and Indicated resources are 1"
    assert one(spark, text.resource_text(F.col("c"), "inferred"), c=s) == "Inferred resources are 3 Moz"
    assert one(spark, text.topic_sentences(F.col("c")), c=s) == "Gold is hosted in quartz."
    assert one(spark, text.report_names(F.col("c")), c=s) == ["See the NI 43-101 technical report at https://x"]
    assert one(spark, text.report_urls(F.col("c")), c=s) == ["https://x.com/reports/hope.pdf"]


def test_report_names_as_one_search(spark, sf):
    """Searching stretch by stretch finds what one search of the whole text finds."""
    pattern = (r"[^.\n]{0,80}\b(?:NI 43-101|SK-1300|technical report|feasibility study|PEA|preliminary economic assessment)"
               r"\b[^.\n]{0,120}")
    docs = [r["text"].replace(" the ", " PEA ").replace(" and ", " technical report ")
            for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, c string").select(
        "i", text.report_names(F.col("c")).alias("n")).collect()
    for row in got:
        found = [py_clean(m) for m in re.findall(pattern, docs[row["i"]], re.I)]
        assert row["n"] == list(dict.fromkeys(f for f in found if f))[:10]


@pytest.mark.parametrize("name,want", [
    ("Hope Projects", "Hope"), ("- Hope | ", "Hope"), ("Hope Projects Overview", "Hope Projects"), ("x" * 130, "x" * 120)])
def test_clean_project_name(spark, name, want):
    assert one(spark, text.clean_project_name(F.col("c")), c=name) == want


@pytest.mark.parametrize("name,generic", [
    ("Projects", True), (" where we operate ", True), ("404 page", True), ("Latest News", True), ("Newsworthy", False),
    ("Homestake", False), ("Home", True)])
def test_generic_name(spark, name, generic):
    assert one(spark, text.generic_name(F.col("c")), c=name) is generic


def test_project_names(spark):
    lines = F.array(*[F.lit(x) for x in ["Overview", "Quick facts", "Hope Mine", "Other project"]])
    assert one(spark, text.project_name(lines), c="") == "Hope Mine"
    plain = F.array(F.lit("ab"), F.lit("Quick facts"), F.lit("More"))
    assert one(spark, text.project_name(plain), c="") == "Quick facts"
    inferred = text.inferred_name(F.lit("/en/hope-mine_2/"), F.col("c"), lines)
    assert one(spark, inferred, c="Hope Gold | Acme") == "Hope Gold"
    assert one(spark, inferred, c="Mid-Point Gold - Acme") == "Mid-Point Gold"
    assert one(spark, inferred, c="Home | Acme") == "hope mine 2"
    old = text.inferred_name(F.lit("/"), F.col("c"), lines, verbatim=True)
    assert one(spark, old, c="Mid-Point Gold - Acme") == "Mid"


def test_symbol_tags(spark):
    tags = text.symbol_tags(F.col("c"))
    assert one(spark, tags, c="cinema of silver and gold") == ["NEM", "GOLD", "MINERS", "SILVER"]
    assert one(spark, tags, c="nothing here") == ["GOLD", "SILVER", "MINERS"]
    assert one(spark, text.symbol_tags(F.col("c"), whole_word=True), c="cinema of gold") == ["GOLD", "MINERS"]
    every = "agnico wheaton coeur newmont barrick silver copper uranium lithium"
    assert one(spark, tags, c=every) == ["AEM", "WPM", "CDE", "NEM", "GOLD", "SILVER", "MINERS", "COPPER"]


def test_confidence_bounds(spark):
    def score(**v):
        names = ["name", "desc", "loc", "status", "ev", "layer"]
        row = {n: v.get(n, "") for n in names}
        return one(spark, text.confidence(*[F.col(n) for n in names]), **row)

    assert score(name="x") == 0.6
    assert score(name="x", desc="d", loc="l", status="s", ev="The reserve", layer="semantic_html") == 0.98
    assert score(name="x", layer="semantic_html") == 0.66


class Events(HTMLParser):
    """The parse events of a page as a list."""

    def __init__(self, page):
        super().__init__()
        self.seen = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.seen.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.seen.append(("close", tag, None))

    def handle_data(self, data):
        self.seen.append(("text", data, None))


def shown(page):
    """(last title, closed links, visible lines) told from the events."""
    title, links, lines = "", [], []
    target, in_title, held, dead = None, False, [], 0
    for kind, name, attrs in Events(page).seen:
        dead_tag = name in ("script", "style", "noscript", "svg")
        if kind == "text":
            if in_title or target:
                held.append(name)
            elif dead == 0:
                lines.append(py_clean(name))
        elif dead_tag:
            dead = dead + 1 if kind == "open" else max(0, dead - 1)
        elif name == "title":
            if kind == "close":
                title = py_clean(" ".join(held))
            in_title, held = kind == "open", []
        elif name == "a" and kind == "open" and attrs.get("href"):
            target, held = attrs["href"], []
        elif name == "a" and kind == "close" and target:
            links.append((target, py_clean(" ".join(held))))
            target = None
    return title, links, [x for x in lines if x]


PAGES = [
    "<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>Hello<br>world</p><a href='/x'>go <b>on</b></a></body>",
    "<p>one</p><!-- <p>no</p> --><script>var t='</p>';</script><noscript>gone <a href=y>link</a></noscript><p>two &amp;amp; three</p>",
    "<a name=x>kept</a><a class=\"c\" href=\"/u?a=1&amp;b=2\">T</a><svg><title>Icon</title><text>no</text></svg>tail",
    "<a href=/one>lost<a href=/two>kept</a> after",
    "text only", "", "<div>a</div><a href=/open>never closed",
    "<ul><li><a href=\"/The\">The</a></li><li>x</li></ul><h1>H&eacute;llo  there</h1>",
]


def test_page_parts_equal_a_parser(spark, sf):
    shared = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    pages = PAGES + shared
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").withColumn(
        "live", H.live_html(F.col("html")))
    rows = df.select("i", H.page_title(F.col("live")).alias("t"), H.page_links(F.col("live")).alias("k"),
                     H.page_lines(F.col("live")).alias("x")).collect()
    assert len(rows) == len(pages)
    for row in rows:
        title, links, lines = shown(pages[row["i"]])
        assert row["t"] == title, pages[row["i"]][:200]
        assert [tuple(a) for a in row["k"]] == links
        assert row["x"] == lines


def test_project_cards_equal_python(spark):
    page = ('<div class="card"><li>in</li>a</div><LI x=1>b</li><section>c<div>d</section></div><article>e</article>'
            '<div data-x="&amp;">f</div>')
    got = one(spark, H.project_cards(F.col("c")), c=page)
    want = [(pyhtml.unescape(m[1]), m[2]) for m in re.findall(
        r"<(article|li|div|section)\b([^>]*)>(.*?)</\1>", page, re.I | re.S)]
    assert [(c["attrs"], c["body"]) for c in got] == want


def test_likely_block(spark):
    long = "The gold mine project is described at some length here, with enough words to pass the size rule. "
    block = H.likely_block(F.col("a"), F.col("t"))
    assert one(spark, block, a='class="project"', t=long) is True
    assert one(spark, block, a='class="teaser"', t=long) is False
    assert one(spark, block, a='class="project"', t="gold mine") is False


def test_channel_id(spark):
    a, b = "UC" + "a" * 22, "UC" + "b" * 22
    assert one(spark, H.channel_id(F.col("c")), c=f'x https://www.youtube.com/channel/{b} "externalId":"{a}"') == a
    assert one(spark, H.channel_id(F.col("c")), c=f"x https://www.youtube.com/channel/{b}/about") == b
    assert one(spark, H.channel_id(F.col("c")), c=f"/channel/{b}") is None


def test_every_reference_is_decoded(spark):
    """As the standard library does it: all names, numbers of any length, and what is no character."""
    from html.entities import html5

    texts = [f"a &{n} b" for n in html5] + [f"x&{n}y" for n in html5] + [f"&#{i};z" for i in (
        *range(160), 173, 55295, 55296, 57343, 57344, 64976, 65533, 65534, 0x1FFFE, 1114111, 1114112, 9999999, 10**14)]
    texts += ["&#x110000;", "&#xD800;", "&#00000039;", "&#x000000000041g", "&#", "&#x;", "&;", "& a", "&&amp;", "&notit;",
              "&notin;", "&eacute", "&amp;lt;", "&unknown;", "&#146;s", "&#65x", "a&b&c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.unescape(F.col("t")).alias("v"))
    assert {r.i: r.v for r in rows.collect()} == {i: pyhtml.unescape(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("when, want", [
    ("2024-01-01T10:00Z", "2024-01-01 10:00:00"), ("2024-01-01 10:00", "2024-01-01 10:00:00"),
    ("2024-01-01T10:00+05:30", "2024-01-01 04:30:00"), ("2024-01-01T10:00:30Z", "2024-01-01 10:00:30"), ("10:00", None)])
def test_times_without_seconds(spark, when, want):
    assert one(spark, times.parse_time(F.col("t")).cast("string"), t=when) == want


@pytest.mark.parametrize("ref, want", [
    (" /projects/a", "http://h.org/projects/a"), ("\n/projects", "http://h.org/projects"), ("a\tb", "http://h.org/b/c/ab"),
    (" http://x.org/q", "http://x.org/q")])
def test_blanks_before_a_link(spark, ref, want):
    assert one(spark, urls.join_url(F.lit("http://h.org/b/c/d"), F.col("r")), r=ref) == want
