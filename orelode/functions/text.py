"""Text cleaning, bounded excerpts and field extraction, as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from orelode import dims

# runs of white space that are not one plain space already, so tidy text is passed over
_SPACES = r"(?U)[\s\x1c-\x1f]{2,}+|[\s\x1c-\x1f&&[^ ]]"
# names that HTML also accepts without the closing semicolon, longest first
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
# code points that HTML reads as others: 128 to 159 are letters of Windows-1252 where it has any
_WINDOWS = [ord(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(128, 160)]


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` worked out once, however often ``use`` names it.

    Without this the optimizer may inline a costly expression at every mention.
    """
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _entity_names() -> str:
    """The named references of HTML 5, as the SQL text of one constant map."""
    pairs = "\u0001".join(f"{name}\u0002{value}" for name, value in sorted(html5.items()))
    return f"str_to_map(decode(X'{pairs.encode().hex()}', 'UTF-8'), '\u0001', '\u0002')"


# A code point as a character: what is no character becomes U+FFFD, what HTML forbids nothing.
_CHARACTER = f"""n -> CASE
  WHEN n BETWEEN 128 AND 159 THEN decode(unhex(lpad(hex(array({', '.join(map(str, _WINDOWS))})[int(n - 128)]), 8, '0')), 'UTF-32')
  WHEN n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN '\ufffd'
  WHEN n < 9 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN ''
  ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END"""

# Written as SQL, as it is used in many places and takes one call this way. Numbers are cut
# to nine digits after their leading zeros: any such number is beyond all characters already.
_UNESCAPE = rf"""s -> CASE WHEN contains(s, '&') THEN array_join(transform(split(s, '&'), (part, i) ->
  CASE WHEN i = 0 THEN part
       WHEN part RLIKE '^#(?:[0-9]|[xX][0-9a-fA-F])' THEN
         transform(array(CASE WHEN part RLIKE '^#[0-9]'
             THEN bigint('0' || regexp_extract(part, '^#0*([0-9]{{0,9}})', 1))
             ELSE bigint(conv('0' || regexp_extract(part, '^#[xX]0*([0-9a-fA-F]{{0,9}})', 1), 16, 10)) END), {_CHARACTER})[0]
         || regexp_replace(part, '^#(?:[xX][0-9a-fA-F]+|[0-9]+);?', '')
       ELSE transform(array(struct(regexp_extract(part, r'^([^	
 <&#;]{{1,32}};)', 1) AS closed,
                                   regexp_extract(part, r'^({_BARE})', 1) AS bare)), ref -> coalesce(
         try_element_at({_entity_names()}, ref.closed) || substring(part, length(ref.closed) + 1),
         try_element_at({_entity_names()}, nullif(ref.bare, '')) || substring(part, length(ref.bare) + 1),
         '&' || part))[0] END), '') ELSE s END"""


def unescape(c: Column) -> Column:
    """Character references to characters; unknown ones stay as written."""
    return F.get(F.call_function("transform", F.array(c), F.expr(_UNESCAPE)), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space, no-break spaces included, to one space; trimmed."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def clean_text(c: Column) -> Column:
    return squeeze(unescape(F.coalesce(c, F.lit(""))))


def cut_at_word(c: Column, n: int) -> Column:
    """At most ``n`` characters of clean text, cut back to a space if there is one."""
    return once(c, lambda s: F.when(F.length(s) <= n, s).otherwise(
        F.regexp_replace(F.substring(s, 1, n), r" [^ ]*$", "")))


def trim_text(c: Column, n: int) -> Column:
    return cut_at_word(clean_text(c), n)


def nonempty(arr: Column) -> Column:
    return F.filter(arr, lambda x: x != "")


def split_text_lines(c: Column) -> Column:
    """Clean non-empty lines; two or more spaces also end a line."""

    def lines(s: Column) -> Column:
        raw = F.split(s, r"[\n\r]+| {2,}")
        return F.when(F.contains(s, F.lit("&")), F.transform(raw, clean_text)).otherwise(F.transform(raw, squeeze))

    return nonempty(once(c, lines))


def contains_any(c: Column, terms: list[str]) -> Column:
    return c.rlike("|".join(re.escape(t) for t in terms))


def count_terms(c: Column, terms: list[str]) -> Column:
    """How many of the terms occur; a plural counts beside its singular."""
    table = F.array(*[F.lit(t) for t in terms])
    return once(c, lambda s: F.size(F.filter(table, lambda t: F.contains(s, t))))


def words(terms: list[str]) -> str:
    """Pattern for any of the terms as whole words, in any case."""
    return r"(?iU)\b(?:" + "|".join(terms) + r")\b"


def first_match(c: Column, pattern: str) -> Column:
    return trim_text(F.regexp_extract(c, pattern, 0), 500)


def ownership_pattern(verbatim: bool = False) -> str:
    """``verbatim`` also asks for a word character straight after the percent sign."""
    if verbatim:
        return r"(?iU)\b(?:\d{1,3}(?:\.\d+)?%|wholly owned|joint venture|owns?|ownership|stream|royalty)\b[^.]{0,180}"
    return r"(?iU)\b(?:\d{1,3}(?:\.\d+)?%|(?:wholly owned|joint venture|owns?|ownership|stream|royalty)\b)[^.]{0,180}"


STATUS = words(dims.STATUS_WORDS)
MINING_STYLE = words(dims.STYLE_WORDS)
RESOURCE = r"(?iU)\b(?:" + "|".join(dims.RESOURCE_WORDS) + r")\b[^.]{0,240}"
LOCATION = (
    r"(?iU)\b(?:located|location|in|near)\b[^.]{0,120}\b(?:" + "|".join(dims.PLACES) + r")\b"
)
REPORT_NAME = r"(?iU)[^.\n]{0,80}\b(?:" + "|".join(dims.REPORT_WORDS) + r")\b[^.\n]{0,120}"
REPORT_HINT = words(dims.REPORT_WORDS)
WEB_LINK = r"https?://[^\s\"')<>]+"


def resource_text(c: Column, kind: str, pattern: str = RESOURCE) -> Column:
    """First three resource statements of a kind: ``inferred`` or ``measured``."""
    wanted = ["inferred"] if kind == "inferred" else ["measured", "indicated", "m&i"]
    hits = F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: contains_any(F.lower(m), wanted))
    return trim_text(F.array_join(F.slice(hits, 1, 3), " "), 500)


def sentences(c: Column) -> Column:
    """Clean text split after ``.``, ``!`` or ``?`` and white space."""
    return F.split(F.regexp_replace(clean_text(c), r"([.!?])\s+", "$1\u0001"), "\u0001")


def topic_sentences(c: Column, terms: list[str] | None = None, limit: int = 5, size: int = 900) -> Column:
    """First sentences that name a topic; geology by default."""
    pattern = words(terms or dims.GEOLOGY_WORDS)
    return trim_text(F.array_join(F.slice(F.filter(sentences(c), lambda s: s.rlike(pattern)), 1, limit), " "), size)


def clean_unique(arr: Column, limit: int) -> Column:
    return F.slice(F.array_distinct(nonempty(F.transform(arr, clean_text))), 1, limit)


def report_names(c: Column, pattern: str = REPORT_NAME, hint: str = REPORT_HINT) -> Column:
    """Report names with their surroundings inside one sentence or line.

    The pattern may start 80 characters before a report word, so it is tried only
    on the stretches between periods and line ends that hold one.
    """
    stretches = F.filter(F.split(c, r"[.\n]"), lambda x: x.rlike(hint))
    return clean_unique(F.flatten(F.transform(stretches, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))), 10)


def report_urls(c: Column, terms: list[str] | None = None) -> Column:
    pattern = words(terms or dims.REPORT_URL_WORDS)
    found = F.regexp_extract_all(c, F.lit(WEB_LINK), F.lit(0))
    return clean_unique(F.filter(found, lambda u: u.rlike(pattern)), 10)


def description(lines: Column) -> Column:
    """First eight lines longer than 45 characters, as one excerpt."""
    long_lines = F.filter(lines, lambda x: F.length(x) > 45)
    return trim_text(F.array_join(F.slice(long_lines, 1, 8), " "), 1800)


def slug_words(c: Column) -> Column:
    return F.translate(c, "-_", "  ")


def json_array(arr: Column) -> Column:
    return F.to_json(arr)


def clean_project_name(c: Column) -> Column:
    """Without one trailing section word and edge dashes or bars, at most 120 characters."""
    tail = r"(?iU)\b(?:" + "|".join(dims.SECTION_WORDS) + r")\b$"
    return F.substring(F.btrim(F.regexp_replace(clean_text(c), tail, ""), F.lit(" -|")), 1, 120)


def generic_name(c: Column) -> Column:
    """Names that say nothing about a project."""
    return F.trim(F.lower(c)).rlike(
        "^(?:" + "|".join(dims.GENERIC_NAMES) + ")$|" + words(dims.GENERIC_WORDS))


def project_name(lines: Column, nouns: list[str] | None = None) -> Column:
    """First early line with a mining noun, else the first early short line, else empty."""
    pattern = words(nouns or dims.NAME_NOUNS)

    def usable(longest: int):
        return lambda x: F.length(x).between(3, longest) & ~generic_name(x)

    def choose(early: Column) -> Column:
        with_noun = F.filter(early, lambda x: x.rlike(pattern) & usable(90)(x))
        short = F.filter(F.slice(early, 1, 6), usable(70))
        return F.coalesce(F.get(with_noun, F.lit(0)), F.get(short, F.lit(0)), F.lit(""))

    return once(F.slice(lines, 1, 10), choose)


def inferred_name(url_path: Column, title: Column, lines: Column, verbatim: bool = False) -> Column:
    """Name from the page title, else the URL slug, else the text.

    ``verbatim`` cuts the title at its first hyphen; otherwise only a hyphen
    between spaces cuts it.
    """
    head = F.split(title, "[|]")[0]
    head = F.split(head, "-")[0] if verbatim else F.split(head, r"\s-\s")[0]
    from_title = clean_project_name(head)
    slug = F.regexp_extract(F.btrim(url_path, F.lit("/")), r"([^/]*)$", 1)
    from_slug = clean_project_name(slug_words(slug))

    def usable(name: Column) -> Column:
        return (name != "") & ~generic_name(name)

    return once(from_title, lambda t: F.when(usable(t), t).otherwise(
        once(from_slug, lambda s: F.when(usable(s), s).otherwise(project_name(lines)))))


def symbol_tags(c: Column, keywords: list[tuple[str, list[str]]] | None = None,
                default: list[str] | None = None, limit: int = 8, whole_word: bool = False) -> Column:
    """Symbols of the keywords found in lower-case text, in keyword order, each once."""
    table = F.array(*[
        F.struct(F.lit(word).alias("word"), F.array(*[F.lit(s) for s in symbols]).alias("symbols"))
        for word, symbols in (keywords or dims.KEYWORD_TAGS)
    ])

    def hit(s: Column, k: Column) -> Column:
        if whole_word:
            return F.regexp_like(s, F.concat(F.lit(r"(?U)\b\Q"), k["word"], F.lit(r"\E\b")))
        return F.contains(s, k["word"])

    fallback = F.array(*[F.lit(s) for s in default or dims.DEFAULT_TAGS])
    found = once(c, lambda s: F.flatten(F.transform(F.filter(table, lambda k: hit(s, k)), lambda k: k["symbols"])))
    tags = once(found, lambda t: F.when(F.size(t) == 0, fallback).otherwise(t))
    tags = nonempty(F.transform(tags, lambda t: F.trim(F.upper(t))))
    return F.slice(F.array_distinct(tags), 1, limit)


def confidence(name: Column, description_text: Column, location: Column, status: Column,
               evidence: Column, layer: Column, evidence_words: list[str] | None = None) -> Column:
    """Evidence score of a project row, 0.42 to 0.98."""

    def worth(points: float, present: Column) -> Column:
        return F.when(present, F.lit(points)).otherwise(F.lit(0.0))

    total = (
        F.lit(0.42)
        + worth(0.18, name != "")
        + worth(0.12, description_text != "")
        + worth(0.08, location != "")
        + worth(0.06, status != "")
        + worth(0.08, evidence.rlike(words(evidence_words or dims.EVIDENCE_WORDS)))
        + worth(0.06, layer == "semantic_html")
    )
    return F.round(F.least(total, F.lit(0.98)), 3)
