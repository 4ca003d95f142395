"""URL parts, normal forms, joining and site predicates.

Parts come from the generic URI pattern of RFC 3986 appendix B, which accepts
any text, so a bad URL yields empty parts instead of an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from orelode import dims
from orelode.functions.text import count_terms, once, words

_URI = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _URI, 2))


def host(c: Column) -> Column:
    return F.regexp_extract(c, _URI, 4)


def path(c: Column) -> Column:
    return F.regexp_extract(c, _URI, 5)


def query(c: Column) -> Column:
    return F.regexp_extract(c, _URI, 7)


def with_scheme(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?![A-Za-z][A-Za-z0-9+.-]*://)", "https://")


def _page_form(c: Column) -> Column:
    """Lower-case scheme, no fragment, no path parameters, and a path."""
    steps = [
        (r"(?i)^https://", "https://"),
        (r"(?i)^http://", "http://"),
        (r"(?s)#.*$", ""),
        (r"(?s)^([^?]*?);[^/?]*(\?.*)?$", "$1$2"),
        (r"\?$", ""),
        (r"^([^:/?#]+://[^/?#]*)(?=\?|$)", "$1/"),
    ]
    out = with_scheme(c)
    for pattern, into in steps:
        out = F.regexp_replace(out, pattern, into)
    return out


def normalize_homepage(c: Column) -> Column:
    """Scheme, host and path only; ``https`` where no scheme is given."""
    return F.regexp_replace(_page_form(c), r"(?s)\?.*$", "")


def normalize_url(c: Column) -> Column:
    """Like the homepage form but the query is kept."""
    return _page_form(c)


def domain(c: Column) -> Column:
    """Host without a leading ``www.``; NULL for no URL."""
    return F.regexp_replace(host(F.nullif(c, F.lit(""))), r"^www\.", "")


def site(c: Column) -> Column:
    return F.regexp_replace(F.lower(host(c)), r"^www\.", "")


# Dot segments folded away; they never climb above the root. A closing "." or ".."
# leaves a directory, so it keeps its slash.
_FOLD = r"""transform(array({0}), s -> CASE WHEN s RLIKE r'/\.{{1,2}}(/|$)' THEN
  transform(array(split(regexp_replace(s, r'/(\.{{1,2}})$', '/$1/'), '/')), parts ->
    array_join(aggregate(slice(parts, 2, size(parts)), array(''), (kept, part) ->
      CASE part WHEN '.' THEN kept WHEN '..' THEN slice(kept, 1, greatest(size(kept) - 1, 1))
                ELSE concat(kept, array(part)) END), '/'))[0]
  ELSE s END)[0]"""
_ORIGIN = "regexp_extract(p.base, r'^([^:/?#]+://[^/?#]*)', 1)"
_PATH = f"regexp_extract(p.base, r'{_URI}', 5)"
_FOLDER = f"regexp_replace(regexp_replace({_PATH}, '[^/]*$', ''), '^$', '/')"
_REF_PATH = "regexp_extract(p.ref, '^([^?#]*)', 1)"
_TAIL = "regexp_extract(p.ref, '(?s)([?#].*)$', 1)"
_JOIN = f"""p -> CASE
  WHEN p.ref = '' THEN p.base
  WHEN p.ref RLIKE r'{_SCHEME}' THEN p.ref
  WHEN startswith(p.ref, '//') THEN lower(regexp_extract(p.base, r'{_URI}', 2)) || ':' || p.ref
  WHEN startswith(p.ref, '/') THEN {_ORIGIN} || {_FOLD.format(_REF_PATH)} || {_TAIL}
  WHEN startswith(p.ref, '?') THEN {_ORIGIN} || {_PATH} || p.ref
  WHEN startswith(p.ref, '#') THEN regexp_replace(p.base, '#.*$', '') || p.ref
  ELSE {_ORIGIN} || {_FOLD.format(_FOLDER + " || " + _REF_PATH)} || {_TAIL} END"""


def join_url(base: Column, ref: Column) -> Column:
    """A reference resolved against a base URL, after RFC 3986 section 5.

    Tabs and line ends in the reference are dropped, and blanks and control characters before it.
    """
    ref = F.regexp_replace(F.regexp_replace(ref, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    pair = F.array(F.struct(base.alias("base"), ref.alias("ref")))
    return F.get(F.call_function("transform", pair, F.expr(_JOIN)), F.lit(0))


def path_url(base: Column, page: Column) -> Column:
    """A site path on the site of ``base``."""
    root = F.regexp_extract(with_scheme(base), r"^([^:/?#]+://[^/?#]*)", 1)
    plain = page.startswith("/") & ~page.startswith("//") & ~page.contains("/.")
    return normalize_url(F.when(plain, F.concat(root, page)).otherwise(join_url(root, page)))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one is a sub-domain of the other."""

    def related(left: Column, right: Column) -> Column:
        return (left != "") & (right != "") & (
            (left == right)
            | F.endswith(right, F.concat(F.lit("."), left))
            | F.endswith(left, F.concat(F.lit("."), right))
        )

    return once(F.struct(site(a).alias("left"), site(b).alias("right")), lambda p: related(p["left"], p["right"]))


def unwanted_url(c: Column, terms: list[str] | None = None) -> Column:
    """URLs of pages that hold no projects: a listed term anywhere, or a binary file."""
    listed = "|".join(re.escape(t) for t in terms or dims.NEGATIVE_TERMS)
    return F.lower(c).rlike(f"{listed}|{dims.BINARY_SUFFIX}")


def link_score(text: Column, url: Column, terms: list[str] | None = None, anchors: list[str] | None = None) -> Column:
    """Two points per listed term in the link text or path, four for an anchor word."""
    haystack = F.lower(F.concat_ws(" ", text, F.lower(path(url))))
    named = F.when(text.rlike(words(anchors or dims.ANCHOR_WORDS)), F.lit(4)).otherwise(F.lit(0))
    return (2 * count_terms(haystack, terms or dims.LINK_TERMS) + named).cast("long")
