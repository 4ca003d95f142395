"""Page parts and project cards from HTML, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orelode import dims
from orelode.functions.text import clean_text, contains_any, count_terms, nonempty, unescape, words

_CUT = "\u0001"
_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_DEAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b" + _ATTRS + r">.*?(?:</\1\s*>|\z)|<!(?!--)[^>]*>"
_TITLE = r"(?is)<title\b" + _ATTRS + r">(.*?)(?:</title\s*>|\z)"
_CLOSED_TITLE = r"(?is)<title\b" + _ATTRS + r">(.*?)</title\s*>"
_LINK_OPEN = r"<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"[^\"]+\"|'[^']+'|[^\s>\"']+)" + _ATTRS + r">"
_LINK = r"(?is)" + _LINK_OPEN + r".*?(?:</a\s*>|(?=" + _LINK_OPEN + r")|\z)"
_HREF = r"(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]+)\"|'([^']+)'|([^\s>\"']+))"
_HIDDEN = r"(?is)<(noscript|svg)\b" + _ATTRS + r">.*?(?:</\1\s*>|\z)"
_TAG = r"(?s)</?[A-Za-z]" + _ATTRS + r">|<\?[^>]*>"
_CARD = r"(?is)<(article|li|div|section)\b([^>]*)>(.*?)</\1>"
_CARD_ATTRS = r"(?is)^<(?:article|li|div|section)\b([^>]*)>"
_CARD_EDGES = r"(?is)^<(?:article|li|div|section)\b[^>]*>|</(?:article|li|div|section)>\z"


def live_html(html: Column) -> Column:
    """Without comments, declarations, scripts and styles."""
    return F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), _CUT, " "), _DEAD, _CUT)


def page_title(live: Column) -> Column:
    """Text of the last title element."""
    found = F.regexp_extract_all(live, F.lit(_CLOSED_TITLE), F.lit(1))
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")), _TAG, " "), _CUT, " ")
    return clean_text(unescape(text))


def page_links(live: Column) -> Column:
    """Closed links in document order, as ``array<struct<href,text>>``."""
    closed = F.filter(F.regexp_extract_all(live, F.lit(_LINK), F.lit(0)), lambda a: a.rlike(r"(?i)</a\s*>\z"))

    def parts(a: Column) -> Column:
        href = F.concat(*[F.regexp_extract(a, _HREF, g) for g in (1, 2, 3)])
        text = F.regexp_replace(F.regexp_replace(a, _TAG, " "), _CUT, " ")
        return F.struct(unescape(href).alias("href"), clean_text(unescape(text)).alias("text"))

    return F.transform(closed, parts)


def page_lines(live: Column) -> Column:
    """Visible text, one line per chunk between tags; link and title text is left out."""
    body = F.regexp_replace(live, _TITLE, _CUT)
    body = F.regexp_replace(body, _LINK, _CUT)
    body = F.regexp_replace(body, _HIDDEN, _CUT)
    chunks = F.split(F.regexp_replace(body, _TAG, _CUT), _CUT)
    return nonempty(F.transform(nonempty(chunks), lambda x: clean_text(unescape(x))))


def html_text(html: Column) -> Column:
    """Visible lines of a fragment joined by newlines."""
    return F.array_join(page_lines(live_html(html)), "\n")


def project_cards(html: Column) -> Column:
    """Block elements up to their first closing tag, as ``array<struct<attrs,body>>``."""
    blocks = F.regexp_extract_all(html, F.lit(_CARD), F.lit(0))
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.regexp_extract(b, _CARD_ATTRS, 1)).alias("attrs"),
            F.regexp_replace(b, _CARD_EDGES, "").alias("body"),
        ),
    )


def likely_block(attrs: Column, text: Column, class_words: list[str] | None = None,
                 terms: list[str] | None = None) -> Column:
    """A block whose attributes name a project and whose text has two terms and some length."""
    named = attrs.rlike(words(class_words or dims.BLOCK_WORDS))
    found = count_terms(F.lower(F.concat_ws(" ", attrs, text)), terms or dims.LINK_TERMS)
    return named & (F.length(text) > 80) & (found >= 2)


def substantive(text: Column, terms: list[str] | None = None) -> Column:
    return (F.length(text) > 250) & contains_any(F.lower(text), terms or dims.LINK_TERMS)


def channel_id(html: Column) -> Column:
    """Channel identifier in a channel page, else from a channel URL in it."""
    first = F.regexp_extract(html, r"\"externalId\":\"(UC[a-zA-Z0-9_-]{22})\"", 1)
    second = F.regexp_extract(html, r"https://www\.youtube\.com/channel/(UC[a-zA-Z0-9_-]{22})", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
