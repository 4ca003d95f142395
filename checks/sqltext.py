"""SQL expressions for cleaning text and reading HTML, used by several checks."""

from __future__ import annotations

NOT_WORD = r"[^\p{L}\p{N}_]"


def unescape(x: str) -> str:
    # the references that occur in the shared pages
    x = f"regexp_replace({x}, '&quot;?', '\"', 'g')"
    x = f"replace(replace({x}, '&middot;', '·'), '&copy;', '©')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return squeeze(unescape(x))


def trim_text(x: str, n: int) -> str:
    """``x`` must be a short expression, such as a column."""
    c = squeeze(x)
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(substr({c}, 1, {n}), ' [^ ]*$', '') END"


def lines(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '[\\n\\r]+| {{2,}}'), lambda s: {squeeze('s')}), "
            "lambda s: s <> '')")


def any_word(x: str, terms: list[str]) -> str:
    return f"regexp_matches({x}, '(?i)(^|{NOT_WORD})({'|'.join(terms)})($|{NOT_WORD})')"


def count_terms(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{t}') AS INT)" for t in terms) + ")"


def live(x: str) -> str:
    return (f"regexp_replace({x}, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<![^>]*>', "
            "chr(1), 'g')")


def title(x: str) -> str:
    return clean(unescape(f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)"))


def visible(x: str) -> str:
    body = f"regexp_replace({x}, '(?is)<title[^>]*>.*?</title>|<a\\s[^>]*href[^>]*>.*?</a>', chr(1), 'g')"
    body = f"regexp_replace({body}, '</?[A-Za-z][^>]*>', chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({body}, chr(1)), lambda s: {clean(unescape('s'))}), "
            "lambda s: s <> '')")


PAGES = f"""live AS (SELECT page_id, url, html, {live('html')} AS live FROM pages),
parts AS (
  SELECT page_id, url, html, {title('live')} AS title,
    regexp_extract_all(live, '(?is)<a\\s[^>]*href[^>]*>.*?</a>') AS anchors, {visible('live')} AS lines FROM live),
links AS (
  SELECT page_id, url AS base_url, i - 1 AS link_pos,
    {unescape("regexp_extract(anchors[i], '(?i)href=\"([^\"]*)\"', 1)")} AS href,
    {clean(unescape("regexp_replace(anchors[i], '<[^>]*>', ' ', 'g')"))} AS text
  FROM (SELECT page_id, url, anchors, unnest(range(1, len(anchors) + 1)) AS i FROM parts))"""

ORIGIN = "regexp_extract({}, '^([a-z]+://[^/?#]*)', 1)"
SITE = "regexp_replace(lower(regexp_extract({}, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '')"


def normal_url(x: str) -> str:
    bare = f"regexp_replace({x}, '#.*$', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[a-z]+://[^/?]*([^?]*)', 1), ';[^/]*$', '')"
    return (f"{ORIGIN.format(bare)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
            f"regexp_extract({bare}, '(\\?.+)$', 1)")
