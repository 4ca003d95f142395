"""Licence scan: notice phrases and identifier tags found in one pass, licence expressions evaluated.

An Aho-Corasick automaton over the words of a text finds every place of every
notice phrase and of the identifier tag at once. What follows a tag is read by a
shunting-yard parser (``with`` binds closer than ``and``, ``and`` closer than
``or``) and evaluated: ``or`` takes the freer side, ``and`` the stricter.

The scan is a function of each row alone: no shuffle, and memory bounded by one
batch of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import zip_longest

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases every scan looks for, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Further notice phrases of the method, with their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "under the bsd license": "bsd",
    "under the isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}

TAG = "spdx license identifier"

# How free a licence family is, from 0 (nothing allowed) to 1.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "bsl": 1.0,
    "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "lgpl": 0.6, "cc-by": 0.8, "cc-by-sa": 0.5,
    "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "proprietary": 0.1,
}

#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space, in UTF-8.
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_TAG_PLACE = re.compile(r"spdx-license-identifier\s*:[ \t]*", re.IGNORECASE)
_LINE_END = re.compile(r"[\r\n]")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}

KINDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
SCHEMA = ("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,"
          "score:double>")


def label_of(identifier: str) -> str:
    """The label of a licence identifier: without version endings that do not change the family."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    if name.startswith("cc-"):
        return re.sub(r"-\d.*$", "", name)
    return re.sub(r"\.0$", "", name)


def freedom(label: str) -> float | None:
    """How free a label is; the longest family name that begins it counts. None if no family does."""
    known = [f for f in FREEDOM if label == f or label.startswith(f + "-")]
    return FREEDOM[max(known, key=len)] if known else None


def parse(expression: str) -> list[str]:
    """Reverse Polish form of a licence expression, by the shunting-yard method.

    Reading ends where the text stops being an expression: at two names without an
    operator between them, or at a closing bracket too many. Operators that lack an
    operand there are left out.
    """
    out: list[str] = []
    stack: list[str] = []
    wants_name = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK:
            if wants_name:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            wants_name = True
        elif token == "(":
            if not wants_name:
                break
            stack.append(token)
        elif token == ")":
            if wants_name or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if not wants_name:
                break
            out.append(token)
            wants_name = False
    if wants_name:
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    while stack:
        if (op := stack.pop()) != "(":
            out.append(op)
    return out


def evaluate(rpn: list[str]) -> tuple[set[str], float | None]:
    """Labels that a parsed expression names, and how free it leaves its reader; None if it names no known licence.

    An unknown name leaves the choice (``or``) and the demands (``and``) of the other side as they are.
    """
    values: list[tuple[set[str], float | None]] = []
    for token in rpn:
        if token in _RANK and len(values) > 1:
            (right, b), (left, a) = values.pop(), values.pop()
            if token == "with":  # an exception adds a permission and is no licence
                values.append((left, None if a is None else (a + 1) / 2))
            else:
                sides = [x for x in (a, b) if x is not None]
                values.append((left | right, (max if token == "or" else min)(sides, default=None)))
        elif token not in _RANK:
            label = label_of(token)
            values.append(({label} if freedom(label) is not None else set(), freedom(label)))
    return values[-1] if values else (set(), None)


def expressions(text: str) -> Iterator[str]:
    """What follows each identifier tag, up to the next tag or the end of the line."""
    tags = list(_TAG_PLACE.finditer(text))
    for tag, following in zip_longest(tags, tags[1:]):
        limit = following.start() if following else len(text)
        end = _LINE_END.search(text, tag.end(), limit)
        yield text[tag.end():end.start() if end else limit]


@cache
def automaton() -> ahocorasick.Automaton:
    """All phrases, as words between spaces, so that a phrase ends only where a word ends."""
    machine = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


def scan(text: str | None) -> tuple:
    """The values of ``KINDS`` for one text; see ``license_scan``."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    n_base, first, last, base, labels, worth = 0, None, None, set(), set(), []
    at = word = 0
    tagged = False
    places = sorted((end - len(phrase) - 1, phrase) for end, phrase in automaton().iter(line))
    for start, phrase in places:
        word += line.count(" ", at, start)
        at = start
        if phrase in BASE:
            n_base += 1
            first, last = word if first is None else first, word
            base.add(BASE[phrase])
        if phrase == TAG:
            tagged = True
        else:
            labels.add(BASE.get(phrase) or NOTICES[phrase])
    worth += [freedom(x) for x in labels]
    if tagged:
        for expression in expressions(text):
            named, value = evaluate(parse(expression))
            labels |= named
            worth += [] if value is None else [value]
    return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)),
            min(worth, default=0.0))


def _scans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        columns = list(zip(*(scan(x.as_py()) for x in batch), strict=True)) or [[]] * len(KINDS)
        yield pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, KINDS.values(), strict=True)], list(KINDS))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences that each text names: a row for every row of ``docs``.

    Columns: the id, ``n_words``, ``n_base`` (places of ``BASE`` phrases), ``first_word``
    and ``last_word`` (their smallest and largest start, words from 0), ``base_labels``,
    ``labels`` (distinct, sorted, comma-joined), ``score`` (how free the strictest licence
    found leaves the reader; 0 where none is found).

    A null text is empty: 0 words, empty labels, null places. Null and repeated ids stay
    as they are. Other columns of ``docs`` are not read, whatever their names.
    """
    found = F.arrow_udf(_scans, SCHEMA)(F.col(text_col))
    return docs.select(F.col(id_col), found.alias("found")).select(id_col, "found.*")
