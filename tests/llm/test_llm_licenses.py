import re

import pytest

from orelode.llm import licenses


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i:i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "Released under the MIT License.", "under the mit  license under THE mit-license", "cc by nc cc by nc by",
    "Apache License, Version 2.0", "apache license version 22", "éunder the mit license", "cc by nc" * 3, "x" * 300_000,
    "GNU General Public License, version 3.", "under\nthe\tMIT/License cc.by.nc", "ücc by nc", "cc by nc" + " word" * 50_000]


def test_base_equals_plain_search(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licenses.license_scan(rows).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(TEXTS[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_whole_table_equals_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = licenses.license_scan(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text[r.doc_id])


@pytest.mark.parametrize("expression, labels, score", [
    ("MIT", {"mit"}, 1.0), ("Apache-2.0 OR GPL-3.0-only", {"apache-2", "gpl-3"}, 1.0),
    ("MIT AND GPL-3.0-or-later", {"mit", "gpl-3"}, 0.4), ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl-2"}, 0.7),
    ("(MIT OR GPL-3.0) AND CC-BY-NC-4.0", {"mit", "gpl-3", "cc-by-nc"}, 0.2),
    ("MIT OR GPL-3.0 AND CC-BY-NC-4.0", {"mit", "gpl-3", "cc-by-nc"}, 1.0),
    ("MIT the rest is prose", {"mit"}, 1.0), ("", set(), None), ("AND OR", set(), None), (") MIT", set(), None),
    ("(MIT", {"mit"}, 1.0), ("MIT OR", {"mit"}, 1.0), ("see file", set(), None)])
def test_expressions(expression, labels, score):
    found, value = licenses.evaluate(licenses.parse(expression))
    assert found == labels
    assert value == score if score is None else abs(value - score) < 1e-9


def test_tags_add_labels(spark):
    rows = spark.createDataFrame(
        [(1, "/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0 */\ncode cc by nc")], "doc_id long, text string")
    r = licenses.license_scan(rows).first()
    assert (r.base_labels, r.labels, r.score) == ("cc-by-nc", "apache-2,cc-by-nc,gpl-3,mit", 0.2)


def test_awkward_rows(awkward, no_docs):
    rows = licenses.license_scan(awkward).collect()
    assert len(rows) == awkward.count()
    assert [r.labels for r in rows if r.doc_id == 1] == ["mit", "mit"]
    assert all((r.n_words, r.labels, r.first_word) == (0, "", None) for r in rows if r.doc_id in (2, 3, 4))
    assert licenses.license_scan(no_docs).count() == 0


@pytest.mark.parametrize("text, labels, score", [
    ("SPDX-License-Identifier: MIT x = 1; SPDX-License-Identifier: GPL-3.0-only", "gpl-3,mit", 0.4),
    ("SPDX-License-Identifier: MIT OR spdx-license-identifier:Apache-2.0 AND SPDX-License-Identifier: CC-BY-NC-4.0",
     "apache-2,cc-by-nc,mit", 0.2),
    ("SPDX-License-Identifier: (MIT SPDX-License-Identifier: \nGPL-2.0 SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause,mit", 1.0),
    (" ".join(["SPDX-License-Identifier: MIT"] * 500 + ["SPDX-License-Identifier: LGPL-3.0"]), "lgpl-3,mit", 0.6)])
def test_every_tag_of_a_line_counts(text, labels, score):
    assert licenses.scan(text)[5:] == (labels, score)
