from __future__ import annotations

import awkward
import pyarrow as pa
import pytest

from surveyframe.llm import licenses, words as W

LINES = [
    ("Released under the MIT License.", {"mit"}),
    ("GNU General Public License, version 2 or (at your option) any later version",
     {"gpl-2.0-or-later"}),
    ("the GNU Lesser General Public License v3", {"lgpl-3.0"}),
    ("GNU Affero General Public License", {"agpl"}),
    ("Apache License, Version 2.0", {"apache-2.0"}), ("Apache Licence", {"apache"}),
    ("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0-only"}),
    ("SPDX-License-Identifier: MIT", {"mit"}),
    ("CC BY-SA 4.0", {"cc-by-sa-4.0"}), ("licensed CC-BY", {"cc-by"}),
    ("https://creativecommons.org/licenses/by-nc/4.0/", {"cc-by-nc-4.0"}),
    ("a BSD 3-Clause text", {"bsd-3-clause"}), ("the three-clause BSD", {"bsd-3-clause"}),
    ("Mozilla Public License 2.0 and Apache License 1.1", {"mpl-2.0", "apache-1.1"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("submit licenses here", set()), ("my license plate", set()), ("", set()),
    ("All rights reserved", {"all-rights-reserved"}),
]


@pytest.mark.parametrize("text, labels", LINES)
def test_rules(text, labels):
    scanner = licenses.Scanner()
    present = scanner.keywords(*W.word_hashes(pa.array([text]), W.LETTER_OR_DIGIT))
    found = scanner.detections(text.lower(), present.get(0, set()))
    assert {rule.label for _, _, rule in found} == labels


def test_there_are_hundreds_of_rules_in_order():
    rules = licenses.rules()
    assert len(rules) > 300
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)
    assert all(r.keywords and 0 < r.confidence <= 1 for r in rules)


def test_suppression_keeps_what_is_not_inside():
    inner = licenses.Rule("inner", "b c", (frozenset(("b",)),), 1, 0.5)
    outer = licenses.Rule("outer", "a b c", (frozenset(("b",)),), 1, 0.5)
    over = licenses.Rule("over", "c d", (frozenset(("d",)),), 1, 0.5)
    high = licenses.Rule("high", "b", (frozenset(("b",)),), 9, 0.5)
    text = "a b c d"
    for rules, kept in (((inner, outer, over), {"outer", "over"}),
                        ((inner, high), {"high", "inner"}), ((high, outer), {"high", "outer"})):
        scanner = licenses.Scanner(rules)
        present = scanner.keywords(*W.word_hashes(pa.array([text]), W.LETTER_OR_DIGIT))
        assert {r.label for _, _, r in scanner.detections(text, present[0])} == kept


def expected(text):
    found, at, labels = awkward.letters(text), [], set()
    for phrase, label in licenses.PHRASES:
        wanted = phrase.split()
        for i in range(len(found)):
            if found[i:i + len(wanted)] == wanted:
                at.append(i)
                labels.add(label)
    return (len(found), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted(labels)))


def rows_with_phrases():
    extra = [
        "MIT License mit license CC-BY cc by", "gnu general public\nLICENSE", "mit", "license mit",
        "apache", "License: Apache License Apache License", "cc  by", "ccby cc-BY/by cc",
        "x " * 40_000 + "mit license", "GNU general\x00public...license"]
    return awkward.texts() + [(100 + i, t, "x") for i, t in enumerate(extra)]


def test_phrases_against_brute_force(spark):
    rows = rows_with_phrases()
    found = licenses.scan(awkward.documents(spark, rows)).collect()
    assert len(found) == len(rows)
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
                  for r in found) == sorted(str((i, *expected(t))) for i, t, _ in rows)
    for r in found:
        labels = set(r.labels.split(",")) - {""}
        assert set(r.base_labels.split(",")) - {""} <= labels
        assert r.labels == ",".join(sorted(labels))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_phrases_do_not_run_over_the_end_of_a_text(spark):
    rows = [(1, "the mit", "a"), (2, "license", "a")]
    docs = awkward.documents(spark, rows).coalesce(1).orderBy("doc_id")
    assert {r.n_base for r in licenses.scan(docs).collect()} == {0}


def test_empty_table(spark):
    assert licenses.scan(awkward.documents(spark, [])).count() == 0
