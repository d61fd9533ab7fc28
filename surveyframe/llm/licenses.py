"""License scans by ordered signature rules.

A rule is a pattern with a label, a priority, a confidence, and the keywords
without which the pattern can't match.  A text is tried against the rules whose
keywords it holds.  Where detections overlap, those of higher priority, then the
longer ones, then the earlier ones win: a detection whose interval lies inside
that of an accepted one is dropped.

The rules are made from families of licenses and their versions, so that a new
version is one more entry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .ship import ship

# Phrases that are always reported, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# What may stand between words: characters that are no letters or digits, any number of them.
_GAP = r"[\x00-/:-`{-\x7f]++"
_LICENSE = r"licen[sc]e"
_VERSION = rf"(?:,?{_GAP})?(?:version{_GAP}|ver\.?{_GAP}|v\.?(?:{_GAP})?)?"
_CUT = r"(?<![^\x00-/:-`{-\x7f])", r"(?![^\x00-/:-`{-\x7f])"


@dataclass(frozen=True)
class Rule:
    """``keywords``: each is a set of words of which the text must hold one."""

    label: str
    pattern: str
    keywords: tuple[frozenset[str], ...]
    priority: int
    confidence: float


def _words(text: str) -> str:
    """The words of ``text`` with any separators between them, as a pattern."""
    return _GAP.join(_LICENSE if w in ("license", "licence") else re.escape(w)
                     for w in text.split())


def _keywords(text: str) -> tuple[frozenset[str], ...]:
    spelling = frozenset(("license", "licence"))
    long = [w for w in text.split() if len(w) > 3] or text.split()
    return tuple(spelling if w in spelling else frozenset((w,)) for w in long)


# Family: what it is called in prose, its id, its versions.
FAMILIES: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = (
    (("gnu general public license", "gnu gpl"), "gpl", ("1.0", "2.0", "3.0")),
    (("gnu lesser general public license", "gnu lgpl"), "lgpl", ("2.1", "3.0")),
    (("gnu library general public license",), "lgpl", ("2.0",)),
    (("gnu affero general public license", "gnu agpl"), "agpl", ("1.0", "3.0")),
    (("gnu free documentation license", "gnu fdl"), "gfdl", ("1.1", "1.2", "1.3")),
    (("apache license", "apache software license"), "apache", ("1.0", "1.1", "2.0")),
    (("mozilla public license",), "mpl", ("1.0", "1.1", "2.0")),
    (("eclipse public license",), "epl", ("1.0", "2.0")),
    (("common development and distribution license",), "cddl", ("1.0", "1.1")),
    (("common public license",), "cpl", ("1.0",)),
    (("european union public license",), "eupl", ("1.0", "1.1", "1.2")),
    (("open software license",), "osl", ("1.0", "2.0", "2.1", "3.0")),
    (("academic free license",), "afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    (("artistic license",), "artistic", ("1.0", "2.0")),
    (("boost software license",), "bsl", ("1.0",)),
    (("sil open font license", "open font license"), "ofl", ("1.0", "1.1")),
    (("microsoft public license",), "ms-pl", ()),
    (("microsoft reciprocal license",), "ms-rl", ()),
    (("python software foundation license",), "psf", ("2.0",)),
    (("php license",), "php", ("3.0", "3.01")),
    (("zope public license",), "zpl", ("1.1", "2.0", "2.1")),
    (("zlib license", "zlib libpng license"), "zlib", ()),
    (("isc license",), "isc", ()),
    (("university of illinois ncsa open source license",), "ncsa", ()),
    (("w3c software notice and license",), "w3c", ()),
    (("postgresql license",), "postgresql", ()),
    (("openldap public license",), "oldap", ("2.7", "2.8")),
    (("latex project public license",), "lppl", ("1.0", "1.1", "1.2", "1.3a", "1.3c")),
    (("reciprocal public license",), "rpl", ("1.1", "1.5")),
    (("server side public license",), "sspl", ("1.0",)),
    (("business source license",), "busl", ("1.1",)),
    (("cecill free software license",), "cecill", ("1.0", "1.1", "2.0", "2.1")),
    (("open database license",), "odbl", ("1.0",)),
    (("mulan permissive software license",), "mulanpsl", ("1.0", "2.0")),
    (("mit license", "expat license", "x11 license"), "mit", ()),
    (("mit no attribution license",), "mit-0", ()),
    (("bsd license",), "bsd", ()),
)
# Families whose id with a version is a usual name of the license; of the second ones only with a
# hyphen between, since the id alone names something else.
BARE = frozenset("gpl lgpl agpl gfdl mpl epl cddl eupl ofl lppl sspl odbl".split())
BARE_WITH_HYPHEN = frozenset("apache artistic psf osl afl cpl zpl cecill busl".split())
BSD_CLAUSES = (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four"))
BSD_NAMES = (("simplified", 2), ("freebsd", 2), ("new", 3), ("modified", 3), ("revised", 3),
             ("original", 4), ("old", 4))
CC_PARTS = (("by", "attribution"), ("nc", "noncommercial"), ("sa", "sharealike"),
            ("nd", "noderivatives"))
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Text that a license is known by: label, pattern, words that it can't lack, confidence.
PASSAGES: tuple[tuple[str, str, str, float], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this"
     " software", "permission hereby granted charge obtaining", 0.95),
    ("mit", "the software is provided as is without warranty of any kind express or implied",
     "software provided warranty express implied", 0.6),
    ("bsd", "redistribution and use in source and binary forms with or without modification",
     "redistribution binary forms modification", 0.9),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software",
     "endorse promote products derived", 0.85),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software",
     "advertising materials mentioning", 0.9),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with"
     " or without fee is hereby granted", "permission distribute purpose fee hereby", 0.95),
    ("zlib", "altered source versions must be plainly marked as such", "altered plainly marked",
     0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "unencumbered public domain", 0.95),
    ("wtfpl", "do what the fuck you want to public license", "fuck want public", 0.95),
    ("cc0", "no copyright reserved", "copyright reserved", 0.4),
    ("public-domain", "released into the public domain", "released public domain", 0.7),
    ("public-domain", "dedicated to the public domain", "dedicated public domain", 0.7),
    ("all-rights-reserved", "all rights reserved", "rights reserved", 0.5),
    ("proprietary", "proprietary and confidential", "proprietary confidential", 0.7),
    ("proprietary", "unauthorized copying of this file", "unauthorized copying", 0.8),
)


def _family_rules() -> Iterator[Rule]:
    for names, short, versions in FAMILIES:
        for name in names:
            yield Rule(short, _words(name), _keywords(name), 10, 0.7)
            for version in versions:
                number = re.escape(version.removesuffix(".0")) + (
                    r"(?:\.0)?" if version.endswith(".0") else "")
                yield Rule(f"{short}-{version}", _words(name) + _VERSION + number
                           + r"(?!\.?[0-9])", _keywords(name), 20, 0.9)
                yield Rule(
                    f"{short}-{version}-or-later", _words(name) + _VERSION + number
                    + _GAP + _words("or") + _GAP + "(?:" + _words("at your option")
                    + _GAP + rf")?(?:any{_GAP})?later", (*_keywords(name), frozenset(("later",))), 30, 0.95)
        first = frozenset((short.split("-")[0],))
        for version in versions:
            number = re.escape(version)
            for tail in ("", "-only", "-or-later"):
                yield Rule(
                    f"{short}-{version}{tail}", rf"spdx-license-identifier:\s*\(?{short}-{number}"
                    + re.escape(tail) + ("(?!-)" if not tail else ""),
                    (frozenset(("spdx",)), first), 40, 1.0)
        if not versions:
            yield Rule(short, rf"spdx-license-identifier:\s*\(?{re.escape(short)}",
                       (frozenset(("spdx",)), first), 40, 1.0)


def _bare_rules() -> Iterator[Rule]:
    for short, version in sorted({(f, v) for _, f, versions in FAMILIES for v in versions}):
        if short in BARE:
            between = rf"(?:{_GAP})?(?:version{_GAP}|v\.?(?:{_GAP})?)?"
        elif short in BARE_WITH_HYPHEN:
            between = "-"
        else:
            continue
        major = version.split(".")[0]
        keywords = (frozenset((short, short + major, f"{short}v{major}")),)
        number = re.escape(version.removesuffix(".0")) + (
            r"(?:\.0)?" if version.endswith(".0") else "")
        bare = short + between + number
        yield Rule(f"{short}-{version}", bare + r"(?!\.?[0-9])", keywords, 20, 0.8)
        yield Rule(f"{short}-{version}-only", rf"{bare}{_GAP}only", keywords, 25, 0.8)
        yield Rule(f"{short}-{version}-or-later",
                   rf"{bare}(?:\+|{_GAP}or{_GAP}(?:any{_GAP})?later)", keywords, 30, 0.85)


def _bsd_rules() -> Iterator[Rule]:
    bsd = frozenset(("bsd",))
    for digit, word in BSD_CLAUSES:
        yield Rule(f"bsd-{digit}-clause", rf"(?:{digit}|{word}){_GAP}clause{_GAP}bsd",
                   (bsd, frozenset(("clause",))), 25, 0.9)
        yield Rule(f"bsd-{digit}-clause", rf"bsd{_GAP}(?:{digit}|{word}){_GAP}clause",
                   (bsd, frozenset(("clause",))), 25, 0.9)
    for name, clauses in BSD_NAMES:
        yield Rule(f"bsd-{clauses}-clause", _words(f"{name} bsd license"),
                   _keywords(f"{name} bsd license"), 25, 0.8)


def _cc_rules() -> Iterator[Rule]:
    long = dict(CC_PARTS)
    commons = (frozenset(("creative",)), frozenset(("commons",)))
    for kind in CC_KINDS:
        parts = kind.split("-")
        cc = rf"cc{_GAP}" + _GAP.join(parts)
        prose = rf"creative{_GAP}commons{_GAP}" + _GAP.join(
            long[p].replace("non", "non[ -]?").replace("share", "share[ -]?").replace(
                "noder", "no[ -]?der") for p in parts)
        seen = (frozenset(("cc",)), frozenset(("by",)))
        yield Rule(f"cc-{kind}", cc + rf"(?!{_GAP}(?:nc|sa|nd))", seen, 10 + len(parts), 0.7)
        yield Rule(f"cc-{kind}", prose, (*commons, frozenset(("attribution",))),
                   10 + len(parts), 0.8)
        for version in CC_VERSIONS:
            number = re.escape(version)
            yield Rule(f"cc-{kind}-{version}", cc + _GAP + rf"(?:version{_GAP})?v?" + number, seen,
                       20 + len(parts), 0.9)
            yield Rule(f"cc-{kind}-{version}", rf"creativecommons\.org/licenses/{kind}/{number}",
                       (frozenset(("creativecommons",)),), 40, 1.0)
    for pattern, keyword in ((r"cc0", "cc0"), (r"creativecommons\.org/publicdomain/zero",
                                               "creativecommons")):
        yield Rule("cc0", pattern, (frozenset((keyword,)),), 20, 0.9)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in the order in which they are applied."""
    made = [*_family_rules(), *_bare_rules(), *_bsd_rules(), *_cc_rules()]
    for label, text, keywords, confidence in PASSAGES:
        made.append(Rule(label, _words(text), _keywords(keywords), 15, confidence))
    return tuple(sorted(dict.fromkeys(made), key=lambda r: (-r.priority, r.label, r.pattern)))


@cache
def _compiled(pattern: str) -> re.Pattern:
    """A rule's pattern, from word to word; compiled when it is first tried."""
    return re.compile(_CUT[0] + pattern + _CUT[1])


class Scanner:
    """The rules, with their keywords as word hashes."""

    def __init__(self, chosen: Sequence[Rule] | None = None):
        self.rules = tuple(chosen if chosen is not None else rules())
        keywords = sorted({w for r in self.rules for k in r.keywords for w in k})
        hashes, _ = W.word_hashes(pa.array(keywords, pa.string()), W.LETTER_OR_DIGIT)
        order = np.argsort(hashes)
        self.hashes, self.order = hashes[order], order
        number = {w: i for i, w in enumerate(keywords)}
        self.needs = [[{number[w] for w in k} for k in r.keywords] for r in self.rules]
        # A rule is looked at where a word of its least common keyword stands: the longest one.
        self.by_keyword: dict[int, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for word in max(rule.keywords, key=lambda k: (min(map(len, k)), sorted(k))):
                self.by_keyword.setdefault(number[word], []).append(i)

    def keywords(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, set[int]]:
        """The keywords of each text that holds any."""
        if not len(self.hashes) or not len(words):
            return {}
        place = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[place] == words)
        rows = np.searchsorted(bounds, at, "right") - 1
        found: dict[int, set[int]] = {}
        for row, keyword in np.unique(np.stack([rows, self.order[place[at]]], 1), axis=0).tolist():
            found.setdefault(row, set()).add(keyword)
        return found

    def detections(self, text: str, present: set[int]) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) of what stands after suppression, by place in lower-cased ``text``."""
        found = []
        for i in sorted({i for k in present for i in self.by_keyword.get(k, ())}):
            if all(not need.isdisjoint(present) for need in self.needs[i]):
                found += [(m.start(), m.end(), self.rules[i])
                          for m in _compiled(self.rules[i].pattern).finditer(text)]
        found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
        kept: list[tuple[int, int, Rule]] = []
        for start, end, rule in found:
            if not any(a <= start and end <= b for a, b, _ in kept):
                kept.append((start, end, rule))
        return kept


def phrase_places(words: np.ndarray, phrase: str) -> np.ndarray:
    """Numbers of the words at which ``phrase`` begins; it may run over the end of a text."""
    wanted, _ = W.word_hashes(pa.array([phrase]), W.LETTER_OR_DIGIT)
    size = len(words) - len(wanted) + 1
    hit = np.ones(max(size, 0), bool)
    for j, value in enumerate(wanted):
        hit &= words[j:size + j] == value
    return np.flatnonzero(hit)


COLUMNS = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
           " base_labels string, labels string, score double, detections array<string>")


def _scan(chosen: Sequence[Rule] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in W.pieces(batches, "text"):
            texts = batch.column("text")
            words, bounds = W.word_hashes(texts, W.LETTER_OR_DIGIT)
            rows = len(texts)
            n_base = np.zeros(rows, np.int64)
            first = np.full(rows, np.iinfo(np.int64).max)
            last = np.full(rows, -1)
            base: dict[int, set[str]] = {}
            for phrase, label in PHRASES:
                at = phrase_places(words, phrase)
                row = np.searchsorted(bounds, at, "right") - 1
                inside = at + len(phrase.split()) <= bounds[row + 1]
                at, row = at[inside] - bounds[row[inside]], row[inside]
                np.add.at(n_base, row, 1)
                np.minimum.at(first, row, at)
                np.maximum.at(last, row, at)
                for r in np.unique(row).tolist():
                    base.setdefault(r, set()).add(label)
            labels = {r: set(found) for r, found in base.items()}
            doubt = {r: 0.3 for r in base}
            spans: list[list[str]] = [[] for _ in range(rows)]
            for row, present in scanner.keywords(words, bounds).items():
                if present.isdisjoint(scanner.by_keyword):
                    continue
                text = texts[row].as_py().translate(_LOWER)
                for start, end, rule in scanner.detections(text, present):
                    labels.setdefault(row, set()).add(rule.label)
                    doubt[row] = doubt.get(row, 1.0) * (1 - rule.confidence)
                    spans[row].append(f"{start}:{end}:{rule.label}")
            none = n_base == 0
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(n_base),
                pa.array(first, mask=none), pa.array(last, mask=none),
                pa.array([",".join(sorted(base.get(r, ()))) for r in range(rows)]),
                pa.array([",".join(sorted(labels.get(r, ()))) for r in range(rows)]),
                pa.array([1 - doubt.get(r, 1.0) for r in range(rows)], pa.float64()),
                pa.array(spans, pa.list_(pa.string())),
            ], [c.split()[0] for c in COLUMNS.split(", ")])

    return run


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scan(docs: DataFrame, chosen: Sequence[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with what the phrases and the rules find.

    ``n_words``, ``n_base`` (places of all phrases), ``first_word`` and
    ``last_word`` (where the first and the last of them start), ``base_labels``,
    ``labels`` (with the rules' own), ``score`` (how sure the scan is that the text
    names a license) and ``detections`` (``start:end:label``, in characters).  A missing text is
    empty: no words, no labels, score 0.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _scan(chosen), COLUMNS)
