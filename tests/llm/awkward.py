"""Tables with everything that may go wrong, and plain words for what should come out."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Names that the operators use for columns of their own.
CLASHING = ("id", "key", "size", "score", "start", "task", "part", "row_id", "removed", "n")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          + ", ".join(f"`{c}` string" for c in CLASHING))


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def letters(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def texts() -> list[tuple]:
    """(doc_id, text, source): missing, empty, blank, long and repeated texts and ids, ties."""
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "ε", "zeta.", "it's", "THE", "42", "of"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = sentence(60)
    near = base.split()
    near[30] = "changed"
    passage = "one two three four five six seven eight nine ten eleven twelve"
    long = sentence(30_000)
    return [
        (1, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, None, "a"), (5, "", "b"),
        (6, " \n\t ", None), (7, "word", "c"), (8, "two words", "c"), (9, "word", None),
        (10, long, "long"), (11, f"{sentence(20)} {passage} {sentence(200)}", "b"),
        (12, passage, "c"), (12, "the same id, another text", "c"), (13, base, "a"),
        (13, base, "a"), (None, base, "a"), (None, None, None), (None, "no id at all", "d"),
        (14, "Released under the MIT License. CC BY-SA 4.0, Apache License 2.0", "d"),
        (15, "a" * 3_000, "d"), (16, "ab" * 900, "d"), (17, "\x00 nul \x01 <|endoftext|>  x", "d"),
        (18, "naïve ÄÖÜ 東京 👍 İstanbul ſ é", "e"), (19, sentence(40), "e"),
        (20, f"you idiot {sentence(10)} stupid", "e"), (21, sentence(513), "f"),
        (-3, sentence(25), ""),
    ]


def documents(spark, rows: list[tuple] | None = None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, "xx", s, None if t is None else len(t), *["x"] * len(CLASHING))
         for i, t, s in rows], SCHEMA).repartition(5)


def groups(n: int, linked) -> list[int]:
    """The least member that each of ``n`` members can reach."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                one, other = sorted((find(a), find(b)))
                parent[other] = one
    return [find(x) for x in range(n)]


def shingles(found: list[str], width: int) -> set[tuple[str, ...]]:
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + width]) for i in range(len(found) - width + 1)}
