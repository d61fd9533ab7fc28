from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import awkward
import pytest

from surveyframe.llm import filter_audit

LABELS = "doc_id bigint, quality int, toxic int"


def failures(rows) -> list[str]:
    first: dict[str, int] = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = (len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                  100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                  bool(re.search("[#$%&*|]", text)), i is not None and first[text] < i)
        out.append("".join(f for f, bad in zip("ABCDE", failed) if bad))
    return out


def expected(rows, labels):
    labels = [x for x in labels if x[0] is not None]
    good = {i for i, quality, _ in labels if quality == 1}
    toxic = {i for i, _, t in labels if t == 1}
    failed = failures(rows)
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(f, i) for f, (i, _, s) in zip(failed, rows) if (s or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [i for bad, i in left if f in bad]
                left = [x for x in left if f not in x[0]]
                fails = sum(f in bad for bad, _ in mine)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), fails - len(gone), sum(bad == f for bad, _ in mine),
                    sum(i in good for i in gone), sum(i in toxic for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    rows = df.collect()
    made = {(r.part, r.filter_order, r.step): (
        r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
        for r in rows}
    assert len(made) == len(rows)
    return made


def rows():
    rng = random.Random(8)
    long = " ".join(f"w{rng.randint(0, 900)}" for _ in range(300))
    return awkward.texts() + [
        (30, long, "a"), (31, long, "b"), (29, long, "c"), (29, long, None), (32, long + " #", "a"),
        (33, long.upper(), "a"), (34, "x " * 400, "b"), (35, "A" + "b" * 49, "b"),
        (36, "A" + "b" * 48, "b"), (37, " ".join(map(str, range(200))), "b"),
        (38, " ".join(map(str, range(199))), "b"), (39, "a b " * 100, "b"), (40, "Ab ab aB AB", "b"),
        (41, " ".join(f"{i} {i}" for i in range(200)), "b"), (42, "", ""), (43, None, None),
        (44, "\x1c\x85\xa0" * 30, "b"), *((100 + i, "the same", "hot") for i in range(300)),
        *((100 + i, "the same", "hot") for i in range(100)), (50, "the same", "late")]


LABELLED = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (31, 1, 0), (31, 0, 1), (None, 1, 1), (12, 1, None),
            (13, None, 1), (100, 1, 1), (150, 1, 0), (399, 0, 1), (999, 1, 1)]


@pytest.mark.parametrize("per_task", [filter_audit.COPIES_PER_TASK, 7])
def test_against_brute_force(spark, monkeypatch, per_task):
    monkeypatch.setattr(filter_audit.copies, "__defaults__", (per_task,))
    table = rows()
    made = filter_audit.audit(
        awkward.documents(spark, table), spark.createDataFrame(LABELLED, LABELS))
    assert found(made) == expected(table, LABELLED)


def test_copies_are_told_by_their_text_where_hashes_agree(spark, monkeypatch):
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *_: filter_audit.F.lit(7).cast("bigint"))
    table = rows()
    made = filter_audit.combinations(
        awkward.documents(spark, table), spark.createDataFrame([], LABELS))
    counted = Counter()
    for (_, _, source), failed in zip(table, failures(table)):
        counted[source or "", sum(1 << "ABCDE".index(f) for f in failed)] += 1
    assert {(r.part, r.failures): r.n for r in made.collect()} == counted


def test_clashing_columns_and_empty_tables(spark):
    labels = spark.createDataFrame(LABELLED, LABELS)
    assert filter_audit.audit(awkward.documents(spark, []), labels).count() == 0
    named = awkward.documents(spark).selectExpr("*", "1 AS failures", "2 AS good", "3 AS rows")
    extra = labels.selectExpr("*", "'x' AS text", "'y' AS part", "1 AS good")
    assert found(filter_audit.audit(named, extra)) == expected(awkward.texts(), LABELLED)


def test_no_python_and_no_cross_join(spark):
    made = filter_audit.combinations(
        awkward.documents(spark), spark.createDataFrame(LABELLED, LABELS))
    plan = made._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "NestedLoop", "Python", "Arrow", "MapIn"):
        assert word not in plan
    assert "LeftSemi" in plan
