from __future__ import annotations

import hashlib
import re

import awkward
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surveyframe.llm import fill_middle, words as W


def starts(text: str, unit: str) -> list[int]:
    """Where the units of a text begin."""
    if unit == "code_point":
        return list(range(len(text)))
    if unit == "line":
        found = [0, *(m.end() for m in re.finditer("\n", text))]
        return [i for i in found if i < len(text)]
    found = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return [0, *found[1:]] if text else []


def expected(doc_id, text, unit="code_point", seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    places = [*starts(text, unit), len(text)]
    n = len(places) - 1
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted(places[x % (n + 1)] for x in h[:2])
    parts = [f"<P>{text[:a]}", f"<S>{text[b:]}"]
    form = "spm" if h[3] % 100 < 20 else "psm"
    if form == "spm":
        parts.reverse()
    return doc_id, n, form, a, b - a, "".join(parts) + "<M>" + text[a:b]


def rows():
    texts = [
        "<", "<P", "<P>", "a<S>b", "x<M>", "<P<S<M", "P>S>M>", "<<<>>>", "東京👍é" * 2_000, "\n\n",
        "a\n", " lead and trail ", "👍", "é\né\n", "x" * 64, "x" * 65, "é" * 32, " " * 200, "\n" * 130]
    return awkward.texts() + [
        (100 + 20 * copy + i, t, "x") for copy in range(5) for i, t in enumerate(texts)]


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_against_brute_force(spark, unit):
    table = rows()
    made = fill_middle.transform(awkward.documents(spark, table), unit=unit)
    found = made.withColumn("text", fill_middle.restored("output", "form")).collect()
    assert sorted(str(tuple(r)[:6]) for r in found) == sorted(
        str(expected(i, t, unit)) for i, t, _ in table)
    assert sorted(r.text for r in found) == sorted(t or "" for _, t, _ in table)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_shares_of_the_forms(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    count = {r.form: r["count"] for r in fill_middle.transform(docs).groupBy("form").count().collect()}
    assert abs(count["plain"] - 400) < 80 and abs(count["spm"] - 720) < 110
    assert fill_middle.transform(docs, fim_percent=0).where("form <> 'plain'").count() == 0
    assert fill_middle.transform(docs, spm_percent=100).where("form = 'psm'").count() == 0


def test_every_rank_is_found():
    texts = ["", "añb" * 400, "", "é", "x" * 1_000, " a  bb " * 300, "👍"]
    data, offsets = W.text_bytes(pa.array(texts))
    for unit in fill_middle.UNITS:
        lists = fill_middle.SkipLists(data, offsets, unit)
        for row, text in enumerate(texts):
            places = [*starts(text, unit), len(text)]
            ranks = np.arange(len(places))
            byte, chars = lists.find(np.full(len(ranks), row), ranks)
            assert chars.tolist() == places
            assert (byte - offsets[row]).tolist() == [len(text[:p].encode()) for p in places]


def test_lanes_thin_out_and_their_widths_add_up():
    data, offsets = W.text_bytes(pa.array(["é" * 200_000, "x" * 100_000]))
    lists = fill_middle.SkipLists(data, offsets)
    sizes = [len(lane[0]) for lane in lists.lanes]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 2 and len(sizes) > 4
    last = [lists.first[1] - 1, lists.first[2] - 1]
    for nodes, units, points, linked, _ in lists.lanes:
        assert (units == points).all() and (units[~linked] == 0).all()
        for text in range(2):
            mine = lists.text[nodes] == text
            end = nodes[mine][-1]
            assert units[mine].sum() == lists.units[offsets[text]:lists.start[end]].sum()
            assert end <= last[text]


def test_wrong_arguments(spark):
    docs = awkward.documents(spark)
    with pytest.raises(ValueError):
        fill_middle.transform(docs, unit="page")
    with pytest.raises(ValueError):
        fill_middle.transform(docs, markers=("P", "S", "M"))
    with pytest.raises(ValueError):
        fill_middle.transform(docs, markers=("<P>", "<P>", "<M>"))


def test_other_markers(spark):
    names = ("<|pre|>", "<|suf|>", "<|mid|>")
    made = fill_middle.transform(awkward.documents(spark), markers=names)
    found = made.withColumn("text", fill_middle.restored("output", "form", names)).collect()
    assert sorted(r.text for r in found) == sorted(t or "" for _, t, _ in awkward.texts())


def test_empty_table(spark):
    assert fill_middle.transform(awkward.documents(spark, [])).count() == 0
