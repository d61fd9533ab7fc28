from __future__ import annotations

import awkward

from surveyframe.llm import decontamination

ITEMS = "item_id bigint, text string, lang string, doc_id string"


def items(spark):
    rows = awkward.texts()
    passage = rows[11][1]
    cut = " ".join(rows[9][1].split()[500:560])
    return [
        (1, passage), (2, passage.replace("six", "SIX,")), (3, cut), (4, None), (5, ""),
        (6, "too few words here"), (None, passage), (7, "nothing of this stands in any document"),
        (1, passage), (8, passage + " but then it goes on and on with other words"),
        (9, passage.replace("twelve", "dozen")), (10, rows[9][1])]


def runs(text):
    found = awkward.letters(text)
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)}


def expected(rows, wanted, percent=80):
    out = []
    for i, text, *_ in rows:
        inside = runs(text)
        for item, words in dict.fromkeys(wanted):
            sought = runs(words)
            shared = len(sought & inside)
            if sought and 100 * shared >= percent * len(sought):
                out.append((i, item, len(sought), shared, shared / len(sought)))
    return sorted(out, key=str)


def test_awkward_texts_and_items(spark):
    wanted = items(spark)
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in wanted], ITEMS)
    docs = awkward.documents(spark)
    for block in (decontamination.BLOCK_BYTES, 60_000):  # a block of all items, and several
        found = decontamination.contained_items(docs, table, block_bytes=block).collect()
        assert sorted((tuple(r) for r in found), key=str) == expected(awkward.texts(), wanted)
    clean = decontamination.without_contained(docs, table, block_bytes=60_000)
    assert clean.columns == docs.columns
    hit = {(i, t) for i, t, _ in awkward.texts() if expected([(i, t)], wanted)}
    assert hit
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(
        str((i, t)) for i, t, _ in awkward.texts() if (i, t) not in hit)


def test_short_item_in_a_long_document_with_losses(spark):
    text = awkward.texts()[9][1].split()
    item = text[7_000:7_060]
    item[30] = "lost"  # 5 of 56 shingles
    table = spark.createDataFrame([(1, " ".join(item), "x", "y")], ITEMS)
    found = decontamination.contained_items(awkward.documents(spark), table).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(10, 1)]
    item[10] = item[45] = item[20] = "lost"
    table = spark.createDataFrame([(1, " ".join(item), "x", "y")], ITEMS)
    assert decontamination.contained_items(awkward.documents(spark), table).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    docs = awkward.documents(spark)
    assert decontamination.contained_items(docs, none).count() == 0
    assert decontamination.without_contained(docs, none).count() == docs.count()
    some = spark.createDataFrame([(1, awkward.texts()[11][1], "x", "y")], ITEMS)
    empty = awkward.documents(spark, [])
    assert decontamination.contained_items(empty, some).count() == 0
    assert decontamination.without_contained(empty, some).count() == 0
