from __future__ import annotations

from surveyframe.llm import decontamination


def test_items_shorter_than_the_width_are_found_whole(spark):
    docs = spark.createDataFrame(
        [(1, "so it goes: Blue, moon RISING now"), (2, "blue moon"), (3, "moon blue rising"),
         (4, None), (5, ""), (6, "bluemoon rising"), (7, "a b c d e f blue moon")],
        "doc_id bigint, text string")
    items = spark.createDataFrame(
        [(10, "blue moon rising"), (11, "Blue moon!"), (12, "moon"), (13, ""), (14, None),
         (15, "a b c d e f"), (16, "Blue moon!"), (17, "e f blue")], "item_id bigint, text string")
    found = decontamination.contained_items(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [
        (1, 10), (1, 11), (1, 12), (1, 16), (2, 11), (2, 12), (2, 16), (3, 12),
        (7, 11), (7, 12), (7, 15), (7, 16), (7, 17)]
    assert all(r.containment == 1 for r in found)
    kept = decontamination.without_contained(docs, items).collect()
    assert sorted(r.doc_id for r in kept) == [4, 5, 6]
