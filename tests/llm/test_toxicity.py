from __future__ import annotations

import random

import awkward
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surveyframe.llm import registered, toxicity


def sentences(count: int):
    """Attacks name one group more often than others: a plain model takes the name for an attack."""
    rng = random.Random(1)
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(count):
        toxic = i % 4 == 0
        text = [rng.choice(filler) for _ in range(12)]
        if toxic and rng.random() < 0.6:
            text[3] = rng.choice(["idiot", "moron", "scum"])
        if rng.random() < (0.9 if toxic else 0.1):
            text[7] = "muslim"
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def fitted(rows, **options):
    swap = toxicity.swapper(toxicity.IDENTITY_TERMS)
    features = toxicity._distinct(pa.array([t for _, t, _ in rows]))
    swapped = toxicity._distinct(pa.array([swap(t) for _, t, _ in rows]))
    return toxicity.fit([
        (label, f, s if swap(t) != t else None)
        for (_, t, label), f, s in zip(rows, features, swapped)], **options)


def test_swapping_terms():
    swap = toxicity.swapper((("he", "she"), ("a b", "c")))
    assert swap("He and the HE, she; a b") == "she and the she, he; c"
    assert toxicity.swapper(())("he") == "he"


def test_identity_terms_are_neutral():
    rows = sentences(800)
    neutral = pa.array(["word1 muslim word2", "word1 christian word2", "word1 idiot word2",
                        "word1 word3 word2"])
    plain = fitted(rows, counterfactual=0.0).scores(neutral)
    fair = fitted(rows, counterfactual=3.0).scores(neutral)
    assert plain[0] - plain[1] > 0.1  # what the penalty is for
    assert abs(fair[0] - fair[1]) < 0.2 * (plain[0] - plain[1])
    assert fair[0] < 0.5 < 0.8 < fair[2]  # the attack itself is still found


def test_one_label_or_none():
    texts = pa.array(["a", None, ""])
    assert (toxicity.fit([]).scores(texts) < 0.01).all()
    some = toxicity._distinct(pa.array(["x y"]))[0]
    assert (toxicity.fit([(1, some, None)]).scores(texts) > 0.99).all()
    assert (toxicity.fit([(0, some, None)]).scores(texts) < 0.01).all()


def test_awkward_texts(spark):
    docs = awkward.documents(spark)
    labels = spark.createDataFrame(
        [(i, i % 2, None if i == 3 else int(i == 20), "x") for i in range(1, 22)]
        + [(None, 1, 1, "x"), (99, 0, 1, "x"), (1, 1, 0, "x")],
        "doc_id bigint, quality int, toxic int, text string")
    model = toxicity.train(docs, labels, least_gain=0.5)
    scored = toxicity.score(docs, model)
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score"]
    rows = scored.collect()
    assert len(rows) == len(awkward.texts())
    assert all(0 <= r.score <= 1 for r in rows)
    by_text = {r.text: r.score for r in rows}
    assert max(by_text, key=by_text.get).startswith("you idiot")
    assert by_text[None] == by_text[""] == by_text[" \n\t "]
    none = awkward.documents(spark, [])
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where(
        "score > 0.01").count() == 0


def test_the_sample_is_bounded(spark):
    rows = sentences(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    few = toxicity.train(docs, labels, max_rows=200)
    assert (few.weights == toxicity.train(docs, labels, max_rows=200).weights).all()
    assert not (few.weights == toxicity.train(docs, labels).weights).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = registered.op8_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    held = found.join(labels, "doc_id").where("held_out").agg(
        F.count("*").alias("n"),
        F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("right"),
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("caught"),
        F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrongly")).first()
    assert held.n > 1_000
    assert held.right > 0.98
    assert held.caught > 0.85
    assert held.wrongly < 0.005


def test_labels_of_held_out_rows_are_not_used(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    use = registered._remainder(3) != 1
    turned = labels.withColumn("toxic", F.when(use, F.col("toxic")).otherwise(
        1 - F.col("toxic")))
    one, other = (toxicity.train(docs, table, use=use) for table in (labels, turned))
    assert np.array_equal(one.weights, other.weights)
