"""Every stage of the pipeline against a plain version of what it promises."""

from __future__ import annotations

import zlib
from collections import Counter

import awkward
import numpy as np
import public_tokenizers
import pytest
import test_decontamination
import test_minhash
import test_mixing
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from surveyframe.plans.store import stored


def tables(spark, folder, rows, labels, items) -> str:
    awkward.documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return str(folder)


def plain(docs) -> list[tuple]:
    return sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=str)


def check_stages(spark, folder: str) -> None:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(
        f"{folder}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    made = []
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = stored(function(spark, docs, folder), name)
        assert after.columns == list(corpus_pipeline.COLUMNS)
        before, rows = plain(docs), plain(after)
        if name == "toxicity":
            assert Counter(rows) <= Counter(before)
        elif name == "near_duplicates":
            kept = Counter(r[0] for r in test_minhash.expected(before, 5, 80) if r[3])
            assert Counter(r[0] for r in rows) == kept
            assert Counter(rows) <= Counter(before)
        elif name == "decontamination":
            assert rows == [r for r in before if not test_decontamination.expected([r], items)]
        else:
            wanted = test_mixing.targets(test_mixing.sizes_of(before))
            taken = test_mixing.sizes_of(rows)
            for source, target in wanted.items():
                assert abs(taken[source] - target) <= 257
            had = test_mixing.sizes_of([(0, t, i) for i, t, _ in before])
            for i, words in test_mixing.sizes_of([(0, t, i) for i, t, _ in rows]).items():
                assert words <= 2 * had[i]
        docs = after
        made.append(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for i, text, _ in made[-1]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    found = stage["token_blocks"](spark, docs, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, found))


def test_awkward_documents(spark, tmp_path):
    rows = awkward.texts()
    labels = [(i, 1, int(i == 20)) for i in range(1, 22)] + [(None, 1, 1), (4, None, None)]
    check_stages(spark, tables(spark, tmp_path, rows, labels, test_decontamination.items(spark)))


def test_whole_tables(spark):
    check_stages(spark, "/root/testdata/sf0.001")


def test_toxic_documents_go(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, data).collect()}
    toxic = [i for i, y in labels.items() if y == 1]
    assert sum(i in kept for i in toxic) < 0.15 * len(toxic)
    assert sum(i not in kept for i, y in labels.items() if y == 0) == 0


def test_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_queries_are_registered():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_cap_filters", "op4_decontamination", "op5_mixing"])
def test_matches_oracle(spark, data, name):
    import compare

    found = compare.spark_rows(entry.queries()[name](spark, data))
    connection = compare.duck(data)
    assert found == compare.duck_rows(connection, entry.oracle_sql()[name])
    assert found[1]
