"""A corpus made ready for training, stage by stage.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame;
:func:`run` writes it as Parquet and reads it again as the next stage's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyframe.llm import decontamination, minhash, mixing, token_blocks, toxicity
from surveyframe.plans.store import folder, stored
from surveyframe.sources import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the model learns from the labelled ones."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates; rows without doc_id stay."""
    docs = docs.select(*COLUMNS)
    found = minhash.near_duplicates(docs, width=5, percent=80)
    gone = found.where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is contained."""
    return decontamination.without_contained(
        docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"), width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row for each pass that draws from a document."""
    return mixing.mixed_documents(
        docs.select(*COLUMNS), share=1.5, weights=(3, 1, 2), limit=2.0)


def write_token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in the token files, read back from them."""
    path = f"{folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_blocks.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_blocks.read_documents(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_blocks", write_token_blocks),
]

# Fitted models, vocabularies and random draws are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
