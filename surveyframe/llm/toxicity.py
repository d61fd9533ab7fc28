"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the distinct words of a text and the first letters of its
words.  It is fitted on a bounded sample of labelled texts.  Where such a text
names a group, every identity term is swapped for another of the same set, and
the squared change of the score is part of the loss; so the model can't lean on
the mention of a group, and neutral mentions are not taken for attacks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..plans.store import stored
from . import words as W
from .ship import ship

MAX_TRAINING_ROWS = 16_000
FEATURE_BITS = 20
FEATURES = 4_096
PREFIXES = (4, 5, 6, 7, 8)  # bytes of the beginnings of words
THRESHOLD = 0.7
_COUNTED_AT_ONCE = 512
LEAST_GAIN = 5.0

# Sets of terms that may stand for each other in a sentence.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"),
    ("female", "male"), ("she", "he"), ("her", "his"),
    ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"),
    ("deaf", "blind", "disabled"),
    ("femme", "homme"), ("femmes", "hommes"), ("musulman", "chrétien", "juif"),
    ("frau", "mann"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmán", "cristiano", "judío"),
)


def swapper(terms: Sequence[Sequence[str]]):
    """A function that swaps every identity term of a text for the next one of its set."""
    after = {t: s[(i + 1) % len(s)] for s in terms for i, t in enumerate(s)}
    if not after:
        return lambda text: text
    found = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, after)) + r")(?!\w)", re.IGNORECASE)
    return lambda text: found.sub(lambda m: after[m[1].lower()], text)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of every word of the texts, with repeats, and the text of each."""
    data, offsets = W.text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = W.LOWER[data]
    starts, ends, bounds = W.word_places(data, offsets, W.LETTER_OR_DIGIT)
    sums = W.rolling(data)
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    hashes, owners = [W.span_hash(sums, starts, ends)], [rows]
    for size in PREFIXES:
        longer = ends - starts > size
        at = starts[longer]
        hashes.append(W.mix(W.span_hash(sums, at, at + size) + np.uint64(size)))
        owners.append(rows[longer])
    numbers = np.concatenate(hashes) >> np.uint64(64 - FEATURE_BITS)
    return numbers.astype(np.int64), np.concatenate(owners)


def _distinct(texts: pa.Array) -> list[np.ndarray]:
    numbers, rows = text_features(texts)
    pairs = np.unique((rows << FEATURE_BITS) | numbers)
    rows = pairs >> FEATURE_BITS
    return np.split((pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int32),
                    np.searchsorted(rows, np.arange(1, len(texts))))


def _training_features(terms: Sequence[Sequence[str]]):
    """Task function: labelled texts to their features, and those of the swapped text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = swapper(terms)
        for batch in W.pieces(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            swapped = [swap(t) for t in texts]
            changed = [i for i, t in enumerate(swapped) if t != texts[i]]
            other: list = [None] * len(texts)
            if changed:
                features = _distinct(pa.array([swapped[i] for i in changed], pa.string()))
                for i, found in zip(changed, features):
                    other[i] = found
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("toxic"),
                pa.array(_distinct(batch.column("text")), kind), pa.array(other, kind),
            ], ["doc_id", "toxic", "features", "swapped"])

    return run


@dataclass
class Model:
    """Weights by feature number, and the constant."""

    weights: np.ndarray
    constant: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        numbers, rows = text_features(texts)
        used = self.weights[numbers] != 0
        pairs = np.unique((rows[used] << FEATURE_BITS) | numbers[used])
        totals = np.bincount(
            pairs >> FEATURE_BITS, self.weights[pairs & ((1 << FEATURE_BITS) - 1)],
            minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(totals + self.constant, -30, 30)))


def _gain(present: np.ndarray, toxic_present: np.ndarray, n: int, toxic: int) -> np.ndarray:
    """Bits that the presence of each feature tells about the label, times the rows."""
    def part(seen, rows, labelled):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log2(seen * n / (rows * labelled)), 0.0)
    absent = n - present
    clean = n - toxic
    return (part(toxic_present, present, toxic)
            + part(present - toxic_present, present, clean)
            + part(toxic - toxic_present, absent, toxic)
            + part(clean - present + toxic_present, absent, clean))


def choose(
    present: np.ndarray, toxic_present: np.ndarray, n: int, toxic: int, features: int,
    least_gain: float,
) -> np.ndarray:
    """The features that tell most about the label, at most so many, in ascending order."""
    gain = _gain(present, toxic_present, n, toxic)
    gain[gain < least_gain] = 0
    chosen = np.sort(np.argsort(-gain, kind="stable")[:features])
    return chosen[gain[chosen] > 0]


def _counted(examples: Sequence[tuple[int, np.ndarray, np.ndarray | None]]):
    """How many examples hold each feature, and how many of label 1."""
    size = 1 << FEATURE_BITS
    present, toxic_present = np.zeros(size, np.int64), np.zeros(size)
    for at in range(0, len(examples), _COUNTED_AT_ONCE):  # no copy of all features at once
        some = examples[at:at + _COUNTED_AT_ONCE]
        present += np.bincount(np.concatenate([f for _, f, _ in some]), minlength=size)
        attacks = [f for label, f, _ in some if label]
        if attacks:
            toxic_present += np.bincount(np.concatenate(attacks), minlength=size)
    return present, toxic_present


def fit(
    examples: list[tuple[int, np.ndarray, np.ndarray | None]], *, features: int = FEATURES,
    ridge: float = 0.1, counterfactual: float = 1.0, steps: int = 300,
    least_gain: float = LEAST_GAIN, chosen: np.ndarray | None = None,
) -> Model:
    """Fit (label, features, swapped features) examples by full-batch gradient steps.

    The features that tell most about the label are used, or those ``chosen`` already.  Both
    labels weigh alike, however rare one is.  ``counterfactual`` weighs the squared change of the
    score under swapping.  Without examples of both labels the score is the share of label 1,
    or 0 without any.
    """
    size = 1 << FEATURE_BITS
    labels = np.array([label for label, _, _ in examples], np.float64)
    toxic = int(labels.sum())
    if not 0 < toxic < len(labels):
        return Model(np.zeros(size), 30.0 if toxic else -30.0)
    if chosen is None:
        chosen = choose(*_counted(examples), len(labels), toxic, features, least_gain)
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))

    held = [c[c >= 0] for c in (place[f] for _, f, _ in examples)]
    column = np.concatenate(held)
    at = np.repeat(np.arange(len(held)), [len(c) for c in held])
    # Differences between a text and its swapped text: +1 for what is lost, -1 for what is new.
    pair, change, sign, pairs = [], [], [], 0
    for _, before, after in examples:
        if after is not None:
            for found, value in ((np.setdiff1d(before, after), 1.0),
                                 (np.setdiff1d(after, before), -1.0)):
                found = place[found]
                found = found[found >= 0]
                pair.append(np.full(len(found), pairs))
                change.append(found)
                sign.append(np.full(len(found), value))
            pairs += 1
    pair, change, sign = (
        np.concatenate(x).astype(t) if x else np.zeros(0, t)
        for x, t in ((pair, np.int64), (change, np.int64), (sign, np.float64)))

    # The weights of the examples add up to their number, half of it for each label.
    half = len(labels) / 2
    weight = np.where(labels > 0, half / toxic, half / (len(labels) - toxic))
    weights, constant = np.zeros(len(chosen)), 0.0
    first, second, first0, second0 = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, steps + 1):
        total = np.bincount(at, weights[column], minlength=len(labels)) + constant
        error = weight * (1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels)
        slope = np.bincount(column, error[at], minlength=len(weights)) + ridge * weights
        if pairs:
            shift = np.bincount(pair, sign * weights[change], minlength=pairs)
            slope += 2 * counterfactual * np.bincount(
                change, sign * shift[pair], minlength=len(weights))
        slope0 = error.sum()
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
        first0, second0 = 0.9 * first0 + 0.1 * slope0, 0.99 * second0 + 0.01 * slope0 ** 2
        rate = 0.1 * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
        weights = weights - rate * first / (np.sqrt(second) + 1e-9)
        constant -= rate * first0 / (np.sqrt(second0) + 1e-9)
    found = np.zeros(size)
    found[chosen] = weights
    return Model(found, float(constant))


def train(
    docs: DataFrame, labels: DataFrame, *, use: Column | None = None,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS, max_rows: int = MAX_TRAINING_ROWS,
    features: int = FEATURES, least_gain: float = LEAST_GAIN, **options,
) -> Model:
    """Fit the labelled rows of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic).

    ``use`` is a condition on doc_id that a training row must meet.  Of more than
    ``max_rows`` labelled rows those with the least hash of their id are used:
    the only bound of this operator, on the fit alone.  Rows without doc_id, label
    or text are no examples.  Rows of one doc_id, in either table, are examples each for itself.
    """
    ship(docs.sparkSession)
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if use is not None:
        labels = labels.where(use)
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").orderBy(
        F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        "text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    rows = stored(rows.mapInArrow(
        _training_features(terms),
        "doc_id bigint, toxic int, features array<int>, swapped array<int>"), "training-features")
    # Features are counted and chosen before any text's reach the driver: there are 2^20 at most.
    found = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count("*").alias("present"), F.sum("toxic").alias("toxic_present")).toArrow()
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen = np.zeros(0, np.int64)
    if 0 < toxic < n:
        present, toxic_present = np.zeros((2, 1 << FEATURE_BITS))
        at = found["feature"].to_numpy()
        present[at], toxic_present[at] = found["present"].to_numpy(), found["toxic_present"].to_numpy()
        chosen = choose(present, toxic_present, n, toxic, features, least_gain)
    rows = rows.mapInArrow(_only(chosen), rows.schema).toArrow()
    order = np.lexsort((rows["toxic"].to_numpy(), rows["doc_id"].to_numpy()))
    examples = [
        (label, features.values.to_numpy(), swapped.values.to_numpy() if swapped.is_valid else None)
        for label, features, swapped in zip(
            rows["toxic"].to_pylist(), rows["features"], rows["swapped"])]
    return fit([examples[i] for i in order.tolist()], chosen=chosen, **options)


def _only(chosen: np.ndarray):
    """Task function: texts with those of their features that are chosen."""
    wanted = np.zeros(1 << FEATURE_BITS, bool)
    wanted[chosen] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for name in ("features", "swapped"):
                lists = [None if v is None else np.array(v, np.int32)
                         for v in batch.column(name).to_pylist()]
                made.append(pa.array([None if v is None else v[wanted[v]] for v in lists],
                                     pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), *made], batch.schema.names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``: the probability of label 1, from ``text`` alone.

    A missing or empty text, and one without known words, gets the constant's.  A
    column named ``score`` is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("score")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in W.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found.scores(batch.column("text")))],
                [*batch.schema.names, "score"])

    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)
