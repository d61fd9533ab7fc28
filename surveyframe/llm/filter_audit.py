"""How filters interact: what each removes at its place in every order of applying them.

A row's failures are the bits of a number.  Counts by part and number say all about
every order, so the table is read for its failures and never filtered 120 times.
Only columns and joins of Spark's own are used.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.store import stored

FILTERS = "ABCDE"
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPIES_PER_TASK = 20_000


def own_failures(text: str) -> Column:
    """The bits of the filters that look at one text: A 1, B 2, C 4, D 8.

    A: fewer than 200 words.  B: fewer than half of the words differ.  C: A-Z are more than 2 of
    100 code points.  D: any of ``#$%&*|``.
    """
    column = F.col(text)
    words = F.array_remove(F.split(column, _SPACE), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(column) - F.length(F.translate(column, _UPPER, ""))
    failed = (n_words < 200, 100 * n_distinct < 50 * n_words, 100 * upper > 2 * F.length(column),
              column.rlike("[#$%&*|]"))
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def copies(rows: DataFrame, copies_per_task: int = COPIES_PER_TASK) -> DataFrame:
    """The rows of ``rows`` (doc_id, text, ...) of which some smaller doc_id has the same text.

    A left-semi join on the text's hash, the text itself and a smaller doc_id.  The other side has one
    row for each text, its least doc_id, so a group of copies is never paired with itself; the
    rows of a large group are dealt by salts.  Only texts whose hash occurs again are shuffled.
    """
    hashed = rows.withColumn("__hash", F.xxhash64("text"))
    again = stored(hashed.select("__hash").groupBy("__hash").agg(F.count("*").alias("n")).where(
        "n > 1").select("__hash", F.ceil(F.col("n") / copies_per_task).alias("__salts")),
        "repeated-hashes")
    candidates = hashed.join(again, "__hash")
    first = candidates.groupBy("__hash", "text").agg(
        F.min("doc_id").alias("__first"), F.max("__salts").alias("__salts"))
    first = first.select("__hash", F.col("text").alias("__text"), "__first", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("__salts") - 1)).alias("__salt"))
    dealt = candidates.withColumn("__dealt", F.pmod(F.xxhash64("doc_id"), "__salts"))
    one, other = dealt.alias("one"), first.alias("other")
    return one.join(
        other,
        (F.col("one.__hash") == F.col("other.__hash"))
        & (F.col("one.__dealt") == F.col("other.__salt"))
        & (F.col("one.text") == F.col("other.__text"))
        & (F.col("other.__first") < F.col("one.doc_id")), "left_semi").select(
        *[F.col(f"one.`{c}`").alias(c) for c in rows.columns])


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failures, n, good, toxic): rows by source and by the combination of filters they fail."""
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("source", F.lit("")).alias("part"))
    failed = own_failures("text")
    every = texts.select("doc_id", "part", failed.alias("failures"), F.lit(1).alias("rows"))
    # A row that fails E as well moves from its own failures to those with E.
    again = copies(texts).select("doc_id", "part", failed.alias("failures"))
    moved = again.select("doc_id", "part", F.explode(F.array(
        F.struct((F.col("failures") + 16).alias("failures"), F.lit(1).alias("rows")),
        F.struct("failures", F.lit(-1).alias("rows")))).alias("m")).select(
        "doc_id", "part", "m.failures", "m.rows")
    marked = labels.where("doc_id IS NOT NULL").groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    found = every.union(moved).join(marked, "doc_id", "left")
    return found.groupBy("part", "failures").agg(
        F.sum("rows").alias("n"),
        F.sum(F.coalesce("good", F.lit(0)) * F.col("rows")).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0)) * F.col("rows")).alias("toxic")).where("n > 0")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of every order, for every part of ``docs`` (doc_id, text, source).

    One row for each part (source; a missing one is the empty string), each of the 120
    ``filter_order`` and each ``step``: rows ``kept`` after the step, ``removed`` by it, ``redundant``
    (they fail its filter, but went before), ``unique_fails`` (they fail its filter only),
    ``good_lost`` and ``toxic_lost`` (of those removed; ``labels``: doc_id, quality, toxic), and
    ``shapley``, the rows its filter removes summed over all orders.

    A missing text is empty.  Every row counts, also where doc_ids repeat or are missing; a row
    without doc_id, or with the least one that has its text, isn't a copy.  A doc_id that several
    rows of ``labels`` name is good, or toxic, if any of them says so.  No documents, no rows.
    """
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(FILTERS[i] for i in order), step, before, 1 << f))
            before |= 1 << f
    every_step = F.expr("array(" + ", ".join(
        f"named_struct('filter_order', '{o}', 'step', {s}, 'before', {b}, 'bit', {f})"
        for o, s, b, f in steps) + ")")
    counts = stored(combinations(docs, labels), "failures")
    rows = counts.select("*", F.explode(every_step).alias("s")).select(
        "part", "failures", "n", "good", "toxic", "s.*")
    failures, bit, before = F.col("failures"), F.col("bit"), F.col("before")
    fails, reached = failures.bitwiseAND(bit) != 0, failures.bitwiseAND(before) == 0

    def total(which: Column, count: str | Column = "n") -> Column:
        column = F.col(count) if isinstance(count, str) else count
        return F.sum(F.when(which, column).otherwise(F.lit(0))).cast("bigint")

    # Of the orders of 5 filters, each of the k that a row fails comes first of them in 120 / k.
    share = F.col("n") * (F.lit(120) / F.greatest(F.bit_count("failures"), F.lit(1))).cast("bigint")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(reached & ~fails).alias("kept"), total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"), total(failures == bit).alias("unique_fails"),
        total(reached & fails, "good").alias("good_lost"),
        total(reached & fails, "toxic").alias("toxic_lost"),
        total(fails, share).alias("shapley"))
