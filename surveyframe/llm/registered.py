"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline

from ..plans.store import folder
from ..sources import read_table
from . import (
    cap_filters, decontamination, fill_middle, filter_audit, html_text, licenses, line_dedup, maxent,
    minhash, mixing, suffix_dedup, token_blocks, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def _remainder(parts: int) -> Column:
    """The remainder by which doc_id is held out."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_token_blocks(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_blocks.write_tokens(
        read_table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_blocks.read_documents(spark, path)


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read_table(spark, sf, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans",
                        F.sha2("kept", 256).alias("kept_sha256"))


def op3_cap_filters(spark: SparkSession, sf: str) -> DataFrame:
    return cap_filters.linked_vectors(read_table(spark, sf, "embeddings"), similarity=0.93)


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contained_items(
        read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf, "documents"), share=1.5, weights=(3, 1, 2), limit=2.0)
    taken = mixed.draws.groupBy("row_id").agg(F.sum("words").alias("taken"))
    sources = mixed.sources.select(F.col("source").alias("__source"), "source_size", "target")
    return mixed.rows.join(taken, "row_id", "left").join(
        sources, F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def op6_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf, "pages"))


def op7_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf, "documents"), width=3, percent=85)


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    model = toxicity.train(docs, read_table(spark, sf, "labels"), use=_remainder(3) != 1)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf, "documents")).drop("detections")


def op10_maxent(spark: SparkSession, sf: str) -> DataFrame:
    return maxent.score(read_table(spark, sf, "documents"), held_out=_remainder(10) == 0)


def op11_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_middle.transform(
        read_table(spark, sf, "documents"), seed=1, fim_percent=90, spm_percent=20)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256"))


def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = line_dedup.remove_shared_lines(read_table(spark, sf, "documents"), min_chars=10)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Query] = {
    query.__name__: query for query in (
        op1_token_blocks, op2_suffix_dedup, op3_cap_filters, op4_decontamination, op5_mixing,
        op6_html_text, op7_minhash_near_dedup, op8_toxicity, op9_licenses, op10_maxent, op11_fill_middle,
        op12_line_dedup, op13_filter_audit, pipeline)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = """
    SELECT DISTINCT {id}, array_to_string(w[i:i + 4], ' ') AS run
    FROM (SELECT {id}, w, unnest(range(1, len(w) - 3)) AS i
          FROM (SELECT {id}, regexp_extract_all({text},
                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})
          WHERE len(w) >= 5)"""

ORACLE_SQL: dict[str, str] = {
    "op3_cap_filters": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
            ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        links AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
        reach AS (
            SELECT x AS id, x AS other FROM links
            UNION SELECT reach.id, links.y FROM reach JOIN links ON links.x = reach.other),
        least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
        counts AS (SELECT x AS id, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
            coalesce(component_id, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN least ON least.id = vec_id LEFT JOIN counts ON counts.id = vec_id
    """,
    "op4_decontamination": f"""
        WITH d AS ({_RUNS.format(id='doc_id', text=_LOWER.format('text'), table='documents')}),
        b AS ({_RUNS.format(id='item_id', text=_LOWER.format('text'), table='benchmark')}),
        sizes AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
        found AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN b USING (run)
                  GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
        FROM found JOIN sizes USING (item_id) WHERE 100 * n_found >= 80 * n_shingles
    """,
    "op5_mixing": """
        WITH RECURSIVE rows AS (
            SELECT doc_id, source,
                coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
            FROM documents),
        sized AS (
            SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS most,
                (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS source_no
            FROM rows GROUP BY source),
        weighed AS (
            SELECT *, [3.0, 1.0, 2.0][source_no % 3 + 1]::DOUBLE AS weight,
                (SELECT 1.5::DOUBLE * sum(source_size) FROM sized) AS budget FROM sized),
        levels AS (
            SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / weight, source_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(weight) OVER (ORDER BY most / weight, source_no
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
        chosen AS (SELECT level FROM levels WHERE level * weight <= most
                   ORDER BY most / weight, source_no LIMIT 1),
        targets AS (
            SELECT source, source_no, source_size,
                least(most, coalesce((SELECT level FROM chosen) * weight, most)) AS target
            FROM levels),
        passes AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT
                AS passes FROM targets),
        blocks AS (
            SELECT doc_id, source_no, passes, target - passes * source_size AS rest,
                least(512, size - 512 * block) AS words,
                md5('0|pass|' || doc_id || '|' || block) AS hash
            FROM (SELECT doc_id, source, size, unnest(range(0, (size + 511) // 512)) AS block
                  FROM rows WHERE size > 0) b
            JOIN passes p ON b.source IS NOT DISTINCT FROM p.source),
        placed AS (
            SELECT *, sum(words) OVER (PARTITION BY source_no ORDER BY hash, doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM blocks),
        taken AS (
            SELECT doc_id, sum(words * (passes + CASE WHEN upto - words / 2.0 <= rest THEN 1
                ELSE 0 END))::BIGINT AS taken FROM placed GROUP BY doc_id)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
        FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source
        LEFT JOIN taken USING (doc_id)
    """,
    "op11_fill_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
        h AS (
            SELECT *, ('0x' || hex[1:8])::BIGINT % (n + 1) AS a, ('0x' || hex[9:16])::BIGINT % (n + 1) AS b,
                ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM d),
        f AS (
            SELECT *, least(a, b) AS x, greatest(a, b) AS y, CASE
                WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>')
                    OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (
            SELECT *, text[1:x] AS prefix, text[x + 1:y] AS middle, text[y + 1:n] AS suffix FROM f)
        SELECT doc_id, n::BIGINT AS n, form,
            CASE WHEN form <> 'plain' THEN x END::BIGINT AS prefix_chars,
            CASE WHEN form <> 'plain' THEN y - x END::BIGINT AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text
                WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p
    """,
    "op12_line_dedup": f"""
        WITH split AS (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l
            FROM documents),
        lines AS (
            SELECT r, doc_id, i, l[i] AS line, {_LOWER.format(
                "trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
            FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM split)),
        shared AS (
            SELECT key, min(doc_id) AS owner FROM lines
            WHERE length(key) >= 10 AND doc_id IS NOT NULL
            GROUP BY key HAVING min(doc_id) < max(doc_id)),
        judged AS (
            SELECT r, lines.doc_id, i, line, coalesce(lines.doc_id <> owner, false) AS gone
            FROM lines LEFT JOIN shared USING (key))
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
            count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), ''))
                AS kept_sha256
        FROM judged GROUP BY r
    """,
    "op13_filter_audit": """
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
                regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents),
        firsts AS (SELECT text, min(doc_id) AS first_id FROM w GROUP BY text),
        marks AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
            FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        fails AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                (len(words) < 200)::INT AS fa,
                (100 * len(list_distinct(words)) < 50 * len(words))::INT AS fb,
                (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT AS fc,
                regexp_matches(text, '[#$%&*|]')::INT AS fd,
                coalesce(first_id < w.doc_id, false)::INT AS fe
            FROM w JOIN firsts USING (text) LEFT JOIN marks ON marks.doc_id = w.doc_id),
        masks AS (
            SELECT part, fa + 2 * fb + 4 * fc + 8 * fd + 16 * fe AS mask, count(*) AS n,
                sum(good) AS good, sum(toxic) AS toxic
            FROM fails GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        steps AS (
            SELECT filter_order, step, filter_order[step] AS f,
                (1 << (ascii(filter_order[step]) - 65)) AS bit,
                list_sum(list_transform(range(1, step),
                    lambda i: 1 << (ascii(filter_order[i]) - 65)))::BIGINT AS before
            FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)),
        sums AS (
            SELECT part, filter_order, step::INT AS step, f,
                sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN n ELSE 0 END)
                    AS removed,
                sum(CASE WHEN mask & coalesce(before, 0) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)
                    AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN good ELSE 0 END)
                    AS good_lost,
                sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)
                    AS toxic_lost
            FROM masks, steps GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
            redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
            good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
            sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
        FROM sums
    """,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
