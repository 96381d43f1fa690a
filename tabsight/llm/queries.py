"""The registered queries, one per operator: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import bond, bpe, decontaminate, licenses, lm_score, merkle, pii, quality_classifier, quality_rules, simhash, substring_dedup, threshold_search, url_filter
from tabsight.llm.common import crc_mod, table


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


#: The rules of the url filter.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) == 2)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0, 5, 10, 30, 90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_licenses,
        op3_quality_rules,
        op4_pii,
        op5_bpe,
        op6_substring_dedup,
        op7_lm_score,
        op8_url_filter,
        op9_quality_classifier,
        op10_simhash,
        op11_merkle_manifest,
        op12_exact_topk,
        op13_hard_negatives,
    )
}
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = (
    "unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
    " WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s"
)
#: Vectors that take part, as integers; inner product of two of them, padded with zeros.
_INTEGERS = (
    "SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x"
    " FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
)
_PRODUCT = "CAST(list_sum(list_transform(list_zip({0}.x, {1}.x), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT)"
ORACLE: dict[str, str] = {
    "op1_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
        ds AS (SELECT doc_id, {_SHINGLES} FROM d),
        bs AS (SELECT item_id, {_SHINGLES} FROM b),
        n AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY item_id),
        j AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles AS containment
        FROM j JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_item_shingles""",
    "op11_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS row, *, list_reduce(
                [4294967295::BIGINT] || list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT),
                lambda a, c: list_reduce([xor(a, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))
            ) AS crc FROM documents),
        t AS (SELECT *, CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS tampered,
            coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM d),
        l AS (SELECT row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS now FROM t),
        placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
        inside(level, tree, pos, n, node) AS (
            SELECT 0, tree, pos, n, leaf FROM placed
            UNION ALL
            SELECT any_value(level) + 1, tree, pos // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM inside WHERE n > 1 GROUP BY tree, pos // 3),
        subroots AS (SELECT tree, node AS subroot FROM inside WHERE n = 1),
        over_sources(level, pos, n, node) AS (
            SELECT 0, tree, (SELECT count(*) FROM subroots), subroot FROM subroots
            UNION ALL
            SELECT any_value(level) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM over_sources WHERE n > 1 GROUP BY pos // 3),
        -- Siblings of each node that is not a root, left and right of it.
        s1 AS (SELECT a.level, a.tree, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
            FROM inside a JOIN inside b ON a.level = b.level AND a.tree = b.tree AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.level, a.tree, a.pos),
        s2 AS (SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
            FROM over_sources a JOIN over_sources b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.level, a.pos),
        fold1(row, level, tree, pos, node, proof) AS (
            SELECT row, 0, tree, pos, now, '' FROM placed
            UNION ALL
            SELECT f.row, f.level + 1, f.tree, f.pos // 3, sha256(lft || f.node || rgt), f.proof || lft || rgt FROM fold1 f JOIN s1 USING (level, tree, pos)),
        top1 AS (SELECT row, arg_max(tree, level) AS tree, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM fold1 GROUP BY row),
        fold2(row, level, pos, node, proof) AS (
            SELECT row, 0, tree, node, proof FROM top1
            UNION ALL
            SELECT f.row, f.level + 1, f.pos // 3, sha256(lft || f.node || rgt), f.proof || lft || rgt FROM fold2 f JOIN s2 USING (level, pos)),
        top2 AS (SELECT row, arg_max(node, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM fold2 GROUP BY row)
        SELECT doc_id, leaf, subroot, node AS root, proof_sha256, folded_root, folded_root = node AS verified
        FROM placed JOIN subroots USING (tree) JOIN top2 USING (row), (SELECT node FROM over_sources WHERE n = 1)""",
    "op12_exact_topk": rf"""
        WITH v AS ({_INTEGERS}),
        s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, {_PRODUCT.format("q", "c")} AS score FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op13_hard_negatives": rf"""
        WITH v AS (SELECT * REPLACE (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label) FROM ({_INTEGERS}) WHERE label IS NOT NULL),
        s AS (SELECT a.row, a.vec_id AS anchor_id, c.row AS other, c.vec_id, a.label = c.label AS same, {_PRODUCT.format("a", "c")} AS score FROM v a JOIN v c ON a.row <> c.row WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other) <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
            CAST(row_number() OVER (PARTITION BY p.row, p.other ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank
            FROM p JOIN s ON p.row = s.row AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
