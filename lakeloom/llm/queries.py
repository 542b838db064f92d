"""The thin queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import alignment, bpe, ctw, exact_topk, html_text, mask_search, mixing, packing, quality, simhash, tiff, token_counts, token_files
from lakeloom.llm.common import table


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_products(table(spark, sf_dir, "embeddings"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("exact")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, path)


def op2_tiff_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.payload_features(table(spark, sf_dir, "documents"))


def op3_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rounds", "position")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, ids=False)


def op12_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_tiff_payloads": op2_tiff_payloads,
    "op3_context_tree_weighting": op3_context_tree_weighting,
    "op4_quality_trees": op4_quality_trees,
    "op5_curriculum_mix": op5_curriculum_mix,
    "op6_exact_topk": op6_exact_topk,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_token_counts": op8_token_counts,
    "op9_simhash_components": op9_simhash_components,
    "op10_html_main_text": op10_html_main_text,
    "op11_retrieval_packing": op11_retrieval_packing,
    "op12_mask_search": op12_mask_search,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op6_exact_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rid <> c.rid AND len(q.e) = len(c.e)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op12_mask_search": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
        ), e AS (SELECT doc_id, rid, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
        g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM e),
        q AS (
            SELECT item_id, row_number() OVER () AS iid, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
        ), i AS (SELECT item_id, iid, unnest(t) AS term FROM q),
        p AS (
            SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, n, unnest(t) AS term FROM e)
            WHERE term IN (SELECT term FROM i) GROUP BY rid, doc_id, n, term
        ), w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, docs),
        s AS (
            SELECT i.iid, i.item_id, p.rid, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * p.n * g.docs) // g.words))))::BIGINT AS score
            FROM i JOIN p USING (term) JOIN w USING (term), g GROUP BY i.iid, i.item_id, p.rid, p.doc_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op5_curriculum_mix": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS turn
            FROM documents
        ), s AS (
            SELECT source, sum(size)::DOUBLE AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source
        ), w AS (
            SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
        ), l AS (
            SELECT *, (sum(ss) OVER () - 3 * coalesce(sum(ss) OVER (ORDER BY ss / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ss / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
        ), t AS (
            SELECT source, ss, weight, least(3 * ss, (SELECT coalesce(arg_min(level, (ss / weight, rk)), 0) FROM l WHERE NOT 3 * ss < level * weight) * weight) AS target FROM l
        ), c AS (
            SELECT d.doc_id, d.size, t.ss::BIGINT AS source_size, t.target, t.weight, round(t.target)::BIGINT AS goal,
                sum(size) OVER (PARTITION BY d.source ORDER BY conv_bucket, turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS pos
            FROM (SELECT *, ('0x' || substr(turn, 1, 8))::BIGINT % 4096 AS conv_bucket FROM d) d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), r AS (  -- a row for each round in which words are taken; share: the part of its source's demand before it
            SELECT c.*, n, greatest(least(size, goal - pos - n * source_size), 0) AS words, (pos + n * source_size)::DOUBLE / nullif(goal, 0) AS share
            FROM c, (SELECT unnest([0, 1, 2]) AS n)
        ), p AS (  -- rates over training time: 1.5 - t, 1 and 0.5 + t; their integrals reach the share at the root of a quadratic
            SELECT *, CASE weight
                WHEN 5 THEN CASE WHEN share >= 0.625 THEN 0.5 + 2 * (share - 0.625) / (1.0 + sqrt(greatest(1.0 - 2 * (share - 0.625), 0))) ELSE 2 * share / (1.5 + sqrt(greatest(2.25 - 2 * share, 0))) END
                WHEN 2 THEN share
                ELSE CASE WHEN share >= 0.375 THEN 0.5 + 2 * (share - 0.375) / (1.0 + sqrt(1.0 + 2 * (share - 0.375))) ELSE 2 * share / (0.5 + sqrt(0.25 + 2 * share)) END
            END AS due FROM r
        )
        SELECT doc_id, size, source_size, any_value(target) AS target, sum(words)::BIGINT AS taken, count(*) FILTER (words > 0)::INTEGER AS rounds,
            min(floor(least(due, 1) * 1e9 + 0.5) / 1e9) FILTER (words > 0) AS position
        FROM p GROUP BY doc_id, size, source_size, pos
    """,
}
