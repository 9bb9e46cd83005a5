"""One query for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelwright.llm import (
    alignment,
    conversations,
    decontam,
    hmm,
    htmltext,
    langid,
    mixing,
    secrets,
    simhash,
    suffix_dedup,
    topk,
    toxicity,
    warc,
)
from funnelwright.llm.common import crc_fold, shared_path, table


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", "value", "score", "is_secret")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("lcs", 6).alias("lcs"), F.round("answer", 6).alias("answer"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path, payloads=False).drop("payload")


def op4_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_fold(F.col("doc_id"), 7)
    return hmm.score(table(spark, sf_dir, "documents"), fold != 2, fold == 2)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    # A null id has no fold: it is not held out, and not learnt from either.
    learnt = langid.profiles(docs.where((crc_fold(F.col("doc_id"), 3) != 1)))
    return langid.predict(docs, learnt).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents")).drop("row")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", digest, (F.col("n_removed") > 0).alias("has_repeats"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 3)
    model = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels"), fold != 1))
    held_out, predicted = F.coalesce(fold == 1, F.lit(False)), (F.col("score") >= toxicity.TOXIC).cast("int")
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations"))).digests()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_hidden_markov": op4_hidden_markov,
    "op5_language": op5_language,
    "op6_html_text": op6_html_text,
    "op7_mixing": op7_mixing,
    "op8_topk": op8_topk,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op7_mixing": r"""
        WITH RECURSIVE rows_ AS (
            SELECT doc_id, coalesce(source, '') AS source,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
            FROM documents
        ), totals AS (
            SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs
            FROM rows_ GROUP BY source HAVING sum(n_tokens) > 0
        ), shares AS (
            SELECT tokens / CAST((SELECT sum(tokens) FROM totals) AS DOUBLE) AS p FROM totals
        ), goal AS (
            SELECT 0.5 * (-sum(p * ln(p)) + ln(count(*))) AS target FROM shares
        ), spread AS (
            SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
            UNION ALL
            SELECT i + 1, CASE WHEN e.h >= g.target THEN (low + high) / 2 ELSE low END,
                   CASE WHEN e.h >= g.target THEN high ELSE (low + high) / 2 END
            FROM spread, goal g, LATERAL (
                SELECT ln(sum(pow(p, (low + high) / 2)))
                       - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) AS h
                FROM shares
            ) e
            WHERE i < 45
        ), seen AS (
            SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
            UNION ALL
            SELECT i + 1, CASE WHEN e.r > 4.0 THEN (low + high) / 2 ELSE low END,
                   CASE WHEN e.r > 4.0 THEN high ELSE (low + high) / 2 END
            FROM seen, LATERAL (
                SELECT max(pow(p, (low + high) / 2 - 1)) / sum(pow(p, (low + high) / 2)) AS r FROM shares
            ) e
            WHERE i < 45
        ), chosen AS (
            SELECT round(greatest((SELECT max(low) FROM spread),
                                  CASE WHEN (SELECT max(1 / p) / count(*) FROM shares) > 4.0 THEN (SELECT max(low) FROM seen) ELSE 0 END), 4) AS a
        ), plan_ AS (
            SELECT source, round(pow(tokens, a) / (SELECT sum(pow(tokens, a)) FROM totals), 9) AS weight, tokens,
                   CAST(ceil(docs / 256) AS BIGINT) AS blocks,
                   CAST(round(round(pow(tokens, a) / (SELECT sum(pow(tokens, a)) FROM totals), 9) * (SELECT sum(tokens) FROM totals)) AS BIGINT) AS wanted
            FROM totals, chosen
        ), dealt AS (
            SELECT r.*, weight, blocks, wanted // tokens AS whole, wanted % tokens AS rest,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % blocks AS block
            FROM rows_ r JOIN plan_ USING (source)
        ), used AS (
            SELECT source, block, epoch, whole, rest,
                   row_number() OVER w AS block_rank, sum(tokens) OVER w - tokens AS before
            FROM (
                SELECT source, block, whole, rest, sum(n_tokens) AS tokens, unnest(range(0, whole + 1)) AS epoch
                FROM dealt GROUP BY source, block, whole, rest
            )
            WINDOW w AS (PARTITION BY source, epoch
                         ORDER BY md5('mix|' || epoch || '|' || source || '|' || block), block
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        ), uses AS (
            SELECT d.doc_id, d.source, d.n_tokens, d.weight, u.epoch, CAST(u.block_rank AS INTEGER) AS block_rank,
                   CAST(row_number() OVER w AS INTEGER) AS doc_rank, u.before + sum(d.n_tokens) OVER w - d.n_tokens AS before, d.whole, d.rest
            FROM dealt d JOIN used u USING (source, block)
            WHERE u.epoch < u.whole OR u.before < u.rest
            WINDOW w AS (PARTITION BY d.source, u.epoch, d.block
                         ORDER BY md5('mix|' || u.epoch || '|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.n_tokens
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        )
        SELECT doc_id, source, n_tokens, weight, epoch, block_rank, doc_rank FROM uses WHERE epoch < whole OR before < rest
    """,
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum([q.w[i] * c.w[i] FOR i IN range(1, least(len(q.w), len(c.w)) + 1)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM s
        )
        SELECT * FROM r WHERE rank <= 10
    """,
}
