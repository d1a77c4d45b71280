"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.llm import (bpe, centroids, chat_format, filter_audit, html_main, line_dedup, lm_score, near_dup, packing,
                           pieces, quality, toxicity, vectors)
from boardwalk.llm.common import table, wide_enough


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_enough(table(spark, sf_dir, "documents", "doc_id", "text"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dup.classes(_documents(spark, sf_dir))


def op2_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_main.extract(wide_enough(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that earlier ones hold."""
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the log-likelihood ratio, per document."""
    return quality.judge(_documents(spark, sf_dir), _labels(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op5_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict per document."""
    return toxicity.judge(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of what they decode to, per document."""
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of every document."""
    return lm_score.score(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat_format.format_chats(table(spark, sf_dir, "conversations", *chat_format.COLUMNS))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of what they decode to, per document."""
    return pieces.digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, per source, in every order of them."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return filter_audit.audit(wide_enough(docs), _labels(spark, sf_dir))


def op13_orchard_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of 40 centroids for every vector, after five rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


_CHATS_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
places AS (SELECT conv_id, turn, list({'r': role, 'x': text} ORDER BY role NULLS FIRST, text NULLS FIRST) AS said
           FROM turns GROUP BY conv_id, turn),
whole AS (SELECT conv_id, list({'t': turn, 's': said} ORDER BY turn NULLS FIRST) AS all_places
          FROM places GROUP BY conv_id),
prefixes AS (SELECT DISTINCT all_places[1:k] AS p
             FROM (SELECT all_places, unnest(range(1, len(all_places))) AS k FROM whole)),
apart AS (SELECT all_places, CASE WHEN count(conv_id) = count(*) THEN min(conv_id) END AS conv_id,
                 count(*) AS n_copies
          FROM whole GROUP BY all_places),
kept AS (SELECT conv_id, n_copies, flatten(list_transform(all_places, lambda y: y.s)) AS all_turns
         FROM apart ANTI JOIN prefixes ON all_places = p)
SELECT conv_id, CAST(len(all_turns) AS BIGINT) AS n_turns, n_copies,
       array_to_string(list_transform(all_turns, lambda y: '<|' || coalesce(y.r, 'unknown') || '|>' || chr(10)
                                                           || coalesce(y.x, '') || '<|end|>'), chr(10)) AS text
FROM kept
"""

_AUDIT_SQL = r"""
WITH letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.l NOT IN (b.l, c.l, d.l, e.l)
    AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l),
steps AS (
  SELECT filter_order, instr(filter_order, f.l) AS step, f.bit,
         CAST(coalesce(sum(g.bit), 0) AS INTEGER) AS earlier
  FROM orders CROSS JOIN letters f LEFT JOIN letters g ON instr(filter_order, g.l) < instr(filter_order, f.l)
  GROUP BY filter_order, f.l, f.bit),
texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN marks USING (doc_id)),
counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks GROUP BY part, mask),
rows AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted CROSS JOIN steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM rows
"""


def _centroids_sql(count: int, rounds: int) -> str:
    """Assignment and replacement written out, one pair of steps for each round."""
    distance = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def assigned(number: int) -> str:
        return f"""near{number} AS MATERIALIZED (
  SELECT k.id, arg_min(c.c, {distance} * {count} + c.c) AS c, min({distance}) AS distance
  FROM kept k CROSS JOIN c{number} c GROUP BY k.id)"""

    def replaced(number: int) -> str:
        return f"""c{number + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{number} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
      FROM near{number} JOIN kept USING (id), range(1, 65) r(i) GROUP BY c, i) GROUP BY c) m ON o.c = m.c)"""

    steps = [x for r in range(rounds) for x in (assigned(r), replaced(r))] + [assigned(rounds)]
    joined = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY key NULLS LAST, v) - 1 AS c, v
  FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS key, v FROM kept ORDER BY key NULLS LAST, v LIMIT {count})),
{joined}
SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM near{rounds} n JOIN kept USING (id) JOIN c{rounds} c ON n.c = c.c
"""


QUERIES = {f.__name__: f for f in (
    op1_order_minhash, op2_html_min_cut, op3_line_chunks, op4_quality_rules, op5_pruned_graph,
    op6_best_fit_packing, op7_toxicity, op8_byte_bpe, op9_attention_lm, op10_chat_formatting,
    op11_sentencepiece, op12_filter_audit, op13_orchard_centroids)}
ORACLE = {"op10_chat_formatting": _CHATS_SQL, "op12_filter_audit": _AUDIT_SQL,
          "op13_orchard_centroids": _centroids_sql(centroids.CENTROIDS, centroids.ROUNDS)}
