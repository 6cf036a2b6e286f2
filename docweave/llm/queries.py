"""The thin queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_dedup, jaccard, langid, line_dedup, mixing, packing, quality, token_output, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), window=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/docweave-{uuid.uuid4().hex}/tokens"
    token_output.write(_table(spark, sf_dir, "documents"), path)
    return token_output.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"), entropy_share=0.99, max_repeats=4.0)
    return mix.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "copies")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), percent=75, words=5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_output": op5_token_output,
    "op6_language_id": op6_language_id,
    "op7_topk_search": op7_topk_search,
    "op8_mixing": op8_mixing,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op3_line_dedup": """
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM docs),
        marked AS (SELECT *, regexp_matches(line, '[^ \t\x0B\f\r]') AS solid FROM lines),
        firsts AS (SELECT doc_id, pos, line, length(line) AS n FROM marked WHERE solid
                   QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1),
        keyed AS (SELECT f.*, m, m // 2 AS h FROM firsts f, (SELECT unnest([0, 1]) AS d) z, LATERAL (SELECT n - d AS m) WHERE n >= 20),
        halves AS (SELECT doc_id, pos, line, n, m, 'h' AS side, left(line, h) AS k FROM keyed
                   UNION ALL SELECT doc_id, pos, line, n, m, 't', right(line, m - h) FROM keyed),
        pairs AS (SELECT DISTINCT b.doc_id, b.pos, b.line AS late, a.line AS early, a.n AS na, b.n AS nb
                  FROM halves a JOIN halves b ON a.side = b.side AND a.m = b.m AND a.k = b.k
                  WHERE (a.doc_id, a.pos) < (b.doc_id, b.pos) AND a.m = least(a.n, b.n)),
        near AS (SELECT DISTINCT doc_id, pos FROM pairs WHERE
                 (na = nb AND list_bool_or([left(late, i) = left(early, i) AND substr(late, i + 2) = substr(early, i + 2) FOR i IN range(na)]))
              OR (na = nb + 1 AND list_bool_or([left(late, i) = left(early, i) AND substr(late, i + 1) = substr(early, i + 2) FOR i IN range(na)]))
              OR (nb = na + 1 AND list_bool_or([left(late, i) = left(early, i) AND substr(late, i + 2) = substr(early, i + 1) FOR i IN range(nb)]))),
        kept AS (SELECT m.doc_id, m.pos, m.line FROM marked m
                 LEFT JOIN firsts f ON f.doc_id = m.doc_id AND f.pos = m.pos
                 LEFT JOIN near x ON x.doc_id = m.doc_id AND x.pos = m.pos
                 WHERE NOT m.solid OR (f.pos IS NOT NULL AND x.pos IS NULL)),
        clean AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM kept GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.l) AS BIGINT) AS n_lines, CAST(len(d.l) - coalesce(c.n, 0) AS BIGINT) AS n_dropped,
               sha256(coalesce(c.text, '')) AS text_sha256
        FROM docs d LEFT JOIN clean c USING (doc_id)""",
    "op9_ngram_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT doc_id, doc_id AS t FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.t = e.a),
        m AS (SELECT doc_id, min(t) AS component_id FROM r GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id FROM s JOIN m USING (doc_id)""",
    "op7_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS comps FROM embeddings),
        s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.comps, b.comps) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
