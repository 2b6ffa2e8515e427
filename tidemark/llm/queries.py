"""Registered queries of the text operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    bloom_dedup, centroids, collocations, decontaminate, gam, label_shards, minhash, ngram_lm, packed_ids, pair_bpe, secrets, simhash,
    toxicity,
)
from tidemark.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query(
    "op8_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    marked = bloom_dedup.mark_copies(documents(spark, folder), carry=["doc_id"])
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, folder), carry=["doc_id"])
    return groups.select("doc_id", "fingerprint", "component_id")


@query("op2_template_leaks")
def op2_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.mark_leaks(documents(spark, folder), table(spark, folder, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "item_id", "coverage", "shift", "slots")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return toxicity.mark_toxic(docs, table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@query("op5_pair_bpe")
def op5_pair_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = documents(spark, folder).select("doc_id", pair_bpe.digests(F.col("text"), VOCABULARY).alias("d"))
    return coded.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


@query("op7_packed_ids")
def op7_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return packed_ids.round_trip(docs, VOCABULARY, pair_bpe.vocabulary(VOCABULARY).size)


@query("op4_secrets")
def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = documents(spark, folder).select("doc_id", secrets.summary(F.col("text")).alias("s"))
    return found.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans", "s.n_entropy")


@query("op10_quality")
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return gam.mark_quality(docs, table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op9_label_shards")
def op9_label_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = label_shards.assign(documents(spark, folder), carry=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op3_bloom_lm")
def op3_bloom_lm(spark: SparkSession, folder: str) -> DataFrame:
    scored = ngram_lm.score_texts(documents(spark, folder), carry=["doc_id"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _centroid_sql(clusters: int = 8, rounds: int = 10, width: int = 64) -> str:
    """The rounds of op13 as chained tables; every number is an exact integer."""
    parts = [
        f"""kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS q FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h) - 1 AS k, q AS c
            FROM (SELECT q, sha256('3:' || vec_id::VARCHAR) AS h FROM kept ORDER BY h LIMIT {clusters}))""",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
            SELECT vec_id, any_value(q) AS q, min({{'d': d, 'k': k}}) AS best
            FROM (SELECT vec_id, q, k, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d
                  FROM kept, c{t}) GROUP BY vec_id)""")
        if t < rounds:
            parts.append(f"""c{t + 1} AS MATERIALIZED (
            SELECT k, coalesce(m, c) AS c FROM c{t} LEFT JOIN (
                SELECT k, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY i) AS m
                FROM (SELECT best.k AS k, i, sum(q[i]) AS s, count(*) AS n
                      FROM a{t}, (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY ALL) GROUP BY k) USING (k))""")
    return "WITH " + ",\n".join(parts) + f"""
        SELECT vec_id, best.k::INT AS cluster, best.d::BIGINT AS distance,
               sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON best.k = c{rounds}.k"""


@query("op13_centroids", _centroid_sql())
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    placed = centroids.cluster(table(spark, folder, "embeddings"), carry=["vec_id"])
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query(
    "op11_collocations",
    r"""
    WITH pieces AS MATERIALIZED (
        SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w
        FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    counts AS MATERIALIZED (
        SELECT lang, m, p, count(*) AS f FROM (
            SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS p
            FROM pieces, (SELECT unnest([1, 2, 3]) AS m)) GROUP BY ALL),
    candidates AS (SELECT lang, m, p, f AS a, string_split(p, ' ') AS w FROM counts WHERE m > 1 AND f >= 10),
    longer AS (
        SELECT lang, p, max(a) AS a FROM (
            SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p FROM candidates WHERE m = 3)
        GROUP BY ALL),
    kept AS (
        SELECT c.* FROM candidates c LEFT JOIN longer l ON c.lang = l.lang AND c.p = l.p AND c.m = 2
        WHERE l.a IS NULL OR 100 * l.a < 50 * c.a),
    cuts AS (
        SELECT lang, p, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
        FROM kept, (SELECT unnest([1, 2]) AS k) WHERE k < m),
    scored AS (
        SELECT c.lang, c.p, c.a, k, h.f AS l, t.f AS r, 1000000::HUGEINT * c.a * c.a // (h.f::HUGEINT * t.f) AS score
        FROM cuts c JOIN counts h ON h.lang = c.lang AND h.p = head JOIN counts t ON t.lang = c.lang AND t.p = tail),
    lowest AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)),
    sizes AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang)
    SELECT lang, rank, p AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM lowest JOIN sizes USING (lang) WHERE rank <= 2000
    """,
)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))


@query(
    "op12_minhash",
    r"""
    WITH RECURSIVE split AS MATERIALIZED (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    shingles AS MATERIALIZED (
        SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM split WHERE len(w) > 0),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
    ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
    FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
    """,
)
def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, folder), carry=["doc_id"])
    return found.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
