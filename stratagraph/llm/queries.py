"""The registered training-data queries: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removal_report

    return removal_report(load(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(load(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_texts

    return main_texts(load(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(load(spark, sf_dir, "documents"), weights=(1, 2, 3), repeats=3)


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tool_calls import linked_conversations

    return linked_conversations(load(spark, sf_dir, "conversations"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(load(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
    return judge(load(spark, sf_dir, "documents")).select(*columns)


def op10_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_join import near_classes

    return near_classes(load(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lloyd import delta_lloyd

    return delta_lloyd(load(spark, sf_dir, "embeddings"), length=64, scale=1024, k=8, seed="3:", rounds=10)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_classes

    return simhash_classes(load(spark, sf_dir, "documents"), width=4, threshold=4)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codebooks import encode

    return encode(load(spark, sf_dir, "embeddings"), parts=16, entries=64, scale=256, rounds=2).drop("label")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_WARC = """
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT page_id, h, first, strlen(h) >= 100 AND page_id <> first AS again
      FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
_SQUARES = "CAST(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _lloyd_sql(rounds: int = 10) -> str:
    """Plain Lloyd: every round compares all vectors with all centroids and sums all of them."""
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT 8))",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := {_SQUARES.format('kept.v', f'c{i}.v')}, c := c)) AS m FROM kept, c{i} GROUP BY r)")
        ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.v, o.v) AS v FROM c{i} AS o LEFT JOIN (
            SELECT c, list({_FLOOR} ORDER BY p) AS v FROM (SELECT c, p, sum(x) AS s, count(*) AS n FROM (
                SELECT a.m.c AS c, generate_subscripts(k.v, 1) AS p, unnest(k.v) AS x FROM a{i} AS a JOIN kept AS k USING (r)) GROUP BY c, p) GROUP BY c) AS w USING (c))""")
    last = f"a{rounds}"
    return f"""WITH {', '.join(ctes[:-1])}
SELECT k.vec_id, CAST(a.m.c AS INTEGER) AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM {last} AS a JOIN kept AS k USING (r) JOIN c{rounds} AS c ON c.c = a.m.c"""


def _codes_sql(rounds: int = 2) -> str:
    """Every part against every entry."""
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_FINITE}))""",
        "parts AS MATERIALIZED (SELECT r, p, v[CAST(4 * p + 1 AS BIGINT):CAST(4 * p + 4 AS BIGINT)] AS v FROM kept, range(16) AS t(p))",
        "b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= 64)",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := {_SQUARES.format('parts.v', f'b{i}.v')}, e := e)) AS m FROM parts JOIN b{i} USING (p) GROUP BY r, p)")
        ctes.append(f"""b{i + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(w.v, o.v) AS v FROM b{i} AS o LEFT JOIN (
            SELECT p, e, list({_FLOOR} ORDER BY j) AS v FROM (SELECT p, e, j, sum(x) AS s, count(*) AS n FROM (
                SELECT a.p, a.m.e AS e, generate_subscripts(k.v, 1) AS j, unnest(k.v) AS x FROM a{i} AS a JOIN parts AS k USING (r, p)) GROUP BY p, e, j) GROUP BY p, e) AS w USING (p, e))""")
    return f"""WITH {', '.join(ctes[:-1])},
coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256 FROM coded AS c JOIN kept AS k USING (r), digest AS d"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; tests/llm holds the others against brute force."""
    from .tool_calls import ORACLE

    return {"op2_warc": _WARC, "op7_tool_calls": ORACLE, "op11_centroids": _lloyd_sql(), "op13_vector_codes": _codes_sql()}
