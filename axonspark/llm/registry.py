"""The queries of this subpackage, by the name under which the entry module registers them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonspark.llm import forest, html, jaccard, leaks, mixing, packing, periodic, pii, quality, resample, spans, tokens, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(e.where(F.col("vec_id") % 100 == 0), e)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken", "copies")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return forest.nearest(e.where(F.col("vec_id") % 100 == 0), e)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resampled documents: those that the classifier rejects aren't in the result."""
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return scored.where("keep").select("doc_id", "log_weight", "keep")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Of a tenth of the documents: the word from which they repeat themselves, and the number of words that repeat."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 or n <= 0:
        return None
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted, carry=["doc_id"])
    best = F.col("strongest")
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_main_text": op2_main_text,
    "op3_token_counts": op3_token_counts,
    "op4_personal_data": op4_personal_data,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_quality": op10_quality,
    "op11_decontamination": op11_decontamination,
    "op12_resampling": op12_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) x
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
        ), l AS (
            SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)
        ), e AS (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r AS (
            SELECT doc_id, doc_id AS c FROM documents
            UNION
            SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a WHERE r.c < e.b
        )
        SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
        FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON d.doc_id = m.doc_id
    """,
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_decontamination": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), i AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
        ), g AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0) x
        ), p AS (
            SELECT doc_id, l, k, array_to_string(w[k:k + l - 1], ' ') AS g
            FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM w, (SELECT DISTINCT l FROM g) y WHERE len(w) >= l) x
        ), m AS (
            SELECT p.doc_id, p.k, p.l, g.item_id FROM p JOIN g ON p.l = g.l AND p.g = g.g
        ), h AS (
            SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS x FROM m) y GROUP BY doc_id
        ), t AS (
            SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) y GROUP BY doc_id
        )
        SELECT w.doc_id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
               sha256(coalesce(t.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
        FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
    """,
    "op12_resampling": r"""
        WITH c AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
        ), a AS (
            SELECT doc_id, FALSE AS wanted, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
            UNION ALL
            SELECT NULL, TRUE, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
        ), u AS (
            SELECT wanted, doc_id, unnest(w) AS w FROM a
        ), b AS (
            SELECT d.w AS w, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(d.w))), lambda k: CAST(concat('0x', substr(hex(encode(d.w)), 2 * k + 1, 2)) AS BIGINT)), lambda s, x: xor(s >> 8, c.t[xor(s & 255, x) + 1]), 4294967295)) % 10000 AS bucket
            FROM (SELECT DISTINCT w FROM u) d, c
        ), n AS (
            SELECT b.bucket, count(*) FILTER (WHERE NOT u.wanted) AS s, count(*) FILTER (WHERE u.wanted) AS t FROM u JOIN b ON u.w = b.w GROUP BY b.bucket
        ), z AS (
            SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t FROM n
        ), g AS (
            SELECT n.bucket, CAST(floor(1000 * ln((CAST(n.t AS DOUBLE) + 1) * (z.s + 10000) / ((CAST(n.s AS DOUBLE) + 1) * (z.t + 10000)))) AS BIGINT) AS gain FROM n, z
        ), f AS (
            SELECT u.doc_id, count(*) AS n_features, CAST(sum(g.gain) AS BIGINT) AS weight FROM u JOIN b ON u.w = b.w JOIN g ON b.bucket = g.bucket WHERE NOT u.wanted GROUP BY u.doc_id
        ), x AS (
            SELECT d.doc_id, coalesce(f.n_features, 0) AS n_features, coalesce(f.weight, 0) AS weight,
                   coalesce(f.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('2024:', CAST(d.doc_id AS VARCHAR))), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id
        ), k AS (
            SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS many FROM x
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= (10 * many) // 100 THEN place END AS rank FROM k
    """,
}
