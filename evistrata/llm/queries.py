"""The registered queries of the training-data operators and the SQL that some of them match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.llm import alignment, exact_dedup, filter_audit, hamming_search, html_extract, mixing, ngram_join, pieces, quality, sharding, surrogates, token_counts, toxicity

#: Of the registered query; a real run passes a secret of its own.
SURROGATE_KEY = b"evistrata example key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(_table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup_table(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming_search.sign_code("embedding").alias("code"))
    return hamming_search.search(codes, codes.filter("id % 100 = 0"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), pieces.read_model(pieces.DEFAULT_MODEL))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> bytes:
    import public_tokenizers

    return pieces.read_model(public_tokenizers.path(name))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.measure(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_surrogates": op4_surrogates,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_hamming_search": op8_hamming_search,
    "op9_pieces": op9_pieces,
    "op10_ngram_join": op10_ngram_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_counts": op12_token_counts,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * same >= 85 * (p.n + q.n - same)),
        reach AS (SELECT a AS node, b AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
        SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(d.doc_id, min(r.seen)) AS component_id
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id""",
    "op8_hamming_search": """
        WITH found AS (
            SELECT q.vec_id AS query_id, x.vec_id AS neighbor_id,
                   len(list_filter(range(1, 65), lambda i: (coalesce(q.embedding[i], 0) > 0) <> (coalesce(x.embedding[i], 0) > 0))) AS distance
            FROM embeddings q JOIN embeddings x ON x.vec_id <> q.vec_id
            WHERE q.vec_id % 100 = 0 AND q.embedding IS NOT NULL AND x.embedding IS NOT NULL)
        SELECT query_id, row_number() OVER w AS rank, neighbor_id, distance FROM found
        WINDOW w AS (PARTITION BY query_id ORDER BY distance, neighbor_id) QUALIFY row_number() OVER w <= 10""",
    "op11_filter_audit": r"""
        WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
        fails AS (
            SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
                    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f,
                words.doc_id IN (SELECT doc_id FROM good) AS good, words.doc_id IN (SELECT doc_id FROM toxic) AS toxic
            FROM words),
        cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
        acts AS (
            SELECT c.*, filter_order, step, c.f[ascii(filter_order[step]) - 64] AS fails_now,
                len(list_filter(range(1, step), lambda i: c.f[ascii(filter_order[i]) - 64])) > 0 AS gone,
                len(list_filter(c.f, lambda b: b)) = 1 AS alone
            FROM cells c, steps),
        counted AS (
            SELECT part, filter_order, step, sum(n) FILTER (NOT gone AND NOT fails_now) AS kept, sum(n) FILTER (NOT gone AND fails_now) AS removed,
                sum(n) FILTER (gone AND fails_now) AS redundant, sum(n) FILTER (alone AND fails_now) AS unique_fails,
                sum(good) FILTER (NOT gone AND fails_now) AS good_lost, sum(toxic) FILTER (NOT gone AND fails_now) AS toxic_lost
            FROM acts GROUP BY part, filter_order, step)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
            CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
            CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter_order[step]), 0) AS BIGINT) AS shapley
        FROM counted""",
}
