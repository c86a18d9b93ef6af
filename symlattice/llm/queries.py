"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, jaccard, language, licences, mpeg, packing, pii, repeats, shard


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_docs(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_docs(spark, sf_dir))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(_docs(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_docs(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.report(_docs(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(_docs(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_docs(spark, sf_dir))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.report(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_pii, op3_jaccard_join, op4_packing, op5_decontaminate, op6_mpeg_audio, op7_language_id, op8_license_scan, op9_chat_format, op10_shard)
}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
        own AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
        gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM win JOIN own USING (s), range(0, 13) r(k) WHERE first < doc_id GROUP BY doc_id),
        kept AS (SELECT d.doc_id, len(w) AS n, list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(coalesce(places, []), i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS k FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept""",
    "op3_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op5_decontaminate": r"""
        WITH words AS (SELECT k, id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''), []) AS w
          FROM (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
        items AS (SELECT DISTINCT CAST(id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT id, w, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM words WHERE k = 'b' AND len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM items),
        win AS (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE k = 'd' AND len(w) >= n)),
        hit AS (SELECT id, i, n, item FROM win JOIN items USING (n, s)),
        cover AS (SELECT id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, 8) r(k) WHERE k < n GROUP BY id),
        who AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id)
        SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM words LEFT JOIN cover USING (id) LEFT JOIN who USING (id) WHERE k = 'd'""",
    "op8_license_scan": licences.oracle(),
}
