"""Registered queries: each applies one operator, with production parameters, to its whole tables. SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailpolicy.llm import chat, clustering, decontamination, licenses, maxent, packing, quality, resampling, simhash, substring, topk, toxicity, wavelet
from mailpolicy.llm.common import crc_remainder, table


def _judged(scored: DataFrame, divisor: int, held: int, threshold: float) -> DataFrame:
    held_out = F.coalesce(crc_remainder("doc_id", divisor) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_remainder("doc_id", 4) != 2)
    return _judged(scored, 4, 2, toxicity.THRESHOLD)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_remainder("doc_id", 5) != 0)
    return _judged(scored, 5, 0, quality.THRESHOLD)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "dropped", end_id=1, size=4096)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "kept", end_id=2)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op11_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(table(spark, sf_dir, "documents"), crc_remainder("doc_id", 7) == 2)


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256, seed=2)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=1, buckets=10_000, least=20, percent=10, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_decontamination": op5_decontamination,
    "op6_chat": op6_chat,
    "op7_substring": op7_substring,
    "op8_simhash": op8_simhash,
    "op9_wavelet": op9_wavelet,
    "op10_topk": op10_topk,
    "op11_maxent": op11_maxent,
    "op12_clustering": op12_clustering,
    "op13_resampling": op13_resampling,
}

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _rounds(n: int) -> str:
    """Assignments a0... to centroids c0..., one CTE each."""
    out = []
    for i in range(n + 1):
        out.append(f"""a{i} AS MATERIALIZED (
            SELECT r, c, list_inner_product(v.t, v.t) - 2 * list_inner_product(v.t, c{i}.t) + list_inner_product(c{i}.t, c{i}.t) AS d
            FROM v, c{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < n:
            out.append(f"""m{i} AS (
            SELECT c, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY j) AS t
            FROM (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n
                FROM (SELECT c, unnest(t) AS x, unnest(range(64)) AS j FROM v JOIN a{i} USING (r)) GROUP BY c, j) GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.t, c{i}.t) AS t FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",\n        ".join(out)

SQL = {
    "op5_decontamination": f"""
        WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
        item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM benchmark),
        pane AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)),
        size AS (SELECT DISTINCT n FROM pane),
        gram AS (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, size WHERE len(w) >= n)),
        met AS (SELECT doc_id, item_id, gram.n, i FROM gram JOIN pane USING (n, t)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM met) GROUP BY ALL),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM met) GROUP BY ALL)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op6_chat": """
        WITH turn AS (
            SELECT conv_id, alone, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn) AS n,
                '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS t
            FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations)),
        prefix AS (
            SELECT conv_id, n, string_agg(t, '') OVER (PARTITION BY conv_id, alone ORDER BY n) AS text, n = max(n) OVER (PARTITION BY conv_id, alone) AS whole
            FROM turn),
        stay AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_equal, text FROM prefix WHERE whole GROUP BY n, text)
        SELECT conv_id, n_turns, n_equal, text FROM stay
        WHERE NOT EXISTS (SELECT 1 FROM prefix WHERE NOT whole AND prefix.n = stay.n_turns AND prefix.text = stay.text)""",
    "op10_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS t FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.t, c.t)::BIGINT AS score
            FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op12_clustering": f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS t FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), t) - 1 AS c, t FROM v QUALIFY c < 40),
        {_rounds(5)},
        inside AS (SELECT c, sum(d) AS s, sum(sum(d)) OVER () AS total FROM a5 GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, s::BIGINT AS cluster_inertia, total::BIGINT AS inertia,
            sha256(array_to_string(list_transform(c5.t, lambda x: x::BIGINT), ',')) AS centroid_sha256
        FROM v JOIN a5 USING (r) JOIN inside USING (c) JOIN c5 USING (c)""",
    "op13_resampling": f"""
        WITH step AS (
            SELECT list(c ORDER BY i) AS tab
            FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
        doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
        raw AS (SELECT unnest(w) AS x FROM doc),
        aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS})) AS x FROM benchmark),
        bytes AS (
            SELECT x, list_transform(range(octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), (2 * i + 1)::INTEGER, 2))::BIGINT) AS y
            FROM (SELECT x FROM raw UNION SELECT x FROM aim)),
        bucket AS MATERIALIZED (
            SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, y), lambda c, k: xor(c >> 8, tab[(xor(c, k) & 255) + 1])), 4294967295) % 10000 AS b
            FROM bytes, step),
        s AS (SELECT b, count(*) AS n FROM raw JOIN bucket USING (x) GROUP BY b),
        t AS (SELECT b, count(*) AS n FROM aim JOIN bucket USING (x) GROUP BY b),
        gain AS (
            SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM raw) + 10000)
                / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aim) + 10000)))) AS g
            FROM s FULL JOIN t USING (b)),
        -- documents by row, as ids may come again
        numbered AS (SELECT row_number() OVER () AS r, doc_id, w FROM doc),
        weighed AS (SELECT r, sum(g) AS g FROM (SELECT r, unnest(w) AS x FROM numbered) JOIN bucket USING (x) JOIN gain USING (b) GROUP BY r),
        scored AS (
            SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(g, 0)::BIGINT AS weight,
                (coalesce(g, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
            FROM numbered LEFT JOIN weighed USING (r)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed""",
}
