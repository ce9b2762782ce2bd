"""The ``opN_`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, html, language, mixture, pieces, pii, quality, simhash, suffixes, tokens, warc, whiten
from .common import read, sha256_hex


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_report(read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", sha256_hex(F.col("base_spans")).alias("base_sha256"), "spans", "n_added")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), check=True)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.convert_pages(spark, read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", warc.hex_digest(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    model = language.fit(docs.filter(~held_out))
    return docs.select("doc_id", held_out, language.language(docs, model, F.col("text")).alias("_l")).select("doc_id", "held_out", "_l.*")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's ``deviation`` is a long: beyond some millions of vectors it does not fit, and the cast is an error."""
    return whiten.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixture.allot(read(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_decontaminate, op3_token_counts, op4_pii, op5_main_text, op6_simhash, op7_pieces, op8_warc, op9_suffixes, op10_language, op11_centroids, op12_whiten, op13_mixture)
}


def _centroids_sql(k: int = 40, rounds: int = 5) -> str:
    """Every distance of every round, by brute force."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        """
        v AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), x AS MATERIALIZED (
            SELECT rid, unnest(range(1, 65)) AS i, unnest(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS x FROM v
        ), c0 AS MATERIALIZED (
            SELECT k, i, x AS c FROM (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM v) JOIN x USING (rid) WHERE k < """
        + f"{k})"
    ]
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (
            SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT rid, k, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{r} USING (i) GROUP BY rid, k) GROUP BY rid
        )""")
        if r < rounds:
            steps.append(f"""
        c{r + 1} AS MATERIALIZED (
            SELECT k, i, coalesce({floor}, c)::BIGINT AS c FROM c{r} LEFT JOIN (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (rid) GROUP BY k, i) USING (k, i)
        )""")
    return f"""
        WITH {", ".join(steps)}, names AS (
            SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k
        )
        SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN v USING (rid) JOIN names USING (k)
    """

ORACLE_SQL: dict[str, str] = {
    "op11_centroids": _centroids_sql(),
    "op13_mixture": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight FROM d GROUP BY source
        ), o AS (
            SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS r, sum(source_size) OVER ()::BIGINT AS whole FROM s
        ), p AS (
            -- what is left, by weight, if the sources before this one are cut at three times their size
            SELECT *, (whole - coalesce(sum(3 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
                   (sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS active FROM o
        ), level AS (
            SELECT r AS first_free, rest, active FROM p WHERE 3 * source_size * active >= weight * rest ORDER BY r LIMIT 1
        ), t AS (
            SELECT source, source_size, CASE WHEN r < first_free THEN (3 * source_size)::DOUBLE ELSE (weight * level.rest)::DOUBLE / level.active::DOUBLE END AS target FROM o, level
        ), m AS (
            SELECT doc_id, size, source_size, target, draw, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INTEGER))::BIGINT AS taken FROM m
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
            SELECT page_id, octet_length(body) AS payload_bytes, payload_digest,
                   max(page_id) OVER (PARTITION BY payload_digest, octet_length(body)) AS first
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
        FROM g
    """,
    "op2_decontaminate": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), b AS (
            SELECT item_id::varchar AS item_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM benchmark WHERE text IS NOT NULL
        ), bw AS (
            SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM b WHERE len(words) > 0
        ), p AS (
            SELECT DISTINCT item_id, least(13, len(words)) AS m, array_to_string(words[i : i + 12], ' ') AS pattern FROM bw
        ), dw AS (
            SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d
        ), w AS MATERIALIZED (
            SELECT rid, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ahead FROM dw
        ), lengths AS MATERIALIZED (
            SELECT DISTINCT m FROM p
        ), x AS MATERIALIZED (
            SELECT rid, i, m, array_to_string(ahead[1 : m], ' ') AS pattern FROM w JOIN lengths ON len(ahead) >= m
        ), o AS MATERIALIZED (
            SELECT rid, i, m, item_id FROM x JOIN p USING (m, pattern)
        ), hit AS (
            SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT rid, i, m FROM o)) GROUP BY rid
        ), items AS (
            SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined FROM (SELECT DISTINCT rid, item_id FROM o WHERE item_id IS NOT NULL) GROUP BY rid
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
    """,
    "op9_suffixes": """
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS body, length(hex(encode(coalesce(text, '')))) // 2 AS n_bytes FROM documents
        ), s AS MATERIALIZED (
            SELECT rid, unnest(range(0, n_bytes - 399)) AS i FROM d WHERE n_bytes >= 400
        ), h AS MATERIALIZED (
            SELECT rid, i, md5_number(substr(body, 2 * i + 1, 800)) AS m FROM s JOIN d USING (rid)
        ), again AS (
            SELECT m FROM h GROUP BY m HAVING count(*) > 1
        ), r AS (
            SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM h SEMI JOIN again USING (m)
        ), g AS (
            SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM r
        ), spans AS (
            SELECT rid, run, min(i) AS a, max(i) + 400 AS e FROM g GROUP BY rid, run
        ), gaps AS (
            SELECT rid, a, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans
        ), cut AS (
            SELECT rid, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(body, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
            FROM gaps JOIN d USING (rid) GROUP BY rid
        )
        SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(body, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN cut USING (rid)
    """,
}
