"""The ``opN_<name>`` queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import MIN_COVER, license_scan

    out = license_scan(_table(spark, sf_dir, "documents"))
    words = F.transform("places", lambda p: p["word"])
    base = F.transform("places", lambda p: p["label"])
    more = F.transform(F.filter("spans", lambda s: s["coverage"] >= MIN_COVER), lambda s: s["label"])
    join = lambda labels: F.concat_ws(",", F.sort_array(F.array_distinct(labels)))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        join(base).alias("base_labels"), join(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.round(F.array_max(F.transform("spans", lambda s: s["coverage"])), 6), F.lit(0.0))).alias("score"),
    )


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_round_trip

    out = bpe_round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    out = secret_scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "finding", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    out = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), out="q", keep_text=False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *(F.col("q")[x].alias(x) for x in names), F.round(F.col("q")["posterior"], 6).alias("posterior"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_dedup

    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import centroid_clusters

    return centroid_clusters(_table(spark, sf_dir, "embeddings")).drop("centroid")


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_warc": op3_warc,
    "op4_secret_scan": op4_secret_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_count": op6_token_count,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_language_id": op12_language_id,
    "op13_centroid_clusters": op13_centroid_clusters,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _centroid_rounds(rounds: int) -> str:
    """Assignment to the centroids of a round and the centroids of the next, so many times."""
    out = ""
    for i in range(rounds + 1):
        out += f""",
        a{i} AS (SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM
          (SELECT row, cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c USING (pos) GROUP BY row, cluster) GROUP BY row)"""
        if i < rounds:
            out += f""",
        c{i + 1} AS (SELECT c.cluster, c.pos, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{i} c LEFT JOIN
          (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM v JOIN a{i} USING (row) GROUP BY cluster, pos) USING (cluster, pos))"""
    return out


_PART = "1 + (1000000000 * (CAST({n} AS HUGEINT) + 5)) // ({total} + 5 * {terms})"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm""",
    "op3_warc": """
        WITH h AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
        f AS (SELECT payload, min(page_id) AS first_id FROM h GROUP BY payload)
        SELECT page_id, CAST(strlen(h.payload) AS BIGINT) AS payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            CAST(((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
          CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM h JOIN f ON h.payload = f.payload""",
    "op5_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS start FROM w),
        g AS (SELECT doc_id, start, array_to_string(list_slice(words, start, start + 19), ' ') AS gram FROM p),
        d AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY gram ORDER BY doc_id, start) AS n FROM g) WHERE n > 1),
        c AS (SELECT DISTINCT doc_id, start + unnest(range(0, 20)) AS pos FROM d),
        r AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
          sha256(array_to_string(list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
        FROM w LEFT JOIN r ON w.doc_id = r.doc_id""",
    "op11_source_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS document, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
        t AS (SELECT lang, source, document, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT document) >= 30),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        l AS (SELECT lang, count(*) AS terms, sum(total) AS total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
        p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {_PART.format(n="coalesce(c.n, 0)", total="s.total", terms="l.terms")} AS p, {_PART.format(n="k.total", total="l.total", terms="l.terms")} AS q
          FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_centroid_clusters": f"""
        WITH e AS (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        v AS (SELECT row, vec_id, unnest(range(1, 65)) AS pos, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM e),
        o AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster FROM e),
        c0 AS (SELECT cluster, pos, CAST(x AS HUGEINT) AS x FROM o JOIN v USING (row) WHERE cluster < 16){_centroid_rounds(3)},
        h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c3 GROUP BY cluster)
        SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
          CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a3 a JOIN e USING (row) JOIN h ON h.cluster = a.cluster""",
}
