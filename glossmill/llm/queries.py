"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, divergence, fingerprints, language_id, line_dedup, near_duplicates, neighbours, packing, private_data, quality, sharding, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """Where the public word tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_two_pass_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sharding.shard_records(_table(spark, sf_dir, "documents"), shards=40)
    return drawn.select(
        "record.doc_id", "size", F.crc32(F.coalesce("record.text", F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op2_skip_chain_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find_private_data(_table(spark, sf_dir, "documents"))


def op3_kneser_ney_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_languages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), percent=85, shingle=5)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.find_repeated_lines(_table(spark, sf_dir, "documents"), size=3)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op6_lookup_sketch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.drop("matches")


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), word_tokenizer(), capacity=4096, end_id=1)


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Toxic texts are of grade 0, poor ones of grade 1, all others of grade 2; a text that is not
    # known to be toxic or not, or else not to be poor or not, has no grade and teaches nothing.
    toxic, good = F.col("toxic"), F.col("quality")
    grade = F.when(toxic == 1, 0).when((toxic == 0) & (good == 0), 1).when((toxic == 0) & (good == 1), 2)
    ratings = _table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    found = quality.grade_documents(_table(spark, sf_dir, "documents"), ratings, n_grades=3)
    return found.select("doc_id", "expected_grade", "tail_probability", F.expr("1 - at_least[0]").alias("toxic_probability"), "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), window=20)


def op11_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"), every=20, top=20)


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, size=64, scale=1024, seed=3)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"), least_documents=3, most_terms=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_two_pass_sharding": op1_two_pass_sharding,
    "op2_skip_chain_private_data": op2_skip_chain_private_data,
    "op3_kneser_ney_language_id": op3_kneser_ney_language_id,
    "op4_minhash_near_duplicates": op4_minhash_near_duplicates,
    "op5_line_dedup": op5_line_dedup,
    "op6_lookup_sketch_fingerprints": op6_lookup_sketch_fingerprints,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_pattern_packing": op8_pattern_packing,
    "op9_ordinal_quality": op9_ordinal_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_multiprobe_neighbours": op11_multiprobe_neighbours,
    "op12_yinyang_clusters": op12_yinyang_clusters,
    "op13_source_divergence": op13_source_divergence,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lloyd_sql(k: int, rounds: int, size: int, scale: int, seed: int) -> str:
    """Rounds of assignment and floored means, each a step of its own. A centroid is a list of integers."""
    distance = "list_sum(list_transform(list_zip(v, h), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""n AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
        )""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS c, v AS h FROM n ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT r, c, CAST({distance} AS BIGINT) AS d FROM n, c{i})")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS o FROM d{i}) WHERE o = 1)")
        if i < rounds:
            parts.append(
                f"m{i} AS (SELECT c, list(x ORDER BY j) AS h FROM (SELECT c, j, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x "
                f"FROM (SELECT c, unnest(v) AS x, unnest(range(1, {size + 1})) AS j FROM a{i} JOIN n USING (r)) GROUP BY c, j) GROUP BY c)"
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.h, o.h) AS h FROM c{i} AS o LEFT JOIN m{i} AS m USING (c))")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(h, ',')) AS centroid_sha256
        FROM a{rounds} JOIN n USING (r) JOIN c{rounds} USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op12_yinyang_clusters": _lloyd_sql(8, 10, 64, 1024, 3),
    "op13_source_divergence": rf"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ),
        kept AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY ALL HAVING count(*) >= 3),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        o AS (SELECT lang, source, t, count(*) AS c FROM (SELECT lang, source, unnest(w) AS t FROM d) SEMI JOIN kept USING (lang, t) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        gn AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN o USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT lang, source, t, coalesce(c, 0) AS c, 1 + (1000000000 * CAST(coalesce(c, 0) + 1 AS HUGEINT)) // (n + v) AS p
            FROM gn JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN o USING (lang, source, t)
        ),
        l AS (SELECT lang, t, sum(c) AS c FROM o GROUP BY ALL),
        ln AS (SELECT lang, sum(c) AS n FROM l GROUP BY ALL),
        q AS (SELECT lang, t, 1 + (1000000000 * CAST(c + 1 AS HUGEINT)) // (n + v) AS q FROM l JOIN ln USING (lang) JOIN v USING (lang)),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b USING (lang, t) WHERE a.source <> b.source GROUP BY ALL),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        ),
        terms AS (SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
        WHERE part = 'pair' OR rank <= 200
    """,
    "op4_minhash_near_duplicates": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(node, other) AS (SELECT a, a FROM l UNION SELECT node, b FROM reach JOIN l ON other = a),
        c AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = w.doc_id
    """,
    "op7_benchmark_decontamination": rf"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w FROM documents),
        t AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
        tw AS (
            SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g
            FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM t WHERE len(w) > 0)
        ),
        dw AS (
            SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM tw) WHERE len(w) >= k)
        ),
        hit AS (SELECT doc_id, i, k, item FROM dw JOIN tw USING (k, g)),
        n AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hit), range(0, 10) AS r(o) WHERE o < k GROUP BY doc_id),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
        places AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS j, w FROM (SELECT row_number() OVER () AS r, w, least(len(w), 10) AS k FROM t WHERE len(w) > 0)),
        met AS (SELECT doc_id, r, k, i, j FROM (SELECT DISTINCT doc_id, i, k, g FROM dw SEMI JOIN tw USING (k, g)) JOIN (SELECT r, k, j, array_to_string(w[j : j + k - 1], ' ') AS g FROM places) USING (k, g)),
        runs AS (SELECT doc_id, count(*) + k - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, r, i - j ORDER BY i) AS run FROM met) GROUP BY doc_id, r, k, i - j, run),
        longest AS (SELECT doc_id, max(n) AS longest FROM runs GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN longest USING (doc_id)
    """,
    "op10_substring_dedup": r"""
        WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        p AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM p) WHERE n > 1),
        covered AS (SELECT DISTINCT doc_id, i + o AS i FROM late, range(0, 20) AS r(o)),
        word AS (SELECT doc_id, i, w[i] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
        kept AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS s, count(*) AS n FROM word ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op5_line_dedup": """
        WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
        w AS (
            SELECT doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS k
            FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM cut)
        ),
        late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
        covered AS (SELECT DISTINCT doc_id, p + o AS p FROM late, (VALUES (0), (1), (2)) AS t(o)),
        line AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS s FROM cut),
        kept AS (
            SELECT doc_id, string_agg(s, chr(10) ORDER BY p) AS s, count(*) AS n
            FROM line ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
            CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM cut LEFT JOIN kept USING (doc_id)
    """,
}
