"""The queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import centroids, codes, decontaminate, fingerprint, jaccard, langid, lines, packing, pieces, sharding, toxicity, urls, warc
from weftline.llm.common import table

SHARDS = [f"shard-{i:03d}" for i in range(64)]
PIECES = "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_table(spark, table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), dropped="n_dropped")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_th")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("url", "offset", "length")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES)))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_url_filters, op3_sharding, op4_fingerprints, op5_packing, op6_line_dedup, op7_jaccard_join, op8_language_id, op9_decontamination, op10_warc, op11_centroids, op12_pieces, op13_vector_codes)
}


def _op3_sql() -> str:
    digits = "".join(f"{x:03d}" for x in sharding.fill_table(SHARDS))
    return f"""SELECT doc_id, slot, CAST(substr('{digits}', 3 * slot + 1, 3) AS INTEGER) AS shard FROM (
        SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents)"""


_OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM g),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, p.n, item_id FROM p JOIN win ON win.n = p.n AND win.s = array_to_string(w[i:i + p.n - 1], ' ')),
cov AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN coalesce(page_id > first, first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN coalesce(page_id > first, true) THEN first END AS refers_to
FROM q LEFT JOIN f ON f.payload_digest = q.payload_digest AND payload_bytes >= 100
"""

_OP6_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS h, coalesce(text, '') AS page, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
s AS (SELECT h, page, trim(line, E' \t\r\f\v') AS k FROM l),
b AS (SELECT s.h, k FROM (SELECT h, k, count(DISTINCT page) AS n FROM s WHERE k <> '' GROUP BY h, k) s JOIN (SELECT coalesce(source, '') AS h, count(DISTINCT coalesce(text, '')) AS pages FROM documents GROUP BY 1) p ON p.h = s.h WHERE n >= 3 AND n > 0.01 * pages),
bad AS (SELECT h, list(k) AS ks FROM b GROUP BY h),
d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS a, coalesce(ks, []) AS ks FROM documents LEFT JOIN bad ON bad.h = coalesce(source, '')),
k AS (SELECT doc_id, source, text, a, list_filter(a, lambda x: NOT list_contains(ks, trim(x, E' \t\r\f\v'))) AS keep FROM d)
SELECT doc_id, source, CASE WHEN len(keep) < len(a) THEN array_to_string(keep, chr(10)) ELSE text END AS text, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(a) - len(keep) END AS BIGINT) AS n_dropped FROM k
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds one after another, all distances computed."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT rid, vec_id, v, min(CAST(list_dot_product(v, v) - 2 * list_dot_product(v, w) + list_dot_product(w, w) AS BIGINT) * {k} + c) AS m FROM kept, c{i} GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""u{i} AS MATERIALIZED (
    SELECT c, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS w FROM (
        SELECT m % {k} AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(u{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN u{i} ON u{i}.c = c{i}.c)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS w FROM kept QUALIFY c < {k}),
{", ".join(steps)}
SELECT vec_id, CAST(m % {k} AS INTEGER) AS cluster, m // {k} AS distance,
       CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(w, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = m % {k}
"""


def _op13_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds with whole sums."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT rid, part.p, x, min(CAST(list_dot_product(x, x) - 2 * list_dot_product(x, w) + list_dot_product(w, w) AS BIGINT) * {entries} + e) AS m
    FROM part JOIN b{i} ON b{i}.p = part.p GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""u{i} AS MATERIALIZED (
    SELECT p, e, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS w FROM (
        SELECT p, m % {entries} AS e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{i}) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b{i}.p, b{i}.e, coalesce(u{i}.w, b{i}.w) AS w FROM b{i} LEFT JOIN u{i} ON u{i}.p = b{i}.p AND u{i}.e = b{i}.e)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings WHERE {_FINITE}),
part AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS w FROM part WHERE rid <= {entries}),
{", ".join(steps)},
book AS (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS s FROM b{rounds}),
code AS (SELECT rid, string_agg(lower(printf('%02x', m % {entries})), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM kept JOIN code USING (rid), book
"""


ORACLES: dict[str, str] = {
    "op3_sharding": _op3_sql(),
    "op6_line_dedup": _OP6_SQL,
    "op9_decontamination": _OP9_SQL,
    "op10_warc": _OP10_SQL,
    "op11_centroids": _op11_sql(),
    "op13_vector_codes": _op13_sql(),
}
