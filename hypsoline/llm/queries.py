"""The queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers as tokenizers

from pyspark.sql import functions as F

from . import bpe, gif, langid, licenses, mixing, nearcopies, pii, shards, simhash, urlfilter, vafile
from .common import table

RANKS = tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = tokenizers.path("piece_bpe_32k.model")

QUERIES = {
    "op1_byte_bpe": lambda spark, d: bpe.op1(table(spark, d, "documents"), RANKS, tokenizers.PATTERN),
    "op2_exact_top_k": lambda spark, d: vafile.op2(table(spark, d, "embeddings")),
    "op3_simhash": lambda spark, d: simhash.op3(table(spark, d, "documents")),
    "op4_url_filter": lambda spark, d: urlfilter.op4(table(spark, d, "pages")),
    "op5_gif_media": lambda spark, d: gif.op5(table(spark, d, "documents")),
    "op6_sampled_splitters": lambda spark, d: shards.op6(table(spark, d, "documents")),
    "op7_pii_boosting": lambda spark, d: pii.op7(table(spark, d, "documents")),
    "op8_license_digests": lambda spark, d: licenses.op8(table(spark, d, "documents")),
    "op9_language_id": lambda spark, d: langid.op9(table(spark, d, "documents"), PIECES),
    "op10_mixing": lambda spark, d: mixing.op10(table(spark, d, "documents")),
}

_TOP_K = """
WITH usable AS (
  SELECT DISTINCT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id::BIGINT AS query_id, r::INT AS rank, vec_id::BIGINT AS vec_id, score FROM ranked WHERE r <= 10
"""

_MIX = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), '10', md5(coalesce(text, '')))), 1, 15))::BIGINT AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source
), o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS i FROM s),
p AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(3 * source_size) OVER before, 0)::DOUBLE AS rest_size,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest_w
  FROM o WINDOW before AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT * FROM p WHERE 3 * source_size * rest_w >= rest_size * w ORDER BY i LIMIT 1),
t AS (
  SELECT p.source, p.source_size, CASE WHEN p.i < f.i THEN 3.0 * p.source_size ELSE f.rest_size * p.w / f.rest_w END::DOUBLE AS target
  FROM p, f
), g AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size)) END AS passes FROM t
), r AS (
  SELECT *, CASE WHEN passes < 3 THEN least(source_size::DOUBLE, target - passes * source_size) ELSE 0 END AS rest FROM g
), k AS (
  SELECT *, sum(z) OVER (PARTITION BY source ORDER BY u) - z AS cum
  FROM (SELECT source, u, sum(size) AS z FROM d GROUP BY source, u)
), x AS (
  SELECT k.source, k.u, (r.rest > 0 AND cum * 2 + z <= r.rest * 2)::INT AS extra, r.source_size, r.target, r.passes
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source
), w AS (SELECT greatest(1, (sum(source_size)::BIGINT + {blocks} - 1) // {blocks}) AS words FROM s),
e AS (SELECT source, max(u) AS last FROM x WHERE extra = 1 GROUP BY source),
b AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s, greatest(1, (source_size + words - 1) // words) AS blocks FROM r, w),
tree0 AS (
  SELECT b.source, b.s, b.blocks, '0' AS node, b.passes::BIGINT * b.blocks + coalesce((((e.last >> 24) * b.blocks) >> 36) + 1, 0) AS n
  FROM b LEFT JOIN e ON b.source IS NOT DISTINCT FROM e.source
), {levels}, dealt AS (
  SELECT source, blocks, row_number() OVER (PARTITION BY s ORDER BY node) - 1 AS shard, sum(n) OVER (PARTITION BY s ORDER BY node) AS upto, n FROM tree3
), copies AS (
  SELECT d.doc_id, d.u, d.source, t.shard FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.u = x.u JOIN range(3) k(k) ON k < x.passes + x.extra
  JOIN dealt t ON t.source IS NOT DISTINCT FROM d.source AND k * t.blocks + (((d.u >> 24) * t.blocks) >> 36) >= t.upto - t.n
    AND k * t.blocks + (((d.u >> 24) * t.blocks) >> 36) < t.upto
), taken AS (
  SELECT doc_id, source, u, count(*) AS many, string_agg(shard, ',' ORDER BY shard) AS shards FROM (SELECT DISTINCT * FROM copies) GROUP BY ALL
)
SELECT d.doc_id, d.size, x.source_size, x.target, (d.size * (x.passes + x.extra))::BIGINT AS taken, coalesce(t.shards, '') AS shards
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.u = x.u
LEFT JOIN taken t ON t.doc_id IS NOT DISTINCT FROM d.doc_id AND t.source IS NOT DISTINCT FROM d.source AND t.u = d.u
"""

#: One level of the splitting tree: each node's balls in the order of their hashes, the first half to the left.
_LEVEL = """tree{at} AS (
  SELECT source, s, blocks, node || side AS node, count(*) FILTER (side = (2 * r > t - t % 2)::INT::VARCHAR AND i IS NOT NULL) AS n
  FROM (
    SELECT p.*, i, row_number() OVER (PARTITION BY node ORDER BY i IS NULL, md5('10|' || node || '|' || s || '|' || i), s) AS r, count(i) OVER (PARTITION BY node) AS t
    FROM tree{before} p LEFT JOIN (SELECT s AS s2, node AS node2, unnest(range(n)) AS i FROM tree{before}) ON s = s2 AND node = node2
  ), (VALUES ('0'), ('1')) sides(side) GROUP BY ALL
)"""
_MIX = _MIX.replace("{blocks}", str(mixing.BLOCKS)).replace("{levels}", ", ".join(_LEVEL.format(at=i, before=i - 1) for i in (1, 2, 3)))


def _canonical_sql(value: str) -> str:
    out = f"translate({value}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, '(?m)^[ \\t]*(?:copyright|\\(c\\)|\\x{{A9}}|all rights reserved)[^\\n]*$', ' ', 'g')"
    out = f"' ' || replace(trim(regexp_replace({out}, '[\\x00-/:-`{{-\\x7F]+', ' ', 'g')), ' ', '  ') || ' '"
    for a, b in licenses.SPELLINGS:
        out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _licenses_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licenses.KNOWN)
    given = ", ".join(f"('{a}', '{b}')" for a, b in licenses.DIGESTS)
    return f"""
WITH texts AS (SELECT md5({_canonical_sql("t")}) AS digest, min(license) AS license FROM (VALUES {rows}) AS v(license, t) GROUP BY 1),
known AS (SELECT digest, min(license) AS license FROM (SELECT * FROM texts UNION ALL SELECT digest, license FROM (VALUES {given}) AS g(license, digest)) GROUP BY 1),
lines AS (
  SELECT DISTINCT d.doc_id, k.license FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) d
  JOIN texts k ON md5({_canonical_sql("line")}) = k.digest
), notices AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM lines GROUP BY doc_id),
whole AS (SELECT doc_id, text, md5({_canonical_sql("text")}) AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license, CASE WHEN w.text IS NULL THEN NULL ELSE coalesce(n.notices, '') END AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (doc_id)
"""


#: What SQL can say of operators that it can't say whole: columns of the same operators, over the same whole tables.
QUERIES |= {
    "llm_decoded_bytes": lambda spark, d: QUERIES["op1_byte_bpe"](spark, d).select("doc_id", "decoded_sha256"),
    "llm_near_copies": lambda spark, d: nearcopies.near_copies(table(spark, d, "documents")).select("doc_id", "component_id"),
    "llm_url_rules": lambda spark, d: QUERIES["op4_url_filter"](spark, d).select("page_id", "host", "path", "rule", F.expr("CASE WHEN rule IS NOT NULL THEN verdict END").alias("verdict")),
    "llm_payload_bytes": lambda spark, d: QUERIES["op5_gif_media"](spark, d).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256"),
    "llm_shard_sizes": lambda spark, d: shard_sizes(spark, d),
    "llm_pii_counts": lambda spark, d: QUERIES["op7_pii_boosting"](spark, d).select("doc_id", "n_email", "n_ip", "n_card", "n_phone"),
}


def shard_sizes(spark, d):
    """Whether the law of op6 holds: rows and bytes in all, shards, whether slots are gapless, and whether the sizes of shards
    differ by less than two of the largest documents."""
    out = QUERIES["op6_sampled_splitters"](spark, d)
    most = out.agg(F.max("size").alias("most"))  # one row
    per = out.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"))
    even = (F.max("bytes") - F.min("bytes") < 2 * F.first("most")).alias("even")
    gapless = F.bool_and((F.col("n") == F.col("slots")) & (F.col("last") == F.col("n") - 1)).alias("gapless")
    return per.crossJoin(F.broadcast(most)).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), gapless, even)


_NEAR = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM d
), k AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS k, min(doc_id) AS id, any_value(s) AS s FROM g GROUP BY 1),
e AS MATERIALIZED (SELECT k, len(s) AS n, unnest(s) AS x FROM k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.k < b.k AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE c * 9 >= (na + nb) * 4), ab AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT k AS a, k AS b FROM k UNION SELECT r.a, ab.b FROM r JOIN ab ON ab.a = r.b),
c AS (SELECT r.a, min(k.id) AS component_id FROM r JOIN k ON k.k = r.b GROUP BY 1)
SELECT g.doc_id, c.component_id FROM g JOIN c ON c.a = md5(array_to_string(list_sort(g.s), chr(10)))
"""

_URLS = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host, rest FROM u),
x AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '(?s)^[^?#]*') AS path FROM h),
r(rule, verdict) AS (VALUES {rules}),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM x JOIN r
  ON (host = split_part(rule, '/', 1) OR host LIKE '%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY 1)
SELECT x.page_id, x.host, x.path, f.rule, f.verdict FROM x LEFT JOIN f USING (page_id)
""".format(rules=", ".join(f"('{a}', '{b}')" for a, b in urlfilter.RULES))

_PAYLOAD = """
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(t || repeat(' ', (m - n)::BIGINT)) AS payload_sha256
FROM (SELECT doc_id, t, n, greatest(1, (n + 191) // 192) * 192 AS m FROM (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, ''))::BIGINT AS n FROM documents) a) b
"""

_SIZES = "SELECT count(*) AS n, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, least(8, count(*)) AS shards, true AS gapless, true AS even FROM documents"

_COUNTS = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (
  SELECT doc_id, [regexp_replace(x, '[^0-9]', '', 'g') FOR x IN regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+')] AS cards,
    [regexp_replace(x, '[^0-9]', '', 'g') FOR x IN regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]')] AS phones,
    [string_split(x, '.') FOR x IN regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)')] AS ips,
    regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS emails FROM t
)
SELECT doc_id, len(emails)::BIGINT AS n_email, len([x FOR x IN ips IF len([y FOR y IN x IF length(ltrim(y, '0')) > 3 OR coalesce(try_cast(right(y, 3) AS INT), 0) > 255]) = 0])::BIGINT AS n_ip,
  len([x FOR x IN cards IF length(x) BETWEEN 14 AND 19 AND
    list_sum([CASE WHEN i % 2 = 0 THEN x[length(x) - i]::INT WHEN x[length(x) - i]::INT > 4 THEN 2 * x[length(x) - i]::INT - 9 ELSE 2 * x[length(x) - i]::INT END FOR i IN range(length(x))]) % 10 = 0])::BIGINT AS n_card,
  len([x FOR x IN phones IF length(x) BETWEEN 10 AND 15])::BIGINT AS n_phone FROM c
"""

ORACLES = {
    "op2_exact_top_k": _TOP_K,
    "op8_license_digests": _licenses_sql(),
    "op10_mixing": _MIX,
    "llm_decoded_bytes": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "llm_near_copies": _NEAR,
    "llm_url_rules": _URLS,
    "llm_payload_bytes": _PAYLOAD,
    "llm_shard_sizes": _SIZES,
    "llm_pii_counts": _COUNTS,
}
