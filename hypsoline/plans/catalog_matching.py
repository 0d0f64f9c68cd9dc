"""Registered queries: hybrid matching of names, classification cascades, enriched documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import resolution as R
from ..registry import register


def names(m):
    """(id, name, v): the distinct names of parts, with the vector of their smallest key."""
    one = m.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return one.join(m.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id").select("id", "name", "v")


NAMES = """nm AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name),
nv AS MATERIALIZED (SELECT nm.id, nm.name, e.embedding::DOUBLE[] AS v FROM nm JOIN embeddings e ON e.vec_id = nm.id)"""
WORDS = f"""{NAMES}, sp AS (SELECT id, [x FOR x IN regexp_split_to_array(lower(trim(name)), '\\s+') IF x <> ''] AS l FROM nv),
tf AS (SELECT id, len(l) AS len, w, count(*) AS tf FROM (SELECT id, l, unnest(l) AS w FROM sp) t GROUP BY id, len(l), w),
tot AS (SELECT count(*) AS n, avg(len(l)) AS a FROM sp), df AS (SELECT w, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM tf, tot GROUP BY w, n),
ix AS (SELECT w, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM df) ELSE idf END AS idf FROM df),
sc AS (SELECT q.id AS qid, d.id, round(sum(q.tf * ix.idf * d.tf * 2.5::DOUBLE / (d.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.len / tot.a))), 9) AS s
FROM tf q JOIN ix USING (w) JOIN tf d ON d.w = q.w, tot GROUP BY 1, 2),
kn AS (SELECT qid, id, round(s / CASE WHEN most > 0 THEN most ELSE 1 END, 9) AS score FROM (SELECT *, max(s) OVER (PARTITION BY qid) AS most FROM sc) t),
kw AS (SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM kn) t WHERE r <= 20)"""
COSINES = """cs AS MATERIALIZED (SELECT a.id AS qid, b.id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS score FROM nv a, nv b)"""


def pairs_sql(keyword: float, meaning: float, threshold: float) -> str:
    return f"""{WORDS}, {COSINES}, sm AS (SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM cs) t WHERE r <= 20),
bo AS (SELECT coalesce(kw.qid, sm.qid) AS qid, coalesce(kw.id, sm.id) AS id, round({keyword}::DOUBLE * coalesce(kw.score, 0) + {meaning}::DOUBLE * coalesce(sm.score, 0), 6) AS s
FROM kw FULL JOIN sm ON kw.qid = sm.qid AND kw.id = sm.id),
pr AS (SELECT least(qid, id) AS src, greatest(qid, id) AS dst, arg_min(s, qid) AS similarity FROM bo WHERE qid <> id AND s >= {threshold} GROUP BY 1, 2)"""


#: The test vectors are far from each other; the operators' own thresholds would leave hardly an edge.
LOW = 0.45
register("sea11_okapi", lambda m: M.okapi(names(m)).withColumn("score", F.round("score", 6)), f"{WORDS} SELECT qid, id, round(score, 6) AS score FROM kw")
register("ent10_similarity_graph", lambda m: M.similarity_graph(names(m).drop("v"), names(m), threshold=LOW), f"{pairs_sql(0.4, 0.6, LOW)} SELECT src, dst, similarity FROM pr")
register("ent18_canonical_graph", lambda m: M.similarity_graph(names(m).drop("v"), names(m), M.CANONICAL, LOW), f"{pairs_sql(0.3, 0.7, LOW)} SELECT src, dst, similarity FROM pr")


def cluster_records(m):
    n = names(m)
    graph = M.similarity_graph(n.drop("v"), n, threshold=LOW)
    labels = M.cluster_labels(n, graph)
    count = m.part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("occurrences"))
    out = M.cluster_records(n.drop("v").join(count, "name"), labels, graph)
    listed = F.array_join(F.transform("members", lambda x: F.concat(x["name"], F.lit(":"), x["occurrences"].cast("string"))), ",")
    return out.withColumn("members", listed)


COMPONENTS = f"""RECURSIVE {pairs_sql(0.4, 0.6, LOW)}, ed AS (SELECT src, dst FROM pr UNION ALL SELECT dst, src FROM pr),
reach AS (SELECT id, id AS other FROM nv UNION SELECT r.id, ed.dst FROM reach r JOIN ed ON ed.src = r.other), lb AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id)"""
register("ent11_cluster_records", cluster_records, f"""{COMPONENTS}, oc AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1),
me AS (SELECT lb.cluster, nv.name, oc.n FROM lb JOIN nv USING (id) JOIN oc ON oc.name = nv.name),
av AS (SELECT a.cluster, avg(similarity) AS s FROM pr JOIN lb a ON a.id = src GROUP BY 1)
SELECT cluster, arg_min(name, (-n, name)) AS canonical, string_agg(name || ':' || n, ',' ORDER BY name) AS members, count(*) AS size, round(coalesce(any_value(s), 1), 6) AS avg_similarity
FROM me LEFT JOIN av USING (cluster) GROUP BY cluster""")


def renamed(m):
    """New entries beside the names: every third with a name of its own, the others with an `s`, all with the same vectors."""
    n = names(m)
    return n.withColumn("name", F.when(F.col("id") % 3 == 0, F.lit("unheard of")).otherwise(F.concat("name", F.lit("s"))))


#: Only a name's own vector has a cosine of .75 or more to it.
register("ent15_duplicates", lambda m: M.duplicates_of(renamed(m), names(m)), f"""{NAMES}
SELECT id, id AS dup, round(0.4::DOUBLE * (2.0::DOUBLE * length(name) / (2 * length(name) + 1)) + 0.6::DOUBLE, 6) AS score FROM nv WHERE id % 3 <> 0""")


def merged(m):
    old = names(m).where("id % 2 = 0").withColumn("variants", F.array("name"))
    new = renamed(m).withColumn("variants", F.array("name", F.concat("name", F.lit(" II"))))
    out = M.merge_results(old, new)
    return out.select("name", F.array_join("variants", ",").alias("variants"), "is_new")


register("ent16_merge_results", merged, f"""{NAMES}, rn AS (SELECT id, name AS was, CASE WHEN id % 3 = 0 THEN 'unheard of' ELSE name || 's' END AS name FROM nv)
SELECT was AS name, was || CASE WHEN id % 3 <> 0 THEN ',' || name || ',' || name || ' II' ELSE '' END AS variants, false AS is_new FROM rn WHERE id % 2 = 0
UNION ALL SELECT name, name || ',' || name || ' II', true FROM rn WHERE id % 2 <> 0 OR id % 3 = 0""")
register("ent14_add_variants", lambda m: M.add_variants(names(m).select("id", F.array("name").alias("variants")), m.part.join(names(m).select("id", "name"), F.col("p_name") == F.col("name")).select("id", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("name"))).select("id", F.array_join("variants", ",").alias("variants")), f"""{NAMES}
SELECT nv.id, concat_ws(',', nv.name, b) AS variants FROM nv LEFT JOIN (SELECT p_name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS b FROM part WHERE p_partkey % 2 <> 0 GROUP BY 1) t ON p_name = nv.name""")
register("ent17_rich_text", lambda m: m.part.select("p_partkey", M.rich_text(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")), F.repeat("p_brand", 20)).alias("text")), """
SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN '. Domain: ' || p_type ELSE '' END || '. ' || repeat(p_brand, 20)[1:100] AS text FROM part""")
register("ent29_index_text", lambda m: m.part.select("p_partkey", M.index_text(F.col("p_name"), F.filter(F.array("p_brand", "p_type"), lambda x: F.col("p_size") > 25), F.col("p_type")).alias("text")), """
SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN ' | Variants: ' || p_brand || ', ' || p_type ELSE '' END || ' | Description: ' || p_type AS text FROM part""")
register("ent26_near_duplicates", lambda m: M.near_duplicates(m.part.select("p_name").withColumnRenamed("p_name", "name")))
register("ent26_buckets", lambda m: M.near_duplicate_buckets(M.near_duplicates(m.part.select(F.col("p_name").alias("name")))))
register("ent28_final_catalog", lambda m: R.merged(m.part.select(F.col("p_type").alias("cluster"), F.col("p_name").alias("name"), F.array("p_brand").alias("variants"), F.lit(True).alias("in_catalog"), F.lit(1).cast("long").alias("occurrences"))).agg(F.count("*").alias("technologies"), F.sum(F.size("variants")).alias("variants"), F.sum("occurrences").alias("occurrences")), """
SELECT count(DISTINCT p_type) AS technologies, count(DISTINCT p_type || p_brand) AS variants, count(*) AS occurrences FROM part""")


def catalog(m):
    return names(m).select("id", "name", F.array(F.concat(F.lit("P"), "id")).alias("aliases"), "v")


def queries(m):
    """Mentions, one a vector: a catalogue name in capitals, an alias, or a name that only its vector can match."""
    n = names(m).select("id", "name")
    rows = m.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")).join(n, F.col("qid") == F.col("id"), "left")
    kind = F.col("qid") % 3
    name = F.when((kind == 0) & F.col("name").isNotNull(), F.upper("name")).when(kind == 1, F.concat(F.lit("p"), "qid")).otherwise(F.concat(F.lit("mention "), "qid"))
    return rows.select("qid", name.alias("name"), "qv")


CLASSIFY = f"""{NAMES}, qs AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv, CASE WHEN vec_id % 3 = 0 AND nm.name IS NOT NULL THEN upper(nm.name) WHEN vec_id % 3 = 1 THEN 'p' || vec_id ELSE 'mention ' || vec_id END AS name
FROM embeddings LEFT JOIN nv nm ON nm.id = vec_id), al AS (SELECT lower(name) AS k, min(id) AS id FROM (SELECT name, id FROM nv UNION ALL SELECT 'P' || id, id FROM nv) t GROUP BY 1),
ex AS (SELECT qs.*, al.id AS exact_id FROM qs LEFT JOIN al ON al.k = lower(qs.name)),
sv AS (SELECT ex.qid, nv.id, round(list_dot_product(ex.qv, nv.v) / (sqrt(list_dot_product(ex.qv, ex.qv)) * sqrt(list_dot_product(nv.v, nv.v))), 9) AS score FROM ex, nv),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM sv WHERE score >= {{threshold}})"""


def classified(m, threshold, tickers=None):
    out = M.classify(queries(m), catalog(m), threshold, tickers)
    return out.select("qid", "name", "id", F.round("score", 6).alias("score"), "method", "confidence", F.array_join(F.col("alternatives").cast("array<string>"), ",").alias("alternatives"))


LEVEL = "CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.75 THEN 'medium' ELSE 'low' END AS confidence"
register("ent32_classify", lambda m: classified(m, 0.3), f"""{CLASSIFY.format(threshold=0.3)}
SELECT qid, name, id, round(score, 6) AS score, method, {LEVEL}, alternatives FROM (
SELECT ex.qid, ex.name, coalesce(exact_id, a.id) AS id, CASE WHEN exact_id IS NOT NULL THEN 1.0 ELSE coalesce(a.score, 0) END::DOUBLE AS score, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN a.id IS NOT NULL THEN 'vector' ELSE 'none' END AS method,
CASE WHEN exact_id IS NOT NULL THEN '' ELSE concat_ws(',', b.id, c.id) END AS alternatives
FROM ex LEFT JOIN rk a ON a.qid = ex.qid AND a.r = 1 LEFT JOIN rk b ON b.qid = ex.qid AND b.r = 2 LEFT JOIN rk c ON c.qid = ex.qid AND c.r = 3) t""")


def tickers(m):
    return names(m).where("id % 2 = 1").select(F.concat(F.lit("MENTION "), "id").alias("ticker"), "id")


register("ent37_classify_company", lambda m: classified(m, 0.25, tickers(m)), f"""{CLASSIFY.format(threshold=0.25)}
SELECT qid, name, id, round(score, 6) AS score, method, {LEVEL}, alternatives FROM (
SELECT ex.qid, ex.name, coalesce(t.id, exact_id, a.id) AS id, CASE WHEN t.id IS NOT NULL OR exact_id IS NOT NULL THEN 1.0 ELSE coalesce(a.score, 0) END::DOUBLE AS score,
CASE WHEN t.id IS NOT NULL THEN 'ticker' WHEN exact_id IS NOT NULL THEN 'exact' WHEN a.id IS NOT NULL THEN 'vector' ELSE 'none' END AS method,
CASE WHEN t.id IS NOT NULL OR exact_id IS NOT NULL THEN '' ELSE concat_ws(',', b.id, c.id) END AS alternatives
FROM ex LEFT JOIN nv t ON t.id % 2 = 1 AND upper(ex.name) = 'MENTION ' || t.id LEFT JOIN rk a ON a.qid = ex.qid AND a.r = 1 LEFT JOIN rk b ON b.qid = ex.qid AND b.r = 2 LEFT JOIN rk c ON c.qid = ex.qid AND c.r = 3) u""")


def mapped_back(m):
    mentions = m.part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.upper("p_name")).alias("name"))
    distinct = mentions.select(F.col("name").alias("qid"), "name", F.lit(None).cast("array<float>").alias("qv")).distinct()
    return M.map_back(mentions, M.classify(distinct, catalog(m), 0.85)).select("p_partkey", "id", "method")


register("ent38_map_back", mapped_back, f"{NAMES} SELECT p_partkey, nv.id, CASE WHEN nv.id IS NULL THEN 'none' ELSE 'exact' END AS method FROM part LEFT JOIN nv ON nv.name = p_name AND p_partkey % 4 <> 0")


def annotated(m):
    """Documents with their mentions as an array, in the order of lines, annotated by a catalogue of every second technology."""
    item = F.struct("seq", F.concat(F.lit("T"), "tech_id").alias("name"), "role")
    docs = m.mention_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("tech_mentions"))
    matches = m.technologies.where("id % 2 = 0").select(F.concat(F.lit("T"), "id").alias("name"), F.col("name").alias("canonical"), "id", F.when(F.col("id") % 4 == 0, "high").otherwise("medium").alias("confidence"))
    return M.normalize_documents(docs, {"tech_mentions": ["name"]}, matches)


ANNOTATED = """an AS (SELECT r.doc_id, r.seq, r.role, t.id, coalesce(t.name, 'Unknown') AS normalized_name, CASE WHEN t.id IS NULL THEN 'low' WHEN t.id % 4 = 0 THEN 'high' ELSE 'medium' END AS confidence
FROM mention_rows r LEFT JOIN technologies t ON t.id = r.tech_id AND t.id % 2 = 0)"""
register("ent40_normalize_documents", lambda m: annotated(m).select("doc_id", F.explode("tech_mentions").alias("x")).select("doc_id", "x.seq", "x.role", "x.normalized_name", F.col("x.name_id").alias("id"), F.col("x.name_confidence").alias("confidence")), f"{ANNOTATED} SELECT doc_id, seq, role, normalized_name, id, confidence FROM an")


def enriched(m):
    docs = annotated(m).withColumn("ids", M.entity_ids([F.transform("tech_mentions", lambda x: x["name_id"])]))
    out = M.with_entities(docs, "ids", m.technologies.where("id % 3 <> 0").select("id", "name", "domain"), "technologies")
    listed = F.array_join(F.transform("technologies", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["domain"])), ",")
    return out.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), listed.alias("technologies"))


register("ent41_enriched", enriched, f"""{ANNOTATED}, d AS (SELECT DISTINCT doc_id, id FROM an)
SELECT doc_id, coalesce(string_agg(d.id, ',' ORDER BY d.id), '') AS ids, coalesce(string_agg(t.id || ':' || t.domain, ',' ORDER BY t.id), '') AS technologies FROM d LEFT JOIN technologies t ON t.id = d.id AND t.id % 3 <> 0 GROUP BY doc_id""")
register("ent42_final_names", lambda m: annotated(m).select("doc_id", F.explode(M.final_names(F.col("tech_mentions"), "name", ["role"])).alias("x")).select("doc_id", "x.*").withColumnRenamed("name_id", "id"), f"{ANNOTATED} SELECT doc_id, seq, normalized_name AS name, id FROM an")
register("ent43_match_statistics", lambda m: M.match_statistics(annotated(m).select(F.explode("tech_mentions").alias("x")).select(F.col("x.normalized_name").alias("normalized"), F.col("x.name_confidence").alias("confidence"))), f"""{ANNOTATED}
SELECT count(*) AS total, count(id) AS matched, count_if(confidence = 'high')::BIGINT AS high, count_if(confidence = 'medium')::BIGINT AS medium, 0::BIGINT AS low FROM an""")
