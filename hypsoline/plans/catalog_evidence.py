"""Registered queries: citations, communities, discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations as C
from ..operators import communities as M
from ..registry import register
from .catalog_layers import MD, window
from .model import AS_OF

RECENT = f"published_at >= DATE '{AS_OF}' - 730 AND published_at <= DATE '{AS_OF}'"

for i, layer in enumerate(C.LAYERS, 2):
    types, roles = (", ".join(f"'{x}'" for x in xs) for xs in C.LAYERS[layer])
    register(f"cit{i}_{layer}_citations", lambda m, layer=layer: C.citations(m.mention_docs, layer, "1999-08-01", AS_OF), f"""
    SELECT tech_id, rank, doc_id, strength, contribution FROM (SELECT tech_id, doc_id, round(strength, 6) AS strength, CASE doc_type WHEN 'sec_filing' THEN 'Sec Filing' WHEN 'technical_paper' THEN 'Technical Paper' WHEN 'government_contract' THEN 'Government Contract'
    ELSE upper(doc_type[1]) || doc_type[2:] END || ' - ' || upper(role[1]) || role[2:] AS contribution, row_number() OVER (PARTITION BY tech_id ORDER BY strength DESC, evidence_confidence DESC, published_at DESC, doc_id)::INT AS rank
    FROM {MD} AND doc_type IN ({types}) AND role IN ({roles}) AND evidence_confidence >= 0.75 AND {window()}) t WHERE rank <= 5""")

register("cit1_layer_citations", lambda m: C.layer_citations(m.mention_docs, ["patent", "news"], ["invented", "subject"], "2000-01-01", None, 3, 0.9).drop("contribution"), f"""
SELECT tech_id, rank, doc_id, strength FROM (SELECT tech_id, doc_id, round(strength, 6) AS strength, row_number() OVER (PARTITION BY tech_id ORDER BY strength DESC, evidence_confidence DESC, published_at DESC, doc_id)::INT AS rank
FROM {MD} AND doc_type IN ('patent', 'news') AND role IN ('invented', 'subject') AND evidence_confidence >= 0.9 AND published_at >= DATE '2000-01-01') t WHERE rank <= 3""")
register("cit6_evidence_distribution", lambda m: C.evidence_distribution(m.mention_docs, AS_OF), f"""
SELECT tech_id, doc_type, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:3], ',') AS sample FROM {MD} AND {RECENT} GROUP BY tech_id, doc_type""")
register("cit7_co_mentions", lambda m: C.co_mentions(m.mention_docs, AS_OF), f"""
x AS (SELECT tech_id, doc_id, doc_type FROM {MD} AND {RECENT}), p AS (SELECT a.tech_id, b.tech_id AS other_id, count(DISTINCT a.doc_id) AS shared_docs, count(DISTINCT a.doc_type) AS doc_types, min(a.doc_id) AS sample_doc
FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.tech_id <> b.tech_id GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tech_id ORDER BY shared_docs DESC, doc_types DESC, other_id)::INT AS rank FROM p) t WHERE rank <= 10""")
register("cit8_provenance", lambda m: C.provenance(m.company_tech, m.mention_docs, m.companies, AS_OF), f"""
x AS (SELECT tech_id, doc_id, published_at, strength FROM {MD} AND published_at >= DATE '{AS_OF}' - 365 AND published_at <= DATE '{AS_OF}')
SELECT tech_id, rank, company, relation_type, doc_id, doc_ref FROM (SELECT x.tech_id, c.name AS company, e.relation_type, x.doc_id, e.doc_ref,
row_number() OVER (PARTITION BY x.tech_id ORDER BY e.evidence_confidence DESC, x.strength DESC, x.published_at DESC, x.doc_id, c.name, e.doc_ref)::INT AS rank
FROM x JOIN company_tech e ON e.dst = x.tech_id JOIN companies c ON c.id = e.src) t WHERE rank <= 10""")
register("cit9_triplets", lambda m: C.triplets(m.mention_docs, m.technologies, AS_OF), f"""
SELECT tech_id, rank, subject, predicate, object FROM (SELECT x.tech_id, t.name AS subject, x.role AS predicate, x.title AS object, row_number() OVER (PARTITION BY x.tech_id ORDER BY x.evidence_confidence DESC, x.doc_id)::INT AS rank
FROM (SELECT * FROM {MD} AND {RECENT}) x JOIN technologies t ON t.id = x.tech_id) y WHERE rank <= 20""")


def members(m):
    brand = lambda c: F.concat(F.lit("Brand#"), (c % 5 + 1).cast("int"), (c % 5 + 1).cast("int"))
    return M.members(m.technologies, m.companies, m.documents_g, brand(F.col("id")), brand(F.col("doc_id")))


MEMBERS = """g AS (SELECT community, 'Technology' AS label, id::VARCHAR AS node_id, name, coalesce(pagerank, 0) AS importance FROM technologies
UNION ALL SELECT 'Brand#' || (id % 5 + 1) || (id % 5 + 1), 'Company', id::VARCHAR, name, coalesce(pagerank, 0) FROM companies
UNION ALL SELECT 'Brand#' || (doc_id % 5 + 1) || (doc_id % 5 + 1), 'Document', doc_id::VARCHAR, coalesce(title, doc_id::VARCHAR), coalesce(pagerank, 0) FROM documents_g)"""
register("com1_technology_community", lambda m: m.technologies.select(F.col("id").alias("tech_id"), "community"), "SELECT id AS tech_id, community FROM technologies")
register("com5_members", lambda m: M.top_members(members(m)), f"""{MEMBERS} SELECT community, rank, label, node_id, name FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY importance DESC NULLS LAST, label, node_id)::INT AS rank FROM g) t WHERE rank <= 25""")
register("com7_composition", lambda m: M.composition(members(m)), f"""{MEMBERS} SELECT community, count_if(label = 'Technology')::BIGINT AS tech_count, count_if(label = 'Company')::BIGINT AS company_count, count_if(label = 'Document')::BIGINT AS doc_count,
round(avg(importance), 6) AS avg_pagerank, round(CASE WHEN count_if(label = 'Technology') > 0 THEN count_if(label = 'Company')::DOUBLE / count_if(label = 'Technology')::DOUBLE ELSE 0 END, 6) AS companies_per_tech FROM g GROUP BY community""")
register("com6_related", lambda m: M.related(m.technologies), """SELECT tech_id, rank, other_id FROM (SELECT a.id AS tech_id, b.id AS other_id, row_number() OVER (PARTITION BY a.id ORDER BY b.pagerank DESC, b.id)::INT AS rank
FROM technologies a JOIN technologies b ON a.community = b.community AND a.id <> b.id) t WHERE rank <= 10""")
register("com8_bridges", lambda m: M.bridges(m.technologies), "SELECT id, community, betweenness FROM technologies WHERE betweenness >= 100 ORDER BY betweenness DESC, id LIMIT 5")
HIST = f"""s AS (SELECT community, count(*) AS member_count FROM technologies GROUP BY 1), h AS (SELECT community, count_if(doc_type = 'patent') AS p, count_if(doc_type = 'news') AS n, count_if(doc_type = 'government_contract') AS c, count(*) AS d
FROM (SELECT DISTINCT t.community, x.doc_id, x.doc_type FROM (SELECT * FROM {MD}) x JOIN technologies t ON t.id = x.tech_id) y GROUP BY 1),
k AS (SELECT s.community, member_count, coalesce(p, 0)::BIGINT AS n_patent, coalesce(n, 0)::BIGINT AS n_news, coalesce(c, 0)::BIGINT AS n_government_contract, coalesce(d, 0)::BIGINT AS docs FROM s LEFT JOIN h USING (community)),
z AS (SELECT *, CASE WHEN n_patent + n_news + n_government_contract < 10 THEN CASE WHEN n_government_contract >= 2 AND (n_patent >= 1 OR n_news >= 1) THEN 'late' WHEN n_patent > n_news AND n_government_contract <= 1 THEN 'early'
WHEN n_news > n_patent AND n_government_contract <= 1 THEN 'hype' ELSE 'mid' END ELSE CASE WHEN n_patent / (n_news + 1) > 2 AND n_government_contract < 5 THEN 'early' WHEN n_news / (n_patent + 1) > 1.5 AND n_government_contract < 5 THEN 'hype'
WHEN n_government_contract >= 3 AND n_patent > 2 THEN 'late' ELSE 'mid' END END AS stage FROM k)"""
register("com11_doc_histogram", lambda m: M.doc_histogram(m.mention_docs, m.technologies), f"{HIST} SELECT * FROM k")
register("dis3_maturity", lambda m: M.classified(M.doc_histogram(m.mention_docs, m.technologies)), f"{HIST} SELECT * FROM z")
register("com9_large_communities", lambda m: M.doc_histogram(m.mention_docs, m.technologies).where("member_count >= 5").select("community", "member_count"), "SELECT community, count(*) AS member_count FROM technologies GROUP BY 1 HAVING count(*) >= 5")
register("com10_community_list", lambda m: m.technologies.select("community").distinct(), "SELECT DISTINCT community FROM technologies")
register("com12_cost_estimate", lambda m: m.technologies.groupBy("community").count().agg(F.count("*").alias("communities"), F.sum("count").alias("members"), F.round(F.sum(F.lit(500) + 40 * F.col("count")) * 1e-6 * 0.15, 8).alias("cost")),
         "SELECT count(*) AS communities, sum(n)::BIGINT AS members, round(sum(500 + 40 * n) * 1e-6 * 0.15, 8) AS cost FROM (SELECT community, count(*) AS n FROM technologies GROUP BY 1) t")


def community_summaries(m):
    tops = F.transform(F.slice(F.array_sort(F.collect_list("name")), 1, 5), lambda x: x)
    return m.technologies.groupBy("community").agg(F.concat(F.lit("Group "), F.first("community"), F.lit(" of "), F.count("*").cast("string")).alias("summary"), tops.alias("top_technologies"))


register("com3_text_search", lambda m: M.text_search(community_summaries(m), "brand#1").select("community", "summary"), "SELECT community, 'Group ' || community || ' of ' || count(*) AS summary FROM technologies GROUP BY community HAVING contains(lower('Group ' || community || ' of ' || count(*)), 'brand#1') OR len([x FOR x IN list_sort(list(name))[1:5] IF contains(lower(x), 'brand#1')]) > 0")
register("com2_histogram_json", lambda m: M.doc_histogram(m.mention_docs, m.technologies).select("community", F.try_element_at(F.from_json(F.to_json(F.struct("n_patent", "n_news")), "map<string,bigint>"), F.lit("n_patent")).alias("n_patent")), f"{HIST} SELECT community, n_patent FROM k")

FOUND = f"""e AS (SELECT tech_id, doc_type, count(DISTINCT doc_id) AS n FROM {MD} GROUP BY 1, 2), v AS (SELECT t.id AS tech_id, t.name, t.community, t.pagerank, sum(e.n)::BIGINT AS document_count, count(*) AS type_count,
array_to_string(list_sort(list(e.doc_type || ':' || e.n)), ',') AS types FROM e JOIN technologies t ON t.id = e.tech_id GROUP BY ALL)"""
register("dis1_discover", lambda m: M.discover(m.mention_docs, m.technologies, 5).withColumn("pagerank", F.round("pagerank", 9)), f"{FOUND} SELECT tech_id, name, community, round(pagerank, 9) AS pagerank, document_count, type_count, types FROM v WHERE document_count >= 5")
register("dis2_total", lambda m: M.discover(m.mention_docs, m.technologies).agg(F.countDistinct("tech_id").alias("total")), f"SELECT count(DISTINCT tech_id) AS total FROM {MD} AND tech_id IN (SELECT id FROM technologies)")
register("dis6_domain", lambda m: M.discover(m.mention_docs, m.technologies, 1, "ECONOMY").select("tech_id", "document_count"), f"{FOUND} SELECT tech_id, document_count FROM v WHERE tech_id IN (SELECT id FROM technologies WHERE domain = 'ECONOMY')")
ORDER = "pagerank DESC, type_count DESC, document_count DESC, tech_id"
register("dis4_sample_communities", lambda m: M.top_k(M.discover(m.mention_docs, m.technologies).where(F.col("community").isin("Brand#11", "Brand#22") & ~F.col("tech_id").isin(1, 2, 3)).withColumn("all", F.lit(1)), ["all"], [F.desc("pagerank"), F.desc("type_count"), F.desc("document_count"), F.col("tech_id")], 20).select("tech_id", "rank"),
         f"{FOUND} SELECT tech_id, row_number() OVER (ORDER BY {ORDER})::INT AS rank FROM v WHERE community IN ('Brand#11', 'Brand#22') AND tech_id NOT IN (1, 2, 3) ORDER BY {ORDER} LIMIT 20")
SHARES = {"early": 0.2, "mid": 0.4, "late": 0.2, "hype": 0.2}
register("dis5_stratified", lambda m: M.sample_discovery(M.discover(m.mention_docs, m.technologies), M.classified(M.doc_histogram(m.mention_docs, m.technologies)), 100, SHARES), f"""{HIST}, {FOUND},
w AS (SELECT v.*, z.stage, row_number() OVER (PARTITION BY z.stage ORDER BY {ORDER}) AS i, CASE z.stage WHEN 'mid' THEN 80 ELSE 40 END AS most, CASE z.stage WHEN 'early' THEN 0 WHEN 'mid' THEN 1 WHEN 'late' THEN 2 ELSE 3 END AS o FROM v JOIN z USING (community))
SELECT tech_id, community, stage, document_count FROM w ORDER BY (i > most), CASE WHEN i <= most THEN o END, CASE WHEN i <= most THEN i END, {ORDER} LIMIT 100""")
