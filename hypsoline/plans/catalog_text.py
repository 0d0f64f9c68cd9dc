"""Registered queries: scalar functions, search, entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import resolution as R
from ..operators import search as Q
from ..registry import register

# scalar functions

DOMAIN = "regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^www\\.', '')"
register("sca1_outlet_tier", lambda m: m.pages.select("page_id", S.outlet_tier(F.concat(F.when(F.col("page_id") % 3 == 0, "fool.").when(F.col("page_id") % 3 == 1, "www.Reuters.").otherwise("x."), F.lit("com"))).alias("tier")), "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Mainstream Media' WHEN 1 THEN 'Financial Authority' ELSE 'Niche/Aggregator' END AS tier FROM pages")
register("sca3_article_id", lambda m: m.pages.select("page_id", S.md5_id("news_article_", F.col("url")).alias("doc_id")), "SELECT page_id, 'news_article_' || md5(url)[1:12] AS doc_id FROM pages")
register("sca4_domain", lambda m: m.pages.select("page_id", S.domain_of(F.col("url")).alias("domain")), f"SELECT page_id, {DOMAIN} AS domain FROM pages")
register("sca5_publisher", lambda m: m.pages.select("page_id", S.publisher_name(S.domain_of(F.col("url"))).alias("publisher")), f"SELECT page_id, array_to_string([array_to_string([upper(y[1]) || y[2:] FOR y IN string_split(x, '-')], '-') FOR x IN string_split(p, ' ')], ' ') AS publisher FROM (SELECT page_id, replace(replace({DOMAIN}, '.com', ''), '.', ' ') AS p FROM pages) t")
register("sca6_duration", lambda m: m.orders.select("o_orderkey", S.days_between(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("2001-08-01")).alias("days")), "SELECT o_orderkey, (DATE '2001-08-01' - o_orderdate::DATE)::INT AS days FROM orders")
register("sca7_contract_size", lambda m: m.orders.select("o_orderkey", S.contract_size(F.col("o_totalprice")).alias("size")), "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 1000000 THEN 'medium' ELSE 'large' END AS size FROM orders")
register("sca9_award_id", lambda m: m.part.select("p_partkey", S.award_id(F.concat("p_brand", F.lit("/"), "p_type", F.lit("-1 a"))).alias("id")), "SELECT p_partkey, translate(p_brand || '/' || p_type || '-1 a', '/- ', '___') AS id FROM part")
register("sca20_slug", lambda m: m.part.select("p_partkey", S.slug(F.concat(F.lit("#"), "p_name", F.lit(" (x)"))).alias("slug")), "SELECT p_partkey, trim(regexp_replace(lower('#' || p_name || ' (x)'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
register("sca22_fiscal_quarter", lambda m: m.documents_g.select("doc_id", S.fiscal_quarter(F.col("published_at"), F.col("filing_type")).alias("quarter")), "SELECT doc_id, CASE WHEN filing_type = '10-K' THEN 'Q4' ELSE 'Q' || quarter(published_at) END AS quarter FROM documents_g")
register("sca23_strip_tags", lambda m: m.pages.select("page_id", F.md5(S.strip_tags(F.col("html")).cast("binary")).alias("text_md5")), "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
register("sca26_legal_status", lambda m: m.documents_g.select("doc_id", S.legal_status(F.col("risk_factor_mentioned"), F.when(F.col("stars") < 100, F.lit("x")), F.add_months("published_at", 60), "2001-08-01").alias("status")), "SELECT doc_id, CASE WHEN NOT risk_factor_mentioned THEN 'pending' WHEN stars < 100 THEN 'abandoned' WHEN published_at + INTERVAL 60 MONTH < DATE '2001-08-01' THEN 'expired' ELSE 'granted' END AS status FROM documents_g")
register("sca32_filing_title", lambda m: m.documents_g.select("doc_id", S.filing_title(F.col("agency"), F.col("filing_type"), F.col("published_at").cast("string")).alias("title")), "SELECT doc_id, concat_ws(' - ', agency, filing_type, published_at::VARCHAR) AS title FROM documents_g")
register("sca35_evidence", lambda m: m.documents.select("doc_id", F.md5(S.evidence(F.col("text")).cast("binary")).alias("head_md5")), "SELECT doc_id, md5(text[1:200]) AS head_md5 FROM documents")
register("sca12_header_field", lambda m: m.conversations.select("conv_id", "turn", S.header_field(F.concat(F.lit("X: 1\nROLE: "), "role", F.lit("\nY: 2")), "ROLE").alias("field")), "SELECT conv_id, turn, role AS field FROM conversations")

# search

WORDS = "license version"
BM25 = """t AS (SELECT doc_id, list_filter_words AS w FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{N}]+)', 1) AS list_filter_words FROM documents) q),
f AS (SELECT doc_id, len(w) AS len, len([x FOR x IN w IF x = 'license']) AS f0, len([x FOR x IN w IF x = 'version']) AS f1 FROM t), n AS (SELECT count(*) AS n, avg(len) AS a, count_if(f0 > 0) AS d0, count_if(f1 > 0) AS d1 FROM f),
b AS (SELECT doc_id, round(ln(1 + (n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a)) + ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a)), 6) AS score FROM f, n WHERE f0 + f1 > 0),
bm AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM b ORDER BY rank LIMIT 20)"""
register("sea3_bm25", lambda m: Q.bm25(m.documents, WORDS, F.col("text")), f"{BM25} SELECT doc_id, score, rank FROM bm")


def query_vector(m):
    return [float(x) for x in m.embeddings.where("vec_id = 0").select("embedding").first()[0]]


COSINE = """q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], qv) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qv, qv))), 6) AS score FROM embeddings, q),
vs AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM c WHERE score >= 0.2 ORDER BY rank LIMIT 20)"""
register("sea2_vector_search", lambda m: Q.vector_search(m.embeddings, query_vector(m), 20, 0.2), f"{COSINE} SELECT doc_id, score, rank FROM vs")
HYBRID = f"""{BM25}, {COSINE}, r AS (SELECT doc_id, round(sum(s), 9) AS s FROM (SELECT doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM bm UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + rank) FROM vs) u GROUP BY 1)"""
register("sea1_rrf", lambda m: Q.rrf([Q.bm25(m.documents, WORDS, F.col("text")), Q.vector_search(m.embeddings, query_vector(m), 20, 0.2)]), f"{HYBRID} SELECT doc_id, s AS score FROM r")
register("sea4_hybrid", lambda m: Q.hybrid(Q.bm25(m.documents, WORDS, F.col("text")), Q.vector_search(m.embeddings, query_vector(m), 20, 0.2)), f"{HYBRID}, h AS (SELECT doc_id, round(least(1.0::DOUBLE, s * 10), 6) AS score FROM r) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM h ORDER BY rank LIMIT 10")
register("sea5_restricted", lambda m: Q.restricted(Q.hybrid(Q.bm25(m.documents, WORDS, F.col("text")), Q.vector_search(m.embeddings, query_vector(m), 20, 0.2), 30), m.documents.where("lang = 'en'")), f"""{HYBRID}, h AS (SELECT doc_id, round(least(1.0::DOUBLE, s * 10), 6) AS score FROM r ORDER BY 2 DESC, 1 LIMIT 30)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM h WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY rank LIMIT 10""")
register("sea9_to_embed", lambda m: Q.to_embed(m.documents.join(m.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
register("com4_similar_communities", lambda m: Q.similar_communities(Q.centres(m.embeddings), query_vector(m), -1.0, 5).select(F.col("doc_id").alias("label"), F.round("score", 5).alias("score"), "rank"), """
k AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) t GROUP BY 1, 2), v AS (SELECT label, list(x ORDER BY i) AS v FROM k GROUP BY 1),
q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), c AS (SELECT label, round(list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 6) AS s FROM v, q)
SELECT label, round(s, 5) AS score, row_number() OVER (ORDER BY s DESC, label)::INT AS rank FROM c ORDER BY rank LIMIT 5""")

# entity resolution


def catalog(m):
    return m.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.concat(F.lit("P"), "p_partkey")).alias("aliases"))


def mentions(m):
    odd = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))).when(F.col("p_partkey") % 5 == 1, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))
    return m.part.select(odd.alias("name"), F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string")).alias("role"), (F.col("p_partkey") % 100).alias("doc_id"), (F.col("p_size") / 50).alias("strength"))


MENTIONS = "k AS (SELECT lower(trim(p_name)) AS key, min(p_partkey) AS id FROM part GROUP BY 1 UNION ALL SELECT lower('P' || p_partkey), p_partkey FROM part), m AS (SELECT CASE p_partkey % 5 WHEN 0 THEN ' ' || upper(p_name) || ' ' WHEN 1 THEN p_name || 'x' ELSE p_name END AS name, 'r' || (p_partkey % 3) AS role, p_partkey % 100 AS doc_id, p_size / 50 AS strength FROM part)"
register("ent1_exact", lambda m: R.exact(mentions(m), R.alias_table(catalog(m))).select("name", "id"), f"{MENTIONS} SELECT m.name, k.id FROM m LEFT JOIN k ON k.key = lower(trim(m.name))")
register("ent2_unmatched", lambda m: R.unmatched(mentions(m), R.alias_table(catalog(m))), f"{MENTIONS} SELECT name, count(*) AS n FROM m WHERE lower(trim(name)) NOT IN (SELECT key FROM k) GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
register("ent3_normalize", lambda m: m.conversations.select("conv_id", "turn", F.md5(S.normalize_name(F.col("text")).cast("binary")).alias("md5")), "SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), '[^a-z0-9\\s\\-()/+]', '', 'g'), '\\s+', ' ', 'g'))) AS md5 FROM conversations")
register("ent4_normalized_mentions", lambda m: R.normalized_mentions(mentions(m)), f"""{MENTIONS}, z AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\\s+', ' ', 'g'), '[^a-z0-9\\s\\-()/+]', '', 'g'), '\\s+', ' ', 'g')) AS normalized FROM m),
o AS (SELECT normalized, name, row_number() OVER (PARTITION BY normalized ORDER BY count(*) DESC, name) AS r FROM z GROUP BY 1, 2) SELECT z.normalized, count(*) AS n, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, count(DISTINCT doc_id) AS documents, round(avg(strength), 6) AS avg_strength, any_value(o.name) AS original
FROM z JOIN o ON o.normalized = z.normalized AND o.r = 1 WHERE z.normalized <> '' GROUP BY z.normalized""")


def supplier_catalog(m):
    return m.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("S"), "s_suppkey")).alias("aliases"))


def supplier_mentions(m, *more):
    n = F.col("s_suppkey") % 4
    return m.supplier.select(F.when(n == 0, F.upper("s_name")).when(n == 1, F.concat("s_name", F.lit("s"))).when(n == 2, F.concat(F.lit("Somewhere else "), "s_suppkey")).otherwise(F.col("s_name")).alias("name"), *more)


register("ent8_cascade", lambda m: R.cascade(supplier_mentions(m), supplier_catalog(m)).groupBy("method").agg(F.count("*").alias("n")), """
SELECT method, count(*) AS n FROM (SELECT CASE s_suppkey % 4 WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'none' ELSE 'exact' END AS method FROM supplier) t GROUP BY 1""")
#: Names of suppliers differ in a few digits and are linked all; so are the names that begin with `Somewhere else`.
register("ent10_clusters", lambda m: R.clusters(supplier_mentions(m, "s_suppkey").withColumnRenamed("s_suppkey", "id")), """
SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_suppkey % 4 = 2) AS cluster FROM supplier""")
register("ent13_tech_id", lambda m: m.part.select("p_partkey", S.slug(F.col("p_name")).alias("tech_id")), "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS tech_id FROM part")
register("ent21_decisions", lambda m: m.part.select("p_partkey", R.merge_decision(F.col("p_partkey") % 100 / 100.0, F.col("p_size") % 2 == 0, F.col("p_size") / 50).alias("decision")), "SELECT p_partkey, CASE WHEN p_partkey % 100 / 100.0::DOUBLE < 0.75 THEN 'reject' WHEN p_size % 2 = 0 AND p_size / 50 >= 0.3::DOUBLE THEN 'auto_merge' ELSE 'review' END AS decision FROM part")


def members(m):
    return m.part.select((F.col("p_partkey") % 50).alias("cluster"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("variants"), (F.col("p_partkey") % 7 == 0).alias("in_catalog"), F.col("p_size").cast("long").alias("occurrences"))


MERGED = """a AS (SELECT p_partkey % 50 AS cluster, p_name AS name, p_size AS occurrences, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY (p_partkey % 7 <> 0), p_name) AS r, p_brand, p_type FROM part),
v AS (SELECT cluster, list_sort(list_distinct(list(x))) AS v FROM (SELECT cluster, unnest([p_brand, p_type]) AS x FROM a) t GROUP BY 1), g AS (SELECT a.cluster, max(CASE WHEN r = 1 THEN name END) AS name, sum(occurrences)::BIGINT AS occurrences FROM a GROUP BY 1)"""
register("ent22_merged", lambda m: R.merged(members(m)).withColumn("variants", F.array_join("variants", ",")).drop("tech_id"), f"{MERGED} SELECT g.cluster, name, array_to_string(v, ',') AS variants, occurrences FROM g JOIN v USING (cluster)")
register("ent27_catalog_report", lambda m: R.catalog_report(R.merged(members(m)), 60000).select("names", "duplicate_names", "ambiguous_variants"), f"{MERGED} SELECT (SELECT count(*) FROM g) AS names, (SELECT count(*) FROM (SELECT name FROM g GROUP BY 1 HAVING count(*) > 1) t) AS duplicate_names, (SELECT count(*) FROM (SELECT x FROM (SELECT g.name, unnest(v) AS x FROM g JOIN v USING (cluster)) t GROUP BY x HAVING count(DISTINCT name) > 1) u) AS ambiguous_variants")
register("ent31_semantic", lambda m: R.semantic(m.embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), Q.centres(m.embeddings).select(F.col("label").alias("id"), F.col("centre").alias("v")), 0.2).withColumn("score", F.round("score", 4)), """
k AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) t GROUP BY 1, 2), v AS (SELECT label AS id, list(x ORDER BY i) AS v FROM k GROUP BY 1),
s AS (SELECT a.vec_id AS qid, v.id, round(list_dot_product(a.embedding::DOUBLE[], v.v) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(v.v, v.v))), 9) AS s FROM embeddings a, v)
SELECT qid, id, round(s, 4) AS score, rank, CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.75 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id)::INT AS rank FROM s WHERE s >= 0.2) t WHERE rank <= 3""")
register("ent33_tickers", lambda m: m.companies.select("id", R.ticker_of(F.concat("name", F.lit(" ("), F.substring("ticker", 1, 5), F.lit(")")), F.array("ticker")).alias("ticker")), "SELECT id, ticker[1:5] AS ticker FROM companies")
register("ent44_placeholders", lambda m: m.conversations.groupBy("conv_id").agg(F.array_sort(R.without_placeholders(F.array(F.min("role"), F.lit("Third Party"), F.lit("Unnamed Entity")))).alias("a")).select("conv_id", F.array_join("a", ",").alias("names")), "SELECT conv_id, min(role) AS names FROM conversations GROUP BY 1")

# more scalar functions, over strings made from the tables

register("sca2_seen_date", lambda m: m.orders.select("o_orderkey", F.to_date(S.seen_date(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T010203Z")))).alias("d")), "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders")
AGENCY = "element_at(array('US Navy', 'Federal Aviation Administration', 'NASA', 'City', ''), CAST(o_custkey % 5 AS INT) + 1)"
register("sca8_agency_type", lambda m: m.orders.select("o_orderkey", S.agency_type(F.expr(AGENCY)).alias("kind")), "SELECT o_orderkey, ['defense', 'regulatory', 'civil', 'civil', 'unknown'][o_custkey % 5 + 1] AS kind FROM orders")
register("sca11_repo_id", lambda m: m.part.select("p_partkey", S.repo_id(F.concat(F.lit("owner/my-repo."), "p_partkey")).alias("id")), "SELECT p_partkey, 'my_repo_' || p_partkey AS id FROM part")
register("sca14_docket", lambda m: m.part.select("p_partkey", S.docket(F.concat(F.lit("Text. Docket No. FAA-"), "p_partkey", F.lit(" more"))).alias("docket")), "SELECT p_partkey, 'FAA-' || p_partkey AS docket FROM part")
ACTION = "element_at(array('Final rule; approval', 'Proposed rule', 'Denied', 'Type certification notice'), CAST(p_partkey % 4 AS INT) + 1)"
register("sca15_document_type", lambda m: m.part.select("p_partkey", S.document_type(F.expr(ACTION)).alias("document_type"), S.decision_type(F.expr(ACTION)).alias("decision_type")), "SELECT p_partkey, ['final_rule', 'proposed_rule', 'notice', 'notice'][p_partkey % 4 + 1] AS document_type, ['approval', 'proposal', 'denial', 'certification_requirement'][p_partkey % 4 + 1] AS decision_type FROM part")
register("sca18_email", lambda m: m.documents.select("doc_id", S.email(F.col("text")).alias("email")), "SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', 0), '') AS email FROM documents")
register("sca21_sec_date", lambda m: m.orders.select("o_orderkey", S.sec_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("iso")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
register("sca31_peer_reviewed", lambda m: m.part.select("p_partkey", S.peer_reviewed(F.expr("element_at(array('Journal of X', 'preprint server', 'Blog'), CAST(p_partkey % 3 AS INT) + 1)")).alias("reviewed")), "SELECT p_partkey, [true, false, NULL][p_partkey % 3 + 1] AS reviewed FROM part")
register("sca33_short_summary", lambda m: m.documents.select("doc_id", F.length(S.short_summary(F.col("text"))).alias("n")), """
h AS (SELECT doc_id, length(text) AS n, text[1:500] AS h FROM documents), p AS (SELECT doc_id, n, h, 500 - strpos(reverse(h), ' .') AS stop, strpos(reverse(h), ' .') AS k FROM h)
SELECT doc_id, CASE WHEN n <= 500 THEN n WHEN k > 0 AND stop > 200 THEN stop ELSE 500 END::INT AS n FROM p""")
register("src61_patent_number", lambda m: m.part.select("p_partkey", S.patent_number(F.concat(F.lit("0"), F.col("p_partkey").cast("string"), F.lit("-B")), F.expr("element_at(array('S1', 'P2', 'B2'), CAST(p_partkey % 3 AS INT) + 1)")).alias("number")), "SELECT p_partkey, ['D', 'PP', ''][p_partkey % 3 + 1] || CASE WHEN p_partkey = 0 THEN '' ELSE p_partkey::VARCHAR END AS number FROM part")
register("src58_first_long", lambda m: m.documents.select("doc_id", F.length(S.first_long(F.substring("text", 1, 90), F.col("text"))).alias("n")), "SELECT doc_id, CASE WHEN length(text) >= 100 THEN length(text) END::INT AS n FROM documents")
register("src62_sizes", lambda m: m.documents.groupBy("source").agg(F.sum("n_chars").alias("n")).select("source", S.readable_size(F.col("n")).alias("size")), "SELECT source, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024, 1)) ELSE printf('%.1f MB', round(n / 1048576, 1)) END AS size FROM (SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1) t")
register("har3_money", lambda m: m.orders.select("o_orderkey", S.money(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("value")), "SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders")
register("har16_funders", lambda m: m.supplier.select("s_suppkey", S.funding_org(F.expr("element_at(array('NSF grant', 'US Department of Energy', 'the acme fund'), CAST(s_suppkey % 3 AS INT) + 1)")).alias("org")), "SELECT s_suppkey, ['NSF', 'DOE', 'The Acme Fund'][s_suppkey % 3 + 1] AS org FROM supplier")
register("har29_accession", lambda m: m.orders.select("o_orderkey", S.accession(F.lpad(F.col("o_orderkey").cast("string"), 18, "0")).alias("accession")), "SELECT o_orderkey, a[1:10] || '-' || a[11:12] || '-' || a[13:18] AS accession FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 18, '0') AS a FROM orders) t")
register("src52_cik", lambda m: m.supplier.select("s_suppkey", S.cik(F.col("s_suppkey")).alias("cik")), "SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 10, '0') AS cik FROM supplier")
