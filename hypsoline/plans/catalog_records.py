"""Registered queries: harvest summaries, upserts, diagnostics, graph algorithms, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import graph as G
from ..operators import harvest as H
from ..operators import upsert as U
from ..operators.basics import keep_first, last_wins
from ..registry import register
from ..streaming import events as E
from .catalog_layers import MD

# harvest

register("har1_first_by_url", lambda m: H.dedupe(m.news, ["url"], ["seq"]).select("seq", "url", "keyword"), "SELECT seq, url, keyword FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS r FROM news) t WHERE r = 1")
register("har2_daily_sentiment", lambda m: H.daily_sentiment(m.news), "SELECT day, count(*) AS articles, round(avg(tone), 2) AS avg_tone, count_if(tone > 5)::BIGINT AS positive, count_if(tone < -5)::BIGINT AS negative, count_if(tone BETWEEN -5 AND 5)::BIGINT AS neutral FROM news GROUP BY day")
register("har2_direction", lambda m: H.sentiment_direction(H.daily_sentiment(m.news)).select(F.round("first_half", 6).alias("first_half"), F.round("second_half", 6).alias("second_half"), "trend"), """
d AS (SELECT day, round(avg(tone), 2) AS a FROM news GROUP BY day), r AS (SELECT a, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM d), h AS (SELECT avg(CASE WHEN r <= n // 2 THEN a END) AS x, avg(CASE WHEN r > n // 2 THEN a END) AS y FROM r)
SELECT round(x, 6) AS first_half, round(y, 6) AS second_half, CASE WHEN y > x THEN 'improving' ELSE 'declining' END AS trend FROM h""")
register("har4_first_award", lambda m: H.dedupe(m.lineitem.select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"]), "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) t WHERE r = 1")
register("har5_contract_stats", lambda m: H.contract_stats(m.documents_g.where("doc_type = 'government_contract'"), "agency", "award_amount"), "SELECT agency, count(*) AS contracts, round(sum(award_amount), 2) AS total_value FROM documents_g WHERE doc_type = 'government_contract' GROUP BY agency")
register("har6_popularity", lambda m: m.documents_g.where("doc_type = 'github'").select("doc_id", F.round(H.popularity(F.col("stars"), F.col("forks"), F.col("citation_count")), 6).alias("popularity")), "SELECT doc_id, round(stars + 0.5::DOUBLE * forks + 0.3::DOUBLE * citation_count, 6) AS popularity FROM documents_g WHERE doc_type = 'github'")
register("har8_first_keyword", lambda m: m.part.select("p_partkey", H.first_keyword(F.col("p_name"), ["7", "3", "1"]).alias("keyword")), "SELECT p_partkey, CASE WHEN contains(p_name, '7') THEN '7' WHEN contains(p_name, '3') THEN '3' WHEN contains(p_name, '1') THEN '1' END AS keyword FROM part")
register("har12_citation_metrics", lambda m: H.citation_metrics(m.documents_g.where("doc_type = 'technical_paper'"), "citation_count"), """
p AS (SELECT citation_count AS c, row_number() OVER (ORDER BY citation_count DESC) - 1 AS r, count(*) OVER () AS n FROM documents_g WHERE doc_type = 'technical_paper')
SELECT count(*) AS papers, sum(c)::BIGINT AS total_citations, round(avg(c), 4) AS avg_citations, max(c) AS max_citations, max(CASE WHEN r = n // 10 THEN c END) AS top_decile FROM p""")
register("har7_top_values", lambda m: H.top_values(m.documents, "source"), "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 10")
register("har7_timeline", lambda m: H.month_timeline(m.orders, "o_orderdate"), "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
register("har11_keyword_trends", lambda m: m.news.groupBy("keyword").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls")), "SELECT keyword, count(*) AS n, count(DISTINCT url) AS urls FROM news GROUP BY keyword")
register("har18_first_by_any_id", lambda m: H.dedupe(m.documents_g.select("doc_id", "agency", "title", "published_at"), ["agency", "title"], ["published_at", "doc_id"]).select("doc_id", "agency"), "SELECT doc_id, agency FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(agency, title) ORDER BY published_at, doc_id) AS r FROM documents_g) t WHERE r = 1")
register("har19_keyword_filter", lambda m: m.documents.where(H.matches_keywords(F.col("text"), ["License", "+1 ("])).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), '+1 (')")
register("har22_pdf_links", lambda m: m.pages.select("page_id", F.size(H.links(F.col("html"), '(?i)href="([^"]*)"')).alias("n_links")), "SELECT page_id, len(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1))::INT AS n_links FROM pages")
register("har26_quarters", lambda m: m.spark.range(1).select(F.explode(H.quarters("2023-01-15", "2025-01-15")).alias("quarter")), "SELECT DISTINCT year(d) || 'Q' || quarter(d) AS quarter FROM (SELECT unnest(generate_series(DATE '2023-01-15', DATE '2025-01-15', INTERVAL 90 DAY)) AS d) t")
register("har30_sorted_entries", lambda m: keep_first(m.news, "url", ["seq"]).orderBy(F.col("ts").desc_nulls_last(), "seq").limit(50).select("seq", "url"), "SELECT seq, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS r FROM news) t WHERE r = 1 ORDER BY ts DESC NULLS LAST, seq LIMIT 50")
register("har32_feed_stats", lambda m: m.news.groupBy("keyword").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), "SELECT keyword, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM news GROUP BY keyword")
register("har35_source_layers", lambda m: H.source_summary(m.documents.select("source"), m.documents.select("source").distinct().select("source", F.when(F.substring("source", 4, 1) == "1", "a").when(F.length("source") == 4, "b").alias("layer"))), """
s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT CASE WHEN source[4:4] = '1' THEN 'a' WHEN length(source) = 4 THEN 'b' ELSE 'other' END AS layer, count(*) AS sources, count_if(n >= 5)::BIGINT AS active, sum(n)::BIGINT AS records FROM s GROUP BY 1""")
register("har40_success", lambda m: m.labels.agg(F.count_if(F.col("quality") == 1).alias("ok"), F.count_if(F.col("quality") == 0).alias("failed")).withColumn("rate", H.success_rate(F.col("ok"), F.col("failed"))), "SELECT count_if(quality = 1)::BIGINT AS ok, count_if(quality = 0)::BIGINT AS failed, round(count_if(quality = 1) / count(*) * 100, 4) AS rate FROM labels WHERE quality IN (0, 1)")
register("har43_quality_filter", lambda m: m.documents_g.where(F.coalesce("quality_score", F.lit(0.0)) >= 0.85).groupBy("doc_type").agg(F.count("*").alias("n")), "SELECT doc_type, count(*) AS n FROM documents_g WHERE quality_score >= 0.85 GROUP BY 1")
register("har44_quality_distribution", lambda m: H.quality_distribution(m.documents_g), "SELECT count(*) AS n, min(quality_score) AS least, max(quality_score) AS most, round(avg(quality_score), 6) AS mean, count_if(quality_score >= 0.85)::BIGINT AS good, round(count_if(quality_score >= 0.85) / count(*) * 100, 4) AS good_pct FROM documents_g")

# upserts

register("ups1_upsert_nodes", lambda m: last_wins(m.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), ["l_suppkey"], ["l_orderkey", "l_linenumber"]), "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) t WHERE r = 1")
register("ups7_merge_mentions", lambda m: U.merge_edges(m.mention_rows, m.technologies, "id", m.documents_g, "doc_id", ["tech_id", "doc_id"], "seq").select("tech_id", "doc_id", "role"), "SELECT tech_id, doc_id, role FROM tech_mentions WHERE tech_id IN (SELECT id FROM technologies) AND doc_id IN (SELECT doc_id FROM documents_g)")
register("ups9_parallel_edges", lambda m: m.company_tech.groupBy("src", "dst").agg(F.count("*").alias("edges")).where("edges > 1"), "SELECT src, dst, count(*) AS edges FROM company_tech GROUP BY 1, 2 HAVING count(*) > 1")
register("ups15_duplicate_keys", lambda m: U.duplicates(m.lineitem, ["l_partkey", "l_orderkey"]), "SELECT l_partkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
register("ups17_statistics", lambda m: U.statistics({"Technology": m.technologies, "Company": m.companies, "Document": m.documents_g}, {"MENTIONED_IN": m.tech_mentions, "RELATED_TO_TECH": m.company_tech}), """SELECT 'node' AS kind, 'Technology' AS label, count(*) AS n FROM technologies UNION ALL SELECT 'node', 'Company', count(*) FROM companies UNION ALL SELECT 'node', 'Document', count(*) FROM documents_g
UNION ALL SELECT 'edge', 'MENTIONED_IN', count(*) FROM tech_mentions UNION ALL SELECT 'edge', 'RELATED_TO_TECH', count(*) FROM company_tech""")
register("ups20_memberships", lambda m: m.technologies.select("community", F.col("id").alias("node_id")), "SELECT community, id AS node_id FROM technologies")
register("src13_dangling", lambda m: U.dangling(m.mention_rows, m.technologies.where("domain <> 'ECONOMY'"), "tech_id", "id").groupBy("tech_id").agg(F.count("*").alias("n")), "SELECT tech_id, count(*) AS n FROM mention_rows WHERE tech_id NOT IN (SELECT id FROM technologies WHERE domain <> 'ECONOMY') GROUP BY 1")

# diagnostics

COLUMNS = ("agency", "outlet_tier", "citation_count", "quality_score")
register("dia1_type_profile", lambda m: m.documents_g.groupBy("doc_type").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("avg_quality"), F.min("published_at").alias("first_date"), F.max("published_at").alias("last_date")), "SELECT doc_type, count(*) AS n, round(avg(quality_score), 6) AS avg_quality, min(published_at) AS first_date, max(published_at) AS last_date FROM documents_g GROUP BY 1")
register("dia2_completeness", lambda m: D.completeness(m.documents_g, COLUMNS), " UNION ALL ".join(f"SELECT doc_type, '{c}' AS \"column\", count({c}) AS filled, round(count({c}) / count(*) * 100, 4) AS pct FROM documents_g GROUP BY 1" for c in COLUMNS))
register("dia3_distribution", lambda m: D.score_distribution(m.documents_g, "citation_count", "doc_type"), """
r AS (SELECT doc_type, citation_count AS v, row_number() OVER (PARTITION BY doc_type ORDER BY citation_count) - 1 AS i, count(*) OVER (PARTITION BY doc_type) AS n FROM documents_g)
SELECT doc_type, min(v) AS least, max(CASE WHEN i = floor(n * 0.25) THEN v END) AS p25, max(CASE WHEN i = floor(n * 0.5) THEN v END) AS median, max(CASE WHEN i = floor(n * 0.75) THEN v END) AS p75, max(v) AS most, round(avg(v), 6) AS mean FROM r GROUP BY 1""")
register("dia5_buckets", lambda m: D.document_buckets(m.tech_mentions.groupBy("tech_id").agg(F.count("*").alias("n"))), "SELECT CASE WHEN n < 5 THEN '0-4' WHEN n < 10 THEN '5-9' WHEN n < 20 THEN '10-19' WHEN n < 50 THEN '20-49' ELSE '50+' END AS bucket, count(*) AS technologies, sum(n)::BIGINT AS documents FROM (SELECT tech_id, count(*) AS n FROM tech_mentions GROUP BY 1) t GROUP BY 1")
register("dia7_having", lambda m: m.tech_mentions.groupBy("tech_id").agg(F.count("*").alias("n")).where("n >= 15").orderBy(F.desc("n"), "tech_id").limit(100), "SELECT tech_id, count(*) AS n FROM tech_mentions GROUP BY 1 HAVING count(*) >= 15 ORDER BY n DESC, tech_id LIMIT 100")
register("dia8_roles", lambda m: m.mention_docs.groupBy("doc_type", "role").agg(F.count("*").alias("n")), "SELECT doc_type, role, count(*) AS n FROM tech_mentions JOIN documents_g USING (doc_id) GROUP BY 1, 2")
register("dia9_filing_types", lambda m: m.documents_g.where("doc_type = 'sec_filing'").groupBy("filing_type").agg(F.count("*").alias("n")), "SELECT filing_type, count(*) AS n FROM documents_g WHERE doc_type = 'sec_filing' GROUP BY 1")
register("dia10_null_counts", lambda m: m.documents_g.agg(F.count("*").alias("n"), F.count("agency").alias("with_agency"), F.count("outlet_tier").alias("with_tier")), "SELECT count(*) AS n, count(agency) AS with_agency, count(outlet_tier) AS with_tier FROM documents_g")
register("dia11_status", lambda m: D.completeness(m.documents_g, COLUMNS).withColumn("status", D.status(F.col("pct"))).select("doc_type", "column", "status"), " UNION ALL ".join(f"SELECT doc_type, '{c}' AS \"column\", CASE WHEN round(count({c}) / count(*) * 100, 4) >= 95 THEN 'PASS' WHEN round(count({c}) / count(*) * 100, 4) >= 80 THEN 'WARNING' ELSE 'FAIL' END AS status FROM documents_g GROUP BY 1" for c in COLUMNS))
register("dia16_overall", lambda m: D.overall(D.completeness(m.documents_g, ("citation_count", "quality_score")).withColumn("status", D.status(F.col("pct")))), "SELECT CASE WHEN min(least(a, b)) < 80 THEN 'FAIL' WHEN min(least(a, b)) < 95 THEN 'WARNING' ELSE 'PASS' END AS overall FROM (SELECT count(citation_count) / count(*) * 100 AS a, count(quality_score) / count(*) * 100 AS b FROM documents_g GROUP BY doc_type) t")

# graph


def nodes(m):
    return m.technologies.select(F.col("id").cast("long").alias("id")).unionByName(m.companies.select((-1 - F.col("id")).cast("long").alias("id")))


def edges(m):
    """Companies (negative ids) to technologies, and back for `uses`."""
    e = m.company_tech
    there = e.select((-1 - F.col("src")).alias("src"), F.col("dst").alias("dst"))
    back = e.where("relation_type = 'uses'").select(F.col("dst").alias("src"), (-1 - F.col("src")).alias("dst"))
    return there.unionByName(back)


GRAPH = "n AS (SELECT id::BIGINT AS id FROM technologies UNION ALL SELECT -1 - id FROM companies), e AS (SELECT -1 - src AS src, dst FROM company_tech UNION ALL SELECT dst, -1 - src FROM company_tech WHERE relation_type = 'uses')"
register("gra2_degree", lambda m: G.degree(nodes(m), edges(m)), f"{GRAPH} SELECT id, coalesce(d, 0)::BIGINT AS degree FROM n LEFT JOIN (SELECT src, count(*) AS d FROM e GROUP BY 1) t ON src = id")
ROUNDS = 20
PAGERANK = ", ".join(
    f"p{i + 1} AS MATERIALIZED (SELECT n.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(f, 0) AS p FROM n "
    f"LEFT JOIN (SELECT dst, sum(p{i}.p * s) AS f FROM l JOIN p{i} ON p{i}.id = l.src GROUP BY dst) t ON t.dst = n.id)"
    for i in range(ROUNDS)
)
#: The operator's own 20 rounds; its tolerance of 1e-7 is not reached in them on these graphs.
register("gra1_pagerank", lambda m: G.pagerank(nodes(m), edges(m), ROUNDS).select("id", F.round("pagerank", 6).alias("pagerank")), f"""{GRAPH},
o AS (SELECT src, count(*) AS o FROM e GROUP BY 1), l AS MATERIALIZED (SELECT e.src, e.dst, count(*) / any_value(o.o) AS s FROM e JOIN o USING (src) GROUP BY e.src, e.dst),
p0 AS (SELECT id, 0.15::DOUBLE AS p FROM n), {PAGERANK} SELECT id, round(p, 6) AS pagerank FROM p{ROUNDS}""")


def places(m):
    """Customers to their nation, nations to their region; nations and regions have negative ids."""
    up = m.customer.select(F.col("c_custkey").cast("long").alias("src"), (-1 - F.col("c_nationkey")).cast("long").alias("dst"))
    return up.unionByName(m.nation.select((-1 - F.col("n_nationkey")).cast("long").alias("src"), (-1000 - F.col("n_regionkey")).cast("long").alias("dst")))


register("gra3_tree", lambda m: G.betweenness(places(m), places(m).select(F.col("src").alias("id"))), """
c AS (SELECT c_nationkey, count(*)::DOUBLE AS n FROM customer GROUP BY 1) SELECT (-1 - c_nationkey)::BIGINT AS id, n AS betweenness FROM c UNION ALL SELECT DISTINCT (-1000 - n_regionkey)::BIGINT, 0.0::DOUBLE FROM nation""")
register("gra3_betweenness", lambda m: G.betweenness(edges(m), nodes(m)).select("id", F.round("betweenness", 4).alias("betweenness")))
register("gra4_top_nodes", lambda m: G.degree(nodes(m), edges(m)).orderBy(F.desc("degree"), "id").limit(5), f"{GRAPH} SELECT id, count(*) AS degree FROM e JOIN n ON id = src GROUP BY 1 ORDER BY degree DESC, id LIMIT 5")
#: All rounds up to a hundredth, of which the first that repeats an earlier state, or changes nothing, is the result.
register("gra5_label_propagation", lambda m: G.label_propagation(edges(m), rounds=None), f"""RECURSIVE {GRAPH},
w AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) t WHERE src <> dst GROUP BY 1, 2),
x AS (
  SELECT 0 AS r, src AS id, src AS c FROM w GROUP BY src
  UNION ALL
  SELECT r, id, arg_max(c, (k, -c)) FROM (
    SELECT r, id, c, sum(k) AS k FROM (
      SELECT x.r + 1 AS r, w.src AS id, x.c, w.w AS k FROM w JOIN x ON x.id = w.dst UNION ALL SELECT x.r + 1, x.id, x.c, 1 FROM x
    ) v WHERE r <= 100 GROUP BY r, id, c
  ) t GROUP BY r, id
),
h AS (SELECT r, md5(string_agg(id || ':' || c, ',' ORDER BY id)) AS h FROM x GROUP BY r),
z AS (SELECT min(a.r) AS r FROM h a JOIN h b ON a.h = b.h AND (b.r BETWEEN 1 AND a.r - 1 OR b.r = a.r - 1) WHERE a.r > 0)
SELECT id, c AS community FROM x WHERE r = (SELECT r FROM z)""")
register("gra7_community_counts", lambda m: m.technologies.agg(F.countDistinct("community").alias("v1"), F.countDistinct("domain").alias("v2")), "SELECT count(DISTINCT community) AS v1, count(DISTINCT domain) AS v2 FROM technologies")
register("gra8_components", lambda m: G.connected_components(m.customer.select(F.col("c_custkey").cast("long").alias("src"), (-1 - F.col("c_nationkey")).cast("long").alias("dst"))), """
SELECT c_custkey::BIGINT AS id, (-1 - c_nationkey)::BIGINT AS component FROM customer UNION ALL SELECT DISTINCT (-1 - c_nationkey)::BIGINT, (-1 - c_nationkey)::BIGINT FROM customer""")
register("gra9_neighbourhood", lambda m: G.neighbourhood(m.company_tech, 5), "SELECT 'out' AS way, src AS node, dst AS other, relation_type FROM company_tech WHERE src = 5 UNION ALL SELECT 'in', dst, src, relation_type FROM company_tech WHERE dst = 5")
register("gra10_lookup", lambda m: m.technologies.where("id = 7").select("id", "name", "community"), "SELECT id, name, community FROM technologies WHERE id = 7")
register("gra13_colours", lambda m: m.documents_g.select("doc_type").distinct().select("doc_type", G.colour(F.lit("Document")).alias("colour")), "SELECT DISTINCT doc_type, '#76b7b2' AS colour FROM documents_g")
register("gra15_tooltips", lambda m: m.companies.select("id", G.tooltip([("name", F.col("name")), ("country", F.col("country")), ("ticker", F.col("ticker"))]).alias("tooltip")), "SELECT id, 'name: ' || name || chr(10) || 'country: ' || country || chr(10) || 'ticker: ' || ticker AS tooltip FROM companies")

# events

register("str1_tumbling", lambda m: E.tumbling(m.events), "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS events, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")
register("str1_sliding", lambda m: E.sliding(m.events), """SELECT w AS window_start, count(*) AS events FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS w FROM events UNION ALL SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE FROM events) t GROUP BY 1""")
register("str1_sessions", lambda m: E.sessions(m.events), """
a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), b AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM b GROUP BY user_id, g""")


def log(m):
    return m.events.select(F.concat(F.lit("run"), (F.col("user_id") % 7).cast("string")).alias("run_id"), F.when(F.col("event_type") == "purchase", "technology_complete").otherwise("agent_start").alias("type"), F.lit(500).alias("total"))


register("str3_progress", lambda m: E.progress(log(m)), "SELECT 'run' || (user_id % 7) AS run_id, count_if(event_type = 'purchase')::BIGINT AS done, 500 AS total, (100 * count_if(event_type = 'purchase') // 500)::INT AS pct FROM events GROUP BY 1")
register("str6_not_done", lambda m: E.not_done(m.events.select("event_id", "user_id"), m.events.where("value > 489").select("user_id"), "user_id"), "SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 489)")
register("dia4_good_documents", lambda m: m.documents_g.agg(*[F.count_if(F.col("quality_score") >= q).alias(f"at_least_{int(q * 100)}") for q in (0.5, 0.75, 0.85)]), "SELECT count_if(quality_score >= 0.5)::BIGINT AS at_least_50, count_if(quality_score >= 0.75)::BIGINT AS at_least_75, count_if(quality_score >= 0.85)::BIGINT AS at_least_85 FROM documents_g")
register("dia6_strata", lambda m: H.top_k(m.mention_docs.groupBy("doc_type", "tech_id").agg(F.count("*").alias("n")), ["doc_type"], [F.desc("n"), F.col("tech_id")], 10).select("doc_type", "tech_id", "n"), "SELECT doc_type, tech_id, n FROM (SELECT doc_type, tech_id, count(*) AS n, row_number() OVER (PARTITION BY doc_type ORDER BY count(*) DESC, tech_id) AS r FROM tech_mentions JOIN documents_g USING (doc_id) GROUP BY 1, 2) t WHERE r <= 10")
