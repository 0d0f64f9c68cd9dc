"""Registered queries: innovation, adoption, narrative, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers as L
from ..registry import register
from .model import AS_OF

START, YEAR, HALF = "1999-08-01", "2000-08-01", "2001-02-01"
MD = "tech_mentions JOIN documents_g USING (doc_id) WHERE quality_score >= 0.75"


def window(start: str = START, end: str = AS_OF) -> str:
    return f"published_at >= DATE '{start}' AND published_at < DATE '{end}'"


register("inn1_patent_count", lambda m: L.patent_count(m.mention_docs, START, AS_OF), f"""
SELECT tech_id, count(*) AS patent_count, sum(coalesce(citation_count, 0))::BIGINT AS total_citations, round(avg(coalesce(pagerank, 0)), 6) AS avg_pagerank,
round(sum(1 + 100 * coalesce(pagerank, 0)), 4) AS weighted_count FROM {MD} AND doc_type = 'patent' AND role = 'invented' AND {window()} GROUP BY tech_id""")

for name, kind, roles in (("inn2_top_patents", "patent", ("invented",)), ("inn5_top_papers", "technical_paper", ("invented", "studied"))):
    register(
        name,
        lambda m, kind=kind, roles=roles: L.top_documents(m.mention_docs, kind, roles, [F.desc("citation_count"), F.desc("pagerank"), F.col("doc_id")], 5, ["doc_id", "citation_count"]),
        f"""SELECT tech_id, rank, doc_id, citation_count FROM (SELECT tech_id, doc_id, citation_count, row_number() OVER (PARTITION BY tech_id ORDER BY citation_count DESC, pagerank DESC, doc_id)::INT AS rank
        FROM {MD} AND doc_type = '{kind}' AND role IN ({", ".join(f"'{r}'" for r in roles)})) t WHERE rank <= 5""",
    )

COMMUNITY_DOCS = f"""c AS (SELECT t.community, count(DISTINCT x.doc_id) AS n FROM (SELECT * FROM {MD} AND doc_type = 'patent' AND {window()}) x
JOIN technologies t ON t.id = x.tech_id GROUP BY t.community)"""
register("inn3_community_patents", lambda m: L.community_documents(m.mention_docs, m.technologies, "patent", START, AS_OF), f"{COMMUNITY_DOCS} SELECT id AS tech_id, community, n AS community_docs FROM technologies JOIN c USING (community)")

register("inn4_paper_count", lambda m: L.paper_count(m.mention_docs, START, AS_OF), f"""
SELECT tech_id, count(*) AS paper_count, sum(citation_count)::BIGINT AS total_citations, round(avg(pagerank), 6) AS avg_pagerank
FROM {MD} AND doc_type = 'technical_paper' AND role IN ('invented', 'studied') AND {window()} GROUP BY tech_id""")

register("inn6_repo_count", lambda m: L.repo_count(m.mention_docs, START, AS_OF), f"""
SELECT tech_id, count(*) AS repo_count, sum(stars)::BIGINT AS total_stars, sum(forks)::BIGINT AS total_forks FROM {MD} AND doc_type = 'github' AND {window()} GROUP BY tech_id""")


def trend_sql(types: str, roles: str | None, months: int, span: int, up: float, names: tuple[str, str, str]) -> str:
    inner = f"""SELECT tech_id, count_if(published_at >= DATE '{AS_OF}' - INTERVAL {months} MONTH) AS recent_count, count_if(published_at < DATE '{AS_OF}' - INTERVAL {months} MONTH) AS historical_count
    FROM {MD} AND doc_type IN ({types}) {f"AND role IN ({roles})" if roles else ""} AND published_at >= DATE '{AS_OF}' - INTERVAL {span} MONTH AND published_at < DATE '{AS_OF}' GROUP BY tech_id"""
    rate, base = f"recent_count / {months}.0::DOUBLE", f"historical_count / {span - months}.0::DOUBLE"
    return f"""SELECT tech_id, recent_count::BIGINT AS recent_count, historical_count::BIGINT AS historical_count, CASE WHEN {rate} > {base} * (1 + {up}::DOUBLE) THEN '{names[0]}' WHEN {rate} < {base} * (1 - {up}::DOUBLE) THEN '{names[1]}' ELSE '{names[2]}' END AS trend FROM ({inner}) t"""


TRENDS = {
    "inn7_innovation_trend": (("patent", "technical_paper", "github"), None, 6, 24, 0.2, ("growing", "declining", "stable")),
    "ado6_adoption_trend": (("government_contract", "regulation"), ("procured", "regulated"), 6, 24, 0.2, ("growing", "declining", "stable")),
    "ris6_risk_trend": (("sec_filing",), None, 3, 12, 0.3, ("increasing", "decreasing", "stable")),
}
for name, (types, roles, months, span, up, names) in TRENDS.items():
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs) if xs else None
    register(name, lambda m, a=(types, roles, AS_OF, months, span, up, names): L.temporal_trend(m.mention_docs, *a), trend_sql(quoted(types), quoted(roles), months, span, up, names))

register("inn8_innovation_metrics", lambda m: L.innovation_metrics(m.mention_docs, m.technologies, AS_OF), f"""
a AS (SELECT tech_id, count_if(doc_type = 'patent' AND role = 'invented') AS p, sum(CASE WHEN doc_type = 'patent' AND role = 'invented' THEN citation_count END) AS pc,
count_if(doc_type = 'technical_paper' AND role IN ('invented', 'studied')) AS a, sum(CASE WHEN doc_type = 'technical_paper' AND role IN ('invented', 'studied') THEN citation_count END) AS ac,
count_if(doc_type = 'github') AS r, sum(CASE WHEN doc_type = 'github' THEN stars END) AS s FROM {MD} AND {window("1999-08-02")} GROUP BY tech_id), {COMMUNITY_DOCS.replace(START, "1999-08-02")}
SELECT t.id AS tech_id, coalesce(p, 0)::BIGINT AS patent_count, coalesce(pc, 0)::BIGINT AS patent_citations, coalesce(a, 0)::BIGINT AS paper_count, coalesce(ac, 0)::BIGINT AS paper_citations,
coalesce(r, 0)::BIGINT AS repo_count, coalesce(s, 0)::BIGINT AS total_stars, coalesce(c.n, 0)::BIGINT AS community_patents, floor(coalesce(c.n, 0) * 0.67::DOUBLE)::BIGINT AS community_papers
FROM technologies t LEFT JOIN a ON a.tech_id = t.id LEFT JOIN c ON c.community = t.community""")

register("ado1_contracts", lambda m: L.contracts(m.mention_docs, YEAR, AS_OF), f"""
SELECT tech_id, count(*) AS contract_count, round(sum(award_amount), 2) AS total_value, round(avg(award_amount), 6) AS avg_value,
coalesce(array_to_string(list_sort(list_distinct(list(agency)))[1:10], ','), '') AS agencies
FROM {MD} AND doc_type = 'government_contract' AND role IN ('deployed', 'funded', 'researched') AND {window(YEAR)} GROUP BY tech_id""")

register(
    "ado2_top_contracts",
    lambda m: L.top_documents(m.mention_docs, "government_contract", ("deployed", "funded", "researched"), [F.desc("award_amount"), F.desc("published_at"), F.col("doc_id")], 5, ["doc_id", "award_amount"]),
    f"""SELECT tech_id, rank, doc_id, award_amount FROM (SELECT tech_id, doc_id, award_amount, row_number() OVER (PARTITION BY tech_id ORDER BY award_amount DESC, published_at DESC, doc_id)::INT AS rank
    FROM {MD} AND doc_type = 'government_contract' AND role IN ('deployed', 'funded', 'researched')) t WHERE rank <= 5""",
)

register("ado3_approvals", lambda m: L.approvals(m.mention_docs, START, AS_OF), f"""
SELECT tech_id, count(*) AS approval_count, coalesce(array_to_string(list_sort(list_distinct(list(agency)))[1:10], ','), '') AS bodies,
array_to_string(list_sort(list(doc_id))[1:5], ',') AS first_docs FROM {MD} AND doc_type = 'regulation' AND role = 'regulated' AND {window()} GROUP BY tech_id""")

FILINGS = f"f AS (SELECT tech_id, doc_id, published_at, filing_type, strength, evidence_text, risk_factor_mentioned, cash_burn, cash_reserves FROM {MD} AND doc_type = 'sec_filing')"
register("ado4_revenue_mentions", lambda m: L.revenue_mentions(m.company_tech, m.mention_docs, m.companies, START, AS_OF), f"""{FILINGS}
SELECT tech_id, company, doc_id, published_at, doc_ref, rank FROM (SELECT f.tech_id, c.name AS company, f.doc_id, f.published_at, e.doc_ref,
row_number() OVER (PARTITION BY f.tech_id ORDER BY e.evidence_confidence DESC, f.published_at DESC, f.doc_id, c.name, e.doc_ref)::INT AS rank
FROM f JOIN company_tech e ON e.dst = f.tech_id JOIN companies c ON c.id = e.src WHERE (e.evidence_text LIKE '%revenue%' OR e.evidence_text LIKE '%sales%') AND {window()}) t WHERE rank <= 20""")

register("ado5_developers", lambda m: L.developing_companies(m.company_tech, m.companies), """
SELECT tech_id, rank, name, pagerank FROM (SELECT e.dst AS tech_id, c.name, round(c.pagerank, 6) AS pagerank, row_number() OVER (PARTITION BY e.dst ORDER BY c.pagerank DESC, c.name)::INT AS rank
FROM (SELECT DISTINCT src, dst FROM company_tech WHERE relation_type IN ('adopts', 'develops')) e JOIN companies c ON c.id = e.src WHERE c.pagerank IS NOT NULL) t WHERE rank <= 10""")


def adoption_metrics(m):
    parts = [
        L.agency_metrics(m.mention_docs, YEAR, START, AS_OF),
        L.revenue_mentions(m.company_tech, m.mention_docs, m.companies, YEAR, AS_OF).groupBy("tech_id").agg(F.countDistinct("company").alias("revenue_companies")),
        L.developing_companies(m.company_tech, m.companies).groupBy("tech_id").agg(F.count("*").alias("developers")),
    ]
    out = m.technologies.select(F.col("id").alias("tech_id"))
    for p in parts:
        out = out.join(p, "tech_id", "left")
    return out.fillna(0)


register("ado7_adoption_metrics", adoption_metrics, f"""{FILINGS},
a AS (SELECT tech_id, count(*) AS n, round(sum(award_amount), 2) AS v FROM {MD} AND doc_type = 'government_contract' AND role IN ('deployed', 'funded', 'researched') AND {window(YEAR)} GROUP BY 1),
b AS (SELECT tech_id, count(*) AS n FROM {MD} AND doc_type = 'regulation' AND role = 'regulated' AND {window()} GROUP BY 1),
r AS (SELECT tech_id, count(DISTINCT company) AS n FROM (SELECT f.tech_id, c.name AS company, row_number() OVER (PARTITION BY f.tech_id ORDER BY e.evidence_confidence DESC, f.published_at DESC, f.doc_id, c.name, e.doc_ref) AS rank
FROM f JOIN company_tech e ON e.dst = f.tech_id JOIN companies c ON c.id = e.src WHERE (e.evidence_text LIKE '%revenue%' OR e.evidence_text LIKE '%sales%') AND {window(YEAR)}) t WHERE rank <= 20 GROUP BY 1),
d AS (SELECT e.dst AS tech_id, least(10, count(*)) AS n FROM (SELECT DISTINCT src, dst FROM company_tech WHERE relation_type IN ('adopts', 'develops')) e JOIN companies c ON c.id = e.src WHERE c.pagerank IS NOT NULL GROUP BY 1)
SELECT t.id AS tech_id, coalesce(a.n, 0)::BIGINT AS contract_count, coalesce(a.v, 0)::DOUBLE AS total_value, coalesce(b.n, 0)::BIGINT AS approval_count, coalesce(r.n, 0)::BIGINT AS revenue_companies, coalesce(d.n, 0)::BIGINT AS developers
FROM technologies t LEFT JOIN a ON a.tech_id = t.id LEFT JOIN b ON b.tech_id = t.id LEFT JOIN r ON r.tech_id = t.id LEFT JOIN d ON d.tech_id = t.id""")

NEWS = f"{MD} AND doc_type = 'news' AND role = 'subject'"
register("nar1_news_count", lambda m: L.news_count(m.mention_docs, HALF, AS_OF), f"SELECT tech_id, count(*) AS news_count FROM {NEWS} AND {window(HALF)} GROUP BY tech_id")
register("nar2_tier_breakdown", lambda m: L.tier_breakdown(m.mention_docs, START, AS_OF), "SELECT tech_id, " + ", ".join(f"count_if(coalesce(outlet_tier, 'Other') = '{t}')::BIGINT AS {t.lower().replace(' ', '_')}" for t in L.TIERS) + f" FROM {NEWS} AND {window()} GROUP BY tech_id")
PRIORITY = "CASE outlet_tier WHEN 'Industry Authority' THEN 1 WHEN 'Financial Authority' THEN 2 WHEN 'Press Release' THEN 3 ELSE 4 END"
register("nar3_prominent_articles", lambda m: L.prominent_articles(m.mention_docs), f"""
SELECT tech_id, rank, doc_id, priority FROM (SELECT tech_id, doc_id, {PRIORITY} AS priority, row_number() OVER (PARTITION BY tech_id ORDER BY {PRIORITY}, published_at DESC, strength DESC, doc_id)::INT AS rank FROM {NEWS}) t WHERE rank <= 10""")
register("nar4_sentiment_trend", lambda m: m.technologies.select(F.col("id").alias("tech_id"), F.lit(0.0).alias("avg_sentiment"), F.lit("neutral").alias("trend")), "SELECT id AS tech_id, 0.0::DOUBLE AS avg_sentiment, 'neutral' AS trend FROM technologies")
register("nar5_momentum", lambda m: L.momentum(m.mention_docs, AS_OF, 90), f"""
SELECT tech_id, recent, previous, round(q, 6) AS momentum, CASE WHEN q > 1.5 THEN 'accelerating' WHEN q < 0.5 THEN 'decelerating' ELSE 'steady' END AS label FROM (
SELECT *, CASE WHEN previous = 0 THEN recent::DOUBLE ELSE recent / previous END AS q FROM (SELECT tech_id, count_if(published_at >= DATE '{AS_OF}' - 90)::BIGINT AS recent, count_if(published_at < DATE '{AS_OF}' - 90)::BIGINT AS previous
FROM {MD} AND doc_type = 'news' AND published_at >= DATE '{AS_OF}' - 180 AND published_at < DATE '{AS_OF}' GROUP BY tech_id) t) u""")


def narrative_metrics(m):
    news = L.news_count(m.mention_docs, HALF, AS_OF)
    recent = L.news_count(m.mention_docs, "2001-07-01", AS_OF).select("tech_id", F.col("news_count").alias("recent_news"))
    tiers = L.tier_breakdown(m.mention_docs, HALF, AS_OF).select("tech_id", F.col("industry_authority").alias("top_tier"))
    out = m.technologies.select(F.col("id").alias("tech_id")).join(news, "tech_id", "left").join(recent, "tech_id", "left").join(tiers, "tech_id", "left").fillna(0)
    return out.withColumn("freshness", L.freshness(F.col("recent_news"), F.col("news_count"))).withColumn("sentiment", L.sentiment_label(F.lit(0.0)))


register("nar6_narrative_metrics", narrative_metrics, f"""
n AS (SELECT tech_id, count(*) AS n, count_if(published_at >= DATE '2001-07-01') AS r, count_if(outlet_tier = 'Industry Authority') AS t FROM {NEWS} AND {window(HALF)} GROUP BY tech_id)
SELECT id AS tech_id, coalesce(n.n, 0)::BIGINT AS news_count, coalesce(n.r, 0)::BIGINT AS recent_news, coalesce(n.t, 0)::BIGINT AS top_tier,
CASE WHEN coalesce(n.n, 0) = 0 THEN 1.0 ELSE round((n.r / 30) / (n.n / 180), 2) END::DOUBLE AS freshness, 'neutral' AS sentiment FROM technologies LEFT JOIN n ON n.tech_id = id""")

register(
    "nar7_freshness",
    lambda m: m.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") >= "2000-01-01").alias("recent"), F.count_if(F.col("o_orderdate") < "2000-01-01").alias("older")).withColumn("freshness", L.freshness(F.col("recent"), F.col("older"))),
    """SELECT o_custkey, recent, older, CASE WHEN older = 0 THEN 1.0 ELSE round((recent / 30) / (older / 180), 2) END::DOUBLE AS freshness FROM (SELECT o_custkey, count_if(o_orderdate >= TIMESTAMP '2000-01-01')::BIGINT AS recent, count_if(o_orderdate < TIMESTAMP '2000-01-01')::BIGINT AS older FROM orders GROUP BY 1) t""",
)

RISK = f"""{FILINGS}, r AS (SELECT f.*, e.doc_ref, c.name AS company FROM f JOIN company_tech e ON e.dst = f.tech_id JOIN companies c ON c.id = e.src WHERE f.risk_factor_mentioned OR f.evidence_text LIKE '%risk%')"""
register("ris1_risk_mentions", lambda m: L.risk_mentions(L.risk_rows(m.company_tech, m.mention_docs, m.companies), HALF, AS_OF), f"""{RISK}
SELECT tech_id, count(DISTINCT doc_id) AS mention_count, array_to_string(list_sort(list_distinct(list(company)))[1:10], ',') AS companies FROM r WHERE {window(HALF)} GROUP BY tech_id""")
register("ris2_top_risks", lambda m: L.top_risks(L.risk_rows(m.company_tech, m.mention_docs, m.companies)), f"""{RISK}
SELECT tech_id, rank, doc_id, company, doc_ref FROM (SELECT tech_id, doc_id, company, doc_ref, row_number() OVER (PARTITION BY tech_id ORDER BY strength DESC, published_at DESC, doc_id, company, doc_ref)::INT AS rank FROM r) t WHERE rank <= 5""")
for name, types, start in (("ris3_institutional_docs", ("13F-HR",), None), ("ris4_insider_filings", ("3", "4", "5"), HALF)):
    register(name, lambda m, t=types, s=start: L.filings_over_edges(m.company_tech, m.mention_docs, m.companies, t, s, AS_OF if s else None), f"""{FILINGS}
    SELECT f.tech_id, count(*) AS filing_rows, count(DISTINCT f.doc_id) AS filings, array_to_string(list_sort(list_distinct(list(c.name)))[1:10], ',') AS companies FROM f JOIN company_tech e ON e.dst = f.tech_id
    JOIN companies c ON c.id = e.src WHERE filing_type IN ({", ".join(f"'{t}'" for t in types)}) {f"AND {window(start)}" if start else ""} GROUP BY f.tech_id""")
register("ris5_cash_burn", lambda m: L.cash_burn(m.company_tech, m.mention_docs), f"""{FILINGS}
SELECT f.tech_id, count(DISTINCT src) AS companies, round(avg(cash_burn), 6) AS avg_burn, round(avg(w), 6) AS avg_runway, count_if(w < 12)::BIGINT AS short_runway
FROM (SELECT *, CASE WHEN cash_burn <= 0 THEN 999.0::DOUBLE ELSE cash_reserves / cash_burn END AS w FROM f) f JOIN company_tech e ON e.dst = f.tech_id GROUP BY f.tech_id""")


def risk_metrics(m):
    out = m.technologies.select(F.col("id").alias("tech_id"))
    rows = L.risk_rows(m.company_tech, m.mention_docs, m.companies)
    for p in (L.risk_mentions(rows, HALF, AS_OF).drop("companies"), L.filings_over_edges(m.company_tech, m.mention_docs, m.companies, ("13F-HR",), None, None).select("tech_id", F.col("filings").alias("holdings_docs")), L.cash_burn(m.company_tech, m.mention_docs).select("tech_id", "short_runway")):
        out = out.join(p, "tech_id", "left")
    return out.fillna(0)


register("ris7_risk_metrics", risk_metrics, f"""{RISK}, a AS (SELECT tech_id, count(DISTINCT doc_id) AS n FROM r WHERE {window(HALF)} GROUP BY 1),
b AS (SELECT f.tech_id, count(DISTINCT f.doc_id) AS n FROM f JOIN company_tech e ON e.dst = f.tech_id JOIN companies c ON c.id = e.src WHERE filing_type = '13F-HR' GROUP BY 1),
d AS (SELECT f.tech_id, count_if(cash_burn > 0 AND cash_reserves / cash_burn < 12) AS n FROM f JOIN company_tech e ON e.dst = f.tech_id GROUP BY 1)
SELECT id AS tech_id, coalesce(a.n, 0)::BIGINT AS mention_count, coalesce(b.n, 0)::BIGINT AS holdings_docs, coalesce(d.n, 0)::BIGINT AS short_runway
FROM technologies LEFT JOIN a ON a.tech_id = id LEFT JOIN b ON b.tech_id = id LEFT JOIN d ON d.tech_id = id""")
