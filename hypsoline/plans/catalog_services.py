"""Registered queries: what is kept of paged services, parsers of raw documents, text index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import register
from ..sources import parsers as P
from ..sources import readers as R
from ..sources import services as W

#: Rows of pages: a supplier is a query, its lines are rows in the order of keys, dealt to pages.
PAGED = """pg AS (SELECT l_suppkey AS query, (row_number() OVER w - 1) // {size} AS page, row_number() OVER w AS pos, l_partkey AS id, l_orderkey, l_linenumber FROM lineitem
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity))"""


def paged(m, size: int):
    at = F.expr("row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)")
    rows = m.lineitem.withColumn("at", at)
    return rows.select(F.col("l_suppkey").alias("query"), F.floor((F.col("at") - 1) / size).cast("int").alias("page"), "at", F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber")


register("src25_scroll", lambda m: W.reached(paged(m, 100), 100, 250).select("query", "page", "at"), f"{PAGED.format(size=100)} SELECT query, page::INT AS page, pos::INT AS \"at\" FROM pg WHERE pos <= 250")
register("src25_by_assignee", lambda m: W.by_assignee(paged(m, 100), 150).select("id", "query"), f"{PAGED.format(size=100)} SELECT id, query FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query, page, pos) AS r FROM pg WHERE pos <= 150) t WHERE r = 1")
register("src25_missing_page", lambda m: W.reached(paged(m, 50).where("page <> 2"), 50).groupBy("query").agg(F.count("*").alias("n")), f"{PAGED.format(size=50)} SELECT query, count(*) AS n FROM pg WHERE page < 2 GROUP BY 1")


def papers(m):
    rows = paged(m, 500).join(m.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), (F.lit(2000) + F.col("p_size")).alias("year")), "id")
    return W.by_title_or_abstract(rows, ["ring", "economy"], 2010, 2030).select("query", "at", "id")


register("src26_by_title_or_abstract", papers, f"{PAGED.format(size=500)} SELECT query, pos::INT AS \"at\", id FROM pg JOIN part ON p_partkey = id WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'economy')) AND p_size BETWEEN 10 AND 30")
register("src27_one_page", lambda m: W.one_page(paged(m, 100)).select("query", "at"), f"{PAGED.format(size=100)} SELECT query, pos::INT AS \"at\" FROM pg WHERE pos <= 100")
register("src28_news_range", lambda m: m.news.where(F.col("keyword").isin("click", "view") & F.col("day").between("2024-01-03", "2024-01-09")).select("seq", "keyword"), "SELECT seq, keyword FROM news WHERE keyword IN ('click', 'view') AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'")
register("src29_repositories", lambda m: W.repositories(paged(m, 100), 75).select("id", "query"), f"{PAGED.format(size=100)} SELECT id, query FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query, page, pos) AS r FROM pg) t WHERE r = 1 ORDER BY query, page, pos LIMIT 75")
register("src30_most_cited", lambda m: W.most_cited(m.documents_g.select(F.col("doc_id").alias("id"), F.col("citation_count").alias("cited")), 200), "SELECT doc_id AS id, citation_count AS cited FROM documents_g ORDER BY cited DESC, id LIMIT 200")


def five_sources(m):
    part = m.part.select(F.col("p_partkey").cast("string").alias("doi"), "p_name", "p_size")
    return R.union_sources([part.where(f"p_size % 5 = {i} OR p_size % 7 = {i}").withColumn("found_in", F.lit(i)).drop(*(["p_size"] if i % 2 else [])) for i in range(5)], ["doi"]).select("doi", "found_in")


register("src31_five_sources", five_sources, "SELECT p_partkey::VARCHAR AS doi, min(i)::INT AS found_in FROM part JOIN range(5) r(i) ON p_size % 5 = i OR p_size % 7 = i GROUP BY 1")


def agency(m):
    rows = paged(m, 50).withColumn("page", F.col("page") + 1).withColumn("total_pages", F.when(F.col("page") == 1, (F.col("query") % 3 + 1).cast("int")))
    return W.agency_documents(rows.join(m.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("text")), "id"), ["bolt", "brand#1"]).select("id", "query")


register("src32_agency_documents", agency, f"""{PAGED.format(size=50)} SELECT id, query FROM (SELECT id, query, row_number() OVER (PARTITION BY id ORDER BY query, page, pos) AS r FROM pg JOIN part ON p_partkey = id
WHERE page <= query % 3 AND (contains(lower(p_name || ' ' || p_brand), 'bolt') OR contains(lower(p_name || ' ' || p_brand), 'brand#1'))) t WHERE r = 1""")
register("src33_company_filings", lambda m: W.company_filings(m.documents_g.select(F.concat_ws("-", F.lit("00"), "doc_id").alias("accession"), "filing_type", F.col("published_at").cast("string").alias("filed")), ["10-K", "10-Q"], "1996-01-01", "1997-12-31").select("accession", "filing_type"), "SELECT '00' || doc_id AS accession, filing_type FROM documents_g WHERE filing_type IN ('10-K', '10-Q') AND published_at BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
register("src34_ticker_quarters", lambda m: W.ticker_quarters(m.companies.select("ticker"), "2023-01-15", "2024-01-15"), "SELECT ticker, q AS quarter FROM companies, (SELECT DISTINCT year(d) || 'Q' || quarter(d) AS q FROM (SELECT unnest(generate_series(DATE '2023-01-15', DATE '2024-01-15', INTERVAL 90 DAY)) AS d) t) u")


def links(m):
    html = F.concat(F.lit('<p><a class="x" href="/a/'), "p_partkey", F.lit('"><b>'), "p_name", F.lit(' press release</b></a> <A HREF="/b">short</A>'))
    return W.scraped_links(m.part.select("p_partkey", html.alias("html")), ["ring", "gear"], 15, "p_partkey")


register("src35_scraped_links", links, "SELECT p_partkey, '/a/' || p_partkey AS link, p_name || ' press release' AS title FROM part WHERE length(p_name) + 14 >= 15 AND (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear'))")
register("src36_single_search", lambda m: W.one_page(paged(m, 10), 10).select("query", "id", "at"), f"{PAGED.format(size=10)} SELECT query, id, pos::INT AS \"at\" FROM pg WHERE pos <= 10")
register("src47_first_keywords", lambda m: W.one_page(paged(m, 20).join(m.supplier.orderBy("s_suppkey").limit(15).select(F.col("s_suppkey").alias("query")), "query", "left_semi"), 20).select("query", "at"), f"{PAGED.format(size=20)} SELECT query, pos::INT AS \"at\" FROM pg WHERE pos <= 20 AND query IN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 15)")
register("src48_keyword_feed", lambda m: m.news.where(W.matches_keywords(F.col("url"), ["site1", "site3"])).select("seq"), "SELECT seq FROM news WHERE contains(lower(url), 'site1') OR contains(lower(url), 'site3')")
register("src49_links_per_ticker", lambda m: W.links_per_ticker(paged(m, 100).withColumnRenamed("query", "ticker")).select("ticker", "at"), f"{PAGED.format(size=100)} SELECT query AS ticker, pos::INT AS \"at\" FROM pg WHERE pos <= 3 AND query IN (SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1 LIMIT 15)")
register("src50_releases", lambda m: m.news.where(F.col("day").between("2024-01-10", "2024-01-20") & W.matches_keywords(F.col("keyword"), ["purchase"])).select("seq"), "SELECT seq FROM news WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND keyword LIKE '%purchase%'")
register("src51_job_rows", lambda m: W.job_rows(m.part.select(F.concat("p_name", F.lit(" at "), "p_brand").alias("title"), F.concat(F.lit("http://j/"), "p_partkey").alias("link"), F.lit(None).cast("string").alias("description"), F.lit("now").alias("pubDate")), "jobs"), "SELECT p_name || ' at ' || p_brand AS title, p_brand AS company, 'http://j/' || p_partkey AS link, '' AS description, 'now' AS published, 'jobs' AS feed, md5('http://j/' || p_partkey) AS job_id FROM part")
register("src53_search_hits", lambda m: W.search_hits(m.part.select(F.col("p_partkey").alias("patent_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.lit("A B , C D,")).alias("inventor"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("").alias("assignee")), F.lit("searched")).select("patent_id", "title", F.array_join("inventors", ";").alias("inventors"), "assignee"), "SELECT p_partkey AS patent_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'A B;C D' ELSE '' END AS inventors, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'searched' END AS assignee FROM part")
register("src59_first_pdf", lambda m: W.first_pdf(m.part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "").otherwise("d").alias("doi"), F.when(F.col("p_partkey") % 5 == 0, F.lit("i")).alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, "http://a").alias("oa"), F.when(F.col("p_partkey") % 3 == 0, "http://b").alias("pmc")), ["oa", "pmc"]).select("p_partkey", "paper_id", F.col("pdf.source").alias("source")), "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'i' WHEN p_partkey % 4 <> 0 THEN 'd' ELSE md5(p_name) END AS paper_id, CASE WHEN p_partkey % 2 = 0 THEN 'oa' WHEN p_partkey % 3 = 0 THEN 'pmc' END AS source FROM part")


def merged_tables(m):
    from .catalog_sources import folder

    at = folder(m)
    quarters = [m.orders.where(f"o_orderkey % 4 = {i}").select("o_orderkey", "o_custkey") for i in range(4)]
    R.write_csv(R.merge_quarters(quarters), at, "\t")
    return R.tsv(m.spark, at, "o_orderkey long, o_custkey long")


register("src19_merge_and_write", merged_tables, "SELECT o_orderkey, o_custkey FROM orders")


def shards(m):
    from .catalog_sources import folder

    at = folder(m)
    for i in range(3):
        R.publish(m.documents_g.where(f"doc_id % 3 = {i}").select("doc_id", "quality_score"), at)
    read = lambda family: R.json_records(m.spark, f"{at}/{family}", "doc_id long, quality_score double", lines=True)
    return read("all").select("doc_id", F.lit("all").alias("family")).unionByName(read("relevant").select("doc_id", F.lit("relevant").alias("family")))


register("src20_checkpoint_shards", shards, "SELECT doc_id, 'all' AS family FROM documents_g UNION ALL SELECT doc_id, 'relevant' FROM documents_g WHERE quality_score >= 0.85")
register("sea7_postings", lambda m: W.postings(m.part, "p_partkey", "p_name", "p_type").select("word", F.col("doc_id").alias("p_partkey"), "n"), "SELECT word, p_partkey, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS word FROM part) t GROUP BY 1, 2")
register("sea10_embedded", lambda m: W.to_embed(m.part, ["p_name", "p_type"]).agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("sized"), F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 3).alias("length")), "SELECT count(*) AS n, count(*) AS sized, round(count(*), 3)::DOUBLE AS length FROM part")

# parsers: raw rows of each kind, made from the tables


def extractor(text):
    """A stand-in for a model: one technology a text."""
    mention = F.struct(F.upper(F.substring(text, 1, 5)).alias("name"), F.lit("subject").alias("role"), F.lit(0.5).alias("strength"), F.lit(0.9).alias("evidence_confidence"), F.substring(text, 1, 20).alias("evidence_text"))
    relation = F.struct(F.lit("Joby").alias("company_name"), F.substring(text, 1, 5).alias("technology_name"), F.lit("develops").alias("relation_type"), F.lit(0.9).alias("evidence_confidence"), F.lit("x").alias("evidence_text"), F.lit("").alias("doc_ref"))
    none = F.array().cast(P.MENTION)
    return F.struct(F.lit(0.9).alias("quality_score"), F.array(mention).alias("tech_mentions"), none.alias("company_mentions"), F.array(relation).alias("company_tech_relations"))


def patents(m):
    k = F.col("p_partkey")
    return m.part.select(k.cast("string").alias("lens_id"), F.col("p_name").alias("title"), F.col("p_name").alias("abstract"), F.col("p_brand").alias("assignee"), (k % 2 == 0).alias("granted"), F.when(k % 4 == 0, "2020-01-01").alias("discontinued"), F.when(k % 3 == 0, F.lit("2000-01-01")).otherwise("2030-01-01").cast("date").alias("expires"), F.lit("2019-05-05").alias("published"))


register("par1_patents", lambda m: P.patents(patents(m), "2024-01-01", extractor).select("doc_id", "legal_status", F.to_date("published_at").alias("published_at"), F.get("tech_mentions", 0)["name"].alias("mention"), F.get("company_tech_relations", 0)["doc_ref"].alias("doc_ref")), "SELECT 'patent_' || p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 1 THEN 'pending' WHEN p_partkey % 4 = 0 THEN 'abandoned' WHEN p_partkey % 3 = 0 THEN 'expired' ELSE 'granted' END AS legal_status, DATE '2019-05-05' AS published_at, upper(p_name[1:5]) AS mention, 'patent_' || p_partkey AS doc_ref FROM part")
register("par2_papers", lambda m: P.papers(m.part.select(F.col("p_partkey").cast("string").alias("lens_id"), F.col("p_name").alias("title"), F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("abstract"), F.lit("2020-02-02").alias("date_published"), F.concat(F.lit("Journal of "), "p_type").alias("venue"))).select("doc_id", "content", "peer_reviewed", "venue_type", "quality_score", F.size("tech_mentions").alias("n")), "SELECT 'paper_' || p_partkey AS doc_id, p_name AS content, true AS peer_reviewed, 'Journal' AS venue_type, 0.0::DOUBLE AS quality_score, 0 AS n FROM part")


def raw_filings(m):
    head = F.concat(F.lit("COMPANY CONFORMED NAME: "), "p_brand", F.lit("\nCONFORMED SUBMISSION TYPE: 10-K\nCONFORMED PERIOD OF REPORT: 20201231\nFILED AS OF DATE: 20210301\n"), F.repeat("p_name", 10))
    return m.part.select(F.concat(F.lit("/f/A-"), "p_partkey").alias("path"), F.when(F.col("p_partkey") % 5 != 0, head).otherwise("short").alias("text"))


register("par3_filings", lambda m: P.filings(raw_filings(m)).select("doc_id", "title", F.to_date("published_at").alias("published_at")), "SELECT 'sec_a_' || p_partkey AS doc_id, CASE WHEN p_partkey % 5 <> 0 THEN p_brand || ' - 10-K - 2021-03-01' ELSE 'SEC Filing' END AS title, CASE WHEN p_partkey % 5 <> 0 THEN DATE '2021-03-01' END AS published_at FROM part")
register("par4_rules", lambda m: P.rules(m.part.select(F.concat(F.lit("2024-"), "p_partkey").alias("fr_doc"), F.col("p_name").alias("title"), F.lit("ACTION: Final rule; approval\nDocket No. FAA-1").alias("text"), F.lit("2024-03-03").alias("published")), "faa").select("doc_id", "document_type", "decision_type"), "SELECT 'regulatory_faa_2024-' || p_partkey AS doc_id, 'final_rule' AS document_type, 'approval' AS decision_type FROM part")
register("par5_news", lambda m: P.news(m.part.select(F.concat(F.lit("http://x/"), "p_partkey").alias("url"), F.col("p_name").alias("title"), F.lit("reuters.com").alias("domain"), F.lit("20240102T030405Z").alias("seendate"), F.col("p_name").alias("text")), extractor).select("doc_id", "outlet_tier", "publisher", F.size("company_mentions").alias("n"), F.get("company_mentions", 0)["role"].alias("role")), "SELECT 'news_article_' || md5('http://x/' || p_partkey)[1:12] AS doc_id, 'Financial Authority' AS outlet_tier, 'Reuters' AS publisher, 1 AS n, 'publisher' AS role FROM part")
register("par7_repositories", lambda m: P.repositories(m.part.select(F.lit("own").alias("owner"), F.concat(F.lit("own/re-po."), "p_partkey").alias("repo_name"), F.lit("2021-01-01").alias("created_at"), F.col("p_name").alias("description"), F.col("p_size").alias("stars"), F.lit(0).alias("forks"))).select("doc_id", "stars"), "SELECT 'github_own_re_po_' || p_partkey AS doc_id, p_size AS stars FROM part")


def errors(m):
    """Lines that can't be parsed are rows with the line in the column for it."""
    from .catalog_sources import folder

    at = folder(m)
    m.part.select(F.when(F.col("p_partkey") % 4 == 0, F.lit('{"a": ')).otherwise(F.concat(F.lit('{"a": '), "p_partkey", F.lit("}"))).alias("value")).write.text(at)
    rows = m.spark.read.schema(R.with_errors("a long")).json(at)
    return rows.select((F.col("_corrupt_record").isNotNull() & F.col("a").isNull()).alias("bad")).groupBy("bad").agg(F.count("*").alias("n"))


register("par12_error_rows", errors, "SELECT p_partkey % 4 = 0 AS bad, count(*) AS n FROM part GROUP BY 1")
register("par18_lookup", lambda m: m.technologies.join(m.spark.range(3).select((F.col("id") * 10).alias("id")), "id").select("id", "name"), "SELECT id, name FROM technologies WHERE id IN (0, 10, 20)")
register("str5_all_technologies", lambda m: m.technologies.select("id").join(m.tech_mentions.groupBy(F.col("tech_id").alias("id")).agg(F.count("*").alias("mentions")), "id", "left").fillna(0), "SELECT id, coalesce(n, 0)::BIGINT AS mentions FROM technologies LEFT JOIN (SELECT tech_id, count(*) AS n FROM tech_mentions GROUP BY 1) t ON tech_id = id")
register("par6_contracts", lambda m: P.contracts(m.orders.select(F.concat(F.lit("A/"), "o_orderkey").alias("award_id"), F.lit("Joby").alias("recipient_name"), F.lit("Air Force").alias("awarding_sub_agency"), F.lit("Department of Defense").alias("awarding_agency"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"), F.lit("2001-08-01").alias("end_date"), F.col("o_totalprice").alias("award_amount"), F.lit("text").alias("description"))).select("doc_id", "title", F.to_date("published_at").alias("published_at"), "duration_days", "size_band", "agency_type"), "SELECT 'contract_A_' || o_orderkey AS doc_id, 'Joby - Air Force Contract' AS title, o_orderdate::DATE AS published_at, (DATE '2001-08-01' - o_orderdate::DATE)::INT AS duration_days, CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 1000000 THEN 'medium' ELSE 'large' END AS size_band, 'defense' AS agency_type FROM orders")


def notices(m):
    from ..functions import scalars as S
    from .catalog_sources import NOTICE

    text = F.concat(F.lit("ACTION: Proposed rule\nDocket No. FAA-"), "p_partkey", F.lit("\n"), F.expr(NOTICE), F.lit("\nwrite to a@b.gov"))
    return m.part.select("p_partkey", S.rule_metadata(text, F.concat(F.lit("faa_2024-"), "p_partkey", F.lit(".md"))).alias("x")).select("p_partkey", "x.*")


register("par8_rule_metadata", notices, """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'FAA' WHEN p_partkey % 3 = 0 THEN 'Office of X' ELSE 'Some Board' END AS regulatory_body, CASE WHEN p_partkey % 6 = 0 THEN 'Office of X' END AS sub_agency, 'FAA-' || p_partkey AS docket_number,
'proposed_rule' AS document_type, 'proposal' AS decision_type, DATE '2024-03-01' + (p_partkey % 28)::INT AS effective_date, DATE '2024-05-05' AS comment_deadline, 'a@b.gov' AS contact_email, '2024-' || p_partkey AS federal_register_doc_id FROM part""")


def filing_nodes(m):
    from ..operators.upsert import document_properties

    return document_properties(m.documents_g, "sec_filing").select("doc_id", "published_at", "filing_type", "risk_factor_mentioned", "cik")


register("ups4_filing_nodes", filing_nodes, "SELECT doc_id, published_at::VARCHAR AS published_at, filing_type, risk_factor_mentioned, NULL::VARCHAR AS cik FROM documents_g WHERE doc_type = 'sec_filing'")
