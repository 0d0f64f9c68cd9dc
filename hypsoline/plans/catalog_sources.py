"""Registered queries: scans of written files, extraction records, harvested records, batches, coverage, further scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import chunks as K
from ..functions import scalars as S
from ..operators import control as C
from ..operators import diagnostics as D
from ..operators import graph as G
from ..operators import harvest as H
from ..operators import resolution as E
from ..operators import scoring as P
from ..operators import upsert as U
from ..operators.basics import between
from ..registry import register
from ..sources import harvested as V
from ..sources import readers as R
from .catalog_scoring import RANKED, SCORES_SQL, chart, scores
from .lineage import freed, shared_dir
from .model import SQL


def folder(m) -> str:
    return f"{shared_dir(m.spark)}/f-{uuid.uuid4().hex}"


# scans: a table is written in the format, whole, and read back by the declared schema


def filings(m) -> dict[str, DataFrame]:
    info = m.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ACCESSION_NUMBER"), F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("CUSIP"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("NAMEOFISSUER"), F.round("l_extendedprice", 2).alias("VALUE"), F.col("l_quantity").alias("SSHPRNAMT"), *[F.lit(None).cast("string").alias(c) for c in ("SSHPRNAMTTYPE", "PUTCALL", "INVESTMENTDISCRETION")], *[F.lit(None).cast("long").alias(c) for c in ("VOTING_AUTH_SOLE", "VOTING_AUTH_SHARED", "VOTING_AUTH_NONE")])
    at = folder(m)
    info.write.csv(f"{at}/INFOTABLE.tsv", sep="\t", header=True, emptyValue="", nullValue="")
    return R.tsv_folder(m.spark, at, {"INFOTABLE": R.FORM13F["INFOTABLE"]})


register("src1_filing_tables", lambda m: filings(m)["INFOTABLE"].select(F.col("ACCESSION_NUMBER").alias("accession"), F.col("CUSIP").alias("cusip"), F.col("NAMEOFISSUER").alias("issuer"), F.col("VALUE").alias("value"), F.col("SSHPRNAMT").alias("shares")), """
SELECT l_orderkey || '-' || l_linenumber AS accession, lpad(l_partkey::VARCHAR, 9, '0') AS cusip, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS issuer, round(l_extendedprice, 2) AS value, l_quantity AS shares FROM lineitem""")


def owners(m):
    at = folder(m)
    rows = m.supplier.select(F.concat(F.lit("a"), "s_suppkey").alias("ACCESSION_NUMBER"), F.col("s_suppkey").cast("string").alias("RPTOWNERCIK"), F.col("s_name").alias("RPTOWNERNAME"), F.when(F.col("s_suppkey") % 2 == 0, "OFFICER").alias("RPTOWNER_RELATIONSHIP"), F.lit(None).cast("string").alias("RPTOWNER_TITLE"))
    rows.write.csv(at, sep="\t", header=True, emptyValue="", nullValue="")
    return R.tsv(m.spark, at, R.INSIDER["REPORTINGOWNER"]).select(F.col("RPTOWNERCIK").alias("cik"), F.col("RPTOWNERNAME").alias("owner"), F.col("RPTOWNER_RELATIONSHIP").alias("relationship"))


register("src2_insider_tables", owners, "SELECT s_suppkey::VARCHAR AS cik, s_name AS owner, CASE WHEN s_suppkey % 2 = 0 THEN 'OFFICER' END AS relationship FROM supplier")


def merged_quarters(m):
    a = m.orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice")
    return R.merge_quarters([a, m.orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey")])


register("src3_merged_quarters", merged_quarters, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS o_custkey FROM orders")


def records(m) -> DataFrame:
    """Extraction records, one a document of the graph: its mentions as aliases of technologies, and its relations.

    The raw columns are shuffled by document once for each array, which serves the removal of repeats, the grouping and the
    joins; texts are made after that."""
    lines, orders = m.lineitem.repartition("l_orderkey"), m.orders.repartition("o_orderkey")
    tech_mentions = m.spark.sql(SQL["tech_mentions"], mention_rows=m.spark.sql(SQL["mention_rows"], lineitem=lines))
    company_tech = m.spark.sql(SQL["company_tech"], lineitem=lines)
    documents = m.spark.sql(SQL["documents_g"], orders=orders)
    mention = F.struct(F.concat(F.lit(" P"), F.col("tech_id").cast("string")).alias("name"), "role", "strength", "evidence_confidence", "evidence_text")
    mentions = tech_mentions.groupBy("doc_id").agg(F.collect_list(mention).alias("tech_mentions"))
    relation = F.struct(F.concat(F.lit("s"), "src").alias("company_name"), F.concat(F.lit("p"), "dst").alias("technology_name"), "relation_type", "evidence_confidence", "evidence_text", F.lit(None).cast("string").alias("doc_ref"))
    relations = company_tech.groupBy(F.col("doc_ref").alias("doc_id")).agg(F.collect_list(relation).alias("company_tech_relations"))
    doc = documents.select("doc_id", F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_type") == "news", "news_article").when(F.col("doc_type") == "github", "github_repository").otherwise(F.col("doc_type")).alias("doc_type"), "title", F.when(F.col("doc_type") == "patent", F.col("published_at").cast("string")).alias("published_at"), F.when(F.col("doc_type") == "news", F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'")).alias("seendate"), F.when(~F.col("doc_type").isin("news", "patent"), F.col("published_at").cast("string")).alias("publication_date"), F.lit("about").alias("abstract"), F.when(F.col("quality_score") > 0.5, F.col("quality_score")).alias("quality_score")).alias("document"))
    return doc.join(mentions, "doc_id", "left").join(relations, "doc_id", "left").drop("doc_id")


def read_records(m) -> DataFrame:
    at = folder(m)
    with freed(m.spark):
        records(m).write.option("compression", "gzip").json(at)
    return m.spark.read.schema(R.RECORD).json(at)


def tables(m) -> dict[str, DataFrame]:
    tech = m.part.select(F.lower(F.concat(F.lit("P"), "p_partkey")).alias("key"), F.col("p_partkey").alias("id"))
    company = m.supplier.select(F.lower(F.concat(F.lit("S"), "s_suppkey")).alias("key"), F.col("s_suppkey").alias("id"))
    return R.split_record(read_records(m), tech, company)


register("src4_records", lambda m: read_records(m).select("document.doc_id", F.greatest(F.size("tech_mentions"), F.lit(0)).alias("mentions")), "SELECT d.doc_id::VARCHAR AS doc_id, count(t.doc_id)::INT AS mentions FROM documents_g d LEFT JOIN tech_mentions t ON t.doc_id = d.doc_id GROUP BY 1")
register("src5_documents", lambda m: tables(m)["documents"].select("doc_id", "doc_type", F.to_date("published_at").alias("published_at"), "summary", "quality_score"), "SELECT doc_id::VARCHAR AS doc_id, doc_type, published_at, 'about' AS summary, CASE WHEN quality_score > 0.5 THEN quality_score ELSE 0 END::DOUBLE AS quality_score FROM documents_g")
register("src6_tech_mentions", lambda m: tables(m)["tech_mentions"].select("doc_id", "tech_id", "role", "strength"), "SELECT doc_id::VARCHAR AS doc_id, tech_id, role, strength FROM tech_mentions WHERE doc_id IN (SELECT doc_id FROM documents_g)")
register("src8_company_tech", lambda m: tables(m)["company_tech"].select("doc_ref", "src", "dst", "relation_type"), "SELECT doc_ref::VARCHAR AS doc_ref, src, dst, relation_type FROM company_tech WHERE doc_ref IN (SELECT doc_id FROM documents_g)")
register("src14_unresolved", lambda m: R.unresolved(records(m), m.part.where("p_partkey % 2 = 0").select(F.lower(F.concat(F.lit("P"), "p_partkey")).alias("key"), "p_partkey")), "SELECT ' P' || tech_id AS name, count(*) AS n FROM tech_mentions WHERE tech_id % 2 = 1 AND doc_id IN (SELECT doc_id FROM documents_g) GROUP BY 1")


def whole(m):
    at = folder(m)
    m.documents.where("text IS NOT NULL").select(F.to_json(F.struct("doc_id", "lang")).alias("value")).repartition(7).write.text(at)
    return m.spark.read.schema("doc_id long, lang string").json(at)


register("src12_json_folder", lambda m: whole(m), "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL")
register("src15_parse_date", lambda m: m.orders.select("o_orderkey", F.to_date(S.parse_date(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")))).alias("d")), "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS d FROM orders")


def catalogue(m, wrapped: bool):
    """A catalogue written as a list of entries or as an object around it, read by one reader."""
    entry = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("S"), "s_suppkey")).alias("aliases"))
    rows = m.supplier.agg(F.array_sort(F.collect_list(entry)).alias("technologies"))  # a catalogue is one file
    at = folder(m)
    text = F.to_json(F.struct("technologies")) if wrapped else F.to_json("technologies")
    rows.select(text.alias("value")).coalesce(1).write.text(at)
    return V.catalog_file(m.spark, at)


register("src18_catalog_list", lambda m: E.alias_table(catalogue(m, False)).select("key", "id"), "SELECT lower(s_name) AS key, s_suppkey::VARCHAR AS id FROM supplier UNION ALL SELECT 's' || s_suppkey, s_suppkey::VARCHAR FROM supplier")
register("src18_catalog_object", lambda m: catalogue(m, True).select("id", "name", F.array_join("aliases", ",").alias("aliases")), "SELECT s_suppkey::VARCHAR AS id, s_name AS name, 'S' || s_suppkey AS aliases FROM supplier")


def inline(m):
    """Every order carries its customer and a name that only it uses; customers of even number are in the catalogue."""
    entity = F.struct(F.col("o_custkey").alias("id"), F.concat(F.lit("Customer "), "o_custkey").alias("name"), F.array(F.concat(F.lit("C"), "o_orderkey")).alias("aliases"))
    rows = m.orders.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("doc_id"), F.array(entity).alias("entities"))
    known = m.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    return V.inline_entities(rows, "entities", known).select("id", "name", F.size("aliases").alias("n_aliases"))


register("src17_inline_entities", inline, """
o AS (SELECT o_custkey AS id, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS id, c_name AS name, CASE WHEN o.n IS NULL THEN 0 ELSE o.n + 1 END::INT AS n_aliases FROM customer LEFT JOIN o ON o.id = c_custkey WHERE c_custkey % 2 = 0
UNION ALL SELECT id, 'Customer ' || id, n::INT FROM o WHERE id % 2 = 1 OR id NOT IN (SELECT c_custkey FROM customer)""")
register("src16_catalog_upsert", lambda m: U.merge_nodes(m.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), m.lineitem.select(F.col("l_suppkey").alias("id"), F.concat(F.lit("new "), "l_partkey").alias("name"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq")).where("id % 3 = 0"), "id", "seq"), """
n AS (SELECT l_suppkey AS id, arg_max('new ' || l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS name FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
SELECT coalesce(n.id, s_suppkey) AS id, coalesce(n.name, s_name) AS name FROM supplier FULL JOIN n ON n.id = s_suppkey""")


def filing_names(m):
    path = F.concat(F.lit("/x/AAPL_10-K_2024-01-"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("_0001_2.txt"))
    return m.part.select("p_partkey", R.filing_name(path).alias("f")).select("p_partkey", "f.*")


register("src22_filing_name", filing_names, "SELECT p_partkey, 'AAPL' AS ticker, '10-K' AS filing_type, '2024-01-' || lpad(p_partkey::VARCHAR, 7, '0') AS date, '0001_2' AS accession FROM part")


def texts(m):
    at = folder(m)
    m.supplier.select(F.concat_ws("\n", "s_name", F.lit("second line")).alias("value")).repartition(5).write.text(at)
    return R.whole_texts(m.spark, at).agg(F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"), F.sum(F.length("text")).alias("characters"))


register("src21_whole_texts", texts, "SELECT (2 * count(*))::BIGINT AS lines, sum(length(s_name) + 13)::BIGINT AS characters FROM supplier")


def feed(m):
    at = folder(m)
    date = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss '+0000'")).otherwise("")
    item = F.concat(F.lit("<item><title>T"), "event_id", F.lit("</title><link>http://a.b/"), "event_id", F.lit("</link><pubDate>"), date, F.lit("</pubDate></item>"))
    files = m.events.groupBy((F.col("event_id") % 64).alias("file")).agg(F.array_join(F.collect_list(item), "\n").alias("items"))
    rss = files.select(F.concat(F.lit("<rss><channel>\n"), "items", F.lit("\n</channel></rss>")).alias("value")).repartition(64)
    rss.write.option("maxRecordsPerFile", 1).text(at)  # a second root in a file would end its reading
    return R.feed(m.spark, at, "2024-01-05", "2024-01-20").select("title", F.to_date("published").alias("d"))


register("src24_feed", feed, """SELECT 'T' || event_id AS title, CASE WHEN event_id % 5 <> 0 THEN ts::DATE END AS d FROM events WHERE event_id % 5 = 0 OR ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")


def scored_papers(m):
    k = F.col("p_partkey").cast("string")
    node = F.struct(k.alias("node_id"), F.lit("technology").alias("node_type"), F.col("p_name").alias("name"), F.lit("").alias("description"), F.lit("early").alias("maturity"), F.col("p_type").alias("domain"))
    rel = F.struct(k.alias("subject"), F.lit("uses").alias("predicate"), F.lit("x").alias("object"), F.lit(0.9).alias("confidence"), F.lit("because of this").alias("evidence"))
    signals = F.struct(F.lit("lab").alias("research_stage"), F.lit("incremental").alias("innovation_type"), F.lit("high").alias("impact_potential"), F.lit("low").alias("technical_risk"), F.array(F.lit("pilot"), F.col("p_brand")).alias("adoption_indicators"))
    meta = F.struct(k.alias("lens_id"), F.col("p_name").alias("title"), F.lit(2020).alias("year_published"), F.lit("article").alias("publication_type"), F.lit("J").alias("journal"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("url"))
    fit = F.struct((F.col("p_size") / 5.0).alias("relevance_score"), (F.col("p_size") > 25).alias("is_relevant"), F.lit("core").alias("relevance_category"), F.lit(0.8).alias("confidence"), F.lit("so").alias("justification"))
    nodes = F.when(F.col("p_partkey") % 3 == 0, F.array(node, node)).when(F.col("p_partkey") % 3 == 1, F.array(node))
    return m.part.select(meta.alias("paper_metadata"), fit.alias("relevance_assessment"), nodes.alias("technology_nodes"), F.array(rel).alias("relationships"), signals.alias("innovation_signals"))


register("src41_paper_nodes", lambda m: R.paper_tables(scored_papers(m))["technology_nodes"].select("lens_id", "name", "domain"), "SELECT p_partkey::VARCHAR AS lens_id, p_name AS name, p_type AS domain FROM part, range(2) r(i) WHERE p_partkey % 3 = 0 OR p_partkey % 3 = 1 AND i = 0")
register("src42_adoption_indicators", lambda m: R.paper_tables(scored_papers(m))["adoption_indicators"], "SELECT p_partkey::VARCHAR AS lens_id, unnest(['pilot', p_brand]) AS indicator FROM part")


def run_history(m):
    at = folder(m)
    for run in ("2024-01-01_10-00-00_40tech_v1", "2024-02-01_10-00-00_40tech_v1"):
        R.save_run(m.technologies.where(F.col("id") % len(run) < 15).select("id", F.lit(run[5:7]).alias("month")), at, run)
    return at


register("src43_list_runs", lambda m: R.list_runs(m.spark, run_history(m)), "SELECT run_id, count(*) AS technologies FROM technologies, (VALUES ('2024-01-01_10-00-00_40tech_v1'), ('2024-02-01_10-00-00_40tech_v1')) r(run_id) WHERE id % 29 < 15 GROUP BY 1")
register("src45_get_run", lambda m: R.get_run(m.spark, run_history(m), "2024-02-01_10-00-00_40tech_v1").select("id", "month"), "SELECT id, '02' AS month FROM technologies WHERE id % 29 < 15")
register("par20_latest_chart", lambda m: C.latest_chart(m.spark.read.parquet(run_history(m))).select("id", F.col("run_id").cast("string").alias("run_id")), "SELECT id, '2024-02-01_10-00-00_40tech_v1' AS run_id FROM technologies WHERE id % 29 < 15")


def written(m, how: str):
    at = folder(m)
    df = m.supplier.select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))
    R.write_json(df, at) if how == "json" else R.write_csv(df, at)
    schema = "s_suppkey long, s_name string, s_acctbal double"
    return m.spark.read.schema(schema).json(at) if how == "json" else m.spark.read.schema(schema).csv(at, header=True)


for how, n in (("json", 46), ("csv", 44)):
    register(f"src{n}_write_{how}", lambda m, how=how: written(m, how), "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
register("src56_checkpoint", lambda m: C.resume(m.events.select(F.col("event_id").alias("index"), "user_id"), m.events.where("event_id % 3 = 0").select(F.col("event_id").alias("index"))), "SELECT event_id AS index, user_id FROM events WHERE event_id % 3 <> 0")
register("src57_statements", lambda m: V.ticker_dataset(m.orders.select(F.col("o_custkey").alias("ticker"), F.struct("o_orderdate", "o_orderkey").alias("date"), "o_orderkey"), "income_statements", "", "").select("ticker", "o_orderkey"), "SELECT o_custkey AS ticker, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) t WHERE r <= 5")
register("src37_options", lambda m: V.ticker_dataset(m.lineitem.select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("expiry"), "l_orderkey", "l_linenumber"), "options", "", "").select("ticker", "expiry", "l_orderkey", "l_linenumber"), "SELECT ticker, expiry, l_orderkey, l_linenumber FROM (SELECT l_suppkey AS ticker, l_shipdate::DATE AS expiry, l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate::DATE) AS r FROM lineitem) t WHERE r <= 3")
register("src38_dated_news", lambda m: V.ticker_dataset(m.news.select(F.col("keyword").alias("ticker"), F.col("day").alias("published_date"), "seq"), "news", "2024-01-10", "2024-01-12").select("ticker", "seq"), "SELECT keyword AS ticker, seq FROM news WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")


def patents54(m):
    return m.documents_g.select("doc_id", F.col("published_at").alias("patent_date"), F.col("title").alias("patent_title"), F.col("agency").alias("patent_abstract"), F.array(F.col("filing_type")).alias("cpc_codes"))


register("src54_legacy_filter", lambda m: patents54(m).where(V.legacy_patent_filter(["title 12", "HIGH"], ["4"], "1996-01-01", "1998-06-30")).select("doc_id"), "SELECT doc_id FROM documents_g WHERE published_at BETWEEN DATE '1996-01-01' AND DATE '1998-06-30' AND (contains(lower(title), 'title 12') OR contains(lower(title), 'high') OR contains(lower(coalesce(agency, '')), 'title 12') OR contains(lower(coalesce(agency, '')), 'high') OR filing_type = '4')")
register("src55_legacy_metrics", lambda m: V.legacy_patent_metrics(m.documents_g.select(F.col("published_at").alias("app_date"), F.when(F.col("stars") < 500, F.col("published_at")).alias("patent_date"), F.col("citation_count").alias("citedby_patent_count"), F.when(F.col("forks") > 5, F.col("forks")).alias("claims_count")), "1995-01-01", "2001-08-01"), """
SELECT count(*) AS filings, round(count(*) / ((DATE '2001-08-01' - DATE '1995-01-01') / 30), 6) AS filings_per_month, count_if(stars < 500)::BIGINT AS granted, round(count_if(stars < 500) * 100.0::DOUBLE / count(*), 6) AS grant_pct, round(avg(citation_count), 2) AS avg_citations,
max(citation_count) AS max_citations, count_if(citation_count > 10)::BIGINT AS highly_cited, round(avg(CASE WHEN forks > 5 THEN forks END), 2) AS avg_claims, count_if(forks > 20)::BIGINT AS broad FROM documents_g""")
register("src55_top_assignees", lambda m: V.top_assignees(m.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("assignees"))), "SELECT l_suppkey::VARCHAR AS assignee, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, assignee LIMIT 10")
register("src60_pdf_url", lambda m: m.part.select("p_partkey", S.pdf_url(F.when(F.col("p_partkey") % 4 == 0, "http://x/a.pdf"), F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("US"), "p_partkey")), F.when(F.col("p_partkey") % 4 == 2, "http://x/b.html").otherwise("http://x/c")).alias("url")), "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'http://x/a.pdf' WHEN 1 THEN 'https://patents.google.com/patent/US' || p_partkey || '/en' WHEN 2 THEN 'http://x/b.pdf' END AS url FROM part")

# harvested records, written as JSON and read by their schemas


def patent_records(m) -> DataFrame:
    k, odd = F.col("p_partkey"), F.col("p_partkey") % 2 == 1
    en = lambda t: F.struct(F.lit("en").alias("lang"), t.alias("text"))
    de = F.struct(F.lit("de").alias("lang"), F.concat(F.lit("de "), "p_name").alias("text"))
    titles = F.when(odd, F.array(de, en(F.col("p_name")))).when(k % 4 == 0, F.array(de))
    filed = F.when(odd, F.to_json(F.array(F.struct(F.lit("2020-05-05").alias("date"))))).otherwise(F.to_json(F.struct(F.lit("2019-04-04").alias("date"))))
    biblio = F.struct(
        titles.alias("invention_title"), F.struct(F.when(k % 3 == 0, F.array(F.struct(F.col("p_brand").alias("name")))).alias("applicants"), F.array(F.struct(F.lit("A B").alias("name")), F.struct(F.lit("").alias("name"))).alias("inventors")).alias("parties"),
        filed.alias("application_reference"), F.array(F.struct(F.lit("B64C").alias("symbol")), F.struct(F.lit("").alias("symbol"))).alias("classifications_cpc"), F.struct(k.alias("patent_count")).alias("references_cited"),
        F.struct(F.array(F.struct(F.lit("c1").alias("lens_id")), F.struct(F.lit("c2").alias("lens_id"))).alias("patents")).alias("cited_by"),
    )
    claims = F.when(odd, F.lit("A:\n1. one\n 2. two\nx 3. no")).otherwise(F.to_json(F.array(en(F.lit("B:\n10. ten")))))
    status = F.struct((k % 5 == 0).alias("granted"), F.when(k % 10 == 0, "2021-06-06").alias("grant_date"))
    return m.part.select(k.cast("string").alias("lens_id"), F.concat(F.lit("US"), k).alias("doc_number"), F.lit("2021-01-01").alias("date_published"), biblio.alias("biblio"), status.alias("legal_status"), claims.alias("claims"), F.lit("plain").alias("description"))


def flat_patents(m):
    at = folder(m)
    patent_records(m).write.json(at)
    out = V.flat_patents(m.spark.read.schema(V.PATENT).json(at), F.lit("searched"))
    listed = lambda c: F.array_join(c, ",").alias(c)
    return out.select("lens_id", "patent_number", "title", "assignee", listed("inventors"), "filing_date", "grant_date", "claims_count", listed("cpc_codes"), "citation_count", "type", "forward_citation_count", listed("forward_citation_lens_ids"), "description", "publication_type", "simple_family_size")


register("har13_flat_patents", flat_patents, """SELECT p_partkey::VARCHAR AS lens_id, 'US' || p_partkey AS patent_number, CASE WHEN p_partkey % 2 = 1 THEN p_name WHEN p_partkey % 4 = 0 THEN 'de ' || p_name ELSE '' END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'searched' END AS assignee, 'A B' AS inventors,
CASE WHEN p_partkey % 2 = 1 THEN '2020-05-05' ELSE '2019-04-04' END AS filing_date, CASE WHEN p_partkey % 10 = 0 THEN '2021-06-06' WHEN p_partkey % 5 = 0 THEN '2021-01-01' ELSE '' END AS grant_date, CASE WHEN p_partkey % 2 = 1 THEN 2 ELSE 1 END AS claims_count, 'B64C' AS cpc_codes, p_partkey AS citation_count,
CASE WHEN p_partkey % 5 = 0 THEN 'granted' ELSE 'application' END AS type, 2 AS forward_citation_count, 'c1,c2' AS forward_citation_lens_ids, 'plain' AS description, 'UNKNOWN' AS publication_type, 0::BIGINT AS simple_family_size FROM part""")


def paper_records(m) -> DataFrame:
    k = F.col("p_partkey")
    grant = F.struct(F.when(k % 3 == 0, "nasa grant").when(k % 3 == 1, "the acme fund").alias("organisation"), F.lit("F1").alias("funding_id"))
    author = F.struct(F.col("p_name").alias("display_name"), F.array(F.struct(F.lit("MIT").alias("name"))).alias("affiliations"))
    return m.part.select(k.cast("string").alias("lens_id"), F.when(k % 4 != 0, F.col("p_name")).alias("title"), F.lit("<p>An abstract</p>").alias("abstract"), F.when(k % 2 == 0, F.array(grant)).alias("funding"), F.array(author, author).alias("authors"), F.when(k % 7 != 0, k).alias("references_count"), F.struct(F.col("p_brand").alias("title")).alias("source"))


def read_papers(m):
    at = folder(m)
    paper_records(m).write.json(at)
    return m.spark.read.schema(V.PAPER).json(at)


register("har15_flat_papers", lambda m: V.flat_papers(read_papers(m), F.lit("rotor")).select("lens_id", "title", "abstract", F.get("funding", 0)["organisation"].alias("funder"), F.get("funding", 0)["organisation_raw"].alias("funder_raw"), "author_count", F.get("authors", 1)["affiliations"][0]["name"].alias("place"), "references_count", F.col("source.title").alias("venue"), F.col("source.country").alias("country"), "matched_keyword", "url"), """
SELECT p_partkey::VARCHAR AS lens_id, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE 'Untitled' END AS title, '<p>An abstract</p>' AS abstract, CASE WHEN p_partkey % 2 = 0 THEN ['NASA', 'The Acme Fund', 'Unknown'][p_partkey % 3 + 1] END AS funder,
CASE WHEN p_partkey % 2 = 0 THEN ['nasa grant', 'the acme fund', 'Unknown'][p_partkey % 3 + 1] END AS funder_raw, 2 AS author_count, 'MIT' AS place, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey ELSE 0 END AS references_count, p_brand AS venue, '' AS country, 'rotor' AS matched_keyword, 'https://link.lens.org/' || p_partkey AS url FROM part""")
register("src11_paper_metadata", lambda m: V.paper_metadata(read_papers(m)).select("lens_id", "references_count", "citing_patent_count", "fields_of_study", F.length("authors").alias("n")), """SELECT p_partkey::VARCHAR AS lens_id, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey ELSE 0 END AS references_count, 0::BIGINT AS citing_patent_count, '[]' AS fields_of_study,
(3 + 2 * (length('{"display_name":"","affiliations":[{"name":"MIT"}]}') + length(p_name)))::INT AS n FROM part""")
register("har17_funding_summary", lambda m: V.funding_summary(read_papers(m)), "SELECT count(*) AS papers, count_if(p_partkey % 2 = 0)::BIGINT AS with_funding, round(count_if(p_partkey % 2 = 0) * 100.0::DOUBLE / count(*), 2) AS pct FROM part")
register("har17_top_funders", lambda m: V.top_funders(V.flat_papers(read_papers(m), F.lit(""))), "SELECT ['NASA', 'The Acme Fund', 'Unknown'][p_partkey % 3 + 1] AS organisation, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
SOURCE = "element_at(array('federal_register', 'rss', 'other'), CAST(p_partkey % 3 AS INT) + 1)"
register("har21_pdf_routes", lambda m: m.part.select("p_partkey", V.pdf_route(F.expr(SOURCE), F.when(F.col("p_partkey") % 2 == 0, "x.pdf"), F.when(F.col("p_partkey") % 5 != 0, "http://x")).alias("route")), """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'federal_register' WHEN p_partkey % 3 = 1 OR (p_partkey % 2 = 1 AND p_partkey % 5 <> 0) THEN 'rss_feeds' END AS route FROM part""")
register("har23_is_pdf", lambda m: m.part.select("p_partkey", V.is_pdf(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).cast("binary")).alias("pdf")), "SELECT p_partkey, p_partkey % 3 = 0 AS pdf FROM part")
register("har24_filenames", lambda m: m.part.select("p_partkey", V.pdf_filename(F.lit("Federal Aviation (FAA)"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("2024/"), "p_partkey")), F.concat(F.lit("On: "), "p_name"), F.lit("2024-01-02")).alias("name")), "SELECT p_partkey, 'federal-aviation-faa_' || CASE WHEN p_partkey % 2 = 0 THEN '2024' || p_partkey ELSE '2024-01-02_On' || replace(p_name, ' ', '') END || '.pdf' AS name FROM part")
register("har24_rss_id", lambda m: m.pages.select("page_id", V.rss_id(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("N"), "page_id")), F.col("url"), F.lit("t")).alias("id")), "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'N' || page_id ELSE 'rss_' || md5(url)[1:12] END AS id FROM pages")
register("har34_entry_date", lambda m: m.orders.select("o_orderkey", F.to_date(V.entry_date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss '+0000'")), F.when(F.col("o_orderkey") % 3 == 1, F.lit("never")), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("d")), "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders")
JSON = ['{"data": [1, 2, 3]}', '[{"a": 1}, {"a": 2}]', '{"total": 17}', '{"x": 1}', "3", "{broken", '{"items": []}', '{"data": 5, "count": 4}']
register("har36_record_counts", lambda m: m.part.select("p_partkey", V.record_count(F.element_at(F.array(*[F.lit(j) for j in JSON]), (F.col("p_partkey") % 8).cast("int") + 1)).alias("n")), "SELECT p_partkey, [3, 2, 17, 1, 0, 0, 0, 4][p_partkey % 8 + 1]::INT AS n FROM part")


def per_source(m):
    return m.part.groupBy(F.col("p_type").alias("layer"), F.col("p_brand").alias("name")).agg((F.count("*") % 7).cast("int").alias("files"), F.sum("p_size").cast("long").alias("records"))


register("har37_source_table", lambda m: V.source_table(per_source(m)), "SELECT p_type AS layer, CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY p_brand) = 1 THEN '**' || p_type || '**' ELSE '' END AS label, p_brand AS name, (count(*) % 7)::INT AS files, sum(p_size)::BIGINT AS records, CASE WHEN count(*) % 7 = 0 THEN 'Empty' WHEN count(*) % 7 < 5 THEN 'Minimal' ELSE 'Active' END AS status FROM part GROUP BY 1, 3")
register("har39_source_totals", lambda m: C.source_totals(m.documents.select("source", F.when(F.col("doc_id") % 4 != 0, 1).otherwise(0).alias("ok"), F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("failed"))), "SELECT coalesce(source, 'all') AS source, count_if(doc_id % 4 <> 0)::BIGINT AS ok, count_if(doc_id % 4 = 0)::BIGINT AS failed, round(count_if(doc_id % 4 <> 0) * 100.0::DOUBLE / count(*), 4) AS rate FROM documents GROUP BY ROLLUP (source)")
register("har46_gold_index", lambda m: V.gold_index(scored_papers(m).select("paper_metadata.lens_id", "paper_metadata.title", "technology_nodes", "relationships")), "SELECT p_partkey::VARCHAR AS lens_id, p_name AS title, [2, 1, 0][p_partkey % 3 + 1]::INT AS nodes_count, 1 AS relationships_count FROM part")
register("har45_gold_errors", lambda m: scored_papers(m).select("paper_metadata.lens_id", F.array_join(H.gold_errors(F.coalesce("technology_nodes", F.array().cast("array<struct<node_id:string,node_type:string,name:string,description:string,maturity:string,domain:string>>")), F.col("relationships")), ";").alias("errors")), "SELECT p_partkey::VARCHAR AS lens_id, 'few nodes;few relations' || CASE WHEN p_partkey % 3 = 2 THEN ';unknown subject' ELSE '' END AS errors FROM part")
register("nar8_search_summary", lambda m: V.search_summary(m.news.where("seq < 4000").select((F.col("seq") % 50).alias("tech_id"), F.col("seq").alias("position"), F.concat(F.lit("H"), "seq").alias("title"), "url"), relevant=F.col("position") % 2 == 0).select("tech_id", "found", "relevant", F.array_join("headlines", ",").alias("headlines"), F.array_join("sources", ",").alias("sources")), """
h AS (SELECT seq % 50 AS tech_id, seq, regexp_extract(url, '://([^/]*)', 1) AS d, row_number() OVER (PARTITION BY seq % 50 ORDER BY seq) AS r FROM news WHERE seq < 4000)
SELECT tech_id, count(*) AS found, count_if(seq % 2 = 0)::BIGINT AS relevant, string_agg('H' || seq, ',' ORDER BY seq) FILTER (r <= 5) AS headlines, string_agg(d, ',' ORDER BY seq) FILTER (r <= 5) AS sources FROM h GROUP BY 1""")

# regulatory notices

NOTICE = (
    r"concat('DEPARTMENT OF TRANSPORTATION\n', CASE WHEN p_partkey % 3 = 0 THEN '[Docket 1]\nOffice of X\n' ELSE '' END, "
    r"CASE WHEN p_partkey % 2 = 0 THEN '**AGENCY:** Federal Aviation Administration (FAA), DOT.\n' ELSE '**Some Board**\n' END, "
    r"'\n**DATES:** This rule is effective on March ', CAST(p_partkey % 28 + 1 AS STRING), ', 2024. Comments must be received by May 5, 2024.\n\n**ADDRESSES:** none')"
)
register("sca13_agency", lambda m: m.part.select("p_partkey", S.agency_info(F.expr(NOTICE)).alias("a")).select("p_partkey", "a.*"), """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'FAA' WHEN p_partkey % 3 = 0 THEN 'Office of X' ELSE 'Some Board' END AS regulatory_body, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'Office of X' END AS sub_agency FROM part""")
register("sca17_dates", lambda m: m.part.select("p_partkey", S.rule_dates(F.expr(NOTICE)).alias("d")).select("p_partkey", "d.*"), "SELECT p_partkey, DATE '2024-03-01' + (p_partkey % 28)::INT AS effective_date, DATE '2024-05-05' AS comment_deadline FROM part")
register("sca19_fr_document", lambda m: m.part.select("p_partkey", S.fr_document(F.concat(F.lit("faa_2024-"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, ".md").otherwise(".txt"))).alias("fr_doc")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '2024-' || p_partkey END AS fr_doc FROM part")
register("sca16_decisions", lambda m: m.part.select("p_partkey", S.decision_type(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit("Type Certification basis"))).alias("decision")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'certification_requirement' ELSE 'proposal' END AS decision FROM part")
register("sca24_chunks", lambda m: K.chunk(m.documents, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("characters"), F.max(F.length("chunk")).alias("longest")).where("chunks = 1 OR longest <= 5000").select("doc_id", "characters"), "SELECT doc_id, length(text)::BIGINT AS characters FROM documents WHERE length(text) > 0")
register("sca29_external_id", lambda m: m.part.select("p_partkey", S.external_id(F.array(F.struct(F.lit("PMID").alias("type"), F.lit("1").alias("value")), F.struct(F.lit("DOI").alias("type"), F.col("p_name").alias("value"))), "doi").alias("doi")), "SELECT p_partkey, p_name AS doi FROM part")
register("sca28_peer_reviewed", lambda m: m.part.select("p_partkey", S.peer_reviewed(F.col("p_name")).alias("reviewed")), "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'journal|article|conference|proceedings') THEN true WHEN regexp_matches(lower(p_name), 'preprint|book|thesis|dissertation|report') THEN false END AS reviewed FROM part")

# keep-first of other sources, as one function with other keys

FIRST = {
    "har9_company_of": None, "har10_first_patent": (["p_name"], ["p_partkey"]), "har14_first_paper": (["p_brand"], ["p_partkey"]), "har20_first_rule": (["p_type"], ["p_partkey"]),
    "har25_first_filing": (["p_brand", "p_type"], ["p_size", "p_partkey"]), "har41_first_seen": (["p_type"], ["p_size", "p_partkey"]), "har42_first_of_name": (["p_name"], ["p_size", "p_partkey"]),
}
for name, rule in FIRST.items():
    if rule:
        ids, seq = rule
        register(name, lambda m, a=rule: H.dedupe(m.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), *a).select("p_partkey"), f"SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY {ids[0]} ORDER BY {', '.join(seq)}) AS r FROM part) t WHERE r = 1")
ENTRY = "element_at(array('Pilot at Joby', 'Joby - pilot', 'Joby|pilot', 'Company: Joby', 'Joby'), CAST(p_partkey % 5 AS INT) + 1)"
register("har9_company_of", lambda m: m.part.select("p_partkey", H.company_of(F.expr(ENTRY)).alias("company")), "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 4 THEN 'Joby' END AS company FROM part")
register("har27_date_range", lambda m: m.orders.where(between(F.to_date("o_orderdate"), "1997-01-01", "1997-07-01")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '1997-01-01' AND o_orderdate::DATE < DATE '1997-07-01'")
register("har31_keywords", lambda m: m.part.where(H.matches_keywords(F.col("p_name"), ["RING", "bolt"])).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt')")
register("har33_strip_tags", lambda m: m.part.select("p_partkey", S.strip_tags(F.concat(F.lit("<p>"), "p_name", F.lit("</p> <b>x</b>"))).alias("text")), "SELECT p_partkey, p_name || ' x' AS text FROM part")

# upserts of other kinds

for name, key in (("ups2_technologies", "l_partkey"), ("ups3_companies", "l_suppkey"), ("ups4_documents", "l_orderkey"), ("ups5_by_line", "l_linenumber")):
    register(name, lambda m, key=key: U.merge_nodes(m.lineitem.select(key, F.lit("old").alias("flag")).distinct(), m.lineitem.where(f"{key} % 2 = 0").select(key, F.col("l_returnflag").alias("flag"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("seq")), key, "seq"), f"""
SELECT {key}, CASE WHEN {key} % 2 = 0 THEN arg_max(l_returnflag, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)) ELSE 'old' END AS flag FROM lineitem GROUP BY {key}""")
for name, keys in (("ups8_company_mentions", ("l_suppkey", "l_orderkey")), ("ups10_tech_tech", ("l_partkey", "l_linenumber")), ("ups11_company_company", ("l_suppkey", "l_linenumber")), ("ups12_community_edges", ("l_partkey", "l_suppkey"))):
    register(name, lambda m, keys=keys: U.merge_edges(m.lineitem.select(*keys, F.col("l_quantity").alias("q"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("seq")), m.lineitem.select(keys[0]).where(f"{keys[0]} % 2 = 0").distinct(), keys[0], m.lineitem.select(keys[1]).distinct(), keys[1], list(keys), "seq"), f"""
SELECT {keys[0]}, {keys[1]}, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity)) AS q FROM lineitem WHERE {keys[0]} % 2 = 0 GROUP BY 1, 2""")
register("ups13_created", lambda m: C.created(m.customer.select("c_custkey"), m.orders.select(F.col("o_custkey").alias("c_custkey")).unionByName(m.orders.select((-F.col("o_orderkey") - 1).alias("c_custkey"))), "c_custkey"), "SELECT count(*) AS created FROM (SELECT o_custkey AS k FROM orders UNION SELECT -o_orderkey - 1 FROM orders) t WHERE k NOT IN (SELECT c_custkey FROM customer)")


def laid_out(m):
    at = folder(m)
    C.write_layout(m.part.select("p_partkey", "p_type"), at, ["p_type", "p_partkey"])
    return m.spark.read.schema("p_partkey long, p_type string").parquet(at)


register("ups16_layout", laid_out, "SELECT p_partkey, p_type FROM part")


def community_members(m):
    t = m.technologies.select("community", F.lit("technology").alias("kind"), "name", F.lit(None).cast("string").alias("doc_type"), F.col("pagerank").alias("weight"))
    d = m.tech_mentions.join(m.technologies.select(F.col("id").alias("tech_id"), "community"), "tech_id").join(m.documents_g, "doc_id")
    return t.unionByName(d.select("community", F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("name"), "doc_type", F.lit(0.0).alias("weight")).distinct())


register("ups19_community_nodes", lambda m: C.community_nodes(community_members(m), 1, "louvain", 1.0).select("id", "version", "algorithm", "member_count", "tech_count", "doc_count", F.array_join("top_technologies", ",").alias("top"), "doc_type_distribution"), """
d AS (SELECT DISTINCT t.community, x.doc_id, g.doc_type FROM tech_mentions x JOIN technologies t ON t.id = x.tech_id JOIN documents_g g ON g.doc_id = x.doc_id),
n AS (SELECT community, count(*) AS n FROM d GROUP BY 1), k AS (SELECT community, doc_type, count(*) AS n FROM d GROUP BY 1, 2), j AS (SELECT community, '{' || string_agg('"' || doc_type || '":' || n, ',' ORDER BY doc_type) || '}' AS j FROM k GROUP BY 1),
r AS (SELECT community, name, row_number() OVER (PARTITION BY community ORDER BY pagerank DESC, name) AS r FROM technologies), p AS (SELECT community, string_agg(name, ',' ORDER BY r) FILTER (r <= 5) AS top, count(*) AS t FROM r GROUP BY 1)
SELECT 'v1_' || p.community AS id, 1 AS version, 'louvain' AS algorithm, p.t + coalesce(n.n, 0) AS member_count, p.t AS tech_count, coalesce(n.n, 0) AS doc_count, p.top, coalesce(j.j, '{}') AS doc_type_distribution FROM p LEFT JOIN n USING (community) LEFT JOIN j USING (community)""")
register("ups21_detach", lambda m: C.detach(m.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label")), m.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_orderkey", "l_linenumber"), "SMALL")[1], "SELECT l_partkey AS src, l_suppkey AS dst, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL') AND l_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL')")

# batches

register("par9_index_range", lambda m: C.index_range(m.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 1000, 500).select("o_orderkey", "index"), "SELECT o_orderkey, r AS index FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders) t WHERE r BETWEEN 1000 AND 1499")


def parse_name(row: dict) -> dict:
    """A parser that fails on every fifth row."""
    if row["index"] % 5 == 0:
        raise ValueError("unreadable")
    return {"name": row["p_name"].upper(), "quality_score": row["index"] % 10 / 10}


SCHEMA = "name string, quality_score double"
register("par10_parse_batch", lambda m: C.parse_batch(m.part.select(F.col("p_partkey").alias("index"), "p_name"), parse_name, SCHEMA), "SELECT p_partkey AS index, CASE WHEN p_partkey % 5 <> 0 THEN upper(p_name) END AS name, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 10 / 10 END::DOUBLE AS quality_score, CASE WHEN p_partkey % 5 = 0 THEN 'ValueError: unreadable' END AS error FROM part")


def resumed(m):
    """A run over the first half, then one over all, which goes on from there."""
    at, rows = folder(m), m.part.select(F.col("p_partkey").alias("index"), "p_name")
    C.run_batches(rows.where("index % 2 = 0"), parse_name, SCHEMA, at)
    C.run_batches(rows, parse_name, SCHEMA, at)
    return m.spark.read.parquet(f"{at}/relevant").select("index", "name")


register("par11_resumed_batches", resumed, "SELECT p_partkey AS index, upper(p_name) AS name FROM part WHERE p_partkey % 10 = 9")
register("par14_valid_pdfs", lambda m: m.part.select("p_partkey", V.valid_pdf(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".PDF").otherwise(".txt")), F.rpad(F.lit("%PDF-1.7"), 2000, "x").cast("binary"), pages=F.col("p_size") * 3).alias("ok")), "SELECT p_partkey, p_partkey % 2 = 0 AND p_size * 3 <= 100 AS ok FROM part")
register("par16_keywords", lambda m: m.part.select("p_partkey", F.array_join(C.all_keywords(F.create_map(F.lit("a"), F.array("p_brand", "p_type"), F.lit("b"), F.array("p_type", "p_name"))), ",").alias("words")), "SELECT p_partkey, array_to_string(list_sort([p_brand, p_type, p_name]), ',') AS words FROM part")
register("par16_companies", lambda m: m.part.select("p_partkey", C.all_companies([F.create_map(F.lit("A"), F.col("p_name"), F.lit("B"), F.lit("b")), F.create_map(F.lit("A"), F.col("p_brand"))])["A"].alias("a")), "SELECT p_partkey, p_brand AS a FROM part")


def published(m):
    at = folder(m)
    R.publish(m.documents_g.select("doc_id", "quality_score"), at)
    return m.spark.read.schema("doc_id long").json(f"{at}/relevant")


register("par13_publish", published, "SELECT doc_id FROM documents_g WHERE quality_score >= 0.85")
register("par17_catalog_variants", lambda m: R.catalog_variants(m.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.array("s_name", F.lit("x"))).alias("aliases"))).select("s_suppkey", F.array_join(F.transform("variants", lambda v: F.concat_ws(":", v["name"], v["method"])), ",").alias("variants")), "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ':catalog,x:catalog' ELSE '' END AS variants FROM supplier")

# coverage and UI forms

register("dia12_community_coverage", lambda m: C.community_coverage(m.documents_g.select("agency", "outlet_tier", "doc_type", F.lit(None).cast("string").alias("none")), ["agency", "outlet_tier", "doc_type", "none"]), " UNION ALL ".join(f"SELECT '{c}' AS version, count(DISTINCT {c}) AS communities, count({c}) AS nodes, round(count({c}) * 100.0::DOUBLE / count(*), 4) AS pct, CASE WHEN count({c}) * 100.0 / count(*) >= 95 THEN 'PASS' WHEN count({c}) * 100.0 / count(*) >= 80 THEN 'WARNING' WHEN count({c}) > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM (SELECT *, NULL AS none FROM documents_g) t" for c in ("agency", "outlet_tier", "doc_type", "none")))
register("dia13_summary_coverage", lambda m: C.summary_coverage(m.orders.select((F.col("o_custkey") % 3).cast("int").alias("version"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).otherwise("").alias("summary")), [0, 1, 2, 3]), """
SELECT v::INT AS version, count(DISTINCT o_orderkey) AS communities, count(DISTINCT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END) AS with_summary, round(count(DISTINCT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END) * 100.0::DOUBLE / nullif(count(DISTINCT o_orderkey), 0), 4) AS pct,
CASE WHEN count(o_orderkey) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM range(4) r(v) LEFT JOIN orders ON o_custkey % 3 = v GROUP BY v""")
register("dia14_metric_coverage", lambda m: C.metric_coverage(m.companies.select("pagerank", F.col("id").alias("degree")), ["pagerank", "degree"]), " UNION ALL ".join(f"SELECT '{n}' AS metric, count({c}) AS nodes, round(count({c}) * 100.0::DOUBLE / count(*), 4) AS pct, CASE WHEN count({c}) * 100.0 / count(*) >= 95 THEN 'PASS' WHEN count({c}) * 100.0 / count(*) >= 80 THEN 'WARNING' ELSE 'FAIL' END AS status FROM companies" for n, c in (("pagerank", "pagerank"), ("degree", "id"))))
register("dia15_missing", lambda m: D.missing(m.part.select("p_name").distinct().withColumnRenamed("p_name", "name"), m.part.where("p_size > 45").select(F.col("p_name").alias("name"))), "SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45)")


def ui(m):
    node = lambda i, label, group: F.struct(i.cast("string").alias("id"), label.alias("label"), F.lit(group).alias("group"))
    t = m.technologies.where("id < 50").select(F.col("id").alias("dst"), "name")
    rows = m.company_tech.join(t, "dst").join(m.companies.select(F.col("id").alias("src"), F.col("name").alias("company")), "src")
    props = F.create_map(F.lit("relation_type"), F.when(F.col("src") % 2 == 0, F.col("relation_type")))
    return C.ui_graph(rows.select(F.struct("dst", "src", "doc_ref").alias("seq"), node(F.col("dst"), F.col("name"), "Technology").alias("node"), F.lit("RELATED_TO_TECH").alias("kind"), props.alias("properties"), node(F.concat(F.lit("c"), "src"), F.col("company"), "Company").alias("other")))


UI = "u AS (SELECT e.src, e.dst, e.relation_type, t.name, c.name AS company FROM company_tech e JOIN technologies t ON t.id = e.dst AND t.id < 50 JOIN companies c ON c.id = e.src)"
register("gra11_ui_nodes", lambda m: ui(m)[0].select("id", "label", "group", "color", "size"), f"{UI} SELECT DISTINCT dst::VARCHAR AS id, name AS label, 'Technology' AS \"group\", '#4e79a7' AS color, 40 AS size FROM u UNION ALL SELECT DISTINCT 'c' || src, company, 'Company', '#f28e2b', 30 FROM u")
register("gra12_ui_edges", lambda m: ui(m)[1].select("from", "to", "label"), f"{UI} SELECT dst::VARCHAR AS \"from\", 'c' || src AS \"to\", CASE WHEN src % 2 = 0 THEN relation_type ELSE 'RELATED_TO_TECH' END AS label FROM u")
register("gra14_clean_properties", lambda m: m.part.select("p_partkey", F.array_join(F.array_sort(F.map_keys(G.clean_properties(F.create_map(F.lit("name"), F.lit("x"), F.lit("embedding_v1"), F.lit("y"), F.lit("search_corpus"), F.lit("z"), F.col("p_type"), F.lit("t"))))), ",").alias("keys")), "SELECT p_partkey, array_to_string(list_sort(['name', p_type]), ',') AS keys FROM part")

# matching parts of their own

register("ent5_alias_table", lambda m: E.alias_table(m.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.upper("p_name"), F.concat(F.lit("K"), "p_partkey")).alias("aliases"))), "SELECT lower(p_name) AS key, min(p_partkey) AS id FROM part GROUP BY 1 UNION ALL SELECT 'k' || p_partkey, p_partkey FROM part")
register("ent6_fuzzy", lambda m: E.fuzzy(m.supplier.select(F.concat("s_name", F.lit("s")).alias("name")), m.supplier.select(F.lower("s_name").alias("key"), F.col("s_suppkey").alias("id"))), "SELECT lower(s_name) || 's' AS name, s_suppkey AS id, round(2.0::DOUBLE * length(s_name) / (2 * length(s_name) + 1), 6) AS score FROM supplier")
DOMAINS = "element_at(array('Energy Storage', 'Propulsion', 'Avionics', 'Safety', 'Unknown'), CAST({} % 5 AS INT) + 1)"
register("ent19_domains_agree", lambda m: m.part.select("p_partkey", E.domains_agree(F.expr(DOMAINS.format("p_partkey")), F.expr(DOMAINS.format("p_size"))).alias("agree")), """SELECT p_partkey, a = b OR a = 4 OR b = 4 OR (a = 0 AND b = 1) OR (a = 1 AND b = 0) OR (a = 2 AND b = 3) OR (a = 3 AND b = 2) AS agree FROM (SELECT p_partkey, p_partkey % 5 AS a, p_size % 5 AS b FROM part) t""")
register("ent20_variant_overlap", lambda m: m.part.select("p_partkey", F.round(E.variant_overlap(F.array("p_brand", "p_type", F.lit("x")), F.when(F.col("p_partkey") % 3 != 0, F.array("p_type", F.lit("x"))).otherwise(F.array().cast("array<string>"))), 6).alias("overlap")), "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN round(2 / 3, 6) ELSE 0 END::DOUBLE AS overlap FROM part")
register("ent24_high_confidence", lambda m: m.part.select("p_partkey", E.high_confidence(F.col("p_partkey") % 100 / 100.0, (F.col("p_size") % 3).cast("int")).alias("high")), "SELECT p_partkey, p_partkey % 100 / 100.0::DOUBLE >= 0.85 OR (p_partkey % 100 / 100.0::DOUBLE >= 0.80 AND p_size % 3 <= 1) AS high FROM part")
register("ent39_annotate", lambda m: E.annotate(m.part.select(F.col("p_partkey").alias("doc_id"), F.array("p_name", F.lit("other")).alias("names")), m.part.select(F.col("p_name").alias("name")).distinct().withColumn("canonical", F.upper("name"))).select("doc_id", F.array_join("names", ",").alias("names")), "SELECT p_partkey AS doc_id, upper(p_name) || ',other' AS names FROM part")

# scores by themselves, and evidence

register("sco2_innovation_score", lambda m: scores(m).select("tech_id", "innovation", "n_patents", "patent_cites", "n_repos"), f"{SCORES_SQL} SELECT tech_id, innovation, n_patents, patent_cites, n_repos FROM s")
register("sco3_narrative_score", lambda m: scores(m).select("tech_id", "narrative", "n_news", "n_top"), f"{SCORES_SQL} SELECT tech_id, narrative, n_news, n_top FROM s")
register("sco4_risk_score", lambda m: scores(m).select("tech_id", "risk", "n_risks"), f"{SCORES_SQL} SELECT tech_id, risk, n_risks FROM s")
register("sco6_hype_confidence", lambda m: chart(m).groupBy("hype_confidence").agg(F.count("*").alias("n")), f"{SCORES_SQL} SELECT hype_confidence, count(*) AS n FROM c GROUP BY 1")
register("sco8_phase_confidence", lambda m: chart(m).groupBy("phase_confidence").agg(F.count("*").alias("n")), f"{SCORES_SQL} SELECT phase_confidence, count(*) AS n FROM p GROUP BY 1")
register("sco9_summary_text", lambda m: chart(m).select("tech_id", C.summary_text(F.col("name"), F.col("phase"), F.col("innovation"), F.col("adoption"), F.col("narrative"), F.col("risk")).alias("text")), f"{SCORES_SQL} SELECT tech_id, printf('%s: %s (innovation %.2f, adoption %.2f, narrative %.2f, risk %.2f)', name, phase, innovation, adoption, narrative, risk) AS text FROM c")
register("sco12_weighted_score", lambda m: P.chart_columns(scores(m), 6).select("tech_id", "phase_position", "weighted_score"), f"{SCORES_SQL} SELECT tech_id, phase_position, round(0.3::DOUBLE * innovation + 0.35::DOUBLE * adoption + 0.15::DOUBLE * narrative + 0.2::DOUBLE * (100 - risk), 6) AS weighted_score FROM c")
register("sco13_in_range", lambda m: chart(m).select("tech_id", P.in_range(F.col("phase"), F.col("chart_x") + F.when(F.col("tech_id") % 2 == 0, 3.0).otherwise(0.0)).alias("ok")), f"{SCORES_SQL} SELECT tech_id, chart_x + CASE WHEN tech_id % 2 = 0 THEN 3 ELSE 0 END BETWEEN low - 0.05 AND high + 0.05 AS ok FROM c")
register("sco16_evidence", lambda m: C.evidence_record(chart(m).withColumns({"innovation_reasoning": F.lit("by rule"), "risk_reasoning": F.lit(None).cast("string")}), {"innovation": ("n_patents", "n_papers"), "risk": ("n_risks",)}).select("tech_id", F.col("evidence.innovation_evidence.metrics.n_patents").alias("n_patents"), F.col("evidence.innovation_evidence.reasoning").alias("reasoning"), F.col("evidence.risk_evidence.reasoning").alias("risk_reasoning"), F.round("evidence.hype_analysis.score", 6).alias("hype"), F.col("evidence.phase_analysis.phase").alias("phase")), f"{SCORES_SQL} SELECT tech_id, n_patents, 'by rule' AS reasoning, '' AS risk_reasoning, round(hype, 6) AS hype, phase FROM c")
register("sco18_date_ranges", lambda m: m.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(C.date_range(k, "2025-01-01")[0]).alias("start")) for k in C.DAYS_BACK])).alias("x")).select("x.*"), "SELECT * FROM (VALUES ('innovation', (DATE '2025-01-01' - 730)::VARCHAR), ('adoption', (DATE '2025-01-01' - 540)::VARCHAR), ('narrative', (DATE '2025-01-01' - 180)::VARCHAR), ('risk', (DATE '2025-01-01' - 180)::VARCHAR)) t(layer, start)")

def ranking(m):
    df = chart(m)
    return df.select("tech_id", F.round(P.ranking_score(df), 6).alias("ranking_score"))


register("sco19_ranking_score", ranking, f"{RANKED} SELECT tech_id, ranking_score FROM r0")
register("sco22_spread", lambda m: P.normalize_chart(chart(m)).groupBy("phase").agg(F.min("chart_x").alias("first_x"), F.max("chart_x").alias("last_x")), f"{RANKED} SELECT phase, round(min(x), 6) AS first_x, round(max(x), 6) AS last_x FROM r3 GROUP BY phase")
register("sco23_spacing", lambda m: P.normalize_chart(chart(m), 40).groupBy("phase").agg(F.count("*").alias("n")), f"{RANKED} SELECT phase, least(40, count(*)) AS n FROM r0 GROUP BY phase")
