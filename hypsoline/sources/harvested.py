"""Harvested records of patents, papers, catalogues and per-ticker data: declared schemas, and their flat forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators.basics import top_k

TEXTS = "ARRAY<STRUCT<lang: STRING, text: STRING>>"
#: Fields that come as an object, a list or a text in different records are declared as text and taken apart below.
PATENT = f"""lens_id STRING, doc_number STRING, doc_key STRING, jurisdiction STRING, kind STRING, date_published STRING, publication_type STRING, lang STRING, abstract {TEXTS},
biblio STRUCT<invention_title: {TEXTS}, parties: STRUCT<applicants: ARRAY<STRUCT<name: STRING>>, inventors: ARRAY<STRUCT<name: STRING>>,
owners_all: ARRAY<STRUCT<extracted_name: STRUCT<value: STRING>, recorded_date: STRING, execution_date: STRING, extracted_country: STRING>>>,
application_reference: STRING, classifications_cpc: ARRAY<STRUCT<symbol: STRING>>, classifications_ipcr: ARRAY<STRUCT<symbol: STRING>>,
references_cited: STRUCT<patent_count: BIGINT, npl_count: BIGINT, npl_resolved_count: BIGINT, citations: ARRAY<STRING>>, cited_by: STRUCT<patents: ARRAY<STRUCT<lens_id: STRING>>>,
priority_claims: STRUCT<earliest_claim: STRUCT<date: STRING>>>,
families STRUCT<simple_family: STRUCT<size: BIGINT>, extended_family: STRUCT<size: BIGINT>>,
legal_status STRUCT<granted: BOOLEAN, grant_date: STRING, anticipated_term_date: STRING, discontinuation_date: STRING, has_disclaimer: BOOLEAN>, description STRING, claims STRING"""
PAPER = f"""lens_id STRING, title STRING, year_published INT, date_published STRING, publication_type STRING, publication_supplementary_type ARRAY<STRING>, abstract STRING,
authors ARRAY<STRUCT<display_name: STRING, affiliations: ARRAY<STRUCT<name: STRING, country_code: STRING>>>>, funding ARRAY<STRUCT<organisation: STRING, funding_id: STRING, country: STRING>>,
fields_of_study ARRAY<STRING>, keywords ARRAY<STRING>, mesh_terms ARRAY<STRING>, clinical_trials ARRAY<STRING>, chemicals ARRAY<STRING>, external_ids ARRAY<STRUCT<type: STRING, value: STRING>>,
open_access STRING, source_urls ARRAY<STRUCT<url: STRING>>, source STRUCT<title: STRING, publisher: STRING, country: STRING>, scholarly_citations_count BIGINT, patent_citations_count BIGINT,
references_count BIGINT, citing_patent_count BIGINT, scholarly_citations ARRAY<STRING>, patent_citations ARRAY<STRING>, references ARRAY<STRUCT<lens_id: STRING>>"""


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def english(texts: Column) -> Column:
    """The first English text, else the first one; empty where there is none."""
    own = F.get(F.filter(texts, lambda x: x["lang"] == "en"), 0)["text"]
    return F.coalesce(F.nullif(own, F.lit("")), F.get(texts, 0)["text"], F.lit(""))


def english_or_plain(raw: Column) -> Column:
    """The same of a value that is a list of texts, or a text itself."""
    return F.when(raw.startswith("["), english(F.from_json(raw, TEXTS))).otherwise(text(raw))


def symbols(codes: Column) -> Column:
    return F.filter(F.transform(F.coalesce(codes, F.array().cast("array<struct<symbol:string>>")), lambda c: c["symbol"]), lambda s: s != "")


def flat_patents(df: DataFrame, assignee: Column | None = None) -> DataFrame:
    """PATENT records as flat rows: English texts first, the filing date of an object or the first of a list, the date of
    publication for granted patents without a grant date, and claims counted by the numbers that begin their lines."""
    b, status = F.col("biblio"), F.col("legal_status")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    granted = F.coalesce(status["granted"], F.lit(False))
    ref = b["application_reference"]
    filed = F.when(ref.startswith("["), F.get(F.from_json(ref, "ARRAY<STRUCT<date: STRING>>"), 0)["date"]).otherwise(F.from_json(ref, "date STRING")["date"])
    grant = F.coalesce(F.nullif(status["grant_date"], F.lit("")), F.when(granted, F.col("date_published")), F.lit(""))
    claims = english_or_plain(F.col("claims"))
    owners = F.transform(
        b["parties"]["owners_all"],
        lambda o: F.struct(text(o["extracted_name"]["value"]).alias("name"), text(o["recorded_date"]).alias("recorded_date"), text(o["execution_date"]).alias("execution_date"), text(o["extracted_country"]).alias("country")),
    )
    citing = F.coalesce(b["cited_by"]["patents"], F.array().cast("array<struct<lens_id:string>>"))
    inventors = F.filter(F.transform(b["parties"]["inventors"], lambda i: i["name"]), lambda n: n != "")
    refs = b["references_cited"]
    return df.select(
        text(F.col("doc_number")).alias("patent_number"), text(F.col("lens_id")).alias("lens_id"), text(F.col("jurisdiction")).alias("jurisdiction"), text(F.col("kind")).alias("kind"),
        english(b["invention_title"]).alias("title"), english(F.col("abstract")).alias("abstract"),
        F.coalesce(F.get(b["parties"]["applicants"], 0)["name"], assignee if assignee is not None else F.lit("")).alias("assignee"), F.coalesce(inventors, F.array().cast("array<string>")).alias("inventors"),
        text(filed).alias("filing_date"), grant.alias("grant_date"), text(F.col("date_published")).alias("publication_date"), F.regexp_count(claims, F.lit(r"\n\s*\d+\.")).alias("claims_count"),
        symbols(b["classifications_cpc"]).alias("cpc_codes"), symbols(b["classifications_ipcr"]).alias("ipcr_codes"), zero(refs["patent_count"]).alias("citation_count"),
        zero(refs["npl_count"]).alias("npl_citation_count"), zero(refs["npl_resolved_count"]).alias("npl_resolved_count"), F.coalesce(refs["citations"], F.array().cast("array<string>")).alias("detailed_citations"),
        F.when(granted, "granted").otherwise("application").alias("type"), F.concat(F.lit("https://link.lens.org/"), text(F.col("lens_id"))).alias("url"), text(F.col("doc_key")).alias("doc_key"),
        F.coalesce("publication_type", F.lit("UNKNOWN")).alias("publication_type"), text(F.col("lang")).alias("lang"),
        zero(F.col("families")["simple_family"]["size"]).alias("simple_family_size"), zero(F.col("families")["extended_family"]["size"]).alias("extended_family_size"),
        F.size(citing).alias("forward_citation_count"), F.transform(citing, lambda p: text(p["lens_id"])).alias("forward_citation_lens_ids"), owners.alias("current_owners"),
        text(b["priority_claims"]["earliest_claim"]["date"]).alias("earliest_priority_date"), text(status["anticipated_term_date"]).alias("anticipated_term_date"),
        text(status["discontinuation_date"]).alias("discontinuation_date"), F.coalesce(status["has_disclaimer"], F.lit(False)).alias("has_terminal_disclaimer"),
        english_or_plain(F.col("description")).alias("description"), claims.alias("claims"),
    )


def flat_papers(df: DataFrame, keyword: Column) -> DataFrame:
    """PAPER records with defaults, funders by their usual names beside the given ones, and authors with affiliations."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    none = lambda c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
    unknown = lambda g: F.coalesce(g["organisation"], F.lit("Unknown"))
    grants = F.transform(
        none("funding"), lambda g: F.struct(S.funding_org(unknown(g)).alias("organisation"), unknown(g).alias("organisation_raw"), text(g["funding_id"]).alias("funding_id"), text(g["country"]).alias("country"))
    )
    places = lambda a: F.transform(a["affiliations"], lambda x: F.struct(text(x["name"]).alias("name"), text(x["country_code"]).alias("country_code")))
    authors = F.transform(none("authors"), lambda a: F.struct(text(a["display_name"]).alias("display_name"), places(a).alias("affiliations")))
    lists = [none(c).alias(c) for c in ("publication_supplementary_type", "external_ids", "source_urls", "scholarly_citations", "patent_citations", "references", "fields_of_study", "keywords", "mesh_terms", "clinical_trials", "chemicals")]
    src = F.col("source")
    return df.select(
        text(F.col("lens_id")).alias("lens_id"), F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("year_published", F.lit(0)).alias("year_published"),
        text(F.col("date_published")).alias("date_published"), F.coalesce("publication_type", F.lit("unknown")).alias("publication_type"), english_or_plain(F.col("abstract")).alias("abstract"),
        grants.alias("funding"), authors.alias("authors"), F.size(authors).alias("author_count"), zero(F.col("scholarly_citations_count")).alias("scholarly_citations_count"),
        zero(F.col("patent_citations_count")).alias("patent_citations_count"), zero(F.col("references_count")).alias("references_count"), *lists, "open_access",
        F.struct(text(src["title"]).alias("title"), text(src["publisher"]).alias("publisher"), text(src["country"]).alias("country")).alias("source"),
        keyword.alias("matched_keyword"), F.concat(F.lit("https://link.lens.org/"), text(F.col("lens_id"))).alias("url"),
    )


def paper_metadata(df: DataFrame) -> DataFrame:
    """Counts of PAPER records, 0 without one, and their nested fields as JSON."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    json = lambda c: F.coalesce(F.to_json(F.col(c)), F.lit("[]")).alias(c)
    return df.select("lens_id", "date_published", zero("references_count"), zero("citing_patent_count"), zero("scholarly_citations_count"), json("authors"), json("fields_of_study"))


def funding_summary(papers: DataFrame) -> DataFrame:
    """One row: papers, those with funding, and their percentage."""
    funded = F.count_if(F.size(F.coalesce("funding", F.array().cast(papers.schema["funding"].dataType))) > 0)
    return papers.agg(F.count("*").alias("papers"), funded.alias("with_funding"), F.round(F.try_divide(funded * 100.0, F.count("*")), 2).alias("pct"))


def top_funders(papers: DataFrame, k: int = 10) -> DataFrame:
    orgs = papers.select(F.explode("funding").alias("g")).select(F.col("g.organisation").alias("organisation")).where("organisation <> ''")
    return orgs.groupBy("organisation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "organisation").limit(k)


CATALOG_ENTRY = "id STRING, name STRING, canonical_name STRING, domain STRING, ticker STRING, description STRING, aliases ARRAY<STRING>, variants ARRAY<STRUCT<name: STRING>>"


def catalog_file(spark: SparkSession, path: str, wrapper: str = "technologies") -> DataFrame:
    """(id, name, aliases, domain, ticker, description) of a catalogue that is a list of entries, or an object that holds
    the list under `wrapper`."""
    entry = f"STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in CATALOG_ENTRY.split(', '))}>"
    raw = spark.read.schema(f"{wrapper} ARRAY<{entry}>, {CATALOG_ENTRY}").option("multiLine", True).json(path)
    own = F.struct(*[F.col(f.split()[0]) for f in CATALOG_ENTRY.split(", ")])
    rows = raw.select(F.explode(F.coalesce(F.col(wrapper), F.array(own))).alias("e")).select("e.*")
    aliases = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce(F.transform("variants", lambda v: v["name"]), F.array().cast("array<string>")))
    named = rows.select("id", F.coalesce("name", "canonical_name").alias("name"), aliases.alias("aliases"), "domain", "ticker", "description")
    return named.where("id IS NOT NULL AND name IS NOT NULL")


def inline_entities(records: DataFrame, array: str, catalog: DataFrame) -> DataFrame:
    """catalog (id, name, aliases) with the entities that records carry themselves (array of struct id, name, aliases), the
    catalogue's first, else the record with the smallest doc_id. Aliases of all records are known before any is resolved, so
    the order of records plays no part; alias_table() of the result resolves names."""
    from ..operators.basics import keep_first

    rows = records.select(F.col("doc_id").cast("string").alias("doc"), F.explode(array).alias("e")).select("doc", "e.id", "e.name", "e.aliases").withColumn("_o", F.lit(1))
    every = rows.unionByName(catalog.select(F.lit("").alias("doc"), "id", "name", "aliases", F.lit(0).alias("_o")))
    first = keep_first(every, F.col("id").cast("string"), ["_o", "doc"])
    more = every.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")))))).alias("_all"))
    return first.join(more, "id").select("id", "name", F.array_except("_all", F.array("name")).alias("aliases"))


#: The datasets that are kept for each ticker, and the date that bounds them, if any.
TICKER_DATASETS = {
    "historical_prices": "date", "company_info": None, "options": None, "recommendations": None, "institutional_holders": None, "insider_transactions": None, "earnings_estimates": None, "revenue_estimates": None,
    "income_statements": None, "balance_sheets": None, "cash_flow_statements": None, "news": "published_date", "earnings_calendar": "date", "key_metrics": None, "ratios": None,
}


def ticker_dataset(df: DataFrame, dataset: str, start: str, end: str, expiries: int = 3, statements: int = 5) -> DataFrame:
    """The rows of a dataset that are kept for each ticker: between two days where the dataset has a date; the first
    expiries of options; the last statements of reports."""
    date = TICKER_DATASETS[dataset]
    if date:
        return df.where(F.to_date(date).between(start, end))
    if dataset == "options":
        return df.withColumn("_e", F.dense_rank().over(_by_ticker("expiry"))).where(F.col("_e") <= expiries).drop("_e")
    if dataset.endswith(("_statements", "_sheets")):
        return top_k(df, ["ticker"], [F.desc("date")], statements).drop("rank")
    return df


def _by_ticker(order: str):
    from pyspark.sql import Window

    return Window.partitionBy("ticker").orderBy(order)


def legacy_patent_filter(keywords: Sequence[str], codes: Sequence[str], start: str, end: str) -> Column:
    """Dated in [start, end] and any keyword in title or abstract, or any class code; without both, the dates alone."""
    dated = F.col("patent_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    has = lambda c, w: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w.lower()))
    parts = [has(c, w) for w in keywords for c in ("patent_title", "patent_abstract")]
    parts += [F.array_contains("cpc_codes", code) for code in codes]
    return dated & reduce(lambda a, b: a | b, parts) if parts else dated


def legacy_patent_metrics(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row: filings, filings a month of thirty days, grants and their percentage, distinct assignees, mean and largest
    citations, patents cited more than ten times, mean claims of those that have any, patents of more than twenty claims."""
    months = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) / 30
    cited = F.coalesce("citedby_patent_count", F.lit(0))
    claimed = F.when(F.col("claims_count") > 0, F.col("claims_count"))
    return df.agg(
        F.count("app_date").alias("filings"), F.round(F.count("app_date") / months, 6).alias("filings_per_month"), F.count("patent_date").alias("granted"),
        F.round(F.try_divide(F.count("patent_date") * 100.0, F.count("*")), 6).alias("grant_pct"), F.round(F.avg(cited), 2).alias("avg_citations"), F.max(cited).alias("max_citations"),
        F.count_if(cited > 10).alias("highly_cited"), F.round(F.coalesce(F.avg(claimed), F.lit(0.0)), 2).alias("avg_claims"), F.count_if(claimed > 20).alias("broad"),
    )


def top_assignees(df: DataFrame, k: int = 10) -> DataFrame:
    names = df.select(F.explode("assignees").alias("assignee")).where("assignee <> ''")
    return names.groupBy("assignee").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "assignee").limit(k)


def search_range(days: int) -> str:
    """The range that a news search takes for so many days."""
    return "day" if days <= 1 else "week" if days <= 7 else "month" if days <= 30 else "year"


def search_summary(hits: DataFrame, key: str = "tech_id", relevant: Column | None = None, k: int = 5) -> DataFrame:
    """Per key: hits (key, position, title, url), those that `relevant` holds for (all without one), and the titles and
    domains of the first k."""
    keep = F.coalesce(relevant, F.lit(True)) if relevant is not None else F.lit(True)
    first = top_k(hits, [key], [F.col("position")], k)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("position", c.alias("v")))), lambda x: x["v"])
    shown = first.groupBy(key).agg(listed(F.col("title")).alias("headlines"), listed(S.domain_of(F.col("url"))).alias("sources"))
    return hits.groupBy(key).agg(F.count("*").alias("found"), F.count_if(keep).alias("relevant")).join(shown, key)


def pdf_route(source: Column, pdf_url: Column, url: Column) -> Column:
    """By which way a document's PDF is fetched; null: none."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when((source == "federal_register") & has(pdf_url), "federal_register").when(source.isin("rss_feeds", "rss") | (~has(pdf_url) & has(url)), "rss_feeds")


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.startswith(content, F.lit(b"%PDF")), F.lit(False))


def valid_pdf(path: Column, content: Column, least: int = 1024, pages: Column | None = None, most_pages: int = 100) -> Column:
    """The extension, at least so many bytes, the magic bytes, and, where known, at most so many pages."""
    ok = F.lower(path).endswith(".pdf") & (F.octet_length(content) >= least) & is_pdf(content)
    return ok & (F.coalesce(pages, F.lit(0)) <= most_pages) if pages is not None else ok


def pdf_filename(agency: Column, number: Column, title: Column, date: Column) -> Column:
    """agency_number.pdf, or agency_date_title.pdf without a number, of safe characters."""
    clean = F.regexp_replace(F.replace(F.lower(F.coalesce(agency, F.lit("unknown"))), F.lit(" "), F.lit("-")), "[^a-z0-9-]", "")
    head = F.regexp_replace(F.replace(F.substring(text(title), 1, 50), F.lit(" "), F.lit("_")), "[^a-zA-Z0-9-]", "")
    by_title = F.concat(clean, F.lit("_"), F.regexp_replace(text(date), "[^0-9-]", ""), F.lit("_"), head, F.lit(".pdf"))
    by_number = F.concat(clean, F.lit("_"), F.regexp_replace(text(number), "[^a-zA-Z0-9-]", ""), F.lit(".pdf"))
    return F.when(text(number) != "", by_number).otherwise(by_title)


def rss_id(number: Column, url: Column, title: Column) -> Column:
    """A document's number, else one made of its address or title; the same on every run."""
    made = F.concat(F.lit("rss_"), F.substring(F.md5(F.coalesce(F.nullif(url, F.lit("")), title, F.lit("unknown")).cast("binary")), 1, 12))
    return F.coalesce(F.nullif(number, F.lit("")), made)


def entry_date(*fields: Column) -> Column:
    """The first of several fields that can be read as a date."""
    at = lambda c: F.coalesce(F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), S.parse_date(c))
    return F.coalesce(*[at(c) for c in fields])


def record_count(json: Column) -> Column:
    """Records in a JSON text: the length of a list, or of a list under a usual name; a total or count; 1 for another
    object, 0 for what is neither."""
    v = F.try_parse_json(json)
    length = lambda path: F.json_array_length(F.to_json(F.try_variant_get(v, path, "variant")))
    named = [length(f"$.{k}") for k in ("data", "results", "documents", "records", "items")]
    totals = [F.try_variant_get(v, f"$.{k}", "int") for k in ("total", "count")]
    kind = F.schema_of_variant(v)
    other = F.when(kind.startswith("OBJECT"), F.coalesce(*named, *totals, F.lit(1))).otherwise(0)
    return F.coalesce(F.when(kind.startswith("ARRAY"), F.json_array_length(json)).otherwise(other), F.lit(0))


def source_table(summary: DataFrame) -> DataFrame:
    """Rows (layer, name, files, records) in order, with the layer's name on its first row only, and a status by files."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("layer").orderBy("name")) == 1
    status = F.when(F.col("files") == 0, "Empty").when(F.col("files") < 5, "Minimal").otherwise("Active")
    return summary.select("layer", F.when(first, F.concat(F.lit("**"), "layer", F.lit("**"))).otherwise("").alias("label"), "name", "files", "records", status.alias("status")).orderBy("layer", "name")


def gold_index(entries: DataFrame) -> DataFrame:
    """The index rows of gold entries: ids, title, and how many nodes and relations each has."""
    count = lambda c: F.greatest(F.size(F.col(c)), F.lit(0))
    return entries.select("lens_id", "title", count("technology_nodes").alias("nodes_count"), count("relationships").alias("relationships_count"))
