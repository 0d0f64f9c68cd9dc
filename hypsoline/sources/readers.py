"""Scans and sinks: tab-separated filings, nested JSON, text, feeds, and run folders. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_date

FORM13F = {
    "INFOTABLE": "ACCESSION_NUMBER string, CUSIP string, NAMEOFISSUER string, VALUE double, SSHPRNAMT double, SSHPRNAMTTYPE string, PUTCALL string, INVESTMENTDISCRETION string, VOTING_AUTH_SOLE long, VOTING_AUTH_SHARED long, VOTING_AUTH_NONE long",
    "SUBMISSION": "ACCESSION_NUMBER string, CIK string, PERIODOFREPORT string, FILING_DATE string, SUBMISSIONTYPE string",
    "COVERPAGE": "ACCESSION_NUMBER string, FILINGMANAGER_NAME string, FILINGMANAGER_CITY string, FILINGMANAGER_STATEORCOUNTRY string",
}
INSIDER = {
    "NONDERIV_TRANS": "ACCESSION_NUMBER string, TRANS_DATE string, TRANS_CODE string, TRANS_SHARES double, TRANS_PRICEPERSHARE double, TRANS_ACQUIRED_DISP_CD string, SHRS_OWND_FOLWNG_TRANS double, DIRECT_INDIRECT_OWNERSHIP string, TRANS_TIMELINESS string",
    "SUBMISSION": "ACCESSION_NUMBER string, ISSUERCIK string, ISSUERNAME string, ISSUERTRADINGSYMBOL string, FILING_DATE string, DOCUMENT_TYPE string",
    "REPORTINGOWNER": "ACCESSION_NUMBER string, RPTOWNERCIK string, RPTOWNERNAME string, RPTOWNER_RELATIONSHIP string, RPTOWNER_TITLE string",
}
MENTION = "ARRAY<STRUCT<name: STRING, role: STRING, strength: DOUBLE, evidence_confidence: DOUBLE, evidence_text: STRING>>"
RECORD = f"""document STRUCT<doc_id: STRING, doc_type: STRING, title: STRING, url: STRING, source: STRING, published_at: STRING, seendate: STRING, publication_date: STRING, summary: STRING, abstract: STRING,
content: STRING, quality_score: DOUBLE, relevance_score: DOUBLE, assignee: STRING, assignee_name: STRING, award_amount: DOUBLE, citation_count: BIGINT>, tech_mentions {MENTION}, company_mentions {MENTION},
company_tech_relations ARRAY<STRUCT<company_name: STRING, technology_name: STRING, relation_type: STRING, evidence_confidence: DOUBLE, evidence_text: STRING, doc_ref: STRING>>,
tech_tech_relations ARRAY<STRUCT<from_tech_name: STRING, to_tech_name: STRING, relation_type: STRING, evidence_confidence: DOUBLE, evidence_text: STRING, doc_ref: STRING>>,
company_company_relations ARRAY<STRUCT<from_company_name: STRING, to_company_name: STRING, relation_type: STRING, evidence_confidence: DOUBLE, evidence_text: STRING, doc_ref: STRING>>"""
SCORED_PAPER = """paper_metadata STRUCT<lens_id: STRING, title: STRING, year_published: INT, publication_type: STRING, journal: STRING, doi: STRING, url: STRING>,
relevance_assessment STRUCT<relevance_score: DOUBLE, is_relevant: BOOLEAN, relevance_category: STRING, confidence: DOUBLE, justification: STRING>,
technology_nodes ARRAY<STRUCT<node_id: STRING, node_type: STRING, name: STRING, description: STRING, maturity: STRING, domain: STRING>>,
relationships ARRAY<STRUCT<subject: STRING, predicate: STRING, object: STRING, confidence: DOUBLE, evidence: STRING>>,
innovation_signals STRUCT<research_stage: STRING, innovation_type: STRING, impact_potential: STRING, technical_risk: STRING, adoption_indicators: ARRAY<STRING>>"""


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header; empty is null, a bad row stops the read."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="", mode="FAILFAST", schema=schema)


def tsv_folder(spark: SparkSession, folder: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    return {name: tsv(spark, f"{folder}/{name}.tsv", schema) for name, schema in tables.items()}


def merge_quarters(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def json_records(spark: SparkSession, path: str | list[str], schema: str, skip: str | None = None, lines: bool = False) -> DataFrame:
    """Files that hold an array or one object each, or (lines) an object a line; files whose name contains `skip` are left
    out, unreadable ones give no rows."""
    df = spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)
    if skip:
        df = df.where(~F.element_at(F.split(F.input_file_name(), "/"), -1).contains(skip))
    return df


def limit_per_file(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of each file, of files that are read whole (as json_records does): their rows then have rising
    numbers in the order of the file, however the files are dealt to tasks."""
    w = Window.partitionBy("_file").orderBy("_at")
    out = df.withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()}).withColumn("_n", F.row_number().over(w))
    return out.where(F.col("_n") <= n).drop("_file", "_at", "_n")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text or markdown files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def filing_name(path: Column) -> Column:
    """struct(ticker, filing_type, date, accession) of a file name like AAA_10-K_2024-01-31_0001234.txt."""
    part = F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), "_")
    return F.struct(F.get(part, 0).alias("ticker"), F.get(part, 1).alias("filing_type"), F.get(part, 2).alias("date"), F.array_join(F.slice(part, 4, 100), "_").alias("accession"))


def feed(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Items of RSS files between two days; items without a date stay."""
    schema = "title string, link string, description string, pubDate string"
    df = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    at = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), parse_date(F.col("pubDate")))
    df = df.withColumn("published", at)
    return df.where(F.col("published").isNull() | F.to_date("published").between(start, end))


def split_record(records: DataFrame, tech_aliases: DataFrame, company_aliases: DataFrame) -> dict[str, DataFrame]:
    """Extraction records to documents and edge tables; names are resolved by (key, id) aliases, and edges with an
    unknown name are left out (see unresolved())."""
    cut200 = lambda c: F.substring(c, 1, 200)

    def named(df: DataFrame, name: str, aliases: DataFrame, out: str) -> DataFrame:
        return df.join(aliases.select(F.col("key").alias("_k"), F.col("id").alias(out)), F.lower(F.trim(name)) == F.col("_k")).drop("_k", name)

    doc = F.col("document.doc_id").alias("doc_id")
    mention = lambda arr: records.select(doc, F.explode(arr).alias("m")).select("doc_id", "m.name", "m.role", "m.strength", "m.evidence_confidence", cut200(F.col("m.evidence_text")).alias("evidence_text"))

    def relation(arr: str, a: str, b: str, ta: DataFrame, tb: DataFrame) -> DataFrame:
        rows = records.select(doc, F.explode(arr).alias("r")).select(F.coalesce("r.doc_ref", "doc_id").alias("doc_ref"), f"r.{a}", f"r.{b}", "r.relation_type", "r.evidence_confidence", cut200(F.col("r.evidence_text")).alias("evidence_text"))
        return named(named(rows, a, ta, "src"), b, tb, "dst")

    return {
        "documents": normalized_documents(records.select("document.*")),
        "tech_mentions": named(mention("tech_mentions"), "name", tech_aliases, "tech_id"),
        "company_mentions": named(mention("company_mentions"), "name", company_aliases, "company_id"),
        "company_tech": relation("company_tech_relations", "company_name", "technology_name", company_aliases, tech_aliases),
        "tech_tech": relation("tech_tech_relations", "from_tech_name", "to_tech_name", tech_aliases, tech_aliases),
        "company_company": relation("company_company_relations", "from_company_name", "to_company_name", company_aliases, company_aliases),
    }


def unresolved(records: DataFrame, aliases: DataFrame, array: str = "tech_mentions") -> DataFrame:
    rows = records.select(F.explode(array).alias("m")).select(F.col("m.name").alias("name"))
    return rows.join(aliases.select(F.col("key").alias("_k")), F.lower(F.trim("name")) == F.col("_k"), "left_anti").groupBy("name").agg(F.count("*").alias("n"))


#: Document types that other readers name differently.
TYPE_NAMES = {"news_article": "news", "github_repository": "github", "scholarly": "technical_paper"}


def normalized_documents(docs: DataFrame) -> DataFrame:
    """One row a document with the fallbacks of each type: abstract for summary, other dates for published_at."""
    kind = F.col("doc_type")
    for k, v in TYPE_NAMES.items():
        kind = F.when(F.col("doc_type") == k, v).otherwise(kind)
    when = F.coalesce(parse_date(F.col("published_at")), parse_date(F.col("publication_date")), F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")), parse_date(F.col("seendate")))
    return docs.select("doc_id", kind.alias("doc_type"), "title", "url", "source", when.alias("published_at"), F.coalesce("summary", "abstract").alias("summary"), "content", F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), F.coalesce("assignee_name", "assignee").alias("assignee_name"), "award_amount", "citation_count")


def paper_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of scored papers; a paper without nodes or relations gives none."""
    key = F.col("paper_metadata.lens_id").alias("lens_id")
    return {
        "papers": scored.select("paper_metadata.*"), "relevance": scored.select(key, "relevance_assessment.*"), "technology_nodes": scored.select(key, F.explode("technology_nodes").alias("n")).select("lens_id", "n.*"),
        "relationships": scored.select(key, F.explode("relationships").alias("r")).select("lens_id", "r.*"), "innovation_signals": scored.select(key, "innovation_signals.*").drop("adoption_indicators"),
        "adoption_indicators": scored.select(key, F.explode("innovation_signals.adoption_indicators").alias("indicator")),
    }


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def run_id(n: int, version: str, at: str) -> str:
    return f"{at[:10]}_{at[11:19].replace(':', '-')}_{n}tech_{version}"


def save_run(chart: DataFrame, path: str, run: str) -> None:
    """A run's chart as one partition of the history."""
    chart.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("run_id").parquet(path)


def list_runs(spark: SparkSession, path: str, k: int = 20) -> DataFrame:
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("technologies")).orderBy(F.desc("run_id")).limit(k)


def get_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run)


def with_errors(record_schema: str) -> T.StructType:
    """A record schema with the column that takes what can't be parsed."""
    return T.StructType.fromDDL(record_schema).add("_corrupt_record", T.StringType())


def publish(results: DataFrame, path: str, threshold: float = 0.85) -> None:
    """All records as one shard family, those of at least `threshold` quality as another."""
    good = results.where(F.coalesce("quality_score", F.lit(0.0)) >= threshold)
    results.write.mode("append").json(f"{path}/all")
    good.write.mode("append").json(f"{path}/relevant")


def catalog_variants(catalog: DataFrame) -> DataFrame:
    """Catalogue rows with their aliases as variants of full similarity."""
    alias = F.coalesce("aliases", F.array().cast("array<string>"))
    return catalog.withColumn("variants", F.transform(alias, lambda a: F.struct(a.alias("name"), F.lit(1.0).alias("similarity_score"), F.lit("catalog").alias("method"))))


def union_sources(frames: Sequence[DataFrame], ids: Sequence[str]) -> DataFrame:
    """Rows of several sources, columns by name, the first row of each id (in the order of the sources) kept."""
    from ..operators.harvest import dedupe

    tagged = [f.withColumns({"_source": F.lit(i), "_at": F.monotonically_increasing_id()}) for i, f in enumerate(frames)]
    return dedupe(merge_quarters(tagged), ids, ["_source", "_at"]).drop("_source", "_at")
