"""Raw documents of seven kinds to extraction records: a projection each, with a place for an extractor.

An extractor is any function from (text Column) to a Column of struct<quality_score, tech_mentions, ...>; without one the
arrays are empty and the quality is 0, as after a failed extraction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from .readers import MENTION

Extractor = Callable[[Column], Column]

EMPTY = {
    "tech_mentions": MENTION, "company_mentions": MENTION,
    "company_tech_relations": "ARRAY<STRUCT<company_name: STRING, technology_name: STRING, relation_type: STRING, evidence_confidence: DOUBLE, evidence_text: STRING, doc_ref: STRING>>",
}

#: The closed vocabulary of relations between companies and technologies.
RELATIONS = ("develops", "uses", "invests_in", "researches", "owns_ip")


def extracted(text: Column, doc_id: Column, extractor: Extractor | None) -> list[Column]:
    """The extracted columns; every relation carries the id of the document it comes from."""
    if extractor is None:
        out = [F.lit(0.0).alias("quality_score")]
        return out + [F.array().cast(t).alias(n) for n, t in EMPTY.items()]
    x = extractor(text)
    rel = F.transform(x["company_tech_relations"], lambda r: r.withField("doc_ref", doc_id))
    return [x["quality_score"].alias("quality_score"), x["tech_mentions"].alias("tech_mentions"), x["company_mentions"].alias("company_mentions"), rel.alias("company_tech_relations")]


def record(df: DataFrame, kind: str, doc_id: Column, title: Column, published: Column, text: Column, extractor: Extractor | None, **more: Column) -> DataFrame:
    made = df.select(doc_id.alias("doc_id"), F.lit(kind).alias("doc_type"), title.alias("title"), published.alias("published_at"), text.alias("content"), *[c.alias(n) for n, c in more.items()])
    return made.select("*", *extracted(F.col("content"), F.col("doc_id"), extractor))


def patents(df: DataFrame, as_of: str, extractor: Extractor | None = None) -> DataFrame:
    """(lens_id, title, abstract, assignee, granted, discontinued, expires, published) rows."""
    return record(df, "patent", F.concat(F.lit("patent_"), "lens_id"), F.col("title"), S.parse_date(F.col("published")), F.col("abstract"), extractor, assignee_name=F.col("assignee"), legal_status=S.legal_status(F.col("granted"), F.col("discontinued"), F.col("expires"), as_of))


def papers(df: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    text = S.strip_tags(F.col("abstract"))
    return record(df, "technical_paper", F.concat(F.lit("paper_"), "lens_id"), F.col("title"), S.parse_date(F.col("date_published")), text, extractor, peer_reviewed=S.peer_reviewed(F.col("venue")), venue_type=F.get(F.split("venue", " "), 0))


def filings(df: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """(path, text) rows; header fields come from the text. Texts under a hundred characters give empty records."""
    text = F.col("text")
    field = lambda label: S.header_field(text, label)
    body = F.when(F.length(text) >= 100, S.strip_tags(text))
    period = F.try_to_date(field("CONFORMED PERIOD OF REPORT"), "yyyyMMdd")
    kind = field("CONFORMED SUBMISSION TYPE")
    return record(df, "sec_filing", F.concat(F.lit("sec_"), S.slug(F.element_at(F.split("path", "/"), -1))), S.filing_title(field("COMPANY CONFORMED NAME"), kind, S.sec_date(field("FILED AS OF DATE"))), S.parse_date(S.sec_date(field("FILED AS OF DATE"))), body, extractor, cik=S.cik(field("CENTRAL INDEX KEY")), filing_type=kind, fiscal_year=F.year(period), fiscal_quarter=S.fiscal_quarter(period, kind))


def rules(df: DataFrame, agency: str, extractor: Extractor | None = None) -> DataFrame:
    """(fr_doc, title, text, published) rows of rules and notices."""
    text = F.col("text")
    action = F.coalesce(S.header_field(text, "ACTION"), F.lit(""))
    return record(df, "regulation", F.concat_ws("_", F.lit("regulatory"), F.lit(agency), "fr_doc"), F.col("title"), S.parse_date(F.col("published")), text, extractor, document_type=S.document_type(action), decision_type=S.decision_type(action, text), docket_number=S.docket(text), contact=S.email(text))


def news(df: DataFrame, extractor: Extractor | None = None, publisher_strength: float = 0.10) -> DataFrame:
    """Articles (url, title, domain, seendate, text); the publisher is added to the companies unless it is there."""
    name = S.publisher_name(F.col("domain"))
    out = record(df, "news", S.md5_id("news_article_", F.col("url")), F.col("title"), S.seen_date(F.col("seendate")), F.col("text"), extractor, url=F.col("url"), outlet_tier=S.outlet_tier(F.col("domain")), publisher=name)
    me = F.struct(F.col("publisher").alias("name"), F.lit("publisher").alias("role"), F.lit(publisher_strength).alias("strength"), F.lit(1.0).alias("evidence_confidence"), F.lit(None).cast("string").alias("evidence_text"))
    there = F.exists("company_mentions", lambda m: m["name"] == F.col("publisher"))
    return out.withColumn("company_mentions", F.when(there, F.col("company_mentions")).otherwise(F.array_append("company_mentions", me)))


def contracts(df: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    title = F.concat("recipient_name", F.lit(" - "), "awarding_sub_agency", F.lit(" Contract"))
    return record(df, "government_contract", F.concat(F.lit("contract_"), S.award_id(F.col("award_id"))), title, S.parse_date(F.col("start_date")), F.col("description"), extractor, award_amount=F.col("award_amount"), duration_days=S.days_between(F.col("start_date"), F.col("end_date")), size_band=S.contract_size(F.col("award_amount")), agency_type=S.agency_type(F.col("awarding_agency")))


def repositories(df: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    return record(df, "github", F.concat(F.lit("github_"), F.col("owner"), F.lit("_"), S.repo_id(F.col("repo_name"))), F.col("repo_name"), S.parse_date(F.col("created_at")), F.col("description"), extractor, stars=F.col("stars"), forks=F.col("forks"))


def valid_relations(relations: Column, allowed: tuple[str, ...] = RELATIONS) -> Column:
    return F.forall(relations, lambda r: r["relation_type"].isin(list(allowed)))
