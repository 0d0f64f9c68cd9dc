"""Keyed upserts of nodes and edges, referential checks and store statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .basics import last_wins


def merge_nodes(current: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """current with the last change of each key in its place, new keys added."""
    new = last_wins(changes, [key], [seq]).drop(seq)
    return current.join(new.select(key), key, "left_anti").unionByName(new.select(*current.columns))


def merge_edges(changes: DataFrame, left: DataFrame, left_key: str, right: DataFrame, right_key: str, keys: Sequence[str], seq: str) -> DataFrame:
    """The last change of each edge key whose two ends exist; the others are left out without an error."""
    df = changes.join(left.select(F.col(left_key).alias(keys[0])), keys[0], "left_semi").join(right.select(F.col(right_key).alias(keys[1])), keys[1], "left_semi")
    return last_wins(df, keys, [seq]).drop(seq)


def dangling(changes: DataFrame, nodes: DataFrame, key: str, node_key: str) -> DataFrame:
    return changes.join(nodes.select(F.col(node_key).alias(key)), key, "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def statistics(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """(kind, label, n) of every node label and edge type."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(k).alias("label"), "n") for kind, group in (("node", nodes), ("edge", edges)) for k, df in group.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The properties of every document, and those of each type besides.
COMMON = ("doc_id", "doc_type", "source", "title", "url", "published_at", "summary", "content", "quality_score", "relevance_score", "embedding")
BY_TYPE = {
    "patent": ("patent_number", "jurisdiction", "type", "legal_status", "filing_date", "grant_date", "assignee_name", "citation_count", "simple_family_size", "applicants"),
    "technical_paper": ("doi", "venue_type", "peer_reviewed", "source_title", "year_published", "date_published", "citation_count", "patent_citations_count", "authors"),
    "sec_filing": (
        "filing_type", "cik", "accession_number", "filing_date", "fiscal_year", "fiscal_quarter", "ticker", "net_insider_value_usd", "total_shares_held", "revenue_mentioned", "revenue_amount",
        "risk_factor_mentioned", "qoq_change_pct",
    ),
    "regulation": ("regulatory_body", "sub_agency", "document_type", "decision_type", "effective_date", "docket_number"),
    "github": ("github_id", "repo_name", "owner", "created_at", "last_pushed_at", "stars", "forks", "contributor_count"),
    "government_contract": ("award_id", "recipient_name", "award_amount", "start_date", "end_date", "awarding_agency", "awarding_sub_agency"),
    "news": ("domain", "outlet_tier", "seendate", "tone"),
}


def document_properties(df: DataFrame, doc_type: str) -> DataFrame:
    """The documents of one type with the properties that nodes of it have; those that df lacks are null. Dates are ISO text."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}

    def value(name: str):
        if name not in kinds:
            return F.lit(None).cast("string").alias(name)
        iso = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd'T'HH:mm:ss"}.get(kinds[name])
        return (F.date_format(name, iso) if iso else F.col(name)).alias(name)

    return df.where(F.col("doc_type") == doc_type).select(*[value(n) for n in dict.fromkeys((*COMMON, *BY_TYPE[doc_type]))])
