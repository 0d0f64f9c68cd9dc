"""Evidence: citations by layer, co-mentions, provenance paths, triplets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .basics import QUALITY, between, good, top_k

#: Layer -> (document types, roles).
LAYERS = {
    "innovation": (("patent", "technical_paper", "github"), ("invented", "studied")),
    "adoption": (("government_contract", "regulation", "sec_filing"), ("procured", "regulated")),
    "narrative": (("news", "press_release"), ("subject",)),
    "risk": (("sec_filing",), ("regulated",)),
}


def layer_citations(mention_docs: DataFrame, doc_types: Sequence[str], roles: Sequence[str], start: str, end: str | None = None, k: int = 5, confidence: float = QUALITY) -> DataFrame:
    """The k strongest documents of each technology in a layer, with a line on what they contribute."""
    df = good(mention_docs).where(F.col("doc_type").isin(list(doc_types)) & F.col("role").isin(list(roles)))
    df = df.where((F.col("evidence_confidence") >= confidence) & between(F.col("published_at"), start, end))
    order = [F.desc("strength"), F.desc("evidence_confidence"), F.desc("published_at"), F.col("doc_id")]
    text = F.concat(F.initcap(F.replace("doc_type", F.lit("_"), F.lit(" "))), F.lit(" - "), F.initcap("role"))
    return top_k(df, ["tech_id"], order, k).select("tech_id", "rank", "doc_id", F.round("strength", 6).alias("strength"), text.alias("contribution"))


def citations(mention_docs: DataFrame, layer: str, start: str, end: str | None = None, k: int = 5) -> DataFrame:
    return layer_citations(mention_docs, *LAYERS[layer], start, end, k)


def evidence_distribution(mention_docs: DataFrame, as_of: str, days: int = 730, sample: int = 3) -> DataFrame:
    """Documents of each type a technology has lately, with the first few as a sample."""
    now = F.lit(as_of).cast("date")
    df = good(mention_docs).where((F.col("published_at") >= F.date_sub(now, days)) & (F.col("published_at") <= now))
    keys = ["tech_id", "doc_type"]
    first = top_k(df.select(*keys, "doc_id"), keys, [F.col("doc_id")], sample)
    listed = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("sample"))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).join(listed, keys)


def co_mentions(mention_docs: DataFrame, as_of: str, days: int = 730, k: int = 10) -> DataFrame:
    """Technologies that share documents: distinct documents and types shared, the k closest of each."""
    now = F.lit(as_of).cast("date")
    df = good(mention_docs).where((F.col("published_at") >= F.date_sub(now, days)) & (F.col("published_at") <= now)).select("tech_id", "doc_id", "doc_type")
    other = df.select(F.col("tech_id").alias("other_id"), "doc_id")
    pairs = df.join(other, "doc_id").where("tech_id <> other_id")
    agg = pairs.groupBy("tech_id", "other_id").agg(F.countDistinct("doc_id").alias("shared_docs"), F.countDistinct("doc_type").alias("doc_types"), F.min("doc_id").alias("sample_doc"))
    return top_k(agg, ["tech_id"], [F.desc("shared_docs"), F.desc("doc_types"), F.col("other_id")], k)


def provenance(company_tech: DataFrame, mention_docs: DataFrame, companies: DataFrame, as_of: str, days: int = 365, k: int = 10) -> DataFrame:
    """Company -> technology -> document paths, the strongest first."""
    now = F.lit(as_of).cast("date")
    docs = good(mention_docs).where((F.col("published_at") >= F.date_sub(now, days)) & (F.col("published_at") <= now)).select("tech_id", "doc_id", "published_at", "strength")
    edges = company_tech.select("src", F.col("dst").alias("tech_id"), "relation_type", "doc_ref", "evidence_confidence")
    rows = docs.join(edges, "tech_id").join(companies.select(F.col("id").alias("src"), F.col("name").alias("company")), "src")
    order = [F.desc("evidence_confidence"), F.desc("strength"), F.desc("published_at"), F.col("doc_id"), F.col("company"), F.col("doc_ref")]
    return top_k(rows, ["tech_id"], order, k).select("tech_id", "rank", "company", "relation_type", "doc_id", "doc_ref")


def triplets(mention_docs: DataFrame, technologies: DataFrame, as_of: str, days: int = 730, k: int = 20) -> DataFrame:
    """(subject, predicate, object) of each mention, the most certain first."""
    now = F.lit(as_of).cast("date")
    df = good(mention_docs).where((F.col("published_at") >= F.date_sub(now, days)) & (F.col("published_at") <= now))
    df = df.select("tech_id", "role", F.col("title").alias("object"), "evidence_confidence", "doc_id").join(technologies.select(F.col("id").alias("tech_id"), F.col("name").alias("subject")), "tech_id")
    return top_k(df, ["tech_id"], [F.desc("evidence_confidence"), F.col("doc_id")], k).select("tech_id", "rank", "subject", F.col("role").alias("predicate"), "object")
