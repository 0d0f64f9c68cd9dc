"""Innovation, adoption, narrative and risk metrics of all technologies at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .basics import between, good, top_k, trend


def doc_metrics(mention_docs: DataFrame, doc_type: str | Sequence[str], roles: Sequence[str] | None, start: str | None, end: str | None, aggs: Sequence[Column], keys: Sequence[str] = ("tech_id",)) -> DataFrame:
    """One filtered aggregate a technology: documents of a type, in given roles, published in [start, end)."""
    types = [doc_type] if isinstance(doc_type, str) else list(doc_type)
    df = good(mention_docs).where(F.col("doc_type").isin(types))
    if roles:
        df = df.where(F.col("role").isin(list(roles)))
    if start:
        df = df.where(between(F.col("published_at"), start, end))
    return df.groupBy(*keys).agg(*aggs)


def patent_count(mention_docs: DataFrame, start: str, end: str) -> DataFrame:
    pr = F.coalesce("pagerank", F.lit(0.0))
    aggs = [F.count("*").alias("patent_count"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("total_citations"), F.round(F.avg(pr), 6).alias("avg_pagerank"), F.round(F.sum(1 + 100 * pr), 4).alias("weighted_count")]
    return doc_metrics(mention_docs, "patent", ["invented"], start, end, aggs)


def paper_count(mention_docs: DataFrame, start: str, end: str) -> DataFrame:
    aggs = [F.count("*").alias("paper_count"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("total_citations"), F.round(F.avg(F.coalesce("pagerank", F.lit(0.0))), 6).alias("avg_pagerank")]
    return doc_metrics(mention_docs, "technical_paper", ["invented", "studied"], start, end, aggs)


def repo_count(mention_docs: DataFrame, start: str, end: str) -> DataFrame:
    aggs = [F.count("*").alias("repo_count"), F.sum("stars").alias("total_stars"), F.sum("forks").alias("total_forks")]
    return doc_metrics(mention_docs, "github", None, start, end, aggs)


def top_documents(mention_docs: DataFrame, doc_type: str, roles: Sequence[str] | None, order: Sequence[Column], k: int, columns: Sequence[str]) -> DataFrame:
    df = good(mention_docs).where(F.col("doc_type") == doc_type)
    if roles:
        df = df.where(F.col("role").isin(list(roles)))
    return top_k(df, ["tech_id"], order, k).select("tech_id", "rank", *columns)


def community_documents(mention_docs: DataFrame, technologies: DataFrame, doc_type: str, start: str, end: str) -> DataFrame:
    """Distinct documents that any technology of a technology's community mentions, in any role."""
    comm = technologies.select(F.col("id").alias("tech_id"), "community")
    docs = good(mention_docs).where((F.col("doc_type") == doc_type) & between(F.col("published_at"), start, end))
    per = docs.join(comm, "tech_id").groupBy("community").agg(F.countDistinct("doc_id").alias("community_docs"))
    return comm.join(per, "community").select("tech_id", "community", "community_docs")


def temporal_trend(mention_docs: DataFrame, doc_types: Sequence[str], roles: Sequence[str] | None, as_of: str, window: int, span: int, up: float, names: tuple[str, str, str], parity: bool = False) -> DataFrame:
    """Documents of the last `window` months against those of the months before, back to `span`."""
    d, now = F.col("published_at"), F.lit(as_of).cast("date")
    df = good(mention_docs).where(F.col("doc_type").isin(list(doc_types)))
    if roles:
        df = df.where(F.col("role").isin(list(roles)))
    df = df.where((d >= F.add_months(now, -span)) & (d < now))
    recent = d >= F.add_months(now, -window)
    out = df.groupBy("tech_id").agg(F.count_if(recent).alias("recent_count"), F.count_if(~recent).alias("historical_count"))
    return out.withColumn("trend", trend(F.col("recent_count"), F.col("historical_count"), window, span, up, names, parity))


def innovation_metrics(mention_docs: DataFrame, technologies: DataFrame, as_of: str, days: int = 730) -> DataFrame:
    """The composed innovation record of every technology; absent parts count 0. Community papers are taken as two
    thirds of the community's patents."""
    start = str(_before(as_of, days))
    df = good(mention_docs).where(between(F.col("published_at"), start, as_of))
    patent = (F.col("doc_type") == "patent") & (F.col("role") == "invented")
    paper = (F.col("doc_type") == "technical_paper") & F.col("role").isin("invented", "studied")
    repo = F.col("doc_type") == "github"
    total = lambda c, v: F.sum(F.when(c, F.coalesce(v, F.lit(0))))
    own = df.where(patent | paper | repo).groupBy("tech_id").agg(
        F.count_if(patent).alias("patent_count"), total(patent, "citation_count").alias("patent_citations"),
        F.count_if(paper).alias("paper_count"), total(paper, "citation_count").alias("paper_citations"),
        F.count_if(repo).alias("repo_count"), total(repo, "stars").alias("total_stars"),
    )
    near = community_documents(mention_docs, technologies, "patent", start, as_of).select("tech_id", F.col("community_docs").alias("community_patents"))
    out = technologies.select(F.col("id").alias("tech_id")).join(own, "tech_id", "left").join(near, "tech_id", "left").fillna(0)
    return out.withColumn("community_papers", F.floor(F.col("community_patents") * 0.67).cast("long"))


def _before(as_of: str, days: int):
    import datetime

    return datetime.date.fromisoformat(as_of) - datetime.timedelta(days=days)


def contracts(mention_docs: DataFrame, start: str, end: str, roles: Sequence[str] = ("deployed", "funded", "researched")) -> DataFrame:
    aggs = [
        F.count("*").alias("contract_count"), F.round(F.sum(F.coalesce("award_amount", F.lit(0.0))), 2).alias("total_value"),
        F.round(F.avg(F.coalesce("award_amount", F.lit(0.0))), 6).alias("avg_value"), F.array_join(F.slice(F.array_sort(F.collect_set("agency")), 1, 10), ",").alias("agencies"),
    ]
    return doc_metrics(mention_docs, "government_contract", roles, start, end, aggs)


def approvals(mention_docs: DataFrame, start: str, end: str) -> DataFrame:
    first = F.slice(F.array_sort(F.collect_list("doc_id")), 1, 5)
    aggs = [F.count("*").alias("approval_count"), F.array_join(F.slice(F.array_sort(F.collect_set("agency")), 1, 10), ",").alias("bodies"), F.array_join(first.cast("array<string>"), ",").alias("first_docs")]
    return doc_metrics(mention_docs, "regulation", ["regulated"], start, end, aggs)


def agency_metrics(mention_docs: DataFrame, contracts_from: str, approvals_from: str, end: str, roles: Sequence[str] = ("deployed", "funded", "researched")) -> DataFrame:
    """Contracts, their value, and approvals of each technology in one pass; the two have windows of their own."""
    df = good(mention_docs).where(F.col("doc_type").isin("government_contract", "regulation"))
    contract = (F.col("doc_type") == "government_contract") & F.col("role").isin(list(roles)) & between(F.col("published_at"), contracts_from, end)
    approval = (F.col("doc_type") == "regulation") & (F.col("role") == "regulated") & between(F.col("published_at"), approvals_from, end)
    value = F.sum(F.when(contract, F.coalesce("award_amount", F.lit(0.0))))
    return df.where(contract | approval).groupBy("tech_id").agg(F.count_if(contract).alias("contract_count"), F.round(value, 2).alias("total_value"), F.count_if(approval).alias("approval_count"))


def revenue_mentions(company_tech: DataFrame, mention_docs: DataFrame, companies: DataFrame, start: str, end: str, k: int = 20) -> DataFrame:
    """Companies of a technology and its filings whose evidence speaks of revenue or sales; an edge a source document
    keeps its own row."""
    text = F.col("e.evidence_text")
    filings = good(mention_docs).where((F.col("doc_type") == "sec_filing") & between(F.col("published_at"), start, end)).select("tech_id", "doc_id", "published_at")
    edges = company_tech.alias("e").where(text.contains("revenue") | text.contains("sales"))
    df = edges.join(filings, F.col("e.dst") == F.col("tech_id")).join(companies.select(F.col("id").alias("src"), F.col("name").alias("company")), "src")
    out = df.select("tech_id", "company", "doc_id", "published_at", "doc_ref", "evidence_confidence")
    return top_k(out, ["tech_id"], [F.desc("evidence_confidence"), F.desc("published_at"), F.col("doc_id"), F.col("company"), F.col("doc_ref")], k).drop("evidence_confidence")


def developing_companies(company_tech: DataFrame, companies: DataFrame, k: int = 10, relations: Sequence[str] = ("adopts", "develops")) -> DataFrame:
    edges = company_tech.where(F.col("relation_type").isin(list(relations))).select("src", F.col("dst").alias("tech_id")).distinct()
    df = edges.join(companies.where(F.col("pagerank").isNotNull()), edges.src == companies.id)
    return top_k(df, ["tech_id"], [F.desc("pagerank"), F.col("name")], k).select("tech_id", "rank", "name", F.round("pagerank", 6).alias("pagerank"))


def news_count(mention_docs: DataFrame, start: str, end: str) -> DataFrame:
    return doc_metrics(mention_docs, "news", ["subject"], start, end, [F.count("*").alias("news_count")])


TIERS = ("Industry Authority", "Financial Authority", "Press Release", "Other")


def tier_breakdown(mention_docs: DataFrame, start: str, end: str) -> DataFrame:
    """Dense counts of the four known tiers; others are dropped, missing tiers count as Other."""
    df = good(mention_docs).where((F.col("doc_type") == "news") & (F.col("role") == "subject") & between(F.col("published_at"), start, end))
    tier = F.coalesce("outlet_tier", F.lit("Other"))
    return df.groupBy("tech_id").agg(*[F.count_if(tier == t).alias(t.lower().replace(" ", "_")) for t in TIERS])


def prominent_articles(mention_docs: DataFrame, k: int = 10) -> DataFrame:
    priority = F.when(F.col("outlet_tier") == TIERS[0], 1).when(F.col("outlet_tier") == TIERS[1], 2).when(F.col("outlet_tier") == TIERS[2], 3).otherwise(4)
    df = good(mention_docs).where((F.col("doc_type") == "news") & (F.col("role") == "subject")).withColumn("priority", priority)
    return top_k(df, ["tech_id"], [F.col("priority"), F.desc("published_at"), F.desc("strength"), F.col("doc_id")], k).select("tech_id", "rank", "doc_id", "priority")


def momentum(mention_docs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """News of the last days against those of as many days before; without earlier news the ratio is the count."""
    d, now = F.col("published_at"), F.lit(as_of).cast("date")
    df = good(mention_docs).where((F.col("doc_type") == "news") & (d >= F.date_sub(now, 2 * days)) & (d < now))
    recent = d >= F.date_sub(now, days)
    out = df.groupBy("tech_id").agg(F.count_if(recent).alias("recent"), F.count_if(~recent).alias("previous"))
    ratio = F.when(F.col("previous") == 0, F.col("recent").cast("double")).otherwise(F.col("recent") / F.col("previous"))
    return out.withColumn("momentum", F.round(ratio, 6)).withColumn("label", F.when(ratio > 1.5, "accelerating").when(ratio < 0.5, "decelerating").otherwise("steady"))


def freshness(recent: Column, historical: Column, days_recent: int = 30, days_historical: int = 180) -> Column:
    return F.when(historical == 0, F.lit(1.0)).otherwise(F.round((recent / days_recent) / (historical / days_historical), 2))


def sentiment_label(tone: Column) -> Column:
    return F.when(tone > 0.3, "positive").when(tone < -0.3, "negative").otherwise("neutral")


def risk_rows(company_tech: DataFrame, mention_docs: DataFrame, companies: DataFrame) -> DataFrame:
    """Company, technology and filing rows where the filing names risk factors or its evidence contains `risk`; as many
    rows as there are parallel edges."""
    filings = good(mention_docs).where((F.col("doc_type") == "sec_filing") & (F.col("risk_factor_mentioned") | F.col("evidence_text").contains("risk")))
    filings = filings.select("tech_id", "doc_id", "published_at", "filing_type", "strength")
    edges = company_tech.select("src", F.col("dst").alias("tech_id"), "doc_ref")
    return filings.join(edges, "tech_id").join(companies.select(F.col("id").alias("src"), F.col("name").alias("company")), "src")


def risk_mentions(rows: DataFrame, start: str, end: str) -> DataFrame:
    df = rows.where(between(F.col("published_at"), start, end))
    return df.groupBy("tech_id").agg(F.countDistinct("doc_id").alias("mention_count"), F.array_join(F.slice(F.array_sort(F.collect_set("company")), 1, 10), ",").alias("companies"))


def top_risks(rows: DataFrame, k: int = 5) -> DataFrame:
    return top_k(rows, ["tech_id"], [F.desc("strength"), F.desc("published_at"), F.col("doc_id"), F.col("company"), F.col("doc_ref")], k).select("tech_id", "rank", "doc_id", "company", "doc_ref")


def filings_over_edges(company_tech: DataFrame, mention_docs: DataFrame, companies: DataFrame, types: Sequence[str], start: str | None, end: str | None) -> DataFrame:
    """Filings of given forms, counted once an edge (distinct too), with up to ten companies."""
    df = good(mention_docs).where((F.col("doc_type") == "sec_filing") & F.col("filing_type").isin(list(types)))
    if start:
        df = df.where(between(F.col("published_at"), start, end))
    df = df.select("tech_id", "doc_id").join(company_tech.select("src", F.col("dst").alias("tech_id")), "tech_id")
    df = df.join(companies.select(F.col("id").alias("src"), F.col("name").alias("company")), "src")
    return df.groupBy("tech_id").agg(F.count("*").alias("filing_rows"), F.countDistinct("doc_id").alias("filings"), F.array_join(F.slice(F.array_sort(F.collect_set("company")), 1, 10), ",").alias("companies"))


def cash_burn(company_tech: DataFrame, mention_docs: DataFrame) -> DataFrame:
    """Runway in quarters is reserves / burn, 999 where nothing is burnt; needs both figures and a date."""
    df = good(mention_docs).where((F.col("doc_type") == "sec_filing") & F.col("cash_burn").isNotNull() & F.col("cash_reserves").isNotNull() & F.col("published_at").isNotNull())
    df = df.select("tech_id", "cash_burn", "cash_reserves").join(company_tech.select("src", F.col("dst").alias("tech_id")), "tech_id")
    runway = F.when(F.col("cash_burn") <= 0, F.lit(999.0)).otherwise(F.col("cash_reserves") / F.col("cash_burn"))
    return df.groupBy("tech_id").agg(F.countDistinct("src").alias("companies"), F.round(F.avg("cash_burn"), 6).alias("avg_burn"), F.round(F.avg(runway), 6).alias("avg_runway"), F.count_if(runway < 12).alias("short_runway"))
