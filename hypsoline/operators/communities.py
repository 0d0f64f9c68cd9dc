"""Communities: lookups, members, composition, maturity, and stratified discovery of technologies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .basics import good, top_k


def members(technologies: DataFrame, companies: DataFrame, documents: DataFrame, company_community: Column, document_community: Column) -> DataFrame:
    """(community, label, node_id, name, importance) of nodes of every label."""
    parts = [
        technologies.select("community", F.lit("Technology").alias("label"), F.col("id").cast("string").alias("node_id"), "name", F.coalesce("pagerank", F.lit(0.0)).alias("importance")),
        companies.select(company_community.alias("community"), F.lit("Company").alias("label"), F.col("id").cast("string").alias("node_id"), "name", F.coalesce("pagerank", F.lit(0.0)).alias("importance")),
        documents.select(document_community.alias("community"), F.lit("Document").alias("label"), F.col("doc_id").cast("string").alias("node_id"), F.coalesce("title", F.col("doc_id").cast("string")).alias("name"), F.coalesce("pagerank", F.lit(0.0)).alias("importance")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def top_members(rows: DataFrame, k: int = 25) -> DataFrame:
    return top_k(rows, ["community"], [F.col("importance").desc_nulls_last(), F.col("label"), F.col("node_id")], k).select("community", "rank", "label", "node_id", "name")


def composition(rows: DataFrame) -> DataFrame:
    """Counts by label, mean importance and companies for each technology (0 where there are none)."""
    n = lambda label: F.count_if(F.col("label") == label)
    out = rows.groupBy("community").agg(n("Technology").alias("tech_count"), n("Company").alias("company_count"), n("Document").alias("doc_count"), F.round(F.avg("importance"), 6).alias("avg_pagerank"))
    return out.withColumn("companies_per_tech", F.round(F.when(F.col("tech_count") > 0, F.col("company_count") / F.col("tech_count")).otherwise(0.0), 6))


def related(technologies: DataFrame, k: int = 10) -> DataFrame:
    """Other technologies of the same community by pagerank; only the k + 1 best of a community meet all of it."""
    best = top_k(technologies.where(F.col("pagerank").isNotNull()), ["community"], [F.desc("pagerank"), F.col("id")], k + 1, "r")
    pairs = technologies.select(F.col("id").alias("tech_id"), "community").join(best.select("community", F.col("id").alias("other_id"), "pagerank"), "community").where("tech_id <> other_id")
    return top_k(pairs, ["tech_id"], [F.desc("pagerank"), F.col("other_id")], k).select("tech_id", "rank", "other_id")


def bridges(technologies: DataFrame, least: float = 100.0, k: int = 5) -> DataFrame:
    df = technologies.where((F.col("betweenness") >= least) & F.col("community").isNotNull())
    return df.select("id", "community", "betweenness").orderBy(F.desc("betweenness"), "id").limit(k)


def doc_histogram(mention_docs: DataFrame, technologies: DataFrame, types: Sequence[str] = ("patent", "news", "government_contract")) -> DataFrame:
    """Distinct quality documents of each community by type, as columns, with the size of the community."""
    comm = technologies.select(F.col("id").alias("tech_id"), "community")
    sizes = comm.groupBy("community").agg(F.count("*").alias("member_count"))
    docs = good(mention_docs).select("tech_id", "doc_id", "doc_type").join(comm, "tech_id").select("community", "doc_id", "doc_type").distinct()
    hist = docs.groupBy("community").agg(*[F.count_if(F.col("doc_type") == t).alias(f"n_{t}") for t in types], F.count("*").alias("docs"))
    return sizes.join(hist, "community", "left").fillna(0)


def maturity(patents: Column, news: Column, contracts: Column) -> Column:
    """early, mid, late or hype: by counts where a community has under ten such documents, else by smoothed ratios."""
    p, n, c = patents, news, contracts
    small = F.when((c >= 2) & ((p >= 1) | (n >= 1)), "late").when((p > n) & (c <= 1), "early").when((n > p) & (c <= 1), "hype").otherwise("mid")
    large = F.when((p / (n + 1) > 2) & (c < 5), "early").when((n / (p + 1) > 1.5) & (c < 5), "hype").when((c >= 3) & (p > 2), "late").otherwise("mid")
    return F.when(p + n + c < 10, small).otherwise(large)


def classified(hist: DataFrame) -> DataFrame:
    return hist.withColumn("stage", maturity(F.col("n_patent"), F.col("n_news"), F.col("n_government_contract")))


def discover(mention_docs: DataFrame, technologies: DataFrame, least: int = 1, domain: str | None = None) -> DataFrame:
    """Technologies with at least `least` quality documents: distinct documents, types, and the histogram of types."""
    df = technologies.where(F.col("domain") == domain) if domain else technologies
    docs = good(mention_docs).select("tech_id", "doc_id", "doc_type").distinct()
    per = docs.groupBy("tech_id", "doc_type").agg(F.count("*").alias("n"))
    agg = per.groupBy("tech_id").agg(F.sum("n").alias("document_count"), F.count("*").alias("type_count"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "doc_type", "n"))), ",").alias("types")).where(F.col("document_count") >= least)
    return df.select(F.col("id").alias("tech_id"), "name", "community", "pagerank").join(agg, "tech_id")


def sample_discovery(found: DataFrame, stages: DataFrame, total: int, shares: dict[str, float], exclude: Sequence[int] = ()) -> DataFrame:
    """A stratified sample: each stage's share by rank, up to twice over, then the best of the rest, `total` in all.

    found: discover()'s rows; stages: (community, stage). A technology belongs to one stage, through its community.
    """
    df = found.join(stages.select("community", "stage"), "community")
    if exclude:
        df = df.where(~F.col("tech_id").isin(list(exclude)))
    order = [F.desc("pagerank"), F.desc("type_count"), F.desc("document_count"), F.col("tech_id")]
    most = F.create_map(*[F.lit(x) for kv in ((k, int(2 * v * total)) for k, v in shares.items()) for x in kv])
    first = F.create_map(*[F.lit(x) for kv in ((k, i) for i, k in enumerate(shares)) for x in kv])
    df = df.withColumn("in_stage", F.row_number().over(Window.partitionBy("stage").orderBy(*order)))
    # of each stratum at most `total` rows can be taken, so the last sort has a bounded input
    df = df.where(F.col("in_stage") <= total).withColumn("own", F.col("in_stage") <= F.try_element_at(most, F.col("stage")))
    last = [F.when(F.col("own"), 0).otherwise(1), F.when(F.col("own"), F.try_element_at(first, F.col("stage"))), F.when(F.col("own"), F.col("in_stage")), *order]
    picked = df.orderBy(*last).limit(total)
    return picked.select("tech_id", "community", "stage", "document_count")


def text_search(communities: DataFrame, query: str, summary: str = "summary", names: str = "top_technologies") -> DataFrame:
    """Communities whose summary, or any of whose top technologies, contains the query, whatever the case."""
    q = F.lit(query.lower())
    return communities.where(F.lower(summary).contains(q) | F.exists(names, lambda x: F.lower(x).contains(q)))
