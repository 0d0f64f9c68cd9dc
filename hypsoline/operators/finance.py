"""Holdings of institutions, insider transactions, and papers by composite score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .basics import top_k


def filing_date(text: Column) -> Column:
    """DD-MON-YYYY to a date; what can't be read is null."""
    return F.try_to_date(text, "dd-MMM-yyyy")


def holdings_by_cusip(infotable: DataFrame, submission: DataFrame, coverpage: DataFrame, cusips: Sequence, start: str | None = None, end: str | None = None) -> DataFrame:
    """13F-HR rows of the given securities, joined on the accession number; dates are compared as dates."""
    df = infotable.where(F.col("CUSIP").isin(list(cusips)) & (F.col("CUSIP") != "000000000"))
    sub = submission.where(F.col("SUBMISSIONTYPE") == "13F-HR").withColumn("period", filing_date(F.col("PERIODOFREPORT")))
    if start:
        sub = sub.where(F.col("period") >= F.lit(start).cast("date"))
    if end:
        sub = sub.where(F.col("period") <= F.lit(end).cast("date"))
    return df.join(sub, "ACCESSION_NUMBER").join(coverpage, "ACCESSION_NUMBER").orderBy(F.desc("period"), F.desc("VALUE"))


def normalize_value(value: Column, filed: Column) -> Column:
    """Values filed before 2023-01-03 are in thousands; null counts 0, an unknown date leaves the value."""
    v = F.coalesce(value, F.lit(0.0))
    return F.when(filed < F.lit("2023-01-03").cast("date"), v * 1000).otherwise(v)


def by_quarter(holdings: DataFrame, keys: Sequence[str] = ("cusip",), parity: bool = False) -> DataFrame:
    """Per quarter: shares, value, rows, distinct institutions, share of the ten largest, change to the quarter before
    (with parity, to the one after, since the original walks from the newest)."""
    per = holdings.groupBy(*keys, "period", "institution").agg(F.sum("shares").alias("s"), F.sum("value").alias("v"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "period").orderBy(F.desc("s"), "institution")
    ranked = per.withColumn("r", F.row_number().over(w))
    q = ranked.groupBy(*keys, "period").agg(F.sum("s").alias("total_shares"), F.sum("v").alias("total_value"), F.sum("n").alias("holdings"), F.count("*").alias("institutions"), (F.sum(F.when(F.col("r") <= 10, F.col("s"))) / F.sum("s") * 100).alias("top10_pct"))
    order = Window.partitionBy(*keys).orderBy(F.desc("period") if parity else F.col("period"))
    before = F.lag("total_shares").over(order)
    return q.withColumn("share_change", F.col("total_shares") - before).withColumn("change_pct", F.when(before > 0, (F.col("total_shares") - before) / before * 100))


def top_holders(holdings: DataFrame, keys: Sequence[str] = ("cusip", "period"), k: int = 10) -> DataFrame:
    """The k institutions with most shares of each group, with their part of all its shares."""
    per = holdings.groupBy(*keys, "institution").agg(F.sum("shares").alias("shares"))
    total = holdings.groupBy(*keys).agg(F.sum("shares").alias("_all"))
    first = top_k(per, keys, [F.desc("shares"), F.col("institution")], k)
    return first.join(total, list(keys)).withColumn("pct", F.col("shares") / F.col("_all") * 100).drop("_all")


def signals(quarters: DataFrame, keys: Sequence[str] = ("cusip",)) -> DataFrame:
    """The mean change of the latest (up to three) quarters, and what it says."""
    last = top_k(quarters.where(F.col("change_pct").isNotNull()), keys, [F.desc("period")], 3)
    out = last.groupBy(*keys).agg(F.avg("change_pct").alias("avg_change"))
    c = F.col("avg_change")
    return out.withColumns({"signal": F.when(c > 5, "accumulation").when(c < -5, "distribution").otherwise("stable"), "sentiment": F.when(c > 5, "bullish").when(c < -5, "bearish").otherwise("neutral"), "risk": F.when(c > 5, "low").when(c < -5, "high").otherwise("medium")})


def role_text(relationship: Column) -> Column:
    """Officer, Director and 10% Owner, joined; Unknown for null, Other for none of them."""
    has = lambda s, t: F.when(F.upper(relationship).contains(s), t)
    found = F.concat_ws(", ", has("OFFICER", "Officer"), has("DIRECTOR", "Director"), has("TENPERCENTOWNER", "10% Owner"))
    return F.when(relationship.isNull(), "Unknown").when(found == "", "Other").otherwise(found)


def insider_metrics(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, shares, values (priced trades only), nets, unweighted mean prices and distinct insiders of purchases and
    sales; means without a trade are 0."""
    buy, sell, priced = F.col("code") == "P", F.col("code") == "S", F.col("price") > 0
    value = F.when(priced, F.col("shares") * F.col("price")).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    role = lambda s: F.count_distinct(F.when(F.col("relationship").contains(s), F.col("owner")))
    out = trades.where(buy | sell).groupBy(*keys).agg(
        F.count_if(buy).alias("purchases"), F.count_if(sell).alias("sales"), zero(F.sum(F.when(buy, F.col("shares")))).alias("shares_bought"), zero(F.sum(F.when(sell, F.col("shares")))).alias("shares_sold"),
        zero(F.sum(F.when(buy, value))).alias("value_bought"), zero(F.sum(F.when(sell, value))).alias("value_sold"), zero(F.avg(F.when(buy & priced, F.col("price")))).alias("avg_buy"), zero(F.avg(F.when(sell & priced, F.col("price")))).alias("avg_sell"),
        F.count_distinct("owner").alias("insiders"), role("OFFICER").alias("officers"), role("DIRECTOR").alias("directors"), role("TENPERCENTOWNER").alias("owners"), F.min("trans_date").alias("first_date"), F.max("trans_date").alias("last_date"),
    )
    return out.withColumns({"net_shares": F.col("shares_bought") - F.col("shares_sold"), "net_value": F.col("value_bought") - F.col("value_sold")})


def top_insiders(trades: DataFrame, code: str, keys: Sequence[str] = (), k: int = 10) -> DataFrame:
    """The k insiders with most shares, with their percentage of all insiders' shares."""
    value = F.when(F.col("price") > 0, F.col("shares") * F.col("price")).otherwise(0.0)
    per = trades.where(F.col("code") == code).groupBy(*keys, "owner").agg(F.sum("shares").alias("shares"), F.avg("price").alias("avg_price"), F.count("*").alias("trades"), F.sum(value).alias("value"))
    if keys:
        per = per.withColumn("pct", F.col("shares") / F.sum("shares").over(Window.partitionBy(*keys)) * 100)
        return top_k(per, keys, [F.desc("shares"), F.col("owner")], k)
    total = per.agg(F.sum("shares").alias("all_shares"))  # one row
    return per.crossJoin(F.broadcast(total)).withColumn("pct", F.col("shares") / F.col("all_shares") * 100).drop("all_shares").orderBy(F.desc("shares"), "owner").limit(k)


def trade_details(trades: DataFrame, timeliness: Column) -> DataFrame:
    label = F.when(F.col("code") == "P", "Purchase").otherwise("Sale")
    late = F.when(timeliness == "E", "Early").when(timeliness == "L", "Late").otherwise("On-time")
    return trades.select("ticker", "owner", "trans_date", label.alias("kind"), late.alias("timeliness"), F.when(F.col("price") > 0, F.col("shares") * F.col("price")).otherwise(0.0).alias("value"), role_text(F.col("relationship")).alias("role"))


#: The weights of the composite score.
WEIGHTS = {"relevance": 0.4, "impact": 0.2, "references": 0.2, "innovation": 0.1, "recency": 0.1}
IMPACT = {"very_high": 1.0, "high": 0.7, "medium": 0.4}
INNOVATION = {"breakthrough": 1.0, "incremental_breakthrough": 0.7, "incremental": 0.4}


def _grade(c: Column, grades: dict[str, float]) -> Column:
    out = F.lit(0.1)
    for k, v in grades.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def composite_papers(papers: DataFrame, relevance: DataFrame, signals_: DataFrame, metadata: DataFrame | None, k: int = 200, least: float = 8.0, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The k papers with the highest weighted score; parts without data count half. Parts aren't clamped. Ties by id.
    Without metadata the weight of references goes to nothing."""
    df = papers.join(relevance.where((F.col("relevance_score") >= least) & F.col("is_relevant")), "lens_id").join(signals_, "lens_id")
    if metadata is not None:
        df = df.join(metadata.select("lens_id", "references_count"), "lens_id", "left")
    parts = {
        "relevance": (F.col("relevance_score") - 8.0) / (9.0 - 8.0),
        "impact": _grade(F.col("impact_potential"), IMPACT),
        "references": F.when(F.col("references_count").isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.col("references_count") / 100.0)) if metadata is not None else F.lit(0.0),
        "innovation": _grade(F.col("innovation_type"), INNOVATION),
        "recency": F.when(F.col("year_published").isNull(), 0.5).otherwise((F.col("year_published").cast("int") - 2010) / 15.0),
    }
    total = None
    for name, part in parts.items():
        term = F.lit(weights[name]) * part
        total = term if total is None else total + term
    return df.withColumn("composite_score", F.round(total, 9)).orderBy(F.desc("composite_score"), "lens_id").limit(k)


def top_patents(patents: DataFrame, k: int = 100) -> DataFrame:
    """Min-max recency, and log family size and citations over their maxima, weighted .4, .3, .3; the k largest."""
    df = patents.withColumns({"d": F.unix_date("filed"), "f": F.log1p("family"), "c": F.log1p("citations")})
    bounds = df.agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.max("f").alias("f1"), F.max("c").alias("c1"))  # one row
    df = df.crossJoin(F.broadcast(bounds))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    score = 0.4 * ratio(F.col("d") - F.col("d0"), F.col("d1") - F.col("d0")) + 0.3 * ratio(F.col("f"), F.col("f1")) + 0.3 * ratio(F.col("c"), F.col("c1"))
    return df.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "patent_id").limit(k).select("patent_id", "score")
