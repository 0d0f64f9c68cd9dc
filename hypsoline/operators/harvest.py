"""Cleaning and trends of harvested rows: keep-first, keyword filters, per-day and per-key summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .basics import keep_first, top_k


def dedupe(df: DataFrame, ids: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The first row of each id, the first of `ids` that is not empty; rows without any id go."""
    return keep_first(df, F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ids]), seq)


def matches_keywords(text: Column, keywords: Sequence[str], case: bool = False) -> Column:
    """Whether a keyword is contained; an empty list matches all."""
    if not keywords:
        return F.lit(True)
    words = F.array(*[F.lit(k if case else k.lower()) for k in keywords])
    return F.exists(words, lambda k: F.contains(F.coalesce(text if case else F.lower(text), F.lit("")), k))


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    words = F.array(*[F.lit(k) for k in keywords])
    return F.get(F.filter(words, lambda k: F.contains(F.lower(text), F.lower(k))), 0)


def daily_sentiment(news: DataFrame) -> DataFrame:
    """Per day: articles, mean tone (2 digits), positive (> 5), negative (< -5) and neutral ones."""
    tone = F.col("tone")
    return news.groupBy("day").agg(F.count("*").alias("articles"), F.round(F.avg(tone), 2).alias("avg_tone"), F.count_if(tone > 5).alias("positive"), F.count_if(tone < -5).alias("negative"), F.count_if((tone >= -5) & (tone <= 5)).alias("neutral"))


def sentiment_direction(daily: DataFrame) -> DataFrame:
    """One row: the mean of daily means in the first and the second half of the days. A row a day is what is sorted."""
    n = daily.withColumn("_n", F.count("*").over(Window.partitionBy())).withColumn("_r", F.row_number().over(Window.orderBy("day")))
    early = F.col("_r") <= F.floor(F.col("_n") / 2)
    out = n.agg(F.avg(F.when(early, F.col("avg_tone"))).alias("first_half"), F.avg(F.when(~early, F.col("avg_tone"))).alias("second_half"))
    return out.withColumn("trend", F.when(F.col("second_half") > F.col("first_half"), "improving").otherwise("declining"))


def contract_stats(df: DataFrame, agency: str, value: str) -> DataFrame:
    return df.groupBy(agency).agg(F.count("*").alias("contracts"), F.round(F.sum(value), 2).alias("total_value"))


def popularity(stars: Column, forks: Column, watchers: Column) -> Column:
    return stars + 0.5 * forks + 0.3 * watchers


def company_of(entry: Column) -> Column:
    """After the last ` at `, before ` - `, before `|`, or after `Company:`."""
    after = lambda sep: F.trim(F.substring_index(entry, sep, -1))
    before = lambda sep: F.trim(F.substring_index(entry, sep, 1))
    return F.when(entry.contains(" at "), after(" at ")).when(entry.contains(" - "), before(" - ")).when(entry.contains("|"), before("|")).when(entry.contains("Company:"), after("Company:"))


def citation_metrics(papers: DataFrame, cited: str = "cited") -> DataFrame:
    """Count, sum, mean, maximum, and the citations at a tenth of the way down (the maximum under ten papers)."""
    # the value at 0-based place n // 10 from the top, from counts by value, so no task sorts all papers
    by = papers.groupBy(cited).agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc(cited)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("above", above).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = F.floor(F.col("all") / 10)
    return by.agg(
        F.sum("n").alias("papers"), F.sum(F.col(cited) * F.col("n")).alias("total_citations"), F.round(F.sum(F.col(cited) * F.col("n")) / F.sum("n"), 4).alias("avg_citations"), F.max(cited).alias("max_citations"),
        F.max(F.when((F.col("above") <= at) & (at < F.col("above") + F.col("n")), F.col(cited))).alias("top_decile"),
    )


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def month_timeline(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def quality_distribution(df: DataFrame, quality: str = "quality_score", threshold: float = 0.85) -> DataFrame:
    q = F.coalesce(F.col(quality), F.lit(0.0))
    good = F.count_if(q >= threshold)
    return df.agg(F.count("*").alias("n"), F.min(q).alias("least"), F.max(q).alias("most"), F.round(F.avg(q), 6).alias("mean"), good.alias("good"), F.round(good / F.count("*") * 100, 4).alias("good_pct"))


def gold_errors(nodes: Column, relations: Column) -> Column:
    """What keeps an entry from the gold set: few nodes or relations, weak confidence, short evidence, unknown subject."""
    checks = [
        F.when(F.size(nodes) < 3, "few nodes"), F.when(F.size(relations) < 3, "few relations"),
        F.when(~F.forall(relations, lambda r: r["confidence"] >= 0.7), "weak confidence"), F.when(~F.forall(relations, lambda r: F.length(r["evidence"]) >= 10), "short evidence"),
        F.when(F.size(F.array_except(F.transform(relations, lambda r: r["subject"]), F.transform(nodes, lambda n: n["node_id"]))) > 0, "unknown subject"),
    ]
    return F.array_compact(F.array(*checks))


def quarters(start: str, end: str) -> Column:
    """Distinct year-quarter names met in steps of ninety days."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 90 days"))
    return F.array_distinct(F.transform(days, lambda d: F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))))


def source_summary(df: DataFrame, layers: DataFrame) -> DataFrame:
    """Records by layer: sources, active ones (five or more), and totals. layers: (source, layer), one row a source."""
    per = df.groupBy("source").agg(F.count("*").alias("n"))
    return per.join(layers, "source", "left").groupBy(F.coalesce("layer", F.lit("other")).alias("layer")).agg(F.count("*").alias("sources"), F.count_if(F.col("n") >= 5).alias("active"), F.sum("n").alias("records"))


def success_rate(ok: Column, failed: Column) -> Column:
    return F.when(ok + failed > 0, F.round(ok / (ok + failed) * 100, 4)).otherwise(0.0)


def links(html: Column, pattern: str = r'(?i)href="([^"]*\.pdf)"') -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def latest_per_source(df: DataFrame, key: str, date: str, k: int) -> DataFrame:
    return top_k(df, [key], [F.col(date).desc_nulls_last()], k)
