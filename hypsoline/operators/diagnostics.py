"""Coverage, distributions and health of the graph tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def completeness(df: DataFrame, columns: Sequence[str], by: str = "doc_type") -> DataFrame:
    """(by, column, filled, pct): how many rows of each group have a value, in one pass."""
    agg = df.groupBy(by).agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    long = agg.unpivot([by, "_n"], list(columns), "column", "filled")
    return long.select(by, "column", "filled", F.round(F.col("filled") / F.col("_n") * 100, 4).alias("pct"))


def status(pct: Column, good: float = 95.0, fair: float = 80.0) -> Column:
    return F.when(pct.isNull(), "N/A").when(pct >= good, "PASS").when(pct >= fair, "WARNING").otherwise("FAIL")


def overall(checks: DataFrame, column: str = "status") -> DataFrame:
    s = F.col(column)
    return checks.agg(F.when(F.bool_or(s == "FAIL"), "FAIL").when(F.bool_or(s == "WARNING"), "WARNING").otherwise("PASS").alias("overall"))


def score_distribution(df: DataFrame, value: str, by: str) -> DataFrame:
    """Least, quartiles, largest and mean of each group; quartiles are values at 0-based places n // 4, n // 2, 3n // 4.

    Found from counts by value, so that no task sorts a group's rows.
    """
    from pyspark.sql import Window

    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    run = F.sum("n").over(w.orderBy(value))
    counts = counts.withColumns({"upto": run, "all": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("all") * q), F.col(value)))
    return counts.groupBy(by).agg(F.min(value).alias("least"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), F.max(value).alias("most"), F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 6).alias("mean"))


def document_buckets(per_tech: DataFrame, column: str = "n") -> DataFrame:
    """Histogram of documents a technology."""
    n = F.col(column)
    bucket = F.when(n < 5, "0-4").when(n < 10, "5-9").when(n < 20, "10-19").when(n < 50, "20-49").otherwise("50+")
    return per_tech.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("technologies"), F.sum(n).alias("documents"))


def missing(required: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    return required.join(present, key, "left_anti")
