"""What many operators share: windows, keep-first, top-k, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

QUALITY = 0.75


def between(date: Column, start: str, end: str | None) -> Column:
    """Half-open [start, end) on dates; an end of None is open."""
    out = date >= F.lit(start).cast("date")
    return out & (date < F.lit(end).cast("date")) if end else out


def good(df: DataFrame, threshold: float = QUALITY) -> DataFrame:
    return df.where(F.col("quality_score") >= threshold)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered; Spark keeps k of a group in each task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def keep_first(df: DataFrame, key: Column | str, seq: Sequence[str], drop_empty: bool = True) -> DataFrame:
    """The first row of each key in the order of `seq`. Rows without a key (null or empty) go, or all stay.

    Works as an aggregate of whole rows, which combines before the shuffle, so a frequent key costs no task its rows.
    """
    key = F.col(key) if isinstance(key, str) else key
    named = df.withColumn("_key", F.nullif(key.cast("string"), F.lit("")))
    cols = df.columns
    first = F.min_by(F.struct(*cols), F.struct(*seq)).alias("_row")
    out = named.where(F.col("_key").isNotNull()).groupBy("_key").agg(first).select("_row.*")
    return out if drop_empty else out.unionByName(named.where(F.col("_key").isNull()).select(*cols))


def last_wins(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Keyed upsert of a change log: the last row of each key in the order of `seq`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_row")).select(*keys, "_row.*")


def trend(recent: Column, before: Column, window: int, span: int, up: float, names: tuple[str, str, str], parity: bool = False) -> Column:
    """Compares monthly rates: rising above (1 + up), falling below (1 - up), else the third name.

    With parity, the earlier rate cancels to 12 a month whenever there is any earlier document.
    """
    base = F.when(before > 0, F.lit(12.0)).otherwise(F.lit(0.0)) if parity else before / F.lit(float(span - window))
    rate = recent / F.lit(float(window))
    return F.when(rate > base * (1 + up), names[0]).when(rate < base * (1 - up), names[1]).otherwise(names[2])
