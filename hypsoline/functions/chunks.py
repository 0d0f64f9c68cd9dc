"""Splitting long texts into chunks, which is a recurrence: a Python table function over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F


def by_blank_line(text: str, size: int = 5000) -> list[str]:
    """Chunks of at most `size` characters, broken after the last blank line where there is one."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = text.rfind("\n\n", at, end)
            if cut > at:
                end = cut + 2
        out.append(text[at:end])
        at = end
    return out


def overlapping(text: str, size: int = 16_000, overlap: int = 800) -> list[str]:
    """Chunks of at most `size` characters that repeat the last `overlap` of the one before; a chunk ends after a
    sentence where one ends in its last tenth."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = text.rfind(". ", at + size * 9 // 10, end)
            if cut > 0:
                end = cut + 2
        out.append(text[at:end])
        if end == len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def chunk(df: DataFrame, key: str, text: str, how=by_blank_line, **options: int) -> DataFrame:
    """(key, chunk_no, chunk) of each text; null and empty texts have no chunk."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch["k"], batch["t"], strict=True) if isinstance(t, str) for i, c in enumerate(how(t, **options))]
            yield pd.DataFrame(rows, columns=["k", "chunk_no", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, chunk_no int, chunk string").withColumnRenamed("k", key)
