"""Exact top-k by inner product with vector-approximation files.

The approximation file holds, for each vector, one byte a component: which of 256 equal-width intervals of its page's
range holds it. It is made once, from the exact file, and only it goes to the queries. A scan of its cells gives a lower
and an upper bound of every score. A first scan, of every so many pages, gives each query a score that its kth result is
sure to reach; the second, of all pages, leaves the few vectors whose upper bound reaches it. Of these, exact vectors are
read by falling upper bound: first 2 k a query, then those whose upper bound still reaches the kth exact score found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import col, cut, sieved

PAGE_ROWS = 16384
QUERY_ROWS = 4096
#: Queries whose bounds are held at once.
QUERY_STEP = 256
CELLS = 256
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53
#: Scores are longs, and held at their ends.
END = 2.0**63

PAGE = "dim int, ids array<long>, variants array<long>, low array<double>, width array<double>, cells binary"
FOUND = "query_id long, query_variant long, vec_id long, variant long, lower double, upper double"


def quantise(values: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell numbers as bytes, low, width) of a page of vectors; the interval i is low + width * [i, i + 1]."""
    low = values.min(axis=0)
    width = np.maximum((values.max(axis=0) - low) / cells, 1e-9)
    numbers = np.clip(np.floor((values - low) / width), 0, cells - 1).astype(np.uint8)
    return numbers, low, width


def bounds(queries: np.ndarray, numbers: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of query x vector scores, from cells alone, widened by the rounding error."""
    middle, half = queries @ (low + (numbers + 0.5) * width).T, np.abs(queries) @ (width / 2)
    slack = np.abs(queries) @ np.maximum(np.abs(low), np.abs(low + width * CELLS)) * 1e-12 + 1e-6
    gap = (half + slack)[:, None]
    return np.clip(middle - gap, -END, END), np.clip(middle + gap, -END, END)


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products row by row; Python's integers where doubles could round, kept within the range of a long."""
    if np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1]) < EXACT:
        return np.einsum("ij,ij->i", queries, vectors).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for q, v in zip(queries, vectors, strict=True)]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], dtype=np.int64)


def scan(page: dict, queries: dict, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query rows, page rows, lower, upper) of the vectors that may be among a query's k best: their upper bound
    reaches `least` of the query and the kth lower bound of the page."""
    numbers = np.frombuffer(page["cells"], np.uint8).reshape(len(page["ids"]), page["dim"])
    for at in range(0, len(queries["ids"]), QUERY_STEP):
        some = slice(at, at + QUERY_STEP)
        lower, upper = bounds(queries["v"][some], numbers, page["low"], page["width"])
        own = queries["ids"][some, None] == page["ids"]
        lower[own] = -np.inf
        least = queries["least"][some]
        if lower.shape[1] > k:
            least = np.maximum(least, np.partition(lower, -k, axis=1)[:, -k])
        rows, at_page = np.nonzero((upper >= least[:, None]) & ~own)
        yield rows + at, at_page, lower[rows, at_page], upper[rows, at_page]


def vectors_of(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, variant, v array<double> of whole numbers): distinct usable rows. Null ids, null vectors and vectors that
    hold a null or non-finite component, also after scaling, take no part; a repeated row counts once."""
    x = col(vector)
    scaled = F.transform(x, lambda e: e.cast("double") * scale)
    bad = F.exists(scaled, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = col(id_col).isNotNull() & x.isNotNull() & ~bad
    # doubles from EXACT on are whole already; floor() of those below is a long that holds it
    whole = F.transform(scaled, lambda e: F.when(F.abs(e) < EXACT, F.floor(e).cast("double")).otherwise(e))
    rows = df.where(ok).select(col(id_col).cast("long").alias("vec_id"), whole.alias("v")).distinct()
    return rows.select("vec_id", F.xxhash64("v").alias("variant"), "v")


def useful(usable: DataFrame, k: int) -> DataFrame:
    """usable less all but the k + 1 smallest ids of equal vectors. Ranks are of hashes (128 bits) and ids alone; rows of
    vectors with more ids are found through a sieve and settled by id, so that the others don't move."""
    thin = usable.select("vec_id", "variant", F.xxhash64(F.lit(1), "v").alias("other"))
    place = F.expr("row_number() over (partition by variant, other order by vec_id)")
    least = cut(thin.withColumn("place", place).where(F.col("place") <= k + 1))
    marked = sieved(usable, "variant", least.where(F.col("place") == k + 1).select("variant"), "flag")
    kept = marked.where("flag").join(least.select("vec_id", "variant"), ["vec_id", "variant"], "left_semi")
    return marked.where("not flag").drop("flag").unionByName(kept.drop("flag"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.empty((0, dim)), *[np.asarray(a.flatten(), np.float64).reshape(len(a), dim) for a in arrays]])


def pages(base: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """The approximation file: pages of up to `rows` vectors of one length, made where the vectors lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for dim, parts in held.items():
                ids, variants, v = (np.concatenate(x) for x in zip(*parts, strict=True))
                for at in range(0, len(ids), rows):
                    some = slice(at, at + rows)
                    numbers, low, width = quantise(v[some])
                    row = {"dim": dim, "ids": ids[some], "variants": variants[some], "low": low, "width": width, "cells": numbers.tobytes()}
                    yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in PAGE_TYPES.items()], names=list(PAGE_TYPES))
            held.clear()

        for b in batches:
            size = np.asarray(b.column("dim"))
            for dim in np.unique(size).tolist():
                own = b.filter(pa.array(size == dim))
                held.setdefault(dim, []).append((np.asarray(own.column("vec_id")), np.asarray(own.column("variant")), matrix(own.column("v"), dim)))
            many += b.num_rows
            if many >= rows:
                yield from flush()
                many = 0
        yield from flush()

    return base.select("vec_id", "variant", "v", F.size("v").alias("dim")).mapInArrow(run, PAGE)


PAGE_TYPES = {
    "dim": pa.int32(), "ids": pa.list_(pa.int64()), "variants": pa.list_(pa.int64()), "low": pa.list_(pa.float64()), "width": pa.list_(pa.float64()), "cells": pa.binary(),
}


def candidates(pages_: DataFrame, n_pages: int, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
    """FOUND: what scan() leaves of every page and query. Pages and blocks of queries (with their `least`) meet in
    groups, each of some pages of cells and one block of queries; no side is collected or broadcast."""
    q_blocks, groups = max(1, -(-n_queries // QUERY_ROWS)), max(1, n_pages)
    keyed = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", "variant"), F.lit(q_blocks)))
    left = keyed.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = pages_.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = right.withColumn("qb", F.col("qb").cast("long"))
    left = left.withColumn("g", F.col("g").cast("long"))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, t)] for t in (np.int64,) * 4 + (np.float64,) * 2]
        sizes = np.asarray(q.column("dim")) if q.num_rows else np.empty(0, np.int32)
        for page in c.to_batches(max_chunksize=1):
            if not page.num_rows:
                continue
            one = {n: page.column(n)[0] for n in PAGE_TYPES}
            dim = one["dim"].as_py()
            own = q.filter(pa.array(sizes == dim))
            if not own.num_rows:
                continue
            listed = {n: np.asarray(one[n].values) for n in ("ids", "variants", "low", "width")}
            block = {"ids": own.column("vec_id").to_numpy(), "v": matrix(own.column("v"), dim), "least": own.column("least").to_numpy()}
            variants = own.column("variant").to_numpy()
            for rows, at, lower, upper in scan(listed | {"dim": dim, "cells": one["cells"].as_py()}, block, k):
                found = (block["ids"][rows], variants[rows], listed["ids"][at], listed["variants"][at], lower, upper)
                for x, y in zip(out, found, strict=True):
                    x.append(y)
        names = [f.split()[0] for f in FOUND.split(", ")]
        return pa.table([pa.array(np.concatenate(x)) for x in out], names=names)

    return left.groupBy("qb", "g").cogroup(right.groupBy("qb", "g")).applyInArrow(meet, FOUND)


def kth(found: DataFrame, by: str, k: int) -> DataFrame:
    """(query_id, query_variant, kth): each query's kth largest value of `by`, for queries with as many rows."""
    place = F.expr(f"row_number() over (partition by query_id, query_variant order by {by} desc)")
    first = found.select("query_id", "query_variant", by).withColumn("place", place).where(F.col("place") <= k)
    return first.where(F.col("place") == k).select("query_id", "query_variant", F.col(by).cast("double").alias("kth"))


def scored(found: DataFrame, queries: DataFrame, base: DataFrame) -> DataFrame:
    """found with the exact score of its rows, read from the exact file."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("variant").alias("query_variant"), F.col("v").alias("q"))
    both = found.join(base, ["vec_id", "variant"]).join(q, ["query_id", "query_variant"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column("dim"))
            for dim in np.unique(size).tolist():
                own = b.filter(pa.array(size == dim))
                score = exact_scores(matrix(own.column("q"), dim), matrix(own.column("v"), dim))
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(score, pa.int64())], names=["query_id", "query_variant", "vec_id", "score"])

    rows = both.select("query_id", "query_variant", "vec_id", "q", "v", F.size("v").alias("dim"))
    return rows.mapInArrow(run, "query_id long, query_variant long, vec_id long, score long")


def top_k(
    df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, page_rows: int = PAGE_ROWS
) -> DataFrame:
    """(query_id, query_variant, rank, vec_id, score): the k best other rows of each row that satisfies is_query(id).

    Components count as floor(scale * x). All rows are candidates; those with the query's own id are not its own
    candidates. Only vectors of one length meet. Ids with several different vectors: each is a candidate and a query
    of its own, told apart by query_variant. Scores beyond a long are held at its ends. Ties go to the smaller id. Of
    equal vectors, only the k + 1 smallest ids can be among a query's k best, so the files hold no more of them. Empty
    input, empty output; columns other than the two are not read.
    """
    usable = cut(vectors_of(df, id_col, vector, scale))
    base = useful(usable, k)
    file = cut(pages(base, page_rows))  # the sieve leaves exact vectors where they are; only cells go on
    queries = usable.where(is_query(F.col("vec_id")))
    n_pages, n_queries = file.count(), queries.count()

    own: Column = F.col("vec_id")
    shaped = queries.select(own, "variant", "v", F.size("v").alias("dim"))
    step = math.isqrt(n_pages - 1) + 1 if n_pages > 1 else 1
    first = file.where(F.pmod(F.xxhash64("ids"), F.lit(step)) == 0)
    sure = kth(candidates(first, -(-n_pages // step), shaped.withColumn("least", F.lit(float("-inf"))), n_queries, k), "lower", k)
    named = sure.select(F.col("query_id").alias("vec_id"), F.col("query_variant").alias("variant"), F.col("kth").alias("least"))
    ready = shaped.join(named, ["vec_id", "variant"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = cut(candidates(file, n_pages, ready, n_queries, k))

    left = found.join(kth(found, "lower", k), ["query_id", "query_variant"], "left").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).drop("kth")
    order = F.expr("row_number() over (partition by query_id, query_variant order by upper desc, vec_id, variant)")
    left = cut(left.withColumn("place", order))
    read = scored(left.where(F.col("place") <= 2 * k), queries, base)
    rest = left.where(F.col("place") > 2 * k).join(kth(read, "score", k), ["query_id", "query_variant"], "left")
    read = read.unionByName(scored(rest.where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))), queries, base))
    rank = F.expr("row_number() over (partition by query_id, query_variant order by score desc, vec_id)")
    out = read.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "query_variant", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2(embeddings: DataFrame) -> DataFrame:
    found = top_k(embeddings, lambda i: F.pmod(i, F.lit(100)) == 0)
    return found.select("query_id", "rank", "vec_id", "score")
