"""Text and vector search: BM25, cosine, reciprocal rank fusion, hybrids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import cosine
from ..plans.lineage import cut

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def _is(word: str):
    return lambda x: x == word


def bm25(docs: DataFrame, query: str, text: Column, k: int | None = 20, k1: float = 1.2, b: float = 0.75, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, rank): the k best documents for the words of a query.

    One scan of the texts gives each document's length and its counts of the query's words, a thin table that is written
    once; nothing is exploded or shuffled but one row of totals. idf = ln(1 + (N - df + .5) / (df + .5)).
    """
    import re

    words = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    counts = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("t"))
    tf = [F.size(F.filter("t", _is(w))).alias(f"f{i}") for i, w in enumerate(words)]
    per = cut(counts.select("doc_id", F.size("t").alias("len"), *tf))
    totals = per.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(words))])  # one row
    df = per.where(reduce(lambda x, y: x | y, [F.col(f"f{i}") > 0 for i in range(len(words))], F.lit(False))).crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(len(words)):
        f, d = F.col(f"f{i}"), F.col(f"d{i}")
        score = score + F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    out = df.select("doc_id", F.round(score, 6).alias("score"))
    return ranked(out, k)


def ranked(df: DataFrame, k: int | None) -> DataFrame:
    """Rows by falling score, ties by id, numbered from 1: the first k, or all, in ranges of scores."""
    order = [F.desc("score"), F.col("doc_id")]
    if k:
        return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in parts.groupBy("_part").count().collect())  # one row a partition
    before, at = [F.lit(-1), F.lit(0)], 0
    for part, n in sizes:
        before += [F.lit(part), F.lit(at)]
        at += n
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("rank", (own + F.element_at(F.create_map(*before), F.col("_part"))).cast("int")).drop("_part")


def vector_search(vectors: DataFrame, query: Sequence[float], k: int = 20, threshold: float | None = 0.7, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(doc_id, score, rank): the k most similar vectors at or above the threshold."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select(F.col(vec_id).alias("doc_id"), F.round(cosine(F.col(vector), q), 6).alias("score"))
    return ranked(out.where(F.col("score") >= threshold) if threshold is not None else out, k)


def rrf(lists: Sequence[DataFrame], k: int = 60) -> DataFrame:
    """(doc_id, score): the sum over ranked lists (doc_id, rank) of 1 / (k + rank)."""
    parts = [x.select("doc_id", (1.0 / (F.lit(k) + F.col("rank"))).alias("s")) for x in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.round(F.sum("s"), 9).alias("score"))


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, k: int = 10, rrf_k: int = 60) -> DataFrame:
    """Both lists fused; scores are ten times the fused ones, 1 at most."""
    fused = rrf([vector_hits, text_hits], rrf_k).withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") * 10), 6))
    return ranked(fused, k)


def restricted(hits: DataFrame, allowed: DataFrame, k: int = 10) -> DataFrame:
    """Hits among allowed documents, taken after the ranking, so there may be fewer than k."""
    return ranked(hits.drop("rank").join(allowed.select("doc_id"), "doc_id", "left_semi"), k)


def to_embed(nodes: DataFrame, vector: str = "embedding") -> DataFrame:
    return nodes.where(F.col(vector).isNull() | (F.size(vector) == 0))


def similar_communities(centres: DataFrame, query: Sequence[float], threshold: float = 0.8, k: int = 10) -> DataFrame:
    return vector_search(centres, query, k, threshold, "label", "centre")


def centres(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centre): mean vector of each label, its components combined before the shuffle."""
    one = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return one.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def nearest(queries: DataFrame, items: DataFrame, k: int | None = None, least: float = -1.0, rows: int = 4096) -> DataFrame:
    """(qid, id, score): the items (id, v) of most cosine to each query (qid, qv), `least` at least: the k best, ties by id,
    or all. Scores have 9 digits; null, empty and all-zero vectors have cosine 0, and only equal lengths meet.

    Every query meets every item, in blocks of `rows` of both, so that each group is bounded, whatever the sizes; a block
    gives at most k items a query.
    """
    import numpy as np
    import pyarrow as pa

    usable = lambda df, v: df.where(F.col(v).isNotNull())
    q = usable(queries.select("qid", F.col("qv").cast("array<double>").alias("qv")), "qv")
    i = usable(items.select("id", F.col("v").cast("array<double>").alias("v")), "v")
    q_blocks, i_blocks = (max(1, -(-df.count() // rows)) for df in (q, i))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(F.size("qv").alias("dim"), place("qid", q_blocks).alias("qb"), every(i_blocks).alias("ib"), "qid", "qv")
    right = i.select(F.size("v").alias("dim"), place("id", i_blocks).alias("ib"), every(q_blocks).alias("qb"), "id", "v")
    schema = left.select("qid").join(right.select("id"), F.lit(False)).withColumn("score", F.lit(0.0)).schema

    def unit(column: pa.ChunkedArray, dim: int) -> np.ndarray:
        x = np.concatenate([np.asarray(c.flatten(), np.float64).reshape(len(c), dim) for c in column.chunks])
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["qid", "id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([a.column("qid").slice(0, 0), b.column("id").slice(0, 0), pa.array([], pa.float64())], names=names)
        dim = a.column("dim")[0].as_py()
        scores = np.round(unit(a.column("qv"), dim) @ unit(b.column("v"), dim).T, 9)
        low = np.full(len(scores), least)
        if k and scores.shape[1] > k:
            low = np.maximum(low, np.partition(scores, -k, axis=1)[:, -k])
        row, at = np.nonzero(scores >= low[:, None])
        return pa.table([a.column("qid").take(pa.array(row)), b.column("id").take(pa.array(at)), pa.array(scores[row, at])], names=names)

    keys = ["dim", "qb", "ib"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    if not k:
        return met
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return met.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
