"""SimHash near-duplicates through pivot distance tables.

The pivots are reference fingerprints: a fixed base and, for each block of bits, the base with Walsh patterns of that
block turned over. The table of a fingerprint holds its Hamming distances to all of them. The triangle inequality says
that fingerprints within r bits differ by at most r in every column of the table. More than that: with blocks in
families, r differing bits leave all columns of some family the same distance from the base's column, so the fingerprints
that share those columns, a cell, hold every linked pair. Pairs of a cell are discarded by their maximum column
difference, and survivors verified on the fingerprints themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .common import col, cut, map_arrow, row_hash, sieved, unused
from .components import components

RADIUS = 2
BASE = 0x9E3779B97F4A7C15
BLOCKS = 4
#: A cell with more members is divided by the columns of smaller blocks; such a part has at most 2**16 members.
CELL = 4096


def walsh(start: int, width: int) -> list[int]:
    """The Walsh patterns of the bits start .. start + width - 1."""
    masks = []
    for s in range(width):
        bits = (i for i in range(width) if (i & s).bit_count() % 2 == 0)
        masks.append(sum(1 << (start + i) for i in bits))
    return masks


def block_masks(blocks: int = BLOCKS) -> list[list[int]]:
    width = 64 // blocks
    return [walsh(b * width, width) for b in range(blocks)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes | None, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, repeats included, some at a time; a text of fewer words is one shingle."""
    tokens = (text or b"").lower().split()  # of bytes: A-Z only, and split at \\x20 and \\x09-\\x0D only
    if not tokens:
        return
    line, n = b" ".join(tokens), len(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    if n < words:
        begins, ends = [0], [len(line)]
    else:
        begins, ends = begins[: n - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begins), 1 << 16):
        yield np.array([digest(line[a:b], seed) for a, b in zip(begins[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], dtype="<u8")


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit, the lowest first."""
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # as many as a byte can count
        out += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return out


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, words, seed):
        ones += bit_sums(hashes)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "fingerprint") -> DataFrame:
    """The columns `keep` and `out`, a long with the bits of each whole text's SimHash. Null text: 0."""

    def make(rows: pa.RecordBatch, arrays: list[pa.Array]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        yield rows, [pa.array([signed(fingerprint(t.as_py())) for t in arrays[0]], pa.int64())]

    return map_arrow(docs, list(keep), [col(text).cast("binary")], [T.StructField(out, T.LongType())], make)


def column(fp: Column, mask: int) -> Column:
    """Distance to the pivot base ^ mask, less the distance to the base."""
    return F.bit_count(fp.bitwiseXOR(F.lit(signed(BASE ^ mask)))) - F.bit_count(fp.bitwiseXOR(F.lit(signed(BASE))))


def cell_keys(fp: Column, masks: list[list[int]], spare: int) -> Column:
    """array<struct<family, cell>>: a cell for each choice of all but `spare` blocks."""
    shares = [F.xxhash64(*[column(fp, m) for m in block]) for block in masks]
    chosen = list(itertools.combinations(range(len(masks)), len(masks) - spare))
    return F.array(*[F.struct(F.lit(i).alias("family"), F.xxhash64(*[shares[b] for b in c]).alias("cell")) for i, c in enumerate(chosen)])


def finer(blocks: int = BLOCKS, spare: int = RADIUS) -> list[tuple[int, list[list[int]]]]:
    """For each family, the patterns of the two halves of each block that it leaves out."""
    width = 64 // blocks
    out = []
    for i, c in enumerate(itertools.combinations(range(blocks), blocks - spare)):
        left = [b for b in range(blocks) if b not in c]
        out.append((i, [walsh(b * width + h * width // 2, width // 2) for b in left for h in (0, 1)]))
    return out


def link_cell(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning set of the links among one cell's fingerprints, found by its pivot table."""
    x = np.unique(prints).view(np.uint64)
    n = len(x)
    if n < 2:
        return []
    pivots = np.array([BASE] + [BASE ^ m for block in block_masks() for m in block], dtype=np.uint64)
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, js: np.ndarray) -> None:
        for j in js.tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)

    step = max(1, (1 << 22) // len(pivots))
    distances = np.concatenate([np.bitwise_count(x[a : a + step, None] ^ pivots) for a in range(0, n, step)]).astype(np.int8)
    order = np.argsort(distances[:, 0], kind="stable")
    x, distances = x[order], distances[order]
    base = distances[:, 0]
    ends = np.searchsorted(base, base + radius, side="right")
    for i in range(n - 1):
        a, b = i + 1, int(ends[i])
        if b <= a:
            continue
        near = np.arange(a, b)
        for p in range(1, len(pivots), 8):  # discard by the maximum column difference, some columns at a time
            near = near[(np.abs(distances[near, p : p + 8] - distances[i, p : p + 8]) <= radius).all(axis=1)]
            if not len(near):
                break
        if len(near):
            join(i, near[np.bitwise_count(x[near] ^ x[i]) <= radius])
    y = x.view(np.int64)
    return [(int(y[i]), int(y[r])) for i in range(n) if (r := top(i)) != i]


def links(prints: DataFrame, fp: str = "fp", limit: int = CELL) -> DataFrame:
    """(a, b): links among distinct fingerprints whose components are those of all pairs within RADIUS bits."""
    keyed = prints.select("fp", F.explode(cell_keys(F.col(fp), block_masks(), RADIUS)).alias("k")).select("fp", "k.family", "k.cell")
    large = keyed.groupBy("family", "cell").count().where(F.col("count") > limit).select("family", "cell")
    large = cut(large)
    if large.isEmpty():
        cells = keyed
    else:
        sub = F.lit(None)
        for i, masks in finer():
            sub = F.when(F.col("family") == i, cell_keys(F.col("fp"), masks, RADIUS)).otherwise(sub)
        parts = keyed.join(large, ["family", "cell"], "left_semi").withColumn("s", F.explode(sub))
        parts = parts.select("fp", (F.col("family") * 100 + 100 + F.col("s.family")).alias("family"), F.xxhash64("cell", "s.cell").alias("cell"))
        cells = keyed.join(large, ["family", "cell"], "left_anti").unionByName(parts)
    gathered = cells.groupBy("family", "cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for fps in batch.column(0):
                found += link_cell(np.asarray(fps.values, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return gathered.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, fp long, root, component_id): each row with a hash of it, its fingerprint, its component, and the
    smallest doc_id that links reach from it.

    Equal fingerprints are one node, whose links stand for those of all its rows, so copies are never paired. Null
    and wordless texts have fingerprint 0 and link like others. Rows with a null id get the component of their
    fingerprint (component_id null if no row of the component has an id); repeated rows are repeated in the result.
    """
    thin = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), row_hash(docs).alias("row"))
    made = cut(fingerprints(thin, "text", ("doc_id", "row"), "fp"))
    nodes = cut(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "root", "component_id")
    return made.join(named, "fp").select("doc_id", "row", "fp", "root", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """docs less all but one row of each component: of those with the smallest doc_id, the one whose row has the smallest
    hash. Rows that agree in all columns are one. Rows with a null doc_id can't be told apart from others and stay.

    `placed` has a row (doc_id, row, root) for each row of docs, as near_duplicates() gives (its default) or near_copies().
    Rows that go, and heads that occur again, pass a sieve that is broadcast; only what it holds is shuffled to settle it,
    so that most texts stay where they lie. Empty input, empty output.
    """
    placed = cut((near_duplicates(docs) if placed is None else placed).select("doc_id", "row", "root").where("doc_id is not null"))
    heads = placed.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("head"))
    rows = placed.groupBy("root", "doc_id", "row").agg(F.count("*").alias("many")).join(heads, "root")
    is_head = F.struct("doc_id", "row") == F.col("head")
    touched = cut(rows.where(~is_head | (F.col("many") > 1)).select(F.col("row").alias("r"), is_head.alias("again")))
    names = docs.columns
    row, flag = unused(docs, "_row", "_flag")
    marked = sieved(docs.withColumn(row, F.when(col("doc_id").isNotNull(), row_hash(docs))), row, touched.select("r"), flag)
    settled = marked.where(col(flag)).join(touched.select("r"), col(row) == F.col("r"), "left_anti").select(*[col(c) for c in names])
    out = marked.where(~col(flag)).select(*[col(c) for c in names]).unionByName(settled)
    again = touched.where("again")
    if again.isEmpty():
        return out
    repeated = marked.where(col(flag)).join(again, col(row) == F.col("r"), "left_semi").dropDuplicates([row])
    return out.unionByName(repeated.select(*[col(c) for c in names]))


def op3(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
