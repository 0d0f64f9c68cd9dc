"""Near copies by SimHash with pivot distance tables, verified by the exact Jaccard similarity of word shingles.

A text's shingles, as a set, give a fingerprint of 256 bits. Pairs of a similarity of 0.8 or more differ by 39 bits on
average (standard deviation 6; 48 for texts of five shingles), so a radius of 68 bits misses about one in 10**6 of them, and
one in 2000 where a text has five shingles. Steps:

1. Cells. A fingerprint lies in one cell for each of the 24 least shingle hashes of its text. If x of the least hashes of
   both texts together count, a pair of similarity s shares no cell with a chance of (1 - s)**x: below 10**-16 for 24, and
   below 3 * 10**-6 for the 8 that are left at least where cells of common passages, the largest ones, are left out.
2. Pivots. Within a cell, distances to reference fingerprints of the cell are precomputed; pairs fall by their maximum
   coordinate difference, then by their distance. The links that are left form clusters.
3. Survivors. The shingle sets of a cluster's texts, and of no others, are compared.

Groups of any size are split into blocks of bounded size that share the group's reference members; what the blocks do not
join into one component is compared with all members, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .common import col, cut, map_arrow, row_hash, sieve
from .components import components
from .simhash import bit_sums, shingle_hashes

WORDS = 5
SIMILARITY = Fraction(4, 5)
PARTS = 4  # of 64 bits
RADIUS = 68
LEAST = 24
#: Least hashes outside large cells from which on a text leaves the large ones out.
ENOUGH = 8
#: Reference fingerprints of a cell.
PIVOTS = 32
#: Members of a cell from which on it is large, and fingerprints of a block.
CELL = 4096
#: Shingles in the sets of a block.
BLOCK = 1 << 21
#: Groups up to this size, in fingerprints or shingles, are handled many at a time.
TINY = 64, 1 << 13

PRINTS = [f"p{i}" for i in range(PARTS)]


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a whole text, ascending as unsigned numbers."""
    found = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """PARTS numbers: the majority bits of the hashes and of their remixed forms."""
    out = np.zeros(PARTS, np.uint64)
    for part in range(PARTS if len(hashes) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            x = hashes[at : at + (1 << 16)] + np.uint64(part * 0x9E3779B97F4A7C15 % 2**64)
            if part:  # a bijective mix, so that the parts are independent
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x = x ^ (x >> np.uint64(31))
            ones += bit_sums(x)
        out[part] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def sketched(docs: DataFrame, words: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, key long (equal shingle sets, equal keys), n int, p0 .. p3 long, least array<long> of each row."""

    def make(rows: pa.RecordBatch, arrays: list[pa.Array]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        sets = [shingle_set(t.as_py(), words) for t in arrays[0]]
        keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets], np.uint64).view(np.int64)
        prints = np.array([wide_print(x) for x in sets], np.uint64).reshape(-1, PARTS).view(np.int64)
        ends = np.cumsum([0] + [min(len(x), LEAST) for x in sets]).astype(np.int32)
        least = np.concatenate([np.zeros(0, np.uint64), *[x[:LEAST] for x in sets]]).view(np.int64)
        sizes = pa.array([len(x) for x in sets], pa.int32())
        yield rows, [pa.array(keys), sizes, *[pa.array(prints[:, i]) for i in range(PARTS)], pa.ListArray.from_arrays(pa.array(ends), pa.array(least))]

    longs = [T.StructField(c, T.LongType()) for c in ("key", *PRINTS)]
    made = [longs[0], T.StructField("n", T.IntegerType()), *longs[1:], T.StructField("least", T.ArrayType(T.LongType()))]
    return map_arrow(docs, list(keep), [col(text).cast("binary")], made, make)


Link = Callable[[list[np.ndarray]], list[tuple[int, int]]]


def spanning(near: Callable[[int, np.ndarray], np.ndarray], many: int) -> list[tuple[int, int]]:
    """Links that span the components of a relation: near(i, others) are those of `others` that relate to i."""
    label, out = np.arange(many), []
    for i in range(many - 1):
        others = np.arange(i + 1, many)
        others = others[label[others] != label[i]]
        found = near(i, others) if len(others) else others
        labels, first = np.unique(label[found], return_index=True)
        out += [(i, int(found[j])) for j in first]
        label[np.isin(label, labels)] = label[i]
    return out


def link_prints(columns: list[np.ndarray], radius: int = RADIUS, t: Fraction = SIMILARITY) -> list[tuple[int, int]]:
    """Places of fingerprints, of a cell or block, that are linked: sizes that allow a similarity of t, at most
    `radius` differing bits. Pairs fall by the maximum column difference in the table of distances to PIVOTS members."""
    n, x = columns[0].astype(np.int64), np.stack(columns[1:], axis=1).view(np.uint64)
    pivots = x[:: max(1, len(x) // PIVOTS)][:PIVOTS]
    table = np.stack([np.bitwise_count(x ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        for p in range(0, table.shape[1], 8):
            others = others[(np.abs(table[others, p : p + 8] - table[i, p : p + 8]) <= radius).all(axis=1)]
        both = np.minimum(n[others], n[i]) * t.denominator >= np.maximum(n[others], n[i]) * t.numerator
        others = others[both]
        return others[np.bitwise_count(x[others] ^ x[i]).sum(axis=1, dtype=np.int16) <= radius]

    return spanning(near, len(x))


def link_sets(columns: list[pa.Array], t: Fraction = SIMILARITY) -> list[tuple[int, int]]:
    """Places of shingle sets whose links span the components of all pairs with a similarity of t or more."""
    sets = columns[0]
    ends = np.asarray(sets.offsets, np.int64)
    sizes, flat = np.diff(ends), np.asarray(sets.values, np.int64)[ends[0] : ends[-1]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    number = np.cumsum(new) - 1
    starts = np.r_[np.flatnonzero(new), len(flat)]
    back = np.argsort(owner, kind="stable")
    number_of, begins = number[back], np.r_[0, np.cumsum(sizes)]

    def near(i: int, others: np.ndarray) -> np.ndarray:
        """Counts along the holders of each of i's shingles."""
        mine = number_of[begins[i] : begins[i + 1]]
        a, many = starts[mine], starts[mine + 1] - starts[mine]
        a, many = a[many > 1], many[many > 1]
        place = np.repeat(a - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(a) else a
        both = np.bincount(owner[place], minlength=len(sizes))[others]
        return others[both * (t.numerator + t.denominator) >= t.numerator * (sizes[others] + sizes[i])]

    return spanning(near, len(sizes))


def arrays_of(batch, names: list[str]) -> list:
    return [c if pa.types.is_list(c.type) else np.asarray(c) for c in (batch.column(n) for n in names)]


def group_links(members: DataFrame, payload: list[str], link: Link, weight: Column, tiny: int, most: int) -> DataFrame:
    """(a, b): keys whose links have the components that all pairs of a group's members give; members: (g, key, *payload).

    Groups up to `tiny` in weight come many to a batch, those up to `most` alone. Larger ones are dealt to blocks of about
    `most`, each with the same PIVOTS members of the group; components of these links are compared where they differ:
    members outside the group's largest component, in blocks, with all its blocks.
    """
    sizes = members.groupBy("g").agg(F.count("*").alias("many"), F.sum(weight).alias("w")).where("many > 1").select("g", "w")
    large = cut(sizes.where(F.col("w") > tiny))
    alone, over = large.agg(F.count_if(F.col("w") <= most), F.count_if(F.col("w") > most)).first()
    pairs = "a long, b long"

    def table(keys: np.ndarray, found: list[tuple[int, int]]) -> list[pa.Array]:
        return [pa.array([keys[f[i]] for f in found], pa.int64()) for i in (0, 1)]

    def many_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(0)
            ends, flat = np.asarray(listed.offsets), pa.RecordBatch.from_struct_array(listed.values)
            keys, links = np.asarray(flat.column("key")), []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                links += [(a + i, a + j) for i, j in link(arrays_of(flat.slice(a, b - a), payload))]
            yield pa.RecordBatch.from_arrays(table(keys, links), names=["a", "b"])

    def one_group(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys, first = np.unique(group.column("key").to_numpy(), return_index=True)  # a reference member may come twice
        own = group.take(pa.array(first)).combine_chunks().to_batches()
        return pa.table(table(keys, link(arrays_of(own[0], payload)) if own else []), names=["a", "b"])

    gathered = members.join(sizes.where(F.col("w") <= tiny), "g").groupBy("g").agg(F.collect_list(F.struct("key", *payload)).alias("x"))
    out = gathered.select("x").mapInArrow(many_groups, pairs)
    if alone:
        one = members.join(large.where(F.col("w") <= most).select("g"), "g")
        out = out.unionByName(one.groupBy("g").applyInArrow(one_group, pairs))
    if not over:
        return out

    blocks = F.ceil(F.col("w") / most)
    dealt = members.join(large.where(F.col("w") > most).select("g", blocks.alias("blocks")), "g")
    dealt = dealt.withColumn("j", F.pmod(F.xxhash64("key"), F.col("blocks")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    place = F.expr("row_number() over (partition by g order by xxhash64(key, 2))")
    shared = dealt.withColumn("place", place).where(F.col("place") <= PIVOTS).drop("place", "j").withColumn("j", every(F.col("blocks")))
    first = cut(dealt.unionByName(shared).groupBy("g", "j").applyInArrow(one_group, pairs))
    roots = components(first)
    labelled = cut(dealt.join(roots, F.col("key") == F.col("node"), "left").withColumn("c", F.coalesce("root", "key")).select("g", "key", "c", weight.alias("w")))
    top = labelled.groupBy("g", "c").agg(F.count("*").alias("many")).groupBy("g").agg(F.max_by("c", F.struct("many", "c")).alias("top"))
    left = cut(labelled.join(top, "g").where(F.col("c") != F.col("top")).select("g", "key", "w"))
    few = left.groupBy("g").agg(F.ceil(F.sum("w") / most).alias("parts"))
    own = dealt.join(left.select("g", "key"), ["g", "key"], "left_semi").join(few, "g").drop("j")
    own = own.withColumn("i", F.pmod(F.xxhash64("key"), F.col("parts"))).withColumn("j", every(F.col("blocks")))
    others = dealt.join(few, "g").withColumn("i", every(F.col("parts")))
    return out.unionByName(first).unionByName(own.unionByName(others).groupBy("g", "i", "j").applyInArrow(one_group, pairs))


def cells(nodes: DataFrame, large: int = CELL) -> DataFrame:
    """(g, key): the cells of two or more fingerprints. Cells of up to TINY members that hold the same ones are one."""
    thin = nodes.select("key", F.size("least").alias("size"), F.explode("least").alias("gram"))
    many = thin.groupBy("gram").agg(F.count("*").alias("many")).where("many > 1")
    shared = cut(thin.join(many, "gram"))
    wide = shared.where(F.col("many") > large)
    full = wide.groupBy("key").agg((F.max("size") - F.count("*")).alias("rest")).where(F.col("rest") < ENOUGH).select("key")
    medium = shared.where(F.col("many") <= large).where(F.col("many") > TINY[0])
    lists = shared.where(F.col("many") <= TINY[0]).groupBy("gram").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    lists = lists.groupBy(F.xxhash64("keys").alias("g")).agg(F.first("keys").alias("keys"))
    named = F.col("gram").alias("g")
    return lists.select("g", F.explode("keys").alias("key")).unionByName(medium.select(named, "key")).unionByName(wide.join(full, "key").select(named, "key"))


def near_copies(
    docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY, radius: int = RADIUS, cell: int = CELL, block: int = BLOCK
) -> DataFrame:
    """(doc_id, row, root, component_id) for each row of docs: a hash of the row, its component, and the smallest doc_id
    that pairs with `similarity` or more reach from it.

    Texts of fewer words than `words` are one shingle; null and wordless texts are copies of each other. Rows with a null
    id get the component of their text (component_id null if no row of the component has an id). Repeated rows are
    repeated; an empty table gives an empty one. Equal shingle sets are one node, so copies are never paired.
    """
    thin = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"), F.xxhash64(col("text")).alias("th"), row_hash(docs).alias("row"))
    made = cut(sketched(thin, words, keep=("doc_id", "row", "th")))
    nodes = made.where("n > 0").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", *PRINTS, "least")])
    nodes = cut(nodes)
    members = cells(nodes, cell).join(nodes.select("key", "n", *PRINTS), "key")
    found = group_links(members, ["n", *PRINTS], lambda x: link_prints(x, radius, similarity), F.lit(1), TINY[0], cell)
    clusters = cut(components(found))

    wanted = cut(clusters.join(made.groupBy("key").agg(F.min("th").alias("th")), F.col("node") == F.col("key")).select("th", "key", F.col("root").alias("g")))
    texts = sieve(thin.select("th", "text"), "th", wanted.select("th")).groupBy("th").agg(F.first("text").alias("text"))
    sets = texts.join(wanted, "th").select("g", "key", "text")

    def make(rows: pa.RecordBatch, arrays: list[pa.Array]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for at in range(0, rows.num_rows, 64):
            own = [shingle_set(t.as_py(), words).view(np.int64) for t in arrays[0].slice(at, 64)]
            ends = np.cumsum([0] + [len(x) for x in own]).astype(np.int32)
            yield rows.slice(at, 64), [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))]

    grams = map_arrow(sets, ["g", "key"], [F.col("text").cast("binary")], [T.StructField("grams", T.ArrayType(T.LongType()))], make)
    verified = group_links(cut(grams), ["grams"], lambda x: link_sets(x, similarity), F.size("grams"), TINY[1], block)
    roots = components(verified)
    placed = made.select("doc_id", "row", "key").join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "row", F.coalesce("root", "key").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root").select("doc_id", "row", "root", "component_id")
