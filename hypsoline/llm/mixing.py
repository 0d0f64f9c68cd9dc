"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Every source's documents are permuted by a hash and cut into blocks of that order, of about one size for all sources. A
source's target fixes its block quota: whole passes over its blocks, and how far a last pass goes. The tree then deals
the quotas to output shards: at each node, the left half of the shards gets a uniform draw without return from the
node's blocks, which is a multivariate hypergeometric draw of its counts a source. A shard takes the next blocks of each
source's permuted order, as many as it was dealt, so that shards hold disjoint blocks whose numbers add up to the quotas
exactly. A document comes as often as its block was dealt, into the shards that it was dealt to, and a shard's rows are
shuffled by a hash.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import col, cut, small_table, unused

MOST = 3  # copies of a document at most
#: Blocks that all words are cut into; every source has one block at least.
BLOCKS = 4096
SEED = 10
WORDS = r"[^\x20\x09-\x0D]+"
#: The rows that one window may sort; the search for the last block's end narrows until no source has more.
WINDOW_ROWS = 2_000
#: The sources there may be; the driver holds a row of the plan for each (under 300 bytes), which is broadcast.
MOST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, held at most * size, the excess dealt again by weight until none is above.

    With sources by falling weight for their size, the held ones are a beginning of the list; a source is held if it
    is above its limit even when all before it are.
    """
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight, out = sum(sizes), sum(weights), [0.0] * len(sizes)
    for at, i in enumerate(order):
        if most * sizes[i] * weight >= left * weights[i]:
            for j in order[at:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = float(most * sizes[i])
        left -= most * sizes[i]
        weight -= weights[i]
    return out


def drawn(counts: list[int], draws: int, node: str) -> list[int]:
    """How many balls of each kind are among `draws` drawn from counts without return: those that come first in an order
    by hash, so that every set of that many balls is as likely as any other, whatever the counts."""
    key = lambda s, i: hashlib.md5(f"{SEED}|{node}|{s}|{i}".encode()).hexdigest()
    out = [0] * len(counts)
    for _, s in sorted((key(s, i), s) for s, n in enumerate(counts) for i in range(n))[:draws]:
        out[s] += 1
    return out


def split_tree(quotas: list[int], shards: int, node: str = "0") -> list[list[int]]:
    """Each shard's quota of each source's blocks: a node's blocks go to the halves of its shards, by a draw."""
    if shards == 1:
        return [quotas]
    half = shards // 2
    left = drawn(quotas, sum(quotas) * half // shards, node)
    rest = [a - b for a, b in zip(quotas, left, strict=True)]
    return split_tree(left, half, node + "0") + split_tree(rest, shards - half, node + "1")


def block_of(u: Column, blocks: Column) -> Column:
    """The block, of so many, that holds the place u of a source's permuted order."""
    return F.shiftright(F.shiftright(u, 24) * blocks, 36)


def permuted(doc_id: Column, text: Column) -> Column:
    """A place in 0 .. 2**60 - 1 that depends on the id and the text alone."""
    key = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(SEED)), F.md5(F.coalesce(text.cast("binary"), F.lit("").cast("binary"))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


class Mix:
    """A planned mix: `thin` has a row (source, u, size) for each document, `sources` one for each source.

    Null texts have no words; null sources are one source, the last; a null doc_id counts as an empty one. Rows that
    repeat a doc_id and text share a place, and so their fate. Sources without words have target 0 and are not taken;
    an empty table has an empty plan.
    """

    def __init__(
        self, docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", shards: int = 8, weights=(1, 2, 3), most: int = MOST
    ):
        self.names, self.most, self.shards = (source, text, doc_id), most, shards
        thin = docs.select(col(source).alias("source"), permuted(col(doc_id), col(text)).alias("u"), words(col(text)).alias("size"))
        self.thin = cut(thin)
        spark = docs.sparkSession
        found = self.thin.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        rows = [tuple(r) for r in found.limit(MOST_SOURCES + 1).collect()]
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))
        wanted = targets([r[1] for r in rows], [float(weights[i % len(weights)]) for i in range(len(rows))], most)
        self.plan = []
        block_words = max(1, -(-sum(r[1] for r in rows) // BLOCKS))
        for (name, size, count), goal in zip(rows, wanted, strict=True):
            passes = min(most, math.floor(goal / size)) if size else 0
            rest = min(float(size), goal - passes * size) if passes < most else 0.0
            own = {"source": name, "source_size": size, "target": goal, "passes": passes, "rest": rest, "rows": count}
            self.plan.append(own | {"blocks": max(1, -(-size // block_words))})
        self._ends(spark)
        for p in self.plan:  # a last pass may end within a block, whose places up to the end are taken
            p["quota"] = p["passes"] * p["blocks"] + ((p["end"] - 1 >> 24) * p["blocks"] >> 36) + 1
        shares = split_tree([p["quota"] for p in self.plan], shards)
        for s, p in enumerate(self.plan):
            p["cuts"], at = [], 0
            for share in shares:
                at += share[s]
                p["cuts"].append(at)
        keep = ("source", "source_size", "target", "passes", "end", "blocks", "cuts")
        schema = "source string, source_size long, target double, passes int, end long, blocks long, cuts array<long>"
        self.sources = small_table(spark, [{k: p[k] for k in keep} for p in self.plan], schema)

    def _ends(self, spark) -> None:
        """Where in the permuted order each source's last pass ends: before the document whose middle is past `rest`.

        The unit of the search halves its places by 2**10 a round, as sums of all documents by place; windows then
        sort only the few documents left. Documents at one place (repeated rows) go together.
        """
        state = {p["source"]: [0, 60, 0] for p in self.plan if p["rest"] > 0}  # low, bits left, words before
        rest = {p["source"]: p["rest"] for p in self.plan}
        rows = {p["source"]: p["rows"] for p in self.plan}
        while state and any(rows[s] > WINDOW_ROWS and v[1] > 10 for s, v in state.items()):
            found = self._within(spark, state).groupBy("source", F.expr("shiftright(u - low, bits - 10)").alias("at"))
            by: dict = {}
            for s, at, size, count in found.agg(F.sum("size"), F.count("*")).collect():  # at most 1024 rows a source
                by.setdefault(s, []).append((at, size, count))
            for s, v in state.items():
                at, size, count = 0, 0, 0
                for at, size, count in sorted(by[s]):
                    if v[2] + size >= rest[s]:
                        break
                    v[2] += size
                else:
                    v[2] -= size
                v[0] += at << (v[1] - 10)
                v[1] -= 10
                rows[s] = count
        ends = {}
        if state:
            small = self._within(spark, state).groupBy("source", "u", "before", "rest").agg(F.sum("size").alias("size"))
            run = small.withColumn("cum", F.col("before") + F.expr("sum(size) over (partition by source order by u)") - F.col("size"))
            taken = run.where(F.col("cum") * 2 + F.col("size") <= F.col("rest") * 2)
            ends = {r[0]: r[1] + 1 for r in taken.groupBy("source").agg(F.max("u")).collect()}
        # where the search ended between rows, the end is behind the last row before
        between = [{"s": s, "low": 0, "bits": 60, "before": v[0], "rest": 0.0} for s, v in state.items() if s not in ends and v[0]]
        if between:
            below = self.thin.join(self._table(spark, between), F.col("source").eqNullSafe(F.col("s"))).where("u < before")
            ends |= {r[0]: r[1] + 1 for r in below.groupBy("source").agg(F.max("u")).collect()}
        for p in self.plan:
            p["end"] = ends.get(p["source"], 0) if p["source"] in state else 0

    def _table(self, spark, rows: list[dict]) -> DataFrame:
        """Sources of the search, fewer than MOST_SOURCES."""
        return F.broadcast(small_table(spark, rows, "s string, low long, bits int, before long, rest double"))

    def _within(self, spark, state: dict) -> DataFrame:
        rest = {p["source"]: p["rest"] for p in self.plan}
        rows = [{"s": s, "low": v[0], "bits": v[1], "before": v[2], "rest": rest[s]} for s, v in state.items()]
        return self.thin.join(self._table(spark, rows), F.col("source").eqNullSafe(F.col("s"))).where("u >= low and u - low < shiftleft(1L, bits)")

    def copies(self, docs: DataFrame) -> DataFrame:
        """docs with size long, source_size long, target double, copies int and shards array<int>, the output shard
        of each copy in the order of passes; input columns of these names are replaced. A copy is a pass in which some
        shard drew the document's block; of a block in which the last pass ends, only places before the end are taken.
        A row's copies follow from its own columns and its source's line of the plan, so no text is shuffled."""
        source, text, doc_id = self.names
        made = ("size", "source_size", "target", "copies", "shards")
        kept = [c for c in docs.columns if c.lower() not in made]
        s_, u_, n_, q_, d_ = unused(docs, "_s", "_u", "_n", "_q", "_d")
        plan = self.sources.select(F.col("source").alias(s_), F.struct("source_size", "target", "passes", "end", "blocks", "cuts").alias(q_))
        out = docs.select(*[col(c) for c in kept], permuted(col(doc_id), col(text)).alias(u_), words(col(text)).alias(n_))
        out = out.join(F.broadcast(plan), col(source).eqNullSafe(F.col(s_)), "left")
        q, u = F.col(q_), F.col(u_)
        block = block_of(u, q["blocks"])

        def shard_of(k: Column) -> Column:
            """The shard that drew the block in pass k; beyond all cuts no shard did."""
            return F.size(F.filter(q["cuts"], lambda c: c <= k * q["blocks"] + block))

        reached = F.filter(F.sequence(F.lit(0), F.lit(self.most)), lambda k: (k < q["passes"]) | ((k == q["passes"]) & (u < q["end"])))
        dealt = F.filter(F.transform(reached, shard_of), lambda x: x < self.shards)
        out = out.withColumn(d_, F.coalesce(dealt, F.array().cast("array<int>")))
        figures = (F.col(n_).alias("size"), q["source_size"].alias("source_size"), q["target"].alias("target"), F.size(d_).alias("copies"))
        return out.select(*[col(c) for c in kept], *figures, F.col(d_).alias("shards"))

    def draw(self, docs: DataFrame) -> DataFrame:
        """The mix itself: docs' columns, a row for each copy taken, with its shard int and place long; sorting a
        shard by place shuffles it. Input columns of these two names are replaced."""
        kept = [c for c in docs.columns if c.lower() not in ("shard", "place")]
        inner = docs.select(*[col(c).alias(f"c{i}_") for i, c in enumerate(kept)])
        part = Mix.__new__(Mix)
        part.__dict__ = self.__dict__ | {"names": tuple(f"c{kept.index(n)}_" for n in self.names)}
        out = part.copies(inner).select("*", F.posexplode("shards").alias("k_", "shard"))
        out = out.withColumn("place", F.xxhash64(F.lit(SEED), *[F.col(part.names[i]) for i in (2, 1)], F.col("k_")))
        return out.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(kept)], "shard", "place")


def op10(docs: DataFrame) -> DataFrame:
    """Words the mix takes of each document, its copies times its size; and the shards that its copies go to, ascending."""
    own = docs.select("doc_id", "source", "text")
    out = Mix(own).copies(own)
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return out.select("doc_id", "size", "source_size", "target", taken, F.array_join(F.array_sort("shards"), ",").alias("shards"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs as mixed: every row as often as it is taken, with docs' own columns, shard after shard and each shard in the
    order of its places. Ranges of (shard, place) are tasks, so that a shard may be larger than any of them. Rows with a
    null text or source stay if their source is taken; empty input, empty output."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = {n: f"c{names.index(n)}" for n in ("source", "text", "doc_id")}
    out = Mix(inner, **own).draw(inner).repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    return out.drop("shard", "place").toDF(*names)
