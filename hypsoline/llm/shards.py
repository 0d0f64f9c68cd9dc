"""Sharding by sampled splitters, in DataFrame operations only.

A size-weighted sample of keys is drawn and its quantiles become boundaries of many ranges, to which records are dealt;
ranges that turn out overfull are divided again by samples of their own, all in one job, until none is left. Every range is
then one task's bounded work: running sizes within it, on top of the sizes of the ranges before it, give each record its
shard and place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import col, cut, row_hash, small_table, unused, without

#: Rows that a range should have, and the most ranges; beyond, ranges grow (by a hundredth of all rows at 32 billion).
RANGE_ROWS = 20_000
MOST_RANGES = 16_384
#: Keys sampled for each range: RANGE_ROWS and this bound what the driver gets.
SAMPLE = 16
#: A range is overfull at this many times its due.
OVERFULL = 3.0

Key = tuple[int, int, int]


def position(key: Column, splitters: list[Key]) -> Column:
    """How many splitters are <= key, by binary search in a literal array."""
    if not splitters:
        return F.lit(0)
    values, n = F.expr("array(" + ",".join("struct({}L,{}L,{}L)".format(*s) for s in splitters) + ")"), len(splitters)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    # beyond the last splitter get() is null, and so no step
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step - 1) <= key, at + step).otherwise(at))


def quantiles(keys: list[tuple[Key, int]], parts: int) -> set[Key]:
    """The keys at which `parts` equal shares of the drawn keys (with how often they count) begin."""
    n, out, at = sum(times for _, times in keys), set(), 0
    for key, times in sorted(keys):
        before, at = at, at + times
        if before * parts // max(1, n) != at * parts // max(1, n):
            out.add(key)
    return out


def divide(df: DataFrame, range_of: str, keys: list[str], weight: str, wanted: dict[int, tuple[int, int]], sample: int, attempt: int) -> set[Key]:
    """Splitters that divide the ranges of `wanted`, (its weight, its parts) by range, drawn in one job. A key is drawn with
    a chance in proportion to its weight; one heavier than the spacing of the sample counts as often as it would be."""
    rows = [{"r": r, "scale": sample * parts / max(1, total)} for r, (total, parts) in wanted.items()]
    own = df.join(F.broadcast(small_table(df.sparkSession, rows, "r int, scale double")), F.col(range_of) == F.col("r"))
    due = F.col(weight) * F.col("scale")
    draw = F.pmod(F.xxhash64(*keys, F.lit(attempt)), F.lit(1 << 40)) / float(1 << 40)
    drawn = own.where(draw < due).select("r", *keys, F.greatest(F.lit(1), F.floor(due)).cast("int").alias("n")).collect()
    by: dict[int, list] = {}
    for r, a, b, c, n in drawn:
        by.setdefault(r, []).append(((a, b, c), n))
    return set().union(*[quantiles(found, wanted[r][1]) for r, found in by.items()])


def shard(df: DataFrame, shards: int, size: str, group: str) -> DataFrame:
    """df's columns, shard int and slot long (replacing columns of these names): df cut into `shards` runs of near equal total size.

    Records are ordered by the hash of `group` (so equal groups lie together and share a shard unless a boundary falls
    among them), then by the hash of the row, then by a number of the row: only rows that agree in all columns exchange
    places when the input is split differently. shard = floor(size before the record * shards / all sizes), so shards
    differ by less than the largest record. Slots count up from 0 within each shard. Sizes must not be negative; null
    counts as 0, and where all sizes are 0 every row goes to shard 0. Null groups hash alike. df should be thin: it is
    written to the shared folder once, which also makes the row numbers stable. Empty input, empty output.
    """
    df = without(df, "shard", "slot")
    h, o, r, z, g, part, put = unused(df, "_h", "_o", "_r", "_z", "_g", "_part", "_put")
    keys = [h, o, r]
    made = {h: F.xxhash64(col(group)), o: row_hash(df), r: F.monotonically_increasing_id(), z: F.coalesce(col(size).cast("long"), F.lit(0))}
    base = cut(df.withColumns(made)).withColumn(g, F.col(z) + 1)
    rows, weight = base.agg(F.count("*"), F.sum(g)).first()
    if not rows:
        return base.select(*[col(c) for c in df.columns], F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = max(1, min(MOST_RANGES, math.ceil(rows / RANGE_ROWS)), min(64, rows // 64))
    due = weight / parts
    splitters = divide(base.withColumn(part, F.lit(0)), part, keys, g, {0: (weight, parts)}, SAMPLE, 0) if parts > 1 else set()
    attempt, sample = 0, SAMPLE
    while True:
        placed = base.withColumn(part, position(F.struct(*keys), sorted(splitters)))
        totals = placed.groupBy(part).agg(F.sum(z).alias("bytes"), F.count("*").alias("rows"), F.max(z).alias("most")).orderBy(part).collect()
        # keys are unique, so that a range of several rows can be divided
        over = {t[0]: (t["bytes"] + t["rows"], 2 + int((t["bytes"] + t["rows"]) / due)) for t in totals if t["bytes"] + t["rows"] > OVERFULL * due + t["most"] + 1 and t["rows"] > 1}
        if not over:
            break
        attempt += 1
        more = divide(placed, part, keys, g, over, sample, attempt)
        sample *= 1 if more - splitters else 4  # at last every key of a range is drawn
        splitters |= more
    whole, before, rank = sum(t["bytes"] for t in totals), {}, {}
    at = n = 0
    for t in totals:  # one row a range
        before[t[0]], rank[t[0]] = at, n
        at, n = at + t["bytes"], n + t["rows"]
    size_of = len(splitters) + 1
    firsts = F.expr("array(" + ",".join(f"{before.get(i, 0)}L" for i in range(size_of)) + ")")
    ranks = F.expr("array(" + ",".join(f"{rank.get(i, 0)}L" for i in range(size_of)) + ")")
    over_ = f"over (partition by {part} order by {h}, {o}, {r} rows between unbounded preceding and current row)"
    cum, no = unused(placed, "_cum", "_no")
    run = placed.withColumns({cum: F.expr(f"sum({z}) {over_}"), no: F.expr(f"row_number() {over_}")})
    run = run.withColumn(cum, F.col(cum) - F.col(z) + F.get(firsts, F.col(part))).withColumn(no, F.col(no) - 1 + F.get(ranks, F.col(part)))
    number = F.least(F.lit(shards - 1), F.floor(F.col(cum).cast("decimal(38,0)") * shards / F.lit(max(1, whole)).cast("decimal(38,0)"))).cast("int")
    run = run.withColumn(put, number)
    starts = {s: f for s, f in ((x[0], x[1]) for x in run.groupBy(put).agg(F.min(no)).collect())}  # one row a shard
    begin = F.expr("array(" + ",".join(f"{starts.get(i, 0)}L" for i in range(shards)) + ")")
    return run.select(*[col(c) for c in df.columns], F.col(put).alias("shard"), (F.col(no) - F.get(begin, F.col(put))).alias("slot"))


def op6(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Law `bytes`: near equal sizes. Equal texts lie together, next to each other and in one shard unless a boundary falls
    among them (a group may be larger than a shard). Null texts have no bytes and lie together."""
    raw = F.col("text").cast("binary")
    thin = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    put = shard(thin, shards, "size", "text_hash")
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
