"""Entity resolution: normalise, match exactly, by spelling and by meaning, cluster, gate and merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import normalize_name, slug
from ..plans.lineage import cut
from .basics import top_k
from .graph import connected_components
from .search import nearest


def alias_table(catalog: DataFrame) -> DataFrame:
    """(key, id): lower-case trimmed names and aliases of a catalogue (id, name, aliases); the least id where two share one."""
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = catalog.select("id", F.explode(names).alias("n")).select(F.lower(F.trim("n")).alias("key"), "id").where("key <> ''")
    return rows.groupBy("key").agg(F.min("id").alias("id"))


def exact(mentions: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """mentions with the id whose name or alias equals theirs, null without one."""
    return mentions.withColumn("_key", F.lower(F.trim(name))).join(aliases.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def unmatched(mentions: DataFrame, aliases: DataFrame, k: int = 10, name: str = "name") -> DataFrame:
    """The k most frequent names without an id."""
    rest = exact(mentions, aliases, name).where(F.col("id").isNull())
    return rest.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def normalized_mentions(mentions: DataFrame) -> DataFrame:
    """One row a normalised name: its commonest original (ties by name), counts, roles, documents and mean strength."""
    df = mentions.withColumn("normalized", normalize_name(F.col("name"))).where("normalized <> ''")
    per = df.groupBy("normalized", "name").agg(F.count("*").alias("c"))
    best = per.groupBy("normalized").agg(F.min_by("name", F.struct(-F.col("c"), F.col("name"))).alias("original"))
    agg = df.groupBy("normalized").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg("strength"), 6).alias("avg_strength"))
    return agg.join(best, "normalized")


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (|a| + |b|), by bits of one word a character of b."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        x = row & masks.get(ch, 0)
        row = (row + x | row - x) & full
    return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """indel_ratio of two strings, in Arrow batches."""
    return F.pandas_udf(_ratios, "double")(a, b)


def grams(name: Column, n: int = 2) -> Column:
    """The distinct n-grams of a padded name, the blocks in which similar names meet."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(name)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), lambda i: F.substr(padded, i, F.lit(n))))


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r, shared) for names of left (l) and right (r) with close lengths and letters that share one of their rarest
    bigrams; where both have a column `c`, only those that differ in it.

    Let names of a and b letters have L in common, in order. A ratio of t needs a + b <= 2L / t, so x = a - L deletions and
    y = b - L insertions add up to 2L (1 - t) / t at most. Of the a + 1 bigrams of the padded name, a deletion breaks two and
    an insertion one, so at most 2x + y <= 4a (1 - t) / t are not in the other name, and names share one among so many and
    one more of the rarest of each, which keeps frequent bigrams out of the join. At least L + 1 - (x + y) are shared, which
    is positive for t >= 2/3: from there on, no pair is lost. Letters tell of pairs that need more than x + y edits.
    """
    a = left.select(F.col("l").alias("name"), F.explode(grams(F.col("l"))).alias("g"))
    b = right.select(F.col("r").alias("name"), F.explode(grams(F.col("r"))).alias("g"))
    often = a.unionByName(b).groupBy("g").agg(F.count("*").alias("often"))
    own = ["c"] if "c" in left.columns and "c" in right.columns else []

    def rarest(names: DataFrame, rows: DataFrame, side: str) -> DataFrame:
        most = F.floor(4 * F.length("name") * ((1 - threshold) / threshold) + 1e-9).cast("int") + 1
        listed = names.join(often, "g").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("often", "g"))).alias("gs"))
        listed = listed.select(F.col("name").alias(side), F.explode(F.slice("gs", F.lit(1), most)).alias("x")).select(side, "x.g")
        found = counted(rows.select(side, *own).distinct(), side)
        return listed.join(found.select(side, *[F.col(x).alias(f"{x}{side}") for x in ("_n", *COUNTS, *own)]), side)

    x, y = (tuple(f"{c}{side}" for c in COUNTS) for side in "lr")
    meet = apart_at_least(x, y) <= edits(F.col("_nl"), F.col("_nr"), threshold)
    for c in own:
        meet = (F.col(f"{c}l") != F.col(f"{c}r")) & meet
    close = 2 * F.least("_nl", "_nr") >= threshold * (F.col("_nl") + F.col("_nr"))
    return rarest(a, left, "l").join(rarest(b, right, "r"), "g").where(close & meet).groupBy("l", "r").agg(F.count("*").alias("shared"))


def shortened(name: Column, most: int = 1) -> Column:
    """The texts that one (two, where `most` is 2) letters less at most make of a name, some repeated. Names of over 256 letters
    only give themselves, those of over 64 lose one letter at most: these texts find links early, but are never relied on."""
    n = F.length(name)
    less = lambda i, j: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1, j - i - 1), F.substr(name, j + 1, n))
    none = F.array().cast("array<string>")
    one = F.when((n > 0) & (n <= 256), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1, n)))).otherwise(none)
    two = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.transform(F.sequence(i + 1, F.greatest(n, i + 1)), lambda j: less(i, j)))
    both = F.when((n > 1) & (n <= 64), F.flatten(two)).otherwise(none) if most >= 2 else none
    return F.concat(F.array(name), one, both)


def spread(df: DataFrame) -> DataFrame:
    """df in a partition a core, for small tables of which each row makes much work."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


#: Kinds of letters that are counted apart, all in lower case ASCII but a few signs, and up to which number.
KINDS, MOST = 64, 4
#: A name's counts in bits: `MOST` a kind, as many of them set as there are letters of the kind.
COUNTS = tuple(f"_c{i}" for i in range(KINDS * MOST // 64))


def _counts(names: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in names:
        texts = part.fillna("").tolist()
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        rows = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        kinds = (codes & 31) + (codes >> 6 & 1) * 32
        many = np.bincount(rows * KINDS + kinds, minlength=len(texts) * KINDS).reshape(-1, KINDS, 1)
        bits = np.packbits((many > np.arange(MOST)).reshape(len(texts), -1), axis=1)
        yield pd.DataFrame(bits.view(np.int64).reshape(len(texts), -1), columns=list(COUNTS))


def counted(df: DataFrame, name: str) -> DataFrame:
    """df with _n, the length of a name's column, and its letters' `COUNTS`."""
    found = F.pandas_udf(_counts, ", ".join(f"{c} long" for c in COUNTS))(F.col(name))
    return df.withColumn("_x", found).select(*df.columns, F.length(name).alias("_n"), "_x.*")


def apart_at_least(here: tuple[str, ...], there: tuple[str, ...]) -> Column:
    """Letters that have to be put in or taken at least, by columns of `COUNTS`."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(here, there, strict=True)), F.lit(0))


def edits(a: Column, b: Column, threshold: float) -> Column:
    """How many letters can be put in or taken between names of a and b letters at or above the threshold: they have
    L >= t (a + b) / 2 in common, so a + b - 2L at most."""
    return F.floor((a + b) * (1 - threshold) + 1e-9).cast("int")


def within_reach(left: DataFrame, right: DataFrame, threshold: float, apart: str | None = None) -> DataFrame:
    """The rows of left (l) for which right (r) may hold a name at or above the threshold; `apart`: of another value there.

    Names of a and b letters have 2 (1 - t) / t * L edits at most, and L <= least(a, b); counts of kinds of letters differ by
    one an edit at most. Equal counts are compared once, and meet by length. No such row is missed.
    """
    own = [apart] if apart else []
    cells = cut(counted(spread(left.select("l", *own)), "l"))
    keys = ["_n", *COUNTS, *own]
    there = counted(spread(right.select("r", *own)), "r").select(*[F.col(c).alias(f"{c}_") for c in keys]).distinct()
    reach = F.floor(2 * F.col("_n") * ((1 - threshold) / threshold) + 1e-9).cast("int")
    lengths = F.sequence(F.greatest(F.lit(0), F.col("_n") - reach), F.col("_n") + reach)
    here = cells.select(*keys).distinct().withColumn("_m", F.explode(lengths))
    here = here.where(F.abs(F.col("_n") - F.col("_m")) <= edits(F.col("_n"), F.col("_m"), threshold))
    meet = F.col("_m") == F.col("_n_")
    if apart:
        meet = meet & (F.col(apart) != F.col(f"{apart}_"))
    meet = meet & (apart_at_least(COUNTS, tuple(f"{c}_" for c in COUNTS)) <= edits(F.col("_n"), F.col("_n_"), threshold))
    found = here.join(there, meet, "left_semi").select(*keys).distinct()
    return cells.join(found, keys, "left_semi").select("l", *own)


def fuzzy(mentions: DataFrame, catalog_names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(name, id, score): the best spelling match of each distinct name at or above the threshold.

    Names that are equal after a letter less at most on each side meet first. All other pairs have an a of n letters and at
    least two edits on one side, so they score 2n / (2n + 2) at most; only names without a better match go on to
    candidate_pairs, with those of either side that letters let come near.
    """
    left = mentions.select(F.lower(F.trim("name")).alias("l")).distinct()
    right = catalog_names.select(F.col("key").alias("r"), "id")
    keys = right.select("r").distinct()

    def scored(pairs: DataFrame) -> DataFrame:
        rated = pairs.withColumn("score", F.round(ratio(F.col("l"), F.col("r")), 6)).where(F.col("score") >= threshold)
        return top_k(rated.join(right, "r"), ["l"], [F.desc("score"), F.col("id")], 1).select("l", "id", "score")

    pieces = spread(left).select("l", F.explode(shortened(F.col("l"))).alias("k")), spread(keys).select("r", F.explode(shortened(F.col("r"))).alias("k"))
    first = cut(scored(pieces[0].join(pieces[1], "k").select("l", "r").distinct()))
    sure = first.where(F.col("score") > 2 * F.length("l") / (2 * F.length("l") + 2) + 1e-5)
    rest = cut(within_reach(left.join(sure, "l", "left_anti"), keys, threshold))
    near = within_reach(keys.select(F.col("r").alias("l")), rest.select(F.col("l").alias("r")), threshold)
    more = scored(candidate_pairs(rest, near.select(F.col("l").alias("r")), threshold).select("l", "r"))
    return top_k(first.unionByName(more), ["l"], [F.desc("score"), F.col("id")], 1).select(F.col("l").alias("name"), "id", "score")


def cascade(mentions: DataFrame, catalog: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(name, id, score, method): exact, then spelling, then none, for distinct names."""
    aliases = alias_table(catalog)
    names = mentions.select("name").distinct()
    first = exact(names, aliases)
    near = fuzzy(first.where(F.col("id").isNull()).select("name"), aliases, threshold).select(F.col("name").alias("k"), F.col("id").alias("fid"), F.col("score").alias("fs"))
    out = first.join(near, F.lower(F.trim("name")) == F.col("k"), "left")
    method = F.when(F.col("id").isNotNull(), "exact").when(F.col("fid").isNotNull(), "fuzzy").otherwise("none")
    return out.select("name", F.coalesce("id", "fid").alias("id"), F.when(F.col("id").isNotNull(), 1.0).otherwise(F.coalesce("fs", F.lit(0.0))).alias("score"), method.alias("method"))


def clusters(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, cluster): names (id, name) linked by spelling, by connected components; unlinked names are their own.

    A text of k letters that is left of several names when one letter, then two, are taken from them links them all, if k is
    at least threshold times each one's length. Only names that letters let come near one of another component are compared
    then, and only with such, so links inside of a component cost no comparison and no link between components is lost.
    """
    low = names.select("id", F.lower(F.trim("name")).alias("k"))
    ids = cut(low.groupBy("k").agg(F.min("id").alias("src")))  # equal names: one node
    placed = ids.where(F.col("k").isNotNull()).withColumn("c", F.col("src"))

    def joined(edges: DataFrame) -> DataFrame:
        comp = connected_components(edges).select(F.col("id").alias("c"), "component")
        return cut(placed.join(comp, "c", "left").select("k", "src", F.coalesce("component", "c").alias("c")))

    for most in (1, 2):
        texts = spread(placed).select("c", F.length("k").alias("n"), F.explode(shortened(F.col("k"), most)).alias("t"))
        meet = texts.where(F.length("t") >= threshold * F.col("n")).groupBy("t").agg(F.collect_set("c").alias("cs")).where(F.size("cs") > 1)
        placed = joined(meet.select(F.array_min("cs").alias("src"), F.explode("cs").alias("dst")).where("src <> dst").distinct())
    open_ = cut(within_reach(placed.select(F.col("k").alias("l"), "c"), placed.select(F.col("k").alias("r"), "c"), threshold, "c"))
    pairs = candidate_pairs(open_, open_.select(F.col("l").alias("r"), "c"), threshold).where("l < r")
    pairs = pairs.join(open_.select("l", F.col("c").alias("src")), "l").join(open_.select(F.col("l").alias("r"), F.col("c").alias("dst")), "r").where("src <> dst")
    linked = pairs.withColumn("s", ratio(F.col("l"), F.col("r"))).where(F.col("s") >= threshold)
    placed = joined(linked.select("src", "dst").distinct())
    return low.join(ids, "k").join(placed.select("src", "c"), "src", "left").select("id", F.coalesce("c", "src").alias("cluster"))


#: Domains that count as related, either way round.
RELATED = (("Energy Storage", "Propulsion"), ("Avionics", "Safety"), ("Airframe", "Manufacturing"), ("Infrastructure", "Avionics"))


def domains_agree(a: Column, b: Column) -> Column:
    pairs = F.lit(False)
    for x, y in RELATED:
        pairs = pairs | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return (a == b) | (a == "Unknown") | (b == "Unknown") | pairs


def variant_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.greatest(F.size(a), F.size(b)).cast("double")), F.lit(0.0))


def merge_decision(similarity: Column, domain_ok: Column, overlap: Column) -> Column:
    """auto_merge where the score is .75 or more and both gates hold, else review; below .75, reject."""
    return F.when(similarity < 0.75, "reject").when(domain_ok & (overlap >= 0.3), "auto_merge").otherwise("review")


def high_confidence(similarity: Column, failed_gates: Column) -> Column:
    return (similarity >= 0.85) | ((similarity >= 0.80) & (failed_gates <= 1))


def merged(members: DataFrame) -> DataFrame:
    """One row a cluster: the primary name (of the catalogue first, then more variants, then by name), the union of
    variants, the sum of occurrences."""
    first = F.struct((~F.col("in_catalog")).alias("a"), (-F.size("variants")).alias("b"), F.col("name").alias("c"))
    return members.groupBy("cluster").agg(F.min_by("name", first).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("variants"), F.sum("occurrences").alias("occurrences")).withColumn("tech_id", slug(F.col("name")))


def catalog_report(catalog: DataFrame, mentions: int) -> DataFrame:
    """One row: names, duplicates, variants of several names, coverage of mentions, and whether all is well."""
    dup = catalog.groupBy("name").count().where("count > 1").agg(F.count("*").alias("duplicate_names"))
    var = catalog.select("name", F.explode("variants").alias("v")).groupBy("v").agg(F.countDistinct("name").alias("n")).where("n > 1").agg(F.count("*").alias("ambiguous_variants"))
    tot = catalog.agg(F.count("*").alias("names"), F.sum("occurrences").alias("covered"))
    out = tot.crossJoin(dup).crossJoin(var).withColumn("coverage", F.round(F.col("covered") / F.lit(float(mentions)) * 100, 4))  # three single rows
    return out.withColumn("passed", (F.col("duplicate_names") == 0) & (F.col("ambiguous_variants") == 0) & (F.col("coverage") >= 95))


def ticker_of(name: Column, aliases: Column) -> Column:
    """A trailing (XXX) of five letters at most, else the first all-caps alias of one to five."""
    inside = F.regexp_extract(name, r"\(([^()]{1,5})\)[^(]*$", 1)
    alias = F.get(F.filter(aliases, lambda a: (F.upper(a) == a) & F.length(a).between(1, 5)), 0)
    return F.coalesce(F.nullif(inside, F.lit("")), alias)


def semantic(queries: DataFrame, catalog: DataFrame, threshold: float = 0.75, k: int = 3) -> DataFrame:
    """The k most similar catalogue vectors (id, v) of each query (qid, qv), at or above the threshold, with a level of
    confidence."""
    scored = nearest(queries, catalog, k, threshold)
    level = F.when(F.col("score") >= 0.9, "high").when(F.col("score") >= 0.75, "medium").otherwise("low")
    return top_k(scored, ["qid"], [F.desc("score"), F.col("id")], k).withColumn("confidence", level)


def annotate(docs: DataFrame, matches: DataFrame, names: str = "names") -> DataFrame:
    """docs whose array of names is rewritten by matches (name, canonical); unmatched names are kept, order too."""
    rows = docs.select("doc_id", F.posexplode_outer(names).alias("i", "name")).join(matches, "name", "left")
    back = rows.where(F.col("i").isNotNull()).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("canonical", "name").alias("n")))), lambda s: s["n"]).alias("_new"))
    return docs.join(back, "doc_id", "left").withColumn(names, F.coalesce("_new", names)).drop("_new")


#: Names that stand for no company.
PLACEHOLDERS = (
    "Another Retail Company", "Another Customer", "Another Supplier", "Certain Customers", "Certain Suppliers", "Major Customers",
    "Major Suppliers", "Various Customers", "Other Companies", "Third Party", "Unnamed Entity",
)


def without_placeholders(names: Column) -> Column:
    return F.filter(names, lambda n: ~n.isin(list(PLACEHOLDERS)))
