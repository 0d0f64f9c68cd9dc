"""Hybrid matching of names: keyword and vector scores, similarity graphs, classification cascades, enriched documents.

Merges that depend on an order elsewhere are restated set-wise here: names that match are linked, and a component of links
becomes one entry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .basics import top_k
from .graph import connected_components
from .resolution import alias_table, candidate_pairs, exact, ratio
from .search import nearest

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Keyword and vector shares of a pair's score: in clustering mentions, and in clustering canonical names.
MENTIONS, CANONICAL = (0.4, 0.6), (0.3, 0.7)


def okapi(names: DataFrame, k: int = 20) -> DataFrame:
    """(qid, id, score): the k names (id, name) of most Okapi BM25 score for the words of each name, itself included, over the
    largest score of that name. Words that more than half of the names have get a quarter of the mean idf.

    Names meet by their words, once a pair of names and word; a word of very many names makes as many pairs as it must.
    """
    words = F.filter(F.split(F.lower(F.trim("name")), r"\s+"), lambda w: w != "")
    split = names.select("id", words.alias("t"))
    tf = split.select("id", F.size("t").alias("len"), F.explode("t").alias("w")).groupBy("id", "len", "w").agg(F.count("*").alias("tf"))
    totals = split.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_len"))  # one row
    df = tf.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals))
    df = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = df.agg((EPSILON * F.avg("idf")).alias("floor"))  # one row
    df = df.crossJoin(F.broadcast(floor)).select("w", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"), "avg_len")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    query = tf.select(F.col("id").alias("qid"), "w", F.col("tf").alias("qf")).join(df, "w")
    scored = query.join(tf, "w").groupBy("qid", "id").agg(F.round(F.sum(part), 9).alias("s"))
    most = scored.groupBy("qid").agg(F.max("s").alias("most"))
    norm = scored.join(most, "qid").select("qid", "id", F.round(F.col("s") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0), 9).alias("score"))
    return top_k(norm, ["qid"], [F.desc("score"), F.col("id")], k).drop("rank")


def similarity_graph(
    names: DataFrame, vectors: DataFrame, weights: tuple[float, float] = MENTIONS, threshold: float = 0.75, k: int = 20
) -> DataFrame:
    """(src, dst, similarity), src < dst: pairs of names whose weighted keyword and vector scores reach the threshold.

    Candidates of a name are its k best by either score, itself among them; a score that is not among the k counts 0. Where
    both names of a pair reach the threshold, the score of the smaller id's search counts. names (id, name), vectors (id, v).
    """
    words = okapi(names, k).withColumnRenamed("score", "keyword")
    near = nearest(vectors.select(F.col("id").alias("qid"), F.col("v").alias("qv")), vectors, k).withColumnRenamed("score", "meaning")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = words.join(near, ["qid", "id"], "full_outer").where("qid <> id")
    both = both.withColumn("s", F.round(weights[0] * zero("keyword") + weights[1] * zero("meaning"), 6)).where(F.col("s") >= threshold)
    pairs = both.groupBy(F.least("qid", "id").alias("src"), F.greatest("qid", "id").alias("dst"))
    return pairs.agg(F.min_by("s", "qid").alias("similarity"))


def cluster_labels(names: DataFrame, graph: DataFrame) -> DataFrame:
    """(id, cluster): components of a similarity graph; a name without an edge is its own."""
    found = connected_components(graph.select("src", "dst"))
    return names.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def cluster_records(mentions: DataFrame, labels: DataFrame, graph: DataFrame) -> DataFrame:
    """A row a cluster: members array<struct<name, occurrences>> by name, size, and the mean similarity of its edges (1
    without one), for mentions (id, name, occurrences)."""
    placed = mentions.join(labels, "id")
    members = F.array_sort(F.collect_list(F.struct("name", "occurrences"))).alias("members")
    own = placed.groupBy("cluster").agg(members, F.count("*").alias("size"), F.min_by("name", F.struct(-F.col("occurrences"), F.col("name"))).alias("canonical"))
    ends = labels.select(F.col("id").alias("src"), "cluster").join(graph, "src")
    inside = ends.join(labels.select(F.col("id").alias("dst"), F.col("cluster").alias("other")), "dst").where("cluster = other")
    mean = inside.groupBy("cluster").agg(F.avg("similarity").alias("mean"))
    return own.join(mean, "cluster", "left").select("cluster", "canonical", "members", "size", F.round(F.coalesce("mean", F.lit(1.0)), 6).alias("avg_similarity"))


def duplicates_of(new: DataFrame, catalog: DataFrame, weights: tuple[float, float] = MENTIONS, threshold: float = 0.85) -> DataFrame:
    """(id, dup, score): for each new entry (id, name, v), the catalogue entry of most weighted spelling and vector score at
    or above the threshold, ties by id. As spelling gives weights[0] at most, only entries whose cosine reaches
    (threshold - weights[0]) / weights[1] are compared, which misses none."""
    least = (threshold - weights[0]) / weights[1]
    near = nearest(new.select(F.col("id").alias("qid"), F.col("v").alias("qv")), catalog.select("id", "v"), least=least - 1e-9)
    named = near.join(new.select(F.col("id").alias("qid"), F.lower("name").alias("a")), "qid").join(catalog.select("id", F.lower("name").alias("b")), "id")
    total = F.round(weights[0] * ratio(F.col("a"), F.col("b")) + weights[1] * F.col("score"), 6)
    scored = named.select("qid", "id", total.alias("s")).where(F.col("s") >= threshold)
    best = top_k(scored, ["qid"], [F.desc("s"), F.col("id")], 1)
    return best.select(F.col("qid").alias("id"), F.col("id").alias("dup"), F.col("s").alias("score"))


def add_variants(catalog: DataFrame, matches: DataFrame) -> DataFrame:
    """catalog (id, variants array<string>) with the names of matches (id, name) that an entry lacks, sorted at its end."""
    more = matches.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("_more"))
    new = F.array_except(F.coalesce("_more", F.array().cast("array<string>")), "variants")
    return catalog.join(more, "id", "left").withColumn("variants", F.concat("variants", new)).drop("_more")


def merge_results(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """(name, variants, is_new): results (id, name, v, variants) go to their duplicates in the catalogue (id, name, v,
    variants); the others are linked where they are duplicates of each other, and each component is one new entry, named
    by its smallest id. A result's own name is not added as a variant, only its variants are."""
    found = duplicates_of(results, catalog)
    into = found.join(results.select("id", F.explode("variants").alias("name")), "id").select(F.col("dup").alias("id"), "name")
    old = add_variants(catalog.select("id", "name", "variants"), into).select("name", "variants", F.lit(False).alias("is_new"))
    fresh = results.join(found, "id", "left_anti")
    links = duplicates_pairs(fresh)
    labels = cluster_labels(fresh, links)
    made = fresh.join(labels, "id").groupBy("cluster").agg(F.min_by("name", "id").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("variants"))
    return old.unionByName(made.select("name", "variants", F.lit(True).alias("is_new")))


def duplicates_pairs(entries: DataFrame, weights: tuple[float, float] = MENTIONS, threshold: float = 0.85) -> DataFrame:
    """(src, dst, similarity): all pairs of entries (id, name, v) with a weighted score at or above the threshold."""
    least = (threshold - weights[0]) / weights[1]
    near = nearest(entries.select(F.col("id").alias("qid"), F.col("v").alias("qv")), entries.select("id", "v"), least=least - 1e-9).where("qid < id")
    named = near.join(entries.select(F.col("id").alias("qid"), F.lower("name").alias("a")), "qid").join(entries.select("id", F.lower("name").alias("b")), "id")
    total = F.round(weights[0] * ratio(F.col("a"), F.col("b")) + weights[1] * F.col("score"), 6)
    return named.select(F.col("qid").alias("src"), F.col("id").alias("dst"), total.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicates(names: DataFrame, low: float = 0.75, high: float = 0.85) -> DataFrame:
    """(name1, name2, score): pairs of distinct names, name1 < name2, whose spelling is suspiciously close."""
    keys = names.select(F.lower(F.trim("name")).alias("k")).distinct()
    pairs = candidate_pairs(keys.withColumnRenamed("k", "l"), keys.withColumnRenamed("k", "r"), low).where("l < r")
    scored = pairs.select(F.col("l").alias("name1"), F.col("r").alias("name2"), F.round(ratio(F.col("l"), F.col("r")), 6).alias("score"))
    return scored.where((F.col("score") >= low) & (F.col("score") < high))


def near_duplicate_buckets(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.when(F.col("score") >= 0.8, "0.80-0.85").otherwise("0.75-0.80").alias("bucket")).agg(F.count("*").alias("n"))


def rich_text(name: Column, domain: Column, description: Column) -> Column:
    """Name, domain and the first hundred characters of the description as one text; empty parts are left out."""
    some = lambda c, x: F.when(F.coalesce(c, F.lit("")) != "", x)
    return F.concat_ws(". ", name, some(domain, F.concat(F.lit("Domain: "), domain)), some(description, F.substring(description, 1, 100)))


def index_text(name: Column, variants: Column, description: Column) -> Column:
    some = lambda c, x: F.when(c, x)
    listed = some(F.size(variants) > 0, F.concat(F.lit("Variants: "), F.array_join(variants, ", ")))
    return F.concat_ws(" | ", name, listed, some(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("Description: "), description)))


def classify(mentions: DataFrame, catalog: DataFrame, threshold: float = 0.75, tickers: DataFrame | None = None) -> DataFrame:
    """(qid, name, id, score, method, confidence, alternatives): for each mention (qid, name, qv), the catalogue entry (id,
    name, aliases, v) by ticker (tickers: ticker, id; if given), else by exact name or alias, else by the most similar
    vector at or above the threshold, else none. alternatives: ids of the next two vectors at or above the threshold."""
    df = exact(mentions, alias_table(catalog).withColumnRenamed("id", "exact_id").withColumnRenamed("exact_id", "id"))
    df = df.withColumnRenamed("id", "exact_id")
    if tickers is not None:
        named = tickers.groupBy(F.upper("ticker").alias("_t")).agg(F.min("id").alias("ticker_id"))
        df = df.join(named, F.upper(F.trim("name")) == F.col("_t"), "left").drop("_t")
    else:
        df = df.withColumn("ticker_id", F.lit(None).cast(catalog.schema["id"].dataType))
    rest = df.where("ticker_id IS NULL AND exact_id IS NULL").select("qid", "qv")
    hits = top_k(nearest(rest, catalog.select("id", "v"), 3, threshold), ["qid"], [F.desc("score"), F.col("id")], 3)
    by = hits.groupBy(F.col("qid").alias("_q")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("_h"))
    out = df.join(by, F.col("qid") == F.col("_q"), "left")
    best = F.get("_h", 0)
    method = F.when(F.col("ticker_id").isNotNull(), "ticker").when(F.col("exact_id").isNotNull(), "exact").when(best.isNotNull(), "vector").otherwise("none")
    score = F.when(method.isin("ticker", "exact"), 1.0).when(method == "vector", best["score"]).otherwise(0.0)
    level = F.when(score >= 0.9, "high").when(score >= 0.75, "medium").otherwise("low")
    others = F.coalesce(F.transform(F.slice("_h", 2, 2), lambda h: h["id"]), F.array().cast("array<bigint>"))
    return out.select("qid", "name", F.coalesce("ticker_id", "exact_id", best["id"]).alias("id"), score.alias("score"), method.alias("method"), level.alias("confidence"), others.alias("alternatives"))


def map_back(mentions: DataFrame, classified: DataFrame, name: str = "name") -> DataFrame:
    """All mentions with what was found for their name, each distinct name having been classified once (qid is the name)."""
    found = classified.select(F.col("qid").alias("_n"), "id", "score", "method", "confidence")
    return mentions.join(found, F.col(name) == F.col("_n"), "left").drop("_n")


def normalize_documents(docs: DataFrame, arrays: dict[str, Sequence[str]], matches: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """docs with its arrays of structs annotated: for each field of `arrays` (array -> name fields), fields normalized_<f>,
    <f>_id and <f>_confidence from matches (name, canonical, id, confidence); names without a match are `unknown`.

    Each array is exploded with its places, joined, and put back in order; documents without elements keep their arrays.
    """
    found = matches.select(F.col("name").alias("_n"), F.struct("canonical", "id", "confidence").alias("_m"))
    out = docs
    for array, fields in arrays.items():
        rows = docs.select("doc_id", F.posexplode(array).alias("_i", "_e"))
        for f in fields:
            rows = rows.join(found, F.col(f"_e.{f}") == F.col("_n"), "left").drop("_n")
            e = F.col("_e").withField(f"normalized_{f}", F.coalesce("_m.canonical", F.lit(unknown))).withField(f"{f}_id", F.col("_m.id"))
            rows = rows.withColumn("_e", e.withField(f"{f}_confidence", F.coalesce("_m.confidence", F.lit("low")))).drop("_m")
        back = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_e"))), lambda s: s["_e"]).alias("_new"))
        kind = back.schema["_new"].dataType
        out = out.join(back, "doc_id", "left").withColumn(array, F.coalesce("_new", F.array().cast(kind))).drop("_new")
    return out


def entity_ids(arrays: Sequence[Column]) -> Column:
    """The distinct ids of several arrays of ids, sorted; nulls are left out."""
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array(*arrays)))))


def with_entities(docs: DataFrame, ids: str, catalog: DataFrame, out: str) -> DataFrame:
    """docs with `out`, the catalogue's rows of its ids as an array of structs sorted by id; ids without a row are left out."""
    details = F.struct(*[F.col(c) for c in catalog.columns])
    rows = docs.select("doc_id", F.explode(ids).alias("id")).join(catalog, "id")
    back = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(details)).alias(out))
    return docs.join(back, "doc_id", "left").withColumn(out, F.coalesce(out, F.array().cast(back.schema[out].dataType)))


def final_names(mentions: Column, field: str, drop: Sequence[str] = ()) -> Column:
    """Mentions with the normalised name in place of their own, without the fields of the normalisation and `drop`."""
    extra = [f"normalized_{field}", f"{field}_confidence", *drop]
    return F.transform(mentions, lambda m: m.withField(field, m[f"normalized_{field}"]).dropFields(*extra))


def match_statistics(mentions: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """One row: mentions (normalized, confidence), those matched, and the matched of each level of confidence."""
    hit = F.col("normalized").isNotNull() & (F.col("normalized") != unknown)
    level = lambda x: F.count_if(hit & (F.coalesce("confidence", F.lit("low")) == x)).alias(x)
    return mentions.agg(F.count("*").alias("total"), F.count_if(hit).alias("matched"), level("high"), level("medium"), level("low"))
