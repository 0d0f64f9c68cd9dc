"""Control of runs: batches with checkpoints, configuration, retries, evidence records, coverage checks, UI forms."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .diagnostics import status
from .scoring import PHASES

# batches


def index_range(df: DataFrame, order: Sequence[str], start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows start .. start + limit - 1 in the given order, with their index long. Rows are numbered by ranges of the order,
    so that no task sorts them all."""
    from pyspark.sql import Window

    from ..plans.lineage import cut

    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, at = [F.lit(-1), F.lit(0).cast("long")], 0
    for part, n in sorted(tuple(r) for r in parts.groupBy("_part").count().collect()):  # one row a partition
        before += [F.lit(part), F.lit(at).cast("long")]
        at += n
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.element_at(F.create_map(*before), F.col("_part"))
    out = parts.withColumn("index", place.cast("long")).drop("_part").where(F.col("index") >= start)
    return out.where(F.col("index") < start + limit) if limit is not None else out


def parse_batch(df: DataFrame, parse: Callable, schema: str) -> DataFrame:
    """Rows through parse(row as a dict) -> dict or None, in Arrow batches; a row whose parse fails gives `error` instead of
    stopping the others. schema: the fields that parse returns, besides index and error."""
    import pandas as pd

    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    made = parse(row) or {}
                    out.append((row["index"], *[made.get(n) for n in names], None))
                except Exception as e:  # noqa: BLE001 - whatever a parser raises belongs to its row
                    out.append((row["index"], *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["index", *names, "error"])

    return df.mapInPandas(run, f"index long, {schema}, error string")


def resume(df: DataFrame, done: DataFrame | None) -> DataFrame:
    """Rows whose index no checkpoint has marked."""
    return df if done is None else df.join(done.select("index").distinct(), "index", "left_anti")


def run_batches(df: DataFrame, parse: Callable, schema: str, path: str, quality: float = 0.85) -> DataFrame:
    """Parses what <path>/all has not got yet and appends it there, rows of at least `quality` also to <path>/relevant; gives
    all results so far. A run that stops half-way goes on from the indices that were written."""
    spark = df.sparkSession
    full = f"index long, {schema}, error string"
    done = read_if_there(spark, f"{path}/all", full)
    made = parse_batch(resume(df, done), parse, schema)
    made.write.mode("append").parquet(f"{path}/all")
    every = spark.read.schema(full).parquet(f"{path}/all")
    if "quality_score" in every.columns:
        every.where(F.coalesce("quality_score", F.lit(0.0)) >= quality).write.mode("overwrite").parquet(f"{path}/relevant")
    return every


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def by_priority(sources: dict[str, dict]) -> list[str]:
    """The names of sources by their priority (999 without one), ties as given."""
    return sorted(sources, key=lambda s: sources[s].get("priority", 999))


def run_sources(sources: dict[str, Callable[[], DataFrame]], order: Iterable[str]) -> tuple[dict[str, DataFrame], list[dict]]:
    """Each source's frame, and a report (source, success, error): a source that fails does not stop the others."""
    frames, report = {}, []
    for name in order:
        try:
            frames[name] = sources[name]()
            report.append({"source": name, "success": frames[name].count(), "error": None})
        except Exception as e:  # noqa: BLE001 - the failure of one source is its report
            report.append({"source": name, "success": 0, "error": str(e)})
    return frames, report


def source_totals(report: DataFrame) -> DataFrame:
    """Per source: documents, failures, and the percentage that succeeded; a last row for all."""
    rate = F.when(F.sum("ok") + F.sum("failed") > 0, F.round(F.sum("ok") * 100.0 / (F.sum("ok") + F.sum("failed")), 4)).otherwise(0.0)
    return report.rollup("source").agg(F.sum("ok").alias("ok"), F.sum("failed").alias("failed"), rate.alias("rate")).withColumn("source", F.coalesce("source", F.lit("all")))


def created(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """One row: how many nodes a merge would create; keys that are there count 0."""
    return changes.select(key).distinct().join(current.select(key), key, "left_anti").agg(F.count("*").alias("created"))


def in_chunks(rows: DataFrame, key: str, size: int = 100) -> DataFrame:
    """rows with the chunk int of about `size` rows that a transaction would take, by the hash of the key."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def write_layout(df: DataFrame, path: str, keys: Sequence[str], files: int = 8) -> None:
    """Where a store has an index on keys: rows in ranges of the keys and sorted by them, whose statistics let scans skip."""
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def detach(nodes: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label) without a label's, and edges (src, dst) without those at them."""
    gone = nodes.where(F.col("label") == label).select(F.col("id").alias("_g"))
    left = edges.join(gone, F.col("src") == F.col("_g"), "left_anti").join(gone, F.col("dst") == F.col("_g"), "left_anti")
    return nodes.where(F.coalesce(F.col("label") != label, F.lit(True))), left


def community_nodes(members: DataFrame, version: int, algorithm: str, resolution: float, k: int = 5) -> DataFrame:
    """Community nodes of one version, from members (community, kind, name, doc_type, weight): id v<version>_<community>,
    counts, the k heaviest technologies and companies, and the distribution of document types as a map and as JSON."""
    from .basics import top_k

    kind = F.col("kind")
    own = members.groupBy("community").agg(
        F.count("*").alias("member_count"), F.count_if(kind == "technology").alias("tech_count"), F.count_if(kind == "company").alias("company_count"), F.count_if(kind == "document").alias("doc_count"),
    )
    first = top_k(members.where(kind.isin("technology", "company")), ["community", "kind"], [F.desc("weight"), F.col("name")], k)
    heads = lambda x, out: F.transform(F.array_sort(F.collect_list(F.when(kind == x, F.struct("rank", "name")))), lambda s: s["name"]).alias(out)
    named = first.groupBy("community").agg(heads("technology", "top_technologies"), heads("company", "top_companies"))
    types = members.where(kind == "document").groupBy("community", "doc_type").agg(F.count("*").alias("n"))
    spread = types.groupBy("community").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_type", "n")))).alias("doc_types"))
    out = own.join(named, "community", "left").join(spread, "community", "left")
    key = F.concat(F.lit(f"v{version}_"), F.col("community").cast("string"))
    fixed = [F.lit(version).alias("version"), F.lit(algorithm).alias("algorithm"), F.lit(resolution).alias("resolution")]
    return out.select(key.alias("id"), *fixed, "*", F.coalesce(F.to_json("doc_types"), F.lit("{}")).alias("doc_type_distribution"))


# configuration


def config_errors(config: object, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a configuration under a schema of types, required keys, properties, items, enums and bounds."""
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
    out: list[str] = []
    wanted = schema.get("type")
    wanted = [wanted] if isinstance(wanted, str) else wanted or []
    if wanted and not any(isinstance(config, kinds[k]) and (k == "boolean" or not isinstance(config, bool)) for k in wanted):
        return [f"{at}: not {' or '.join(wanted)}"]
    if "enum" in schema and config not in schema["enum"]:
        out.append(f"{at}: not one of {schema['enum']}")
    for word, wrong in (("minimum", lambda x, b: x < b), ("maximum", lambda x, b: x > b)):
        if word in schema and isinstance(config, (int, float)) and wrong(config, schema[word]):
            out.append(f"{at}: beyond the {word} {schema[word]}")
    if isinstance(config, dict):
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in config]
        for k, v in config.items():
            if k in schema.get("properties", {}):
                out += config_errors(v, schema["properties"][k], f"{at}.{k}")
    if isinstance(config, list):
        out += [f"{at}: fewer than {schema['minItems']}"] if len(config) < schema.get("minItems", 0) else []
        for i, v in enumerate(config):
            out += config_errors(v, schema.get("items", {}), f"{at}[{i}]")
    return out


def all_keywords(groups: Column) -> Column:
    """The distinct keywords of a map of groups, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.map_values(groups))))


def all_companies(groups: Sequence[Column]) -> Column:
    """One map of several; where a key is in more than one, the last counts."""
    entries = F.concat(*[F.map_entries(g) for g in groups])
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


#: How many days back each layer looks.
DAYS_BACK = {"innovation": 730, "adoption": 540, "narrative": 180, "risk": 180}


def date_range(layer: str, as_of: str) -> tuple[str, str]:
    """[start, end) of a layer's window that ends on as_of."""
    import datetime

    if layer not in DAYS_BACK:
        raise ValueError(f"no layer {layer}; there are {', '.join(DAYS_BACK)}")
    end = datetime.date.fromisoformat(as_of)
    return str(end - datetime.timedelta(days=DAYS_BACK[layer])), as_of


# runs


def run_pipeline(config: dict, schema: dict, make: Callable[[dict], DataFrame], finish: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], None], tell: Callable[[dict], None]) -> DataFrame | None:
    """Checks the configuration, makes a chart, normalises and saves it, and tells each step; a failure is told, not raised."""
    try:
        tell({"type": "pipeline_start"})
        wrong = config_errors(config, schema)
        if wrong:
            raise ValueError("; ".join(wrong))
        done = finish(make(config))
        save(done)
        tell({"type": "pipeline_complete", "technologies": done.count()})
        return done
    except Exception as e:  # noqa: BLE001 - the caller learns of it from the event
        tell({"type": "pipeline_error", "error": str(e)})
        return None


def latest_chart(history: DataFrame) -> DataFrame:
    """The rows of the run with the last name; none without a run."""
    last = history.agg(F.max("run_id").alias("_last"))  # one row
    return history.join(F.broadcast(last), F.col("run_id") == F.col("_last"), "left_semi")


def evidence_record(df: DataFrame, metrics: dict[str, Sequence[str]]) -> DataFrame:
    """(tech_id, evidence): one nested record of each technology, a part for each layer with its metrics and reasoning, and
    parts for hype and phase."""
    parts = []
    for layer, columns in metrics.items():
        inner = F.struct(*[F.col(c) for c in columns]).alias("metrics")
        parts.append(F.struct(inner, F.coalesce(F.col(f"{layer}_reasoning"), F.lit("")).alias("reasoning")).alias(f"{layer}_evidence"))
    hype = F.struct(F.coalesce("hype", F.lit(0.0)).alias("score"), F.coalesce("divergence", F.lit(0.0)).alias("divergence")).alias("hype_analysis")
    phase = F.struct(F.coalesce("phase", F.lit("unknown")).alias("phase")).alias("phase_analysis")
    return df.select("tech_id", F.struct(*parts, hype, phase).alias("evidence"))


def summary_text(name: Column, phase: Column, innovation: Column, adoption: Column, narrative: Column, risk: Column) -> Column:
    """A plain sentence about a technology, in place of a written analysis."""
    return F.format_string("%s: %s (innovation %.2f, adoption %.2f, narrative %.2f, risk %.2f)", name, phase, innovation, adoption, narrative, risk)


# coverage


def community_coverage(nodes: DataFrame, versions: Sequence[str]) -> DataFrame:
    """(version, communities, nodes, pct, status) of each version's column, in one pass: PARTIAL where a version is there
    but covers too little, FAIL where it is not."""
    agg = nodes.agg(F.count("*").alias("n"), *[x for v in versions for x in (F.count(v).alias(f"{v}_n"), F.count_distinct(v).alias(f"{v}_c"))])
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"{v}_c").alias("communities"), F.col(f"{v}_n").alias("nodes")) for v in versions]))
    out = agg.select("n", rows.alias("x")).select("x.*", F.round(F.try_divide(F.col("x.nodes") * 100.0, F.col("n")), 4).alias("pct"))
    low = F.when(F.col("communities") > 0, "PARTIAL").otherwise("FAIL")
    return out.withColumn("status", F.when(F.coalesce("pct", F.lit(0.0)) >= 80, status(F.col("pct"))).otherwise(low))


def summary_coverage(communities: DataFrame, versions: Sequence[int]) -> DataFrame:
    """(version, communities, with_summary, pct, status): distinct communities of each version and those with a summary."""
    known = communities.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in versions])).alias("version"))
    some = F.coalesce("summary", F.lit("")) != ""
    per = communities.groupBy("version").agg(F.count_distinct("id").alias("communities"), F.count_distinct(F.when(some, F.col("id"))).alias("with_summary"))
    out = known.join(per, "version", "left").fillna(0, ["communities", "with_summary"])
    pct = F.round(F.try_divide(F.col("with_summary") * 100.0, F.col("communities")), 4)
    return out.withColumn("pct", pct).withColumn("status", F.when(F.col("communities") > 0, "PASS").otherwise("FAIL"))


def metric_coverage(nodes: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, nodes, pct, status) of node columns, in one pass."""
    agg = nodes.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in metrics])
    long = agg.unpivot(["n"], list(metrics), "metric", "nodes")
    return long.select("metric", "nodes", F.round(F.try_divide(F.col("nodes") * 100.0, F.col("n")), 4).alias("pct")).withColumn("status", status(F.col("pct")))


def search_works(hits: DataFrame) -> bool:
    """Whether a search finds anything."""
    return not hits.isEmpty()


# UI forms

#: The property that says what an edge of a type means.
SEMANTIC = {"MENTIONED_IN": "role", "RELATED_COMPANY": "relation_type", "RELATED_TECH": "relation_type", "RELATED_TO_TECH": "relation_type"}


def edge_label(kind: Column, properties: Column) -> Column:
    """The value of the property that an edge's type names, else the type."""
    out = kind
    for k, name in SEMANTIC.items():
        own = F.nullif(F.try_element_at(properties, F.lit(name)), F.lit(""))
        out = F.when(kind == k, F.coalesce(own, kind)).otherwise(out)
    return out


def ui_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of records (seq, node struct<id, label, group>, kind, properties, other struct<id, label, group>):
    each node once, as it is first seen, technologies larger; an edge a record, drawn from the technology."""
    from .basics import keep_first
    from .graph import colour

    a = records.select("seq", F.lit(0).alias("side"), F.col("node.*"), F.lit(40).alias("size"))
    b = records.where("other IS NOT NULL").select("seq", F.lit(1).alias("side"), F.col("other.*"), F.lit(30).alias("size"))
    nodes = keep_first(a.unionByName(b), F.col("id").cast("string"), ["seq", "side"]).select("id", "label", "group", colour(F.col("group")).alias("color"), "size")
    some = records.where("other IS NOT NULL AND kind IS NOT NULL")
    edges = some.select(F.col("node.id").alias("from"), F.col("other.id").alias("to"), edge_label(F.col("kind"), F.col("properties")).alias("label"), F.lit("to").alias("arrows"), F.col("kind").alias("relationship_type"))
    return nodes, edges


def phase_names() -> list[str]:
    return [v[0] for v in PHASES.values()]
