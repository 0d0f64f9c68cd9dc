"""What larger tables showed: groups of sources, files of several records, names by the thousand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypsoline import registry
from hypsoline.operators import graph, resolution

registry.load()
SF = "/root/testdata/sf0.001"


def test_sources_alike_are_worked_out_once(spark):
    """A hundred leaves to 1, ten to 1 and 2, then 1 -> 3 <- 2 and 3 -> 4; the limit counts the edges that are left."""
    rows = [(i, 1) for i in range(100, 200)] + [(i, j) for i in range(200, 210) for j in (1, 2)] + [(1, 3), (2, 3), (3, 4)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    got = {r.id: r.betweenness for r in graph.betweenness(edges, edges.select(F.col("src").alias("id")), most_edges=6).collect()}
    assert got == {1: 100 * 2 + 10.0, 2: 10.0, 3: 112.0, 4: 0.0}
    some = {r.id: r.betweenness for r in graph.betweenness(edges, spark.createDataFrame([(100,), (150,), (205,), (999,)], "id long")).collect()}
    assert some == {1: 5.0, 2: 1.0, 3: 3.0, 4: 0.0}


def test_edges_reach_the_driver_packed(spark):
    rows = [(i % 7, i) for i in range(50)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        nodes, many, near = graph.packed(spark.createDataFrame(rows, "src int, dst int"), 50)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert near.dtype == np.int32 and sorted(zip(np.repeat(nodes, many).tolist(), near.tolist())) == sorted(rows)
    assert len(near) == 50 and (np.diff(np.repeat(nodes, many)) >= 0).all()


def brandes(ids, pairs):
    """{node: sum} for the nodes that a source among ids reaches."""
    out, want = {}, {}
    for a, b in {p for p in pairs if p[0] != p[1]}:
        out.setdefault(a, []).append(b)
    for s in ids:
        before, paths, dist, queue = {s: []}, {s: 1}, {s: 0}, [s]
        for v in queue:
            for w in out.get(v, ()):
                if w not in dist:
                    dist[w], paths[w], before[w] = dist[v] + 1, 0, []
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(queue, 0.0)
        for w in queue[:0:-1]:
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            want[w] = want.get(w, 0.0) + share[w]
    return want


def test_betweenness_sends_no_edges_to_the_driver(spark, monkeypatch):
    """Copies of a graph with two sides, a hub, a long path and a random graph; the driver gets neither edges nor sends them."""
    rnd = random.Random(3)
    pairs = [(k * 1000 + i, k * 1000 + 100 + rnd.randrange(60)) for k in range(2) for i in range(20) for _ in range(9)]
    pairs += [(b, a) for a, b in pairs if rnd.random() < 0.5]
    pairs += [(5000, 5001 + i) for i in range(300)] + [(5001 + i, 5400 + i % 2) for i in range(300)] + [(5400, 5000), (5401, 5000)]
    pairs += [(6000 + i, 6001 + i) for i in range(80)] + [(7000 + rnd.randrange(50), 7000 + rnd.randrange(50)) for _ in range(200)]
    edges = spark.createDataFrame(pairs + pairs[:50], "src long, dst long")
    ids = sorted({x for p in pairs for x in p})

    def refuse(*args, **kwargs):
        raise AssertionError("rows of the graph in the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    for name in ("toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(type(edges), name, refuse)
    want = brandes(ids, pairs)
    for more in ({}, {"batch_bytes": 1}):  # as many sources at once as fit; one at a time
        got = {r.id: r.betweenness for r in graph.betweenness(edges, spark.createDataFrame([(i,) for i in ids], "id long"), **more).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * (1 + want[i]) for i in want)
    assert graph.betweenness(edges.where("src < 0"), edges.select(F.col("src").alias("id"))).collect() == []
    with pytest.raises(ValueError):
        graph.betweenness(edges, edges.select(F.col("src").alias("id")), most_edges=5)


def test_sources_are_worked_out_together(spark):
    """More sources, neighbours and rows than one block, piece or strip holds."""
    rnd = np.random.default_rng(1)
    pairs = np.unique(rnd.integers(0, 700, (9000, 2)), axis=0)
    pairs = np.unique(np.r_[pairs[pairs[:, 0] != pairs[:, 1]], [(3, i) for i in range(700) if i != 3], [(i, 5) for i in range(700) if i != 5]], axis=0)
    links = []
    for src, dst in (pairs.T, pairs[:, ::-1].T):
        at = np.argsort(src, kind="stable")
        links.append((np.r_[0, np.cumsum(np.bincount(src, minlength=700))], dst[at].astype(np.int32)))
    ids = np.sort(rnd.permutation(700)[:40])
    assert sorted(graph.grouped(ids, *links, 700)) == ids.tolist()
    rows, shares = graph.shortest_path_shares(ids, np.ones(len(ids)), *links, 700)
    want = brandes(ids.tolist(), [tuple(p) for p in pairs.tolist()])
    assert rows.tolist() == sorted(want) and np.allclose(shares, [want[i] for i in sorted(want)])
    cuts = list(graph.blocks(np.arange(700), links[0], 100, 300))
    assert np.concatenate(cuts).tolist() == list(range(700)) and all(len(c) == 1 or np.diff(links[0][0])[c].sum() <= 300 for c in cuts)


def test_components_are_worked_out_apart():
    """Components of one size are split from each other, small ones are put together; few links are followed and many are summed."""
    rnd = np.random.default_rng(2)
    pairs = [(k * 400 + a, k * 400 + 300 + b) for k in range(3) for a, b in rnd.integers(0, [300, 100], (4000, 2))]
    pairs += [(b, a) for a, b in pairs if rnd.random() < 0.5] + [(1200 + i, 1201 + i) for i in range(0, 60, 3)] + [(1300 + i, 1301 + i) for i in range(200)]
    pairs = np.unique(np.array(pairs), axis=0)
    links = []
    for src, dst in (pairs.T, pairs[:, ::-1].T):
        links.append((np.r_[0, np.cumsum(np.bincount(src, minlength=1600))], dst[np.argsort(src, kind="stable")].astype(np.int32)))
    want = brandes(range(1600), [tuple(p) for p in pairs.tolist()])
    for together, tall, wide in ((1, 64, 4), (500, 4096, 7), (10_000, 100, 3)):
        parts, got = list(graph.split_up(*links, 1600, together)), {}
        assert sorted(np.concatenate([p[0] for p in parts]).tolist()) == list(range(1600))
        for nodes, out, into, ends in parts:
            rows, shares = graph.shortest_path_shares(np.arange(len(nodes)), np.ones(len(nodes)), out, into, len(nodes), ends, wide, tall)
            got |= dict(zip(nodes[rows].tolist(), shares.tolist(), strict=True))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * (1 + want[i]) for i in want)
        assert max(len(p[0]) for p in parts) < 1000 or together > 1000


def test_feed_of_many_partitions(spark):
    """Every feed is one file, however its rows lie in partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = registry.QUERIES["src24_feed"](spark, SF)
        kept = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 5 = 0 OR CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
        assert sorted(r.title for r in got.collect()) == sorted(f"T{r.event_id}" for r in kept.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def close_names(seed: int, n: int) -> list[str]:
    """Random names, and such with a few letters taken, put in or changed, some repeated."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.7:
            x = list(rnd.choice(out))
            for _ in range(rnd.randint(0, 4)):
                at = rnd.randrange(len(x) + 1)
                x[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "7"])
            out.append("".join(x))
        else:
            out.append("".join(rnd.choice("abcdefg 0123#") for _ in range(rnd.choice([3, 8, 13, 20, 31, 40]))))
    return [x for x in out if x.strip()] + ["x" * 300, "x" * 299 + "y", "é" * 70, "é" * 68 + "ab"]


def test_clusters_and_fuzzy_lose_nothing(spark):
    names = close_names(5, 260)
    low = [x.strip().lower() for x in names]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    for t in (0.85, 0.75):
        near = [[resolution.indel_ratio(a, b) >= t for b in low] for a in low]
        want = list(range(len(low)))
        while True:
            new = [min(want[j] for j in range(len(low)) if near[i][j]) for i in range(len(low))]
            if new == want:
                break
            want = new
        assert [r.cluster for r in resolution.clusters(df, t).orderBy("id").collect()] == want
    keys = low[::2]
    catalog = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, id long")
    want = {}
    for a in set(low[1::2]):
        hits = [(-round(resolution.indel_ratio(a, k), 6), i) for i, k in enumerate(keys)]
        if -min(hits)[0] >= 0.85:
            want[a] = (min(hits)[1], -min(hits)[0])
    got = {r.name: (r.id, r.score) for r in resolution.fuzzy(df.where("id % 2 = 1"), catalog).collect()}
    assert got == want


def test_names_of_one_pattern_are_not_compared_with_each_other(spark, monkeypatch):
    """Three thousand names that all link, and as many of another kind that no letter counts bring near, make no pair."""
    met = []
    pairs = resolution.candidate_pairs
    monkeypatch.setattr(resolution, "candidate_pairs", lambda a, b, t: met.append(pairs(a, b, t)) or met[-1])
    names = spark.range(3000).select("id", F.format_string("Supplier#%09d", "id").alias("name"))
    other = spark.range(3000, 6000).select("id", F.format_string("Somewhere else %d", "id").alias("name"))
    assert {tuple(r) for r in resolution.clusters(names.unionByName(other)).select((F.col("id") < 3000).alias("a"), "cluster").distinct().collect()} == {(True, 0), (False, 3000)}
    found = resolution.fuzzy(names.select(F.concat("name", F.lit("s")).alias("name")).unionByName(other.select("name")), names.select(F.lower("name").alias("key"), "id"))
    assert found.count() == 3000 and [x.count() for x in met] == [0, 0]


def test_components_that_letters_tell_apart_are_not_compared(spark, monkeypatch):
    """Numbers whose digits make up for other letters where only eight kinds of letters are counted; names of one component."""
    met = []
    pairs = resolution.candidate_pairs
    monkeypatch.setattr(resolution, "candidate_pairs", lambda a, b, t: met.append(pairs(a, b, t)) or met[-1])
    ids = spark.range(55000, 58000)
    names = ids.select("id", F.when(F.col("id") % 2 == 0, F.format_string("Supplier#%09d", "id")).otherwise(F.format_string("Somewhere else %d", "id")).alias("name"))
    got = resolution.clusters(names).groupBy("cluster").count().orderBy("cluster").collect()
    assert [tuple(r) for r in got] == [(55000, 1500), (55001, 1500)] and met[0].count() == 0
    rows = spark.createDataFrame([("abcdefgh1", 1), ("abcdefgh2", 1), ("abcdefgh3", 2)], "l string, c int")
    assert {(r.l[-1], r.r[-1]) for r in pairs(rows, rows.withColumnRenamed("l", "r"), 0.75).collect()} == {("1", "3"), ("2", "3"), ("3", "1"), ("3", "2")}


def test_letter_counts_are_no_further_apart_than_names(spark):
    names = close_names(7, 120) + ["", "eeeeeeeee", "\U0001f600\U0001f601a"]
    rows = resolution.counted(spark.createDataFrame([(x,) for x in names] + [(None,)], "x string"), "x").where("x IS NOT NULL")
    other = rows.select(*[F.col(c).alias(f"{c}_") for c in rows.columns])
    both = rows.crossJoin(other).select("x", "x_", "_n", resolution.apart_at_least(resolution.COUNTS, [f"{c}_" for c in resolution.COUNTS]).alias("d")).collect()
    assert all(r.d <= round((1 - resolution.indel_ratio(r.x, r.x_)) * (len(r.x) + len(r.x_))) and r._n == len(r.x) for r in both)
    assert {r.d for r in both if (r.x, r.x_) == ("", "eeeeeeeee")} == {4} and {r.d for r in both if r.x == r.x_} == {0}


def test_records_are_written_packed_and_leave_no_shuffle_files(spark, tmp_path):
    """Repeats of a mention in a document keep the last line; files are compressed; shuffles of the writing are gone."""
    from hypsoline.plans import catalog_sources
    from hypsoline.plans.lineage import cut
    from hypsoline.plans.model import Model

    read = catalog_sources.read_records(Model(spark, SF))
    assert all(f.endswith(".json.gz") for f in read.inputFiles()) and read.inputFiles()
    got = sorted((int(r.doc_id), m.name, m.role) for r in read.select("document.doc_id", "tech_mentions").collect() for m in r.tech_mentions or [])
    docs = {r.doc_id for r in Model(spark, SF).documents_g.select("doc_id").collect()}
    assert got == sorted((r.doc_id, f" P{r.tech_id}", r.role) for r in Model(spark, SF).tech_mentions.collect() if r.doc_id in docs)
    spark.sparkContext._jvm.System.gc()
    files = lambda: {p for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|") for p in [d] if "shuffle_" in p}
    before = files()
    cut(spark.range(5000).groupBy((F.col("id") % 777).alias("k")).count())
    assert files() <= before


def test_links_in_buckets_are_not_shuffled_again(spark):
    from hypsoline.plans.lineage import bucketed

    links = bucketed(spark.range(500).select((F.col("id") % 50).alias("src"), F.col("id").alias("dst")), "src")
    both = links.join(spark.range(50).hint("shuffle_hash"), F.col("src") == F.col("id"))
    assert both._jdf.queryExecution().sparkPlan().toString() and both._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert both.count() == 500
