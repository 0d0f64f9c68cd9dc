"""Matching of names against all pairs, and its order-free merges."""

import itertools

from pyspark.sql import functions as F

from hypsoline.operators import matching as M
from hypsoline.operators.resolution import candidate_pairs, indel_ratio
from hypsoline.operators.search import nearest


def plain_ratio(a, b):
    """2 * LCS / (|a| + |b|) by the table of lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def made_names():
    import random

    rng = random.Random(3)
    words = ["rotor", "motor", "rotors", "battery", "bat", "wing", "swing", "aa", "aaaa", "abab"]
    out = {" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)}
    for x in list(out)[:30]:
        y = list(x)
        for _ in range(rng.randint(1, 4)):
            y[rng.randrange(len(y))] = rng.choice("abcxyz ")
        out.add("".join(y).strip() or "q")
    return sorted(out | {"a", "ab", "abc", "x"})


def test_near_duplicates_are_those_of_all_pairs(spark):
    names = made_names()
    want = {(a, b, round(plain_ratio(a, b), 6)) for a, b in itertools.combinations(sorted(set(names)), 2) if 0.75 <= plain_ratio(a, b) < 0.85}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {(r.name1, r.name2, r.score) for r in M.near_duplicates(df).collect()} == want and len(want) > 20
    assert all(abs(indel_ratio(a, b) - plain_ratio(a, b)) < 1e-12 for a, b in itertools.combinations(names[:40], 2))


def test_candidates_lose_no_pair_down_to_two_thirds(spark):
    names = made_names()
    df = spark.createDataFrame([(n,) for n in names], "l string")
    for t in (2 / 3, 0.75, 0.9):
        found = {(r.l, r.r) for r in candidate_pairs(df, df.withColumnRenamed("l", "r"), t).collect()}
        assert {(a, b) for a in names for b in names if plain_ratio(a, b) >= t} <= found


def test_nearest_in_blocks(spark):
    import random

    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)] + [(50, [0.0, 0.0, 0.0]), (51, None), (52, [1.0]), (53, [2.0])]
    items = spark.createDataFrame(rows, "id long, v array<double>")
    queries = items.select(F.col("id").alias("qid"), F.col("v").alias("qv"))

    def cosine(a, b):
        dot, na, nb = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return round(dot / (na * nb), 9) if na * nb else 0.0

    own = [(i, v) for i, v in rows if v is not None]
    every = {i: sorted(((-cosine(v, w), j) for j, w in own if len(w) == len(v))) for i, v in own}
    for size in (4096, 7):
        got = {}
        for r in nearest(queries, items, 4, rows=size).collect():
            got.setdefault(r.qid, []).append((-r.score, r.id))
        assert {i: sorted(x) for i, x in got.items()} == {i: x[:4] for i, x in every.items()}
        wide = {(r.qid, r.id) for r in nearest(queries, items, least=0.5, rows=size).collect()}
        assert wide == {(i, j) for i, x in every.items() for s, j in x if -s >= 0.5}
    assert nearest(queries.where("qid < 0"), items, 4).count() == 0


def test_merge_of_results_has_no_order(spark):
    v = [[1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [0.0, 0.1, 1.0]]
    schema = "id long, name string, v array<double>, variants array<string>"
    catalog = spark.createDataFrame([(1, "battery pack", v[0], ["battery pack"])], schema)
    results = [(10, "battery packs", v[0], ["packs"]), (11, "tilt rotor", v[1], ["tilt"]), (12, "tilt rotors", v[1], ["tilts", "tilt"]), (13, "other", v[2], ["other"])]
    want = {("battery pack", ("battery pack", "packs"), False), ("tilt rotor", ("tilt", "tilts"), True), ("other", ("other",), True)}
    for order in (results, results[::-1]):
        got = M.merge_results(catalog, spark.createDataFrame(order, schema)).collect()
        assert {(r.name, tuple(r.variants), r.is_new) for r in got} == want
    assert M.merge_results(catalog, spark.createDataFrame([], schema)).count() == 1


def test_documents_keep_their_order_and_empty_arrays(spark):
    docs = spark.createDataFrame([("d1", [("A", 1), ("B", 2), ("A", 3)]), ("d2", []), ("d3", None)], "doc_id string, m array<struct<name: string, n: int>>")
    found = spark.createDataFrame([("A", "Alpha", 7, "high")], "name string, canonical string, id long, confidence string")
    rows = {r.doc_id: r.m for r in M.normalize_documents(docs, {"m": ["name"]}, found).collect()}
    assert [(x.n, x.normalized_name, x.name_id, x.name_confidence) for x in rows["d1"]] == [(1, "Alpha", 7, "high"), (2, "Unknown", None, "low"), (3, "Alpha", 7, "high")]
    assert rows["d2"] == [] and rows["d3"] == []
