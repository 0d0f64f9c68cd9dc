"""Registered graph queries against brute force on the smallest tables."""

from collections import Counter

from hypsoline import registry
from hypsoline.plans.catalog_records import edges, nodes
from hypsoline.plans.model import Model

SF = "/root/testdata/sf0.001"
registry.load()


def graph(spark):
    m = Model(spark, SF)
    return [r.id for r in nodes(m).collect()], [(r.src, r.dst) for r in edges(m).collect()]


def test_full_pagerank_has_twenty_rounds(spark):
    ids, pairs = graph(spark)
    out, rank = Counter(a for a, _ in pairs), dict.fromkeys(ids, 0.15)
    for _ in range(20):
        new = dict.fromkeys(ids, 0.15)
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    got = {r.id: r.pagerank for r in registry.QUERIES["gra1_pagerank"](spark, SF).collect()}
    assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 2e-6 for i in ids)


def test_label_propagation_goes_on_until_stable(spark):
    _, pairs = graph(spark)
    near = Counter()
    for a, b in pairs:
        if a != b:
            near[a, b] += 1
            near[b, a] += 1
    labels = {a: a for a, _ in near}
    seen = []
    while labels not in seen:
        seen.append(labels)
        votes = {a: Counter({labels[a]: 1}) for a in labels}
        for (a, b), w in near.items():
            votes[a][labels[b]] += w
        labels = {a: min(v, key=lambda c: (-v[c], c)) for a, v in votes.items()}
    got = {r.id: r.community for r in registry.QUERIES["gra5_label_propagation"](spark, SF).collect()}
    assert got == labels


def test_label_propagation_stops_where_labels_go_in_a_circle_or_a_long_way(spark):
    from hypsoline.operators.graph import label_propagation

    path = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    circle = spark.createDataFrame([(1, 2)] * 3, "src long, dst long")
    assert label_propagation(path, rounds=None).count() == 31
    assert {r.id: r.community for r in label_propagation(circle, rounds=None).collect()}.keys() == {1, 2}


def test_betweenness_of_all_nodes(spark):
    ids, pairs = graph(spark)
    out = {}
    for a, b in set(pairs):
        if a != b:
            out.setdefault(a, []).append(b)
    want, reached = Counter(), set()
    for s in ids:
        order, before, paths, dist, queue = [], {s: []}, Counter({s: 1}), {s: 0}, [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in out.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    before[w] = []
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = Counter()
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                want[w] += share[w]
                reached.add(w)
    got = {r.id: r.betweenness for r in registry.QUERIES["gra3_betweenness"](spark, SF).collect()}
    assert got.keys() == reached and all(abs(got[i] - want[i]) < 1e-3 for i in got) and max(got.values()) > 10
