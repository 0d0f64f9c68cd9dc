"""Operators on small frames: ties, nulls, duplicate keys, empty groups."""

import datetime

from pyspark.sql import functions as F

from hypsoline.functions import chunks
from hypsoline.functions import scalars as S
from hypsoline.operators import basics, communities, diagnostics, finance, graph, harvest, layers, resolution, search, upsert


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_keep_first_and_last_wins(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, None, 1), (4, "", 2), (5, "b", 9)], "id int, url string, v int")
    assert values(basics.keep_first(df, "url", ["id"]), "id") == [(1,), (5,)]
    assert values(basics.keep_first(df, "url", ["id"], drop_empty=False), "id") == [(1,), (3,), (4,), (5,)]
    got = {r.url: r.id for r in basics.last_wins(df, ["url"], ["id"]).collect()}
    assert got == {"a": 2, None: 3, "": 4, "b": 5}


def test_trend(spark):
    df = spark.createDataFrame([(6, 18), (12, 18), (1, 18), (1, 0), (0, 0)], "r int, h int")
    t = layers.trend(F.col("r"), F.col("h"), 6, 24, 0.2, ("up", "down", "flat"))
    assert [x[0] for x in df.select(t).collect()] == ["flat", "up", "down", "up", "flat"]
    p = layers.trend(F.col("r"), F.col("h"), 6, 24, 0.2, ("up", "down", "flat"), parity=True)
    assert [x[0] for x in df.select(p).collect()] == ["down", "down", "down", "up", "flat"]


def test_windows_are_half_open(spark):
    df = spark.createDataFrame([("2020-01-01",), ("2020-06-01",), ("2021-01-01",), (None,)], "d string").withColumn("d", F.to_date("d"))
    assert df.where(basics.between(F.col("d"), "2020-01-01", "2021-01-01")).count() == 2
    assert df.where(basics.between(F.col("d"), "2020-01-01", None)).count() == 3


def test_maturity(spark):
    rows = [(0, 0, 2, "mid"), (1, 0, 2, "late"), (2, 1, 0, "early"), (1, 2, 1, "hype"), (3, 3, 1, "mid"), (20, 2, 1, "early"), (2, 20, 1, "hype"), (10, 10, 5, "late"), (1, 1, 20, "mid")]
    df = spark.createDataFrame(rows, "p int, n int, c int, want string")
    assert df.where(communities.maturity(F.col("p"), F.col("n"), F.col("c")) != F.col("want")).count() == 0


def test_quarters_and_signals(spark):
    rows = [("x", datetime.date(2020, q * 3 - 2, 1), i, 10.0 * q) for q in (1, 2, 3) for i in range(3)]
    df = spark.createDataFrame(rows, "cusip string, period date, institution int, shares double").withColumn("value", F.col("shares") * 2)
    q = {r.period.month: r for r in finance.by_quarter(df).collect()}
    assert q[1].change_pct is None and q[4].change_pct == 100.0 and q[7].change_pct == 50.0 and q[1].institutions == 3 and q[1].top10_pct == 100.0
    assert finance.signals(finance.by_quarter(df)).first().signal == "accumulation"
    assert {r.period.month: r.change_pct for r in finance.by_quarter(df, parity=True).collect()}[7] is None


def test_insiders(spark):
    rows = [("T", "P", 10.0, 2.0, 1, "OFFICER"), ("T", "S", 5.0, 0.0, 2, None), ("T", "M", 99.0, 1.0, 3, "DIRECTOR")]
    df = spark.createDataFrame(rows, "ticker string, code string, shares double, price double, owner int, relationship string").withColumn("trans_date", F.lit("2020-01-01").cast("date"))
    r = finance.insider_metrics(df, ["ticker"]).first()
    assert (r.purchases, r.sales, r.value_bought, r.value_sold, r.avg_sell, r.insiders, r.officers, r.directors, r.net_shares) == (1, 1, 20.0, 0.0, 0.0, 2, 1, 0, 5.0)
    assert [x[0] for x in df.select(finance.role_text(F.col("relationship"))).collect()] == ["Officer", "Unknown", "Director"]


def test_harvest(spark):
    df = spark.createDataFrame([(c,) for c in range(25)] + [(24,)], "cited int")
    r = harvest.citation_metrics(df).first()
    assert (r.papers, r.total_citations, r.max_citations, r.top_decile) == (26, 324, 24, 23)
    assert harvest.citation_metrics(df.where("cited >= 20 and cited < 24")).first().top_decile == 23
    names = spark.createDataFrame([("Engineer at Acme at Beta",), ("Acme - Engineer",), ("Acme | x",), ("Company: Acme",), ("none",)], "t string")
    assert [x[0] for x in names.select(harvest.company_of(F.col("t"))).collect()] == ["Beta", "Acme", "Acme", "Acme", None]
    assert spark.range(1).select(harvest.success_rate(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.title_case(F.lit("31-DEC o'neil ab"))) == "31-Dec O'Neil Ab"
    assert one(S.slug(F.lit("--Solid State (v2)!"))) == "solid_state_v2"
    assert one(S.money(F.lit("$1,234.50"))) == 1234.5 and one(S.money(F.lit("n/a"))) is None
    assert one(S.accession(F.lit("000123456724000001"))) == "0001234567-24-000001" and one(S.accession(F.lit("12"))) == "12"
    assert one(S.domain_of(F.lit("https://www.a.b:80/x?y"))) == "a.b:80"
    assert one(S.decision_type(F.lit("Disapproval of"))) == "approval" and one(S.outlet_tier(F.lit(None).cast("string"))) == "Niche/Aggregator"
    assert one(S.days_between(F.lit("2020-01-01"), F.lit("2020-01-31"))) == 30 and one(S.days_between(F.lit("x"), F.lit("2020-01-31"))) == 0
    assert one(S.normalize_name(F.lit("  Li-Ion  (Battery)™/Cell+ "))) == "li-ion (battery)/cell+"
    assert one(S.filing_title(F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string"))) == "SEC Filing"
    assert one(S.short_summary(F.lit("a" * 300 + ". " + "b" * 300))) == "a" * 300 + "." and one(S.short_summary(F.lit("short"))) == "short"
    assert one(S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(S.docket(F.lit("x Docket No. FAA-2020-1 y"))) == "FAA-2020-1" and one(S.header_field(F.lit("A: 1\n  B:  two \n"), "B")) == "two"
    assert one(S.fiscal_quarter(F.lit("2020-05-01").cast("date"), F.lit("10-K"))) == "Q4"


def test_chunks(spark):
    text = "para one.\n\n" * 30
    assert "".join(chunks.by_blank_line(text, 100)) == text and max(map(len, chunks.by_blank_line(text, 100))) <= 100
    parts = chunks.overlapping("Sentence here. " * 100, 200, 40)
    assert all(len(p) <= 200 for p in parts) and parts[1].startswith(parts[0][-40:])
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, t string")
    assert chunks.chunk(df, "id", "t", size=100).groupBy("id").count().collect()[0].id == 1


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (6, 7), (1, 2)], "src long, dst long")
    nodes = spark.range(1, 8)
    assert values(graph.degree(nodes, edges), "id", "degree") == [(1, 3), (2, 1), (3, 1), (4, 0), (5, 0), (6, 1), (7, 0)]
    assert values(graph.connected_components(edges), "id", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 6)]
    b = {r.id: r.betweenness for r in graph.betweenness(edges, nodes).collect()}
    assert b[3] == 2.0 and b[2] == 0.0
    rank = {i: 0.15 for i in range(1, 8)}
    out = {1: [2, 3, 2], 2: [3], 3: [4], 6: [7]}
    for _ in range(20):
        new = {i: 0.15 for i in rank}
        for s, ds in out.items():
            for d in ds:
                new[d] += 0.85 * rank[s] / len(ds)
        rank = new
    got = {r.id: r.pagerank for r in graph.pagerank(nodes, edges).collect()}
    assert all(abs(got[i] - rank[i]) < 1e-6 for i in rank)
    labels = graph.label_propagation(edges)
    assert labels.count() == 6 and -0.5 <= graph.modularity(edges, labels) <= 1


def test_search(spark):
    docs = spark.createDataFrame([(1, "solid battery battery"), (2, "battery"), (3, "nothing"), (4, None), (5, "Solid, STATE")], "doc_id long, text string")
    got = search.bm25(docs, "solid battery", F.col("text")).collect()
    assert [r.doc_id for r in got][0] == 1 and {r.doc_id for r in got} == {1, 2, 5} and [r["rank"] for r in got] == [1, 2, 3]
    assert search.bm25(docs, "absent", F.col("text")).count() == 0
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "doc_id long, rank int")
    assert {r.doc_id: r.score for r in search.rrf([a, b]).collect()}[2] == round(1 / 61 + 1 / 62, 9)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_resolution(spark):
    for a, b in (("battery", "batteries"), ("", "x"), ("abc", "cba"), ("a" * 80 + "b", "a" * 79 + "cb")):
        assert resolution.indel_ratio(a, b) == 2 * lcs(a, b) / (len(a) + len(b))
    catalog = spark.createDataFrame([(1, "Solid State Battery", ["SSB"]), (2, "Electric Motor", None), (3, "ssb", None)], "id int, name string, aliases array<string>")
    mentions = spark.createDataFrame([(" ssb ",), ("Solid-State Battery",), ("electric motor",), ("unrelated",), (None,)], "name string")
    got = {r.name: (r.id, r.method) for r in resolution.cascade(mentions, catalog).collect()}
    assert got[" ssb "] == (1, "exact") and got["Solid-State Battery"] == (1, "fuzzy") and got["electric motor"] == (2, "exact") and got["unrelated"] == (None, "none")
    names = spark.createDataFrame([(1, "lithium cell"), (2, "lithium cells"), (3, "lithium cells "), (4, "rotor")], "id long, name string")
    assert values(resolution.clusters(names), "id", "cluster") == [(1, 1), (2, 1), (3, 1), (4, 4)]
    docs = spark.createDataFrame([(1, ["x", "b", "x"]), (2, []), (3, None)], "doc_id int, names array<string>")
    matches = spark.createDataFrame([("x", "X")], "name string, canonical string")
    assert {r.doc_id: r.names for r in resolution.annotate(docs, matches).collect()} == {1: ["X", "b", "X"], 2: [], 3: None}


def test_upsert_and_diagnostics(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, name string, seq int")
    assert values(upsert.merge_nodes(now, changes, "id", "seq"), "id", "name") == [(1, "a"), (2, "d"), (3, "e")]
    df = spark.createDataFrame([("x", 1), ("x", None), ("y", None)], "doc_type string, v int")
    assert values(diagnostics.completeness(df, ["v"]), "doc_type", "filled", "pct") == [("x", 1, 50.0), ("y", 0, 0.0)]
    assert spark.range(1).select(diagnostics.status(F.lit(None).cast("double"))).first()[0] == "N/A"


def test_candidate_pairs_lose_nothing(spark):
    import random

    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(3, 14))).strip() or "a" for _ in range(40)})
    names += sorted({n[:i] + rng.choice("abxy") + n[i + rng.randint(0, 1) :] for n in names for i in [rng.randrange(len(n))]} - set(names))
    left, right = spark.createDataFrame([(n,) for n in names], "l string"), spark.createDataFrame([(n,) for n in names], "r string")
    for t in (0.85, 0.9):
        got = {(r.l, r.r) for r in resolution.candidate_pairs(left, right, t).collect()}
        assert {(a, b) for a in names for b in names if resolution.indel_ratio(a, b) >= t} <= got
