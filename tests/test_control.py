"""Control of runs: configuration, retries, batches that go on, sources that fail, UI forms, harvested forms."""

import pytest
from pyspark.sql import functions as F

from hypsoline.operators import control as C
from hypsoline.sources import harvested as V
from hypsoline.sources import paged as P
from hypsoline.sources import services as W

SCHEMA = {
    "type": "object", "required": ["name", "sources"],
    "properties": {"name": {"type": "string"}, "sources": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["id"], "properties": {"limit": {"type": "integer", "minimum": 1}, "kind": {"enum": ["a", "b"]}}}}},
}


def test_config_errors():
    assert C.config_errors({"name": "x", "sources": [{"id": 1, "limit": 5, "kind": "a"}]}, SCHEMA) == []
    assert C.config_errors([], SCHEMA) == ["$: not object"]
    wrong = C.config_errors({"sources": [{"limit": 0, "kind": "c"}, 3]}, SCHEMA)
    assert wrong == ["$.name: missing", "$.sources[0].id: missing", "$.sources[0].limit: beyond the minimum 1", "$.sources[0].kind: not one of ['a', 'b']", "$.sources[1]: not object"]
    assert C.config_errors(True, {"type": "integer"}) and C.config_errors([], {"type": "array", "minItems": 1})


def test_retries_after_passing_failures_only():
    calls, slept = [], []
    failures = [P.ServiceError(503), P.ServiceError(429), ConnectionError(), None]

    def fetch(options, query, number):
        calls.append(query)
        error = failures[len(calls) - 1]
        if error:
            raise error
        return [{"id": 1}]

    patient = P.patient(fetch, most=3, first=1.0, sleep=slept.append, clock=lambda: 0.0)
    assert patient({}, "q", 0) == [{"id": 1}] and slept == [1.0, 2.0, 4.0] and len(calls) == 4
    with pytest.raises(P.ServiceError):
        P.patient(lambda *a: (_ for _ in ()).throw(P.ServiceError(404)), sleep=slept.append)({}, "q", 0)
    assert P.should_retry(P.ServiceError(408), 0) and not P.should_retry(P.ServiceError(500), 3) and not P.should_retry(ValueError(), 0)
    assert P.delay(20) == 300.0
    waits = []
    slow = P.patient(lambda *a: [], interval=2.0, sleep=waits.append, clock=lambda: 10.0)
    slow({}, "a", 0), slow({}, "b", 0)
    assert waits == [2.0]
    assert [r["i"] for r in P.until(iter([[{"i": 1}], [{"i": 2}, {"last": 1, "i": 3}], [{"i": 4}]]), lambda page: "last" in page[-1])] == [1, 2, 3]


def test_pages_stop_at_the_first_short_one_and_at_the_limit(spark):
    rows = [("a", 0, i) for i in range(3)] + [("a", 1, i) for i in range(2)] + [("a", 2, i) for i in range(3)] + [("b", 1, 0)] + [("c", 0, i) for i in range(3)] + [("c", 1, i) for i in range(3)]
    df = spark.createDataFrame(rows, "query string, page int, at int")
    got = {(r.query, r.page, r.at) for r in W.reached(df, 3).collect()}
    assert got == {x for x in rows if x[0] != "b" and x[:2] != ("a", 2)}
    assert {(r.query, r.page, r.at) for r in W.reached(df, 3, 4).collect()} == {x for x in rows if x[:2] in (("a", 0), ("c", 0))} | {("a", 1, 0), ("c", 1, 0)}


def test_a_stopped_run_goes_on(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("index"), F.col("id").cast("string").alias("text"))
    at, schema = str(tmp_path / "run"), "text string, quality_score double"

    def parse(row):
        if row["index"] == 3:
            raise KeyError("no")
        return {"text": row["text"] * 2, "quality_score": row["index"] / 10}

    first = C.run_batches(df.where("index < 4"), parse, schema, at)
    assert first.count() == 4 and first.where("error IS NOT NULL").count() == 1
    every = C.run_batches(df, parse, schema, at, quality=0.5)
    assert sorted(r["index"] for r in every.collect()) == list(range(10)) and every.where("index = 4").first().text == "44"
    assert sorted(r["index"] for r in spark.read.parquet(at + "/relevant").collect()) == [5, 6, 7, 8, 9]


def test_a_failing_source_is_reported_and_the_run_tells_its_steps(spark):
    order = C.by_priority({"late": {}, "first": {"priority": 1}, "second": {"priority": 2}})
    assert order == ["first", "second", "late"]

    def broken():
        raise RuntimeError("down")

    frames, report = C.run_sources({"first": lambda: spark.range(3), "second": broken, "late": lambda: spark.range(1)}, order)
    assert list(frames) == ["first", "late"] and [(r["source"], r["success"], r["error"]) for r in report] == [("first", 3, None), ("second", 0, "down"), ("late", 1, None)]
    told, saved = [], []
    done = C.run_pipeline({"name": "x", "sources": [{"id": 1}]}, SCHEMA, lambda c: spark.range(4), lambda d: d.where("id > 0"), saved.append, told.append)
    assert done.count() == 3 and len(saved) == 1 and [t["type"] for t in told] == ["pipeline_start", "pipeline_complete"]
    assert C.run_pipeline({}, SCHEMA, lambda c: spark.range(4), lambda d: d, saved.append, told.append) is None and told[-1]["type"] == "pipeline_error" and len(saved) == 1


def test_layers_ranges_and_search():
    assert C.date_range("adoption", "2025-01-01") == ("2023-07-11", "2025-01-01")
    with pytest.raises(ValueError):
        C.date_range("other", "2025-01-01")
    assert [V.search_range(d) for d in (1, 7, 30, 31)] == ["day", "week", "month", "year"]


def test_chunks_and_index_ranges_cover_all_rows(spark):
    df = spark.range(1000)
    sizes = [r["count"] for r in C.in_chunks(df, "id", 100).groupBy("chunk").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10
    got = C.index_range(df.withColumn("k", F.col("id") * 7 % 1000), ["k"], 990).orderBy("index").collect()
    assert [(r["index"], r.k) for r in got] == [(i, i) for i in range(990, 1000)]
    assert C.index_range(df, ["id"], 2000).count() == 0 and not C.search_works(df.where("id < 0")) and C.search_works(df)


def test_edge_labels_fall_back_to_the_type(spark):
    df = spark.createDataFrame([("MENTIONED_IN", {"role": "owner"}), ("MENTIONED_IN", {"role": ""}), ("OTHER", {"role": "x"}), ("RELATED_TECH", {"relation_type": "uses"}), ("RELATED_TECH", None)], "k string, p map<string,string>")
    assert [r[0] for r in df.select(C.edge_label(F.col("k"), F.col("p"))).collect()] == ["owner", "MENTIONED_IN", "OTHER", "uses", "RELATED_TECH"]


def test_patents_with_missing_parts(spark):
    rows = spark.createDataFrame([("1",)], "lens_id string")
    raw = rows.select(F.from_json(F.lit('{"lens_id": "x"}'), V.PATENT).alias("r")).select("r.*")
    got = V.flat_patents(raw, F.lit("searched")).first()
    assert (got.title, got.assignee, got.inventors, got.filing_date, got.claims_count, got.type, got.current_owners) == ("", "searched", [], "", 0, "application", None)
    assert got.forward_citation_count == 0 and got.cpc_codes == [] and not got.has_terminal_disclaimer


def test_embedder_is_a_place_for_a_model(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "", "")], "id int, x string, y string")
    assert W.to_embed(df, ["x", "y"], embed=lambda t: F.array(F.length(t).cast("double"))).orderBy("id").first().embedding == [3.0]
    made = W.to_embed(df, ["x", "y"], size=8).orderBy("id").collect()
    assert abs(sum(v * v for v in made[0].embedding) - 1) < 1e-9 and made[1].embedding == [0.0] * 8
