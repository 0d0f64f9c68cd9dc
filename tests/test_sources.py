"""Readers, parsers, sinks and streams over small files."""

import json

import pytest
from pyspark.sql import functions as F

from hypsoline.operators.resolution import alias_table
from hypsoline.sources import paged, parsers, readers
from hypsoline.streaming import events as E


def test_tsv(spark, tmp_path):
    (tmp_path / "COVERPAGE.tsv").write_text("ACCESSION_NUMBER\tFILINGMANAGER_NAME\tFILINGMANAGER_CITY\tFILINGMANAGER_STATEORCOUNTRY\n1\tA\t\tNY\n")
    row = readers.tsv(spark, str(tmp_path / "COVERPAGE.tsv"), readers.FORM13F["COVERPAGE"]).first()
    assert row.ACCESSION_NUMBER == "1" and row.FILINGMANAGER_CITY is None
    (tmp_path / "BAD.tsv").write_text("ACCESSION_NUMBER\tCUSIP\tNAMEOFISSUER\tVALUE\n1\tx\ty\tnot a number\n")
    with pytest.raises(Exception):
        readers.tsv(spark, str(tmp_path / "BAD.tsv"), "ACCESSION_NUMBER string, CUSIP string, NAMEOFISSUER string, VALUE double").collect()


def test_records_split_into_tables(spark, tmp_path):
    record = {
        "document": {"doc_id": "d1", "doc_type": "news_article", "title": "t", "seendate": "20240102T030405Z", "abstract": "s"},
        "tech_mentions": [{"name": " Battery ", "role": "invented", "strength": 0.5, "evidence_confidence": 0.9, "evidence_text": "x" * 300}, {"name": "unknown", "role": "studied"}],
        "company_mentions": [], "company_tech_relations": [{"company_name": "Acme", "technology_name": "battery", "relation_type": "develops", "evidence_confidence": 1.0}],
    }
    (tmp_path / "a.json").write_text(json.dumps([record]))
    (tmp_path / "b.json").write_text(json.dumps(record | {"document": {"doc_id": "d2", "doc_type": "patent", "published_at": "2024-05-06"}}))
    (tmp_path / "skipme.json").write_text(json.dumps(record))
    df = readers.json_records(spark, str(tmp_path), readers.RECORD, skip="skipme")
    tech = alias_table(spark.createDataFrame([("T1", "battery", None)], "id string, name string, aliases array<string>"))
    company = alias_table(spark.createDataFrame([("C1", "acme corp", ["acme"])], "id string, name string, aliases array<string>"))
    out = readers.split_record(df, tech, company)
    docs = {r.doc_id: r for r in out["documents"].collect()}
    assert docs["d1"].doc_type == "news" and docs["d1"].published_at.year == 2024 and docs["d1"].summary == "s" and docs["d2"].published_at.month == 5
    assert [(r.tech_id, len(r.evidence_text)) for r in out["tech_mentions"].collect()] == [("T1", 200)] * 2
    assert sorted((r.src, r.dst, r.doc_ref) for r in out["company_tech"].collect()) == [("C1", "T1", "d1"), ("C1", "T1", "d2")]
    assert out["tech_tech"].count() == 0 and readers.unresolved(df, tech).first().n == 2


def test_scored_papers_flatten(spark, tmp_path):
    paper = {"paper_metadata": {"lens_id": "p", "title": "t", "year_published": 2020}, "technology_nodes": [{"node_id": "n1"}, {"node_id": "n2"}], "innovation_signals": {"innovation_type": "x", "adoption_indicators": ["a", "b", "c"]}}
    (tmp_path / "p.json").write_text(json.dumps([paper, {"paper_metadata": {"lens_id": "q"}}]))
    t = readers.paper_tables(readers.json_records(spark, str(tmp_path / "p.json"), readers.SCORED_PAPER))
    assert {k: v.count() for k, v in t.items()} == {"papers": 2, "relevance": 2, "technology_nodes": 2, "relationships": 0, "innovation_signals": 2, "adoption_indicators": 3}


def test_feed_and_names(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>a</title><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item><item><title>b</title></item><item><title>c</title><pubDate>Tue, 02 Jan 2018 10:00:00 +0000</pubDate></item></channel></rss>")
    assert sorted(r.title for r in readers.feed(spark, str(tmp_path / "f.xml"), "2024-01-01", "2024-12-31").collect()) == ["a", "b"]
    row = spark.range(1).select(readers.filing_name(F.lit("/x/ABCD_10-K_2024-01-31_0001_24.txt")).alias("f")).first().f
    assert (row.ticker, row.filing_type, row.date, row.accession) == ("ABCD", "10-K", "2024-01-31", "0001_24")


def test_paged_source(spark, tmp_path):
    for name, rows in (("a-0", [{"id": "1", "title": "x"}, {"id": "2"}]), ("b-0", [{"id": "3", "published_at": "2024-01-01"}])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").options(path=str(tmp_path), queries="a|b", pages="2").load()
    assert sorted(r.id for r in df.collect()) == ["1", "2", "3"]


def test_runs(spark, tmp_path):
    run = readers.run_id(3, "v1", "2024-05-06T07:08:09")
    assert run == "2024-05-06_07-08-09_3tech_v1"
    for r in (run, "2024-06-01_00-00-00_1tech_v1"):
        readers.save_run(spark.range(3), str(tmp_path / "runs"), r)
    assert readers.list_runs(spark, str(tmp_path / "runs"), 1).first().run_id.startswith("2024-06") and readers.get_run(spark, str(tmp_path / "runs"), run).count() == 3


def test_parsers(spark):
    news = spark.createDataFrame([("http://x/1", "t", "reuters.com", "20240102T030405Z", "body"), ("http://x/2", None, "my-site.org", "bad", None)], "url string, title string, domain string, seendate string, text string")
    got = {r.url: r for r in parsers.news(news).collect()}
    assert got["http://x/1"].outlet_tier == "Financial Authority" and got["http://x/1"].company_mentions[0].name == "Reuters" and got["http://x/2"].published_at is None and got["http://x/2"].company_mentions[0].name == "My-Site Org"
    text = "CONFORMED SUBMISSION TYPE:\t10-Q\nCONFORMED PERIOD OF REPORT: 20240331\nFILED AS OF DATE: 20240501\nCOMPANY CONFORMED NAME: ACME\nCENTRAL INDEX KEY: 123\n" + "<p>body</p> " * 20
    r = parsers.filings(spark.createDataFrame([("/a/ACME_10-Q.txt", text)], "path string, text string")).first()
    assert (r.title, r.cik, r.fiscal_year, r.fiscal_quarter, r.filing_type, r.quality_score) == ("ACME - 10-Q - 2024-05-01", "0000000123", 2024, "Q1", "10-Q", 0.0)
    c = spark.createDataFrame([("a/1-b", "R", "Sub", "NASA HQ", "2024-01-01", "2024-01-31", 5e5, None)], "award_id string, recipient_name string, awarding_sub_agency string, awarding_agency string, start_date string, end_date string, award_amount double, description string")
    r = parsers.contracts(c).first()
    assert (r.doc_id, r.title, r.duration_days, r.size_band, r.agency_type) == ("contract_a_1_b", "R - Sub Contract", 30, "medium", "civil")
    p = spark.createDataFrame([("1", "t", "abs", "A", True, None, "2020-01-01", "2019-01-01")], "lens_id string, title string, abstract string, assignee string, granted boolean, discontinued string, expires string, published string").withColumn("expires", F.to_date("expires"))
    extract = lambda text: F.struct(F.lit(0.9).alias("quality_score"), F.array().cast(readers.MENTION).alias("tech_mentions"), F.array().cast(readers.MENTION).alias("company_mentions"), F.array(F.struct(F.lit("A").alias("company_name"), F.lit("owns").alias("relation_type"), F.lit("").alias("doc_ref"))).alias("company_tech_relations"))
    r = parsers.patents(p, "2024-01-01", extract).first()
    assert r.legal_status == "expired" and r.quality_score == 0.9 and r.company_tech_relations[0].doc_ref == "patent_1"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    for name, make, mode in (("tumbling", E.tumbling, "complete"), ("sliding", E.sliding, "complete"), ("distinct", E.distinct_events, "append")):
        out = []
        E.run_once(make(E.source(spark, str(tmp_path / "in"), events.schema, files=2)), lambda df, _, out=out: out.append([tuple(r) for r in df.collect()]), str(tmp_path / name), mode)
        got = out[-1] if mode == "complete" else [r for part in out for r in part]
        assert sorted(got) == sorted(tuple(r) for r in make(events).collect())
    again = []
    E.run_once(E.distinct_events(E.source(spark, str(tmp_path / "in"), events.schema)), lambda df, _: again.extend(df.collect()), str(tmp_path / "distinct"), "append")
    assert again == []
