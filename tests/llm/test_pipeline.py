"""The pipeline's stages against brute-force versions, on the smallest documents."""

import corpus_pipeline as P
import numpy as np
import public_tokenizers as tokenizers
from pyspark.sql import functions as F

from hypsoline.llm import bpe, mixing, queries

from .test_nearcopies import brute_components
from .test_operators import SF, brute_pii


def test_stages_and_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "redact_pii", "mix_sources", "tokenize"] and P.ORACLE_SQL is None


def test_each_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = P.language_id(spark, docs, SF)
    assert first.columns == docs.columns and first.count() == docs.count()
    second = P.near_dedup(spark, first, SF)
    heads = set(brute_components({r.doc_id: r.text for r in first.collect()}).values())
    assert sorted(r.doc_id for r in second.collect()) == sorted(heads) and second.columns == docs.columns
    third = P.redact_pii(spark, second, SF)
    before = {r.doc_id: r for r in second.collect()}
    for r in third.collect():
        spans = brute_pii(before[r.doc_id].text)
        assert (r.text != before[r.doc_id].text) >= bool(spans) and not brute_pii(r.text) and (spans or r.n_chars == before[r.doc_id].n_chars)
    fourth = P.mix_sources(spark, third, SF)
    taken = {r.doc_id: r.copies for r in mixing.Mix(third).copies(third).collect()}
    rows = [r.doc_id for r in fourth.collect()]
    assert {i: rows.count(i) for i in taken} == taken and fourth.columns == docs.columns
    enc = bpe.encoding(queries.RANKS, tokenizers.PATTERN)
    last = P.tokenize(spark, fourth, SF).collect()
    assert len(last) == len(rows) and all(r.round_trip and r.ids == enc.encode_ordinary(r.text) for r in last)


def test_run_is_the_stages_in_turn(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and np.all([c in out.columns for c in ("doc_id", "text", "ids", "round_trip")])


def test_stages_on_empty_tables_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("a.b", F.lit("kept")).withColumn("Shard", F.lit(1))
    none, some = docs.where("doc_id < 0"), docs.where("doc_id < 40")
    twice = some.unionByName(some.where("doc_id < 5")).unionByName(some.limit(1).withColumn("text", F.lit(None).cast("string")))
    for name, stage in P.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns
        if name not in ("language_id", "near_dedup"):  # those train on, or compare with, the rest
            alone = sorted(str((r.doc_id, r.text)) for r in stage(spark, some, SF).collect())
            again = stage(spark, twice, SF).collect()
            if name != "mix_sources":  # whose quotas follow from all rows
                small = sorted(str((r.doc_id, r.text)) for r in stage(spark, some.where("doc_id < 5"), SF).collect())
                assert sorted(str((r.doc_id, r.text)) for r in again if r.text is not None) == sorted(alone + small) and len(again) == twice.count()
            else:
                shares = {}
                for r in again:
                    shares[r.doc_id, r.text] = shares.get((r.doc_id, r.text), 0) + 1
                assert all(n % 2 == 0 and n <= 6 for (i, t), n in shares.items() if i < 5 and t is not None)
