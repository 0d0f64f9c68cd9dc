"""Near copies of the pipeline's stage against exact Jaccard similarities of all pairs."""

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from hypsoline.llm import nearcopies, simhash
from hypsoline.llm.common import sieved

from .test_operators import DOC, SF


def brute_components(texts):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            x, y = sets[a], sets[b]
            if a < b and (x == y or 10 * len(x & y) >= 8 * len(x | y)):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in texts}


@pytest.fixture(scope="module")
def planted():
    """Texts with copies a few words apart, chains of copies, a common passage, short, empty and null texts."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage, texts = word(40), []
    for _ in range(12):
        base = word(int(rng.integers(8, 200)))
        texts.append(base)
        for _ in range(int(rng.integers(1, 9))):
            base = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(1, 4))):
                base[at] = f"x{rng.integers(0, 10**9)}"
            texts.append(base)
    texts += [word(int(n)) + passage for n in rng.integers(0, 60, 15)]
    out = [" ".join(t) for t in texts] + ["one two", "ONE  two", "one", "", " \n", None]
    return dict(enumerate(out, 1))


@pytest.mark.parametrize("cell, block, tiny", [(nearcopies.CELL, nearcopies.BLOCK, nearcopies.TINY), (5, 1000, (3, 300))])
def test_components_are_those_of_all_pairs(spark, planted, monkeypatch, cell, block, tiny):
    monkeypatch.setattr(nearcopies, "TINY", tiny)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in planted.items()], DOC)
    want = brute_components(planted)
    got = nearcopies.near_copies(docs, cell=cell, block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(want)
    assert len({r.root for r in got}) == len(set(want.values())) and 12 < len(set(want.values())) < len(want)


def test_stage_takes_near_copies_that_two_bits_miss(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = set(brute_components({r.doc_id: r.text for r in docs.collect()}).values())
    got = [r.doc_id for r in P.near_dedup(spark, docs, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) < simhash.keep_one(docs).count()


def test_radius_holds_similar_pairs_and_pivots_lose_none():
    rng = np.random.default_rng(8)
    far = []
    for n in (5, 9, 20, 100, 1000):
        for _ in range(300):
            x = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            gone = n - -(-4 * n // 5)  # A is part of B, of a similarity of 0.8 at least
            far.append(int(np.bitwise_count(nearcopies.wide_print(np.sort(x[:n])) ^ nearcopies.wide_print(np.sort(x[gone:n]))).sum()))
    assert np.mean(np.array(far) > nearcopies.RADIUS) < 0.002
    prints = rng.integers(0, 2**64, (300, nearcopies.PARTS), dtype=np.uint64)
    for i in range(100, 300):  # clouds around some of them
        prints[i] = prints[i % 40] ^ (rng.integers(0, 2**64, 4, dtype=np.uint64) & rng.integers(0, 2**64, 4, dtype=np.uint64) & rng.integers(0, 2**64, 4, dtype=np.uint64))
    columns = [np.full(300, 10), *prints.T.view(np.int64)]
    found = nearcopies.link_prints(columns)
    near = np.bitwise_count(prints[:, None] ^ prints).sum(axis=2) <= nearcopies.RADIUS
    assert labels_of(300, found) == labels_of(300, list(zip(*np.nonzero(near)))) and len(found) > 50


def labels_of(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_near_dedup_of_odd_rows(spark):
    long = "one two three four five six seven eight nine ten eleven twelve. " * 3000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A  b c"), (6, long), (7, long + "x"), (7, "other words in this text here"), (None, "a b c"), (None, None)]
    rows += [(8, "some other text of a few words that occurs again")] * 3 + [(9, "the same id on different texts, the first"), (9, "something else entirely under the id nine again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("_flag", F.lit(2)).withColumn("key", F.lit(3)).withColumn("a.b", F.lit(4))
    kept = P.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = [rows[0], rows[3], rows[5], rows[7], rows[8], rows[9], rows[10], rows[13], rows[14]]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in P.near_dedup(spark, docs.repartition(5), SF).collect()))) == sorted(map(repr, want))
    assert P.near_dedup(spark, docs.where("doc_id < 0"), SF).count() == 0


def test_sieve_keeps_every_key(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"), "id").unionByName(spark.createDataFrame([(None, -1)], "h long, id long"))
    keys = df.where("id % 7 = 0").select("h")
    rows = sieved(df, "h", keys, "flag").collect()
    assert len(rows) == 5001 and all(r.flag for r in rows if r.id % 7 == 0) and sum(r.flag for r in rows) < 1.1 * 715 and not any(r.flag for r in rows if r.id == -1)
    assert not any(r.flag for r in sieved(df, "h", keys.where("h is null"), "flag").collect())
