"""The scoring chain: worked examples by hand, ties, nulls, dense counts, spacing."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from hypsoline.operators import scoring as S


def plain(i, a, n, r):
    """The same arithmetic on Python numbers."""
    d = statistics.stdev([i, a, n, r])
    mean = (i + a + n + r) / 4
    if n > 60 and (i < 40 or a < 40):
        return min(100, 50 + 2 * (n - mean) + 1.5 * (mean - (i + a) / 2)), d
    return (max(0, 50 - 2 * d) if d < 15 else 50 + 1.5 * (d - 15)), d


CASES = [(0, 15, 35, 15), (80, 60, 90, 10), (20, 10, 95, 30), (50, 50, 50, 50), (0, 0, 100, 100), (25, 5, 30, 5), (3, 2, 10, 90), (10, 12, 40, 15), (30, 40, 40, 40), (100, 0, 0, 100)]


def test_chart_columns(spark):
    df = spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(CASES)], "tech_id int, innovation double, adoption double, narrative double, risk double")
    for r in S.chart_columns(df).collect():
        h, d = plain(*CASES[r.tech_id])
        assert math.isclose(r.hype, h, abs_tol=1e-9) and math.isclose(r.divergence, d, abs_tol=1e-9)
    worked = S.chart_columns(df).where("tech_id = 0").first()
    assert round(worked.hype, 6) == 21.277187 and worked.phase == "Trough of Disillusionment" and worked.phase_confidence == 0.85


def test_phases_in_order(spark):
    df = spark.createDataFrame([(30.0, 10.0, 30.0, 50.0, 50.0), (10.0, 10.0, 50.0, 50.0, 45.0), (10.0, 12.0, 40.0, 20.0, 50.0), (15.0, 30.0, 50.0, 60.0, 30.0), (1.0, 1.0, 10.0, 90.0, 90.0), (10.0, 10.0, 30.0, 90.0, 60.0), (60.0, 60.0, 60.0, 60.0, 60.0)], "i double, a double, n double, r double, h double")
    got = [x[0] for x in df.select(S.phase(*[F.col(c) for c in "ianrh"])).collect()]
    assert got == ["innovation_trigger", "peak", "plateau", "slope", "trough", "trough", "slope"]


def test_missing_scores_count_fifty(spark):
    r = S.chart_columns(spark.createDataFrame([(1, None, None, None, None)], "tech_id int, innovation double, adoption double, narrative double, risk double")).first()
    assert r.hype == 50.0 and r.divergence == 0.0 and r.phase_code == "slope" and r.phase_confidence == 0.45


def chart(spark, rows):
    cols = "tech_id int, name string, phase string, phase_confidence double, innovation double, adoption double, narrative double, risk double, hype double, n_patents int, n_papers int, n_news int, n_evidence int"
    return spark.createDataFrame(rows, cols)


def test_normalised_positions(spark):
    rows = [(i, f"t{i}", "Plateau of Productivity", 0.5, 0.0, float(i // 2), 0.0, 0.0, 0.0, 0, 0, 0, 0) for i in range(6)] + [(9, "evtol", "Plateau of Productivity", 0.5, 0.0, 99.0, 0.0, 0.0, 0.0, 0, 0, 0, 0), (7, "one", "Peak of Inflated Expectations", 0.5, 0.0, 1.0, 0.0, 0.0, 0.0, 0, 0, 0, 0)]
    got = {r.tech_id: r for r in S.normalize_chart(chart(spark, rows), 5).collect()}
    assert 9 not in got and len(got) == 6
    assert [t for t, r in sorted(got.items(), key=lambda kv: kv[1].phase_rank) if r.phase.startswith("Plateau")] == [4, 5, 2, 3, 0]
    assert got[4].chart_x == pytest.approx(4.9) and got[0].chart_x == pytest.approx(4.3) and got[7].chart_x == pytest.approx(1.05) and got[7].phase_position == "mid"


def test_spacing_is_the_sequential_push(spark):
    xs = [4.9, 4.89, 4.88, 4.5, 4.49, 4.31, 4.305]
    rows = [(i, f"t{i}", "Plateau of Productivity") for i in range(len(xs))]
    df = spark.createDataFrame([(*r, x) for r, x in zip(rows, xs)], "tech_id int, name string, phase string, chart_x double")
    want, before = [], None
    for x in xs:
        x = x if before is None else min(x, before - 0.05)
        x = max(x, 4.3)
        want.append(x)
        before = x
    got = [r.chart_x for r in S.spaced(df).orderBy("tech_id").collect()]
    assert got == pytest.approx(want)


def test_errors_and_counts(spark):
    rows = [(1, "a", "Peak of Inflated Expectations", 0.5, 0.0, 1.0, 0.0, 0.0, 114.0, 0, 0, 0, 0), (2, "b", "Nowhere", 0.5, None, 1.0, 0.0, 0.0, 0.0, 0, 0, 0, 0)]
    df = chart(spark, rows).withColumn("chart_x", F.lit(1.0))
    got = {r.tech_id: r.errors for r in S.errors(df).collect()}
    assert got[1] == ["hype out of range"] and got[2] == ["chart_x outside its phase", "unknown phase"]
    counts = S.phase_counts(df).first()
    assert counts.total == 2 and counts.n_peak == 1 and counts.n_slope == 0
    assert S.phase_counts(df.where("tech_id > 5")).first().total == 0
