"""Scores, phases and chart positions: arithmetic on columns, ranks by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Phase code -> (display name, least x, largest x, factor of y).
PHASES = {
    "innovation_trigger": ("Innovation Trigger", 0.0, 0.7, 0.8),
    "peak": ("Peak of Inflated Expectations", 0.7, 1.4, 1.3),
    "trough": ("Trough of Disillusionment", 1.4, 2.7, 0.5),
    "slope": ("Slope of Enlightenment", 2.7, 4.2, 0.9),
    "plateau": ("Plateau of Productivity", 4.2, 5.0, 0.85),
}
#: Names too general to chart.
GENERIC = ("evtol", "evtol_technology", "advanced_air_mobility", "unmanned_aerial_vehicle_uav", "urban_air_mobility", "drone_delivery")
PADDING = 0.1
LEAST_SPACING = 0.05
SCORES = ("innovation", "adoption", "narrative", "risk")


def clamp(x: Column, least: float = 0.0, most: float = 100.0) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), x))


def innovation_rule(patents: Column, cites: Column, papers: Column, paper_cites: Column, repos: Column, stars: Column) -> Column:
    """A linear stand-in for a model's judgement; any Column or pandas UDF may take its place."""
    return clamp(5 * patents + 0.1 * cites + 3 * papers + 0.2 * paper_cites + 2 * repos + 0.05 * stars)


def adoption_rule(contracts: Column, millions: Column, approvals: Column, revenue_companies: Column) -> Column:
    return clamp(8 * contracts + 0.5 * millions + 12 * approvals + 15 * revenue_companies)


def narrative_rule(news: Column, sentiment: Column, prominence: Column) -> Column:
    return clamp(1.5 * news + 20 * sentiment + 30 * prominence)


def risk_rule(mentions: Column, selling: Column) -> Column:
    return clamp(10 * mentions + 5 * (selling / 10e6))


def _sample_std(values: list[Column]) -> Column:
    mean = sum(values[1:], values[0]) / len(values)
    return F.sqrt(sum(((v - mean) * (v - mean) for v in values[1:]), (values[0] - mean) * (values[0] - mean)) / (len(values) - 1))


def hype(i: Column, a: Column, n: Column, r: Column) -> tuple[Column, Column]:
    """(hype score, divergence). Where the narrative runs ahead of weak fundamentals the score grows with its lead;
    else it follows the spread of the four scores. The last branch has no upper bound."""
    spread = _sample_std([i, a, n, r])
    mean = (i + a + n + r) / 4
    ahead = F.least(F.lit(100.0), 50 + (n - mean) * 2 + (mean - (i + a) / 2) * 1.5)
    calm = F.greatest(F.lit(0.0), 50 - spread * 2)
    score = F.when((n > 60) & ((i < 40) | (a < 40)), ahead).when(spread < 15, calm).otherwise(50 + (spread - 15) * 1.5)
    return score, spread


def hype_confidence(spread: Column, i: Column, n: Column) -> Column:
    return F.when((spread > 20) | (F.abs(n - i) > 30), "high").otherwise("medium")


def phase(i: Column, a: Column, n: Column, r: Column, h: Column) -> Column:
    """The first rule that holds."""
    weak = sum((c.cast("int") for c in (a < 18, i < 18, h < 28)), (n < 35).cast("int"))
    return (
        F.when((i > 20) & (a < 25) & (n < 45), "innovation_trigger")
        .when((n > 45) & (h > 40) & (a < 25), "peak")
        .when((a >= 10) & (i >= 5) & (n <= 45) & (r <= 20), "plateau")
        .when((a > 20) & (i > 12) & (n > 20) & (h < 50), "slope")
        .when((i < 5) & (a < 5) & (n < 20), "trough")
        .when(weak >= 3, "trough")
        .otherwise("slope")
    )


def phase_confidence(i: Column, a: Column, n: Column) -> Column:
    spread = F.greatest(i, a, n) - F.least(i, a, n)
    return F.when(spread > 30, 0.85).when(spread > 15, 0.65).otherwise(0.45)


def _by_phase(code: Column, at: int, default: str = "slope") -> Column:
    out = F.lit(PHASES[default][at])
    for k, v in PHASES.items():
        out = F.when(code == k, F.lit(v[at])).otherwise(out)
    return out


def phase_position(i: Column, a: Column, r: Column) -> Column:
    maturity = 0.3 * i + 0.4 * a + 0.3 * (100 - r)
    return F.when(maturity < 30, "early").when(maturity < 50, "mid").otherwise("late")


def chart_columns(df: DataFrame, digits: int = 2) -> DataFrame:
    """From (tech_id, innovation, adoption, narrative, risk), nulls as 50: hype, phase, confidence and position."""
    out = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(50.0)) for c in SCORES})
    i, a, n, r = (F.col(c) for c in SCORES)
    score, spread = hype(i, a, n, r)
    out = out.withColumns({"hype": score, "divergence": spread}).withColumns({"hype_confidence": hype_confidence(F.col("divergence"), i, n), "phase_code": phase(i, a, n, r, F.col("hype")), "phase_confidence": phase_confidence(i, a, n), "phase_position": phase_position(i, a, r)})
    code = F.col("phase_code")
    low, high = _by_phase(code, 1), _by_phase(code, 2)
    part = F.when(F.col("phase_position") == "early", 0.25).when(F.col("phase_position") == "mid", 0.5).otherwise(0.75)
    y = F.least(F.lit(100.0), (n * 0.7 + i * 0.2 + a * 0.1) * _by_phase(code, 3))
    weighted = 0.3 * i + 0.35 * a + 0.15 * n + 0.2 * (100 - r)
    return out.withColumns({"phase": _by_phase(code, 0), "chart_x": F.round(low + (high - low) * part, 3), "chart_y": F.round(y, digits), "weighted_score": F.round(weighted, digits)})


def in_range(phase_name: Column, x: Column, tolerance: float = 0.05) -> Column:
    out = F.lit(False)
    for name, low, high, _ in PHASES.values():
        out = F.when(phase_name == name, (x >= low - tolerance) & (x <= high + tolerance)).otherwise(out)
    return out


def errors(df: DataFrame) -> DataFrame:
    """Adds errors array<string>: missing fields, scores outside 0-100, x outside its phase, unknown values."""
    checks = [F.when(F.col(c).isNull(), f"missing {c}") for c in ("tech_id", "phase", "chart_x")]
    checks += [F.when((F.col(c) < 0) | (F.col(c) > 100), f"{c} out of range") for c in (*SCORES, "hype")]
    checks += [F.when(~in_range(F.col("phase"), F.col("chart_x")), "chart_x outside its phase"), F.when(~F.col("phase").isin([v[0] for v in PHASES.values()]), "unknown phase")]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def ranking_score(df: DataFrame) -> Column:
    """The order within a phase; evidence columns n_patents, n_papers, n_news, n_evidence count as given."""
    i, a, n, r = (F.col(c) for c in SCORES)
    c, h = F.col("phase_confidence"), F.col("hype")
    p = F.col("phase")
    return (
        F.when(p == "Innovation Trigger", i * 10 + c * 5 + (F.col("n_patents") + F.col("n_papers")) * 0.1)
        .when(p == "Peak of Inflated Expectations", (n + h) / 2 * 10 + c * 5 + F.col("n_news") * 0.1)
        .when(p == "Trough of Disillusionment", (i + a) / 2 * 10 + c * 5 + F.col("n_evidence") * 0.1)
        .when(p == "Slope of Enlightenment", F.col("n_papers") * 25 + F.col("n_patents") * 8 + n * 2 + a * 3 + c * 20)
        .when(p == "Plateau of Productivity", a * 10 + (100 - r) * 5 + c * 2)
        .otherwise((i + a + n) / 3 * 10 + c * 5)
    )


def normalize_chart(df: DataFrame, top_n: int = 10, name: str = "name") -> DataFrame:
    """The best top_n of each phase, spread evenly from its right end; equal ranking scores by tech_id.

    Positions are named by parts (0.4, 0.7) of the padded width, counted from the unpadded start of the phase.
    """
    df = df.where(~F.col(name).isin(list(GENERIC)))
    w = Window.partitionBy("phase").orderBy(F.desc("ranking_score"), "tech_id")
    df = df.withColumn("ranking_score", F.round(ranking_score(df), 6)).withColumn("phase_rank", F.row_number().over(w)).where(F.col("phase_rank") <= top_n)
    k = F.count("*").over(Window.partitionBy("phase"))
    low, high = (phase_bound(F.col("phase"), at) for at in (1, 2))
    width = high - low - 2 * PADDING
    x = F.when(k == 1, low + PADDING + width * 0.5).otherwise(low + PADDING + width * (k - F.col("phase_rank")) / (k - 1))
    out = df.withColumn("chart_x", x)
    out = spaced(out) if top_n > 11 else out
    share = (F.col("chart_x") - low) / width
    return out.withColumn("phase_position", F.when(share < 0.4, "early").when(share < 0.7, "mid").otherwise("late")).withColumn("chart_x", F.round("chart_x", 6))


def phase_bound(phase_name: Column, at: int) -> Column:
    out = F.lit(None).cast("double")
    for v in PHASES.values():
        out = F.when(phase_name == v[0], F.lit(v[at])).otherwise(out)
    return out


def spaced(df: DataFrame, least: float = LEAST_SPACING) -> DataFrame:
    """Keeps neighbours of a phase at least `least` apart, pushed left from the rightmost, and not left of its start.

    x_i = min(x_i, x_(i-1) - least) unrolls to a running minimum of x_j - (i - j) * least, which a window gives.
    """
    w = Window.partitionBy("phase").orderBy(F.desc("chart_x"), "tech_id")
    i = F.row_number().over(w)
    out = df.withColumn("_i", i)
    low = F.min(F.col("chart_x") + F.col("_i") * least).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_i") * least
    return out.withColumn("chart_x", F.greatest(low, phase_bound(F.col("phase"), 1) + PADDING)).drop("_i")


def phase_counts(df: DataFrame) -> DataFrame:
    """One row: dense counts of the five phases and the total."""
    return df.agg(*[F.count_if(F.col("phase") == v[0]).alias(f"n_{k}") for k, v in PHASES.items()], F.count("*").alias("total"))
