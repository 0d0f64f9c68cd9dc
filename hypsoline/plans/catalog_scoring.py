"""Registered queries: scores, phases and the chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import layers as L
from ..operators import scoring as S
from ..registry import register
from .catalog_layers import HALF, MD, START, window
from .model import AS_OF


def scores(m) -> DataFrame:
    """The four layer scores of every technology by the linear rules, from one pass over mentions and documents."""
    from ..operators.basics import between, good

    d = good(m.mention_docs).where(between(F.col("published_at"), START, AS_OF))
    is_ = lambda t, *roles: (F.col("doc_type") == t) & (F.col("role").isin(list(roles)) if roles else F.lit(True))
    patent, paper, repo, contract = is_("patent", "invented"), is_("technical_paper", "invented", "studied"), is_("github"), is_("government_contract", "deployed", "funded", "researched")
    news = is_("news", "subject") & (F.col("published_at") >= HALF)
    risky = is_("sec_filing") & (F.col("risk_factor_mentioned") | F.col("evidence_text").contains("risk")) & (F.col("published_at") >= HALF)
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    agg = d.groupBy("tech_id").agg(
        F.count_if(patent).alias("n_patents"), total(patent, "citation_count").alias("patent_cites"), F.count_if(paper).alias("n_papers"), total(paper, "citation_count").alias("paper_cites"),
        F.count_if(repo).alias("n_repos"), total(repo, "stars").alias("stars"), F.count_if(contract).alias("n_contracts"), (total(contract, "award_amount") / 1e6).alias("millions"),
        F.count_if(is_("regulation", "regulated")).alias("n_approvals"), F.count_if(news).alias("n_news"), F.count_if(news & (F.col("outlet_tier") == "Industry Authority")).alias("n_top"),
        F.count_if(risky).alias("n_risks"), F.count_if(is_("sec_filing")).alias("n_filings"),
    )
    t = m.technologies.select(F.col("id").alias("tech_id"), "name", "domain").join(agg, "tech_id", "left").fillna(0)
    t = t.withColumns({
        "innovation": F.round(S.innovation_rule(F.col("n_patents"), F.col("patent_cites"), F.col("n_papers"), F.col("paper_cites"), F.col("n_repos"), F.col("stars")), 2),
        "adoption": F.round(S.adoption_rule(F.col("n_contracts"), F.col("millions"), F.col("n_approvals"), F.lit(0)), 2),
        "narrative": F.round(S.narrative_rule(F.col("n_news"), F.lit(0.0), F.when(F.col("n_news") > 0, F.col("n_top") / F.col("n_news")).otherwise(0.0)), 2),
        "risk": F.round(S.risk_rule(F.col("n_risks"), F.lit(0.0)), 2),
    })
    return t.withColumn("n_evidence", F.col("n_patents") + F.col("n_papers") + F.col("n_repos") + F.col("n_news") + F.col("n_filings"))


def chart(m) -> DataFrame:
    """The flagship: scores, hype, phase, position and evidence of every technology."""
    return S.chart_columns(scores(m))


PATENT, PAPER, CONTRACT = "doc_type = 'patent' AND role = 'invented'", "doc_type = 'technical_paper' AND role IN ('invented', 'studied')", "doc_type = 'government_contract' AND role IN ('deployed', 'funded', 'researched')"
NEWS = f"doc_type = 'news' AND role = 'subject' AND published_at >= DATE '{HALF}'"
RISKY = f"doc_type = 'sec_filing' AND (risk_factor_mentioned OR evidence_text LIKE '%risk%') AND published_at >= DATE '{HALF}'"
SCORES_SQL = f"""
a AS (SELECT tech_id, count_if({PATENT}) AS n_patents, coalesce(sum(CASE WHEN {PATENT} THEN citation_count END), 0) AS patent_cites, count_if({PAPER}) AS n_papers, coalesce(sum(CASE WHEN {PAPER} THEN citation_count END), 0) AS paper_cites,
count_if(doc_type = 'github') AS n_repos, coalesce(sum(CASE WHEN doc_type = 'github' THEN stars END), 0) AS stars, count_if({CONTRACT}) AS n_contracts, coalesce(sum(CASE WHEN {CONTRACT} THEN award_amount END), 0) / 1e6 AS millions,
count_if(doc_type = 'regulation' AND role = 'regulated') AS n_approvals, count_if({NEWS}) AS n_news, count_if({NEWS} AND outlet_tier = 'Industry Authority') AS n_top, count_if({RISKY}) AS n_risks, count_if(doc_type = 'sec_filing') AS n_filings
FROM {MD} AND {window()} GROUP BY tech_id),
b AS (SELECT t.id AS tech_id, t.name, t.domain, coalesce(n_patents, 0)::BIGINT AS n_patents, coalesce(patent_cites, 0)::BIGINT AS patent_cites, coalesce(n_papers, 0)::BIGINT AS n_papers, coalesce(paper_cites, 0)::BIGINT AS paper_cites,
coalesce(n_repos, 0)::BIGINT AS n_repos, coalesce(stars, 0)::BIGINT AS stars, coalesce(n_contracts, 0)::BIGINT AS n_contracts, coalesce(millions, 0)::DOUBLE AS millions, coalesce(n_approvals, 0)::BIGINT AS n_approvals,
coalesce(n_news, 0)::BIGINT AS n_news, coalesce(n_top, 0)::BIGINT AS n_top, coalesce(n_risks, 0)::BIGINT AS n_risks, coalesce(n_filings, 0)::BIGINT AS n_filings FROM technologies t LEFT JOIN a ON a.tech_id = t.id),
s AS (SELECT *, round(greatest(0, least(100, 5 * n_patents + 0.1::DOUBLE * patent_cites + 3 * n_papers + 0.2::DOUBLE * paper_cites + 2 * n_repos + 0.05::DOUBLE * stars)), 2)::DOUBLE AS innovation,
round(greatest(0, least(100, 8 * n_contracts + 0.5::DOUBLE * millions + 12 * n_approvals)), 2)::DOUBLE AS adoption,
round(greatest(0, least(100, 1.5::DOUBLE * n_news + 30 * CASE WHEN n_news > 0 THEN n_top / n_news ELSE 0 END)), 2)::DOUBLE AS narrative, round(greatest(0, least(100, 10 * n_risks)), 2)::DOUBLE AS risk,
n_patents + n_papers + n_repos + n_news + n_filings AS n_evidence FROM b),
h0 AS (SELECT *, (innovation + adoption + narrative + risk) / 4 AS mean FROM s),
h1 AS (SELECT *, sqrt(((innovation - mean) * (innovation - mean) + (adoption - mean) * (adoption - mean) + (narrative - mean) * (narrative - mean) + (risk - mean) * (risk - mean)) / 3) AS spread FROM h0),
h AS (SELECT *, CASE WHEN narrative > 60 AND (innovation < 40 OR adoption < 40) THEN least(100, 50 + (narrative - mean) * 2 + (mean - (innovation + adoption) / 2) * 1.5::DOUBLE)
WHEN spread < 15 THEN greatest(0, 50 - spread * 2) ELSE 50 + (spread - 15) * 1.5::DOUBLE END::DOUBLE AS hype FROM h1),
p AS (SELECT *, CASE WHEN innovation > 20 AND adoption < 25 AND narrative < 45 THEN 'innovation_trigger' WHEN narrative > 45 AND hype > 40 AND adoption < 25 THEN 'peak' WHEN adoption >= 10 AND innovation >= 5 AND narrative <= 45 AND risk <= 20 THEN 'plateau'
WHEN adoption > 20 AND innovation > 12 AND narrative > 20 AND hype < 50 THEN 'slope' WHEN innovation < 5 AND adoption < 5 AND narrative < 20 THEN 'trough'
WHEN (narrative < 35)::INT + (adoption < 18)::INT + (innovation < 18)::INT + (hype < 28)::INT >= 3 THEN 'trough' ELSE 'slope' END AS phase_code,
CASE WHEN greatest(innovation, adoption, narrative) - least(innovation, adoption, narrative) > 30 THEN 0.85 WHEN greatest(innovation, adoption, narrative) - least(innovation, adoption, narrative) > 15 THEN 0.65 ELSE 0.45 END::DOUBLE AS phase_confidence,
CASE WHEN 0.3::DOUBLE * innovation + 0.4::DOUBLE * adoption + 0.3::DOUBLE * (100 - risk) < 30 THEN 'early' WHEN 0.3::DOUBLE * innovation + 0.4::DOUBLE * adoption + 0.3::DOUBLE * (100 - risk) < 50 THEN 'mid' ELSE 'late' END AS phase_position FROM h),
d(phase_code, phase, low, high, factor) AS (VALUES {", ".join(f"('{k}', '{v[0]}', {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE)" for k, v in S.PHASES.items())}),
c AS (SELECT p.*, d.phase, d.low, d.high, round(low + (high - low) * CASE phase_position WHEN 'early' THEN 0.25 WHEN 'mid' THEN 0.5 ELSE 0.75 END::DOUBLE, 3) AS chart_x,
round(least(100, (narrative * 0.7::DOUBLE + innovation * 0.2::DOUBLE + adoption * 0.1::DOUBLE) * factor), 6)::DOUBLE AS chart_y,
round(0.3::DOUBLE * innovation + 0.35::DOUBLE * adoption + 0.15::DOUBLE * narrative + 0.2::DOUBLE * (100 - risk), 6) AS weighted_score,
CASE WHEN spread > 20 OR abs(narrative - innovation) > 30 THEN 'high' ELSE 'medium' END AS hype_confidence FROM p JOIN d USING (phase_code))"""

register("sco1_layer_scores", lambda m: scores(m).select("tech_id", *S.SCORES), f"{SCORES_SQL} SELECT tech_id, innovation, adoption, narrative, risk FROM s")
register("sco5_hype", lambda m: chart(m).select("tech_id", F.round("hype", 6).alias("hype"), F.round("divergence", 6).alias("divergence"), "hype_confidence"), f"{SCORES_SQL} SELECT tech_id, round(hype, 6) AS hype, round(spread, 6) AS divergence, hype_confidence FROM c")
register("sco7_phase", lambda m: chart(m).select("tech_id", "phase_code", "phase_confidence"), f"{SCORES_SQL} SELECT tech_id, phase_code, phase_confidence FROM p")
register("sco10_position", lambda m: S.chart_columns(scores(m), 6).select("tech_id", "phase", "phase_position", "chart_x", "chart_y", "weighted_score"), f"{SCORES_SQL} SELECT tech_id, phase, phase_position, chart_x, chart_y, weighted_score FROM c")
register("sco14_full_chart", lambda m: chart(m).select("tech_id", "name", "domain", "phase", "phase_confidence", "chart_x", *S.SCORES, F.round("hype", 6).alias("hype"), "n_patents", "n_papers", "n_news"),
         f"{SCORES_SQL} SELECT tech_id, name, domain, phase, phase_confidence, chart_x, innovation, adoption, narrative, risk, round(hype, 6) AS hype, n_patents, n_papers, n_news FROM c")
register("sco15_phase_counts", lambda m: S.phase_counts(chart(m)), f"{SCORES_SQL} SELECT " + ", ".join(f"count_if(phase_code = '{k}')::BIGINT AS n_{k}" for k in S.PHASES) + ", count(*) AS total FROM c")
register("sco17_errors", lambda m: S.errors(chart(m)).select("tech_id", F.size("errors").alias("n_errors"), F.array_join("errors", ";").alias("errors")),
         f"{SCORES_SQL} SELECT tech_id, (hype > 100)::INT AS n_errors, CASE WHEN hype > 100 THEN 'hype out of range' ELSE '' END AS errors FROM c")
RANKED = f"""{SCORES_SQL}, r0 AS (SELECT *, round(CASE phase_code WHEN 'innovation_trigger' THEN innovation * 10 + phase_confidence * 5 + (n_patents + n_papers) * 0.1::DOUBLE WHEN 'peak' THEN (narrative + hype) / 2 * 10 + phase_confidence * 5 + n_news * 0.1::DOUBLE
WHEN 'trough' THEN (innovation + adoption) / 2 * 10 + phase_confidence * 5 + n_evidence * 0.1::DOUBLE WHEN 'slope' THEN n_papers * 25 + n_patents * 8 + narrative * 2 + adoption * 3 + phase_confidence * 20
ELSE adoption * 10 + (100 - risk) * 5 + phase_confidence * 2 END, 6)::DOUBLE AS ranking_score FROM c),
r1 AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY ranking_score DESC, tech_id)::INT AS phase_rank FROM r0),
r2 AS (SELECT *, count(*) OVER (PARTITION BY phase) AS k, high - low - 0.2::DOUBLE AS width FROM r1 WHERE phase_rank <= 10),
r3 AS (SELECT * EXCLUDE (chart_x, phase_position), CASE WHEN k = 1 THEN low + 0.1::DOUBLE + width * 0.5::DOUBLE ELSE low + 0.1::DOUBLE + width * (k - phase_rank) / (k - 1) END AS x FROM r2)"""
register("sco20_ranks", lambda m: S.normalize_chart(chart(m)).select("tech_id", "phase", "phase_rank", "ranking_score"), f"{RANKED} SELECT tech_id, phase, phase_rank, ranking_score FROM r3")
register("sco24_normalized_chart", lambda m: S.normalize_chart(chart(m)).select("tech_id", "phase", "phase_rank", "chart_x", "phase_position"),
         f"{RANKED} SELECT tech_id, phase, phase_rank, round(x, 6) AS chart_x, CASE WHEN (x - low) / width < 0.4 THEN 'early' WHEN (x - low) / width < 0.7 THEN 'mid' ELSE 'late' END AS phase_position FROM r3")
register("sco25_chart_valid", lambda m: S.normalize_chart(chart(m)).agg(F.bool_and(S.in_range(F.col("phase"), F.col("chart_x"))).alias("valid")), f"{RANKED} SELECT bool_and(x >= low - 0.05 AND x <= high + 0.05) AS valid FROM r3")
register("sco26_graph_metadata", lambda m: L.good(m.mention_docs).groupBy("tech_id").count().agg(*[F.count_if(F.col("count") >= k).alias(f"at_least_{k}") for k in (5, 10, 15, 20)]),
         f"SELECT " + ", ".join(f"count_if(n >= {k})::BIGINT AS at_least_{k}" for k in (5, 10, 15, 20)) + f" FROM (SELECT tech_id, count(*) AS n FROM {MD} GROUP BY 1) t")
