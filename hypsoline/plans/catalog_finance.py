"""Registered queries: holdings, insiders, composite scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finance as N
from ..registry import register


def rounded(df, **digits):
    return df.withColumns({k: F.round(k, v) for k, v in digits.items()})


QUARTERS = """i AS (SELECT cusip, period, institution, sum(shares) AS s, sum(value) AS v, count(*) AS n FROM holdings GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY cusip, period ORDER BY s DESC, institution) AS r FROM i),
q AS (SELECT cusip, period, sum(s) AS total_shares, sum(v) AS total_value, sum(n)::BIGINT AS holdings_, count(*) AS institutions, sum(CASE WHEN r <= 10 THEN s END) / sum(s) * 100 AS top10_pct FROM r GROUP BY 1, 2),
c AS (SELECT *, lag(total_shares) OVER (PARTITION BY cusip ORDER BY period) AS before FROM q)"""
register("fin5_quarters", lambda m: rounded(N.by_quarter(m.holdings), total_value=2, top10_pct=6, change_pct=6), f"""{QUARTERS}
SELECT cusip, period, total_shares, round(total_value, 2) AS total_value, holdings_ AS holdings, institutions, round(top10_pct, 6) AS top10_pct, total_shares - before AS share_change, round(CASE WHEN before > 0 THEN (total_shares - before) / before * 100 END, 6) AS change_pct FROM c""")
register("fin6_top_holders", lambda m: rounded(N.top_holders(m.holdings), pct=6), """SELECT cusip, period, institution, shares, round(pct, 6) AS pct, rank FROM (SELECT *, shares / sum(shares) OVER (PARTITION BY cusip, period) * 100 AS pct,
row_number() OVER (PARTITION BY cusip, period ORDER BY shares DESC, institution)::INT AS rank FROM (SELECT cusip, period, institution, sum(shares) AS shares FROM holdings GROUP BY 1, 2, 3) t) u WHERE rank <= 10""")
register("fin8_signals", lambda m: rounded(N.signals(N.by_quarter(m.holdings)), avg_change=6), f"""{QUARTERS}, d AS (SELECT cusip, period, (total_shares - before) / before * 100 AS p FROM c WHERE before > 0),
e AS (SELECT cusip, avg(p) AS a FROM (SELECT *, row_number() OVER (PARTITION BY cusip ORDER BY period DESC) AS n FROM d) t WHERE n <= 3 GROUP BY 1)
SELECT cusip, round(a, 6) AS avg_change, CASE WHEN a > 5 THEN 'accumulation' WHEN a < -5 THEN 'distribution' ELSE 'stable' END AS signal, CASE WHEN a > 5 THEN 'bullish' WHEN a < -5 THEN 'bearish' ELSE 'neutral' END AS sentiment,
CASE WHEN a > 5 THEN 'low' WHEN a < -5 THEN 'high' ELSE 'medium' END AS risk FROM e""")
register("fin2_quarter_list", lambda m: m.holdings.select("period").distinct(), "SELECT DISTINCT period FROM holdings")
register("fin3_normalized_value", lambda m: m.holdings.select("accession", "line", F.round(N.normalize_value(F.col("value"), F.date_add("filing_date", 9000)), 2).alias("value")),
         "SELECT accession, line, round(CASE WHEN filing_date + 9000 < DATE '2023-01-03' THEN value * 1000 ELSE value END, 2) AS value FROM holdings")
register("fin4_holdings_stats", lambda m: m.holdings.agg(F.count("*").alias("n"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.countDistinct("period").alias("periods")), "SELECT count(*) AS n, min(period) AS first_period, max(period) AS last_period, count(DISTINCT period) AS periods FROM holdings")
register("fin7_deadline", lambda m: m.holdings.select("period", F.date_add("period", 45).alias("deadline")).distinct(), "SELECT DISTINCT period, period + 45 AS deadline FROM holdings")


def thirteen_f(m):
    info = m.lineitem.select(F.col("l_orderkey").alias("ACCESSION_NUMBER"), F.col("l_partkey").cast("string").alias("CUSIP"), F.col("l_extendedprice").alias("VALUE"))
    sub = m.orders.select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("PERIODOFREPORT"), F.when(F.col("o_orderpriority") != "5-LOW", "13F-HR").otherwise("13F-NT").alias("SUBMISSIONTYPE"))
    cover = m.orders.select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), F.col("o_custkey").alias("manager"))
    return N.holdings_by_cusip(info, sub, cover, [str(i) for i in range(1, 40)], "1996-01-01", "1999-12-31").select(F.col("ACCESSION_NUMBER").alias("accession"), F.col("CUSIP").alias("cusip"), "period", "manager", F.col("VALUE").alias("value"))


register("fin1_holdings_by_cusip", thirteen_f, """SELECT l_orderkey AS accession, l_partkey::VARCHAR AS cusip, o_orderdate::DATE AS period, o_custkey AS manager, l_extendedprice AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_partkey BETWEEN 1 AND 39 AND o_orderpriority <> '5-LOW' AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
PRICED = "CASE WHEN price > 0 THEN shares * price ELSE 0 END"
INSIDER = f"""count_if(code = 'P')::BIGINT AS purchases, count_if(code = 'S')::BIGINT AS sales, coalesce(sum(CASE WHEN code = 'P' THEN shares END), 0)::DOUBLE AS shares_bought, coalesce(sum(CASE WHEN code = 'S' THEN shares END), 0)::DOUBLE AS shares_sold,
round(coalesce(sum(CASE WHEN code = 'P' THEN {PRICED} END), 0), 2)::DOUBLE AS value_bought, round(coalesce(sum(CASE WHEN code = 'S' THEN {PRICED} END), 0), 2)::DOUBLE AS value_sold,
round(coalesce(avg(CASE WHEN code = 'P' AND price > 0 THEN price END), 0), 6)::DOUBLE AS avg_buy, round(coalesce(avg(CASE WHEN code = 'S' AND price > 0 THEN price END), 0), 6)::DOUBLE AS avg_sell, count(DISTINCT owner) AS insiders,
count(DISTINCT CASE WHEN contains(relationship, 'OFFICER') THEN owner END) AS officers, count(DISTINCT CASE WHEN contains(relationship, 'DIRECTOR') THEN owner END) AS directors, count(DISTINCT CASE WHEN contains(relationship, 'TENPERCENTOWNER') THEN owner END) AS owners,
min(trans_date) AS first_date, max(trans_date) AS last_date"""
INSIDER_DIGITS = {"value_bought": 2, "value_sold": 2, "avg_buy": 6, "avg_sell": 6}
register("fin12_insider_summary", lambda m: rounded(N.insider_metrics(m.insider, ["ticker"]), **INSIDER_DIGITS).drop("net_value"), f"SELECT *, shares_bought - shares_sold AS net_shares FROM (SELECT ticker, {INSIDER} FROM insider WHERE code IN ('P', 'S') GROUP BY ticker) t")
register("fin13_insider_months", lambda m: rounded(N.insider_metrics(m.insider.withColumn("month", F.date_format("trans_date", "yyyy-MM")), ["month"]), **INSIDER_DIGITS).drop("net_value"), f"SELECT *, shares_bought - shares_sold AS net_shares FROM (SELECT strftime(trans_date, '%Y-%m') AS month, {INSIDER} FROM insider WHERE code IN ('P', 'S') GROUP BY 1) t")
register("fin14_top_insiders", lambda m: rounded(N.top_insiders(m.insider, "P"), avg_price=4, value=0, pct=6), f"""SELECT owner, shares, round(avg_price, 4) AS avg_price, trades, round(value, 0) AS value, round(shares / total * 100, 6) AS pct FROM (SELECT *, sum(shares) OVER () AS total FROM
(SELECT owner, sum(shares) AS shares, avg(price) AS avg_price, count(*) AS trades, sum({PRICED}) AS value FROM insider WHERE code = 'P' GROUP BY 1) t) u ORDER BY shares DESC, owner LIMIT 10""")
register("fin11_roles", lambda m: m.insider.select("relationship", N.role_text(F.col("relationship")).alias("role")).distinct(), "SELECT DISTINCT relationship, CASE WHEN relationship IS NULL THEN 'Unknown' WHEN relationship = 'OFFICER' THEN 'Officer' WHEN relationship = 'DIRECTOR' THEN 'Director' ELSE 'Director, 10% Owner' END AS role FROM insider")
register("fin15_details", lambda m: rounded(N.trade_details(m.insider.where("code IN ('P', 'S')"), F.when(F.col("line") == 1, "E").when(F.col("line") == 2, "L")), value=2), f"""SELECT ticker, owner, trans_date, CASE code WHEN 'P' THEN 'Purchase' ELSE 'Sale' END AS kind, CASE line WHEN 1 THEN 'Early' WHEN 2 THEN 'Late' ELSE 'On-time' END AS timeliness, round({PRICED}, 2)::DOUBLE AS value,
CASE WHEN relationship IS NULL THEN 'Unknown' WHEN relationship = 'OFFICER' THEN 'Officer' WHEN relationship = 'DIRECTOR' THEN 'Director' ELSE 'Director, 10% Owner' END AS role FROM insider WHERE code IN ('P', 'S')""")
register("fin9_trades_by_ticker", lambda m: m.insider.where(F.col("ticker").isin(1, 2, 3) & F.col("code").isin("P", "S") & F.col("trans_date").between("1996-01-01", "1999-12-31")).join(m.supplier.select(F.col("s_suppkey").alias("owner"), F.col("s_name").alias("owner_name")), "owner").select("ticker", "owner_name", "code", "trans_date", "shares", "accession", "line"),
         "SELECT ticker, s_name AS owner_name, code, trans_date, shares, accession, line FROM insider JOIN supplier ON s_suppkey = owner WHERE ticker IN (1, 2, 3) AND code IN ('P', 'S') AND trans_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
register("fin10_code_stats", lambda m: m.insider.groupBy("code").agg(F.count("*").alias("n"), F.min("trans_date").alias("first_date"), F.max("trans_date").alias("last_date")), "SELECT code, count(*) AS n, min(trans_date) AS first_date, max(trans_date) AS last_date FROM insider GROUP BY code")


def scholarly(m):
    papers = m.part.select(F.col("p_partkey").alias("lens_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 11 != 0, F.lit(2000) + F.col("p_size")).alias("year_published"))
    rel = m.part.select(F.col("p_partkey").alias("lens_id"), (F.col("p_partkey") % 101 / 10.0).alias("relevance_score"), (F.col("p_partkey") % 3 != 0).alias("is_relevant"))
    pick = lambda n, *vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (F.col("p_partkey") % n).cast("int") + 1)
    sig = m.part.select(F.col("p_partkey").alias("lens_id"), pick(4, "very_high", "high", "medium", "low").alias("impact_potential"), pick(5, "breakthrough", "incremental_breakthrough", "incremental", "none", "other").alias("innovation_type"))
    meta = m.part.select(F.col("p_partkey").alias("lens_id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 150).alias("references_count"))
    return papers, rel, sig, meta


COMPOSITE = """SELECT p_partkey AS lens_id, round(0.4::DOUBLE * ((p_partkey % 101 / 10.0::DOUBLE - 8.0::DOUBLE) / 1.0::DOUBLE) +
0.2::DOUBLE * (CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.1 END::DOUBLE) + 0.2::DOUBLE * (CASE WHEN p_partkey % 7 = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, p_partkey % 150 / 100.0::DOUBLE) END) +
0.1::DOUBLE * (CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.1 END::DOUBLE) + 0.1::DOUBLE * (CASE WHEN p_partkey % 11 = 0 THEN 0.5::DOUBLE ELSE (2000 + p_size - 2010) / 15.0::DOUBLE END), 9) AS composite_score
FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 101 / 10.0::DOUBLE >= 8"""
register("fin16_composite_papers", lambda m: N.composite_papers(*scholarly(m)).select("lens_id", "composite_score"), f"SELECT lens_id, composite_score FROM ({COMPOSITE}) t ORDER BY composite_score DESC, lens_id LIMIT 200")
register("fin17_relevance_range", lambda m: scholarly(m)[1].where(F.col("relevance_score").between(8.0, 9.0)).join(scholarly(m)[0], "lens_id").select("lens_id", "relevance_score"), "SELECT p_partkey AS lens_id, p_partkey % 101 / 10.0::DOUBLE AS relevance_score FROM part WHERE p_partkey % 101 BETWEEN 80 AND 90")
register("fin18_subgraph", lambda m: m.company_tech.join(m.technologies.where("id <= 10").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "doc_ref"), "SELECT src, dst, doc_ref FROM company_tech WHERE dst <= 10")
register("fin19_relevance_stats", lambda m: scholarly(m)[1].agg(F.count("*").alias("total"), F.count_if("is_relevant").alias("relevant"), F.min("relevance_score").alias("least"), F.max("relevance_score").alias("most"), F.round(F.avg("relevance_score"), 6).alias("mean")), "SELECT count(*) AS total, count_if(p_partkey % 3 <> 0)::BIGINT AS relevant, min(p_partkey % 101 / 10.0::DOUBLE) AS least, max(p_partkey % 101 / 10.0::DOUBLE) AS most, round(avg(p_partkey % 101 / 10.0::DOUBLE), 6) AS mean FROM part")
register("fin20_top_patents", lambda m: N.top_patents(m.documents_g.where("doc_type = 'patent'").select(F.col("doc_id").alias("patent_id"), F.col("published_at").alias("filed"), (F.col("stars") % 30).alias("family"), F.col("citation_count").alias("citations"))), """
a AS (SELECT doc_id AS patent_id, published_at - DATE '1970-01-01' AS d, ln(1 + stars % 30) AS f, ln(1 + citation_count) AS c FROM documents_g WHERE doc_type = 'patent'), b AS (SELECT min(d) AS d0, max(d) AS d1, max(f) AS f1, max(c) AS c1 FROM a)
SELECT patent_id, round(0.4::DOUBLE * ((d - d0) / (d1 - d0)) + 0.3::DOUBLE * (f / f1) + 0.3::DOUBLE * (c / c1), 9) AS score FROM a, b ORDER BY score DESC, patent_id LIMIT 100""")
register("fin21_composite_stats", lambda m: N.composite_papers(*scholarly(m)).agg(F.round(F.min("composite_score"), 6).alias("least"), F.round(F.max("composite_score"), 6).alias("most"), F.count("*").alias("n")),
         f"SELECT round(min(composite_score), 6) AS least, round(max(composite_score), 6) AS most, count(*) AS n FROM (SELECT composite_score FROM ({COMPOSITE}) t ORDER BY composite_score DESC, lens_id LIMIT 200) u")
register("fin22_ticker_map", lambda m: m.insider.select("ticker").distinct().join(m.part.select(F.col("p_partkey").alias("ticker"), F.concat(F.lit("CU"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("cusip")).where("ticker % 2 = 0"), "ticker", "left"), "SELECT DISTINCT ticker, CASE WHEN ticker % 2 = 0 THEN 'CU' || lpad(ticker::VARCHAR, 7, '0') END AS cusip FROM insider")
