"""The property-graph tables, derived from the star-schema test tables by SQL that both engines read.

Each entry is plain SQL over the raw tables and earlier entries; `Model` builds them as DataFrames on demand, and
`prelude` gives the same as common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-01"
RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL: dict[str, str] = {
    "technologies": """SELECT p_partkey AS id, p_name AS name, p_type AS domain, p_brand AS community, (p_partkey * 37 % 997) / 997.0D AS pagerank,
        CAST(p_partkey * 7 % 500 AS DOUBLE) AS betweenness FROM {part}""",
    "companies": """SELECT s_suppkey AS id, s_name AS name, n_name AS country, 'T' || CAST(s_suppkey AS STRING) AS ticker,
        CASE WHEN s_acctbal > 0 THEN s_acctbal / 10000 END AS pagerank FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "documents_g": """SELECT o_orderkey AS doc_id, CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'patent' WHEN 1 THEN 'technical_paper' WHEN 2 THEN 'government_contract'
        WHEN 3 THEN 'news' WHEN 4 THEN 'sec_filing' WHEN 5 THEN 'regulation' ELSE 'github' END AS doc_type,
        'Title ' || CAST(o_orderkey AS STRING) AS title, CAST(o_orderdate AS DATE) AS published_at, o_totalprice AS award_amount,
        o_custkey % 50 AS citation_count, (o_orderkey % 100) / 100.0D AS quality_score, (o_orderkey % 89) / 890.0D AS pagerank,
        CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS agency,
        CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'Industry Authority' WHEN 1 THEN 'Financial Authority' WHEN 2 THEN 'Press Release' WHEN 3 THEN 'Niche' END AS outlet_tier,
        CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN '10-K' WHEN 1 THEN '13F-HR' WHEN 2 THEN '4' ELSE '10-Q' END AS filing_type,
        o_orderstatus = 'F' AS risk_factor_mentioned, CAST(o_custkey % 13 AS DOUBLE) - 1 AS cash_burn, o_totalprice / 1000 AS cash_reserves,
        o_custkey % 1000 AS stars, o_custkey % 100 AS forks FROM {orders}""",
    "mention_rows": """SELECT l_partkey AS tech_id, l_orderkey AS doc_id, l_linenumber AS seq,
        CASE CAST((l_partkey + l_linenumber) % 8 AS INT) WHEN 0 THEN 'invented' WHEN 1 THEN 'studied' WHEN 2 THEN 'subject' WHEN 3 THEN 'deployed' WHEN 4 THEN 'funded'
        WHEN 5 THEN 'researched' WHEN 6 THEN 'procured' ELSE 'regulated' END AS role, l_quantity / 50 AS strength, 1 - l_tax * 4 AS evidence_confidence,
        CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'revenue grew' WHEN 1 THEN 'risk factors' WHEN 2 THEN 'sales rose' ELSE 'a passing remark' END AS evidence_text FROM {lineitem}""",
    "tech_mentions": """SELECT tech_id, doc_id, role, strength, evidence_confidence, evidence_text FROM (SELECT *, row_number() OVER (PARTITION BY tech_id, doc_id ORDER BY seq DESC) AS rn
        FROM {mention_rows}) t WHERE rn = 1""",
    "company_tech": """SELECT src, dst, doc_ref, relation_type, evidence_confidence, evidence_text FROM (SELECT l_suppkey AS src, l_partkey AS dst, l_orderkey AS doc_ref,
        CASE l_linestatus WHEN 'O' THEN 'develops' ELSE 'uses' END AS relation_type, 1 - l_tax * 4 AS evidence_confidence,
        CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'revenue grew' WHEN 1 THEN 'risk factors' WHEN 2 THEN 'sales rose' ELSE 'a passing remark' END AS evidence_text,
        row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_orderkey ORDER BY l_linenumber DESC) AS rn FROM {lineitem}) t WHERE rn = 1""",
    "holdings": """SELECT l_suppkey AS institution, l_partkey AS cusip, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, CAST(o_orderdate AS DATE) AS filing_date,
        l_quantity AS shares, l_extendedprice AS value, l_orderkey AS accession, l_linenumber AS line FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "insider": """SELECT l_partkey AS ticker, l_suppkey AS owner, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'M' END AS code, CAST(l_shipdate AS DATE) AS trans_date,
        l_quantity AS shares, CASE WHEN l_linenumber = 7 THEN 0.0D ELSE l_extendedprice / l_quantity END AS price, l_orderkey AS accession, l_linenumber AS line,
        CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'OFFICER' WHEN 1 THEN 'DIRECTOR' WHEN 2 THEN 'DIRECTOR,TENPERCENTOWNER' END AS relationship FROM {lineitem}""",
    "news": """SELECT event_id AS seq, ts, CAST(ts AS DATE) AS day, event_type AS keyword, (value - 50) / 10 AS tone, 'https://site' || CAST(user_id % 40 AS STRING) || '.example.com/' ||
        CAST(event_id % 3000 AS STRING) AS url FROM {events}""",
}


def needs(name: str) -> list[str]:
    return [k for k in SQL if "{" + k + "}" in SQL[name]]


class Model:
    """The tables of one data folder as DataFrames: m.technologies, m.orders and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in RAW and name not in SQL):
            raise AttributeError(name)
        if name not in self._made:
            if name in RAW:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                used = {k: getattr(self, k) for k in (*RAW, *SQL) if "{" + k + "}" in SQL[name]}
                self._made[name] = self.spark.sql(SQL[name], **used)
        return self._made[name]

    @cached_property
    def mention_docs(self) -> DataFrame:
        """Mentions with their documents, the join that most layer queries share."""
        return self.tech_mentions.join(self.documents_g, "doc_id")


def prelude(sql: str) -> str:
    """sql with the model tables it names, and those they need, as common table expressions."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in needs(name):
            add(n)
        if name not in wanted:
            wanted.append(name)

    import re

    for name in SQL:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    plain = {k: re.sub(r"\{(\w+)\}", r"\1", SQL[k]).replace(".0D", ".0::DOUBLE") for k in wanted}
    ctes = ", ".join(f"{k} AS ({v})" for k, v in plain.items())
    own = sql.strip()
    if own.startswith("RECURSIVE "):
        return f"WITH RECURSIVE {ctes}{', ' if ctes else ''}{own[len('RECURSIVE ') :]}"
    if own.upper().startswith("SELECT"):
        return f"WITH {ctes} {own}" if ctes else own
    return f"WITH {ctes}, {own}" if ctes else f"WITH {own}"
