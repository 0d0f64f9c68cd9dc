"""What is kept of paged services: where reading stops, which rows pass, which is first. The pages themselves come from the
paged source; a rule is a function over their rows, all queries of a service at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..operators.basics import keep_first, top_k
from ..operators.harvest import matches_keywords, quarters


def reached(rows: DataFrame, size: int, limit: int | None = None) -> DataFrame:
    """Rows (query, page, at, ...) that a reader gets that goes from page 0 on and stops at a page of fewer than `size` rows,
    which it still takes, or once it has `limit` rows of the query. Only counts of pages meet in a window."""
    pages = rows.groupBy("query", "page").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    whole = F.coalesce(F.min("n").over(w), F.lit(size)) >= size
    there = F.col("page") == F.count("*").over(w)  # no page before it is missing
    pages = pages.select("query", "page", before.alias("_before"), (whole & there).alias("_ok")).where("_ok").drop("_ok")
    own = rows.join(pages, ["query", "page"])
    if limit is not None:
        place = F.row_number().over(Window.partitionBy("query", "page").orderBy("at"))
        own = own.where(F.col("_before") < limit).withColumn("_p", place).where(F.col("_before") + F.col("_p") <= limit).drop("_p")
    return own.drop("_before")


def total_pages(rows: DataFrame) -> DataFrame:
    """Rows of pages from 1 to the total_pages that the first page tells."""
    total = rows.where("page = 1").groupBy("query").agg(F.max("total_pages").alias("_total"))
    return rows.join(total, "query").where(F.col("page") <= F.col("_total")).drop("_total")


def by_assignee(rows: DataFrame, limit: int) -> DataFrame:
    """Patents by scroll pages of 100, each patent once."""
    return keep_first(reached(rows, 100, limit), F.col("id").cast("string"), ["query", "page", "at"])


def by_title_or_abstract(rows: DataFrame, keywords: Sequence[str], first_year: int, last_year: int) -> DataFrame:
    """Papers by scroll pages of 500 whose title or abstract matches, of a range of years."""
    hit = matches_keywords(F.col("title"), keywords) | matches_keywords(F.col("abstract"), keywords)
    return reached(rows, 500).where(hit & F.col("year").between(first_year, last_year))


def one_page(rows: DataFrame, size: int = 100) -> DataFrame:
    """The first page alone, as contracts, patents of a search and other single requests give."""
    return top_k(rows.where("page = 0"), ["query"], [F.col("at")], size).drop("rank")


def repositories(rows: DataFrame, cap: int) -> DataFrame:
    """Repositories once each, whatever keyword found them, up to a cap over all keywords, in the order found."""
    first = keep_first(rows, F.col("id").cast("string"), ["query", "page", "at"])
    return first.orderBy("query", "page", "at").limit(cap)


def most_cited(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("cited"), "id").limit(k)


def agency_documents(rows: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Rules and notices of all pages whose title or text has a keyword, each document once."""
    hits = total_pages(rows).where(matches_keywords(F.concat_ws(" ", "title", "text"), keywords))
    return keep_first(hits, F.col("id").cast("string"), ["query", "page", "at"])


def company_filings(rows: DataFrame, types: Sequence[str], start: str, end: str) -> DataFrame:
    """Filings of some types between two days, with accession numbers without dashes."""
    df = rows.where(F.col("filing_type").isin(list(types)) & F.to_date("filed").between(start, end))
    return df.withColumn("accession", F.replace("accession", F.lit("-"), F.lit("")))


def ticker_quarters(tickers: DataFrame, start: str, end: str) -> DataFrame:
    """(ticker, quarter): the requests for transcripts; quarters are a short list in each row."""
    return tickers.select("ticker", F.explode(quarters(start, end)).alias("quarter"))


def scraped_links(pages: DataFrame, keywords: Sequence[str], least: int = 20, key: str = "page_id") -> DataFrame:
    """(key, link, title): the links of HTML pages whose text has at least so many characters and a keyword."""
    pair = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(pair), F.lit(1)).alias("link"), F.regexp_extract_all("html", F.lit(pair), F.lit(2)).alias("title"))
    rows = pages.select(key, F.explode(found).alias("x")).select(key, "x.link", S.strip_tags(F.col("x.title")).alias("title"))
    return rows.where((F.length("title") >= least) & matches_keywords(F.col("title"), keywords))


def links_per_ticker(links: DataFrame, k: int = 3, tickers: int = 15) -> DataFrame:
    """The first k links of each of the first tickers."""
    some = links.select("ticker").distinct().orderBy("ticker").limit(tickers)
    return top_k(links.join(F.broadcast(some), "ticker", "left_semi"), ["ticker"], [F.col("at")], k).drop("rank")


def search_hits(rows: DataFrame, assignee: Column) -> DataFrame:
    """Hits of a patent search: inventors as an array, and the assignee that was searched where none is given."""
    names = F.filter(F.transform(F.split(F.coalesce("inventor", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("patent_id", "title", names.alias("inventors"), F.coalesce(F.nullif("assignee", F.lit("")), assignee).alias("assignee"))


def job_rows(items: DataFrame, feed_name: str) -> DataFrame:
    """Seven fields of each item of a job feed."""
    from ..operators.harvest import company_of

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return items.select(blank("title").alias("title"), company_of(F.col("title")).alias("company"), blank("link").alias("link"), blank("description").alias("description"), blank("pubDate").alias("published"), F.lit(feed_name).alias("feed"), F.md5(blank("link").cast("binary")).alias("job_id"))


def first_pdf(df: DataFrame, sources: Sequence[str]) -> DataFrame:
    """df with the first address that one of the sources gave, its source, and the id of the paper."""
    found = F.coalesce(*[F.when(F.coalesce(s, F.lit("")) != "", F.struct(F.lit(s).alias("source"), F.col(s).alias("url"))) for s in sources])
    return df.withColumn("pdf", found).withColumn("paper_id", S.first_id(F.col("doi"), F.col("id"), F.col("title")))


def postings(docs: DataFrame, doc_id: str, *texts: str) -> DataFrame:
    """(word, doc_id, n): a full-text index as a table, of the words of some text columns; scans of it by word can skip if
    it is written in ranges of words."""
    from ..operators.search import tokens

    words = tokens(F.concat_ws(" ", *texts))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(words).alias("word")).groupBy("word", "doc_id").agg(F.count("*").alias("n"))


def to_embed(docs: DataFrame, texts: Sequence[str], embed=None, size: int = 64) -> DataFrame:
    """docs with embedding array<double>: embed(text) of the joined texts, by default hashed words, scaled to length 1."""
    from ..operators.search import tokens

    whole = F.concat_ws(" ", *[F.nullif(F.col(t), F.lit("")) for t in texts])
    if embed is not None:
        return docs.withColumn("embedding", embed(whole))
    place = F.transform(tokens(whole), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(F.col("_at"), lambda p: p == i)).cast("double"))
    out = docs.withColumn("_at", place).withColumn("_c", counts)
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda s, x: s + x * x))
    return out.withColumn("embedding", F.transform("_c", lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))).drop("_at", "_c")
