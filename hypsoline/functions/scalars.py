"""Column-returning scalar functions: names, dates, classes, document fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def any_of(c: Column, words) -> Column:
    """Whether c contains one of the words; an empty list never matches, null counts as no match."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words], F.lit(False)) & c.isNotNull()


def first_rule(c: Column, rules: list[tuple[tuple[str, ...], str]], default: str | None) -> Column:
    """The value of the first rule one of whose words c contains."""
    out = F.lit(default)
    for words, value in reversed(rules):
        out = F.when(any_of(c, words), value).otherwise(out)
    return out


#: Parts of outlet domains and the tier they stand for, in this order.
OUTLETS = [
    (("aviationweek.com", "ainonline.com", "flightglobal.com", "aerospaceamerica.aiaa.org", "verticalmag.com", "rotorcraft.com", "ieee.org", "nature.com", "science.org"), "Industry Authority"),
    (("bloomberg.com", "reuters.com", "wsj.com", "ft.com", "forbes.com", "barrons.com", "marketwatch.com", "cnbc.com"), "Financial Authority"),
    (("prnewswire.com", "businesswire.com", "globenewswire.com", "accesswire.com", "prweb.com", "marketscreener.com"), "Press Release/Wire"),
    (("benzinga.com", "yahoo.com", "fool.com", "seekingalpha.com", "investing.com", "finance.yahoo.com", "msn.com", "google.com/finance"), "Mainstream Media"),
]
#: Words of agencies and the type they stand for, in this order; others are civil.
AGENCIES = [
    (("defense", "air force", "navy", "army", "military", "marines"), "defense"),
    (("transportation", "faa", "federal aviation"), "regulatory"),
]
#: Words of funding bodies and the name they get, in this order.
FUNDERS = [
    (("nasa", "aeronautics and space"), "NASA"),
    (("nsf", "national science foundation"), "NSF"),
    (("doe", "department of energy"), "DOE"),
    (("darpa", "defense advanced research"), "DARPA"),
    (("nih", "national institutes of health"), "NIH"),
    (("department of defense",), "DOD"),
    (("european commission", "ec "), "European Commission"),
]
#: Domains and their publishers.
PUBLISHERS = {
    "fool.com": "The Motley Fool", "benzinga.com": "Benzinga", "finance.yahoo.com": "Yahoo Finance", "yahoo.com": "Yahoo", "seekingalpha.com": "Seeking Alpha", "forbes.com": "Forbes",
    "bloomberg.com": "Bloomberg", "reuters.com": "Reuters", "wsj.com": "The Wall Street Journal", "aviationweek.com": "Aviation Week", "ainonline.com": "AIN Online",
    "flightglobal.com": "Flight Global", "prnewswire.com": "PR Newswire", "businesswire.com": "Business Wire", "globenewswire.com": "GlobeNewswire",
}


def outlet_tier(domain: Column) -> Column:
    return first_rule(F.lower(domain), OUTLETS, "Niche/Aggregator")


def agency_type(agency: Column) -> Column:
    return F.when(F.coalesce(agency, F.lit("")) == "", "unknown").otherwise(first_rule(F.lower(agency), AGENCIES, "civil"))


def title_case(c: Column) -> Column:
    """A capital after anything that is not a letter, small letters elsewhere."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2), F.length(p)))), "")


def funding_org(name: Column) -> Column:
    """The name of a known funder, DOD for names that begin so, else the name in title case; Unknown without one."""
    known = first_rule(F.lower(name), FUNDERS, None)
    dod = F.when(F.lower(name).startswith("dod"), F.lit("DOD"))
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(F.coalesce(known, dod, title_case(name)))


def seen_date(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def parse_date(c: Column) -> Column:
    """ISO 8601, else yyyy-MM-dd, else null."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def domain_of(url: Column) -> Column:
    """The authority of a URL without a leading www."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")


def md5_id(prefix: str, url: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(url.cast("binary")), 1, 12))


def publisher_name(domain: Column, known: dict[str, str] = PUBLISHERS) -> Column:
    """The publisher of a known domain, then of one that contains a known one, else the domain's words in title case."""
    low = F.lower(domain)
    out = title_case(F.replace(F.replace(domain, F.lit(".com"), F.lit("")), F.lit("."), F.lit(" ")))
    for k, v in reversed(known.items()):
        out = F.when(low.contains(k), v).otherwise(out)
    for k, v in known.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def days_between(start: Column, end: Column) -> Column:
    """end - start in days; 0 where one can't be read."""
    return F.coalesce(F.datediff(F.try_to_date(end, "yyyy-MM-dd"), F.try_to_date(start, "yyyy-MM-dd")), F.lit(0))


def contract_size(amount: Column) -> Column:
    return F.when(amount < 100_000, "small").when(amount < 1_000_000, "medium").when(amount.isNotNull(), "large").otherwise("small")


def slug(c: Column) -> Column:
    """Lower case, other characters than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def award_id(c: Column) -> Column:
    return F.translate(c, "/- ", "___")


def repo_id(full_name: Column) -> Column:
    return F.translate(F.element_at(F.split(full_name, "/"), -1), "-.", "__")


def money(c: Column) -> Column:
    return F.try_to_number(F.regexp_replace(c, "[$,\\s]", ""), F.lit("9999999999999999.99")).cast("double")


def accession(c: Column) -> Column:
    """18 digits as 10-2-6."""
    return F.when(F.length(c) == 18, F.concat_ws("-", F.substring(c, 1, 10), F.substring(c, 11, 2), F.substring(c, 13, 6))).otherwise(c)


def cik(c: Column) -> Column:
    return F.lpad(c.cast("string"), 10, "0")


def header_field(content: Column, label: str) -> Column:
    """The rest of a line that begins with label and a colon; null without one."""
    return F.nullif(F.trim(F.regexp_extract(content, rf"(?m)^\s*{label}:[ \t]*([^\n]*)$", 1)), F.lit(""))


def sec_date(c: Column) -> Column:
    return F.date_format(F.try_to_date(c, "yyyyMMdd"), "yyyy-MM-dd")


def fiscal_quarter(period: Column, filing_type: Column) -> Column:
    """The calendar quarter of the period; an annual report is of the fourth."""
    return F.when(filing_type == "10-K", F.lit("Q4")).when(period.isNotNull(), F.concat(F.lit("Q"), F.quarter(period).cast("string")))


def docket(content: Column) -> Column:
    return F.nullif(F.regexp_extract(F.substring(content, 1, 2000), r"(?i)docket\s+(?:no\.|number|id)[:.]?\s*([A-Z0-9-]+)", 1), F.lit(""))


def document_type(action: Column) -> Column:
    a = F.lower(action)
    proposed = a.contains("proposed rule") | a.contains("notice of proposed")
    return F.when(a.contains("final rule"), "final_rule").when(proposed, "proposed_rule").when(a.contains("guidance"), "guidance").otherwise("notice")


def decision_type(action: Column, content: Column | None = None) -> Column:
    """The first class one of whose words the action holds; `disapproval` holds `approval`, so it counts as that.
    A certification may also be named in the first three thousand characters of the content; the rest are proposals."""
    a = F.lower(action)
    says = lambda *words: any_of(a, words)
    named = F.lower(F.substring(content, 1, 3000)).contains("certification") if content is not None else F.lit(False)
    return (
        F.when(says("approval", "approved"), "approval").when(says("denial", "denied", "disapproval"), "denial")
        .when(says("certification", "requirement") | F.coalesce(named, F.lit(False)), "certification_requirement").otherwise("proposal")
    )


def email(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++", 0), F.lit(""))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*+>", " "), r"\s+", " "))


def legal_status(granted: Column, discontinued: Column, expires: Column, as_of: str) -> Column:
    now = F.lit(as_of).cast("date")
    return F.when(~granted, "pending").when(discontinued.isNotNull(), "abandoned").when(expires < now, "expired").otherwise("granted")


def peer_reviewed(venue: Column) -> Column:
    v = F.lower(venue)
    return F.when(any_of(v, ("journal", "article", "conference", "proceedings")), True).when(any_of(v, ("preprint", "book", "thesis", "dissertation", "report")), False)


def filing_title(company: Column, filing_type: Column, date: Column) -> Column:
    joined = F.concat_ws(" - ", *[F.nullif(c, F.lit("")) for c in (company, filing_type, date)])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("SEC Filing"))


def short_summary(text: Column, most: int = 500, least: int = 200) -> Column:
    """At most `most` characters, cut after the last full stop beyond `least` where there is one."""
    head = F.substring(text, 1, most)
    stop = most + 1 - F.locate(" .", F.reverse(F.rpad(head, most, " ")))
    cut = F.when((F.locate(" .", F.reverse(head)) > 0) & (stop - 1 > least), F.substr(head, F.lit(1), stop - 1)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(cut)


def evidence(text: Column) -> Column:
    return F.substring(text, 1, 200)


def normalize_name(c: Column) -> Column:
    """Trimmed, lower, only a-z, 0-9, spaces and - ( ) / +, with single spaces."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9\s\-()/+]", ""), r"\s+", " "))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one is null, empty, all zero or of another length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))).otherwise(0.0)


def first_long(*texts: Column, least: int = 100) -> Column:
    """The first of several texts with at least `least` characters."""
    return F.coalesce(*[F.when(F.length(t) >= least, t) for t in texts])


def first_id(doi: Column, other: Column, title: Column) -> Column:
    """An own id, else the DOI, else a digest of the title; empty counts as missing."""
    return F.coalesce(F.nullif(other, F.lit("")), F.nullif(doi, F.lit("")), F.md5(title.cast("binary")))


def pdf_url(explicit: Column, patent: Column, url: Column) -> Column:
    """A given address, else the public patent page's, else .html as .pdf, else an address that ends in .pdf."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(patent.isNotNull(), F.concat(F.lit("https://patents.google.com/patent/"), patent, F.lit("/en"))), F.when(url.endswith(".html"), F.regexp_replace(url, r"\.html$", ".pdf")), F.when(url.endswith(".pdf"), url))


def patent_number(number: Column, kind: Column) -> Column:
    """A document number without separators and leading zeros, and with its prefix for designs and plants."""
    digits = F.regexp_replace(F.regexp_replace(number, "[^0-9]", ""), "^0+", "")
    return F.concat(F.when(kind.startswith("S"), "D").when(kind.startswith("P"), "PP").otherwise(""), digits)


def external_id(ids: Column, kind: str) -> Column:
    """The value of the first external id (struct type, value) of a kind."""
    return F.get(F.filter(ids, lambda x: F.lower(x["type"]) == kind), 0)["value"]


def preferred_text(texts: Column, lang: str = "en") -> Column:
    """The text (struct lang, text) in a language, else the first one."""
    return F.coalesce(F.get(F.filter(texts, lambda x: x["lang"] == lang), 0)["text"], F.get(texts, 0)["text"])


def readable_size(n: Column) -> Column:
    out = F.format_string("%.1f TB", n / 1024.0**4)
    for unit, power in (("GB", 3), ("MB", 2), ("KB", 1)):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024.0**power)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


#: Agencies that are known by an abbreviation.
AGENCY_NAMES = {
    "Federal Aviation Administration": "FAA", "Environmental Protection Agency": "EPA", "National Aeronautics and Space Administration": "NASA",
    "Federal Communications Commission": "FCC", "Department of Defense": "DoD", "Department of Transportation": "DOT",
}


def agency_info(content: Column) -> Column:
    """struct(regulatory_body, sub_agency) of a notice: the agency of its AGENCY field by its usual abbreviation, else the
    first line after the department, else the department; and the first other line between department and agency field.
    Lines in brackets, which name dockets, don't count."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    department = some(F.regexp_extract(F.substring(content, 1, 2000), r"DEPARTMENT OF ([^\n]+)", 1))
    agency = some(F.regexp_extract(F.substring(content, 1, 3000), r"\*\*AGENCY:\*\*\s+([^(\n]+)", 1))
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.replace(F.trim(x), F.lit("*"), F.lit(""))), lambda x: (x != "") & ~x.startswith("["))
    after = F.regexp_extract(F.substring(content, 1, 2500), r"(?s)DEPARTMENT OF [^\n]+\n(.{0,500})", 1)
    next_line = F.get(lines(F.array_join(F.slice(F.split(after, "\n"), 1, 5), "\n")), 0)
    body = F.coalesce(agency, F.when(department.isNotNull(), F.coalesce(next_line, department)))
    between = F.regexp_extract(F.substring(content, 1, 3000), r"(?s)DEPARTMENT OF [^\n]+\n(.*?)\*\*AGENCY:\*\*", 1)
    sub = F.when(department.isNotNull() & agency.isNotNull(), F.get(F.filter(lines(between), lambda x: x != agency), 0))
    short = body
    for name, letters in AGENCY_NAMES.items():
        short = F.when(body == name, letters).otherwise(short)
    return F.struct(short.alias("regulatory_body"), sub.alias("sub_agency"))


#: The patterns of dates in a DATES section, in this order.
EFFECTIVE = (r"effective\s+(?:on\s+)?", r"effective\s+date[:\s]+", r"becomes?\s+effective\s+(?:on\s+)?")
DEADLINE = (r"comments?\s+(?:must be received|due|should be submitted)\s+(?:by\s+)?", r"(?:on or )?before\s+")
DAY = r"([A-Z][a-z]+\s+[0-9]{1,2},\s+[0-9]{4})"


def rule_dates(content: Column) -> Column:
    """struct(effective_date, comment_deadline) of the DATES section: by the first pattern whose date can be read."""
    section = F.regexp_extract(F.substring(content, 1, 10000), r"(?s)\*\*DATES:\*\*\s+(.+?)(?=\n\n\*\*|\n\n[A-Z])", 1)
    day = lambda p: F.try_to_date(F.regexp_replace(F.regexp_extract(section, f"(?i){p}{DAY}", 1), r"\s+", " "), "MMMM d, yyyy")
    return F.struct(F.coalesce(*[day(p) for p in EFFECTIVE]).alias("effective_date"), F.coalesce(*[day(p) for p in DEADLINE]).alias("comment_deadline"))


def fr_document(filename: Column) -> Column:
    """The document number of a file name like agency_2024-25812.md; null without one."""
    return F.nullif(F.regexp_extract(filename, r"_([0-9]{4}-[0-9]+)\.md$", 1), F.lit(""))


def rule_metadata(content: Column, filename: Column) -> Column:
    """All that the expressions above find in a notice, as one struct."""
    action = F.coalesce(header_field(content, r"(?:\*\*)?ACTION(?:\*\*)?"), F.lit(""))
    agency, dates = agency_info(content), rule_dates(content)
    return F.struct(
        agency["regulatory_body"].alias("regulatory_body"), agency["sub_agency"].alias("sub_agency"), docket(content).alias("docket_number"), document_type(action).alias("document_type"),
        decision_type(action, content).alias("decision_type"), dates["effective_date"].alias("effective_date"), dates["comment_deadline"].alias("comment_deadline"),
        email(F.substring(content, 1, 10000)).alias("contact_email"), fr_document(filename).alias("federal_register_doc_id"),
    )
