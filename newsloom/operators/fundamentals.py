"""Earnings and filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.bounds import check_bound
from newsloom.functions.times import parse_day

# The address and the texts that a filing gets, and days around a report.
FILING_URL = "https://www.sec.gov/Archives/edgar/data/{cik}/{plain}/{accession}-index.htm"
NEAR_DAYS = 3
TARGET_FORMS = ("8-K", "10-K", "10-Q", "4", "SC 13G", "SC 13D")


def surprise_pct(estimate: Column, actual: Column) -> Column:
    """Per cent by which the actual value is above the estimate; null without either, or for an estimate of 0."""
    e, a = estimate.cast("double"), actual.cast("double")
    return F.when((e != 0) & a.isNotNull(), (a - e) / F.abs(e) * 100.0)


def near_earnings(articles: DataFrame, earnings: DataFrame) -> DataFrame:
    """id, ticker, report_date and day distance of the report nearest to each article, if it is near enough.

    Days are rounded down, so an article is near from three days before a report until just under four days after it;
    of equally near reports the earliest is taken. Each report is there for each of its days, and ticker and day are the
    join's keys, so an article meets only the reports that are near.
    """
    pub, report = F.col("published_at"), F.col("report_date")
    first, last = report - F.make_interval(days=F.lit(NEAR_DAYS)), report + F.make_interval(days=F.lit(NEAR_DAYS + 1))
    days = F.sequence(F.to_date(first), F.to_date(last - F.expr("INTERVAL 1 MICROSECOND")))
    e = earnings.where("report_date IS NOT NULL").select("ticker", "report_date", F.explode(days).alias("_day"))
    pairs = articles.select("id", "ticker", "published_at", F.to_date(pub).alias("_day")).join(e, ["ticker", "_day"]).where((pub >= first) & (pub < last))
    floored = F.floor((F.unix_timestamp(pub) - F.unix_timestamp(report)) / 86400)
    best = pairs.groupBy("ticker", "id").agg(F.min(F.struct(F.abs(floored).alias("distance"), "report_date")).alias("b"))
    return best.select("id", "ticker", "b.report_date", "b.distance")


def tag_near_earnings(articles: DataFrame, earnings: DataFrame) -> DataFrame:
    """``articles`` with near_earnings and earnings_date set in raw_payload where a report is near and no tag is there yet, and whether the row was ``tagged`` now.

    Other fields of the payload, nested ones and numbers too, stay as they are written; what isn't an object counts as an empty one.
    """
    near = near_earnings(articles, earnings).select(F.col("id").alias("_id"), F.col("ticker").alias("_ticker"), F.date_format("report_date", "yyyy-MM-dd").alias("_day"))
    own = F.rtrim(F.regexp_extract(F.coalesce("raw_payload", F.lit("")), r"(?s)^\s*\{(.*)\}\s*$", 1))
    body = F.when(F.json_object_keys("raw_payload").isNotNull(), own).otherwise("")
    tag = F.concat(F.lit('"near_earnings":"true","earnings_date":"'), "_day", F.lit('"'))
    tagged = F.concat(F.lit("{"), body, F.when(body != "", ",").otherwise(""), tag, F.lit("}"))
    has = F.coalesce(F.array_contains(F.json_object_keys("raw_payload"), "near_earnings"), F.lit(False))
    x = articles.join(near, (articles["id"] == near["_id"]) & (articles["ticker"] == near["_ticker"]), "left").withColumn("tagged", F.col("_id").isNotNull() & ~has)
    return x.withColumn("raw_payload", F.when(F.col("tagged"), tagged).otherwise(F.col("raw_payload"))).drop("_id", "_ticker", "_day")


def latest_earnings(earnings: DataFrame, ticker: str, limit: int = 40) -> DataFrame:
    check_bound("listed", limit, "limit")
    return earnings.where(F.col("ticker") == ticker.upper()).orderBy(F.desc("report_date")).limit(limit)


def latest_filings(filings: DataFrame, ticker: str, form_type: str | None = None, limit: int = 30) -> DataFrame:
    check_bound("listed", limit, "limit")
    x = filings.where(F.col("ticker") == ticker.upper())
    x = x if form_type is None else x.where(F.col("form_type") == form_type)
    return x.orderBy(F.desc("filed_at"), "accession_number").limit(limit)


def accession(raw: Column) -> Column:
    """18 digits as 10-2-6; anything else as it is."""
    clean = F.regexp_replace(raw, "[- ]", "")
    return F.when(F.length(clean) == 18, F.concat_ws("-", F.substring(clean, 1, 10), F.substring(clean, 11, 2), F.substring(clean, 13, 6))).otherwise(raw)


def pad_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def filing_url(cik: Column, accession_number: Column) -> Column:
    head, rest = FILING_URL.split("{cik}")
    middle, tail = rest.split("{plain}")
    tail, end = tail.split("{accession}")
    return F.concat(F.lit(head), cik.cast("bigint").cast("string"), F.lit(middle), F.replace(accession_number, F.lit("-"), F.lit("")), F.lit(tail), accession_number, F.lit(end))


def unnest_filings(history: DataFrame) -> DataFrame:
    """Rows of parallel arrays (accessionNumber, form, filingDate, primaryDocument), as many as the shortest has."""
    names = ["accessionNumber", "form", "filingDate", "primaryDocument"]
    shortest = F.least(*[F.size(c) for c in names])
    zipped = F.slice(F.arrays_zip(*names), 1, shortest)
    rest = [c for c in history.columns if c not in names]
    return history.where(shortest > 0).select(*rest, F.inline(zipped))


def filing_articles(filings: DataFrame, since: Column, forms: tuple[str, ...] | None = TARGET_FORMS) -> DataFrame:
    """Filings as articles; ``filings`` is from :func:`unnest_filings`, with ticker, cik and name."""
    x = filings if forms is None else filings.where(F.col("form").isin(*forms))
    x = x.withColumn("filed_at", parse_day(F.col("filingDate"))).where(F.col("filed_at") >= since)
    x = x.withColumn("accession_number", accession(F.col("accessionNumber")))
    return x.select(
        "ticker", "cik", "accession_number", F.col("form").alias("form_type"), "filed_at", filing_url(F.col("cik"), F.col("accession_number")).alias("filing_url"),
        F.concat(F.lit("SEC "), "form", F.lit(": "), "name").alias("headline"), F.concat("name", F.lit(" filed a "), "form", F.lit(" with the SEC on "), "filingDate", F.lit(".")).alias("summary"),
    )


def with_cik(tickers: DataFrame, ciks: DataFrame) -> DataFrame:
    """Rows whose ticker has a cik, with it; others go."""
    return tickers.withColumn("ticker", F.upper("ticker")).join(ciks.dropDuplicates(["ticker"]), "ticker")


def link_filings(filings: DataFrame, articles: DataFrame, new_articles: DataFrame) -> DataFrame:
    """``filings`` with article_id: an existing article with that address, else the new one."""
    old = articles.select(F.col("url").alias("filing_url"), F.col("id").alias("_old"))
    new = new_articles.select(F.col("url").alias("filing_url"), F.col("id").alias("_new"))
    return filings.join(old, "filing_url", "left").join(new, "filing_url", "left").withColumn("article_id", F.coalesce("_old", "_new")).drop("_old", "_new")


def new_filings(filings: DataFrame, known: DataFrame, limit: int = 30) -> DataFrame:
    """Filings whose number isn't known for the ticker, the newest ``limit`` of each ticker."""
    fresh = filings.join(known.select("ticker", "accession_number"), ["ticker", "accession_number"], "left_anti")
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("filed_at"), "accession_number"))
    return fresh.withColumn("_rn", rn).where(F.col("_rn") <= limit).drop("_rn")
