"""Feeds kept as files (JSON pages, RSS, raw HTML): one DataFrame for all files of a folder, no network.

Every reader has a fixed schema, so nothing is inferred; what can't be parsed becomes null and is filtered where the column is required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import or_default
from newsloom.functions.times import parse_day, parse_epoch_or_iso, parse_iso, parse_rfc822
from newsloom.operators.fundamentals import pad_cik, surprise_pct

# Days of the earnings calendar before and after today; least and greatest number of items of a search query, and pages that are fetched for their text in a run.
CALENDAR = (365, 90)
PER_QUERY, SCRAPES = (10, 50), 20


def per_query_limit(limit: int, queries: int) -> int:
    """Items that are taken of each of several search queries."""
    return max(PER_QUERY[0], min(PER_QUERY[1], limit // max(queries, 1) + 5))


def first_of_each(items: DataFrame, most: int, by: str, *order: Column) -> DataFrame:
    """The first ``most`` items of each value of ``by``; tasks send no more than these."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return items.withColumn("_rn", rn).where(F.col("_rn") <= most).drop("_rn")


def to_scrape(items: DataFrame, *order: Column, most: int = SCRAPES) -> DataFrame:
    """Items without a body whose pages are fetched in this run: the first ``most`` in order."""
    return items.where("body IS NULL OR body = ''").orderBy(*order).limit(most)


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """The table of tickers, CSV with a head (symbol, name): symbols in upper case, the first name of each."""
    x = spark.read.schema("symbol STRING, name STRING").option("header", True).csv(path)
    x = x.select(F.upper(F.trim("symbol")).alias("symbol"), F.trim("name").alias("name")).where("symbol <> ''")
    return x.groupBy("symbol").agg(F.min("name").alias("name"))


def bars(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """``{"bars": [{t, o, h, l, c, v}]}`` as daily bars by time."""
    raw = spark.read.schema("bars ARRAY<STRUCT<t: STRING, o: DOUBLE, h: DOUBLE, l: DOUBLE, c: DOUBLE, v: DOUBLE>>").json(path, multiLine=True)
    x = raw.select(F.inline("bars")).withColumnsRenamed({"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"})
    return x.select(F.lit(ticker.upper()).alias("ticker"), F.try_to_timestamp("t").alias("timestamp"), "open", "high", "low", "close", "volume").orderBy("timestamp")


def news_pages(spark: SparkSession, path: str, as_of: Column, ticker: str, limit: int = 200) -> DataFrame:
    """``{"news": [...], "next_page_token"}`` pages as articles; at most ``limit`` (1 to 1000), newest first."""
    item = "STRUCT<id: STRING, url: STRING, headline: STRING, summary: STRING, source: STRING, created_at: STRING, symbols: ARRAY<STRING>>"
    x = spark.read.schema(f"news ARRAY<{item}>, next_page_token STRING").json(path, multiLine=True).select(F.inline("news"))
    symbols = F.when(F.size("symbols") > 0, F.transform("symbols", F.upper)).otherwise(F.array(F.lit(ticker.upper())))
    x = x.where("url IS NOT NULL AND url <> ''").select(F.col("id").alias("external_id"), "url", "headline", "summary", "source", parse_iso(F.col("created_at"), as_of).alias("published_at"), symbols.alias("symbols"))
    return x.orderBy(F.desc("published_at"), "url").limit(max(1, min(limit, 1000)))


def paged(pages: DataFrame, limit: int = 200, size: int = 50) -> DataFrame:
    """Items of numbered pages (ticker, page, news, next_page_token) as a client takes them, for all tickers at once.

    It asks for ``size`` items at a time, and stops after a page without token or items, or when ``limit`` (1 to 1000) items have come.
    A ticker's window holds its pages' numbers and sizes, not their items.
    """
    limit, n = max(1, min(limit, 1000)), F.least(F.coalesce(F.size("news"), F.lit(0)), F.lit(size))
    heads = pages.select("ticker", "page", n.alias("n"), (F.coalesce("next_page_token", F.lit("")) == "").alias("last"))
    before = Window.partitionBy("ticker").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    taken = heads.withColumn("came", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("done", F.coalesce(F.max(F.col("last") | (F.col("n") == 0)).over(before), F.lit(False)))
    taken = taken.where(~F.col("done") & (F.col("came") < limit)).select("ticker", "page", F.least("n", F.lit(limit) - F.col("came")).cast("int").alias("take"))
    return pages.join(taken, ["ticker", "page"]).select("ticker", "page", F.inline(F.slice("news", F.lit(1), F.col("take"))))


def company_news(spark: SparkSession, path: str, as_of: Column, limit: int = 100) -> DataFrame:
    """``[{headline, summary, url, source, datetime}]``: the first ``limit`` items of each file, then those without address or headline go."""
    x = spark.read.schema("headline STRING, summary STRING, url STRING, source STRING, datetime STRING").json(path, multiLine=True)
    x = x.withColumn("_file", F.col("_metadata.file_path")).withColumn("_k", F.monotonically_increasing_id())
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy("_file").orderBy("_k"))).where(F.col("_rn") <= limit)
    x = x.where("url <> '' AND headline <> ''")
    return x.select("url", "headline", "summary", F.lower(F.trim(or_default(F.col("source"), "finnhub"))).alias("source"), parse_epoch_or_iso(F.col("datetime"), as_of).alias("published_at"))


def search_news(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """``{"data": [{title, description, url, source, published_at, snippet}]}`` as articles; the snippet is the body."""
    item = "STRUCT<title: STRING, description: STRING, url: STRING, source: STRING, published_at: STRING, snippet: STRING>"
    x = spark.read.schema(f"data ARRAY<{item}>").json(path, multiLine=True).select(F.inline("data")).where("url <> '' AND title <> ''")
    return x.select("url", F.col("title").alias("headline"), F.col("description").alias("summary"), F.col("snippet").alias("body"), F.lower(F.trim(or_default(F.col("source"), "marketaux"))).alias("source"), parse_iso(F.col("published_at"), as_of).alias("published_at"))


def rss(spark: SparkSession, path: str, as_of: Column, days: int = 30, limit: int = 100) -> DataFrame:
    """RSS items not older than ``days``: the first ``limit`` (1 to 100) of each file, complete ones."""
    schema = "title STRING, link STRING, pubDate STRING, source STRUCT<_VALUE: STRING, _url: STRING>"
    x = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    x = x.withColumn("_file", F.input_file_name()).withColumn("_k", F.monotonically_increasing_id())
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy("_file").orderBy("_k"))).where(F.col("_rn") <= max(1, min(limit, 100)))
    x = x.where("title <> '' AND link <> ''").withColumn("published_at", parse_rfc822(F.col("pubDate"), as_of))
    x = x.where(F.col("published_at") >= as_of - F.make_interval(days=F.lit(days)))
    return x.select(F.col("link").alias("url"), F.col("title").alias("headline"), F.lower(F.trim(or_default(F.col("source._VALUE"), "google-news"))).alias("source"), "published_at")


def earnings_calendar(spark: SparkSession, path: str, ticker: str, as_of: Column | None = None) -> DataFrame:
    """``{"earningsCalendar": [{date, epsEstimate, epsActual, fiscalDateEnding}]}`` with the surprise; with ``as_of``, from 365 days before it to 90 after."""
    item = "STRUCT<date: STRING, epsEstimate: DOUBLE, epsActual: DOUBLE, fiscalDateEnding: STRING>"
    x = spark.read.schema(f"earningsCalendar ARRAY<{item}>").json(path, multiLine=True).select(F.inline("earningsCalendar"))
    x = x.withColumn("report_date", parse_day(F.col("date"))).where("report_date IS NOT NULL")
    if as_of is not None:
        today = F.to_date(as_of)
        x = x.where(F.to_date("report_date").between(F.date_sub(today, CALENDAR[0]), F.date_add(today, CALENDAR[1])))
    eps = lambda c: F.col(c).cast("decimal(12,4)")
    return x.select(F.lit(ticker.upper()).alias("ticker"), "report_date", F.col("fiscalDateEnding").alias("fiscal_date_ending"), eps("epsEstimate").alias("estimated_eps"), eps("epsActual").alias("actual_eps"), surprise_pct(F.col("epsEstimate"), F.col("epsActual")).cast("decimal(10,4)").alias("surprise_pct"))


def cik_map(spark: SparkSession, path: str) -> DataFrame:
    """``{"0": {"ticker", "cik_str"}}`` as ticker and ten-digit cik."""
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<ticker: string, cik_str: bigint>>").alias("m"))
    return x.select(F.explode(F.map_values("m")).alias("r")).select(F.upper("r.ticker").alias("ticker"), pad_cik(F.col("r.cik_str")).alias("cik"))


def filing_history(spark: SparkSession, path: str, ticker: str, cik: str) -> DataFrame:
    """``{"name", "filings": {"recent": {accessionNumber[], ...}}}``: name and the four parallel arrays."""
    recent = "accessionNumber: ARRAY<STRING>, form: ARRAY<STRING>, filingDate: ARRAY<STRING>, primaryDocument: ARRAY<STRING>"
    x = spark.read.schema(f"name STRING, filings STRUCT<recent: STRUCT<{recent}>>").json(path, multiLine=True)
    return x.select(F.lit(ticker.upper()).alias("ticker"), F.lit(cik).alias("cik"), "name", "filings.recent.*")


def event_filter(payload: Column, event: Column | None = None) -> Column:
    """News events: type ``n`` or ``news``, or with a headline; what isn't an object is none.

    ``event``: the payload as a struct, where it has been parsed; then only events that say neither are looked at for a headline that is null.
    """
    kind = F.get_json_object(payload, "$.T") if event is None else event["T"]
    said = F.coalesce(kind.isin("n", "news"), F.lit(False))
    if event is not None:
        said = said | event["headline"].isNotNull()
    return said | (payload.contains('"headline"') & F.coalesce(F.array_contains(F.json_object_keys(payload), "headline"), F.lit(False)))


def pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Stored pages in folders ``ticker=.../page=...`` as rows for :func:`paged`; with ``lines``, many to a file in folders ``ticker=...``, each a line that has its ``page``."""
    item = "STRUCT<id: STRING, url: STRING, headline: STRING, summary: STRING, source: STRING, created_at: STRING, symbols: ARRAY<STRING>>"
    return spark.read.schema(f"news ARRAY<{item}>, next_page_token STRING, ticker STRING, page INT").json(path, multiLine=not lines)
