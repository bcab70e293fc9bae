"""Queries of file feeds: a table is written in a feed's format, in files of a hundred items, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.plans import views
from newsloom.plans.catalog import BARS, HISTORY, NEWS, day, query, r6, stamp
from newsloom.sources import feeds, tables

LANGS = "coalesce(lang, 'und')"


def _files(spark: SparkSession, groups: DataFrame, *keys: str) -> str:
    """Writes ``value`` of each row as a line of a file in a folder of its keys."""
    root = f"{tables.work_dir(spark)}/feed"
    groups.write.partitionBy(*keys).text(root)
    return root


def _items(df: DataFrame, item: Column, wrap=lambda items: items, *more: str) -> DataFrame:
    """A JSON value for each hundred articles."""
    items = F.collect_list(item)
    return df.groupBy(*more, F.floor(F.col("id") / 100).alias("part")).agg(F.to_json(wrap(items)).alias("value"))


def _article(**names: str) -> Column:
    day_time = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    values = {"published_at": day_time, "epoch": F.unix_timestamp("published_at"), "id": F.col("id").cast("string")}
    return F.struct(*[values.get(c, F.col(c)).alias(k) for k, c in names.items()])


@query(f"WITH {BARS} SELECT ticker, bar_day, round(close, 6) AS close, round(volume, 6) AS volume FROM bars")
def file_bars(spark: SparkSession, sf: str) -> DataFrame:
    b = views.bars(spark, sf).withColumn("t", F.date_format("bar_day", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    item = F.struct("t", F.col("close").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    root = _files(spark, b.groupBy("ticker").agg(F.to_json(F.struct(F.collect_list(item).alias("bars"))).alias("value")), "ticker")
    read = [feeds.bars(spark, f"{root}/ticker={t}", t.lower()) for t in ("A", "N", "R")]
    return read[0].union(read[1]).union(read[2]).select("ticker", F.to_date("timestamp").alias("bar_day"), *r6("close", "volume"))


@query("""WITH d AS (SELECT coalesce(lang, 'und') AS ticker, doc_id // 50 AS page, doc_id, row_number() OVER (PARTITION BY coalesce(lang, 'und'), doc_id // 50 ORDER BY doc_id) AS k FROM documents),
h AS (SELECT ticker, page, count(*) AS n, page % 7 = 6 AS last FROM d GROUP BY ALL), t AS (SELECT *, coalesce(sum(n) OVER w, 0) AS came, coalesce(bool_or(last) OVER w, false) AS done FROM h WINDOW w AS (PARTITION BY ticker ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ticker, CAST(page AS INT) AS page, CAST(doc_id AS VARCHAR) AS id FROM d JOIN t USING (ticker, page) WHERE NOT done AND came < 120 AND k <= 120 - came""")
def file_paged_news(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of fifty, a line each of a ticker's files; some have no token for a next one, so some tickers end there and some at the limit."""
    n = views.news(spark, sf).withColumn("ticker", F.expr(LANGS)).withColumn("page", F.floor(F.col("id") / 50).cast("int"))
    item = F.struct(F.col("id").alias("k"), F.col("id").cast("string").alias("id"), "url", "headline")
    items = F.transform(F.array_sort(F.collect_list(item)), lambda s: s.dropFields("k"))
    page = n.groupBy("ticker", "page").agg(items.alias("news")).withColumn("next_page_token", F.when(F.col("page") % 7 != 6, F.col("page").cast("string")))
    root = _files(spark, page.select("ticker", F.to_json(F.struct("page", "news", "next_page_token")).alias("value")), "ticker")
    return feeds.paged(feeds.pages(spark, root, lines=True), 120).select("ticker", "page", "id")


@query(f"WITH {NEWS} SELECT url, headline, lower(trim(coalesce(source, 'finnhub'))) AS source, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM news WHERE headline <> ''")
def file_company_news(spark: SparkSession, sf: str) -> DataFrame:
    item = _article(headline="headline", summary="summary", url="url", source="source", datetime="epoch")
    root = _files(spark, _items(views.news(spark, sf), item), "part")
    return feeds.company_news(spark, root, views.as_of()).select("url", "headline", "source", stamp("published_at"))


@query(f"WITH {NEWS} SELECT url, headline, length(summary) AS summary_length, length(body) AS body_length, lower(trim(coalesce(source, 'marketaux'))) AS source, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM news WHERE headline <> ''")
def file_search_news(spark: SparkSession, sf: str) -> DataFrame:
    item = _article(title="headline", description="summary", url="url", source="source", published_at="published_at", snippet="body")
    root = _files(spark, _items(views.news(spark, sf), item, lambda items: F.struct(items.alias("data"))), "part")
    out = feeds.search_news(spark, root, views.as_of())
    return out.select("url", "headline", F.length("summary").cast("long").alias("summary_length"), F.length("body").cast("long").alias("body_length"), "source", stamp("published_at"))


@query(f"WITH {NEWS} SELECT url, lower(coalesce(source, 'google-news')) AS source, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM news WHERE published_at >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY")
def file_rss(spark: SparkSession, sf: str) -> DataFrame:
    when = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    source = F.coalesce(F.concat(F.lit('<source url="https://s.example">'), "source", F.lit("</source>")), F.lit(""))
    item = F.concat(F.lit("<item><title>story "), F.col("id").cast("string"), F.lit("</title><link>"), "url", F.lit("</link><pubDate>"), when, F.lit("</pubDate>"), source, F.lit("</item>"))
    n = views.news(spark, sf).groupBy(F.floor(F.col("id") / 100).alias("part")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("value"))
    return feeds.rss(spark, _files(spark, n, "part"), views.as_of(), days=20).select("url", "source", stamp("published_at"))


@query("SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS report_date, CAST(o_totalprice AS DOUBLE) AS estimated_eps, CAST(o_totalprice + 1 AS DOUBLE) AS actual_eps FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-07-01' - 365 AND DATE '1996-07-01' + 90")
def file_earnings_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """The orders' days as reports, from a year before to 90 days after a day."""
    o = views.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    item = F.struct("date", F.col("o_totalprice").cast("double").alias("epsEstimate"), (F.col("o_totalprice") + 1).cast("double").alias("epsActual"), F.col("id").cast("string").alias("fiscalDateEnding"))
    groups = o.groupBy(F.floor(F.col("id") / 20000).alias("part")).agg(F.to_json(F.struct(F.collect_list(item).alias("earningsCalendar"))).alias("value"))
    out = feeds.earnings_calendar(spark, _files(spark, groups, "part"), "all", F.lit("1996-07-01").cast("timestamp"))
    return out.select(F.col("fiscal_date_ending").cast("long").alias("k"), day("report_date"), F.col("estimated_eps").cast("double").alias("estimated_eps"), F.col("actual_eps").cast("double").alias("actual_eps"))


@query(f"WITH {HISTORY} SELECT ticker, cik, count(*) AS n FROM h GROUP BY ALL")
def file_cik_map(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders as a map of numbered entries, joined to the filings' own cik."""
    h = views.filing_history(spark, sf).select("ticker", F.col("cik").cast("long").alias("k"), F.size("accessionNumber").alias("n"))
    entry = F.struct(F.col("k").cast("string"), F.struct(F.lower("ticker").alias("ticker"), F.col("k").alias("cik_str")))
    groups = h.groupBy(F.floor(F.col("k") / 100).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return feeds.cik_map(spark, _files(spark, groups, "part")).join(h, "ticker").select("ticker", "cik", F.col("n").cast("long").alias("n"))
