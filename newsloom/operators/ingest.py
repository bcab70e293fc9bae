"""Getting new rows in: what is there already stays out, updates are merges of two tables, duplicates are cleaned up.

There is no table format with transactions here, so a merge returns the whole new table; :func:`newsloom.sources.tables.replace`
writes it to a new folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import dedup_key, has_text_signal, or_default
from newsloom.operators.fundamentals import surprise_pct
from newsloom.operators.news import first_of_story

SIGNATURE_DAYS = 60


def url_anti_join(items: DataFrame, articles: DataFrame) -> DataFrame:
    """Items whose address no article has."""
    return items.join(articles.select("url"), "url", "left_anti")


def signature_anti_join(items: DataFrame, articles: DataFrame, as_of: Column, days: int = SIGNATURE_DAYS) -> DataFrame:
    """Items whose story no article of the last days has."""
    recent = articles.where(F.col("published_at") >= as_of - F.make_interval(days=F.lit(days))).select(dedup_key(F.col("headline")).alias("_sig"))
    return items.withColumn("_sig", dedup_key(F.col("headline"))).join(recent, "_sig", "left_anti").drop("_sig")


def with_required(items: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or empty."""
    for c in columns:
        items = items.where(F.col(c).isNotNull() & (F.col(c) != ""))
    return items


def with_signal(items: DataFrame, ticker: Column, company: Column | None = None) -> DataFrame:
    return items.where(has_text_signal(F.col("headline"), F.col("summary"), ticker, company))


def insert_new(items: DataFrame, articles: DataFrame, as_of: Column, ticker: Column, company: Column | None = None) -> DataFrame:
    """New articles of a batch: complete, with a signal, one a story and one an address, and not there yet."""
    x = with_required(items, "url", "headline")
    newest = [F.col("published_at").desc(), F.col("id")]
    x = first_of_story(with_signal(x, ticker, company), *newest, partition=())
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy("url").orderBy(*newest))).where("_rn = 1").drop("_rn")
    return signature_anti_join(url_anti_join(x, articles), articles, as_of)


def explode_symbols(items: DataFrame, default: str = "UNKNOWN") -> DataFrame:
    """A row for each symbol, upper-cased and once; ``default`` where there is none."""
    clean = F.array_distinct(F.transform(F.filter("symbols", lambda s: s.isNotNull()), F.upper))
    symbols = F.when(F.coalesce(F.size(clean), F.lit(0)) > 0, clean).otherwise(F.array(F.lit(default)))
    return items.withColumn("ticker", F.explode(symbols))


def _came(old: Column, new: Column, flags: bool) -> list[Column]:
    """Whether a row of a merge came in or was found, if that is wanted."""
    old, new = F.coalesce(old, F.lit(False)), F.coalesce(new, F.lit(False))
    return [(new & ~old).alias("inserted"), (new & old).alias("updated")] if flags else []


def upsert_labels(stored: DataFrame, fresh: DataFrame, flags: bool = False) -> DataFrame:
    """Labels by ticker and date: existing rows get the new return, label and time but keep their close; others come in. ``flags``: with inserted and updated."""
    f = fresh.select("ticker", "date", *[F.col(c).alias(f"_{c}") for c in ("close_price", "forward_return_5d", "label", "fetched_at")])
    x = stored.withColumn("_old", F.lit(True)).join(f.withColumn("_new", F.lit(True)), ["ticker", "date"], "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return x.select("ticker", "date", F.when(F.col("_old"), F.col("close_price")).otherwise(F.col("_close_price")).alias("close_price"), pick("forward_return_5d"), pick("label"), pick("fetched_at"), *_came(F.col("_old"), F.col("_new"), flags))


def upsert_earnings(stored: DataFrame, fresh: DataFrame, flags: bool = False) -> DataFrame:
    """Reports by ticker and date: an actual value and its surprise fill in where none was stored; others come in. ``flags``: with inserted and updated."""
    f = fresh.where("report_date IS NOT NULL").select(F.lit(True).alias("_new"), "ticker", "report_date", F.col("estimated_eps").alias("_est"), F.col("actual_eps").alias("_act"), F.col("fiscal_date_ending").alias("_fiscal"))
    x = stored.withColumn("_old", F.lit(True)).join(f, ["ticker", "report_date"], "full")
    s = surprise_pct(F.col("_est"), F.col("_act")).cast("decimal(10,4)")
    old, fill = F.coalesce("_old", F.lit(False)), F.col("_act").isNotNull() & F.col("actual_eps").isNull()
    return x.select(
        "ticker", "report_date", F.when(old, F.col("fiscal_date_ending")).otherwise(F.col("_fiscal")).alias("fiscal_date_ending"),
        F.when(old, F.col("estimated_eps")).otherwise(F.col("_est")).alias("estimated_eps"),
        F.when(old & ~fill, F.col("actual_eps")).otherwise(F.col("_act")).alias("actual_eps"), F.when(old & ~fill, F.col("surprise_pct")).otherwise(s).alias("surprise_pct"), *_came(old, F.col("_new"), flags),
    )


def keepers(articles: DataFrame) -> DataFrame:
    """Of each story the article with the most text (a body's length counts three times a summary's), then the earliest stored."""
    size = 3 * F.length(F.coalesce("body", F.lit(""))) + F.length(F.coalesce("summary", F.lit("")))
    return first_of_story(articles.withColumn("_size", size), F.desc("_size"), F.col("ingested_at"), F.col("id"), partition=()).drop("_size")


def duplicate_groups(articles: DataFrame) -> DataFrame:
    """Stories that two or more articles have, and how many."""
    return articles.groupBy(dedup_key(F.col("headline")).alias("story")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def clean_duplicates(articles: DataFrame, tickers: DataFrame, scores: DataFrame, filings: DataFrame) -> dict[str, DataFrame]:
    """The four tables without duplicate articles: tags and scores go with their article, filings lose the link."""
    kept = keepers(articles)
    ids = kept.select(F.col("id").alias("article_id"))
    known = ids.withColumn("_kept", F.lit(True))
    linked = filings.join(known, "article_id", "left").withColumn("article_id", F.when(F.col("_kept"), F.col("article_id"))).drop("_kept")
    return {"articles": kept, "article_tickers": tickers.join(ids, "article_id", "left_semi"), "sentiment_scores": scores.join(ids, "article_id", "left_semi"), "sec_filings": linked}


def mock_article(spark, ticker: str, headline: str, summary: str, published_at, number: int) -> DataFrame:
    """One test article; its address is made from ticker and number."""
    row = [(number, f"https://mock.local/{ticker.upper()}/{number}", headline, summary, "mock", published_at, [ticker.upper()])]
    return spark.createDataFrame(row, "id LONG, url STRING, headline STRING, summary STRING, source STRING, published_at TIMESTAMP, symbols ARRAY<STRING>")


def default_source(source: Column, default: str = "unknown") -> Column:
    return F.lower(F.trim(or_default(source, default)))
