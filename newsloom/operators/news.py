"""Article feed, sentiment summary, trend and sources of a ticker, or of all tickers in one plan.

Articles, tickers and scores are DataFrames with the columns of :mod:`newsloom.schemas`. ``ticker=None`` means every
ticker, each for itself. De-duplication comes first (the first row of a story in the query's order stays), relevance is
tested after it. Ties are broken by id, and every time-relative query takes ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.bounds import check_bound
from newsloom.functions.stats import ewma, in_time_order, mean0, std0
from newsloom.functions.text import dedup_key, or_default, relevance, source_weight

MIN_RELEVANCE = 0.35


def _since(as_of: Column, **interval: int) -> Column:
    return as_of - F.make_interval(**{k: F.lit(v) for k, v in interval.items()})


def without_mock(df: DataFrame, include_mock: bool) -> DataFrame:
    return df if include_mock else df.where("source IS NULL OR source <> 'mock'")


def symbol_map(tickers: DataFrame) -> DataFrame:
    """article_id and all its tickers, upper-cased, as a sorted array."""
    return tickers.groupBy("article_id").agg(F.sort_array(F.collect_list(F.upper("ticker"))).alias("symbols"))


def first_of_story(df: DataFrame, *order: Column, partition: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The first row of each dedup key; ``df`` has a headline."""
    key = dedup_key(F.col("headline"))  # a headline may be a whole text; keys have no "#"
    keyed = df.withColumn("_key", F.when(F.length(key) > 64, F.concat(F.lit("#"), F.sha2(key, 256))).otherwise(key))
    w = Window.partitionBy(*partition, "_key").orderBy(*order)
    return keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_key")


def with_relevance(df: DataFrame, tickers: DataFrame, ticker: str | None = None) -> DataFrame:
    """``df`` with each article's symbols and its relevance; of a named ticker's articles only, so that no other's tags are grouped."""
    if ticker is not None:
        tickers = tickers.join(tickers.where(F.col("ticker") == ticker.upper()).select("article_id"), "article_id", "left_semi")
    joined = df.join(symbol_map(tickers), df["id"] == F.col("article_id"), "left").drop("article_id")
    joined = joined.withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))
    return joined.withColumn("relevance", relevance(F.col("ticker"), F.col("headline"), F.col("summary"), F.col("symbols")))


def _tagged(articles: DataFrame, tickers: DataFrame, ticker: str | None) -> DataFrame:
    """Article and ticker pairs."""
    t = tickers if ticker is None else tickers.where(F.col("ticker") == ticker.upper())
    return articles.join(t, articles["id"] == t["article_id"]).drop("article_id")


def articles_feed(articles: DataFrame, tickers: DataFrame, scores: DataFrame, ticker: str, as_of: Column, limit: int = 50, offset: int = 0, days: int | None = None, min_relevance: float = MIN_RELEVANCE, include_mock: bool = False, window: int | None = None) -> DataFrame:
    """Newest articles of a ticker. The page is cut from the first ``window`` rows (four times the limit, 400 at least) before
    stories are de-duplicated, so it can be short."""
    check_bound("limit", limit)
    check_bound("offset", offset)
    check_bound("min_relevance", min_relevance)
    rows = without_mock(_tagged(articles, tickers, ticker), include_mock)
    if days is not None:
        check_bound("days", days)
        rows = rows.where(F.col("published_at") >= _since(as_of, days=days))
    s = scores.select(F.col("article_id"), F.col("ticker").alias("score_ticker"), "label", F.col("compound").cast("double").alias("compound"))
    joined = rows.join(s, (rows["id"] == s["article_id"]) & (rows["ticker"] == s["score_ticker"]), "left").drop("article_id", "score_ticker")
    newest = [F.col("published_at").desc(), F.col("id")]
    page = joined.orderBy(*newest).offset(offset).limit(window or max(limit * 4, 400))
    found = with_relevance(first_of_story(page, *newest), tickers, ticker).where(F.col("relevance") >= min_relevance)
    flag = lambda k: or_default(F.get_json_object("raw_payload", f"$.{k}"), F.lit(None).cast("string"))
    out = found.select("id", "url", "headline", "summary", "body", "source", "published_at", "symbols", F.round("relevance", 4).alias("relevance"), "label", F.round("compound", 4).alias("compound"), (flag("near_earnings") == "true").alias("near_earnings"), flag("earnings_date").alias("earnings_date"))
    return out.orderBy(*newest).limit(limit)


def scored_stories(articles: DataFrame, tickers: DataFrame, scores: DataFrame, ticker: str | None, time: str, since: Column, min_relevance: float, include_mock: bool) -> DataFrame:
    """Scored articles since a time, one for each story (the earliest by ``time``), relevant enough, with the weighted score."""
    check_bound("min_relevance", min_relevance)
    s = scores if ticker is None else scores.where(F.col("ticker") == ticker.upper())
    s = s.select("article_id", "ticker", F.col("compound").cast("double").alias("compound"), "label", "scored_at")
    rows = without_mock(s.join(articles, s["article_id"] == articles["id"]).drop("article_id"), include_mock).where(F.col(time) >= since)
    found = first_of_story(with_relevance(rows, tickers, ticker), F.col(time), F.col("id")).where(F.col("relevance") >= min_relevance)  # texts aren't needed, nor shuffled, after relevance
    return found.withColumn("weighted", F.col("compound") * source_weight(F.col("source")))


def sentiment_summary(articles: DataFrame, tickers: DataFrame, scores: DataFrame, as_of: Column, ticker: str | None = None, days: int = 7, min_relevance: float = MIN_RELEVANCE, include_mock: bool = False) -> DataFrame:
    """Count, mean, deviation and EWMA of weighted scores, and how many have each label. A named ticker always gives a row."""
    check_bound("summary_days", days, "days")
    found = scored_stories(articles, tickers, scores, ticker, "scored_at", _since(as_of, days=days), min_relevance, include_mock)
    x = F.col("weighted")
    aggregates = [
        F.count(F.lit(1)).alias("article_count"), mean0(x).alias("mean_compound"), std0(x).alias("std_compound"),
        ewma(in_time_order(x, F.col("scored_at"), F.col("id"))).alias("ewma_compound"),
        *[F.count_if(F.col("label") == v).alias(v.lower()) for v in ("POSITIVE", "NEUTRAL", "NEGATIVE")],
    ]
    return found.groupBy("ticker").agg(*aggregates) if ticker is None else found.agg(*aggregates).withColumn("ticker", F.lit(ticker.upper()))


def label_distribution(stories: DataFrame, seeds: tuple[str, ...] = ("POSITIVE", "NEUTRAL", "NEGATIVE")) -> DataFrame:
    """ticker, label, n: labels that a ticker hasn't got are there with 0, unknown labels with their count."""
    counted = stories.groupBy("ticker", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("ticker").agg(F.collect_list(F.struct("label", "n")).alias("have"))
    missing = F.array_except(F.array(*map(F.lit, seeds)), F.transform("have", lambda x: x["label"]))
    rows = F.concat("have", F.transform(missing, lambda x: F.struct(x.alias("label"), F.lit(0).cast("long").alias("n"))))
    return counted.select("ticker", F.explode(rows).alias("r")).select("ticker", "r.*")


def sentiment_trend(articles: DataFrame, tickers: DataFrame, scores: DataFrame, as_of: Column, ticker: str | None = None, hours: int = 72, min_relevance: float = MIN_RELEVANCE, include_mock: bool = False) -> DataFrame:
    """Mean weighted score and number of articles by day of publication; days without any are left out. Sums are exact, so order doesn't matter."""
    check_bound("hours", hours)
    found = scored_stories(articles, tickers, scores, ticker, "published_at", _since(as_of, hours=hours), min_relevance, include_mock)
    return found.groupBy("ticker", F.to_date("published_at").alias("news_day")).agg((F.sum(F.col("weighted").cast("decimal(20,10)")).cast("double") / F.count(F.lit(1))).alias("mean_compound"), F.count(F.lit(1)).alias("article_count"))


def source_breakdown(articles: DataFrame, tickers: DataFrame, as_of: Column, ticker: str | None = None, days: int = 30, min_relevance: float = MIN_RELEVANCE, include_mock: bool = False) -> DataFrame:
    """Articles by source, most first; a story counts for its earliest article."""
    check_bound("days", days)
    rows = without_mock(_tagged(articles, tickers, ticker), include_mock).where(F.col("published_at") >= _since(as_of, days=days))
    found = first_of_story(with_relevance(rows, tickers), F.col("published_at"), F.col("id")).where(F.col("relevance") >= min_relevance)
    counted = found.groupBy("ticker", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("article_count"))
    return counted.orderBy("ticker", F.desc("article_count"), "source")


def diversity_cap(items: DataFrame, limit: int, partition: tuple[str, ...] = ()) -> DataFrame:
    """At most max(5, limit // 6) items of a source, newest first, then ``limit`` of all (for each ``partition``)."""
    newest = [F.col("published_at").desc(), F.col("id")]
    capped = items.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition, "source").orderBy(*newest))).where(F.col("_rn") <= max(5, limit // 6)).drop("_rn")
    if not partition:
        return capped.orderBy(*newest).limit(limit)
    return capped.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*newest))).where(F.col("_rn") <= limit).drop("_rn")


def union_sources(*sources: DataFrame, partition: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """All items of several sources, in their order of priority; one for each story."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return first_of_story(out, F.col("priority"), F.col("published_at").desc(), F.col("id"), partition=partition)


def incremental_feed(articles: DataFrame, tickers: DataFrame, ticker: str, last_seen: int, top: int = 20) -> DataFrame:
    """Of the ``top`` newest articles, those with an id above ``last_seen``, by id."""
    newest = _tagged(articles, tickers, ticker).orderBy(F.col("published_at").desc(), "id").limit(top)
    return newest.where(F.col("id") > last_seen).orderBy("id")


def trailing_volume(scores: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Number of scores of each ticker in the last hours."""
    return scores.where(F.col("scored_at") >= _since(as_of, hours=hours)).groupBy("ticker").agg(F.count(F.lit(1)).alias("article_volume"))


def trailing_volatility(scores: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Sample deviation of scores of each ticker in the last days."""
    return scores.where(F.col("scored_at") >= _since(as_of, days=days)).groupBy("ticker").agg(std0(F.col("compound").cast("double")).alias("volatility"))


def distinct_tickers(tickers: DataFrame) -> DataFrame:
    return tickers.select("ticker").distinct()


def merge_pages(*pages: DataFrame, cap: int = 100) -> DataFrame:
    """Pages of articles as one list: equal by url, headline and time once; the newest ``cap``."""
    out = None
    for p in pages:
        out = p if out is None else out.unionByName(p)
    return out.dropDuplicates(["url", "headline", "published_at"]).orderBy(F.col("published_at").desc(), "id").limit(cap)


def watchlist_add(symbols: Column, symbol: Column) -> Column:
    return F.array_union(symbols, F.array(F.upper(symbol)))


def watchlist_remove(symbols: Column, symbol: Column) -> Column:
    return F.array_except(symbols, F.array(F.upper(symbol)))


def watchlist_toggle(symbols: Column, symbol: Column) -> Column:
    return F.when(F.array_contains(symbols, F.upper(symbol)), watchlist_remove(symbols, symbol)).otherwise(watchlist_add(symbols, symbol))
