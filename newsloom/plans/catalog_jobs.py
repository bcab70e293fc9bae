"""Queries of jobs, predictions, reports and filings, put into the catalog's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import attribution, fundamentals, ingest, jobs, market, signals
from newsloom.plans import views
from newsloom.plans.catalog import BARS, FILED, HISTORY, LABELS, NEWS, REPORTS, TRAIN, _training, day, query, r6
from newsloom.schemas import PRICE_LABELS
from newsloom.sources import tables
from newsloom.streaming import events as live

# --- backfill and labels -----------------------------------------------------------------------------------------------
FED = f"""{NEWS}, fed AS (SELECT *, CASE WHEN source IS NULL THEN 'search' WHEN source IN ('reuters', 'bloomberg') THEN 'wire' ELSE 'web' END AS feed FROM news), old AS (SELECT url, story FROM news WHERE published_at < TIMESTAMP '2024-01-10'),
r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY published_at DESC, id) AS rn FROM fed WHERE headline <> '' AND contains(lower(headline || ' ' || summary), 'th')),
ins AS (SELECT *, CASE WHEN source IS NULL THEN 2 ELSE 1 END AS tags FROM r WHERE rn = 1 AND url NOT IN (SELECT url FROM old) AND story NOT IN (SELECT story FROM old))"""


def _backfill(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = views.news(spark, sf).withColumn("symbols", F.when(F.col("source").isNull(), F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A"))))
    wire = F.col("source").isin("reuters", "bloomberg")
    sources = {"wire": n.where(wire), "web": n.where(~wire), "search": n.where("source IS NULL")}
    return jobs.backfill(sources, n.where("published_at < TIMESTAMP '2024-01-10'"), views.as_of(), F.lit("TH"))


@query(f"WITH {FED} SELECT feed, id FROM ins")
def backfill_articles(spark: SparkSession, sf: str) -> DataFrame:
    return _backfill(spark, sf)[0].select("feed", "id")


@query(f"WITH {FED}, c AS (SELECT feed, count(*) AS fetched, count(*) FILTER (headline = '') AS failed FROM fed GROUP BY ALL), k AS (SELECT feed, count(*) AS inserted, CAST(sum(tags) AS BIGINT) AS tagged FROM ins GROUP BY ALL) SELECT feed, fetched, failed, coalesce(inserted, 0) AS inserted, coalesce(tagged, 0) AS tagged, fetched - failed - coalesce(inserted, 0) AS skipped FROM c LEFT JOIN k USING (feed)")
def backfill_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _backfill(spark, sf)[1].select("feed", "fetched", "failed", "inserted", "tagged", "skipped")


def _refreshed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Labels of all flags; those of A, stored until 1995, are older. Regions are wanted too but have no bars."""
    b = views.bars(spark, sf)
    old = b.where("ticker = 'A' AND bar_day < DATE '1995-01-01'").select("ticker", F.col("bar_day").alias("date"), F.lit(1).cast("decimal(12,4)").alias("close_price"), F.lit(None).cast("decimal(10,6)").alias("forward_return_5d"), F.lit("old").alias("label"), views.as_of().alias("fetched_at"))
    wanted = b.select("ticker").distinct().union(views.read(spark, sf, "region").select("r_name"))
    return jobs.refresh_price_labels(b.withColumn("close", F.round(F.col("close") * 100) / 100), old, wanted, views.as_of(), "bar_day")


@query(f"WITH {BARS.replace('bars AS', 'raw AS')}, bars AS (SELECT * REPLACE (round(close * 100) / 100 AS close) FROM raw), {LABELS} SELECT ticker, bar_day AS date, CASE WHEN ticker = 'A' AND bar_day < DATE '1995-01-01' THEN 1.0::DOUBLE ELSE round(close, 2) END AS close_price, CAST(CAST(fr AS DECIMAL(10,6)) AS DOUBLE) AS forward_return_5d, label FROM labels5")
def label_refresh(spark: SparkSession, sf: str) -> DataFrame:
    return _refreshed(spark, sf)[0].select("ticker", "date", F.col("close_price").cast("double").alias("close_price"), F.col("forward_return_5d").cast("double").alias("forward_return_5d"), "label")


@query(f"WITH {BARS}, w AS (SELECT DISTINCT ticker FROM bars UNION SELECT upper(r_name) FROM region), c AS (SELECT ticker, count(*) AS n FROM bars GROUP BY ALL) SELECT ticker, CASE WHEN n IS NULL THEN 'no_bars' WHEN n <= 5 THEN 'too_few_bars' ELSE 'ok' END AS state, CASE WHEN n > 5 THEN n ELSE 0 END AS upserted FROM w LEFT JOIN c USING (ticker)")
def label_refresh_report(spark: SparkSession, sf: str) -> DataFrame:
    return _refreshed(spark, sf)[1].select("ticker", "state", F.col("upserted").cast("long").alias("upserted"))


_HALVES = f"{BARS.replace('bars AS', 'raw AS')}, bars AS (SELECT * REPLACE (round(close * 100) / 100 AS close) FROM raw), {LABELS}, old AS (SELECT * FROM labels5 WHERE day(bar_day) % 2 = 0), new AS (SELECT * FROM labels5 WHERE bar_day >= DATE '1995-01-01')"


@query(f"""WITH {_HALVES}, c AS (SELECT count(*) FILTER (o.ticker IS NULL) AS inserted, count(*) FILTER (o.ticker IS NOT NULL) AS updated FROM new n LEFT JOIN old o USING (ticker, bar_day))
SELECT ticker, bar_day AS date, round(CASE WHEN o.ticker IS NOT NULL THEN o.close + 1 ELSE n.close END, 2) AS close_price, CASE WHEN n.ticker IS NULL THEN 'old' ELSE n.label END AS label, inserted, updated FROM old o FULL JOIN new n USING (ticker, bar_day), c""")
def label_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Labels kept by month: those of even days are stored, those of 1995 and later come in; with the numbers of rows that came in and were found."""
    root = tables.work_dir(spark)
    x = market.forward_labels(views.bars(spark, sf).withColumn("close", F.round(F.col("close") * 100) / 100), "bar_day").withColumnRenamed("bar_day", "date")
    cut = lambda df, more, label: df.select("ticker", "date", (F.col("close") + more).cast("decimal(12,4)").alias("close_price"), F.col("forward_return").cast("decimal(10,6)").alias("forward_return_5d"), label, views.as_of().alias("fetched_at"))
    merge = lambda stored, fresh: ingest.upsert_labels(stored, fresh, flags=True)
    tables.merge_months(cut(x.where("day(date) % 2 = 0"), 1, F.lit("old").alias("label")), f"{root}/labels", PRICE_LABELS, "date", merge)
    counts = tables.merge_months(cut(x.where("date >= DATE '1995-01-01'"), 0, F.col("label")), f"{root}/labels", PRICE_LABELS, "date", merge)
    out = tables.by_month(spark, f"{root}/labels", PRICE_LABELS).select("ticker", "date", F.col("close_price").cast("double").alias("close_price"), "label")
    return out.withColumns({k: F.lit(v).cast("long") for k, v in counts.items()})


# --- training rows and predictions -------------------------------------------------------------------------------------
@query(f"WITH {TRAIN} SELECT ticker, news_day, CASE WHEN ticker = 'PURCHASE' THEN target WHEN day(news_day) % 2 = 0 THEN 'RISE' ELSE 'FALL' END AS target FROM train")
def training_stored_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Stored labels count for tickers with 30 of them; PURCHASE has fewer."""
    t, b = _training(spark, sf)
    label = F.when(F.day("bar_day") % 2 == 0, "RISE").otherwise("FALL")
    stored = b.where("ticker <> 'PURCHASE' OR bar_day < DATE '2017-01-20'").select("ticker", F.col("bar_day").alias("date"), F.lit(0.01).alias("forward_return_5d"), label.alias("label"))
    return signals.training_dataset(t, b, stored, "bar_day").select("ticker", "news_day", "target")


@query(f"WITH {TRAIN} SELECT ticker, count(*) AS n, true AS sums_to_one, true AS known_label, true AS attributed FROM train GROUP BY ALL")
def model_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions and attributions of a forest for all its rows: probabilities add up to 1, labels are those it knows, and base and attributions add up to the label's probability."""
    t, b = _training(spark, sf)
    data = signals.training_dataset(t, b, time="bar_day").withColumn("id", F.concat_ws("/", "ticker", F.col("news_day").cast("string"))).persist()
    model, info = signals.train_model(signals.with_split(data, "news_day"), trees=10)
    said = signals.predict(model, info, data)
    parts = attribution.path_shapley(model, info, said).select(F.col("id").alias("of"), sum((F.col(c) for c in signals.FEATURES), F.col("base")).alias("total"))
    p = F.map_values("probabilities")
    checks = {
        "sums_to_one": F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9, "known_label": F.col("recommendation").isin(info["labels"]),
        "attributed": F.abs(F.element_at("probabilities", F.col("recommendation")) - F.col("total")) < 1e-9,
    }
    both = said.join(parts, F.col("id") == F.col("of"))
    return both.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), *[F.every(v).alias(k) for k, v in checks.items()])


_PREDICTED = "CASE WHEN ewma_sentiment_1d > 0.15 THEN 'RISE' WHEN ewma_sentiment_1d < -0.15 THEN 'FALL' ELSE 'STABLE' END AS recommendation, CAST(CAST(CAST(least(CAST(0.85 AS DOUBLE), CAST(0.52 AS DOUBLE) + CAST(0.35 AS DOUBLE) * abs(ewma_sentiment_1d)) AS VARCHAR) AS DECIMAL(5,4)) AS DOUBLE) AS confidence"


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    t, b = _training(spark, sf)
    fresh = signals.as_prediction(signals.training_dataset(t, b, time="bar_day"), F.col("news_day").cast("timestamp")).withColumn("id", F.xxhash64("ticker", "predicted_at"))
    return jobs.append_predictions(fresh.where("predicted_at < TIMESTAMP '2020-01-01'"), fresh)


@query(f"WITH {TRAIN} SELECT ticker, news_day AS predicted_at, {_PREDICTED}, CAST(5 AS INT) AS horizon_days FROM train")
def prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log whose first half is there already; writing all of it again adds the second half only."""
    return _predictions(spark, sf).select("ticker", day("predicted_at"), "recommendation", F.col("confidence").cast("double").alias("confidence"), "horizon_days")


@query(f"WITH {TRAIN} SELECT ticker, news_day AS predicted_at, {_PREDICTED} FROM train WHERE ticker = 'CLICK' ORDER BY news_day DESC LIMIT 100")
def prediction_history(spark: SparkSession, sf: str) -> DataFrame:
    return signals.prediction_history(_predictions(spark, sf), "click").select("ticker", day("predicted_at"), "recommendation", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT doc_id, CAST(greatest(0, least(1, round(CAST((doc_id * 37) % 100 AS DOUBLE) / 100 * 0.9, 6))) AS DOUBLE) AS confidence FROM documents")
def calibrated_confidence(spark: SparkSession, sf: str) -> DataFrame:
    p = F.pmod(F.col("doc_id") * 37, F.lit(100)).cast("double") / 100
    return views.read(spark, sf, "documents").select("doc_id", F.round(signals.calibrated_confidence(p, F.lit(0.1)), 6).alias("confidence"))


@query("SELECT event_id, round(value, 6) AS x FROM events WHERE event_type <> 'click' AND value IS NOT NULL")
def finite_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = views.read(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", F.lit(float("inf"))).otherwise(F.col("value")).alias("x"))
    return signals.without_infinities(e, ("x",)).select("event_id", *r6("x"))


@query("""WITH e AS (SELECT event_id, round(value % CAST(1 AS DOUBLE), 6) AS p, round((value * 3) % CAST(1 AS DOUBLE), 6) AS n, round((value * 7) % CAST(1 AS DOUBLE), 6) AS u FROM events)
SELECT event_id, round(greatest(-1, least(1, p - n)), 6) AS compound, CASE WHEN p >= n AND p >= u THEN 'POSITIVE' WHEN n >= u THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label FROM e""")
def three_class_scores(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda k: F.round((F.col("value") * k) % F.lit(1.0), 6)
    compound, label = text.three_class(part(1), part(3), part(7))
    return views.read(spark, sf, "events").select("event_id", F.round(compound, 6).alias("compound"), label.alias("label"))


# --- reports and filings -----------------------------------------------------------------------------------------------
@query(f"""WITH {REPORTS}, p AS (SELECT event_id AS id, e.ticker, rd, abs(CAST(floor((epoch(ts) - epoch(rd)) / 86400) AS BIGINT)) AS distance FROM e JOIN rep USING (ticker) WHERE event_type <> 'purchase' AND ts >= rd - INTERVAL 3 DAY AND ts < rd + INTERVAL 4 DAY), r AS (SELECT *, row_number() OVER (PARTITION BY ticker, id ORDER BY distance, rd) AS rn FROM p),
t AS (SELECT event_id AS id, strftime(rd, '%Y-%m-%d') AS d, event_id % 3 AS k FROM e LEFT JOIN r ON r.id = event_id AND rn = 1 WHERE event_type <> 'purchase')
SELECT id, CASE WHEN k = 0 THEN CASE WHEN d IS NOT NULL THEN '{{"near_earnings":"true","earnings_date":"' || d || '"}}' END WHEN k = 1 THEN '{{"n": 3, "o":{{"a":[1,2]}}' || CASE WHEN d IS NOT NULL THEN ',"near_earnings":"true","earnings_date":"' || d || '"' ELSE '' END || '}}' ELSE '{{"near_earnings":true}}' END AS raw_payload, d IS NOT NULL AND k <> 2 AS tagged FROM t""")
def earnings_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads that are missing, have nested fields or are tagged already."""
    articles, earnings = views.reports(spark, sf)
    k = F.col("id") % 3
    payload = F.when(k == 1, '{"n": 3, "o":{"a":[1,2]}}').when(k == 2, '{"near_earnings":true}')
    return fundamentals.tag_near_earnings(articles.withColumn("raw_payload", payload), earnings).select("id", "raw_payload", "tagged")


@query(f"WITH {REPORTS} SELECT ticker, CAST(rd AS DATE) AS report_date FROM rep WHERE ticker = '9' ORDER BY rd DESC LIMIT 40")
def latest_earnings(spark: SparkSession, sf: str) -> DataFrame:
    return fundamentals.latest_earnings(views.reports(spark, sf)[1], "9").select("ticker", day("report_date"))


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    return fundamentals.filing_articles(fundamentals.unnest_filings(views.filing_history(spark, sf)), F.lit("1900-01-01").cast("timestamp"), None)


@query(f"WITH {HISTORY} SELECT ticker, accession_number, d AS filed_at FROM f WHERE ticker = 'C7' ORDER BY d DESC, accession_number LIMIT 30")
def latest_filings(spark: SparkSession, sf: str) -> DataFrame:
    return fundamentals.latest_filings(_filings(spark, sf), "c7").select("ticker", "accession_number", day("filed_at"))


@query(f"WITH {HISTORY} SELECT accession_number, {FILED} AS filing_url, CASE WHEN d < DATE '1995-01-01' THEN o_orderkey ELSE o_orderkey + 1000000000 END AS article_id FROM f")
def filing_links(spark: SparkSession, sf: str) -> DataFrame:
    """Filings before 1995 have an article already; all get one in the batch, with another id."""
    x = _filings(spark, sf)
    key = F.regexp_replace("accession_number", "-", "").cast("long")
    made = x.select(F.col("filing_url").alias("url"), key.alias("id"), "filed_at")
    out = fundamentals.link_filings(x, made.where("filed_at < TIMESTAMP '1995-01-01'").drop("filed_at"), made.select("url", (F.col("id") + 1000000000).alias("id")))
    return out.select("accession_number", "filing_url", "article_id")


@query("SELECT 'C' || c_custkey AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def cik_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = views.read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ticker"))
    return fundamentals.with_cik(wanted, views.filing_history(spark, sf).select("ticker", "cik"))


# --- small functions ---------------------------------------------------------------------------------------------------
@query("SELECT array_to_string(list_sort(list(DISTINCT upper(event_type))), ',') AS tickers FROM events")
def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    return live.subscribed(views.read(spark, sf, "events").select(F.col("event_type").alias("ticker"))).select(F.array_join("tickers", ",").alias("tickers"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.2f', CAST(l_quantity AS DOUBLE)) AS shown, printf('%.2f', CAST(l_discount AS DOUBLE) * 100) || '%' AS shown_percent FROM lineitem")
def shown_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return views.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.fixed(F.col("l_quantity")).alias("shown"), text.percent(F.col("l_discount")).alias("shown_percent"))


@query("WITH q AS (SELECT s_suppkey, unnest(['(' || s_name || ' OR Supplier & ' || s_nationkey || ') stock', '(' || s_name || ' OR Supplier & ' || s_nationkey || ') site:cnbc.com']) AS q FROM supplier) SELECT s_suppkey, 'https://search.example/rss?q=' || replace(url_encode(q), '%20', '+') AS url FROM q")
def search_urls(spark: SparkSession, sf: str) -> DataFrame:
    company = F.concat(F.lit("Supplier & "), F.col("s_nationkey").cast("string"))
    q = views.read(spark, sf, "supplier").select("s_suppkey", F.explode(text.search_queries(F.col("s_name"), company, ["cnbc.com"])).alias("q"))
    return q.select("s_suppkey", text.query_url("https://search.example/rss?q=", F.col("q")).alias("url"))
