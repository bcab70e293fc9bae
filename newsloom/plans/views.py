"""The driver's tables as news, tags, scores, bars, reports and filings, so that every operator has whole tables to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import lexicon_compound, sentiment_label

AS_OF = "2024-01-31 00:00:00"
POS, NEG = ("ing", "ber", "que", "and"), ("the", "sch", "eau", "ción")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    headline = F.split_part(text, F.lit("\n"), F.lit(1))
    summary = F.substring(text, F.length(headline) + 2, F.length(text))
    names = {"src0": "reuters", "src1": "bloomberg", "src2": "CNBC", "src3": "benzinga", "src4": "mock"}
    source = F.when(F.col("source") == "src5", F.lit(None))
    for k, v in names.items():
        source = source.when(F.col("source") == k, v)
    minutes = F.pmod(F.col("doc_id") * 7919, F.lit(43200))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("url"), headline.alias("headline"), summary.alias("summary"),
        F.col("text").alias("body"), source.otherwise(F.col("source")).alias("source"), "lang", F.timestamp_seconds(F.lit(1704067200) + minutes * 60).alias("published_at"), F.lit(None).cast("string").alias("raw_payload"),
    )


def tags(articles: DataFrame) -> DataFrame:
    some = [F.upper("lang")] + [F.when(F.col("id") % k == 0, v) for k, v in ((2, "EN"), (3, "DE"), (5, "FR"), (7, "ES"))]
    return articles.select(F.col("id").alias("article_id"), F.explode(F.array_distinct(F.filter(F.array(*some), lambda x: x.isNotNull()))).alias("ticker"))


def scores(articles: DataFrame, tickers: DataFrame) -> DataFrame:
    text = F.concat("headline", F.lit(". "), "summary")
    x = articles.select("id", lexicon_compound(text, POS, NEG).alias("compound"), (F.col("published_at") + F.make_interval(mins=(F.col("id") % 180).cast("int"))).alias("scored_at"))
    x = x.select("id", F.col("compound").cast("decimal(6,4)").alias("compound"), sentiment_label(F.col("compound")).alias("label"), "scored_at")
    return tickers.join(x, tickers["article_id"] == x["id"]).select("article_id", "ticker", "compound", "label", "scored_at")


def feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = news(spark, sf_dir)
    t = tags(n)
    return n, t, scores(n, t)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(read(spark, sf_dir, "lineitem"), F.col("l_returnflag").alias("ticker"))


def benchmark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(read(spark, sf_dir, "lineitem")).withColumn("ticker", F.lit("ALL"))


def _bars(items: DataFrame, *keys) -> DataFrame:
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return items.groupBy(*keys, F.to_date("l_shipdate").alias("bar_day")).agg((money("l_extendedprice") / money("l_quantity")).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), money("l_quantity").alias("volume"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.upper("event_type").alias("ticker"), F.col("event_id").alias("article_id"), F.col("ts").cast("timestamp").alias("scored_at"), (F.pmod(F.col("value"), F.lit(2.0)) - 1).cast("decimal(6,4)").alias("compound"))


def reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Articles and earnings reports of users."""
    e = read(spark, sf_dir, "events").withColumn("ticker", F.col("user_id").cast("string")).withColumn("ts", F.col("ts").cast("timestamp"))
    earnings = e.where("event_type = 'purchase' AND value >= 150").select("ticker", F.to_timestamp(F.to_date("ts")).alias("report_date")).distinct()
    return e.where("event_type <> 'purchase'").select(F.col("event_id").alias("id"), "ticker", F.col("ts").alias("published_at")), earnings


def filing_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of filings for each customer; the last array is one shorter where the customer's number is even."""
    forms = F.element_at(F.create_map(*[F.lit(x) for x in ("1-URGENT", "8-K", "2-HIGH", "10-K", "3-MEDIUM", "10-Q", "4-NOT SPECIFIED", "4", "5-LOW", "SC 13G")]), F.col("o_orderpriority"))
    row = F.struct(F.col("o_orderkey").alias("k"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0").alias("acc"), forms.alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    rows = F.sort_array(F.collect_list(row))
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("r"))
    docs = F.transform("r", lambda s: F.concat(F.lit("d"), s["acc"]))
    short = F.when(F.col("o_custkey") % 2 == 0, F.slice(docs, 1, F.size(docs) - 1)).otherwise(docs)
    pick = lambda f: F.transform("r", lambda s: s[f])
    return g.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name"), pick("acc").alias("accessionNumber"), pick("form").alias("form"), pick("day").alias("filingDate"), short.alias("primaryDocument"))


def raw_events(spark: SparkSession, sf_dir: str, twice: bool = True) -> DataFrame:
    """Events as JSON payloads, some of another type; with ``twice``, some without an address, and some addresses twice."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 11 == 0, "q").otherwise("n")
    url = F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit("https://live.example/"), (F.floor(F.col("event_id") / 2)).cast("string")))
    if not twice:
        url = F.concat(F.lit("https://live.example/"), F.col("event_id").cast("string"))
    symbols = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))))
    text = F.when(F.col("value") > 100, "record growth").when(F.col("value") < 20, "weak loss").otherwise("steady")
    fields = [kind.alias("T"), F.col("event_id").cast("string").alias("id"), url.alias("url"), symbols.alias("symbols"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.lit(" Wire ").alias("source")]
    headline = F.when(kind == "n", text).alias("headline")
    return e.select(F.to_json(F.struct(*fields, headline)).alias("payload"))
