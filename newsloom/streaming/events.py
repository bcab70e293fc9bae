"""The live path: events from a stream become articles, tags and scores, each address once.

One query with one checkpoint, and no state but its offsets. What has been stored is told by an index of addresses, split by hash, that stream and backfill both write
to: a micro-batch reads only the parts that its addresses fall into. Each batch is written to folders named by the query and the batch's number, so a replay after a
crash rewrites the same rows (its own addresses don't count as known), and a query with a new checkpoint overwrites nothing. An article is taken however late it comes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from newsloom.functions.text import NEGATIVE, POSITIVE, lexicon_compound, sentiment_label, sentiment_parts
from newsloom.functions.times import parse_iso
from newsloom.operators.ingest import default_source, explode_symbols
from newsloom.schemas import NEWS_EVENT
from newsloom.sources.feeds import event_filter
from newsloom.sources.live import BATCH, events_of
from newsloom.sources.tables import delete, folders

# Seconds between batches, articles that a subscriber's page has.
SECONDS, PAGE = 5, 20
#: Parts of the index of addresses.
PARTS = 64
TABLES = ("articles", "article_tickers", "sentiment_scores")


def parse_events(events: DataFrame, as_of: Column) -> DataFrame:
    """``payload`` JSON rows, an event or a list of events each, as articles with symbols; those without an address go. Works on batches and streams."""
    when = F.col("received_at") if "received_at" in events.columns else as_of
    e = events.select(F.explode(events_of(F.col("payload"))).alias("payload"), when.alias("received_at"))
    e = e.withColumn("e", F.from_json("payload", NEWS_EVENT)).where("e.url IS NOT NULL AND e.url <> ''").where(event_filter(F.col("payload"), F.col("e")))
    published = parse_iso(F.coalesce("e.created_at", "e.published_at"), as_of)
    return e.select(
        "e.url", F.col("e.id").alias("external_id"), F.coalesce("e.headline", F.lit("")).alias("headline"), F.col("e.summary").alias("summary"),
        default_source(F.col("e.source")).alias("source"), published.alias("published_at"), "e.symbols", F.xxhash64("e.url").alias("id"), F.col("payload").alias("raw_payload"), "received_at",
    )


def score(articles: DataFrame, positive=POSITIVE, negative=NEGATIVE) -> DataFrame:
    """One lexicon score for each symbol of each article."""
    text = F.concat(F.coalesce("headline", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit("")))
    x = explode_symbols(articles).withColumn("compound", lexicon_compound(text, positive, negative))
    parts = {k: v.cast("decimal(5,4)") for k, v in sentiment_parts(F.col("compound")).items()}
    return x.withColumns(parts).withColumn("label", sentiment_label(F.col("compound"))).withColumn("compound", F.col("compound").cast("decimal(6,4)"))


def watched(articles: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Articles of which a symbol was subscribed when they were received: ``ticker`` and, if it has one, ``valid_from``."""
    since = F.col("valid_from") if "valid_from" in subscriptions.columns else F.lit(None)
    wanted = subscriptions.select(F.upper("ticker").alias("ticker"), since.cast("timestamp").alias("_since"))
    mine = explode_symbols(articles).select("url", "received_at", "ticker").alias("m")
    on = (F.col("m.ticker") == F.col("w.ticker")) & (F.col("_since").isNull() | (F.col("_since") <= F.col("m.received_at")))
    some = mine.join(wanted.alias("w"), on, "left_semi").select("url", "received_at")
    return articles.join(some, ["url", "received_at"], "left_semi")


def subscribed(tickers: DataFrame) -> DataFrame:
    """One row: the tickers in upper case, each once and in order."""
    return tickers.agg(F.array_sort(F.collect_set(F.upper("ticker"))).alias("tickers"))


def subscribe(subscriptions: DataFrame, ticker: Column, as_of: Column) -> DataFrame:
    """``subscriptions`` (ticker, valid_from) with those of ``ticker``, a column without rows of its own, from ``as_of`` on; one that is there stays as it is."""
    new = subscriptions.sparkSession.range(1).select(F.upper(F.trim(ticker)).alias("ticker"), as_of.alias("valid_from")).where("ticker <> ''")
    return subscriptions.unionByName(new.join(subscriptions.select(F.upper("ticker").alias("ticker")), "ticker", "left_anti"))


def read_events(spark: SparkSession, path: str, max_files: int = BATCH) -> DataFrame:
    """A folder of text files as the stream, so many files a batch; each line is a payload. :func:`newsloom.sources.live.read_live` counts events."""
    return spark.readStream.schema("value STRING").option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed("value", "payload")


def publish(events: DataFrame, path: str) -> None:
    """Appends events (a payload each) to the folder of a stream of text files."""
    events.select(F.col("payload").alias("value")).write.mode("append").text(path)


# --- addresses that are stored -----------------------------------------------------------------------------------------
_KNOWN = "url STRING, run STRING, batch LONG, part INT"


def _part(url: str = "url") -> Column:
    return F.pmod(F.xxhash64(url), F.lit(PARTS)).cast("int")


def remember(articles: DataFrame, root: str, run: str, batch: int = 0) -> None:
    """Puts the addresses of stored articles into the index, as those of a batch of a run; anew if they are there already."""
    part = articles.select("url", _part().alias("part")).repartition("part").distinct()  # one shuffle
    part.write.mode("overwrite").partitionBy("part").parquet(f"{root}/known/run={run}/batch={batch}")


def unknown(articles: DataFrame, root: str, run: str = "", batch: int = -1, few: bool = True) -> DataFrame:
    """Articles whose address isn't in the index, but for what this batch of this run has put there itself. ``few``: only the parts that they fall into are read."""
    spark = articles.sparkSession
    if not folders(spark, f"{root}/known"):
        return articles
    known = spark.read.schema(_KNOWN).parquet(f"{root}/known").where(~((F.col("run") == run) & (F.col("batch") == batch)))
    if few:
        known = known.where(F.col("part").isin([r["part"] for r in articles.select(_part().alias("part")).distinct().collect()]))  # at most PARTS
    return articles.join(known.select("url"), "url", "left_anti")


def compact_index(spark: SparkSession, root: str, run: str) -> None:
    """Makes one batch of all batches of a stopped run, but its last one, which may come again. If this is cut short, addresses are there twice, and none is lost."""
    path = f"{root}/known/run={run}"
    done = sorted(int(n.partition("=")[2]) for n in folders(spark, path))[:-1]
    if len(done) > 1:
        old = spark.read.schema("url STRING, part INT, batch LONG").parquet(path).where(F.col("batch").isin(done))
        remember(old, root, f"{run}-upto{done[-1]}")
        for number in done:
            delete(spark, f"{path}/batch={number}")


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """What all runs have written to one of the :data:`TABLES`."""
    return spark.read.parquet(f"{root}/{name}").drop("run", "batch")


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to; it stays the same when the query is started again."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def start_ingest(stream: DataFrame, root: str, checkpoint: str, as_of: Column, subscriptions: str | None = None, once: bool = True, seconds: float = SECONDS, **lexicon) -> StreamingQuery:
    """Starts the query; it writes to ``root``/articles, article_tickers and sentiment_scores, a folder for each run and batch.

    ``subscriptions``: the folder of a Parquet table of tickers, read anew for each batch; articles that have none of them when they come are dropped, and are not
    known then, so that they count if they come again. ``once``: everything that is there, then the query ends; else it goes on, a batch every ``seconds``.
    """
    parsed = parse_events(stream, as_of)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = run_name(spark, checkpoint)
        few = batch.limit(4 * PARTS).count() < 4 * PARTS  # else nearly all parts are met
        some = batch if subscriptions is None else watched(batch, spark.read.parquet(subscriptions))
        first = F.min_by(F.struct(*some.columns), F.struct("received_at", "published_at", "raw_payload"))
        once_each = some.groupBy("url").agg(first.alias("e")).select("e.*")
        fresh = unknown(once_each, root, run, number, few).persist()
        scored = score(fresh, **lexicon)
        for name, df in zip(
            TABLES, (
                fresh.drop("symbols", "received_at").withColumn("ingested_at", as_of),
                scored.select(F.col("id").alias("article_id"), "ticker"),
                scored.select(F.col("id").alias("article_id"), "ticker", F.lit("lexicon").alias("model"), "score_positive", "score_negative", "score_neutral", "compound", "label", as_of.alias("scored_at")),
            ), strict=True,
        ):
            df.write.mode("overwrite").parquet(f"{root}/{name}/run={run}/batch={number}")
        remember(fresh, root, run, number)
        fresh.unpersist()

    writer = parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def drain(query: StreamingQuery) -> None:
    """Waits until a query that goes on has read what is there, then ends it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Mean score and number by ticker and day (``published_at``, ``compound``), for a batch or, in update mode, a stream."""
    x = stream.withWatermark("published_at", late) if stream.isStreaming else stream
    return x.groupBy("ticker", F.window("published_at", "1 day").alias("w")).agg(F.avg(F.col("compound").cast("double")).alias("mean_compound"), F.count(F.lit(1)).alias("n")).select("ticker", F.col("w.start").alias("day_start"), "mean_compound", "n")


# --- push --------------------------------------------------------------------------------------------------------------
class NewestArticles(StatefulProcessor):
    """For each ticker, the :data:`PAGE` newest articles so far and the greatest id that was sent."""

    def __init__(self, page: int = PAGE):
        self.page = page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("feed", "ids ARRAY<BIGINT>, times ARRAY<BIGINT>, sent BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids, times, sent = self.state.get() if self.state.exists() else ([], [], None)
        newest = list(zip([-t for t in times], ids, strict=True))
        for part in rows:
            newest = sorted([*newest, *zip((-part["published_us"]).tolist(), part["id"].tolist(), strict=True)])[: self.page]
        out = sorted((i, -t) for t, i in newest if sent is None or i > sent)
        if out:
            sent = out[-1][0]
        self.state.update(([i for _, i in newest], [-t for t, _ in newest], sent))
        names = pd.Series([key[0]] * len(out), dtype=object)  # not pandas' own strings, which Arrow splits into chunks
        yield pd.DataFrame({"ticker": names, "id": np.array([i for i, _ in out], np.int64), "published_us": np.array([t for _, t in out], np.int64)})

    def close(self) -> None:
        pass


def push_feed(tagged: DataFrame, page: int = PAGE) -> DataFrame:
    """What each ticker's subscribers are sent in each micro-batch of a stream of articles (``ticker``, ``id``, ``published_at``): of the ``page`` newest so far, those with an id
    above all that were sent. An article that comes late and is not among the newest is never sent, nor is one with a lower id.

    The state of a ticker, a page and a cursor, lies in the state store of its partition; rows are emitted there, by id, and whatever sink the caller starts takes them.
    """
    x = tagged.select("ticker", "id", F.unix_micros("published_at").alias("published_us"))
    out = x.groupBy("ticker").transformWithStateInPandas(NewestArticles(page), "ticker STRING, id LONG, published_us LONG", "Append", "None")
    return out.select("ticker", "id", F.timestamp_micros("published_us").alias("published_at"))


def start_push(tagged: DataFrame, root: str, checkpoint: str, page: int = PAGE) -> StreamingQuery:
    """Writes what is sent to ``root``, a folder for each micro-batch (column ``poll``), until everything there is has been read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/poll={number}")

    conf, name = tagged.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return push_feed(tagged, page).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
