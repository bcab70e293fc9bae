"""Jobs: backfill from several sources, labels and models anew. Each is one plan over all tickers and can be repeated.

What a loop over tickers would log for each of them comes back as a DataFrame of counts or states.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.bounds import check_bound
from newsloom.operators import signals
from newsloom.operators.ingest import insert_new, upsert_labels
from newsloom.operators.market import HORIZON, forward_labels

# Fixed value: rows that a model needs.
MIN_SAMPLES = 30


def readable(readers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The sources that can be opened, and the error of each other one; one that fails doesn't hinder the rest."""
    frames, errors = {}, {}
    for name, read in readers.items():
        try:
            frames[name] = read()
        except PySparkException as e:
            errors[name] = e.getCondition() or type(e).__name__
    return frames, errors


def fetched(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], root: str, threads: int = 10) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Sources read to their ends, several at a time, each written to a folder of its own; and the error of each that broke on the way, which doesn't hinder the rest."""
    frames, errors = {}, {}

    def one(name: str) -> None:
        try:
            df = readers[name]()
            df.write.mode("overwrite").parquet(f"{root}/{name}")
            frames[name] = spark.read.schema(df.schema).parquet(f"{root}/{name}")
        except Exception as e:  # whatever a source does, the others go on
            errors[name] = (e.getCondition() if isinstance(e, PySparkException) else None) or type(e).__name__

    with ThreadPoolExecutor(max_workers=threads) as pool:
        list(pool.map(inheritable_thread_target(spark)(one), readers))
    return frames, errors


def or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """What ``read`` opens, or no rows of ``schema`` where it fails."""
    frames, _ = readable({"source": read})
    return frames.get("source", spark.createDataFrame([], schema))


def backfill(sources: dict[str, DataFrame], articles: DataFrame, as_of: Column, ticker: Column, company: Column | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The new articles of several sources, and each source's counts: fetched, failed, skipped, inserted, tagged.

    An item without address or headline failed; one without a signal, of a known story or address, or beside a newer or lower-numbered one of its story
    is skipped; the rest is inserted, with a tag for each symbol. Items have an id that is theirs in all sources. ``ticker`` and ``company`` may be columns of the items, so
    that one call serves many tickers. ``limit``: of each source only so many of the newest items.
    """
    if limit is not None:
        check_bound("backfill_limit", limit, "limit")
        sources = {name: df.orderBy(F.desc("published_at"), "id").limit(limit) for name, df in sources.items()}
    items = None
    for name, df in sources.items():
        df = df.withColumn("feed", F.lit(name))
        items = df if items is None else items.unionByName(df, allowMissingColumns=True)
    new = insert_new(items, articles, as_of, ticker, company)
    whole = (F.coalesce("url", F.lit("")) != "") & (F.coalesce("headline", F.lit("")) != "")
    came = items.groupBy("feed").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(~whole).alias("failed"))
    kept = new.groupBy("feed").agg(F.count(F.lit(1)).alias("inserted"), F.sum(F.greatest(F.coalesce(F.size("symbols"), F.lit(0)), F.lit(0)).cast("long")).alias("tagged"))
    counts = came.join(kept, "feed", "left").select("feed", "fetched", "failed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("inserted", "tagged")])
    return new, counts.withColumn("skipped", F.col("fetched") - F.col("failed") - F.col("inserted"))


def refresh_price_labels(bars: DataFrame, stored: DataFrame, wanted: DataFrame, as_of: Column, time: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """The whole table of labels after a refresh for the tickers in ``wanted``, and ticker, state and upserted rows of each.

    The state is ``ok``, ``no_bars``, or ``too_few_bars`` if there are no more than the horizon; those keep the labels they have. Repeating it changes nothing.
    """
    tickers = wanted.select(F.upper("ticker").alias("ticker")).distinct()
    mine = bars.join(tickers, "ticker", "left_semi")
    fresh = forward_labels(mine, time).select(
        "ticker", F.to_date(time).alias("date"), F.col("close").cast("decimal(12,4)").alias("close_price"), F.col("forward_return").cast("decimal(10,6)").alias("forward_return_5d"), "label", as_of.alias("fetched_at"),
    )
    n = F.coalesce("n", F.lit(0))
    state = F.when(n == 0, "no_bars").when(n <= HORIZON, "too_few_bars").otherwise("ok")
    report = tickers.join(mine.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")), "ticker", "left").select("ticker", state.alias("state"), F.when(n > HORIZON, n).otherwise(0).alias("upserted"))
    return upsert_labels(stored, fresh), report


def retrain(path: str, scores: DataFrame, bars: DataFrame, labels: DataFrame | None = None, time: str = "timestamp", **model) -> dict:
    """A new model of all tickers' rows in place of the one at ``path``; its state, rows and metrics.

    Tickers with too few scores or bars have no rows and are not in ``tickers_used``. With nothing to train on the old model stays.
    """
    data = signals.with_split(signals.without_infinities(signals.training_dataset(scores, bars, labels, time)), "news_day")
    rows, used = data.agg(F.count(F.lit(1)), F.count_distinct("ticker")).first()
    if not rows:
        return {"status": "skipped", "reason": "no_data"}
    fitted, info = signals.train_model(data, **model)
    signals.save_model(fitted, info, path)
    return {"status": "ok", "tickers_used": used, "rows_trained": rows, "metrics": {k: info[k] for k in ("accuracy", "brier", "ece")}}


def load_or_train(path: str, scores: DataFrame, bars: DataFrame, labels: DataFrame | None = None, time: str = "timestamp", least: int = MIN_SAMPLES, **model):
    """The model at ``path``, or one that is trained and stored there; None if there are fewer than ``least`` rows to train on."""
    if (known := signals.load_model(path)) is not None:
        return known
    if signals.training_dataset(scores, bars, labels, time).limit(least).count() < least:
        return None
    return signals.load_model(path) if retrain(path, scores, bars, labels, time, **model)["status"] == "ok" else None


def append_predictions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``stored`` with new predictions; one of a ticker and time that is there already stays out, so a replay adds nothing. An id is a hash of ticker and time."""
    new = fresh.dropDuplicates(["ticker", "predicted_at"]).join(stored.select("ticker", "predicted_at"), ["ticker", "predicted_at"], "left_anti")
    return stored.unionByName(new.withColumn("id", F.xxhash64("ticker", "predicted_at")).select(*stored.columns))
