"""Technical indicators, risk metrics and forward labels from daily bars, for all tickers in one plan.

``bars`` has ticker, timestamp (or any order column named by ``time``), open, high, low, close, volume. All windows of a
ticker share one partitioning and one sort. Windows need all their rows: before that, values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.bounds import check_bound
from newsloom.functions.stats import clip01

# Window lengths, defaults and thresholds that results depend on.
RSI_ROWS, BAND_ROWS, MIN_BARS, HORIZON, THRESHOLD, YEAR = 14, 20, 30, 5, 0.02, 252
DEFAULTS = {"rsi_14": 50.0, "momentum_5d": 0.0, "bb_position": 0.5, "volume_ratio": 1.0}
TINY = 1e-9


def _rolling(x: Column, w, rows: int, f=F.avg) -> Column:
    over = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(over) == rows, f(x).over(over))


def with_indicators(bars: DataFrame, time: str = "timestamp") -> DataFrame:
    """``bars`` with rsi_14, bb_position, momentum_5d and volume_ratio."""
    w = Window.partitionBy("ticker").orderBy(time)
    close, volume = F.col("close").cast("double"), F.col("volume").cast("double")
    change = F.col("_change")
    x = bars.withColumn("_change", close - F.lag(close).over(w))
    gain = _rolling(F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), w, RSI_ROWS)
    loss = _rolling(F.when(change.isNotNull(), -F.least(change, F.lit(0.0))), w, RSI_ROWS)
    nonzero = lambda v: F.when(v == 0, F.lit(TINY)).otherwise(v)
    mean, dev = _rolling(close, w, BAND_ROWS), _rolling(close, w, BAND_ROWS, F.stddev_samp)
    x = x.withColumn("_gain", gain).withColumn("_loss", loss).withColumn("_mean", mean).withColumn("_dev", dev).withColumn("_volume", _rolling(volume, w, BAND_ROWS))
    x = x.withColumn("rsi_14", 100.0 - 100.0 / (1.0 + F.col("_gain") / nonzero(F.col("_loss"))))
    low, high = F.col("_mean") - 2.0 * F.col("_dev"), F.col("_mean") + 2.0 * F.col("_dev")
    x = x.withColumn("bb_position", F.when(F.col("_dev") == 0, F.lit(0.0)).when(F.col("_dev").isNotNull(), clip01(F.try_divide(close - low, high - low))))
    x = x.withColumn("momentum_5d", F.try_divide(close, F.lag(close, 5).over(w)) - 1.0)
    x = x.withColumn("volume_ratio", volume / nonzero(F.col("_volume")))
    return x.drop("_change", "_gain", "_loss", "_mean", "_dev", "_volume")


def price_features(bars: DataFrame, time: str = "timestamp") -> DataFrame:
    """The latest indicators of each ticker; defaults where it has under 30 bars or the latest is missing."""
    latest = [F.max_by(F.struct(c), F.col(time))[c].alias(c) for c in DEFAULTS]
    x = with_indicators(bars, time).groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"), *latest)
    return x.select("ticker", *[F.coalesce(F.when(F.col("_n") >= MIN_BARS, F.col(c)), F.lit(v)).alias(c) for c, v in DEFAULTS.items()])


def last_bars(bars: DataFrame, limit: int = 365, time: str = "timestamp") -> DataFrame:
    """The last ``limit`` bars of each ticker."""
    check_bound("bars", limit, "limit")
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(time)))
    return bars.withColumn("_rn", rn).where(F.col("_rn") <= limit).drop("_rn")


def with_drawdown(bars: DataFrame, time: str = "timestamp") -> DataFrame:
    """``bars`` with running_max and drawdown."""
    top = F.max("close").over(Window.partitionBy("ticker").orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("running_max", top).withColumn("drawdown", F.try_divide(F.col("close"), F.col("running_max")) - 1.0)


def risk_metrics(bars: DataFrame, benchmark: DataFrame, time: str = "timestamp", days: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Annual volatility and beta from returns on days of both, drawdown and return from all prices; zeros with too few bars. ``days``: of bars since so many days before ``as_of``."""
    if days is not None:
        check_bound("risk_days", days, "days")
        since = F.col(time) >= as_of - F.make_interval(days=F.lit(days))
        bars, benchmark = bars.where(since), benchmark.where(since)
    w = b = Window.partitionBy("ticker").orderBy(time)
    own = with_drawdown(bars, time).withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1.0)
    bench = benchmark.withColumn("ticker", F.lit("benchmark")).withColumn("bench_ret", F.try_divide(F.col("close"), F.lag("close").over(b)) - 1.0)
    totals = own.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("drawdown").alias("max_drawdown"), F.max("close").alias("high_water_mark"),
        F.max_by("close", time).alias("_last"), F.min_by("close", time).alias("_first"),
    )
    bench = bench.select(time, "bench_ret")
    both = own.join(bench, time).where("ret IS NOT NULL AND bench_ret IS NOT NULL").groupBy("ticker").agg(
        F.count(F.lit(1)).alias("m"), F.stddev_samp("ret").alias("_dev"), F.covar_samp("ret", "bench_ret").alias("_cov"), F.var_samp("bench_ret").alias("_var")
    )
    enough = benchmark.agg((F.count(F.lit(1)) >= MIN_BARS).alias("_enough"))
    x = totals.join(both, "ticker", "left").join(F.broadcast(enough))
    ok = F.col("_enough") & (F.col("n") >= MIN_BARS) & (F.coalesce("m", F.lit(0)) > 0)
    beta = F.when(F.col("_var") > 0, F.try_divide(F.col("_cov"), F.col("_var"))).otherwise(0.0)
    values = {
        "annualized_volatility": F.col("_dev") * F.sqrt(F.lit(float(YEAR))), "beta_to_benchmark": beta, "max_drawdown": F.col("max_drawdown"), "high_water_mark": F.col("high_water_mark"),
        "cumulative_return": F.when((F.col("n") > 1) & (F.col("_first") != 0), F.try_divide(F.col("_last"), F.col("_first")) - 1.0).otherwise(0.0),
    }
    return x.select("ticker", *[F.coalesce(F.when(ok, v), F.lit(0.0)).alias(k) for k, v in values.items()])


def return_label(forward_return: Column) -> Column:
    return F.when(forward_return > THRESHOLD, "RISE").when(forward_return < -THRESHOLD, "FALL").otherwise("STABLE")


def forward_labels(bars: DataFrame, time: str = "timestamp", horizon: int = HORIZON) -> DataFrame:
    """``bars`` with forward_return (null for the last rows) and label; tickers with no more bars than the horizon are left out."""
    w = Window.partitionBy("ticker")
    ahead = F.lead("close", horizon).over(w.orderBy(time))
    x = bars.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("forward_return", F.try_divide(ahead - F.col("close"), F.col("close")))
    return x.where(F.col("_n") > horizon).withColumn("label", return_label(F.col("forward_return"))).drop("_n")


def overlay(bars: DataFrame, trend: DataFrame, bar_day: str = "bar_day") -> DataFrame:
    """Bars from the first day of the trend on (all, if there is none), with that day's sentiment."""
    point = F.when(F.col("news_day").isNotNull(), F.struct("news_day", F.round("mean_compound", 3)))
    days = trend.groupBy("ticker").agg(F.min("news_day").alias("_from"), F.map_from_entries(F.collect_list(point)).alias("_days"))  # in one aggregation, so that the trend is computed once
    x = bars.join(days, "ticker", "left").where(F.col("_from").isNull() | (F.col(bar_day) >= F.col("_from")))
    return x.select("ticker", bar_day, (F.round(F.col("close") * 100) / 100).alias("price"), F.try_element_at("_days", F.col(bar_day)).alias("sentiment"))
