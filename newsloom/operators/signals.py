"""Training sets, validation metrics, rule signals, and a small model with probabilities and attributions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.ranks import order_statistics, with_rank, with_ranges
from newsloom.functions.stats import ewm_adjusted_over, ewma_by
from newsloom.functions.text import lexicon_compound, sentiment_label, sentiment_parts, three_class
from newsloom.operators.market import forward_labels, price_features, with_indicators
from newsloom.operators.news import sentiment_summary, trailing_volatility, trailing_volume

# Names and numbers that results depend on.
FEATURES = ("ewma_sentiment_1d", "ewma_sentiment_7d", "sentiment_volatility", "article_volume_24h", "rsi_14", "momentum_5d", "bb_position", "volume_ratio")
MIN_SCORES, MIN_BARS, MIN_LABELS, SPLIT_FROM, SPAN, BINS = 40, 40, 30, 50, 7, 10


def daily_features(scores: DataFrame) -> DataFrame:
    """EWMA, mean, deviation and number of each ticker's scores by day of scoring."""
    x = ewma_by(scores, ["ticker", F.to_date("scored_at").alias("news_day")], F.col("compound").cast("double"), F.col("scored_at"), F.col("article_id"))
    mean = F.col("total") / F.col("n")
    spread = F.greatest(F.col("squares") - F.col("total") * mean, F.lit(0.0))
    deviation = F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).otherwise(0.0)
    return x.select("ticker", "news_day", F.col("ewma").alias("ewma_sentiment_1d"), mean.alias("daily_mean"), deviation.alias("sentiment_volatility"), F.col("n").cast("double").alias("article_volume_24h"))


def with_week_average(daily: DataFrame) -> DataFrame:
    """``daily`` with ewma_sentiment_7d: adjusted exponential weights over the daily means, by rows."""
    return daily.withColumn("ewma_sentiment_7d", ewm_adjusted_over("daily_mean", SPAN, ["ticker"], "news_day"))


def training_dataset(scores: DataFrame, bars: DataFrame, labels: DataFrame | None = None, time: str = "timestamp") -> DataFrame:
    """Daily features with the day's indicators and target, for tickers with 40 scores and 40 bars; rows with a gap are left out.

    Stored labels are the target where a ticker has 30 with a return; else the target comes from the bars.
    """
    enough = scores.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SCORES).select("ticker")
    daily = with_week_average(daily_features(scores.join(enough, "ticker", "left_semi")))
    w = Window.partitionBy("ticker")
    b = bars.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= MIN_BARS).drop("_n")
    tech = forward_labels(with_indicators(b, time), time).withColumn("news_day", F.to_date(time)).select("ticker", "news_day", *FEATURES[4:], F.col("label").alias("target"))
    x = daily.join(tech, ["ticker", "news_day"])
    if labels is not None:
        known = labels.where("forward_return_5d IS NOT NULL")
        many = known.groupBy("ticker").agg((F.count(F.lit(1)) >= MIN_LABELS).alias("_stored"))
        mine = known.select("ticker", F.col("date").alias("news_day"), F.col("label").alias("_label"))
        x = x.join(many, "ticker", "left").join(mine, ["ticker", "news_day"], "left").withColumn("target", F.when(F.coalesce("_stored", F.lit(False)), F.col("_label")).otherwise(F.col("target")))
    return x.select("ticker", "news_day", *FEATURES, "target").na.drop("any")


def without_infinities(df: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Rows whose columns are all finite."""
    inf = F.lit(float("inf"))
    return df.select(*[F.when(~F.isnan(c) & (F.abs(F.col(c)) != inf), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]).na.drop("any", subset=list(columns))


def with_split(df: DataFrame, *order: str, partition: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """``df`` with ``part``: train for the first 80 %, validation for the rest; both (``all``) below 50 rows. The first order column is a number, date or time."""
    x = with_rank(with_ranges(df, order[0], "_range"), partition, [F.col(c) for c in order], F.col("_range"))
    part = F.when(F.col("_n") < SPLIT_FROM, "all").when(F.col("_rank") <= F.floor(F.col("_n") * F.lit(0.8)), "train").otherwise("validation")
    return x.withColumn("part", part).drop("_n", "_rank", "_range")


def argmax_label(probabilities: dict[str, Column]) -> tuple[Column, Column]:
    """The most likely label and its probability; of equal ones the first."""
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-k).alias("k"), F.lit(v).alias("v")) for k, (v, p) in enumerate(probabilities.items())]))
    return best["v"], best["p"]


def calibration_metrics(df: DataFrame, y: Column, probabilities: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, brier (mean over all cells) and ece (ten bins, open below and closed above) in one pass over the rows."""
    label, confidence = argmax_label(probabilities)
    cells = sum((F.pow(F.when(y == v, F.lit(1.0)).otherwise(0.0) - p, F.lit(2.0)) for v, p in probabilities.items()), F.lit(0.0)) / F.lit(float(len(probabilities)))
    edges = [k / BINS for k in range(BINS + 1)]
    bin_ = F.coalesce(*[F.when((F.col("_c") > lo) & (F.col("_c") <= hi), F.lit(k)) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))])
    x = df.select(*by, (label == y).cast("double").alias("_ok"), confidence.alias("_c"), cells.alias("_b"))
    binned = x.groupBy(*by, bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_ok").alias("_oks"), F.sum("_c").alias("_cs"), F.sum("_b").alias("_bs"))
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_oks") - F.col("_cs")))
    return binned.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum("_oks") / F.sum("_n")).alias("accuracy"), (F.sum("_bs") / F.sum("_n")).alias("brier"), (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("_n")).alias("ece"))


def rule_signal(sentiment: Column) -> tuple[Column, Column]:
    """Direction and confidence from the day's sentiment alone."""
    label = F.when(sentiment > 0.15, "RISE").when(sentiment < -0.15, "FALL").otherwise("STABLE")
    return label, F.least(F.lit(0.85), F.lit(0.52) + F.lit(0.35) * F.abs(sentiment))


def calibrated_confidence(p: Column, ece: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p * (F.lit(1.0) - ece)))


def inference_features(articles: DataFrame, tickers: DataFrame, scores: DataFrame, bars: DataFrame, as_of: Column, time: str = "timestamp", **options) -> DataFrame:
    """The model's inputs now, for every ticker with a score; these differ from the training formulas on purpose."""
    day = sentiment_summary(articles, tickers, scores, as_of, days=1, **options).select("ticker", F.col("ewma_compound").alias("ewma_sentiment_1d"))
    week = sentiment_summary(articles, tickers, scores, as_of, days=7, **options).select("ticker", F.col("ewma_compound").alias("ewma_sentiment_7d"))
    x = scores.select("ticker").distinct().join(day, "ticker", "left").join(week, "ticker", "left")
    x = x.join(trailing_volatility(scores, as_of), "ticker", "left").join(trailing_volume(scores, as_of), "ticker", "left").join(price_features(bars, time), "ticker", "left")
    defaults = {"rsi_14": 50.0, "momentum_5d": 0.0, "bb_position": 0.5, "volume_ratio": 1.0}
    named = {"sentiment_volatility": "volatility", "article_volume_24h": "article_volume"}
    return x.select("ticker", *[F.coalesce(F.col(named.get(c, c)).cast("double"), F.lit(defaults.get(c, 0.0))).alias(c) for c in FEATURES])


def top_features(df: DataFrame, importances: str = "feature_importances", key: str = "id", n: int = 5) -> DataFrame:
    """The ``n`` features of largest size of each row, without those whose name begins with ``__``, and their size in per cent of the largest."""
    x = df.select(key, F.explode(F.map_filter(importances, lambda k, v: ~k.startswith("__"))).alias("feature", "value"))
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "feature")
    x = x.withColumn("feature_rank", F.row_number().over(w)).where(F.col("feature_rank") <= n)
    largest = F.greatest(F.max(F.abs("value")).over(Window.partitionBy(key)), F.lit(1e-9))
    return x.withColumn("percent", F.round(F.abs("value") / largest * 100).cast("long"))


def train_model(df: DataFrame, trees: int = 150, depth: int = 4, seed: int = 7, boosted: bool = False, step: float = 0.05) -> tuple[PipelineModel, dict]:
    """A model on the features of training and ``all`` rows of ``part``, and its metrics on the others.

    A forest, or with ``boosted`` a booster for each label against the rest, whose probabilities are scaled to a sum of 1.
    """
    data = without_infinities(df)
    names = [r["target"] for r in data.where("part <> 'validation'").select("target").distinct().where("target IS NOT NULL").orderBy("target").collect()]
    data = data.withColumns({f"is_{k}": (F.col("target") == v).cast("double") for k, v in enumerate(names)})
    train, held = data.where("part <> 'validation'"), data.where("part <> 'train'")
    stages = [StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"), VectorAssembler(inputCols=list(FEATURES), outputCol="features")]
    if boosted:
        for k in range(len(names)):
            one = GBTClassifier(labelCol=f"is_{k}", predictionCol=f"said_{k}", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed)
            stages.append(one.setProbabilityCol(f"p_{k}").setRawPredictionCol(f"raw_{k}"))
    else:
        stages.append(RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.9, seed=seed))
    model, info = Pipeline(stages=stages).fit(train), {"labels": names, "boosted": boosted}
    scored = model.transform(held).withColumn("_p", _probabilities(info))
    row = calibration_metrics(scored, F.col("target"), {v: F.col("_p")[k] for k, v in enumerate(names)}).first()
    return model, info | {"accuracy": row["accuracy"], "brier": row["brier"], "ece": row["ece"], "rows": row["n"]}


def _probabilities(info: dict) -> Column:
    """The labels' probabilities as an array, of rows that the model has scored."""
    if not info.get("boosted"):
        return vector_to_array("probability")
    own = [vector_to_array(f"p_{k}")[1] for k in range(len(info["labels"]))]
    total = sum(own, F.lit(0.0))
    return F.array(*[F.when(total > 0, p / total).otherwise(1.0 / len(own)) for p in own])


def save_model(model: PipelineModel, info: dict, path: str) -> None:
    model.write().overwrite().save(str(PurePosixPath(path) / "model"))
    from pyspark.sql import SparkSession

    SparkSession.active().createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(str(PurePosixPath(path) / "info"))


def load_model(path: str) -> tuple[PipelineModel, dict] | None:
    """What :func:`save_model` wrote; None if there is nothing that can be read."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    try:
        info = json.loads(SparkSession.active().read.text(str(PurePosixPath(path) / "info")).first()["value"])
    except (AnalysisException, TypeError, ValueError):
        return None
    return PipelineModel.load(str(PurePosixPath(path) / "model")), info


def predict(model: PipelineModel, info: dict, rows: DataFrame) -> DataFrame:
    """``rows`` with probabilities by label, recommendation and calibrated confidence."""
    x = rows
    for stage in model.stages[1:]:
        x = stage.transform(x)
    names = info["labels"]
    x = x.withColumn("_p", _probabilities(info))
    label, p = argmax_label({v: F.col("_p")[k] for k, v in enumerate(names)})
    x = x.withColumn("probabilities", F.map_from_arrays(F.array(*map(F.lit, names)), F.col("_p")))
    return x.withColumn("recommendation", label).withColumn("confidence", calibrated_confidence(p, F.lit(info["ece"]))).select(*rows.columns, "probabilities", "recommendation", "confidence")


def shapley(model: PipelineModel, info: dict, rows: DataFrame, background: dict[str, float], key: str = "id") -> DataFrame:
    """Exact Shapley values of the recommended label's probability: all 256 sets of the eight features, others at the background.

    ``rows`` come from :func:`predict`. The sets are rows too, so Spark scores them; the weighted sums are a group by.
    """
    k = len(FEATURES)
    masks = rows.select(key, "recommendation", *FEATURES, F.explode(F.sequence(F.lit(0), F.lit(2**k - 1))).alias("mask"))
    bit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    probed = masks.select(key, "recommendation", "mask", *[F.when(bit(i), F.col(c)).otherwise(F.lit(background[c])).alias(c) for i, c in enumerate(FEATURES)])
    for stage in model.stages[1:]:
        probed = stage.transform(probed)
    probed = probed.withColumn("_p", _probabilities(info))
    p = F.coalesce(*[F.when(F.col("recommendation") == v, F.col("_p")[j]) for j, v in enumerate(info["labels"])])
    size = F.bit_count("mask")
    fact = lambda x: F.factorial(x.cast("int")).cast("double")
    total = float(np.prod(np.arange(1, k + 1)))
    shares = []
    for i, c in enumerate(FEATURES):
        inside = fact(F.greatest(size - 1, F.lit(0))) * fact(k - size) / F.lit(total)
        outside = fact(size) * fact(F.greatest(k - size - 1, F.lit(0))) / F.lit(total)
        shares.append(F.sum(F.when(bit(i), F.col("_v") * inside).otherwise(-F.col("_v") * outside)).alias(c))
    return probed.withColumn("_v", p).groupBy(key).agg(*shares)


def as_prediction(rows: DataFrame, as_of: Column, horizon_days: int = 5) -> DataFrame:
    """Rows with recommendation and confidence as stored predictions; without a model they come from the rule."""
    if "recommendation" not in rows.columns:
        label, confidence = rule_signal(F.col("ewma_sentiment_1d"))
        rows = rows.withColumn("recommendation", label).withColumn("confidence", confidence)
    return rows.select(
        "ticker", as_of.alias("predicted_at"), "recommendation", F.col("confidence").cast("decimal(5,4)").alias("confidence"), F.col("ewma_sentiment_1d").cast("decimal(6,4)").alias("sentiment_score"),
        F.col("rsi_14").cast("decimal(6,2)").alias("price_rsi"), F.create_map(*[x for c in FEATURES for x in (F.lit(c), F.col(c))]).alias("feature_importances"), F.lit(horizon_days).alias("horizon_days"),
    )


def prediction_history(predictions: DataFrame, ticker: str, limit: int = 100) -> DataFrame:
    return predictions.where(F.col("ticker") == ticker.upper()).orderBy(F.desc("predicted_at")).limit(limit)


def prediction_by_id(predictions: DataFrame, number: int) -> DataFrame:
    return predictions.where(F.col("id") == number).limit(1)


def latency_percentiles(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Median, and the value at place max(int(0.99 n), 1) in order, of each group."""
    middle = {"lower": lambda n: F.floor((n + 1) / 2), "upper": lambda n: F.ceil((n + 1) / 2)}
    found = order_statistics(df, value, by, middle | {"p99": lambda n: F.greatest(F.floor(n * F.lit(0.99)), F.lit(1))})
    return found.select(*by, (F.col("lower") + (F.col("upper") - F.col("lower")) * 0.5).alias("p50"), "p99")


def ticker_search(symbols: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Symbols for a search text: exact, symbol prefix, name prefix, all words in the name, text in the name."""
    q = query.strip().upper()
    words, sym, name = q.split(), F.col("symbol"), F.upper("name")
    if not q:
        return symbols.limit(0).withColumn("search_rank", F.lit(0))
    every = F.lit(len(words) > 1)
    for word in words:
        every = every & name.contains(word)
    rank = F.when(sym == q, 0).when(sym.startswith(q), 1).when(name.startswith(q), 2).when(every, 3).when(name.contains(q), 4)
    return symbols.withColumn("search_rank", rank).where("search_rank IS NOT NULL").orderBy("search_rank", "symbol").limit(limit)


# Characters of a text that a transformer gets, and texts of a batch.
CHARACTERS, TEXTS = 512, 32


def engine_input(headline: Column, summary: Column) -> Column:
    """Headline and summary as one text, cut to what a transformer takes."""
    return F.substring(F.concat(F.coalesce(headline, F.lit("")), F.lit(". "), F.coalesce(summary, F.lit(""))), 1, CHARACTERS)


def sentiment_udf(load, texts: int = TEXTS):
    """A pandas UDF (text) -> positive, negative and neutral score; null where there is no engine.

    ``load`` gives a function of a list of texts to a list of such triples. It is called once in each task, and so imports and reads its model there; if it
    fails, all scores of the task are null. Texts go in ``texts`` at a time.
    """

    @F.pandas_udf("positive double, negative double, neutral double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            engine = load()
        except Exception:  # no engine here
            engine = None
        for batch in batches:
            rows = [r for k in range(0, len(batch), texts) for r in engine(batch.iloc[k : k + texts].tolist())] if engine else [(None, None, None)] * len(batch)
            yield pd.DataFrame(rows, columns=["positive", "negative", "neutral"], dtype=float)

    return score


def engine_scores(articles: DataFrame, load, model: str = "finbert") -> DataFrame:
    """``articles`` with model, compound, label and the three scores: by an engine, or by the lexicon where it has none."""
    text = F.concat(F.coalesce("headline", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit("")))
    x = articles.withColumn("_e", sentiment_udf(load)(engine_input(F.col("headline"), F.col("summary")))).withColumn("_c", lexicon_compound(text))
    said, plain = F.col("_e.positive").isNotNull(), sentiment_parts(F.col("_c"))
    parts = {k: F.when(said, F.col(f"_e.{k.removeprefix('score_')}")).otherwise(v) for k, v in plain.items()}
    compound, label = three_class(*[F.col(f"_e.{k}") for k in ("positive", "negative", "neutral")])
    x = x.withColumns({"model": F.when(said, model).otherwise("lexicon"), "compound": F.when(said, compound).otherwise(F.col("_c")), "label": F.when(said, label).otherwise(sentiment_label(F.col("_c"))), **parts})
    return x.drop("_e", "_c")
