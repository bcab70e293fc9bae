"""Jobs over all tickers, boosted models, and file sources that fail."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import fundamentals, jobs, signals
from newsloom.sources import feeds


def _ticker(name: str, days: int, rng) -> tuple[list, list]:
    """Scores and bars of a ticker: two scores and one bar a day."""
    start, close, scores, bars = dt.datetime(2023, 1, 2), 100.0, [], []
    for k in range(days):
        close *= float(1 + rng.normal(0, 0.03))
        at = start + dt.timedelta(days=k)
        bars.append((name, at, close, float(rng.integers(1, 99))))
        scores += [(name, 1000 * k + j, at + dt.timedelta(hours=j), float(rng.uniform(-1, 1))) for j in (1, 2)]
    return scores, bars


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(3)
    parts = [_ticker("AA", 90, rng), _ticker("BB", 80, rng), _ticker("CC", 10, rng)]
    scores = spark.createDataFrame([s for p in parts for s in p[0]], "ticker STRING, article_id LONG, scored_at TIMESTAMP, compound DOUBLE")
    bars = spark.createDataFrame([b for p in parts for b in p[1]], "ticker STRING, timestamp TIMESTAMP, close DOUBLE, volume DOUBLE")
    return scores, bars


def test_retrain_and_load_or_train(spark, market, tmp_path):
    scores, bars = market
    path = str(tmp_path / "model")
    assert jobs.load_or_train(path, scores, bars, least=10**6, trees=3) is None
    model, info = jobs.load_or_train(path, scores, bars, boosted=True, trees=3)
    assert info["boosted"] and set(info["labels"]) <= {"FALL", "RISE", "STABLE"}
    assert jobs.load_or_train(path, scores, bars, least=10**6)[1] == info
    rows = signals.training_dataset(scores, bars).drop("target")
    found = signals.predict(model, info, rows)
    assert found.columns == [*rows.columns, "probabilities", "recommendation", "confidence"]
    for r in found.collect():
        assert sum(r["probabilities"].values()) == pytest.approx(1.0)
        assert r["recommendation"] == max(info["labels"], key=lambda v: r["probabilities"][v])
    state = jobs.retrain(path, scores, bars, trees=3)
    assert state["status"] == "ok" and state["tickers_used"] == 2 and state["rows_trained"] == rows.count()
    assert jobs.load_or_train(path, scores, bars)[1]["boosted"] is False
    assert jobs.retrain(path, scores.limit(0), bars) == {"status": "skipped", "reason": "no_data"}


def test_boosted_shares_add_up(spark, market):
    scores, bars = market
    data = signals.with_split(signals.training_dataset(scores, bars), "news_day")
    model, info = signals.train_model(data, trees=3, boosted=True)
    some = signals.predict(model, info, data.orderBy("ticker", "news_day").limit(2).withColumn("id", F.monotonically_increasing_id()))
    zeros = dict.fromkeys(signals.FEATURES, 0.0)
    shares = {r["id"]: r for r in signals.shapley(model, info, some, zeros).collect()}
    nothing = spark.createDataFrame([tuple(zeros.values())], ", ".join(f"{c} DOUBLE" for c in signals.FEATURES))
    base = signals.predict(model, info, nothing).first()["probabilities"]
    for r in some.collect():
        gain = r["probabilities"][r["recommendation"]] - base[r["recommendation"]]
        assert sum(shares[r["id"]][c] for c in signals.FEATURES) == pytest.approx(gain, abs=1e-9)


def test_refresh_is_repeatable(spark, market):
    _, bars = market
    few = bars.limit(0).union(spark.createDataFrame([("DD", dt.datetime(2023, 1, 2), 1.0, 1.0)], bars.schema))
    now = F.lit("2024-01-01").cast("timestamp")
    stored = spark.createDataFrame([], "ticker STRING, date DATE, close_price DECIMAL(12,4), forward_return_5d DECIMAL(10,6), label STRING, fetched_at TIMESTAMP")
    wanted = spark.createDataFrame([("aa",), ("AA",), ("dd",), ("none",)], "ticker STRING")
    once, report = jobs.refresh_price_labels(bars.union(few), stored, wanted, now)
    twice, _ = jobs.refresh_price_labels(bars.union(few), once, wanted, now)
    assert {(r["ticker"], r["state"], r["upserted"]) for r in report.collect()} == {("AA", "ok", 90), ("DD", "too_few_bars", 0), ("NONE", "no_bars", 0)}
    assert once.count() == 90 and once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_one_failing_source_leaves_the_rest(spark, tmp_path):
    frames, errors = jobs.readable({"good": lambda: spark.range(1), "gone": lambda: spark.read.schema("a INT").json(str(tmp_path / "none"))})
    assert list(frames) == ["good"] and errors == {"gone": "PATH_NOT_FOUND"}
    empty = jobs.or_empty(spark, lambda: feeds.bars(spark, str(tmp_path / "none"), "t"), "ticker STRING, timestamp TIMESTAMP")
    assert empty.count() == 0 and empty.columns == ["ticker", "timestamp"]


def test_paging_stops_at_limit_token_and_empty_page(spark):
    rows = [("A", 0, 3, "t"), ("A", 1, 3, "t"), ("A", 2, 3, "t"), ("B", 0, 2, None), ("B", 1, 2, "t"), ("C", 0, 1, "t"), ("C", 1, 0, "t"), ("C", 2, 1, "t"), ("D", 0, 60, "")]
    schema = "ticker STRING, page INT, news ARRAY<STRUCT<id: STRING>>, next_page_token STRING"
    pages = spark.createDataFrame([(t, p, [(f"{t}{p}{k}",) for k in range(n)], token) for t, p, n, token in rows], schema)
    found = {(r["ticker"], r["page"]): r["count"] for r in feeds.paged(pages, 5, size=50).groupBy("ticker", "page").count().collect()}
    assert found == {("A", 0): 3, ("A", 1): 2, ("B", 0): 2, ("C", 0): 1, ("D", 0): 5}
    assert feeds.paged(pages, 1000, size=50).where("ticker = 'D'").count() == 50


def test_tags_keep_other_fields(spark):
    day = dt.datetime(2024, 1, 10)
    earnings = spark.createDataFrame([("T", day)], "ticker STRING, report_date TIMESTAMP")
    payloads = [None, "{}", ' {"a": {"b": [1, 2.50]}} ', "[1]", "broken", '{"near_earnings": false}']
    articles = spark.createDataFrame([(k, "T", day, p) for k, p in enumerate(payloads)], "id INT, ticker STRING, published_at TIMESTAMP, raw_payload STRING")
    got = {r["id"]: (r["raw_payload"], r["tagged"]) for r in fundamentals.tag_near_earnings(articles, earnings).collect()}
    tag = '"near_earnings":"true","earnings_date":"2024-01-10"}'
    assert got == {0: ("{" + tag, True), 1: ("{" + tag, True), 2: ('{"a": {"b": [1, 2.50]},' + tag, True), 3: ("{" + tag, True), 4: ("{" + tag, True), 5: (payloads[5], False)}


def test_predictions_are_appended_once(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    fresh = signals.as_prediction(spark.createDataFrame([(t, *[0.2] * 8) for t in "AB"], "ticker STRING, " + ", ".join(f"{c} DOUBLE" for c in signals.FEATURES)), now).withColumn("id", F.lit(1).cast("long"))
    once = jobs.append_predictions(fresh.limit(0), fresh)
    twice = jobs.append_predictions(once, fresh)
    assert twice.count() == 2 and signals.prediction_by_id(twice, once.where("ticker = 'A'").first()["id"]).first()["ticker"] == "A"


def test_a_merge_rewrites_only_its_months(spark, tmp_path):
    from newsloom.operators import ingest
    from newsloom.schemas import PRICE_LABELS
    from newsloom.sources import tables

    path, merge = str(tmp_path / "labels"), lambda stored, fresh: ingest.upsert_labels(stored, fresh, flags=True)

    def rows(*items):
        df = spark.createDataFrame([(t, d, c, label) for t, d, c, label in items], "ticker STRING, date STRING, close DOUBLE, label STRING")
        return df.select("ticker", F.to_date("date").alias("date"), F.col("close").cast("decimal(12,4)").alias("close_price"), F.lit(0.5).cast("decimal(10,6)").alias("forward_return_5d"), "label", F.lit("2024-01-31").cast("timestamp").alias("fetched_at"))

    def state():
        return sorted((r["ticker"], str(r["date"]), float(r["close_price"]), r["label"]) for r in tables.by_month(spark, path, PRICE_LABELS).collect())

    assert tables.merge_months(rows(("A", "2024-01-05", 1.0, "x"), ("A", "2024-02-05", 2.0, "x"), ("B", "2024-03-01", 3.0, "x"), ("B", None, 9.0, "x")), path, PRICE_LABELS, "date", merge) == {"inserted": 3, "updated": 0}
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "labels").glob("month=2024-0[13]/*.parquet")}
    assert len(before) == 2
    assert tables.merge_months(rows(("A", "2024-02-05", 7.0, "y"), ("A", "2024-02-06", 4.0, "y")), path, PRICE_LABELS, "date", merge) == {"inserted": 1, "updated": 1}
    want = [("A", "2024-01-05", 1.0, "x"), ("A", "2024-02-05", 2.0, "y"), ("A", "2024-02-06", 4.0, "y"), ("B", "2024-03-01", 3.0, "x")]
    assert state() == want and {f: f.stat().st_mtime_ns for f in before} == before
    assert tables.merge_months(rows(), path, PRICE_LABELS, "date", merge) == {"inserted": 0, "updated": 0}
    # cut short after staging: the next merge puts it in place; what was not staged whole goes
    staged = spark.read.schema(f"{PRICE_LABELS}, month STRING").parquet(path).where("month = '2024-03'").withColumn("label", F.lit("late"))
    staged.write.partitionBy("month").parquet(f"{path}/_staged-1")
    staged.withColumn("label", F.lit("never")).write.partitionBy("month").parquet(f"{path}/_staged-2")
    (tmp_path / "labels" / "_staged-2" / "_SUCCESS").unlink()
    tables.merge_months(rows(("C", "2024-04-01", 1.0, "z")), path, PRICE_LABELS, "date", merge)
    assert state() == [*want[:3], ("B", "2024-03-01", 3.0, "late"), ("C", "2024-04-01", 1.0, "z")]
    assert not list((tmp_path / "labels").glob("_staged-*"))


def test_sources_that_break_while_they_are_read(spark, tmp_path):
    items = lambda *urls: spark.createDataFrame([(k, u, "AAA beats", None, "w", dt.datetime(2024, 1, 20, k), ["aaa"], t) for k, (u, t) in enumerate(urls)], "id LONG, url STRING, headline STRING, summary STRING, source STRING, published_at TIMESTAMP, symbols ARRAY<STRING>, ticker STRING")
    breaks = items(("u9", "AAA")).withColumn("id", F.raise_error(F.lit("the connection was lost")).cast("long"))

    def missing():
        return spark.read.parquet(str(tmp_path / "nothing"))

    frames, errors = jobs.fetched(spark, {"good": lambda: items(("u1", "AAA"), ("u2", "BBB")), "breaks": lambda: breaks, "missing": missing, "wrong": lambda: 1 / 0}, str(tmp_path / "in"))
    assert set(frames) == {"good"} and set(errors) == {"breaks", "missing", "wrong"} and errors["wrong"] == "ZeroDivisionError"
    stored = spark.createDataFrame([], "url STRING, headline STRING, published_at TIMESTAMP")
    two = frames["good"].withColumn("headline", F.concat("ticker", F.lit(" beats")))
    new, counts = jobs.backfill({"good": two}, stored, F.lit("2024-01-31").cast("timestamp"), F.col("ticker"))
    assert sorted(r["url"] for r in new.collect()) == ["u1", "u2"] and counts.first()["inserted"] == 2
    new, _ = jobs.backfill({"good": two}, stored, F.lit("2024-01-31").cast("timestamp"), F.col("ticker"), limit=1)
    assert [r["url"] for r in new.collect()] == ["u2"]
    with pytest.raises(ValueError, match="limit must be from 1 to 500"):
        jobs.backfill({"good": two}, stored, F.lit("2024-01-31").cast("timestamp"), F.col("ticker"), limit=501)


def test_limits_of_searches_and_scrapes(spark, tmp_path):
    assert [feeds.per_query_limit(*x) for x in ((100, 5), (300, 3), (20, 8), (100, 0))] == [25, 50, 10, 50]
    items = spark.createDataFrame([(q, k, "text" if k == 3 else None) for q in "ab" for k in range(15)], "query STRING, k INT, body STRING")
    assert sorted((r["query"], r["k"]) for r in feeds.first_of_each(items, 2, "query", F.col("k")).collect()) == [(q, k) for q in "ab" for k in range(2)]
    assert [(r["k"], r["query"]) for r in feeds.to_scrape(items, F.col("k"), F.col("query")).collect()] == sorted((k, q) for q in "ab" for k in range(15) if k != 3)[:20]
    (tmp_path / "t.csv").write_text("symbol,name\n aapl ,Apple Inc.\nBRK.B,\"Berkshire, Class B\"\nAAPL,Zed\n,none\n")
    assert sorted(map(tuple, feeds.tickers(spark, str(tmp_path / "t.csv")).collect())) == [("AAPL", "Apple Inc."), ("BRK.B", "Berkshire, Class B")]


def test_migration(spark, tmp_path):
    from newsloom.sources import tables

    root = str(tmp_path)
    spark.createDataFrame([(1, "u", "h", dt.datetime(2024, 1, 1))], "id LONG, url STRING, headline STRING, published_at TIMESTAMP").write.parquet(f"{root}/articles/v0")
    spark.createDataFrame([("A", "2024-01-01", 2.5)], "ticker STRING, date STRING, close_price DOUBLE").write.parquet(f"{root}/price_labels/v0")
    done = tables.migrate(spark, root)
    assert done["articles"].startswith("added external_id, summary, body") and done["price_labels"] == "rewritten" and done["tickers"] == "created"
    assert tables.load(spark, root, "articles").first()["body"] is None
    row = tables.load(spark, root, "price_labels").first()
    assert (row["date"], float(row["close_price"]), row["label"]) == (dt.date(2024, 1, 1), 2.5, None)
    assert set(tables.migrate(spark, root).values()) <= {"current", done["articles"]}


def test_engine_or_lexicon(spark):
    df = spark.createDataFrame([(k, "beat " + "x" * 600 if k else "loss", None) for k in range(70)], "id INT, headline STRING, summary STRING")

    def load():
        def engine(texts):
            assert len(texts) <= 32 and all(len(t) <= 512 for t in texts)
            return [(0.7, 0.1, 0.2) if t.startswith("beat") else (0.1, 0.1, 0.8) for t in texts]

        return engine

    def broken():
        raise ImportError("no engine")

    rows = {r["id"]: r for r in signals.engine_scores(df, load).collect()}
    assert len(rows) == 70 and rows[5]["model"] == "finbert" and rows[5]["compound"] == pytest.approx(0.6) and rows[5]["label"] == "POSITIVE" and rows[0]["label"] == "NEUTRAL"
    rows = {r["id"]: r for r in signals.engine_scores(df, broken).collect()}
    assert rows[0]["model"] == "lexicon" and rows[0]["label"] == "NEGATIVE" and rows[5]["compound"] == 1.0 and rows[5]["score_positive"] == 1.0


def test_mock_article_reaches_the_feed(spark):
    from newsloom.operators import ingest, news

    a = ingest.mock_article(spark, "nvda", "NVIDIA earnings beat expectations", "Strong AI revenue growth outlook", dt.datetime(2024, 1, 30), 7)
    a = a.withColumns({"body": F.lit(None).cast("string"), "raw_payload": F.lit(None).cast("string")})
    tags = a.select(F.col("id").alias("article_id"), F.explode("symbols").alias("ticker"))
    scores = tags.withColumns({"label": F.lit("POSITIVE"), "compound": F.lit(1.0).cast("decimal(6,4)")})
    feed = lambda mock: news.articles_feed(a.drop("symbols"), tags, scores, "nvda", F.lit("2024-01-31").cast("timestamp"), min_relevance=0.0, include_mock=mock).collect()
    assert feed(False) == [] and feed(True)[0]["url"] == "https://mock.local/NVDA/7"
    with pytest.raises(ValueError, match="days must be from 60 to 1500"):
        from newsloom.operators import market

        market.risk_metrics(scores, scores, days=30, as_of=F.current_timestamp())
