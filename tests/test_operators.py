"""Operators on small tables: golden cases, pandas restatements, merges, streams and models."""

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import stats
from newsloom.operators import fundamentals, ingest, market, news, signals
from newsloom.sources import feeds, tables
from newsloom.streaming import events as live

T0 = datetime(2024, 1, 1)
def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")



def bars(spark, closes, ticker="T", volume=None):
    rows = [(ticker, T0 + timedelta(days=k), float(c), float(c), float(c), float(c), float(volume[k] if volume else 100 + k % 7)) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, schemas.BARS)


def test_indicators_equal_pandas(spark):
    rng = np.random.default_rng(3)
    close = pd.Series(100 + rng.normal(0, 1, 80).cumsum())
    got = market.with_indicators(bars(spark, close)).orderBy("timestamp").toPandas()
    delta = close.diff()
    gain, loss = delta.clip(lower=0).rolling(14).mean(), (-delta.clip(upper=0)).rolling(14).mean()
    mean, dev = close.rolling(20).mean(), close.rolling(20).std()
    np.testing.assert_allclose(got["rsi_14"], 100 - 100 / (1 + gain / loss), rtol=1e-9)
    np.testing.assert_allclose(got["bb_position"], ((close - mean + 2 * dev) / (4 * dev)).clip(0, 1), rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(got["momentum_5d"], close.pct_change(5), rtol=1e-9)
    assert got["rsi_14"].isna().sum() == 14 and got["bb_position"].isna().sum() == 19


def test_flat_prices(spark):
    r = market.price_features(bars(spark, [5.0] * 40, volume=[0] * 40)).first()
    assert (r["rsi_14"], r["bb_position"], r["momentum_5d"], r["volume_ratio"]) == (0.0, 0.0, 0.0, 0.0)
    r = market.price_features(bars(spark, [5.0] * 29)).first()
    assert r.asDict() == {"ticker": "T"} | market.DEFAULTS


def test_drawdown_and_risk(spark):
    assert market.with_drawdown(bars(spark, [100, 110, 99, 121, 115])).agg(F.min("drawdown").alias("d")).first()["d"] == pytest.approx(-0.10)
    rng = np.random.default_rng(5)
    a, b = (pd.Series(100 + rng.normal(0, 1, 60).cumsum()) for _ in range(2))
    got = market.risk_metrics(bars(spark, a), bars(spark, b)).first()
    ra, rb = a.pct_change().dropna(), b.pct_change().dropna()
    assert got["beta_to_benchmark"] == pytest.approx(ra.cov(rb) / rb.var())
    assert got["annualized_volatility"] == pytest.approx(ra.std() * 252**0.5)
    assert got["cumulative_return"] == pytest.approx(a.iloc[-1] / a.iloc[0] - 1)
    assert set(market.risk_metrics(bars(spark, a[:20]), bars(spark, b)).drop("ticker").first()) == {0.0}


def test_forward_labels(spark):
    got = market.forward_labels(bars(spark, [100, 101, 102, 103, 104, 103, 98.9, 101.9])).orderBy("timestamp").collect()
    assert [r["label"] for r in got] == ["RISE", "FALL", "STABLE"] + ["STABLE"] * 5
    assert got[0]["forward_return"] == pytest.approx(0.03) and got[3]["forward_return"] is None
    assert market.forward_labels(bars(spark, [1, 2, 3, 4, 5])).isEmpty()


def articles(spark, rows):
    """(id, headline, summary, source, days after T0, symbols) as articles, tickers and scores of 0.5."""
    a = spark.createDataFrame([(i, None, f"u{i}", h, s, None, src, T0 + timedelta(days=d), T0, None) for i, h, s, src, d, _ in rows], schemas.ARTICLES)
    t = spark.createDataFrame([(r[0], y) for r in rows for y in r[5]], schemas.ARTICLE_TICKERS)
    s = t.join(a, a["id"] == t["article_id"]).select("article_id", "ticker", F.lit(0.5).cast("decimal(6,4)").alias("compound"), F.lit("POSITIVE").alias("label"), F.col("published_at").alias("scored_at"))
    return a, t, s


def test_dedup_comes_before_relevance(spark):
    rows = [(1, "Same story", "", "x", 20, ["NVDA"]), (2, "Same story - Wire", "", "x", 21, ["NVDA", "A", "B", "C"])]
    a, t, s = articles(spark, rows)
    assert news.articles_feed(a, t, s, "nvda", now()).isEmpty()
    assert news.articles_feed(a.where("id = 1"), t, s, "nvda", now()).count() == 1


def test_feed_keeps_unscored_and_null_sources(spark):
    a, t, s = articles(spark, [(1, "NVDA one", "", None, 20, ["NVDA"]), (2, "NVDA two", "", "mock", 21, ["NVDA"])])
    got = news.articles_feed(a, t, s.limit(0), "NVDA", now()).collect()
    assert [(r["id"], r["label"]) for r in got] == [(1, None)]
    assert [r["id"] for r in news.articles_feed(a, t, s, "NVDA", now(), include_mock=True).collect()] == [2, 1]
    assert [r["id"] for r in news.articles_feed(a, t, s, "NVDA", now(), include_mock=True, offset=1).collect()] == [1]


def test_empty_summary_is_a_row_of_zeros(spark):
    a, t, s = articles(spark, [(1, "NVDA one", "", None, 20, ["NVDA"])])
    r = news.sentiment_summary(a, t, s, now(), "AAPL", days=30).first()
    assert (r["ticker"], r["article_count"], r["mean_compound"], r["std_compound"], r["ewma_compound"], r["positive"]) == ("AAPL", 0, 0.0, 0.0, 0.0, 0)


def test_diversity_cap_is_the_greedy_loop(spark):
    rows = [(k, f"h{k}", "", f"s{k % 3 if k % 2 else 0}", k % 11, ["T"]) for k in range(60)]
    a, _, _ = articles(spark, rows)
    got = [r["id"] for r in news.diversity_cap(a, 24).orderBy(F.desc("published_at"), "id").collect()]
    used, want = {}, []
    for k, *_, in sorted(rows, key=lambda r: (-r[4], r[0])):
        src = rows[k][3]
        if used.get(src, 0) < max(5, 24 // 6) and len(want) < 24:
            used[src] = used.get(src, 0) + 1
            want.append(k)
    assert got == want


def test_near_earnings(spark):
    day = datetime(2024, 3, 10)
    a = spark.createDataFrame([(k, "T", day + timedelta(hours=h), None) for k, h in enumerate((-84, -72, 0, 95, 96))], "id LONG, ticker STRING, published_at TIMESTAMP, raw_payload STRING")
    e = spark.createDataFrame([("T", day)], "ticker STRING, report_date TIMESTAMP")
    assert sorted(r["id"] for r in fundamentals.near_earnings(a, e).collect()) == [1, 2, 3]
    tagged = fundamentals.tag_near_earnings(a.withColumn("raw_payload", F.when(F.col("id") == 2, '{"provider":"p"}')), e).orderBy("id").collect()
    assert json.loads(tagged[2]["raw_payload"]) == {"provider": "p", "near_earnings": "true", "earnings_date": "2024-03-10"} and tagged[0]["raw_payload"] is None
    again = fundamentals.tag_near_earnings(spark.createDataFrame(tagged), e).orderBy("id").collect()
    assert [r["raw_payload"] for r in again] == [r["raw_payload"] for r in tagged]


def test_label_upsert_twice_is_once(spark):
    row = lambda close, ret, label: [("T", T0.date(), close, ret, label, T0)]
    make = lambda r: spark.createDataFrame(r, "ticker STRING, date DATE, close_price DOUBLE, forward_return_5d DOUBLE, label STRING, fetched_at TIMESTAMP")
    old, new = make(row(1.0, None, "STABLE")), make(row(2.0, 0.03, "RISE") + [("U", T0.date(), 3.0, 0.0, "STABLE", T0)])
    once = ingest.upsert_labels(old, new)
    assert sorted((r["ticker"], r["close_price"], r["label"]) for r in once.collect()) == [("T", 1.0, "RISE"), ("U", 3.0, "STABLE")]
    assert sorted(ingest.upsert_labels(once, new).collect()) == sorted(once.collect())


def test_clean_duplicates(spark):
    a, t, s = articles(spark, [(1, "Same", "short", "x", 1, ["T"]), (2, "Same - Wire", "much longer text", "x", 2, ["T"]), (3, "Other", "", "x", 3, ["T"])])
    f = spark.createDataFrame([(1, "F1"), (3, "F3")], "article_id LONG, ticker STRING")
    out = ingest.clean_duplicates(a, t, s, f)
    assert sorted(r["id"] for r in out["articles"].collect()) == [2, 3]
    assert out["sentiment_scores"].count() == 2
    assert sorted((r["ticker"], r["article_id"]) for r in out["sec_filings"].collect()) == [("F1", None), ("F3", 3)]


def test_filings(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"name": "Acme", "filings": {"recent": {"accessionNumber": ["000032019324000123", "2", "3"], "form": ["8-K", "S-1", "10-K"], "filingDate": ["2024-01-05", "2024-01-04", "bad"], "primaryDocument": ["a", "b"]}}}))
    rows = fundamentals.unnest_filings(feeds.filing_history(spark, str(tmp_path), "acme", "0000320193"))
    assert rows.count() == 2
    got = fundamentals.filing_articles(rows, F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r["ticker"], r["accession_number"], r["headline"]) for r in got] == [("ACME", "0000320193-24-000123", "SEC 8-K: Acme")]
    known = spark.createDataFrame([("ACME", "0000320193-24-000123")], "ticker STRING, accession_number STRING")
    assert fundamentals.new_filings(fundamentals.filing_articles(rows, F.lit("2024-01-01").cast("timestamp")), known).isEmpty()


def test_feeds(spark, tmp_path):
    put = lambda name, x: ((tmp_path / name).mkdir(), (tmp_path / name / "x").write_text(x if isinstance(x, str) else json.dumps(x)), str(tmp_path / name))[2]
    b = feeds.bars(spark, put("bars", {"bars": [{"t": "2024-01-02T00:00:00Z", "o": 1, "h": 2, "l": 0, "c": 1.5, "v": 9}, {"t": "2024-01-01T00:00:00Z", "o": 1, "h": 2, "l": 0, "c": 1, "v": 9}]}), "t")
    assert [r["close"] for r in b.collect()] == [1.0, 1.5]
    n = feeds.news_pages(spark, put("news", {"news": [{"id": "1", "url": "u", "headline": "h", "created_at": "bad", "symbols": []}, {"id": "2", "url": ""}], "next_page_token": None}), now(), "nvda")
    assert [(r["url"], r["symbols"], r["published_at"]) for r in n.collect()] == [("u", ["NVDA"], datetime(2024, 1, 31))]
    c = feeds.company_news(spark, put("company", [{"headline": "", "url": "u0", "datetime": 60}, {"headline": "h", "url": "u1", "datetime": 60, "source": " A "}, {"headline": "h", "url": "u2", "datetime": 60}]), now(), 2)
    assert [(r["url"], r["source"], r["published_at"]) for r in c.collect()] == [("u1", "a", datetime(1970, 1, 1, 0, 1))]
    s = feeds.search_news(spark, put("search", {"data": [{"title": "t", "url": "u", "snippet": "b"}, {"title": None, "url": "v"}]}), now())
    assert [(r["headline"], r["body"]) for r in s.collect()] == [("t", "b")]
    item = "<item><title>{}</title><link>{}</link><pubDate>{}</pubDate><source url='x'>Wire</source></item>"
    r = feeds.rss(spark, put("rss", "<rss><channel>" + item.format("t", "l", "Mon, 29 Jan 2024 10:00:00 GMT") + item.format("old", "l2", "Mon, 01 May 2023 10:00:00 GMT") + "</channel></rss>"), now())
    assert [(x["url"], x["source"]) for x in r.collect()] == [("l", "wire")]
    e = feeds.earnings_calendar(spark, put("cal", {"earningsCalendar": [{"date": "2024-01-05", "epsEstimate": 1, "epsActual": 1.2}, {"date": None}]}), "t")
    assert [float(x["surprise_pct"]) for x in e.collect()] == [20.0]
    m = feeds.cik_map(spark, put("cik", {"0": {"ticker": "aapl", "cik_str": 320193}}))
    assert [tuple(x) for x in m.collect()] == [("AAPL", "0000320193")]


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    tables.create_all(spark, root)
    tables.append(spark.createDataFrame([("A", "n")], schemas.TICKERS), root, "tickers")
    tables.replace(tables.load(spark, root, "tickers").union(spark.createDataFrame([("B", "m")], schemas.TICKERS)), root, "tickers")
    assert sorted(r["symbol"] for r in tables.load(spark, root, "tickers").collect()) == ["A", "B"]
    assert tables.load(spark, root, "articles").isEmpty()
    assert json.loads(tables.to_json_rows(tables.load(spark, root, "tickers").where("symbol = 'A'")).first()["value"]) == {"symbol": "A", "name": "n"}


def payload(**x):
    return json.dumps({"T": "n"} | x)


def test_stream_equals_batch_and_replays(spark, tmp_path):
    lines = [payload(url="u1", headline="record growth", symbols=["a", "A", "b"], created_at="2024-01-02T00:00:00Z", id="1"), payload(url="u1", headline="again", symbols=["c"], created_at="2024-01-02T00:00:00Z"), payload(headline="no url"), payload(url="u2", headline="loss", symbols=[], created_at="bad"), json.dumps({"T": "q", "url": "u3"})]
    src, root = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "1.txt").write_text("\n".join(lines[:1]))
    for k in range(2):
        live.start_ingest(live.read_events(spark, str(src)), str(root), str(tmp_path / "cp"), now()).awaitTermination()
        if k == 0:
            (src / "2.txt").write_text("\n".join(lines[1:]))
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # as if the last batch had been written, but not committed
        f.unlink(missing_ok=True)
    live.start_ingest(live.read_events(spark, str(src)), str(root), str(tmp_path / "cp"), now()).awaitTermination()
    got = live.stored(spark, str(root), "articles")
    assert sorted((r["url"], r["headline"]) for r in got.collect()) == [("u1", "record growth"), ("u2", "loss")]
    scores = live.stored(spark, str(root), "sentiment_scores")
    assert sorted((r["ticker"], float(r["compound"]), r["label"]) for r in scores.collect()) == [("A", 1.0, "POSITIVE"), ("B", 1.0, "POSITIVE"), ("UNKNOWN", -1.0, "NEGATIVE")]
    assert got.where("url = 'u2'").first()["published_at"] == datetime(2024, 1, 31)


def test_stream_takes_late_articles_and_only_watched_ones(spark, tmp_path):
    src, root = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    spark.createDataFrame([("b",)], "ticker STRING").write.parquet(str(tmp_path / "subscriptions"))
    for k, (url, when) in enumerate((("u1", "2024-01-30T00:00:00Z"), ("u2", "2023-09-20T00:00:00Z"), ("u1", "2023-09-20T00:00:00Z"), ("u3", "2024-01-31T00:00:00Z"))):
        (src / f"{k}.txt").write_text(payload(url=url, headline="h", symbols=["a"] if url == "u3" else ["B"], created_at=when))
        live.start_ingest(live.read_events(spark, str(src)), str(root), str(tmp_path / "cp"), now(), str(tmp_path / "subscriptions")).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(f"{root}/articles").collect()) == ["u1", "u2"]


def test_ewma_by_buckets_is_the_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(str(k % 3), T0 + timedelta(minutes=int(m)), k, float(v)) for k, (m, v) in enumerate(zip(rng.integers(0, 900, 200), rng.normal(0, 1, 200), strict=True))]
    df = spark.createDataFrame(rows, "ticker STRING, t TIMESTAMP, id LONG, v DOUBLE")
    got = {r["ticker"]: r for r in stats.ewma_by(df, ["ticker"], F.col("v"), F.col("t"), F.col("id")).collect()}
    for ticker, r in got.items():
        own = sorted((t, i, v) for k, t, i, v in rows if k == ticker)
        acc = own[0][2]
        for _, _, v in own[1:]:
            acc = stats.ALPHA * v + (1 - stats.ALPHA) * acc
        assert r["ewma"] == pytest.approx(acc, abs=1e-12) and r["n"] == len(own) and r["total"] == pytest.approx(sum(x[2] for x in own))


def test_streaming_daily_counts(spark, tmp_path):
    rows = spark.createDataFrame([("A", T0, 0.5), ("A", T0 + timedelta(hours=5), 1.0), ("B", T0 + timedelta(days=1), 0.0)], "ticker STRING, published_at TIMESTAMP, compound DOUBLE")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("daily").collect()) == sorted(live.daily_counts(rows).collect())


def test_model_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, "T", *map(float, x), "RISE" if x[0] > 0.3 else "FALL" if x[0] < -0.3 else "STABLE") for k, x in enumerate(rng.normal(0, 1, (120, 8)))]
    df = spark.createDataFrame(rows, "id INT, ticker STRING, " + ", ".join(f"{c} DOUBLE" for c in signals.FEATURES) + ", target STRING")
    split = signals.with_split(df, "id")
    assert {r["part"]: r["count"] for r in split.groupBy("part").count().collect()} == {"train": 96, "validation": 24}
    model, info = signals.train_model(split, trees=20)
    assert info["labels"] == ["FALL", "RISE", "STABLE"] and info["accuracy"] > 0.6
    assert signals.load_model(str(tmp_path / "none")) is None
    signals.save_model(model, info, str(tmp_path / "m"))
    model, info = signals.load_model(str(tmp_path / "m"))
    some = signals.predict(model, info, df.limit(3))
    r = some.first()
    assert sum(r["probabilities"].values()) == pytest.approx(1.0) and 0 <= r["confidence"] <= 1
    background = dict.fromkeys(signals.FEATURES, 0.0)
    values = {x["id"]: x for x in signals.shapley(model, info, some, background).collect()}
    base = signals.predict(model, info, spark.createDataFrame([(0, *background.values())], "id INT, " + ", ".join(f"{c} DOUBLE" for c in signals.FEATURES))).first()["probabilities"]
    for x in some.collect():
        assert sum(values[x["id"]][c] for c in signals.FEATURES) == pytest.approx(x["probabilities"][x["recommendation"]] - base[x["recommendation"]], abs=1e-6)
    stored = signals.as_prediction(some, now())
    assert stored.count() == 3 and signals.prediction_history(stored, "t").count() == 3


def test_plan_pushes_filters(spark):
    from newsloom.plans import views

    plan = views.read(spark, "/root/testdata/sf0.001", "documents").where("lang = 'de'").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in plan
    b = market.with_indicators(views.bars(spark, "/root/testdata/sf0.001"), "bar_day")._jdf.queryExecution().executedPlan().toString()
    assert b.count("Exchange hashpartitioning(ticker") == 1


def test_ranks_and_order_statistics(spark):
    from newsloom.functions import ranks

    rng = np.random.default_rng(5)
    groups = {"a": np.concatenate([np.full(300, 7.0), rng.normal(0, 5, 400)]), "b": rng.integers(0, 9, 90).astype(float), None: np.array([3.0]), "c": np.full(50, 1.0)}
    rows = [(g, k, float(v)) for g, vs in groups.items() for k, v in enumerate(vs)] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "g STRING, k INT, v DOUBLE")
    places = {"first": lambda n: F.lit(1), "mid": lambda n: F.floor((n + 1) / 2), "last": lambda n: n}
    for small in (10, 100_000):
        got = {r["g"]: (r["first"], r["mid"], r["last"]) for r in ranks.order_statistics(df, "v", ["g"], places, small=small).collect()}
        assert got == {g: (min(v), sorted(v)[(len(v) + 1) // 2 - 1], max(v)) for g, v in groups.items()}
    x = ranks.with_rank(ranks.with_ranges(df.where("v IS NOT NULL"), "v", "r"), ["g"], [F.col("v"), F.col("k")], F.col("r"))
    for g, v in groups.items():
        own = sorted((r["v"], r["k"], r["_rank"], r["_n"]) for r in x.where(F.col("g").eqNullSafe(F.lit(g))).collect())
        assert [r[2] for r in own] == list(range(1, len(v) + 1)) and {r[3] for r in own} == {len(v)}
    p = signals.latency_percentiles(df, "v", ("g",)).where("g = 'a'").first()
    assert p["p50"] == pytest.approx(np.median(groups["a"])) and p["p99"] == sorted(groups["a"])[max(int(700 * 0.99), 1) - 1]


def test_plans_have_no_window_over_a_whole_group(spark):
    from newsloom.plans import views

    events = views.read(spark, "/root/testdata/sf0.001", "events")
    plan = signals.latency_percentiles(events, "value", ("event_type",))._jdf.queryExecution().optimizedPlan().toString()
    assert "rows" not in plan.lower().split("window")[0] and "row_number" not in plan
    plan = stats.ewma_by(events, ["event_type"], F.col("value"), F.col("ts"), F.col("event_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in next(line for line in plan.splitlines() if "WindowGroupLimit" in line and "Exchange" not in line and "Final" not in line)
    plan = signals.with_split(events.select("event_type", "ts"), "ts", partition=("event_type",))._jdf.queryExecution().optimizedPlan().toString()
    assert all("_bucket" in line for line in plan.splitlines() if "row_number" in line) and "row_number" in plan
    n, e = views.reports(spark, "/root/testdata/sf0.001")
    plan = fundamentals.near_earnings(n, e)._jdf.queryExecution().optimizedPlan().toString()
    assert "_day" in next(line for line in plan.splitlines() if "Join Inner" in line)


@pytest.mark.parametrize("boosted", [False, True])
def test_path_shapley_is_the_sum_over_sets(spark, boosted):
    from itertools import combinations
    from math import factorial

    from newsloom.operators import attribution

    rng = np.random.default_rng(8)
    rows = [(k, "T", *map(float, x), "RISE" if x[0] + x[3] > 0.3 else "FALL" if x[0] * x[5] < -0.3 else "STABLE") for k, x in enumerate(rng.normal(0, 1, (150, 8)))]
    df = spark.createDataFrame(rows, "id INT, ticker STRING, " + ", ".join(f"{c} DOUBLE" for c in signals.FEATURES) + ", target STRING")
    model, info = signals.train_model(signals.with_split(df, "id"), trees=4, depth=3, boosted=boosted)
    some = signals.predict(model, info, df.limit(6))

    def expected(node, x, known):
        """A tree's output where only some features are known: both sides, by their shares, at splits of others."""
        if "Leaf" in node.getClass().getSimpleName():
            stats = np.array(list(node.impurityStats().stats()))
            return np.array([node.prediction()]) if boosted else stats / stats.sum()
        k, sides = node.split().featureIndex(), (node.leftChild(), node.rightChild())
        if k in known:
            return expected(sides[int(x[k] > node.split().threshold())], x, known)
        return sum(s.impurityStats().count() / node.impurityStats().count() * expected(s, x, known) for s in sides)

    def output(x, label, known):
        stage = model.stages[2 + label] if boosted else model.stages[2]
        total = sum(w * expected(t._java_obj.rootNode(), x, known) for t, w in zip(stage.trees, stage.treeWeights, strict=True))
        return total[0] if boosted else total[label] / len(stage.trees)

    got = {r["id"]: r for r in attribution.path_shapley(model, info, some).collect()}
    for r in some.collect():
        x, label = [r[c] for c in signals.FEATURES], info["labels"].index(r["recommendation"])
        known = {s: output(x, label, set(s)) for n in range(9) for s in combinations(range(8), n)}
        for j, c in enumerate(signals.FEATURES):
            others = [s for s in known if j not in s]
            want = sum(factorial(len(s)) * factorial(7 - len(s)) / factorial(8) * (known[tuple(sorted((*s, j)))] - known[s]) for s in others)
            assert got[r["id"]][c] == pytest.approx(want, abs=1e-9)
        assert got[r["id"]]["base"] == pytest.approx(known[()], abs=1e-9)
        if not boosted:
            assert got[r["id"]]["base"] + sum(got[r["id"]][c] for c in signals.FEATURES) == pytest.approx(r["probabilities"][r["recommendation"]], abs=1e-9)


def test_stories_and_tags_are_cut_before_they_are_shuffled(spark):
    from newsloom.plans import views

    n, t, s = views.feed(spark, "/root/testdata/sf0.001")
    plan = ingest.keepers(n.withColumn("ingested_at", now()))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")  # each task sends one row of a story
    plan = news.articles_feed(n, t, s, "de", now())._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_texts_are_shuffled_once_for_an_overlay(spark):
    from newsloom.plans import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = catalog.QUERIES["price_sentiment_overlay"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("FileScan" in line and "source#" in line and "text#" in line for line in lines) == 1
    windows = [line for line in lines if "Window [row_number()" in line]
    below = [lines[k + 1] for k, line in enumerate(lines) if "Exchange hashpartitioning(ticker" in line and "_key" in line]
    assert len(windows) == 1 and len(below) == 1 and any("relevance" in line or "Contains(lower" in line for line in lines[[k for k, x in enumerate(lines) if x == below[0]][0] :])


def test_overlay_has_each_days_sentiment(spark):
    bars = spark.createDataFrame([("A", "2024-01-01", 1.0), ("A", "2024-01-02", 1.234), ("A", "2024-01-03", 2.0), ("B", "2024-01-01", 3.0)], "ticker STRING, d STRING, close DOUBLE").withColumn("bar_day", F.to_date("d"))
    trend = spark.createDataFrame([("A", "2024-01-02", 0.12345), ("A", "2024-01-04", 1.0)], "ticker STRING, d STRING, mean_compound DOUBLE").withColumn("news_day", F.to_date("d"))
    got = market.overlay(bars, trend).orderBy("ticker", "bar_day").collect()
    assert [(r["ticker"], str(r["bar_day"]), r["price"], r["sentiment"]) for r in got] == [("A", "2024-01-02", 1.23, 0.123), ("A", "2024-01-03", 2.0, None), ("B", "2024-01-01", 3.0, None)]


def test_pages_lie_many_to_a_file(spark, tmp_path, monkeypatch):
    from newsloom.plans import catalog

    monkeypatch.setattr(tables, "work_dir", lambda s: str(tmp_path))
    got = {(r["ticker"], r["page"], r["id"]) for r in catalog.QUERIES["file_paged_news"](spark, "/root/testdata/sf0.01").collect()}
    files = [f for f in (tmp_path / "feed").rglob("*.txt")]
    assert len(files) <= 5 * 4 and sum(len(f.read_text().splitlines()) for f in files) > len(files)  # at most one for each ticker and task
    one_each = spark.read.text(str(tmp_path / "feed")).select("ticker", F.get_json_object("value", "$.page").alias("page"), "value")
    one_each.write.partitionBy("ticker", "page").text(str(tmp_path / "apart"))
    assert {(r["ticker"], r["page"], r["id"]) for r in feeds.paged(feeds.pages(spark, str(tmp_path / "apart")), 120).collect()} == got
