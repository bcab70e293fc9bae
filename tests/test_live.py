"""The live source, the sink with its index of addresses, subscriptions in time, the push feed and retention, on small logs."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.sources import live as feed
from newsloom.streaming import events as live

T0 = datetime(2024, 1, 1)


def now():
    return F.lit("2024-01-31").cast("timestamp")


def event(url, symbols=("A",), **x):
    return {"T": "n", "url": url, "headline": "record", "symbols": list(symbols), "created_at": "2024-01-02T00:00:00Z"} | x


def frames(spark, *items):
    return spark.createDataFrame([(json.dumps(i),) for i in items], "payload STRING")


def urls(spark, root):
    return sorted(r["url"] for r in live.stored(spark, str(root), "articles").collect())


def test_lists_are_flattened(spark):
    got = live.parse_events(frames(spark, [event("u1"), event("u2"), 7, {"T": "q", "url": "u9"}], event("u3"), []), now())
    assert sorted((r["url"], json.loads(r["raw_payload"])["url"]) for r in got.collect()) == [("u1", "u1"), ("u2", "u2"), ("u3", "u3")]


def test_a_new_checkpoint_overwrites_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    for k, some in enumerate(([event("u1"), event("u2")], [event("u3"), event("u1", headline="other")])):
        live.publish(frames(spark, *some), str(tmp_path / f"in{k}"))
        live.start_ingest(live.read_events(spark, str(tmp_path / f"in{k}")), root, str(tmp_path / f"cp{k}"), now()).awaitTermination()
    assert urls(spark, root) == ["u1", "u2", "u3"]
    assert live.stored(spark, root, "sentiment_scores").count() == 3


def test_what_backfill_stored_is_not_written_again(spark, tmp_path):
    root, src, cp = str(tmp_path / "out"), str(tmp_path / "in"), str(tmp_path / "cp")
    live.remember(spark.createDataFrame([("u1",)], "url STRING"), root, "backfill")
    live.publish(frames(spark, event("u1"), event("u2")), src)
    for _ in range(2):
        live.start_ingest(live.read_events(spark, src), root, cp, now()).awaitTermination()
        assert urls(spark, root) == ["u2"]
        for f in (tmp_path / "cp" / "commits").glob("*0*"):  # as if the batch had been written, but not committed
            f.unlink()
    live.publish(frames(spark, event("u3")), src)
    live.start_ingest(live.read_events(spark, src), root, cp, now()).awaitTermination()
    assert urls(spark, root) == ["u2", "u3"]
    run = live.run_name(spark, cp)
    live.publish(frames(spark, event("u4")), src)
    live.start_ingest(live.read_events(spark, src), root, cp, now()).awaitTermination()
    live.compact_index(spark, root, run)
    known = live.unknown(spark.createDataFrame([(f"u{k}",) for k in range(6)], "url STRING"), root)
    assert sorted(r["url"] for r in known.collect()) == ["u0", "u5"]


def test_an_event_that_comes_again_after_subscribing_counts(spark, tmp_path):
    root, cp, log, subscriptions = (str(tmp_path / n) for n in ("out", "cp", "log", "subscriptions"))
    spark.createDataFrame([("B", T0)], "ticker STRING, valid_from TIMESTAMP").write.parquet(subscriptions)

    def send(when, *items):
        feed.publish(frames(spark, *items), log, F.lit(when))
        live.drain(live.start_ingest(feed.read_live(spark, log, "earliest"), root, cp, now(), subscriptions, once=False, seconds=0))

    send(T0, event("u1"), event("u2", ["b"]))
    assert urls(spark, root) == ["u2"]
    have = spark.read.parquet(subscriptions)
    live.subscribe(have, F.lit(" a "), F.lit(T0 + timedelta(days=5))).write.parquet(subscriptions + "2")
    spark.read.parquet(subscriptions + "2").where("ticker = 'A'").write.mode("append").parquet(subscriptions)
    send(T0 + timedelta(days=4), event("u3"))
    assert urls(spark, root) == ["u2"]
    send(T0 + timedelta(days=6), [event("u1"), event("u4")])
    assert urls(spark, root) == ["u1", "u2", "u4"]
    same = live.subscribe(spark.read.parquet(subscriptions), F.lit("b"), F.lit(T0))
    assert same.count() == 2 and live.subscribe(same, F.lit("  "), F.lit(T0)).count() == 2


def test_batches_are_small_and_go_on_where_they_ended(spark, tmp_path):
    log, cp, sizes, seen = str(tmp_path / "log"), str(tmp_path / "cp"), [], []

    def take(batch, number):
        rows = batch.collect()
        sizes.append(len(rows))
        seen.extend(json.loads(r["payload"])["url"] for r in rows)
        assert all(r["symbol"] == json.loads(r["payload"])["symbols"][0].upper() for r in rows)

    def read(start="earliest", checkpoint=cp):
        stream = feed.read_live(spark, log, start, most=4)
        live.drain(stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start())

    feed.publish(frames(spark, *[[event(f"u{k}", [s]) for s in ("a", "b/c")] for k in range(5)]), log, now())
    read()
    assert sorted(seen) == sorted(f"u{k}" for k in range(5) for _ in range(2)) and sum(sizes) == 10 and max(sizes) <= 4 and len(sizes) >= 3
    feed.publish(frames(spark, event("v0"), event("v1")), log, now())
    seen.clear()
    read()
    assert sorted(seen) == ["v0", "v1"]
    seen.clear()
    read("latest", cp + "2")
    assert seen == []
    with pytest.raises(Exception, match="latest or earliest"):
        read("newest", cp + "3")


def test_retention_keeps_enough(spark, tmp_path):
    log = str(tmp_path / "log")
    for k in range(5):
        feed.publish(frames(spark, [event(f"u{k}{j}") for j in range(10)]), log, now())
    assert feed.trim(spark, log, keep=25) == 2
    assert {r["publication"]: r["n"] for r in feed.publications(spark, log).collect()} == {f"{k:012d}": 10 for k in (2, 3, 4)}
    assert feed.trim(spark, log, keep=25) == 0 and feed.trim(spark, log, keep=1) == 2
    seen = []
    stream = feed.read_live(spark, log, "earliest")
    live.drain(stream.writeStream.foreachBatch(lambda b, k: seen.append(b.count())).option("checkpointLocation", str(tmp_path / "cp")).start())
    assert sum(seen) == 10


def test_push_is_a_loop_over_the_newest(spark, tmp_path):
    rng = np.random.default_rng(3)
    polls = [[(t, int(i), T0 + timedelta(hours=int(rng.integers(0, 40)))) for i in rng.choice(1000, 12, replace=False) for t in ("A", "B")] for _ in range(4)]
    have, sent, want = {"A": [], "B": []}, {}, []
    for k, rows in enumerate(polls):
        for t, own in have.items():
            own += [(-when.timestamp(), i, when) for s, i, when in rows if s == t]
            page = sorted(own)[:5]
            new = sorted((i, when) for _, i, when in page if i > sent.get(t, -1))
            want += [(k, t, i, when) for i, when in new]
            sent[t] = max([sent.get(t, -1), *(i for i, _ in new)])
    for k, rows in enumerate(polls):
        df = spark.createDataFrame(rows, "ticker STRING, id LONG, published_at TIMESTAMP")
        df.write.mode("append").parquet(str(tmp_path / "in"))
        live.start_push(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), page=5).awaitTermination()
    got = spark.read.schema("ticker STRING, id LONG, published_at TIMESTAMP, poll INT").parquet(str(tmp_path / "out"))
    assert sorted((r["poll"], r["ticker"], r["id"], r["published_at"]) for r in got.collect()) == sorted(want)


def test_a_micro_batch_takes_several_batches(spark, tmp_path, monkeypatch):
    log, cp, out = str(tmp_path / "log"), str(tmp_path / "cp"), []
    monkeypatch.setattr(feed, "FILE", 5)

    def read():
        stream = feed.read_live(spark, log, "earliest", most=4, batches=3)
        take = lambda b, k: out.append([(r["batch"], json.loads(r["payload"])["url"]) for r in b.collect()])
        live.drain(stream.writeStream.foreachBatch(take).option("checkpointLocation", cp).trigger(processingTime="0 seconds").start())

    for k, n in enumerate((17, 13, 2)):
        feed.publish(frames(spark, *[event(f"u{k}-{j}", [f"s{j % 2}"]) for j in range(n)]).coalesce(1), log, now())
        if k:
            read()
    assert sorted(u for micro in out for _, u in micro) == sorted(f"u{k}-{j}" for k, n in enumerate((17, 13, 2)) for j in range(n))
    assert [len(micro) for micro in out if micro] == [12, 12, 6, 2]
    sizes = [[sum(b == k for b, _ in micro) for k in sorted({b for b, _ in micro})] for micro in out if micro]
    assert sizes == [[4, 4, 4], [4, 4, 4], [4, 2], [2]] and sorted({b for micro in out for b, _ in micro}) == list(range(9))
    assert len(list((tmp_path / "log" / "publication=000000000000" / "symbol=S0").glob("*.parquet"))) == 2


def test_a_batch_is_shuffled_once_for_its_addresses(spark, tmp_path):
    root, before = str(tmp_path), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    live.remember(spark.createDataFrame([("u1",), ("u1",), ("u3",)], "url STRING"), root, "backfill")
    assert spark.read.parquet(f"{root}/known").count() == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        x = spark.createDataFrame([("u1", 1), ("u2", 2), ("u2", 3)], "url STRING, v INT").groupBy("url").agg(F.min("v").alias("v"))
        got = live.unknown(x, root, few=False)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and [tuple(r) for r in got.collect()] == [("u2", 2)]
        assert [tuple(r) for r in live.unknown(x, root).collect()] == [("u2", 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_article_with_two_watched_symbols_is_there_once(spark):
    a = live.parse_events(frames(spark, event("u1", ["a", "b"]), event("u2", ["c"])), now())
    got = live.watched(a, spark.createDataFrame([("A",), ("b",), ("B",)], "ticker STRING"))
    assert [r["url"] for r in got.collect()] == ["u1"]
