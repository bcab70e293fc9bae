"""Golden cases and properties of column functions."""

import re
from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import html, stats, text, times
from newsloom.functions.bounds import check_bound
from newsloom.operators import fundamentals, market, news, signals
from newsloom.sources import feeds

SLOW = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def column_of(spark, values, f, schema="v STRING"):
    return [r["x"] for r in spark.createDataFrame([(v,) for v in values], schema).coalesce(1).select(f(F.col("v")).alias("x")).collect()]


def test_dedup_key(spark):
    cases = {
        "NVIDIA beats - Yahoo Finance": "nvidia beats", "NVIDIA AI-driven growth": "nvidia ai", "Über Gewinn | Börse Online": "ber gewinn", "Results 2024-25": "results 2024 25", "x - y": "x y", "株価 - 日本": "", "": "", None: "",
        "Tabs\tand  spaces \n- The  Wire": "tabs and spaces",
    }
    assert column_of(spark, list(cases), text.dedup_key) == list(cases.values())


@SLOW
@given(values=st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=60), min_size=1, max_size=20))
def test_dedup_key_form(spark, values):
    for key in column_of(spark, values, text.dedup_key):
        assert re.fullmatch(r"([a-z0-9]+( [a-z0-9]+)*)?", key)


@pytest.mark.parametrize(
    ("head", "summary", "symbols", "want"),
    [("NVDA up", "on NVDA news", ["NVDA"], 1.0), ("a", "b", ["NVDA"], 0.45), ("a", "b", ["NVDA", "A", "B", "C"], 0.33), ("NVDA", "", [], 0.4), ("x", "nvda", ["Z"], 0.2), ("x", "y", list("abcdefghij"), 0.0), ("x", "y", None, 0.0)],
)
def test_relevance(spark, head, summary, symbols, want):
    df = spark.createDataFrame([("NVDA", head, summary, symbols)], "t STRING, h STRING, s STRING, y ARRAY<STRING>")
    assert df.select(text.relevance(F.col("t"), F.col("h"), F.col("s"), F.col("y")).alias("x")).first()["x"] == pytest.approx(want)


def test_lexicon(spark):
    up, down = "Company earnings beat expectations. Strong growth and profit", "Company faces lawsuit. Potential loss and downgrade"
    assert column_of(spark, [up, down, "", None], text.lexicon_compound) == [1.0, -1.0, 0.0, 0.0]
    assert [one(spark, text.sentiment_label(F.lit(x))) for x in (0.06, 0.05, -0.06)] == ["POSITIVE", "NEUTRAL", "NEGATIVE"]
    c, label = text.three_class(F.lit(0.4), F.lit(0.4), F.lit(0.2))
    assert (one(spark, c), one(spark, label)) == (0.0, "POSITIVE")


def test_source_weight(spark):
    assert column_of(spark, ["Reuters", "mock", "cnbc.com", None], text.source_weight) == [1.25, 0.1, 1.0, 1.0]
    assert text.source_weights("a:1,b,c:x, D.e :2") == {"a": 1.0, "d e": 2.0}


def test_labels_and_lists(spark):
    assert column_of(spark, ["buy", "Sell", "HOLD", "rise", "", None], text.signal_label) == ["RISE", "FALL", "STABLE", "RISE", "STABLE", "STABLE"]
    assert one(spark, text.csv_list(F.lit(" a, ,b "), upper=True)) == ["A", "B"]
    assert one(spark, text.search_queries(F.lit("T"), F.lit(None).cast("string"), ["s"])) == ["(T) stock", "(T) site:s"]


def fold(values):
    acc = values[0] if values else 0.0
    for v in values[1:]:
        acc = 0.3 * v + 0.7 * acc
    return acc


@SLOW
@given(values=st.lists(st.floats(-1, 1), max_size=30))
def test_ewma_is_a_fold(spark, values):
    assert column_of(spark, [values], stats.ewma, "v ARRAY<DOUBLE>")[0] == pytest.approx(fold(values), abs=1e-12)


def test_stats(spark):
    x = spark.createDataFrame([(0.2,), (-0.1,), (0.3,), (0.0,)], "v DOUBLE")
    r = x.agg(stats.mean0(F.col("v")).alias("m"), stats.std0(F.col("v")).alias("s")).first()
    assert (r["m"], r["s"]) == (pytest.approx(0.1), pytest.approx(0.182574186))
    r = x.limit(0).agg(stats.mean0(F.col("v")).alias("m"), stats.std0(F.col("v")).alias("s")).first()
    assert (r["m"], r["s"]) == (0.0, 0.0)
    assert column_of(spark, [[1.0, 2.0, 3.0]], lambda v: stats.ewm_adjusted(v, 7), "v ARRAY<DOUBLE>")[0] == pytest.approx([1, 1.571428571, 2.189189189])
    assert [one(spark, stats.clip01(F.lit(v).cast("double"))) for v in (-1, 2, None)] == [0.0, 1.0, None]


def test_times(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    assert one(spark, times.parse_iso(F.lit("2024-01-02T03:04:05Z"), now)) == datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, times.parse_iso(F.lit("bad"), now)) == datetime(2024, 1, 31)
    assert one(spark, times.parse_epoch_or_iso(F.lit("60"), now)) == datetime(1970, 1, 1, 0, 1)
    assert one(spark, times.parse_rfc822(F.lit("Mon, 01 Jan 2024 10:00:00 GMT"), now)) == datetime(2024, 1, 1, 10)
    assert one(spark, times.parse_day(F.lit("2024-02-30"))) is None
    ago = [one(spark, times.relative_time(F.lit(t).cast("timestamp"), now)) for t in ("2024-01-30 23:59:30", "2024-01-30 23:01:00", "2024-01-30 01:00:00", "2024-01-28 00:00:00")]
    assert ago == ["just now", "59m ago", "23h ago", "3d ago"]


def test_accession_and_surprise(spark):
    assert column_of(spark, ["000032019324000123", "x-1"], fundamentals.accession) == ["0000320193-24-000123", "x-1"]
    assert one(spark, fundamentals.filing_url(F.lit("0000320193"), F.lit("0000320193-24-000123"))).endswith("/320193/000032019324000123/0000320193-24-000123-index.htm")
    for est, act, want in ((1.0, 1.2, 20.0), (-1.0, -0.5, 50.0), (0.0, 1.0, None), (None, 1.0, None), (1.0, None, None)):
        got = one(spark, fundamentals.surprise_pct(F.lit(est).cast("double"), F.lit(act).cast("double")))
        assert got == (want if want is None else pytest.approx(want))


def test_rule_and_calibration(spark):
    for s, want in ((0.2, ("RISE", 0.59)), (0.15, ("STABLE", 0.5725)), (-0.16, ("FALL", 0.576)), (0.0, ("STABLE", 0.52)), (1.0, ("RISE", 0.85))):
        label, conf = signals.rule_signal(F.lit(s))
        assert (one(spark, label), pytest.approx(one(spark, conf))) == want
    rows = spark.createDataFrame([("a", 0.92), ("a", 0.95), ("b", 0.75), ("a", 0.55)], "y STRING, p DOUBLE")
    got = signals.calibration_metrics(rows, F.col("y"), {"a": F.col("p"), "b": 1 - F.col("p")}).first()
    assert (got["accuracy"], got["ece"]) == (0.75, pytest.approx(0.3325))


def test_html():
    long = "word " * 40
    page = f"<html><body><nav>menu</nav><article><script>x</script><p>{long}&amp; more</p><aside>no</aside></article><footer>foot</footer></body></html>"
    assert html.main_text(page) == (long + "& more").strip()
    assert html.main_text("<p>short</p>") == html.main_text(None) == ""
    assert html.main_text(f"<article>tiny</article><div class='a story-body'>{long}</div>") == long.strip()
    assert len(html.main_text(f"<main>{long * 100}")) == 4000


def test_event_filter(spark):
    got = column_of(spark, ['{"T":"n"}', '{"T":"q"}', '{"T":"q","headline":"h"}', "[1]", "bad", '{"headline":null}'], feeds.event_filter)
    assert got == [True, False, True, False, False, True]


def test_bounds():
    check_bound("limit", 200)
    for name, value in (("limit", 0), ("limit", 201), ("hours", 721), ("min_relevance", 1.1), ("offset", -1)):
        with pytest.raises(ValueError):
            check_bound(name, value)


def test_watchlist(spark):
    a = F.array(F.lit("A"), F.lit("B"))
    assert one(spark, news.watchlist_add(a, F.lit("c"))) == ["A", "B", "C"]
    assert one(spark, news.watchlist_remove(a, F.lit("a"))) == ["B"]
    assert one(spark, news.watchlist_toggle(a, F.lit("b"))) == ["A"]


def test_return_label(spark):
    assert [one(spark, market.return_label(F.lit(x).cast("double"))) for x in (0.02, 0.021, -0.02, -0.021, None)] == ["STABLE", "RISE", "STABLE", "FALL", "STABLE"]


def test_engines(spark):
    text.register_engine("Shout", lambda h, s: F.when(h == F.upper(h), 1.0).otherwise(0.0))
    assert [one(spark, text.engine(n)(F.lit("UP"), F.lit("weak"))) for n in ("shout", "lexicon", "none")] == [1.0, -1.0, -1.0]


def test_body_text_on_the_jvm_and_by_the_parser_agree(spark):
    rng = np.random.default_rng(0)
    long = "word and more, " * 12
    parts = ["<article>", "</article>", "<main>", "</main>", "<nav>", "</nav>", "<header class='x'>", "</header>", "<script>if (a < b) x='</p>'</script>", "<style>p{}</style>", "<p>", "</p>", "<br>", "<br/>", "<b>", "<div class='story-body'>", "</div>", '<div role="main">',
             "<!-- ad 1 -->", "<!-- <nav> -->", "<!--", "&amp;lt; ", "&nbsp;", "&copy; ", "&bogus ", "<", ">", " a > b ", '<img alt="a > b">', "<aside>side</aside>", long, long + "\xa0 é ", "tiny", "<title>t</title>", "<form>", "</form>", "<ARTICLE id=1>", "</Article >", "<figure><figcaption>f</figcaption></figure>"]
    pages = ["".join(rng.choice(parts, int(rng.integers(1, 14)))) for _ in range(600)]
    whole = ["<nav><ul><li>x</li></ul></nav>", "<header><nav>n</nav></header>", "<script>a < b</script>", "<p>one", "<br>", "<!-- ad -->", "&amp;lt; &copy;", long, "<div class='ad'>ad</div>", "<b>b", "<aside>x</aside>", "<title>t</title>"]
    inside = lambda: "".join(rng.choice(whole, int(rng.integers(0, 7))))
    pages += [f"{inside()}<article>{inside()}</article>{inside()}" if k % 3 else f"{inside()}<main a='b'>{inside()}</main>{inside()}" for k in range(200)] + [None, "", long * 30, f"<html><body><article>{long * 40}</article><footer>f</footer></body></html>"]
    df = spark.createDataFrame(list(enumerate(pages)), "k INT, html STRING")
    rest = html._without_dropped(F.coalesce("html", F.lit("")))
    got = df.select("k", html.body_text(F.col("html")).alias("body"), html._is_simple(F.coalesce("html", F.lit("")), rest).alias("simple")).collect()
    wrong = [(pages[r["k"]], r["body"], r["simple"]) for r in got if r["body"] != html.main_text(pages[r["k"]])]
    assert not wrong, wrong[:3]
    assert 150 < sum(r["simple"] for r in got) < 700


def test_query_url_quotes_like_a_form(spark):
    from urllib.parse import quote_plus

    for q in ("a b & c*d~e_f.g-h", "é/ü?=%+", ""):
        assert one(spark, text.query_url("https://s.example/?q=", F.lit(q))) == "https://s.example/?q=" + quote_plus(q)


def test_body_text_leaves_cut_entities_as_its_sql_does(spark, tmp_path):
    import duckdb
    from conftest import same_rows

    from newsloom.plans import catalog

    long = "word and more, " * 12
    pages = [f"<h1>t&amp;&amp</h1><p>{long}</p>", f"<main>{long} a & b &lt</main>", f"<div class='content-body'>{long}&quot;&copy &am</div>", f"<article>{long}&amp;amp;</article>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id LONG, html STRING").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(catalog.QUERIES["html_body"](spark, str(tmp_path)), con, catalog.SQL["html_body"])
    assert one(spark, html.body_text(F.lit(pages[0]))) == html.main_text(pages[0]) == f"t&& {long}".strip()


def test_body_text_returns_whole_texts_if_asked(spark, tmp_path):
    import duckdb
    from conftest import same_rows

    from newsloom.plans import catalog

    long = "".join(f"word {k} and more, " for k in range(900))
    pages = [f"<article>{long}end</article>", f"<main><p>{long}é &amp;amp; end</p></main><footer>f</footer>", f"<div class='ad'><p>{long}</p></div><aside>a</aside>end", f"<main>{long}<div class='page-content'>end</div></main>", "<p>short</p>", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id LONG, html STRING").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    df = spark.read.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    whole = catalog.SQL["html_body"].replace("[:4000]", "")
    assert whole != catalog.SQL["html_body"]
    same_rows(df.select("page_id", html.body_text(F.col("html"), ended=True, most=None).alias("body")), con, whole)
    simple = [r["x"] for r in df.orderBy("page_id").select(html._is_simple(F.coalesce("html", F.lit("")), html._without_dropped(F.coalesce("html", F.lit("")))).alias("x")).collect()]
    assert simple[:4] == [True, True, True, False]
    for page in pages[:4]:
        got = html.main_text(page, None)
        assert got.endswith("end") and len(got) > 15000 and got[: html.MOST] == html.main_text(page)
