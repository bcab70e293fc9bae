"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import os
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from newsloom.llm import decontam, kneser_ney, langid, line_rules, minhash, packing, substring, suffix, url_filter, warc
from newsloom.llm.common import join_by_hot_key, shared_dir
from newsloom.llm.hashing import Keys

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
CLASHING = ("kept", "n_words", "key", "row", "spans", "bucket", "signature", "copy", "sequence_id", "offset", "_bin", "id", "clean_text", "perplexity", "label", "host", "verdict", "_dirty", "a.b", "c`d", "text.x")


def sentence(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n)]
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def docs(spark):
    a, b = sentence(1), sentence(2)
    near = a.split()
    near[60] = "changed"
    rows = [
        (1, a, "en", "s"), (2, a, "en", None), (3, " ".join(near), None, "s"), (4, b, "de", "s"), (4, b, "de", "s"), (5, None, "en", "s"), (6, "", None, None), (7, " \n\t ", "en", "s"), (None, sentence(3), "en", "s"), (None, None, None, None),
        (8, "tiny words here", "de", "s"), (9, "日本語 のテキスト é ü " + sentence(4), "de", "s"), (10, "*** ### 12 !!", "en", "s"), (11, sentence(5) + "\n" + a + "\n" + sentence(6), "en", "s"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def crowded(docs):
    """The same with columns named like those that operators make."""
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def test_line_rules(docs, crowded, none):
    out = by_id(line_rules.quality_rules(docs), "n_words", "kept", "clean_text")
    assert out[5] == [(0, False, None)] and out[6] == [(0, False, "")] and out[7] == [(0, False, " \n\t ")]
    assert out[1][0][:2] == (120, True) and len(out[4]) == 2 and len(out[None]) == 2
    got = line_rules.quality_rules(crowded)
    assert got.count() == docs.count() and len([c for c in got.columns if c.lower() == "kept"]) == 1
    assert line_rules.quality_rules(none).isEmpty()


def test_lines_that_fail():
    fails = lambda s: line_rules.line_fails(s, s.encode().split())
    assert fails("Home | News | Sport | Shop") == "navigation"
    assert fails("All rights reserved by the owner of this site, 2024.") == "boilerplate"
    assert fails("### *** 1") == "punctuation" and fails("Read more") == "punctuation"
    assert fails("A sentence of some words, with an end.") is None
    assert fails("a line of quite many words without any mark at its end at all") is None


@pytest.mark.parametrize(("op", "kept"), [(substring.remove_repeats, "kept_text"), (suffix.remove_repeated_bytes, "kept")])
def test_repeats(op, kept, docs, crowded, none):
    out = by_id(op(docs), "n_removed", kept)
    assert out[5] == [(0, out[6][0][1])] and not out[6][0][1]
    assert out[4][0][0] > 0 and out[4] == [out[4][0]] * 2 and not out[4][0][1]  # equal rows repeat each other
    assert out[8][0][0] == 0 and out[9][0][0] == 0 and out[11][0][0] > 0
    assert sorted(map(str, op(crowded).select("doc_id", "n_removed").collect())) == sorted(map(str, op(docs).select("doc_id", "n_removed").collect()))
    assert op(none).isEmpty()


@pytest.mark.parametrize("op", [substring.remove_repeats, suffix.remove_repeated_bytes])
def test_very_long_text(spark, op):
    rng = np.random.default_rng(7)
    words = ["".join(x) for x in rng.choice(list("abcdefghijklmnop"), (250_000, 5))]
    words[150_000:150_060] = words[10:70]
    df = spark.createDataFrame([(1, " ".join(words), None, None, 0), (2, "x " + " ".join(words[200_000:200_050]), None, None, 0)], SCHEMA)
    out = by_id(op(df), "n_removed")
    unit = 1 if op is substring.remove_repeats else 6
    assert abs(out[1][0] - 170 * unit) <= 6 and abs(out[2][0] - 50 * unit) <= 6


def test_same_content_runs(spark):
    """Ties of anchors: one byte or word over and over."""
    df = spark.createDataFrame([(1, "a" * 1000, None, None, 0), (2, "a" * 150, None, None, 0), (3, "w " * 100, None, None, 0)], SCHEMA)
    assert by_id(suffix.remove_repeated_bytes(df), "n_removed") == {1: [1000], 2: [0], 3: [0]}
    assert by_id(substring.remove_repeats(df), "n_removed") == {1: [0], 2: [0], 3: [100]}


def test_large_groups_are_halved(spark, monkeypatch):
    """Groups with many segments are dealt by longer prefixes, down to whole windows, with the same result."""
    shared = sentence(50, 60)
    rows = [(k, f"{sentence(100 + k, 30)} {shared} {sentence(500 + k, 30)}", None, None, 0) for k in range(40)]
    rows += [(100 + k, " ".join(sentence(50, 60).split()[k:]) + sentence(900 + k, 9), None, None, 0) for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [sorted(op(df).select("doc_id", "n_removed").collect()) for op in (substring.remove_repeats, suffix.remove_repeated_bytes)]
    assert min(r["n_removed"] for r in want[0]) >= 40
    monkeypatch.setattr("newsloom.llm.repeats.GROUP", 3)
    assert [sorted(op(df).select("doc_id", "n_removed").collect()) for op in (substring.remove_repeats, suffix.remove_repeated_bytes)] == want


def doubled(x, y, times):
    """Different strings that every polynomial hash modulo a power of two takes for equal, if doubled often enough."""
    for _ in range(times):
        x, y = x + y, y + x
    return x, y


def test_collisions_of_hashes_remove_nothing(spark):
    x, y = doubled("fon ", "eiju", 5)
    rows = [(k, "bsuvxfovjfmcfxsxwximqhyawrgtlw hmfsrwv  yebnjyvlppyansmyzwmx" + t + "brhgsuxfxwibuwmedkuiasuepknarholqcjrukat", None, None, 0) for k, t in enumerate((x, y))]
    assert by_id(suffix.remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA)), "n_removed") == {0: [0], 1: [0]}
    rows = [(k, f"{sentence(1, 20)} {t} {sentence(2, 20)}", None, None, 0) for k, t in enumerate(doubled("a", "b", 10))]
    assert by_id(substring.remove_repeats(spark.createDataFrame(rows, SCHEMA)), "n_removed") == {0: [0], 1: [0]}
    rows = [(k, f"{sentence(1, 20)} {'long' * 30 + t} {sentence(2, 20)}", None, None, 0) for k, t in enumerate("aab")]
    assert by_id(substring.remove_repeats(spark.createDataFrame(rows, SCHEMA)), "n_removed") == {0: [41], 1: [41], 2: [0]}


def test_sort_without_hashes(monkeypatch):
    """With hashes that always say equal, the order still is that of the bytes."""
    rng = np.random.default_rng(3)
    raw = bytes(rng.choice([97, 98], 400).astype(np.uint8))
    s = suffix.Suffixes(raw, Keys())
    start = rng.permutation(390)[:120]
    end, group = np.full(120, 400), np.sort(rng.integers(0, 4, 120))
    right = suffix.sorted_neighbours(s, start, end, group)
    monkeypatch.setattr(suffix.Suffixes, "common", lambda self, a, b, most: most)
    wrong = suffix.sorted_neighbours(s, start, end, group)
    for order, n in (right, wrong):
        texts = [(group[k], raw[start[k] :]) for k in order]
        assert texts == sorted(texts)
        for (g, a), (h, b), found in zip(texts, texts[1:], n, strict=False):
            assert found == (len(os.path.commonprefix([a, b])) if g == h else 0)


def test_suffix_tree():
    rng = np.random.default_rng(5)
    words = np.array([*rng.integers(0, 3, 200), -1, *rng.integers(0, 3, 50), -2])
    starts = np.flatnonzero(words >= 0)
    order, longest, nodes = substring.suffix_tree(words, starts, 4, 201)
    suffixes = [words[k:].tolist() for k in order]
    assert suffixes == sorted(suffixes)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert longest.tolist() == [max(common(a, b) for j, b in enumerate(suffixes) if j != k) for k, a in enumerate(suffixes)]
    below = {k for _, a, b in nodes for k in range(a, b + 1)}
    assert below == {k for k, n in enumerate(longest) if n >= 4}
    assert all(d == common(suffixes[a], suffixes[b]) >= 4 for d, a, b in nodes)


def test_whole_characters():
    raw = "aéb".encode()
    assert suffix.whole_characters(raw, np.array([True, True, False, True])) == "é"
    assert suffix.whole_characters(raw, np.array([False, True, True, False])) == "ab"


def test_near_duplicates(docs, crowded, none):
    out = by_id(minhash.near_duplicates(docs), "class_id")
    assert {out[k][0] for k in (1, 2, 3)} == {1} and out[4] == [4, 4] and out[5] == [5] and out[6] == [6] and out[11] == [11]
    assert out[None] == [None, None] and out[8] == [8]
    assert by_id(minhash.near_duplicates(crowded), "class_id") == out
    assert minhash.near_duplicates(none).isEmpty()


def test_family_of_copies(spark):
    """Copies of a text with the largest id that are not close enough to each other: the original joins them all."""
    base = sentence(77, 200).split()
    rows = []
    for k in range(12):
        w = list(base)
        w[5 + 15 * k] = w[12 + 15 * k] = f"edit{k}"
        w[(60 + 15 * k) % 190] = f"more{k}"
        rows.append((k, " ".join(w), None, None, 0))
    rows.append((99, " ".join(base), None, None, 0))
    out = by_id(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)), "class_id")
    assert {v[0] for v in out.values()} == {0}


@pytest.mark.parametrize("seed", [16, 17, 168])
def test_pairs_of_one_band_are_compared(spark, seed):
    """Texts 1 and 2 have similar shingle sets and share one band, in a bucket whose least id is like neither."""
    rng = np.random.default_rng(seed)
    part = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(30))
    base = [part() for _ in range(6)]
    text = lambda parts: " ".join(" ".join([p] * int(rng.choice([1, 2, 5]))) for p in parts)
    texts = [text([*base[:4], part(), part()]), text(base), text(base)]
    bands = [set(minhash.band_keys(minhash.prob_minhash(*minhash.shingles(t))[None])[0].tolist()) for t in texts]
    assert bands[0] & bands[1] & bands[2] and len(bands[1] & bands[2]) == 1
    out = by_id(minhash.near_duplicates(spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA)), "class_id")
    assert out == {0: [0], 1: [1], 2: [1]}


def test_components(spark):
    pairs = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 103), (7, 200)]
    got = {r["node"]: r["label"] for r in minhash.components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 200: 0, 100: 100, 101: 100, 103: 100}


def test_kneser_ney(spark, docs, crowded, none):
    ids = spark.createDataFrame([(1,), (4,), (9,), (None,)], "doc_id LONG")
    out = by_id(kneser_ney.classify(docs, ids), "perplexity", "kept")
    assert out[5] == out[6] == out[7] == [(None, False)] and out[1][0][1] and len(out[None]) == 2
    assert out[2][0][0] < out[10][0][0]  # the text of a trusted one, and unknown words
    assert by_id(kneser_ney.classify(crowded, ids), "perplexity", "kept") == out
    assert all(r["kept"] == (r["perplexity"] is not None) for r in kneser_ney.classify(docs, ids.limit(0)).collect())
    assert kneser_ney.classify(none, ids).isEmpty()


def test_kneser_ney_chunks(spark, docs, monkeypatch):
    """Results don't depend on how documents are dealt to chunks."""
    ids = spark.createDataFrame([(1,), (4,), (9,)], "id LONG")
    found = []
    for size in (1, kneser_ney.CHUNK):
        monkeypatch.setattr(kneser_ney, "CHUNK", size)
        texts = kneser_ney.stored(kneser_ney.chunks(docs, ids, "doc_id", "text", "lang"))
        found.append(sorted(map(str, kneser_ney.perplexities(texts).collect())))
    assert found[0] == found[1] and len(found[0]) == docs.where("text IS NOT NULL").count()


def test_kneser_ney_leaves_no_shuffle_files(spark, docs):
    """What was shuffled and stored on the way is gone when documents are scored; only chunks and scores stay."""
    base = shared_dir(spark).rsplit("/", 1)[0].removeprefix("file:")
    dirs = [base, *[str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]]
    files = lambda: {os.path.join(at, f): os.path.getsize(os.path.join(at, f)) for d in dirs for at, _, names in os.walk(d) for f in names if f.endswith((".data", ".parquet"))}
    many = docs.crossJoin(spark.range(40).toDF("copy")).select((F.col("doc_id") * 100 + F.col("copy")).alias("doc_id"), F.concat_ws(" ", "text", "copy").alias("text"), "lang")
    before = files()
    kneser_ney.perplexities(kneser_ney.chunks(many, many.select(F.col("doc_id").alias("id")).distinct(), "doc_id", "text", "lang"))
    time.sleep(1)
    left = [f for f, n in files().items() if f not in before and n]
    assert not [f for f in left if f.endswith(".data")] and len({os.path.dirname(f) for f in left}) == 2


def test_kneser_ney_blocks(spark, docs, monkeypatch):
    """Results don't depend on how many cells and shares of the key space there are, nor on blocks of texts."""
    ids = spark.createDataFrame([(1,), (4,), (9,)], "id LONG")
    found = []
    for cell, block in ((1_000_000, 1 << 18), (10, 100)):
        monkeypatch.setattr(kneser_ney, "CELL", cell)
        monkeypatch.setattr(kneser_ney, "BLOCK", block)
        texts = kneser_ney.chunks(docs, ids, "doc_id", "text", "lang")
        found.append(sorted(map(str, kneser_ney.perplexities(texts, 3).collect())))
    assert found[0] == found[1]


def test_language(spark, docs, crowded, none):
    train = spark.createDataFrame([("en", "the cat sat on the mat with the other cats"), ("de", "der Hund und die Katze waren nicht im Haus"), (None, "x"), ("en", None)], "lang STRING, text STRING")
    prototypes = langid.train_prototypes(train)
    assert list(prototypes) == ["de", "en"]
    out = by_id(langid.predict_language(docs, prototypes), "lang_pred", "score")
    assert out[5] == out[6] == out[7] == out[10] == [("und", 0.0)] and out[8][0][0] in prototypes
    assert by_id(langid.predict_language(crowded, prototypes), "lang_pred", "score") == out
    assert {r["lang_pred"] for r in langid.predict_language(docs, langid.train_prototypes(train.limit(0))).collect()} == {"und"}
    assert langid.predict_language(none, prototypes).isEmpty()


def test_urls(spark):
    rules = [url_filter.Rule("com", "/", "allow"), url_filter.Rule("bad.com", "/x/", "block")]
    urls = [None, "", "no scheme", "http://A.COM/p?q://z#f", "http://a.com", "http://bad.com/x/1", "http://www.bad.com/x/#", "http://notbad.com/x/", "ftp://org.org/" + "y" * 50_000, "http://é.org/ü", "http://bad.com/x/1"]
    df = spark.createDataFrame([(k, u, "was") for k, u in enumerate(urls)], "page_id INT, url STRING, verdict STRING")
    out = {r["page_id"]: r for r in url_filter.judge_urls(df, rules).collect()}
    assert [out[k]["host"] for k in range(5)] == ["", "", "", "a.com", "a.com"] and out[3]["path"] == "/p"
    assert [out[k]["rule"] for k in range(3, 8)] == ["com/", None, "bad.com/x/", "bad.com/x/", "com/"]
    assert all(out[k]["verdict"] in ("allow", "block") for k in out) and out[5] == out[10].__class__(**(out[10].asDict() | {"page_id": 5}))
    only = url_filter.judge_urls(df, rules[:1]).collect()
    assert {r["verdict"] for r in only} == {"allow"} and {r["llr"] for r in only} == {0.0}
    assert url_filter.judge_urls(df.limit(0), rules).isEmpty()


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs, crowded, none):
    out = packing.pack(docs, TOKENIZER)
    got = out.collect()
    assert len(got) == docs.count()
    assert {(r["doc_id"], r["length"]) for r in got} >= {(5, 1), (6, 1), (7, 1)}
    assert packing.pack(crowded, TOKENIZER).count() == len(got)
    assert packing.pack(none, TOKENIZER).isEmpty()
    ids = packing.pack(docs.where("doc_id = 8"), TOKENIZER, with_ids=True).first()["ids"]
    assert ids[-1] == 2 and len(ids) > 1


def test_packing_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    texts = ["", " ", "a.b,c... d'ors.' it's, (x). é. É., ''s 12.5% a_b__ ...", "<|endoftext|> x<|endoftext|>.", "ﬁ. 株価。 日本, Ω. ½. á. ́.", "x" * 500 + ".", "UPPER Case, ΑΣ. İ."]
    for text, raw in zip(texts, packing.token_bytes(texts, TOKENIZER), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_plan():
    counts = {512: 3, 500: 10, 12: 9, 200: 40, 56: 30, 1: 5}
    plan = packing.plan_packing(counts, 512)
    used = {}
    for parts, n in plan:
        assert sum(parts) <= 512
        for p in parts:
            used[p] = used.get(p, 0) + n
    assert used == counts
    assert packing.plan_packing({}, 512) == []


def test_very_long_document_is_cut(spark):
    df = spark.createDataFrame([(1, "word " * 20_000, None, None, 0)], SCHEMA)
    got = packing.pack(df, TOKENIZER).orderBy("start").collect()
    assert sum(r["length"] for r in got) == got[0]["doc_tokens"] == 20_001 and max(r["length"] for r in got) == 4096


def test_decontamination(spark, docs, crowded, none):
    passage = sentence(1).split()[20:60]
    for k in (7, 19, 31):
        passage[k] = "other"
    items = spark.createDataFrame([(1, " ".join(passage).upper()), (2, None), (3, ""), (4, "tiny words HERE!"), (1, " ".join(passage))], "item_id LONG, text STRING")
    rows = decontam.find_overlaps(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in rows.collect()} == {(1, 1), (2, 1), (3, 1), (8, 4), (11, 1)}
    assert decontam.find_overlaps(crowded, items).count() == rows.count()
    left = decontam.decontaminate(docs, items)
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 4, 4, 5, 6, 7, 9, 10] and left.columns == docs.columns
    assert decontam.find_overlaps(docs, items.limit(0)).isEmpty() and decontam.find_overlaps(none, items).isEmpty()


def test_decontamination_of_a_core_beside_sparse_words(spark):
    """Single equal words after, or before and after, passages taken over word by word don't hide them."""
    item, other = sentence(40, 120).split(), sentence(41, 120).split()
    tail = [*item[:20], *[item[k] if k % 5 == 4 else other[k] for k in range(20, 35)], *other[35:]]
    middle = [*item[:20], *[item[k] if k % 5 == 4 else other[k] for k in range(20, 95)], *item[95:115], *other[115:]]
    df = spark.createDataFrame([(1, " ".join(tail), None, None, 0), (2, " ".join(middle), None, None, 0)], SCHEMA)
    rows = decontam.find_overlaps(df, spark.createDataFrame([(7, " ".join(item))], "item_id LONG, text STRING")).collect()
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["n_equal"]) for r in rows)
    assert [x[0] for x in got] == [1, 2, 2] and all(n >= 20 and n >= 0.7 * (e - s) for _, s, e, n in got)
    assert got[0][1] == 0 and got[0][2] >= 20 and got[1][1] == 0 and got[1][2] >= 20 and got[2][1] <= 95 and got[2][2] == 115


def test_runs_are_found_wherever_there_is_one():
    rng = np.random.default_rng(8)
    for share in (0.5, 0.7, 0.8, 1.0):
        for _ in range(60):
            at = np.cumsum(rng.choice([1, 1, 1, 2, 4, 5], rng.integers(1, 60)))
            fits = [(q - p + 1, p, q) for q in range(len(at)) for p in range(q + 1) if q - p + 1 >= 13 and q - p + 1 >= share * (at[q] - at[p] + 1) - 1e-9]
            got = list(decontam.runs(at, 13, share))
            assert max((n for *_, n in got), default=0) == max((n for n, *_ in fits), default=0)
            assert all(n == ((at >= s) & (at < e)).sum() >= share * (e - s) - 1e-9 for s, e, n in got)
            assert all(any(s <= at[q] and at[p] < e for s, e, _ in got) for _, p, q in fits)


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    items = spark.createDataFrame([(k, sentence(k)) for k in range(1, 5)], "item_id LONG, text STRING")
    want = sorted(decontam.find_overlaps(docs, items).collect(), key=str)
    monkeypatch.setattr(decontam, "BLOCK_SEEDS", 700)
    assert sorted(decontam.find_overlaps(docs, items).collect(), key=str) == want and want


def test_warc(spark):
    big = "".join(chr(0x61 + k % 26) + ("é\r\n\r\n" if k % 97 == 0 else "") for k in range(60_000))
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, None), (3, "u", ""), (4, "u", big), (5, "u", "z" * 999), (6, "u", "z" * 999), (7, "u", "y" * 1000), (8, "u", "y" * 1000)]
    pages = spark.createDataFrame(rows, "id LONG, url STRING, payload STRING").withColumn("digest", F.lit("clash"))
    path = shared_dir(spark)
    warc.write_warc(pages, path, records_per_file=3)
    read = warc.read_warc(spark, path)
    full = {r["record_id"]: r for r in read.collect()}
    assert bytes(full["<urn:page:4>"]["payload"]) == big.encode() and full["<urn:page:1>"]["record_type"] == "revisit"
    got = {r["record_id"]: (r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.resolve_revisits(read).collect()}
    assert got["<urn:page:1>"] == ("revisit", len(big.encode()), "<urn:page:4>") and got["<urn:page:7>"] == ("revisit", 1000, "<urn:page:8>")
    assert got["<urn:page:2>"] == got["<urn:page:3>"] == ("response", 0, None) and got["<urn:page:5>"] == ("response", 999, None)
    records = warc.read_records(spark, path)
    assert records.where("number > 1").count() >= 3
    cut = records.where("number IS NULL OR number <> 2")
    with pytest.raises(Exception, match="not whole"):
        warc.reassemble(cut).collect()
    empty = shared_dir(spark)
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).isEmpty()


def test_warc_of_repeated_and_null_ids(spark, tmp_path):
    import duckdb
    from conftest import same_rows

    from newsloom.llm import q_warc

    long, other, copy = "".join(f"{k} é\r\n\r\n" for k in range(9_000)), "w" * 40_000, "c" * 2_000
    rows = [(1, "u", long), (1, "u", long), (1, "v", long), (2, "u", copy), (2, "u", copy), (9, "u", copy), (3, "u", other), (3, "u", "short"), (0, "u", other)]
    rows += [(None, "u", other), (None, None, None), (None, "u", "n" * 30_000), (None, "u", "n" * 30_000), (4, "u", None), (4, "u", None), (-5, "u", "m")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    path = shared_dir(spark)
    warc.write_warc(pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload")), path)
    read = warc.resolve_revisits(warc.read_warc(spark, path)).collect()
    sizes = {r["record_id"]: r["payload_bytes"] for r in read}
    assert len(sizes) == len(rows) and all(sizes[r["refers_to"]] == r["payload_bytes"] for r in read if r["record_type"] == "revisit")
    assert sorted(sizes.values()) == sorted(len((p or "").encode()) for *_, p in rows)
    assert sum(r["record_type"] == "revisit" for r in read) == 4
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(q_warc.op9_warc_segments(spark, str(tmp_path)), con, q_warc.SQL)
    want = []
    for i, _, p in rows:
        equal = [j for j, _, q in rows if (q or "") == (p or "") and len((p or "").encode()) >= 1000]
        top = max((j for j in equal if j is not None), default=None)
        want.append((str(i), len((p or "").encode()), "revisit" if equal and top != i else "response", str(top if equal and top != i else None)))
    got = q_warc.op9_warc_segments(spark, str(tmp_path)).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    assert ("None", 0, "response", "None") in want and ("None", 40_000, "revisit", "3") in want


def test_stages(spark, docs, crowded, none, tmp_path):
    import shutil

    shutil.copy(f"{SF}/benchmark.parquet", tmp_path)
    for table in (docs, crowded, none):
        d = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, str(tmp_path))
            if k < 4:
                assert out.columns == table.columns, name
                out.write.parquet(path := str(tmp_path / f"{name}-{id(table)}"))
                d = spark.read.parquet(path)
                if table is docs and k == 0:
                    assert sorted(r["doc_id"] or 0 for r in d.collect()) == [0, 1, 2, 3, 4, 4, 9, 11]
                if table is docs and k == 1:
                    assert sorted(r["doc_id"] or 0 for r in d.collect()) == [0, 1, 4, 9, 11]
                if table is docs and k == 2:
                    assert {r["doc_id"] for r in d.collect()} == {None, 4, 9, 11} and all(r["n_chars"] == len(r["text"]) for r in d.collect())
            else:
                assert out.count() == (0 if table is none else 4)


def test_hot_keys_are_split(spark):
    left = spark.range(6000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id")
    right = left.select("k").distinct().withColumn("v", F.col("k") * 2)
    joined = join_by_hot_key(left, right, ["k"], ["id"])
    assert "_salt" in joined._jdf.queryExecution().toString()
    assert joined.where("v = k * 2").count() == 6000 and joined.columns == ["k", "id", "v"]


def test_near_duplicates_with_one_id_for_unlike_texts(spark):
    a, b = sentence(21), sentence(22)
    near = lambda s: s.replace(s.split()[50], "other")
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (7, sentence(23)), (1, None), (None, a)]
    for some in (rows, rows[::-1]):
        got = minhash.near_duplicates(spark.createDataFrame(some, "doc_id LONG, text STRING").coalesce(1)).collect()
        assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (7, 7)]


def test_usual_words_stay_remembered(monkeypatch):
    class Tokenizer:
        asked: list = []

        def encode_batch_fast(self, words, add_special_tokens):
            self.asked += words
            return [type("E", (), {"ids": [len(w)]}) for w in words]

    monkeypatch.setattr(packing, "REMEMBERED", 10)
    tokenizer, known, again = Tokenizer(), {}, set()
    for k in range(40):
        words = {b"the", b"of", f"rare{k}".encode(), f"{k}odd".encode()}
        assert packing._learn(words, tokenizer, known, again) == {} and words <= set(known) and len(known) <= 10
        assert all(packing._pack([len(w)]) == x for w, x in known.items())
    assert tokenizer.asked.count("the") == tokenizer.asked.count("of") == 1 and len(tokenizer.asked) == 82
