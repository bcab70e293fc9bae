"""The registered queries on the smallest tables, against SQL or plain Python that does the same the slow way."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF, same_rows

from newsloom.llm import minhash, registry, url_filter
from newsloom.llm.q_url_filter import RULES


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def result(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(registry.SQLS))
def test_query_equals_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.SQLS[name])


def removed(tokens, length):
    counts = Counter(tuple(t[k : k + length]) for t in tokens for k in range(len(t) - length + 1))
    out = []
    for t in tokens:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if counts[tuple(t[k : k + length])] > 1:
                gone[k : k + length] = True
        out.append(gone)
    return out


def test_repeated_words(spark, documents):
    words = [(d["text"] or "").encode().split() for d in documents]
    want = {}
    for d, w, gone in zip(documents, words, removed(words, 35), strict=True):
        want[d["doc_id"]] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in result(spark, "op2_suffix_trees")}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_repeated_bytes(spark, documents):
    raw = [(d["text"] or "").encode() for d in documents]
    want = {}
    counts = Counter(r[k : k + 200] for r in raw for k in range(len(r) - 199))
    for d, r in zip(documents, raw, strict=True):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if counts[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d["doc_id"]] = (len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result(spark, "op10_suffix_sort")}
    assert got == want and sum(x[1] for x in want.values()) > 0


def classes_of(ids, texts, similar):
    """Least id of each row's group, by comparing all pairs that share a shingle."""
    parent = dict(zip(ids, ids, strict=True))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = [t.split() for t in texts]
    bags = [Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []) for w in words]
    where = defaultdict(list)
    for k, b in enumerate(bags):
        for s in b:
            where[s].append(k)
    pairs = {(i, j) for v in where.values() for i in v for j in v if i < j} | {(i, j) for i in range(len(ids)) for j in range(i) if texts[i] == texts[j]}
    for i, j in pairs:
        if texts[i] == texts[j] or similar(bags[i], bags[j]):
            a, b = top(ids[i]), top(ids[j])
            parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def either(a, b):
    """Jaccard of the sets, or probability Jaccard by its definition."""
    both = a.keys() & b.keys()
    if len(both) / len(a.keys() | b.keys()) >= 0.8:
        return True
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in both) >= 0.8


def test_near_duplicates(spark, documents):
    ids, texts = [d["doc_id"] for d in documents], [d["text"] for d in documents]
    want = classes_of(ids, texts, either)
    assert {r["doc_id"]: r["class_id"] for r in result(spark, "op1_prob_minhash")} == want


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    names = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = (np.sort(names[:220]), rng.integers(1, 4, 220)), (np.sort(names[40:300]), rng.integers(1, 4, 260))
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for x, y in [(dict(zip(*a, strict=True)), dict(zip(*b, strict=True)))] for i in x.keys() & y.keys())
    got = np.mean(minhash.prob_minhash(*a, 4000) == minhash.prob_minhash(*b, 4000))
    assert got == pytest.approx(want, abs=0.03)


def test_language(spark, documents):
    rows = {r["doc_id"]: r for r in result(spark, "op5_language_id")}
    held = [d for d in documents if zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1]
    assert {k for k, r in rows.items() if r["held_out"]} == {d["doc_id"] for d in held}
    assert np.mean([rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_packing(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d["doc_id"]: tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [2] for d in documents}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in result(spark, "op7_nnls_packing"):
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for found, total in [(v, len(ids[k])) for k, v in pieces.items()] + [(v, None) for v in places.values()]:
        at = 0
        for start, n in sorted(found):
            assert start == at
            at += n
        assert at == total if total is not None else at <= 4096
    assert pieces.keys() == ids.keys()
    assert sum(map(len, ids.values())) > 0.97 * 4096 * len(places)


def test_decontamination(spark, documents):
    items = {r["item_id"]: " ".join(r["text"].split()) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    want = {(d["doc_id"], k) for d in documents for k, t in items.items() if t in " ".join((d["text"] or "").split())}
    rows = result(spark, "op8_spaced_seeds")
    assert want <= {(r["doc_id"], r["item_id"]) for r in rows}
    grams = {k: {tuple(w[j : j + 8]) for w in [t.split()] for j in range(len(w) - 7)} for k, t in items.items()}
    texts = {d["doc_id"]: d["text"].split() for d in documents}
    for r in rows:  # nothing that shares no run of words
        w = texts[r["doc_id"]]
        assert any(tuple(w[j : j + 8]) in grams[r["item_id"]] for j in range(len(w) - 7))


def test_kneser_ney(spark):
    rows = {r["doc_id"]: r for r in result(spark, "op3_kneser_ney")}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    kept = lambda q: np.mean([rows[k]["kept"] for k, v in labels.items() if v == q])
    assert kept(1) > 0.97 and kept(0) < 0.5


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_perplexities(spark, documents, order):
    """Perplexities of documents from dicts of counts, by the definition; a trained one's by counts that leave it out."""
    from newsloom.llm import kneser_ney as kn

    trained = {r["doc_id"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["quality"] == 1 and r["doc_id"] % 3}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = kn.stored(kn.chunks(docs, spark.createDataFrame([(i,) for i in trained], "id LONG"), "doc_id", "text", "lang"))
    rows = {r["id"]: r for r in kn.perplexities(texts, order).collect()}
    words = {d["doc_id"]: [b""] * (order - 1) + d["text"].encode().split() for d in documents if d["text"]}
    grams = {i: [tuple(w[k : k + order]) for k in range(len(w) - order + 1)] for i, w in words.items()}

    def counts(ids):
        orders = [Counter(g for i in ids for g in grams.get(i, ()))]
        for _ in range(order - 1):
            orders.append(Counter(g[1:] for g in orders[-1]))
        return orders

    everything = counts(trained)
    taken = [kn.discounts(*(sum(x == k for x in c.values()) for k in range(1, 5))) for c in everything]
    size = len(everything[-1])
    assert len(rows) == len(words)
    for i in list(words)[::25]:
        own = counts(trained - {i}) if i in trained else everything
        under = [defaultdict(dict) for _ in own]
        for c, u in zip(own, under, strict=True):
            for g, n in c.items():
                u[g[:-1]][g[-1]] = n

        def probability(g, k=0):
            if k == order:
                return 1 / (size + 1)
            found, lower = under[k].get(g[:-1]), probability(g[1:], k + 1)  # noqa: B023
            if not found:
                return lower
            off = lambda n: taken[k][min(n, 3)]
            return (found.get(g[-1], 0) - off(found.get(g[-1], 0)) + sum(map(off, found.values())) * lower) / sum(found.values())

        if grams[i]:
            assert rows[i]["n_words"] == len(grams[i])
            assert rows[i]["perplexity"] == pytest.approx(math.exp(-np.mean([math.log(probability(g)) for g in grams[i]])), rel=1e-6)


def ratio(text, counts, chars):
    """Mean Witten-Bell log-likelihood difference of a site's symbols, from dicts of n-gram counts."""
    total = 0.0
    s = (chars - 1,) * url_filter.ORDER + tuple(text) + (chars - 1,)
    for k in range(url_filter.ORDER, len(s)):
        logs = []
        for label in ("allow", "block"):
            p = 1 / chars
            for n in range(url_filter.ORDER + 1):
                own = counts[label][n].get(s[k - n : k], {})
                if own:
                    p = (own.get(s[k], 0) + len(own) * p) / (sum(own.values()) + len(own))
            logs.append(math.log(p))
        total += logs[0] - logs[1]
    return total / (len(text) + 1)


def test_url_filter(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    chars = url_filter.SYMBOLS
    code = {c: k + 1 for k, c in enumerate(url_filter.ALPHABET)}
    rows = {r["page_id"]: r for r in result(spark, "op6_url_filter")}
    counts = {x: [defaultdict(Counter) for _ in range(url_filter.ORDER + 1)] for x in ("allow", "block")}
    sites, fits = {}, {}
    for p in pages:
        rest = p["url"].partition("://")[2]
        cut = lambda s, marks: s[: min([s.index(c) for c in marks if c in s], default=len(s))]
        host = cut(rest, "/?#")
        path = cut(rest[len(host) :], "?#")
        r = rows[p["page_id"]]
        assert (r["host"], r["path"]) == (host.lower(), path)
        hit = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(hit, key=lambda x: len(x.name), default=None)
        assert r["rule"] == (best and best.name) and (best is None or r["verdict"] == best.verdict)
        sites[p["page_id"]] = [code.get("0" if c in "0123456789" else c.lower() if c.isascii() else c, 0) for c in host.lower() + path]
        fits[p["page_id"]] = best and best.verdict
    for k, site in sites.items():
        if fits[k]:
            s = (chars - 1,) * url_filter.ORDER + tuple(site) + (chars - 1,)
            for j in range(url_filter.ORDER, len(s)):
                for n in range(url_filter.ORDER + 1):
                    counts[fits[k]][n][s[j - n : j]][s[j]] += 1
    for k, site in sites.items():
        assert rows[k]["llr"] == pytest.approx(ratio(site, counts, chars), abs=1e-4)
    free = [r for k, r in rows.items() if not fits[k]]
    assert max((r["llr"] for r in free if r["verdict"] == "block"), default=-9) <= min((r["llr"] for r in free if r["verdict"] == "allow"), default=9)


def test_pipeline_equals_plain_python(spark, documents):
    """The documents and texts that reach the packing, by a plain chain of the four filters, and their pieces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from newsloom.llm import decontam, line_rules, suffix

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "suffix_array_dedup", "decontamination", "packing"]
    left = {}
    for d in documents:
        verdict = dict(zip(line_rules.COLUMNS, line_rules.judge(d["text"]), strict=True))
        if verdict["kept"]:
            left[d["doc_id"]] = verdict["clean_text"]
    classes = classes_of(list(left), list(left.values()), either)
    left = {i: t for i, t in left.items() if classes[i] == i}
    raw = {i: t.encode() for i, t in left.items()}
    counts = Counter(r[k : k + 200] for r in raw.values() for k in range(len(r) - 199))
    for i, r in raw.items():
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if counts[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left[i] = suffix.whole_characters(r, gone) if gone.any() else left[i]
    left = {i: t for i, t in left.items() if t.split()}
    items = [decontam.word_hashes(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    left = {i: t for i, t in left.items() if not any(overlaps_plainly(decontam.word_hashes(t), w) for w in items)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]))
    assert got.keys() == left.keys()
    for i, pieces in got.items():
        ids = np.array([*tokenizer.encode(left[i], add_special_tokens=False).ids, 2], "<u4")
        assert sum(n for _, n, *_ in pieces) == len(ids)
        assert all(total == len(ids) and crc == zlib.crc32(ids[a : a + n].tobytes()) for a, n, total, crc in pieces)


def overlaps_plainly(words, item):
    """Whether a document overlaps with an item: on a diagonal, a mask sees equal words only, and a run around it has enough of them."""
    from newsloom.llm import decontam

    least = min(decontam.MIN_MATCH, len(item))
    for shift in range(-len(item) + 1, len(words)):
        i, j = max(shift, 0), max(-shift, 0)
        n = min(len(words) - i, len(item) - j)
        same = words[i : i + n] == item[j : j + n]
        if same.sum() < max(least, 1):
            continue
        at = np.flatnonzero(same)
        for part in np.split(at, np.flatnonzero(np.diff(at) > decontam.MAX_GAP + 1) + 1):
            inside = same.copy()
            inside[: part[0]] = inside[part[-1] + 1 :] = False
            seen = any(all(inside[k + p] for p, c in enumerate(m) if c == "1") for m in decontam.MASKS for k in range(max(0, part[0] - 16), n - len(m) + 1))
            if seen and any(q - p + 1 >= least and q - p + 1 >= decontam.MIN_SHARE * (part[q] - part[p] + 1) - 1e-9 for p in range(len(part)) for q in range(p, len(part))):
                return True
    return False


def test_language_profiles_in_plain_python(spark, monkeypatch):
    """Predictions and scores from trigrams bound and bundled one by one; also where languages are compared block by block, and with ties."""
    from newsloom.llm import langid

    texts = [("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("THE end, of it!", "en"), ("der Hund und die Katze", "xx"), ("日本語 の テキスト", "ja"), (None, "en"), ("42 -- 7", "en"), ("ein kleines Haus", None), ("the thing", None), ("", None)]
    rows = [(k, t, lang) for k, (t, lang) in enumerate(texts)] + [(1, "the dog", None), (1, "la maison", None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")

    def bundle(t):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split()) + " "
        total = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            total += np.roll(langid.letter_vector(ord(a)).astype(float), 2) * np.roll(langid.letter_vector(ord(b)), 1) * langid.letter_vector(ord(c))
        return total / np.linalg.norm(total) if s.strip() else None

    sums = {}
    for _, t, lang in rows:
        if lang and (v := bundle(t)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    known = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items())}
    want = []
    for i, t, _ in rows:
        v = bundle(t)
        best = max(known, key=lambda k: round(float(known[k] @ v), 5)) if v is not None else "und"  # the first of equal ones
        want.append((i, best, max(0.0, float(known[best] @ v)) if v is not None else 0.0))
    for block in (1000, 2):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = sorted(map(tuple, langid.predict_language(docs, langid.train_prototypes(docs)).collect()))
        assert [r[:2] for r in got] == [r[:2] for r in sorted(want)]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in sorted(want)], abs=1e-4)
    assert {r[1] for r in want} >= {"de", "und", "en"} and "xx" not in {r[1] for r in want}
