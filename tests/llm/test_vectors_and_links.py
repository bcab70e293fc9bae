"""Vector codes, clusters and the n-gram join against plain Python, and their edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import dual_tree, parity_join, vector_codes

CLASHING = ("id", "code", "error", "cluster", "distance", "node", "comp", "size", "key", "n", "g", "a.b", "c`d")


def plain_lloyd(x, start, rounds):
    """Assignments and centroids after some rounds, by all distances."""
    c = start.copy()
    for k in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if k < rounds:
            for j in set(a.tolist()):
                rows = x[a == j]
                c[j] = [s // len(rows) for s in rows.sum(0).tolist()]
    return a, d.min(1), c


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(v) for v in rng.integers(-3, 4, 8) / 4], int(rng.integers(0, 3)) if k % 9 else None) for k in range(140)]
    rows += [(200 + k, [0.25] * 8, 1) for k in range(60)]  # one vector in many rows
    rows += [(5, rows[3][1], 2), (5, rows[5][1], None), (300, None, 1), (301, [1.0, None] * 4, 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] * 8, None), (304, [], 1), (305, [1.0] * 4, 0), (None, [0.5] * 8, 1)]
    return rows, spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, label INT")


def kept(rows):
    return [r for r in rows if r[1] is not None and len(r[1]) == 8 and all(v is not None and np.isfinite(v) for v in r[1])]


def test_codes_equal_plain_lloyd(spark, vectors):
    rows, df = vectors
    mine = sorted(kept(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in mine]) * 1024).astype(np.int64)
    found = [plain_lloyd(x[:, p * 2 : p * 2 + 2], x[:16, p * 2 : p * 2 + 2], 4) for p in range(4)]
    errors = sum(d for _, d, _ in found)
    labels = {}
    for r, e in zip(mine, errors.tolist(), strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for _, _, c in found for v in c.ravel().tolist()).encode()).hexdigest()
    want = sorted((str(r[0]), "".join(f"{a[k]:02x}" for a, _, _ in found), int(errors[k]), labels[r[2]], digest) for k, r in enumerate(mine))
    for table in (df, df.select("*", *[F.lit("x").alias(c) for c in CLASHING])):
        got = vector_codes.encode(table, entries=16).collect()
        assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == want


def test_clusters_equal_plain_lloyd(spark, vectors):
    rows, df = vectors
    mine = kept(rows)
    order = sorted(range(len(mine)), key=lambda k: (mine[k][0] is None, hashlib.sha256(f"2:{mine[k][0]}".encode()).hexdigest(), mine[k][1]))
    x = np.floor(np.array([r[1] for r in mine]) * 256).astype(np.int64)
    a, d, c = plain_lloyd(x, x[order[:12]], 5)
    want = sorted((str(r[0]), int(a[k]), int(d[k]), int(d[a == a[k]].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[a[k]].tolist())).encode()).hexdigest()) for k, r in enumerate(mine))
    for table in (df, df.select("*", *[F.lit("x").alias(c) for c in CLASHING])):
        got = dual_tree.cluster_vectors(table, dims=8, clusters=12).collect()
        assert sorted((str(r["vec_id"]), *list(r)[1:]) for r in got) == want


def test_few_and_no_vectors(spark, vectors):
    _, df = vectors
    for f in (vector_codes.encode, lambda t: dual_tree.cluster_vectors(t, dims=8)):
        assert f(df.limit(0)).isEmpty() and f(df.where("vec_id >= 300")).count() <= 1
        assert sorted(r["vec_id"] for r in f(df.where("vec_id IN (1, 2)")).collect()) == [1, 2]
    one = vector_codes.encode(df.where("vec_id = 1")).first()
    assert (one["code"], one["error"], one["label_error"]) == ("00000000", 0, 0)
    with pytest.raises(Exception, match="must lie within"):
        vector_codes.encode(spark.createDataFrame([(1, [1e30] * 8, 1)], df.schema)).collect()


def test_partial_distances_and_trees():
    rng = np.random.default_rng(1)
    for trial in range(40):
        d, n, k = (int(v) for v in rng.integers((1, 1, 1), (7, 150, 30)))
        x, c = rng.integers(-5, 6, (n, d)), rng.integers(-5, 6, (k, d))
        far = ((x[:, None] - c[None]) ** 2).sum(2)
        code, least = vector_codes.nearest(x, c)
        assert (code == far.argmin(1)).all() and (least == far.min(1)).all()
        points = np.unique(x, axis=0)
        tree, order = dual_tree.cover_tree(points)
        assert sorted(order.tolist()) == list(range(len(points)))
        for j in range(1, tree.size):  # whatever hangs below a point lies within its radius
            above = tree.parent[j]
            while above >= 0:
                assert np.sqrt(((tree.points[above] - tree.points[j]) ** 2).sum()) <= tree.radius[above] * (1 + 1e-9)
                above = tree.parent[above]
        over, number = dual_tree._centroid_tree(c)
        given = np.full(2 * tree.size, -1)
        for nodes, cluster in dual_tree.assign(tree, over, number):
            given[nodes] = cluster
        for j in range(1, tree.size):
            given[j] = given[tree.parent[j]] if given[tree.parent[j]] >= 0 else given[j]
        got = np.where(given[: tree.size] >= 0, given[: tree.size], given[tree.size :])
        assert (got == ((tree.points[:, None] - c[None]) ** 2).sum(2).argmin(1)).all(), trial


def plain_components(rows):
    """n_shingles and component by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted((str(i), len(s), str(least.get(top(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def family(rng, words, n, changes):
    """Texts that differ from one in some words each, at either end or inside."""
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(int(rng.integers(0, changes + 1))):
            at = int(rng.integers(0, len(w)))
            w[at : at + int(rng.integers(0, 2))] = [f"x{rng.integers(0, 40)}"]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_links_equal_all_pairs(spark, small, monkeypatch):
    if small:
        for name, value in (("GATHERED", 300), ("LOCAL", 3), ("SHARD", 50), ("BLOCK", 3), ("SMALL", 4), ("GROUP", 20), ("OFTEN", 2)):
            monkeypatch.setattr(parity_join, name, value)
    rng = np.random.default_rng(7)
    texts = []
    for length in (1, 2, 4, 5, 6, 9, 14, 31, 32, 33, 60, 120, 250):
        words = [f"w{rng.integers(0, 60)}" for _ in range(length)]
        texts += family(rng, words, 25, max(1, length // 12))
    common = " ".join(f"c{k}" for k in range(30))  # a passage that is most of some texts
    texts += [f"{common} " + " ".join(f"y{rng.integers(0, 999)}" for _ in range(int(rng.integers(1, 14)))) for _ in range(60)]
    rows = [(k, t.upper() if k % 7 == 0 else t) for k, t in enumerate(texts)]
    rows += [(3, texts[40]), (None, texts[50]), (None, "q r s t u v"), (900, None), (901, ""), (902, " \n\t"), (903, "É é"), (904, "é é"), (905, texts[-1]), (905, texts[-1])]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = parity_join.shingle_components(df.select("*", *[F.lit(1).alias(c) for c in CLASHING])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_components(rows)


def test_links_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert parity_join.shingle_components(df).isEmpty()
    alone = spark.createDataFrame([(2, None), (1, "")], "doc_id LONG, text STRING")
    assert sorted(map(tuple, parity_join.shingle_components(alone).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_sets_that_link_share_a_key():
    """The pigeonhole: whatever is common, two sets that link share a key; and sketches differ in no more bits than sets are apart."""
    rng = np.random.default_rng(2)
    for trial in range(300):
        n = int(rng.integers(1, 300))
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        most = parity_join.apart(len(base), len(base))
        other = np.unique(np.concatenate([base[int(rng.integers(0, most // 2 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, most // 2 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if 100 * both < 80 * (len(base) + len(other) - both):
            continue
        common = np.sort(base[rng.random(len(base)) < rng.random()])
        mine = [parity_join.segment_keys(t, np.zeros(len(t), np.int64), common, 1)[0] for t in (base, other)]
        assert len(np.intersect1d(*mine)), trial
        x, y = parity_join._same_width([parity_join.dense_sketch(t) for t in (base, other)])
        assert np.bitwise_count(x ^ y).sum() <= len(base) + len(other) - 2 * both
