"""Near-duplicates by ProbMinHash, banding and verification.

A document is the multiset of its five-word shingles; a document of fewer words is one shingle. Its signature comes from
ProbMinHash: each distinct shingle of weight w sends points of a Poisson process of rate w, each to a random register, until the
next point would come later than what every register already holds; a register keeps the shingle whose point came first. Two
signatures agree at a register with the probability Jaccard similarity of the documents.

1. Equal texts are one class each; only the least id of each goes on, so a text with millions of copies is one row.
2. Bands of :data:`ROWS` registers make buckets. The weight of a document is the size of all its buckets; the original of a family of
   copies has most. The member of a bucket with the greatest weight (the least id of those) is its center, so the buckets of a family
   mostly have one center. Each document is compared with the weightiest of its centers, then with the other ones if those are of another
   group. A pair is linked if its shingle sets' Jaccard similarity, or its probability Jaccard similarity, both taken exactly from
   the texts, is ``threshold`` or more. Shingles are hashed anew for this, with a base drawn in each call.
3. Links make groups (connected components: least labels spread along links, and labels of labels are followed).
4. In buckets that still hold several groups, members are compared with the member that has most links. After that, members that are
   still of different groups are compared with each other if they share a shingle that their center lacks, or if what they share with
   the center is enough for the threshold (:func:`_pairs_apart`), at every size of a bucket. So every pair that shares a bucket is compared, of one group already,
   or known not to be similar; none is left out.

Which pairs share a bucket is chance: at a probability Jaccard similarity of 0.8 nearly all do, but a pair whose shingle sets alone
are similar may share none and is then not linked.

Rows of a hot bucket or of a hot least id are dealt to many tasks. Tables that are read again are written to the shared folder.

* Null texts are never compared: each row is a class of its own. Empty and blank texts have no shingles and match equal texts only.
* Very long texts are shingled whole. Equal rows and ties: the least id stands for a group. Unlike texts with one id are documents of their own.
* Rows with a null id are not compared and have a null class.
* An empty table gives an empty table. Only id and text columns are read; others don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import batch_map, drop_stored, join_by_hot_key, mixed, packed_texts, quoted, stored
from newsloom.llm.hashing import Keys, word_spans

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 6
REGISTERS = BANDS * ROWS
#: Texts are signed in groups of so many characters, and points drawn so many at once, so that arrays stay in a core's cache.
CHARACTERS, POINTS = 200_000, 4096
#: So many shingles of texts that are compared again are kept at hand.
KNOWN = 200_000


def _runs_of_words(words: np.ndarray, size: int, keys: Keys) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    odd = mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(keys.bases[0] << 31 | keys.bases[1])) | np.uint64(1)
    h = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for j in range(size):
        h += words[j : j + len(h)] * odd[j]
    return mixed(h)


def shingles(text: str | None, size: int = SHINGLE, keys: Keys = Keys()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct shingles, sorted, and how often each occurs."""
    words = word_spans((text or "").encode(), keys)[0]
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(_runs_of_words(words, min(size, len(words)), keys), return_counts=True)


def shingle_groups(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`shingles` of several texts at once, one after another: hashes, how often each occurs, and whose it is."""
    raw = [t.encode() for t in texts]
    words, starts, _ = word_spans(b" ".join(raw))
    edges = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)])).tolist()
    h, parts = _runs_of_words(words, size, Keys()), []
    for t, a, b in zip(texts, edges, edges[1:], strict=False):
        if b - a < size:
            parts.append(shingles(t, size)[0])
            continue
        own = h[a : b - size + 1]
        own.sort()
        parts.append(own)
    sizes = [len(x) for x in parts]
    whole, owner = np.concatenate(parts), np.repeat(np.arange(len(texts)), sizes)
    first = np.ones(len(whole), bool)
    first[1:] = (whole[1:] != whole[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return whole[at], np.diff(np.append(at, len(whole))), owner[at]


def prob_minhash(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The element whose point came first at each register."""
    return prob_minhashes(elements, weights, np.zeros(len(elements), np.int64), 1, registers)[0]


def prob_minhashes(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """:func:`prob_minhash` of several texts at once; ``owner`` says whose each element is.

    Each point takes one 64-bit hash of element and step: 40 bits give the gap since the point before, 24 bits the register.
    """
    first, winner = np.full(texts * registers, np.inf), np.zeros(texts * registers, np.uint64)
    live, reached, t = elements, np.zeros(len(elements)), 0
    scale, base = 1.0 / weights, owner * registers
    while len(live):
        block = max(1, min(1024, POINTS // len(live)))
        steps = np.arange(t + 1, t + block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        r = mixed(live[:, None] + steps[None, :])
        at = np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40)
        at *= -scale[:, None]
        at[:, 0] += reached
        if block > 1:
            np.cumsum(at, axis=1, out=at)
        place = ((r & np.uint64(0xFFFFFF)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64) + base[:, None]
        row, column = np.nonzero(at < first[place])
        when, where = at[row, column], place[row, column]
        np.minimum.at(first, where, when)
        won = first[where] == when
        winner[where[won]] = live[row[won]]
        reached = at[:, -1]
        on = reached < first.reshape(texts, registers).max(1)[base // registers]
        live, reached, scale, base, t = live[on], reached[on], scale[on], base[on], t + block
    return winner.reshape(texts, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = 0.0) -> float:
    """The larger of the Jaccard similarity of two shingle sets and the probability Jaccard similarity of the multisets.

    The second is not computed where it must be below ``least``: it is at most what the distributions have in common.
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    union = len(a[0]) + len(b[0]) - len(i)
    plain = len(i) / union
    if not len(i) or (a[1].max() == 1 and b[1].max() == 1):
        return plain
    if np.minimum(a[1][i] / a[1].sum(), b[1][j] / b[1].sum()).sum() < least - 1e-9:
        return plain
    x = np.concatenate([a[1][i], np.delete(a[1], i), np.zeros(len(b[1]) - len(j), np.int64)])
    y = np.concatenate([b[1][j], np.zeros(len(a[1]) - len(i), np.int64), np.delete(b[1], j)])
    width = int(y.max()) + 1
    pairs, n = np.unique(x * width + y, return_counts=True)
    x, y = pairs // width, pairs % width
    total = 0.0
    for k in np.flatnonzero((x > 0) & (y > 0)):
        total += n[k] / (n * np.maximum(x / x[k], y / y[k])).sum()
    return max(plain, float(total))


def band_keys(owners: np.ndarray) -> np.ndarray:
    """The bucket of each band of each signature."""
    rows = owners.reshape(-1, BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), 1))
    for j in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return h.view(np.int64)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in groups of some :data:`CHARACTERS`."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 500
        if size > CHARACTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def signed_texts(texts: list[str]) -> dict[str, np.ndarray | None]:
    """Bands of each text; None without shingles."""
    out: dict[str, np.ndarray | None] = {}
    for group in _groups(list(dict.fromkeys(texts))):
        elements, weights, owner = shingle_groups(group)
        owners = prob_minhashes(elements, weights, owner, len(group))
        some = np.bincount(owner, minlength=len(group)) > 0
        bands = band_keys(owners)
        out |= {t: bands[k] if some[k] else None for k, t in enumerate(group)}
    return out


def signatures(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, copy (a digest of the text) and bands (null without shingles) of each row whose text isn't null."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        known = signed_texts(texts)
        return {"id": batch.column("id"), "copy": batch.column("copy"), "bands": [known[t] for t in texts]}

    t = F.col(quoted(text))
    columns = [F.col(quoted(id_column)).cast("long").alias("id"), t.alias("text"), F.unhex(F.md5(F.encode(t, "utf-8"))).alias("copy")]
    return batch_map(docs.where(t.isNotNull()), columns, run, "id long, copy binary, bands array<long>")


def _compared(pairs: DataFrame, docs: DataFrame, judge: Callable[[tuple, tuple], tuple | None], schema: str) -> DataFrame:
    """What ``judge`` gives for the shingles of both texts of each pair (a, b), where that isn't None; ``docs`` has id and packed text. b may be hot."""
    keys = Keys.drawn()
    # texts are shuffled at every size: a plan that broadcasts some of them on small tables says nothing about large ones
    left = pairs.hint("merge").join(docs.select(F.col("id").alias("a"), F.col("packed").alias("x")), "a")
    wanted = stored(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size")))
    right = wanted.drop("size").hint("merge").join(docs.select(F.col("id").alias("b"), F.col("packed").alias("y")), "b")
    both = join_by_hot_key(left, right, ["b"], ["a"], sizes=wanted)
    names = T._parse_datatype_string(schema).names

    def run(batch: pa.RecordBatch) -> dict:
        unpack, known, rows = zstandard.ZstdDecompressor(), {}, []

        def read(i: int, packed: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            if i not in known:
                if sum(len(k) for k, _ in known.values()) > KNOWN:
                    known.clear()
                known[i] = shingles(unpack.decompress(packed.as_py()).decode(), keys=keys)
            return known[i]

        for a, x, b, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("b").to_pylist(), batch.column("y"), strict=True):
            if (found := judge(read(a, x), read(b, y))) is not None:
                rows.append((a, b, *found))
        return dict(zip(names, zip(*rows, strict=True) if rows else ([],) * len(names), strict=True))

    out = stored(batch_map(both, ["a", "x", "b", "y"], run, schema))
    drop_stored(wanted)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` that are similar."""
    return _compared(pairs, docs, lambda x, y: () if similarity(x, y, threshold) >= threshold else None, "a long, b long")


def beside(x: tuple[np.ndarray, np.ndarray], center: tuple[np.ndarray, np.ndarray]) -> tuple[int, float, int, bool, list[dict]]:
    """How many shingles x has in common with the center, the share of x's weight on them, how many x has, whether none occurs twice, and the other shingles with their shares."""
    common, share = np.isin(x[0], center[0], assume_unique=True), x[1] / x[1].sum()
    rest = [{"s": s, "w": w} for s, w in zip(x[0][~common].view(np.int64).tolist(), share[~common].tolist(), strict=True)]
    return int(common.sum()), float(share[common].sum()), len(common), bool(x[1].max() < 2), rest


def components(links: DataFrame) -> DataFrame:
    """node and label, the least node that is linked with it, for each node in ``links`` (a, b).

    Each round, a node takes the least of itself and its neighbours for a label, and links are drawn between labels instead,
    until none is left between different ones. A star takes one round, a chain the logarithm of its length.
    """
    edges, labels = stored(links.select("a", "b").union(links.select("b", "a")).distinct()), None
    while True:
        step = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        if labels is None:
            labels = stored(step.select(F.col("a").alias("node"), F.col("to").alias("label")))
        else:
            before = labels
            moved = before.join(step, before["label"] == step["a"], "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = stored(moved)
            drop_stored(before)
        mine, other = step.withColumnRenamed("to", "x"), step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        new = stored(edges.join(mine, "a").join(other, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        drop_stored(edges)
        drop_stored(step)
        edges = new
        if edges.isEmpty():
            drop_stored(edges)
            return labels


def _placed(ones: DataFrame) -> DataFrame:
    """bucket, size, id and center of the members of buckets with several members, and the center's weight."""
    members = ones.where("bands IS NOT NULL").select("id", F.explode("bands").alias("bucket"))
    buckets = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = stored(join_by_hot_key(members, buckets, ["bucket"], ["id"], sizes=buckets))
    weighed = stored(shared.join(shared.groupBy("id").agg(F.sum("size").alias("weight")), "id"))
    drop_stored(shared)
    top = F.max(F.struct("weight", (-F.col("id")).alias("k"))).alias("top")
    centers = weighed.groupBy("bucket").agg(top).select("bucket", (-F.col("top.k")).alias("center"), F.col("top.weight").alias("center_weight"))
    placed = stored(join_by_hot_key(weighed.drop("weight"), centers, ["bucket"], ["id"], sizes=buckets))
    drop_stored(weighed)
    drop_stored(buckets)
    return placed


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id and class_id, the least id of the row's group, for each row of ``docs``."""
    usable = F.col(quoted(id_column)).isNotNull() & F.col(quoted(text)).isNotNull()
    signed = stored(signatures(docs.where(usable), id_column, text))
    nulls = docs.where(~usable).select(F.col(quoted(id_column)).cast("long").alias("id"))
    nulls = nulls.select("id", F.col("id").alias("class_id")).withColumnRenamed("id", id_column)
    if not signed.groupBy("id").agg(F.min("copy").alias("lo"), F.max("copy").alias("hi")).where("lo <> hi").isEmpty():
        return _classes_by_text(docs.where(usable), signed, id_column, text, threshold).union(nulls)
    ones = signed.groupBy("copy").agg(F.min(F.struct("id", "bands")).alias("m"), F.count(F.lit(1)).alias("copies"))
    ones = stored(ones.select("copy", "copies", "m.*"))
    placed = _placed(ones)
    texts = packed_texts(docs.where(usable), id_column, text).join(placed.select("id").distinct().hint("merge"), "id", "left_semi")
    texts = stored(texts.dropDuplicates(["id"]))
    best = F.max(F.struct("center_weight", (-F.col("center")).alias("k"))).alias("best")
    pairs = placed.where("id <> center").groupBy("id").agg(best).select(F.col("id").alias("a"), (-F.col("best.k")).alias("b"))
    tried = stored(pairs)
    links = _verified(tried, texts, threshold)
    groups = components(links)
    steps = (_other_centers, lambda rows: _hub_pairs(rows, links), lambda rows: _pairs_apart(rows, texts, threshold))
    for step in steps:
        rows = _open_buckets(placed, groups)
        more = stored(_untried(step(rows), tried))
        drop_stored(rows)
        if more.isEmpty():
            continue
        found = _verified(more, texts, threshold)
        tried = tried.union(more)
        if not found.isEmpty():
            drop_stored(groups)
            links = links.union(found)
            groups = components(links)
    drop_stored(placed)
    drop_stored(texts)
    class_of = ones.join(groups, ones["id"] == groups["node"], "left").select("copy", "copies", F.coalesce("label", "id").alias("class_id"))
    class_of = stored(class_of)
    drop_stored(ones)
    drop_stored(groups)
    several = class_of.where("copies > 1")
    out = join_by_hot_key(signed.select("id", "copy"), class_of.drop("copies"), ["copy"], ["id"], sizes=several.select("copy", F.col("copies").alias("size")))
    return out.select("id", "class_id").withColumnRenamed("id", id_column).union(nulls)


def _classes_by_text(docs: DataFrame, signed: DataFrame, id_column: str, text: str, threshold: float) -> DataFrame:
    """Classes where unlike texts share an id: distinct texts are numbered and grouped, and each row gets the least id of its text's class."""
    t = F.col(quoted(text))
    once = docs.select(t.alias("text"), F.unhex(F.md5(F.encode(t, "utf-8"))).alias("copy")).dropDuplicates(["copy"])
    once = stored(once.withColumn("number", F.monotonically_increasing_id()))
    of = stored(near_duplicates(once, "number", "text", threshold).join(once.select("number", "copy"), "number").select("copy", "class_id"))
    rows = stored(join_by_hot_key(signed.select("id", "copy"), of, ["copy"], ["id"]))
    least = rows.groupBy("class_id").agg(F.min("id").alias("least"))
    out = join_by_hot_key(rows.select("id", "class_id"), least, ["class_id"], ["id"])
    return out.select(F.col("id").alias(id_column), F.col("least").alias("class_id"))


def _open_buckets(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """bucket, size, id, center, group and main (a group) of the members of buckets that have several groups."""
    label = groups.select(F.col("node").alias("id"), "label")
    rows = stored(placed.drop("center_weight").join(label, "id", "left").withColumn("group", F.coalesce("label", "id")).drop("label"))
    several = rows.groupBy("bucket").agg(F.min("group").alias("main"), F.max("group").alias("most"), F.first("size").alias("size")).where("main < most")
    several = stored(several.drop("most"))
    found = stored(join_by_hot_key(rows.drop("size"), several, ["bucket"], ["id"], sizes=several.drop("main")))
    drop_stored(rows)
    drop_stored(several)
    return found


def _other_centers(rows: DataFrame) -> DataFrame:
    """Members and the center of their bucket, where it is of another group."""
    centers = rows.where("id = center").select("bucket", F.col("group").alias("g"))
    sizes = rows.where("id = center").select("bucket", "size")
    return join_by_hot_key(rows.drop("size"), centers, ["bucket"], ["id"], sizes=sizes).where("group <> g").select(F.col("id").alias("a"), F.col("center").alias("b"))


def _hub_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Members and the member of their bucket that has most links, where it is of another group."""
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    known = rows.join(degree, rows["id"] == degree["a"])
    hub = F.max(F.struct("degree", (-F.col("id")).alias("k"), F.col("group").alias("g")))
    hubs = stored(known.groupBy("bucket").agg(hub.alias("hub"), F.first("size").alias("size")).select("bucket", "size", (-F.col("hub.k")).alias("b"), F.col("hub.g").alias("g")))
    return join_by_hot_key(rows.drop("size"), hubs.drop("size"), ["bucket"], ["id"], sizes=hubs.select("bucket", "size")).where("group <> g").select(F.col("id").alias("a"), "b")


def _pairs_apart(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different groups in one bucket that can be similar at all, by what each member has in common with their center.

    Two members have at most as many shingles in common as the one with fewer of the center's shingles has of those, and the ones that both have and
    the center lacks, which are joined and counted. Likewise their probability Jaccard similarity is at most the smaller of their weights on the
    center's shingles and the lesser weight of each other shingle that both have (two couplings agree no more often than their distributions
    overlap). A pair is left out only if both bounds are below what the threshold needs.
    """
    of = rows.where("id <> center").select(F.col("id").alias("a"), F.col("center").alias("b")).distinct()
    near = _compared(of, texts, beside, "a long, b long, common long, share double, n long, plain boolean, rest array<struct<s: long, w: double>>")
    facts = ["group", "common", "share", "n", "plain"]
    known = stored(near.join(rows.select(F.col("id").alias("a"), "group").distinct(), "a"))
    drop_stored(near)
    other = lambda df: df.select(*[F.col(c).alias(f"{c}_2") if c in ("a", "w", *facts) else F.col(c) for c in df.columns])

    def can(same: Column, weight: Column) -> Column:
        plain = F.least("common", "common_2") + same >= threshold / (1 + threshold) * (F.col("n") + F.col("n_2")) - 1e-6
        weighed = F.least("share", "share_2") + weight >= threshold - 1e-6
        return plain | (weighed & ~(F.col("plain") & F.col("plain_2")))

    spread = stored(known.select("a", "b", *facts, F.explode("rest").alias("r")).select("a", "b", *facts, "r.s", "r.w"))
    several = spread.groupBy("b", "s").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("b", "s", "size")
    several = stored(several)
    shared = join_by_hot_key(spread, several, ["b", "s"], ["a"], sizes=several)
    x = stored(_with_rank(shared, threshold).where("early OR late OR heavy"))
    drop_stored(spread)
    y = other(x).withColumnsRenamed({"late": "late_2", "heavy": "heavy_2"}).drop("size", "early").where("late_2 OR heavy_2")
    smaller = F.expr("n < n_2 OR (n = n_2 AND a < a_2)")
    meet = (F.col("early") & F.col("late_2") & smaller) | (F.col("heavy") & F.col("heavy_2") & ~(F.col("plain") & F.col("plain_2")) & F.expr("a < a_2"))
    both = join_by_hot_key(x.drop("late", "size").where("early OR heavy"), y, ["b", "s"], ["a"], sizes=several).where(F.expr("group <> group_2") & meet)
    sharing = both.select("b", F.least("a", "a_2").alias("a"), F.greatest("a", "a_2").alias("a_2")).distinct()
    own = known.select("a", "b", "common", "share", "n", "plain", "rest")
    sharing = sharing.join(own, ["a", "b"]).join(own.select("b", *[F.col(c).alias(f"{c}_2") for c in own.columns if c != "b"]), ["a_2", "b"])
    weights = lambda c: F.map_from_arrays(F.transform(c, lambda r: r["s"]), F.transform(c, lambda r: r["w"]))
    sharing = sharing.withColumns({"_x": weights("rest"), "_y": weights("rest_2")}).withColumn("_both", F.array_intersect(F.map_keys("_x"), F.map_keys("_y")))
    weight = F.aggregate("_both", F.lit(0.0), lambda total, k: total + F.least(F.element_at("_x", k), F.element_at("_y", k)))
    sharing = sharing.where(can(F.size("_both"), weight))

    placed = stored(rows.where("id <> center").select("bucket", F.col("id").alias("a"), F.col("center").alias("b"), "size").join(known.drop("rest"), ["a", "b"]))
    bucket = stored(placed.groupBy("bucket").agg(F.min("n").alias("n_2"), F.max("common").alias("common_2"), F.max("share").alias("share_2"), F.min("plain").alias("plain_2"), F.first("size").alias("size")))
    some = join_by_hot_key(placed.drop("size"), bucket.drop("size"), ["bucket"], ["a"], sizes=bucket.select("bucket", "size")).where(can(F.lit(0), F.lit(0.0)))
    some = stored(some.drop("n_2", "common_2", "share_2", "plain_2", "b"))
    light = join_by_hot_key(some, other(some), ["bucket"], ["a"], sizes=bucket.select("bucket", "size")).where(F.expr("a < a_2 AND group <> group_2") & can(F.lit(0), F.lit(0.0)))
    return sharing.select("a", F.col("a_2").alias("b")).union(light.select("a", F.col("a_2").alias("b")))


def _with_rank(shared: DataFrame, threshold: float) -> DataFrame:
    """``shared`` (a, b, s, w, size, ...) with early, late and heavy: whether s is among the first shingles of its text, of which a similar text must have one too.

    A text's shingles are put in one order for all members of a center: those that no other group has, then by number of members, then the center's. Two sets of which
    at least o are in common share one of the first ``n - o + 1`` of each. Of similar sets, o is at least ``2 t / (1 + t)`` of the smaller (``early``) and t of
    the larger (``late``). By weight, they share one of those before which no more than ``1 - t`` of the weight comes (``heavy``).
    A pair that meets in the center's shingles alone has no other ones in common or has them among the first as well.
    """
    whole = Window.partitionBy("a", "b")
    before = whole.orderBy("size", "s").rowsBetween(Window.unboundedPreceding, -1)
    alone = F.col("n") - F.col("common") - F.count(F.lit(1)).over(whole)
    place = alone + F.count(F.lit(1)).over(before)
    lighter = F.lit(1.0) - F.col("share") - F.sum("w").over(whole) + F.coalesce(F.sum("w").over(before), F.lit(0.0))
    first = lambda part: F.col("n") - F.ceil(F.col("n") * part - 1e-6) + 1
    x = shared.withColumn("_place", place).withColumn("_lighter", lighter)
    x = x.withColumn("early", F.col("_place") < first(2 * threshold / (1 + threshold))).withColumn("late", F.col("_place") < first(threshold))
    return x.withColumn("heavy", F.col("_lighter") <= 1 - threshold + 1e-6).drop("_place", "_lighter")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    both = tried.select("a", "b").union(tried.select("b", "a"))
    return pairs.distinct().join(both, ["a", "b"], "left_anti")
