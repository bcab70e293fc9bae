"""Exact Jaccard join on five-word shingles by parity sketches, and the components of its links.

A document is the set of its distinct shingles after A-Z are lower-cased; fewer words are one shingle. Two documents link when 100 times what they share is
at least 80 times what they have together, so at most a ninth of the sum of both sizes is in one of them alone (``apart``).

1. Equal word sequences are one node, named by a 128-bit digest, in which every copy meets.
2. Sizes from a power of two to the next are a band. In each band a set has a sketch of parity bits: a shingle flips one bit, so sketches differ in at most as many
   bits as sets have shingles apart. The sketch is wide and nearly empty; it is held as segments, :data:`SPREAD` for each size, and of a segment with
   bits the XOR of a random value of each bit. Sets with d shingles apart have at most d unlike segments (the pigeonhole principle). So of their segments with bits, put in
   one order for all sets, one of the first d + 1 is the same in both. Segments of frequent shingles come last in that order. Sets of the next
   band that may have a partner below take part there too.
3. The segments of a task's documents go, sorted and delta-coded, to shards of the key space; a key that many of them have goes there twice only, and the rest by itself.
   A shard answers with the keys that several nodes have: the buckets, or a pair where there are two.
4. Of buckets with the same nodes one is kept. Each bucket's node that is in most buckets is compared with the others; links make components. Where a bucket still has several
   components, its nodes are compared with each other, in large buckets block by block. Before sets are compared, dense sketches are: they may differ in no more bits than
   sets may be apart.
   Nothing is capped: every pair that shares a segment is linked, of one component, or known not to link.

* Null texts and texts without words have no shingles and link with nothing. Rows with a null id take part; the least id is that of rows that have one, and null if none has.
* Rows with one id and unlike texts are documents of their own. Equal rows link. Very long texts count whole.
* An empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import batch_map, drop_stored, join_by_hot_key, mixed, quoted, stored
from newsloom.llm.hashing import Keys, word_spans
from newsloom.llm.minhash import _compared, _groups, _runs_of_words, components

SHINGLE = 5
#: Percent of the union that two sets share at least if they link.
PERCENT = 80
#: Segments of a band's sketch for each shingle of its smallest sets.
SPREAD = 4
#: The most frequent shingles whose segments come last, at most so many, and how often one must be in a task's texts to be counted.
COMMON, OFTEN = 100_000, 8
#: Keys that a task gathers before it sends them, nodes of a key that it sends to the key's shard, keys of a shard, nodes of a block, nodes of a small bucket, and rows of a group of small buckets.
GATHERED, LOCAL, SHARD, BLOCK, SMALL, GROUP = 500_000, 32, 3_000_000, 512, 64, 20_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_BITS = (256, 8192)


def apart(a, b):
    """How many shingles two sets of these sizes that link may have in one of them alone, at most."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def words_of(text: str) -> bytes:
    """The words in lower case, joined by one space."""
    return b" ".join(w for w in text.encode().translate(_LOWER).translate(_SPACES).split(b" ") if w)


def shingle_sets(raws: list[bytes], keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of several texts, one text after another and sorted within each, and whose each is."""
    words, starts, _ = word_spans(b" ".join(raws), keys)
    edges = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)])).tolist()
    h, parts = _runs_of_words(words, SHINGLE, keys), []
    for a, b in zip(edges, edges[1:], strict=False):
        parts.append(np.sort(h[a : b - SHINGLE + 1]) if b - a >= SHINGLE else _runs_of_words(words[a:b], b - a, keys) if b > a else h[:0])
    tokens, owner = np.concatenate([h[:0], *parts]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], owner[new]


def _segments(tokens: np.ndarray, owner: np.ndarray, common: np.ndarray, band: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first ``most + 1`` segments of each set in its band, and whose they are."""
    width = (np.uint64(SPREAD) << band.astype(np.uint64))[owner]
    at = (tokens >> np.uint64(32)) * width >> np.uint64(32)  # grows with the hash, so a set's segments are in order
    first = np.ones(len(tokens), bool)
    first[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(first)
    value, whose = np.bitwise_xor.reduceat(mixed(tokens), first), owner[first]
    key = mixed(value + mixed(at[first] * np.uint64(64) + band[whose].astype(np.uint64)))
    last = np.logical_and.reduceat(common, first).astype(np.uint64)
    order = np.lexsort((key >> np.uint64(1) | last << np.uint64(63), whose))
    whose, key = whose[order], key[order]
    n = np.bincount(whose, minlength=len(band))
    taken = np.arange(len(key)) - (np.cumsum(n) - n)[whose] <= most[whose]
    return key[taken], whose[taken]


def segment_keys(tokens: np.ndarray, owner: np.ndarray, common: np.ndarray, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of several sets, and whose they are. ``common``: the frequent shingles, sorted.

    The first key that two sets share comes after at most d others in both, if one of them has over d segments with bits. With :data:`SPREAD` times as many segments
    as the smallest size nearly all sets have; those that don't also get one key of the band, by which they meet.
    """
    some = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens if len(common) else np.zeros(len(tokens), bool)
    n = np.bincount(owner, minlength=sets)
    band = np.maximum(np.frexp(n)[1] - 1, 0)
    own = apart(n, n * 100 // PERCENT)
    below = (1 << band) - 1
    two = (below > 0) & (100 * below >= PERCENT * n)
    found = []
    for chosen, place, most in ((n > 0, band, own), (two, band - 1, apart(n, below))):
        inside = chosen[owner]
        if inside.any():
            key, whose = _segments(tokens[inside], owner[inside], some[inside], np.maximum(place, 0), most)
            short = np.flatnonzero(chosen & (np.bincount(whose, minlength=sets) <= most))
            found += [(key, whose), (mixed(place[short].astype(np.uint64) + np.uint64(1)), short)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (tokens[:0], owner[:0])


def dense_sketch(tokens: np.ndarray) -> bytes:
    """Parity bits of a set, two to four for each shingle; folding it in two gives the sketch of half the size."""
    bits = min(max(_BITS[0], 4 << max(len(tokens).bit_length() - 1, 0)), _BITS[1])
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _planes(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _sent(shard: int, key: np.ndarray, who: np.ndarray, nodes: np.ndarray) -> dict:
    used, at = np.unique(who, return_inverse=True)
    return {"shard": [shard], "keys": [_planes(np.diff(key, prepend=np.uint64(0)))], "who": [_planes(at.astype(np.uint32))], "nodes": [nodes[used].tobytes()]}


_SENT = "shard int, keys binary, who binary, nodes binary"


def _to_shards(key: np.ndarray, who: np.ndarray, nodes: np.ndarray, shards: int) -> Iterator[dict]:
    """The keys of a task's nodes for the keys' shards. Of a key that more than :data:`LOCAL` of these nodes have, two go there, and all to a shard below 0."""
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    edges = np.flatnonzero(np.append(np.concatenate([[True], key[1:] != key[:-1]]), True))
    size = np.repeat(np.diff(edges), np.diff(edges))
    place = np.arange(len(key)) - np.repeat(edges[:-1], np.diff(edges))
    many = size > LOCAL
    if many.any():
        yield _sent(-1 - int(key[0] % np.uint64(shards)), key[many], who[many], nodes)
    key, who = key[~many | (place < 2)], who[~many | (place < 2)]
    shard = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
        yield _sent(int(shard[a]), key[a:b], who[a:b], nodes)


def _text_batches(batches: Iterator[pa.RecordBatch], keys: Keys) -> Iterator[tuple]:
    """Groups of texts: ids, digests and shingles."""
    for batch in batches:
        rows = dict(zip(("id", "text"), batch.columns, strict=True))
        ids, at = rows["id"].to_pylist(), 0
        for group in _groups(rows["text"].to_pylist()):
            raws = [words_of(t) for t in group]
            yield ids[at : at + len(raws)], [blake2b(r, digest_size=16).digest() for r in raws], raws, *shingle_sets(raws, keys)
            at += len(raws)


def _buckets(docs: DataFrame, common: np.ndarray, shards: int, keys: Keys) -> DataFrame:
    """key and node, for the keys that several nodes have; and where two nodes have a key and no others do, node and ``other`` without a key."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, known, size = [], [], {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            key, who = (np.concatenate(x) for x in zip(*held, strict=True))
            for row in _to_shards(key, who, np.array(nodes, "V16"), shards):
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("who", pa.binary()), ("nodes", pa.binary())]))

        for _, digests, raws, tokens, owner in _text_batches(batches, keys):
            key, whose = segment_keys(tokens, owner, common, len(raws))
            place, fresh = np.zeros(len(raws), np.int64), np.zeros(len(raws), bool)
            for k, d in enumerate(digests):
                fresh[k] = d not in known
                place[k] = known.setdefault(d, len(known))
                if fresh[k]:
                    nodes.append(d)
            mine = fresh[whose]
            held.append((key[mine], place[whose[mine]]))
            size += int(mine.sum())
            if size > GATHERED:
                yield from out()
                held, nodes, known, size = [], [], {}, 0
        if size:
            yield from out()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        key, who, base, nodes = [], [], 0, []
        for k, w, n in zip(rows["keys"], rows["who"], rows["nodes"], strict=True):
            key.append(np.cumsum(_unplanes(k, np.uint64), dtype=np.uint64))
            who.append(_unplanes(w, np.uint32).astype(np.int64) + base)
            nodes.append(np.frombuffer(n, "V16"))
            base += len(nodes[-1])
        key, (distinct, same) = np.concatenate(key), np.unique(np.concatenate(nodes).view([("a", ">u8"), ("b", ">u8")]), return_inverse=True)
        who = same[np.concatenate(who)]
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        key, who = key[new], who[new]
        edges = np.flatnonzero(np.append(np.concatenate([[True], key[1:] != key[:-1]]), True))
        size = np.repeat(np.diff(edges), np.diff(edges))
        two = np.flatnonzero((size == 2) & (rows["shard"].iloc[0] >= 0))[::2]
        pairs = np.unique(np.stack([who[two], who[two + 1]], 1), axis=0)
        more = size > (2 if rows["shard"].iloc[0] >= 0 else 1)
        names = [x.tobytes() for x in distinct]
        node = [names[k] for k in who[more]] + [names[k] for k in pairs[:, 0]]
        other = [None] * int(more.sum()) + [names[k] for k in pairs[:, 1]]
        keyed = pd.array(np.concatenate([key[more].view(np.int64), np.zeros(len(pairs), np.int64)]), dtype="Int64")
        keyed[int(more.sum()) :] = pd.NA
        return pd.DataFrame({"key": keyed, "node": pd.Series(node, dtype=object), "other": pd.Series(other, dtype=object)})

    return docs.mapInArrow(send, _SENT).groupBy("shard").applyInPandas(meet, "key long, node binary, other binary").distinct()


def _summaries(docs: DataFrame, keys: Keys) -> DataFrame:
    """id, node and n of each text (node null without words), and shingle and times of those that are frequent in a task."""
    schema = pa.schema([("id", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("shingle", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counts() -> pa.RecordBatch:
            shingle, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= OFTEN
            return pa.RecordBatch.from_arrays([*(pa.nulls(int(often.sum()), schema.field(k).type) for k in range(3)), pa.array(shingle[often].view(np.int64)), pa.array(times[often])], schema=schema)

        for ids, digests, raws, tokens, owner in _text_batches(batches, keys):
            n = np.bincount(owner, minlength=len(raws))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([d if k else None for d, k in zip(digests, n, strict=True)], pa.binary()), pa.array(n), *(pa.nulls(len(ids), pa.int64()) for _ in range(2))], schema=schema)
            held.append(tokens)
            size += len(tokens)
            if size > 2 * GATHERED:
                yield counts()
                held, size = [], 0
        if size:
            yield counts()

    return docs.mapInArrow(run, "id long, node binary, n long, shingle long, times long")


def _packed(docs: DataFrame) -> DataFrame:
    """id (the node) and the words compressed, of texts with words."""

    def run(batch: pa.RecordBatch) -> dict:
        pack, raws = zstandard.ZstdCompressor(level=1), [words_of(t) for t in batch.column("text").to_pylist()]
        raws = [r for r in raws if r]
        return {"id": [blake2b(r, digest_size=16).digest() for r in raws], "packed": [pack.compress(r) for r in raws]}

    return batch_map(docs, ["text"], run, "id binary, packed binary")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs of nodes (a, b) that link."""

    def judge(x: tuple, y: tuple) -> tuple | None:
        shared = len(np.intersect1d(x[0], y[0], assume_unique=True))
        return () if 100 * shared >= PERCENT * (len(x[0]) + len(y[0]) - shared) else None

    # texts are large and pairs few, so texts are shuffled once, at every size, and only those of the pairs go on
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    some = stored(texts.join(ids.hint("merge"), "id", "left_semi"))
    return _compared(pairs, some, judge, "a binary, b binary")


def _in_order(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _near(x: str, y: str) -> Column:
    """Whether sizes are near enough for a link."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _distinct_buckets(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node, n and the bucket's size; of buckets with the same nodes one is kept, told by 128 bits."""
    hashed = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)])
    kept = stored(hashed.groupBy("size", "x0", "x1").agg(F.min("key").alias("key")).select("key", "size"))
    return stored(join_by_hot_key(shared, kept, ["key"], ["node"], sizes=kept).join(nodes.select("node", "n"), "node"))


def _with_centers(rows: DataFrame) -> DataFrame:
    """Pairs of a node and its bucket's node that is in most buckets."""
    weighed = stored(rows.join(rows.groupBy("node").agg(F.count(F.lit(1)).alias("weight")), "node"))
    centers = stored(weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("top"), F.first("size").alias("size")))
    found = join_by_hot_key(weighed.select("key", "node", "n"), centers.select("key", F.col("top.node").alias("center"), F.col("top.n").alias("m")), ["key"], ["node"], sizes=centers.select("key", "size"))
    return found.where((F.col("node") != F.col("center")) & _near("n", "m")).select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()


def _open(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """``rows`` with comp, of the keys whose nodes are of several components."""
    if label is not None:
        rows = rows.join(label, "node", "left")
    rows = stored(rows.select("key", "node", "n", F.coalesce("label", "node").alias("comp") if label is not None else F.col("node").alias("comp")))
    sizes = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi AND size > 2").select("key", "size")
    sizes = stored(sizes)
    return stored(join_by_hot_key(rows, sizes, ["key"], ["node"], sizes=sizes))


def _sketches(texts: DataFrame, keys: Keys) -> DataFrame:
    """id (the node), n and the dense sketch."""

    def run(batch: pa.RecordBatch) -> dict:
        unpack, n, sketches = zstandard.ZstdDecompressor(), [], []
        for group in _groups([unpack.decompress(p.as_py()).decode() for p in batch.column("packed")]):
            tokens, owner = shingle_sets([t.encode() for t in group], keys)
            for own in np.split(tokens, np.searchsorted(owner, np.arange(1, len(group)))):
                n.append(len(own))
                sketches.append(dense_sketch(own))
        return {"id": batch.column("id"), "n": n, "sketch": sketches}

    return batch_map(texts, ["id", "packed"], run, "id binary, n long, sketch binary")


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes are near enough and whose dense sketches differ in no more bits than their sets may be apart. b may be hot."""
    own = lambda side: sketches.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    sizes = stored(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size")))
    both = join_by_hot_key(pairs.join(own("a"), "a"), own("b").join(sizes.select("b"), "b"), ["b"], ["a"], sizes=sizes)

    def run(batch: pa.RecordBatch) -> dict:
        kept = []
        for k, (x, y, n, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("s_a", "s_b", "n_a", "n_b")), strict=True)):
            x, y = _same_width([x, y])
            if 100 * min(n, m) >= PERCENT * max(n, m) and np.bitwise_count(x ^ y).sum() <= apart(n, m):
                kept.append(k)
        found = batch.take(pa.array(kept, pa.int32()))
        return {"a": found.column("a"), "b": found.column("b")}

    return stored(batch_map(both, ["a", "b", "n_a", "n_b", "s_a", "s_b"], run, "a binary, b binary"))


def _bucket_pairs(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of different components that share a bucket and whose dense sketches differ in no more bits than their sets may be apart.

    A large bucket is compared block by block; many small ones make one group of rows. A pair of large buckets is taken in its first one only.
    """
    large = rows.where(F.col("size") > SMALL).groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("mine"))  # at most the keys of one set
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    group = F.when(F.col("size") > SMALL, F.xxhash64("key", "lo", "hi")).otherwise(F.pmod(F.xxhash64("key"), F.lit(rows.count() // GROUP + 1)))
    members = placed.select(group.alias("g"), "key", "size", "lo", "hi", "block", "node", "n", "comp")
    members = members.join(sketches.select(F.col("id").alias("node"), "sketch"), "node").join(large, "node", "left")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        columns = [part[c].to_numpy() for c in ("key", "lo", "hi")]
        order = np.lexsort(columns[::-1])
        key, lo, hi = (c[order] for c in columns)
        new = (np.diff(key, prepend=key[0]) != 0) | (np.diff(lo, prepend=lo[0]) != 0) | (np.diff(hi, prepend=hi[0]) != 0)
        edges = [0, *np.flatnonzero(new).tolist(), len(order)]
        n, size, block, comp = (part[c].to_numpy()[order] for c in ("n", "size", "block", "comp"))
        comp = pd.factorize(comp)[0]
        (nodes, sketch, mine), found = (part[c].to_numpy()[order] for c in ("node", "sketch", "mine")), []
        for a, b in zip(edges, edges[1:], strict=False):
            if comp[a] == comp[b - 1] and (comp[a:b] == comp[a]).all():
                continue
            bits = np.stack(_same_width(sketch[a:b]))
            right = np.flatnonzero(block[a:b] == hi[a])
            for i in np.flatnonzero(block[a:b] == lo[a]):
                j = right[right > i] if lo[a] == hi[a] else right
                j = j[(comp[a + j] != comp[a + i]) & (100 * np.minimum(n[a + j], n[a + i]) >= PERCENT * np.maximum(n[a + j], n[a + i]))]
                if len(j):
                    j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(1) <= apart(n[a + i], n[a + j])]
                if len(j) and size[a] > SMALL:
                    j = [k for k in j if np.intersect1d(mine[a + i], mine[a + k], assume_unique=True)[0] == key[a]]
                found += [(min(nodes[a + i], nodes[a + k]), max(nodes[a + i], nodes[a + k])) for k in j]
        return pd.DataFrame(found, columns=["a", "b"])

    return members.groupBy("g").applyInPandas(compare, "a binary, b binary").distinct()


def _same_width(sketches: list[bytes]) -> list[np.ndarray]:
    """Sketches as words, folded to the narrowest one's width."""
    width = min(map(len, sketches))
    return [_folded(np.frombuffer(s, np.uint8), width).view(np.uint64) for s in sketches]


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def shingle_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles and component_id, the least id that links reach, for each row of ``docs``."""
    keys = Keys.drawn()
    named = docs.select(F.col(quoted(id_column)).cast("long").alias("id"), F.col(quoted(text)).alias("text"))
    whole = named.where("text IS NOT NULL")
    seen = stored(_summaries(whole, keys))
    often = seen.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(COMMON)
    common = np.sort(np.array([r["shingle"] for r in often.select("shingle").toLocalIterator()], np.int64).view(np.uint64))
    rows = seen.where("shingle IS NULL").select("id", "node", "n")
    nodes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    spark = docs.sparkSession
    total = nodes.agg(F.sum("n")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * SHARD))
    met = stored(_buckets(whole, common, shards, keys))
    twos = met.where("key IS NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    rows_of = _distinct_buckets(met.where("key IS NOT NULL").select("key", "node"), nodes)
    tried = stored(_with_centers(rows_of).union(twos).distinct())
    wanted = rows_of.select("node").union(twos.select("a")).union(twos.select("b")).distinct()
    texts = _packed(whole).join(wanted.select(F.col("node").alias("id")).hint("merge"), "id", "left_semi")
    texts = stored(texts.dropDuplicates(["id"]))
    sketches = stored(_sketches(texts, keys))
    links = _links(_plausible(tried, sketches), texts)
    label = None if links.isEmpty() else components(links)
    left = _open(rows_of, label)
    before = tried.select(*_in_order(F.col("a"), F.col("b")))
    more = stored(_bucket_pairs(left, sketches).join(before, ["a", "b"], "left_anti"))
    found = _links(more, texts)
    if not found.isEmpty():
        links = links.union(found)
        label = components(links)
    own = F.col("node")
    if label is not None:
        nodes = nodes.join(label, "node", "left")
        own = F.coalesce("label", "node")
    classes = nodes.withColumn("comp", own)
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    least = stored(least)
    by_node = join_by_hot_key(classes.select("node", "comp", "copies"), least.drop("size"), ["comp"], ["node"], sizes=least.select("comp", "size"))
    by_node = stored(by_node.select("node", "component_id", "copies"))
    out = join_by_hot_key(rows.where("node IS NOT NULL"), by_node.drop("copies"), ["node"], ["id"], sizes=by_node.where("copies > 1").select("node", F.col("copies").alias("size")))
    alone = rows.where("node IS NULL").select("id", "n").union(named.where("text IS NULL").select("id", F.lit(0).cast("long")))
    out = out.select("id", "n", "component_id").union(alone.select("id", "n", F.col("id")))
    return out.toDF(id_column, "n_shingles", "component_id")
