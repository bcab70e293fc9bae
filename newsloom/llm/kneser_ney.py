"""Quality classifier: perplexity of words under an interpolated modified Kneser-Ney model of trusted text.

A word is a run of bytes other than white space. An n-gram of up to :data:`ORDER` words goes by a 64-bit key, so unlike n-grams of one key
are taken for one; at ``n`` n-grams a key of another is met with a chance of ``n / 2 ** 62``. Nothing of the model is collected but the counts
of counts, so it grows with the text, on all executors.

* Documents lie in chunks of about :data:`CHUNK` bytes: a chunk is one row with the hashes of its words and the order they come in, packed.
* Each order of n-grams, the highest first, is counted and asked for in one exchange: a chunk sends each of its distinct n-grams once, whatever their frequency, with
  its own trusted count, cell by cell of the key space; a cell adds up, and sends each chunk the sums in the order of its keys, without the keys. So no
  n-gram has more rows than there are chunks, and what a task holds at once is one chunk or one cell.
* Lower orders count how many different words stand before an n-gram: the sums mark one chunk as an n-gram's owner, and owners send the next order's counts,
  with what the n-gram adds to its context.
* Only a share of the keys (one of :data:`SLICES`), or of the chunks (one of :data:`TURNS`), is shuffled at a time, and its shuffle files go when it is done. On disk are the chunks, the sums and one share.
* A trusted document is scored by the counts without its own: otherwise it would always seem well known. That is exact but for the discounts and the size of the vocabulary.

Thresholds come from the trusted documents, each scored without its own counts. A document is kept if its perplexity
is between the lower and the upper quantile of theirs in its language, all after an allowance that shrinks with the root of the
number of words. Text that is far too easy to tell, such as one word over and over, is no better than noise. Quantiles come from a
mergeable sketch. A language with under :data:`MIN_TRUSTED` trusted documents, or a null one, has the quantiles of all.

* Null text, or one without any word: perplexity null, not kept.
* Without trusted text nothing can be told apart: thresholds are null, and documents with text are kept.
* Very long texts are scored whole, and are a chunk of their own. Repeated rows count as often as they occur. An empty table gives an empty table.
* Extra columns don't matter; only id, text, language and the trusted ids are read. A null id is never trusted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom.llm.common import batch_map, drop_stored, join_by_hot_key, mixed, quoted, stored, stored_parts, tidy_shuffles
from newsloom.llm.hashing import word_spans

ORDER = 2
QUANTILE = 0.995
#: Bytes of text in a chunk, and words whose n-grams are a cell's.
CHUNK, CELL = 10 << 20, 1_000_000
#: Texts are read in so many shares when they meet the trusted ids, n-grams are counted in so many, and chunks meet their answers in so many.
READS, SLICES, TURNS = 2, 4, 8
#: Words whose probabilities are worked out together.
BLOCK = 1 << 18
#: Chunks of a task are numbered by steps of this.
_BITS = 40
_NEXT = 1 << _BITS
#: So many trusted documents a language needs for quantiles of its own.
MIN_TRUSTED = 100
#: Short texts vary more: logarithms of perplexities may be off by this over the root of the number of words.
ALLOWANCE = 5.0
#: Thresholds of so many languages are broadcast; if there are more, they are joined.
MAX_LANGUAGES = 1000
#: The word before a text, and by how many bits the key of an n-gram is turned before the next word is added.
_START, _TURN = np.uint64(1), 21


def gram_keys(words: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys of the n-grams of 1 to ``order`` words that end at each word, and of 1 to ``order - 1`` that end before it."""
    n, keys = len(words) - order + 1, [words]
    for k in range(1, order):
        last = keys[-1][:-1]
        keys.append((last << np.uint64(_TURN) | last >> np.uint64(64 - _TURN)) ^ words[k:])
    return [k[len(k) - n :] for k in keys], [k[len(k) - n - 1 : len(k) - 1] for k in keys[:-1]]


def packed(values: np.ndarray) -> bytes:
    """The bytes of ``values``, first ones first, which compresses small numbers well."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    found = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(found.T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """The same for ascending keys, by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


def runs(ascending: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts."""
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.flatnonzero(new)


def distinct(keys: np.ndarray) -> np.ndarray:
    """``np.unique``, which is slower on 64-bit keys."""
    keys = np.sort(keys)
    return keys[runs(keys)]


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct value, ascending by value; the number of each value among these; how often each occurs."""
    order = np.argsort(values, kind="stable")
    starts = runs(values[order])
    times = np.diff(starts, append=len(values))
    which = np.empty(len(values), np.int64)
    which[order] = np.repeat(np.arange(len(starts)), times)
    return order[starts], which, times


def cell_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """Cells are ranges of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)


_CHUNK = "chunk long, n long, ids array<long>, langs array<string>, trained array<boolean>, sizes array<long>, words binary, often binary, codes binary"


def _packed_chunk(chunk: int, docs: list[tuple]) -> dict:
    found = [word_spans(raw)[0] for *_, raw in docs]
    hashes = mixed(np.concatenate(found))
    first, which, often = groups(hashes)
    rank = np.empty(len(often), np.uint32)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often), dtype=np.uint32)
    ids, langs, trained, _ = zip(*docs, strict=True)
    packs = {"words": packed_keys(hashes[first]), "often": packed(often.astype(np.uint32)), "codes": packed(rank[which])}
    return {"chunk": chunk, "n": len(hashes), "ids": ids, "langs": langs, "trained": trained, "sizes": [len(f) for f in found]} | packs


class Chunk:
    """Keys of the n-grams that end at each word of a row of :func:`chunks`, and of those that end before it."""

    def __init__(self, row: dict, order: int):
        self.chunk, self.ids, self.langs, self.sizes = row["chunk"], row["ids"], row["langs"], np.array(row["sizes"], np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.trained = np.array(row["trained"], bool)[self.doc]
        often = unpacked(row["often"], np.uint32).astype(np.int64)
        words = unpacked_keys(row["words"])[np.argsort(-often, kind="stable")][unpacked(row["codes"], np.uint32)]
        at = np.arange(len(words)) + self.doc * (order - 1)  # before each text are ``order - 1`` marks of its start
        given = np.full(len(words) + len(self.sizes) * (order - 1), _START)
        given[at + order - 1] = words
        self.grams, self.contexts = ([k[at] for k in keys] for keys in gram_keys(given, order))

    def asked(self, order: int) -> np.ndarray:
        """Ascending keys of the n-grams of ``order`` words whose sums the chunk needs."""
        keys = self.grams[order - 1]
        return distinct(np.concatenate([keys, self.contexts[order - 1]]) if order <= len(self.contexts) else keys)


_NOTHING = np.zeros(0, np.uint64), np.zeros((5, 0), np.int64)
_ASKED = "chunk long, cell long, keys binary, own binary"
_SUMS = ["n1", "n2", "n3", "n4", "types", "total"]
_ANSWER = "chunk long, cell long, sums binary, owned binary, " + ", ".join(f"{c} long" for c in _SUMS)


def _cells(chunk: int, keys: np.ndarray, own: np.ndarray, cells: int) -> pa.Table:
    """Rows for the cells of ascending ``keys``; ``own`` has a row for each kind of count."""
    cell = cell_of(keys, cells)
    starts = runs(cell)
    spans = list(zip(starts, np.append(starts, len(keys))[1:], strict=True))
    found = [cell[starts].astype(np.int64), [packed_keys(keys[a:b]) for a, b in spans], [packed(np.ascontiguousarray(own[:, a:b]).reshape(-1)) for a, b in spans]]
    return pa.table([pa.array([chunk] * len(spans), pa.int64()), pa.array(found[0], pa.int64()), *[pa.array(f, pa.binary()) for f in found[1:]]], names=["chunk", "cell", "keys", "own"])


def _ask_highest(texts: DataFrame, order: int, cells: int, turn: int) -> DataFrame:
    """Rows to be asked of the cells of a share of the key space: the chunks' n-grams of ``order`` words and their trusted counts."""
    share = cells // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, order)
                keys = chunk.grams[-1]
                inside = cell_of(keys, cells) // np.uint64(share) == turn
                keys, own = distinct(keys[inside]), np.sort(keys[inside & chunk.trained])
                starts, counts = runs(own), np.zeros(len(keys), np.int64)
                counts[np.searchsorted(keys, own[starts])] = np.diff(starts, append=len(own))
                yield from _cells(chunk.chunk, keys, counts[None], cells).to_batches()

    return texts.mapInArrow(run, _ASKED)


def _ask_lower(order: int, k: int, cells: int) -> Callable:
    """Makes the rows to be asked for n-grams of ``k`` words from a chunk and the answers to those of ``k + 1``."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = [_cells(0, *_NOTHING, cells)]
        for row in rows.to_pylist():
            chunk = Chunk(row, order)
            above, keys = chunk.asked(k + 1), chunk.asked(k)
            sums, owned = _aligned(answers, len(above), 1 if k + 1 == order else 5)
            at = groups(chunk.grams[k])[0]
            place = np.searchsorted(above, chunk.grams[k][at])
            at, n = at[owned[place]], sums[0][place][owned[place]]
            gram, context = (np.searchsorted(keys, of[k - 1][at]) for of in (chunk.grams, chunk.contexts))
            own = [np.bincount(gram, minlength=len(keys)), *[np.bincount(context, w, len(keys)) for w in (n, n == 1, n == 2, n > 2)]]
            out.append(_cells(chunk.chunk, keys, np.array(own).astype(np.int64), cells))
        return pa.concat_tables(out)

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """The sums of a cell, for each chunk in the order of its keys; owned: whether a chunk is the one that counts an n-gram for the order below."""
    keys = [unpacked_keys(k) for k in rows.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    own = np.concatenate([unpacked(o, np.int64).reshape(-1, n) for o, n in zip(rows.column("own").to_pylist(), sizes, strict=True)], axis=1)
    keys = np.concatenate(keys)
    counted = np.flatnonzero(own.any(axis=0))
    counted = counted[np.argsort(keys[counted], kind="stable")]
    starts = runs(keys[counted])
    known = keys[counted[starts]]
    sums = np.add.reduceat(own[:, counted], starts, axis=1) if len(starts) else np.zeros((len(own), 0), np.int64)
    seen = counted[own[0, counted] > 0]
    owned = np.zeros(len(keys), bool)
    owned[seen[runs(keys[seen])]] = True
    place = np.searchsorted(known, keys)
    sums = np.concatenate([sums, np.zeros((len(own), 1), np.int64)], axis=1)  # of keys that are unknown
    place[np.append(known, np.uint64(0))[place] != keys] = len(known)
    n = sums[0][sums[0] > 0]
    whole = [*[int((n == k).sum()) for k in range(1, 5)], len(n), int(n.sum())]
    ends = np.cumsum(sizes)
    spans = list(zip(ends - sizes, ends, strict=True))
    found = [[packed(np.ascontiguousarray(sums[:, place[a:b]]).reshape(-1)) for a, b in spans], [np.packbits(owned[a:b]).tobytes() for a, b in spans]]
    columns = [rows.column("chunk"), rows.column("cell"), *[pa.array(f, pa.binary()) for f in found], *[pa.array([x] + [0] * (len(spans) - 1), pa.int64()) for x in whole]]
    return pa.table(columns, names=["chunk", "cell", "sums", "owned", *_SUMS])


def _aligned(answers: pa.Table, size: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (a row for each kind of count) and owned of all ``size`` keys that a chunk asked for, from its cells in turn."""
    rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("cell", "sums", "owned")), strict=True), key=lambda r: r[0])
    sums = [np.zeros((kinds, 0), np.int64), *[unpacked(s, np.int64).reshape(kinds, -1) for _, s, _ in rows]]
    owned = [np.unpackbits(np.frombuffer(o, np.uint8), count=s.shape[1]).astype(bool) for (_, _, o), s in zip(rows, sums[1:], strict=True)]
    sums = np.concatenate(sums, axis=1)
    if sums.shape[1] != size:
        raise ValueError(f"{sums.shape[1]} answers to {size} n-grams")
    return sums, np.concatenate([np.zeros(0, bool), *owned])


def chunks(docs: DataFrame, trained: DataFrame, id_column: str, text: str, language: str) -> DataFrame:
    """Rows of a chunk each: ids, languages and sizes of its documents that have a text, and their words; ``trained`` has the distinct ids to train on."""
    most, kind = CHUNK, T._parse_datatype_string(_CHUNK)

    def pack(batch: pa.RecordBatch) -> dict:
        z = zstandard.ZstdCompressor(level=3)
        return {"id": batch.column("id"), "lang": batch.column("lang"), "packed": [z.compress(t.encode()) for t in batch.column("text").to_pylist()]}

    def number(turn: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk, held, size, unpack, arrow = TaskContext.get().partitionId() * (READS + 1) + turn, [], 0, zstandard.ZstdDecompressor(), to_arrow_schema(kind)
            for batch in batches:
                for *doc, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "lang", "trained")), map(unpack.decompress, batch.column("packed").to_pylist()), strict=True):
                    if held and size + len(raw) > most:
                        yield pa.RecordBatch.from_pylist([_packed_chunk(chunk, held)], schema=arrow)
                        chunk, held, size = chunk + _NEXT, [], 0
                    held.append((*doc, raw))
                    size += len(raw)
            if held:
                yield pa.RecordBatch.from_pylist([_packed_chunk(chunk, held)], schema=arrow)

        return run

    columns = [F.col(quoted(id_column)).cast("long").alias("id"), F.col(quoted(language)).cast("string").alias("lang"), F.col(quoted(text)).alias("text")]
    given = docs.where(F.col(quoted(text)).isNotNull())
    texts = lambda rows: batch_map(rows, columns, pack, "id long, lang string, packed binary")
    turn_of = lambda c: F.pmod(F.xxhash64(c), F.lit(READS))
    shares = []
    for turn in range(READS):  # a share at a time is shuffled; a null id is in none
        own = trained.withColumn("trained", F.lit(True)).where(turn_of(F.col("id")) == turn)
        known = texts(given.where(turn_of(F.col(quoted(id_column)).cast("long")) == turn).where(F.col(quoted(id_column)).cast("long").isNotNull())).hint("merge").join(own, "id", "left")
        shares.append(known.select("id", "lang", F.coalesce("trained", F.lit(False)).alias("trained"), "packed").mapInArrow(number(turn), kind))
    # ids that are null match nothing and would all go to one task
    unknown = texts(given.where(F.col(quoted(id_column)).cast("long").isNull())).select("id", "lang", F.lit(False).alias("trained"), "packed")
    shares.append(unknown.mapInArrow(number(READS), kind))
    with tidy_shuffles(docs.sparkSession):
        return stored_parts(shares)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken from counts of 0, 1, 2, and 3 or more, from how many n-grams have a count of 1 to 4."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.concatenate([[0], np.clip(d, [0.05, 0.1, 0.1], [0.95, 1.9, 2.9])])


def _answers(asked: Iterable[DataFrame]) -> DataFrame:
    """What the cells answer, a share of the key space at a time."""
    return stored_parts(rows.groupBy("cell").applyInArrow(_answer, _ANSWER) for rows in asked)


def _in_turn(rows: DataFrame, turn: int) -> DataFrame:
    """A share of the chunks."""
    return rows.where(F.pmod(F.col("chunk") % _NEXT + F.shiftright("chunk", _BITS), F.lit(TURNS)) == turn)


def train(texts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[np.ndarray], dict]:
    """The answers to the chunks for each order, lowest first; the discounts of each order; sums of the lowest."""
    words = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(1, -(-words // (CELL * SLICES)))
    cells = share * SLICES
    answers = [_answers(_ask_highest(texts, order, cells, turn) for turn in range(SLICES))]
    for k in range(order - 1, 0, -1):
        asked = stored_parts(_met(texts, answers[0], turn).applyInArrow(_ask_lower(order, k, cells), _ASKED) for turn in range(TURNS))
        answers.insert(0, _answers(asked.where((F.col("cell") >= turn * share) & (F.col("cell") < (turn + 1) * share)) for turn in range(SLICES)))
        drop_stored(asked)
    sums = [a.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS]).first() for a in answers]
    taken = [discounts(*(s[f"n{k}"] for k in range(1, 5))) for s in sums]
    low, d = sums[0], taken[0]
    more = low["types"] - low["n1"] - low["n2"]
    return answers, taken, {"types": low["types"], "total": low["total"], "back": float(d[1] * low["n1"] + d[2] * low["n2"] + d[3] * more)}


def _met(texts: DataFrame, answers: DataFrame, turn: int) -> PandasCogroupedOps:
    """Chunks of a share with their answers."""
    return _in_turn(texts, turn).groupBy("chunk").cogroup(_in_turn(answers, turn).groupBy("chunk"))


def chunk_perplexities(chunk: Chunk, sums: list[np.ndarray], taken: list[np.ndarray], low: dict) -> np.ndarray:
    """Perplexity (a word) of each text of a chunk, from the sums of its n-grams of each order; the counts of a text that was trained on are taken off first."""
    keys = [chunk.asked(k) for k in range(1, len(taken) + 1)]
    ends = np.cumsum(chunk.sizes)
    starts, out = runs(ends // BLOCK), []  # of blocks of texts
    for a, b in zip(starts, np.append(starts, len(ends))[1:], strict=True):
        out.append(_block(chunk, slice(a, b), slice(ends[a] - chunk.sizes[a], ends[b - 1]), keys, sums, taken, low))
    return np.concatenate(out)


def _block(chunk: Chunk, texts: slice, words: slice, keys: list[np.ndarray], sums: list[np.ndarray], taken: list[np.ndarray], low: dict) -> np.ndarray:
    """The same for some of its texts."""
    doc, sizes, trained = chunk.doc[words] - texts.start, chunk.sizes[texts], chunk.trained[words]
    off = lambda k, n: taken[k][np.minimum(n, 3)]
    levels, own_next = [], None
    for k in range(len(taken) - 1, -1, -1):
        at = np.searchsorted(keys[k], chunk.grams[k][words])
        first, which, times = groups(doc * len(keys[k]) + at)  # distinct n-grams of each text
        n = sums[k][0][at[first]]
        own = np.where(trained[first], times if own_next is None else np.bincount(which[own_next], minlength=len(first)), 0)
        less = np.maximum(n - own, 0)
        freed = off(k, n) - off(k, less)
        if k:
            at = np.searchsorted(keys[k - 1], chunk.contexts[k - 1][words])
            place, of, _ = groups(doc * len(keys[k - 1]) + at)
            _, total, *kinds = (s[at[place]] for s in sums[k - 1])
            total = total - np.bincount(of[first], own, len(place))
            back = (np.dot(taken[k][1:], kinds) - np.bincount(of[first], freed, len(place)))[of]
            total = total[of]
        else:
            total, back = ((low[c] - np.bincount(doc[first], x, len(sizes)))[doc] for c, x in (("total", own), ("back", freed)))
        levels.append(((less - off(k, less))[which], total, back))
        own_next = first[(own > 0) & (less == 0)]
    p = np.full(len(doc), 1.0 / (low["types"] + 1))
    for seen, total, back in reversed(levels):
        p = np.where(total > 0, (seen + np.maximum(back, 0) * p) / np.maximum(total, 1), p)
    return np.exp(-np.bincount(doc, np.log(p), len(sizes)) / np.maximum(sizes, 1))


_SCORED = "id long, lang string, n_words long, perplexity double"


def perplexities(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """id, lang, n_words and perplexity of each document of :func:`chunks`, by a model of those to train on."""
    schema = to_arrow_schema(T._parse_datatype_string(_SCORED))
    with tidy_shuffles(texts.sparkSession):
        answers, taken, low = train(texts, order)

        def score(rows: pa.Table, found: pa.Table) -> pa.Table:
            out, level = [schema.empty_table()], found.column("level").to_numpy()
            for row in rows.to_pylist():
                chunk = Chunk(row, order)
                sums = [_aligned(found.filter(pa.array(level == k)), len(chunk.asked(k)), 1 if k == order else 5)[0] for k in range(1, order + 1)]
                p = pa.array(chunk_perplexities(chunk, sums, taken, low), mask=chunk.sizes == 0)
                out.append(pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.langs, pa.string()), pa.array(chunk.sizes), p], schema=schema))
            return pa.concat_tables(out)

        every = None
        for k, a in enumerate(answers, 1):
            rows = a.select(F.lit(k).alias("level"), "chunk", "cell", "sums", "owned")
            every = rows if every is None else every.unionByName(rows)
        scored = stored_parts(_met(texts, every, turn).applyInArrow(score, _SCORED) for turn in range(TURNS))
    for a in answers:
        drop_stored(a)
    return scored


def classify(docs: DataFrame, trusted_ids: DataFrame, id_column: str = "doc_id", text: str = "text", language: str = "lang", quantile: float = QUANTILE, order: int = ORDER) -> DataFrame:
    """id, perplexity, least, threshold and kept of each row; ``trusted_ids`` has the ids of trusted documents."""
    ids = trusted_ids.select(F.col(id_column).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    texts = chunks(docs, ids, id_column, text, language)
    scored = perplexities(texts, order)
    drop_stored(texts)
    without = docs.where(F.col(quoted(text)).isNull()).select(F.col(quoted(id_column)).cast("long").alias("id"), F.col(quoted(language)).cast("string").alias("lang"))
    scored = stored(scored.unionByName(without.selectExpr("id", "lang", "0L AS n_words", "CAST(NULL AS DOUBLE) AS perplexity")))
    known = scored.where("perplexity IS NOT NULL").join(ids, "id", "left_semi")
    room = F.exp(F.lit(ALLOWANCE) / F.sqrt(F.greatest("n_words", F.lit(1))))
    bounds = (F.percentile_approx(F.col("perplexity") * room, F.lit(1 - quantile), F.lit(10_000)), F.percentile_approx(F.col("perplexity") / room, F.lit(quantile), F.lit(10_000)))
    named = lambda lo, hi: [b.alias(n) for b, n in zip(bounds, (lo, hi), strict=True)]
    count = F.count(F.lit(1)).alias("n")
    own = known.where("lang IS NOT NULL").groupBy("lang").agg(*named("own_least", "own"), count).where(F.col("n") >= MIN_TRUSTED).drop("n")
    rest = known.agg(*named("lo", "hi")).first()
    out = _with_own(scored, own).withColumn("threshold", F.coalesce("own", F.lit(rest["hi"]).cast("double")) * room)
    out = out.withColumn("least", F.coalesce("own_least", F.lit(rest["lo"]).cast("double")) / room)
    p = F.col("perplexity")
    kept = F.coalesce(p.isNotNull() & F.coalesce(p <= F.col("threshold"), F.lit(True)) & F.coalesce(p >= F.col("least"), F.lit(True)), F.lit(False))
    return out.select(F.col("id").alias(id_column), "perplexity", "least", "threshold", kept.alias("kept"))


def _with_own(scored: DataFrame, own: DataFrame) -> DataFrame:
    """``scored`` with the thresholds of its language, or null."""
    rows = own.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        return join_by_hot_key(scored, own, ["lang"], ["id"], how="left")
    return scored.join(F.broadcast(scored.sparkSession.createDataFrame(rows, own.schema)), "lang", "left")
