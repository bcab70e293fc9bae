"""URL filter: host and path rules first, then a ratio of two character language models.

The rules label the URLs they fit. From those, two variable-order Markov models of characters are counted, one of accepted
and one of rejected URLs: Witten-Bell smoothing mixes each order with the next lower one, down to a uniform distribution.
A URL that no rule fits gets the mean log-likelihood difference per character of the two models; it is blocked where that is
below a threshold, which is calibrated on the labelled URLs (least mean of the two error rates, from a histogram).

What leaves the executors is bounded: characters are mapped to :data:`ALPHABET` and one more, so there are at most
``len(SYMBOLS) ** (ORDER + 1)`` n-grams for each model, however many URLs there are. Counts are combined in each partition, then
over partitions by Spark. URLs are never collected.

* A null URL, or one without ``://``, has an empty host and path; no rule fits it, and an empty host and path score 0.
* Without URLs of both labels no model can be told from another: all differences are 0 and everything unlabelled is allowed.
* Very long URLs are scored whole. Repeated rows count as often as they occur. An empty table gives an empty table.
* Columns of the input that have the name of a result column are not carried along.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import batch_map

ORDER = 3
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_%~+"
#: Symbols: other, the alphabet (digits are all ``0``), and one that stands before and after the URL.
SYMBOLS = len(ALPHABET) + 2
_EDGE = SYMBOLS - 1
BINS, WIDTH = 2001, 0.01


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _codes() -> np.ndarray:
    out = np.zeros(128, np.int64)
    for k, c in enumerate(ALPHABET):
        out[ord(c)] = out[ord(c.upper())] = k + 1
    out[ord("0") : ord("9") + 1] = ALPHABET.index("0") + 1
    return out


def grams(text: str) -> np.ndarray:
    """Numbers of the n-grams of ``ORDER + 1`` symbols, one for each character and one for the end."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = np.full(len(points) + ORDER + 1, _EDGE, np.int64)
    codes[ORDER:-1] = np.where(points < 128, _codes()[np.minimum(points, 127)], 0)
    out = np.zeros(len(points) + 1, np.int64)
    for k in range(ORDER + 1):
        out = out * SYMBOLS + codes[k : k + len(out)]
    return out


def log_likelihood(counts: np.ndarray) -> np.ndarray:
    """Natural logarithm of the last symbol's probability after the others, for each n-gram, from n-gram counts (Witten-Bell)."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(ORDER + 1):
        own = counts.reshape(-1, SYMBOLS ** (k + 1)).sum(0).reshape(-1, SYMBOLS).astype(float)
        kinds, total = (own > 0).sum(1, keepdims=True), own.sum(1, keepdims=True)
        lower = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if k else 1, 1))
        p = np.where(total > 0, (own + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return np.log(p).ravel()


def calibrate(accepted: np.ndarray, rejected: np.ndarray) -> float:
    """The threshold with the least mean error rate on histograms of both labels' differences; of equal ones that nearest to 0."""
    if not accepted.sum() or not rejected.sum():
        return -np.inf
    lost = np.concatenate([[0], np.cumsum(accepted)]) / accepted.sum()
    passed = 1 - np.concatenate([[0], np.cumsum(rejected)]) / rejected.sum()
    error = np.round(lost + passed, 12)
    at = (np.arange(BINS + 1) - BINS / 2) * WIDTH
    best = np.flatnonzero(error == error.min())
    return float(at[best[np.argmin(np.abs(at[best]))]])


def _bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x / WIDTH + BINS / 2), 0, BINS - 1).astype(np.int64)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Every row with host, path, rule, verdict and ``llr``, the mean log-likelihood difference (accepted less rejected)."""
    spark = pages.sparkSession
    own = {"host", "path", "rule", "verdict", "llr"}
    host, path = host_and_path(F.col(url))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    parsed = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path")).withColumn("rule", name).withColumn("label", verdict)

    def count(batch: pa.RecordBatch) -> dict:
        kinds, texts = batch.column("label").to_pylist(), batch.column("site").to_pylist()
        found = []
        for label in ("allow", "block"):
            g, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(grams(t) for t, k in zip(texts, kinds, strict=True) if k == label)]), return_counts=True)
            found.append((label, g, n))
        return {"label": [x for x, g, _ in found for _ in g], "gram": np.concatenate([g for _, g, _ in found]), "n": np.concatenate([n for *_, n in found])}

    site = F.concat("host", "path").alias("site")
    counted = batch_map(parsed.where("label IS NOT NULL"), [site, "label"], count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    model = {label: np.zeros(SYMBOLS ** (ORDER + 1), np.int64) for label in ("allow", "block")}
    for label, part in counted.toPandas().groupby("label"):  # at most two models of SYMBOLS ** (ORDER + 1) n-grams
        model[label][part["gram"].to_numpy()] = part["n"].to_numpy()
    known = all(x.any() for x in model.values())
    ratio = spark.sparkContext.broadcast((log_likelihood(model["allow"]) - log_likelihood(model["block"])).astype(np.float32) if known else np.zeros(SYMBOLS ** (ORDER + 1), np.float32))

    def llr(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([float(ratio.value[grams(t)].mean(dtype=np.float64)) for t in batch.column("site").to_pylist()], np.float64)

    def histogram(batch: pa.RecordBatch) -> dict:
        x, kinds = llr(batch), np.array(batch.column("label").to_pylist(), object)
        found = [(label, *np.unique(_bin(x[kinds == label]), return_counts=True)) for label in ("allow", "block")]
        return {"label": [k for k, b, _ in found for _ in b], "bin": np.concatenate([b for _, b, _ in found]), "n": np.concatenate([n for *_, n in found])}

    bins = {label: np.zeros(BINS, np.int64) for label in ("allow", "block")}
    if known:
        for r in batch_map(parsed.where("label IS NOT NULL"), [site, "label"], histogram, "label string, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect():  # at most two histograms of BINS
            bins[r["label"]][r["bin"]] = r["n"]
    threshold = calibrate(bins["allow"], bins["block"]) if known else -np.inf
    schema = T.StructType([*parsed.schema.fields, T.StructField("site", T.StringType()), T.StructField("llr", T.DoubleType())])
    scored = batch_map(parsed.withColumn("site", site), ["row", "host", "path", "rule", "label", "site"], lambda b: {c: b.column(c) for c in schema.names[:-1]} | {"llr": llr(b)}, schema)
    judged = F.coalesce("label", F.when(F.col("llr") < F.lit(threshold), "block").otherwise("allow"))
    kept = [F.col(f"row.`{c}`") for c in pages.columns if c.lower() not in own]
    return scored.select(*kept, "host", "path", "rule", judged.alias("verdict"), "llr")
