"""What each feature adds to a model's output, from the paths of its trees.

A leaf's path asks each of its features to lie in an interval, and says what share of the training rows went that way at the splits of that feature. The expected output given
some features is a sum over leaves of products, one factor a feature: whether the row fits, if the feature is given, else the share. Shapley values of a product follow from the
coefficients of a polynomial, so a row costs a pass over the leaves; nothing is scored again for sets of features.

The leaves (at most trees times 2 ** depth) are read from the model on the driver and go to tasks with the function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from newsloom.operators.signals import FEATURES

#: Rows that a task works on at once.
ROWS = 200


@dataclass
class Leaves:
    """Leaf by leaf: up to ``depth`` features of its path (-1: none), their intervals (low < x <= high) and shares, and what the leaf adds to each label."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    @property
    def base(self) -> np.ndarray:
        """The expected output by label where nothing is known of a row."""
        return (np.where(self.feature >= 0, self.share, 1.0).prod(1)[:, None] * self.value).sum(0)


def _walk(node, path: dict[int, tuple[float, float, float]]) -> Iterator[tuple[dict, object]]:
    """The paths below a node of Spark's, each with its leaf."""
    if not hasattr(node, "split") or "Leaf" in node.getClass().getSimpleName():
        yield path, node
        return
    split, whole = node.split(), node.impurityStats().count()
    k, cut = split.featureIndex(), split.threshold()
    low, high, share = path.get(k, (-math.inf, math.inf, 1.0))
    left, right = node.leftChild(), node.rightChild()
    yield from _walk(left, path | {k: (low, min(high, cut), share * left.impurityStats().count() / whole)})
    yield from _walk(right, path | {k: (max(low, cut), high, share * right.impurityStats().count() / whole)})


def leaves_of(model: PipelineModel, info: dict) -> Leaves:
    """The leaves of a trained model: a forest's with probabilities, a booster's with margins."""
    labels, rows = len(info["labels"]), []
    for k, stage in enumerate(model.stages[2:]):
        trees, weights = stage.trees, stage.treeWeights
        for tree, weight in zip(trees, weights, strict=True):
            for path, leaf in _walk(tree._java_obj.rootNode(), {}):
                if info.get("boosted"):
                    value = np.eye(labels)[k] * weight * leaf.prediction()
                else:
                    stats = np.array(list(leaf.impurityStats().stats()))
                    value = stats / max(stats.sum(), 1e-300) / len(trees)
                rows.append((path, value))
    depth = max([len(p) for p, _ in rows], default=0) or 1
    n = len(rows)
    out = Leaves(np.full((n, depth), -1), np.full((n, depth), -np.inf), np.full((n, depth), np.inf), np.ones((n, depth)), np.array([v for _, v in rows]).reshape(n, labels))
    for r, (path, _) in enumerate(rows):
        for c, (k, (low, high, share)) in enumerate(path.items()):
            out.feature[r, c], out.low[r, c], out.high[r, c], out.share[r, c] = k, low, high, share
    return out


def shapley_values(leaves: Leaves, x: np.ndarray) -> np.ndarray:
    """Values by row, feature and label."""
    rows, (n, depth) = len(x), leaves.feature.shape
    used = leaves.feature >= 0
    given = x[:, np.maximum(leaves.feature, 0)]
    fits = np.where(used, (given > leaves.low) & (given <= leaves.high), True).astype(float)
    size = used.sum(1)
    out = np.zeros((rows, x.shape[1], leaves.value.shape[1]))
    orders = np.array([[math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k) if s < k else 0.0 for s in range(depth)] for k in range(1, depth + 1)])
    weight = np.where(size[:, None] > 0, orders[np.maximum(size, 1) - 1], 0.0)  # by how many of the other features are given
    for j in range(depth):
        poly = np.zeros((rows, n, depth))
        poly[:, :, 0] = 1.0
        for i in range(depth):
            if i != j:
                more = np.where(used[:, i], fits[:, :, i], 0.0)[:, :, None] * poly
                poly *= np.where(used[:, i], leaves.share[:, i], 1.0)[None, :, None]
                poly[:, :, 1:] += more[:, :, :-1]
        gain = (poly * weight[None]).sum(2) * (fits[:, :, j] - leaves.share[:, j]) * used[:, j]
        for k in np.unique(leaves.feature[used[:, j], j]):
            mine = leaves.feature[:, j] == k
            out[:, k] += gain[:, mine] @ leaves.value[mine]
    return out


def path_shapley(model: PipelineModel, info: dict, rows: DataFrame, key: str = "id") -> DataFrame:
    """key, each feature's value for the recommended label, and ``base``; base and values add up to the label's probability (of a booster, to its margin).

    ``rows`` come from :func:`newsloom.operators.signals.predict`.
    """
    leaves, names = leaves_of(model, info), {v: k for k, v in enumerate(info["labels"])}
    base = leaves.base

    def explain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), ROWS):
                some = part.iloc[a : a + ROWS]
                label = some["recommendation"].map(names).to_numpy()
                values = shapley_values(leaves, some[list(FEATURES)].to_numpy(float))[np.arange(len(some)), :, label]
                yield pd.DataFrame({key: some[key].to_numpy(), **dict(zip(FEATURES, values.T, strict=True)), "base": base[label]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "recommendation", *FEATURES).mapInPandas(explain, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in FEATURES) + ", base double")
