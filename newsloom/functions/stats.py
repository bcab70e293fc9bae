"""Column functions for means, deviations and exponentially weighted averages."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.ranks import matched

ALPHA = 0.3


def mean0(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def std0(x: Column) -> Column:
    """Sample deviation, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def ewma(values: Column, alpha: float = ALPHA) -> Column:
    """acc = alpha * v + (1 - alpha) * acc over an array in its order, beginning with its first value; 0 if it is empty."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    fold = F.aggregate(rest, F.element_at(values, 1), lambda acc, v: F.lit(alpha) * v + F.lit(1 - alpha) * acc)
    return F.when(F.size(values) > 0, fold).otherwise(F.lit(0.0))


def _felt(q: float) -> int:
    """So many places back, q ** k is less than a double's precision beside 1."""
    return math.ceil(math.log(2.0**-60) / math.log(q))


def ewma_by(df: DataFrame, keys: Sequence[str | Column], value: Column, time: Column, tie: Column, alpha: float = ALPHA) -> DataFrame:
    """keys, ``ewma``, ``n``, ``total`` and ``squares`` of each group, its values ordered by time and ``tie``.

    What a value adds shrinks with every one that follows, so only the last ones of a group are folded, as many as a double can tell. Each task sends
    no more than these of a group (Spark limits groups before the shuffle), and no array is longer.
    """
    k = [c if isinstance(c, Column) else F.col(c) for c in keys]
    rows = df.select(*k, time.alias("_t"), tie.alias("_i"), value.alias("_v"))
    names = [c for c in rows.columns if c not in ("_t", "_i", "_v")]
    last = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc_nulls_last("_t"), F.desc_nulls_last("_i")))
    felt = rows.withColumn("_rn", last).where(F.col("_rn") <= _felt(1 - alpha)).groupBy(*names).agg(in_time_order(F.col("_v"), -F.col("_rn")).alias("_vs"))
    sums = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.sum(F.col("_v") * F.col("_v")).alias("squares"))
    return matched(sums, felt.select(*names, ewma(F.col("_vs"), alpha).alias("ewma")), names).select(*names, "ewma", "n", "total", "squares")


def in_time_order(value: Column, *order: Column) -> Column:
    """Aggregate: the values of a group as an array, by the order columns."""
    keyed = F.sort_array(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], value.alias("v"))))
    return F.transform(keyed, lambda s: s["v"])


def ewm_adjusted(values: Column, span: int) -> Column:
    """For each place of an array, sum(q ** k * x) / sum(q ** k) over it and what came before, q = 1 - 2 / (span + 1); one pass."""
    q = F.lit(1 - 2 / (span + 1))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        n, d = acc["n"] * q + v, acc["d"] * q + F.lit(1.0)
        return F.struct(n.alias("n"), d.alias("d"), F.concat(acc["out"], F.array(n / d)).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def ewm_adjusted_over(value: str, span: int, partition: Sequence[str], order: str) -> Column:
    """:func:`ewm_adjusted` of a column over a row and those before it.

    Rows so far back that a double can't tell what they add are left out.
    """
    q = 1 - 2 / (span + 1)
    values = F.collect_list(value).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(-_felt(q), Window.currentRow))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    step = lambda acc, v: F.struct((acc["n"] * F.lit(q) + v).alias("n"), (acc["d"] * F.lit(q) + F.lit(1.0)).alias("d"))
    return F.aggregate(values, start, step, lambda acc: acc["n"] / acc["d"])


def clip01(x: Column) -> Column:
    """Between 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
