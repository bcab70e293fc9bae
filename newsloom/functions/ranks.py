"""Ranks and order statistics of groups, without sorting a whole group in one task.

Rows are dealt to ranges of what they are ordered by. A range's first rank follows from the counts of the ranges before it, and only rows of one range are sorted
together. Counts are combined before they are shuffled, so a group that holds a large share of all rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are cut into, and the error that their approximate quantiles may have (1 / ACCURACY of the rows).
CUTS, ACCURACY = 64, 10_000
#: Rows of a range in which a rank is looked for; larger ones are cut again.
SMALL = 200_000


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """A join on equal keys, nulls equal too, without the keys of ``right``."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(other, on if also is None else [*on, also], how).drop(*[f"_of_{k}" for k in keys])


def with_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Column, rank: str = "_rank", size: str = "_n") -> DataFrame:
    """``df`` with each row's place in its group's order, from 1, and the group's size. ``bucket``: a range of the first order column, in the same order."""
    x = df.withColumn("_bucket", bucket)
    counts = x.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    before = F.sum("_c").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")
    counts = counts.select(*by, "_bucket", before.alias("_before"), F.sum("_c").over(w).alias(size))  # a row for each range
    joined = matched(x, counts, [*by, "_bucket"])
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return joined.withColumn(rank, F.col("_before") + inside).drop("_bucket", "_before")


def with_ranges(df: DataFrame, value: str, into: str, cuts: int = CUTS) -> DataFrame:
    """``df`` with the range of each value of a numeric, date or time column: how many of the quantiles of all rows lie below it."""
    points = df.agg(F.percentile_approx(value, [k / cuts for k in range(1, cuts)], ACCURACY)).scalar()
    below = F.size(F.filter("_points", lambda p: p < F.col(value)))
    return df.withColumn("_points", F.array_distinct(points)).withColumn(into, F.coalesce(below, F.lit(0))).drop("_points")


def order_statistics(df: DataFrame, value: str, by: Sequence[str], ranks: dict[str, Callable[[Column], Column]], small: int = SMALL) -> DataFrame:
    """The values at some places of each group's order, null values left out: ``ranks`` gives a place, from 1, by the size of the group.

    All rows are counted by range; only those of the ranges in which a wanted place lies go on, in ranges of their own, until these are small or hold one
    value. In the end equal values are counted, and the distinct ones of each range put in order.
    """
    keys = list(by)
    rows = df.select(*by, F.col(value).alias("_v")).where("_v IS NOT NULL")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("place")) for name, f in ranks.items()])
    wanted = sizes.select(*by, F.explode(places).alias("p")).select(*by, "p.name", "p.place").where("place >= 1")
    most = sizes.agg(F.max("n")).first()[0] or 0
    while most > small:
        part = f"_part{len(keys) - len(by)}"
        ranged = with_ranges(rows, "_v", part)
        counts = ranged.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.withColumn("before", upto - F.col("c"))
        found = matched(counts, wanted, keys, also=(F.col("place") > F.col("before")) & (F.col("place") <= F.col("before") + F.col("c")))
        wanted = found.select(*keys, part, "name", (F.col("place") - F.col("before")).alias("place"), "c").persist()  # a row for each wanted place
        keys.append(part)
        rows = matched(ranged, wanted.select(*keys).distinct(), keys, "left_semi")
        now = wanted.agg(F.max("c")).first()[0] or 0
        wanted = wanted.drop("c")
        if now >= most:  # one value only
            break
        most = now
    values = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    values = values.withColumn("upto", upto)
    found = matched(values, wanted, keys, also=(F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("c")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
