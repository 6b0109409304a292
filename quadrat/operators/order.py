"""Exact ranks and order statistics that no single task sorts.

Equal values are counted on the map side first, so a value that a third of all rows have is one row.
Values fall into classes that keep their order (65,536 to an octave).  The counts of a group's
classes, added up in order, say how many rows stand before each class; within a class its different
values are added up.  Classes are the unit of work, whatever the size of a group.  Ties can't cross a
border, since a class has all rows of a value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of an octave, as a power of two.
FINE = 16


def coarse(x: Column) -> Column:
    """A class of numbers that doesn't fall as they rise; NaN is the last, infinities are at the ends."""
    size = F.abs(x.cast("double"))
    octave = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1000)).cast("double")
    within = F.floor(size * F.pow(F.lit(2.0), F.lit(float(FINE)) - octave))
    place = (octave + 1001) * (1 << (FINE + 2)) + within
    far = F.lit(float(1 << 40))
    place = F.when(size == 0, F.lit(0.0)).when(F.isnan(size), far * 2).when(size == float("inf"), far).otherwise(place)
    return (F.signum(F.when(F.isnan(size), F.lit(1.0)).otherwise(x.cast("double"))) * place).cast("long")


def _key(by: list[str]) -> Column:
    """Groups as one column, in which null is equal to null."""
    return F.struct(*by) if by else F.lit(0)


def _before(n: str, *by: str, order: list[str]) -> Column:
    return F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(rows: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """`_g, value, n, before, total`: for each different value of a group (_g is the struct of `by`), how
    many rows have it, are smaller, and are in the group.  Null values are left out."""
    many = F.sum(weight) if weight else F.count("*")
    return _ordered(rows.filter(F.col(value).isNotNull()).groupBy(_key(by).alias("_g"), value).agg(many.alias("n")), value)


def _ordered(counts: DataFrame, value: str) -> DataFrame:
    """`_g, value, n` of different values, with before and total."""
    counts = counts.withColumn("_c", coarse(F.col(value)))
    classes = counts.groupBy("_g", "_c").agg(F.sum("n").alias("_n"))
    classes = classes.select("_g", "_c", _before("_n", "_g", order=["_c"]).alias("_before"), F.sum("_n").over(Window.partitionBy("_g")).alias("total"))
    return counts.join(classes, ["_g", "_c"]).select("_g", value, "n", (F.col("_before") + _before("n", "_g", "_c", order=[value])).alias("before"), "total")


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """rows with the rank of value in its group, from 1, in which ties share their mean; null for none."""
    at = placed(rows, by, value).select("_g", F.col(value).alias("_v"), (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(name))
    return rows.withColumn("_g", _key(by)).withColumn("_v", F.col(value)).join(at, ["_g", "_v"], "left").drop("_g", "_v")


#: Places, from 0, of the sorted values of n whose mean a statistic is.
Pick = Callable[[Column], list[Column]]
MEDIAN: Pick = lambda n: [F.floor((n - 1) / 2), F.floor(n / 2)]
UPPER_MEDIAN: Pick = lambda n: [F.floor(n / 2)]


def quantile(p: float) -> Pick:
    """The value at place floor(n p), the last for p = 1."""
    return lambda n: [F.least(F.floor(n * F.lit(p)), n - 1)]


#: What a column's counted values also give; each is null (`n` is 0) without any.
TOTALS: dict[str, Callable[[Column, Column], Column]] = {
    "n": lambda v, n: F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).cast("bigint"),
    "mean": lambda v, n: F.try_divide(F.sum(v * n), F.sum(F.when(v.isNotNull(), n))),
    "lo": lambda v, n: F.min(v),
    "hi": lambda v, n: F.max(v),
}


def statistics(rows: DataFrame, by: list[str], columns: list[str], picks: dict[str, Pick], totals: tuple[str, ...] = (), size: str | None = None) -> DataFrame:
    """`by` and `column__pick` of each column and pick, and `column__total` of each of the named TOTALS.

    Values are counted once, and all of it comes from the counts.  Groups without a value in any column
    are left out, unless `size` names a column for the number of a group's rows, with or without values."""
    held = [F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)]
    mark = [F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("v"))] if size else []
    long = rows.select(*by, F.explode(F.array(*held, *mark)).alias("_x")).select(*by, F.col("_x.k").alias("_k"), F.col("_x.v").alias("_v"))
    at = placed(long, [*by, "_k"], "_v")
    here = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("n"))
    one = lambda k, pick: sum(F.max(F.when((F.col("_g._k") == k) & here(i), F.col("_v"))) for i in pick(F.col("total"))) / len(pick(F.col("total")))
    found = [F.coalesce(F.sum(F.when(F.col("_g._k") == -1, F.col("n"))), F.lit(0)).cast("bigint").alias(size)] if size else []
    for k, c in enumerate(columns):
        found += [one(k, pick).alias(f"{c}__{name}") for name, pick in picks.items()]
        found += [TOTALS[t](F.when(F.col("_g._k") == k, F.col("_v")), F.col("n")).alias(f"{c}__{t}") for t in totals]
    return at.groupBy(*[F.col(f"_g.{c}").alias(c) for c in by]).agg(*found)


def with_statistics(main: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """main with the columns of found of the same group, null where it has none; null keys meet."""
    if not by:
        return main.crossJoin(F.broadcast(found))  # one row each
    more = found.select(_key(by).alias("_g"), *[c for c in found.columns if c not in by])
    return main.withColumn("_g", _key(by)).join(more, "_g", "left").drop("_g")


def numbered(rows: DataFrame, value: str, ties: list[str], scopes: dict[str, list[str]]) -> DataFrame:
    """rows with `name` and `name_of` for each scope (a list of grouping columns): the row's number, from
    1, by value and ties among the rows of its group that have a value, and how many those are.

    A class with a single value is parted by the first tie, so cells that share a value are spread.
    Rows without a value have no number, and are spread by hash."""
    classed = rows.withColumn("_c", F.when(F.col(value).isNull(), -(1 << 50) - F.pmod(F.xxhash64(*ties), F.lit(1024))).otherwise(coarse(F.col(value))))
    single = classed.groupBy("_c").agg((F.min(value) == F.max(value)).alias("_one"))
    parted = classed.join(single, "_c").withColumn("_d", F.when(F.col("_one"), coarse(F.col(ties[0]))).otherwise(F.lit(0).cast("long"))).drop("_one")
    out = parted
    for name, by in scopes.items():
        classes = parted.groupBy(_key(by).alias("_g"), "_c", "_d").agg(F.count(value).alias("_n"))
        classes = classes.select("_g", "_c", "_d", _before("_n", "_g", order=["_c", "_d"]).alias("_before"), F.sum("_n").over(Window.partitionBy("_g")).alias(f"{name}_of"))
        place = Window.partitionBy("_g", "_c", "_d").orderBy(value, *ties)
        out = out.withColumn("_g", _key(by)).join(classes, ["_g", "_c", "_d"])
        out = out.withColumn(name, F.when(F.col(value).isNotNull(), F.col("_before") + F.row_number().over(place))).drop("_g", "_before")
    return out.drop("_c", "_d")
