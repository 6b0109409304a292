"""Class summaries, pivots, histograms, quantiles, dense calendars, running offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, percent
from . import order


def class_summary(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows, and mean and interpolated median of each column, per group.  Missing, NaN and infinite
    values are skipped column by column; the count is of all rows."""
    clean = rows.select(*by, *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    out = order.statistics(clean, by, columns, {"median": order.MEDIAN}, ("mean",), size="n_recordings")
    return out.select(*by, "n_recordings", *[f"{c}__{n}" for c in columns for n in ("mean", "median")])


def class_pivot(rows: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """Counts per value as columns (0 where there are none), their total, and percents of all values
    but the last."""
    wide = rows.groupBy(by).pivot(column, values).count().na.fill(0)
    total: Column = sum((F.col(v) for v in values), F.lit(0))
    out = wide.withColumn("total", total.cast("bigint"))
    return out.withColumns({f"{v}_pct": percent(F.col(v), F.col("total")) for v in values[:-1]})


def group_medians(cells: DataFrame, by: str = "continent", value: str = "s_rare_r3") -> DataFrame:
    found = order.statistics(cells, [by], [value], {"m": order.UPPER_MEDIAN}, ("n",))
    return found.select(by, F.col(f"{value}__m").alias("median_richness"), F.col(f"{value}__n").alias("n")).orderBy(F.desc("median_richness"), by)


def order_quantiles(cells: DataFrame, value: str, places: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Least and largest value and those at the given places of the sorted values."""
    found = order.statistics(cells, [], [value], {f"{round(100 * p)}": order.quantile(p) for p in places}, ("lo", "hi"))
    return found.select(F.col(f"{value}__lo").alias("lo"), *[F.col(f"{value}__{round(100 * p)}").alias(f"q{round(100 * p)}") for p in places], F.col(f"{value}__hi").alias("hi"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """`bin, n` of equal widths from the least to the largest value; the last bin is closed.  With a
    single value everything is in the first bin.  Empty bins are left out."""
    bounds = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    placed = rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds))  # one row
    place = F.when(F.col("lo") == F.col("hi"), F.lit(1).cast("bigint")).otherwise(F.least(F.expr(f"width_bucket({value}, lo, if(lo = hi, lo + 1, hi), {bins})"), F.lit(bins).cast("bigint")))
    return placed.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def dense(counts: DataFrame, keys: dict[str, list], value: str = "n") -> DataFrame:
    """counts with a row, 0 if there was none, for each combination of the listed key values."""
    spark = counts.sparkSession
    frame = None
    for name, values in keys.items():
        part = spark.createDataFrame([(v,) for v in values], f"{name} {counts.schema[name].dataType.simpleString()}")
        frame = part if frame is None else frame.crossJoin(part)  # a calendar: as long as its lists
    return frame.join(counts, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(0)).cast("bigint"))


def stack_offset(rows: DataFrame, by: str, along: str, value: str, places: list | None = None) -> DataFrame:
    """rows with `base`: the sum of value over the rows before in order, per group.  With places, the
    order is that of the list, and what is not in it comes last."""
    place = F.lit(0) if places is None else F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, places)), F.col(along)), F.lit(0)), F.lit(len(places) + 1))
    before = Window.partitionBy(by).orderBy(place, along).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint"))


def share(counts: DataFrame, part: list[str], column: str = "urban_class", value: str = "n") -> DataFrame:
    """Sum of value over the given classes, over all, and their ratio."""
    out = counts.agg(F.sum(F.when(F.col(column).isin(part), F.col(value)).otherwise(0)).alias("n_part"), F.sum(value).alias("n_all"))
    return out.withColumn("share", F.try_divide("n_part", "n_all"))
