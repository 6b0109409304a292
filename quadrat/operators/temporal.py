"""Richness by year: trends, first-to-last change, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import direction, year_text
from . import order
from .cells import richness


def yearly(grid: DataFrame, by: list[str], m: int = 10, years: tuple[int, int] | None = None) -> DataFrame:
    """Per group and year: continent, n_rec, s_obs, s_rare.  Rows without a year are left out; no
    range of years is applied unless it is given."""
    rows = grid.withColumn("year", year_text(F.col("date"))).filter("year is not null")
    if years:
        rows = rows.filter(F.col("year").between(*(f"{y:04d}" for y in years)))
    return richness(rows, [*by, "year"], m)


def change(cells: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """First and last scored year of groups scored in two years at least, and the direction."""
    scored = cells.filter("s_rare is not null")
    out = scored.groupBy(*by).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("s_rare", "year").alias("first_richness"), F.max_by("s_rare", "year").alias("last_richness"), F.count("*").alias("_n"))
    delta = F.col("last_richness") - F.col("first_richness")
    return out.filter("_n >= 2").drop("_n").withColumns({"delta": delta, "direction": direction(delta, threshold)})


def direction_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("direction").agg(F.count("*").alias("n"))


def trend(cells: DataFrame) -> DataFrame:
    """Upper median of the scored cells by year and continent and by year over ALL; null if a year
    has none."""
    both = cells.select("year", F.explode(F.array("continent", F.lit("ALL"))).alias("continent"), "s_rare")
    return medians(both, ["year", "continent"])


def medians(cells: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Per group: further aggregates, the upper median of s_rare (null if none is scored), and n_scored."""
    if not more:
        found = order.statistics(cells, by, ["s_rare"], {"m": order.UPPER_MEDIAN}, ("n",), size="_rows")
        return found.select(*by, F.col("s_rare__m").alias("median_richness"), F.col("s_rare__n").alias("n_scored"))
    main = cells.groupBy(*by).agg(*more, F.count("s_rare").alias("n_scored"))
    found = order.statistics(cells, by, ["s_rare"], {"m": order.UPPER_MEDIAN}).withColumnRenamed("s_rare__m", "median_richness")
    out = order.with_statistics(main, found, by)
    return out.select(*[c for c in main.columns if c != "n_scored"], "median_richness", "n_scored")


def multi_year(cells: DataFrame, by: list[str]) -> DataFrame:
    """Groups scored in two years at least, and in all years (of the data, and of scored rows)."""
    years = cells.agg(F.count_distinct("year").alias("n_years"), F.count_distinct(F.when(F.col("s_rare").isNotNull(), F.col("year"))).alias("n_scored_years"))
    per = cells.filter("s_rare is not null").groupBy(*by).agg(F.count_distinct("year").alias("k"))
    joined = years.join(F.broadcast(per.groupBy("k").agg(F.count("*").alias("c"))), how="left")  # one row by as many as there are years
    return joined.groupBy("n_years", "n_scored_years").agg(
        F.coalesce(F.sum(F.when(F.col("k") >= 2, F.col("c"))), F.lit(0)).alias("n_multi"),
        F.coalesce(F.sum(F.when(F.col("k") == F.col("n_years"), F.col("c"))), F.lit(0)).alias("n_all_years"),
        F.coalesce(F.sum(F.when(F.col("k") == F.col("n_scored_years"), F.col("c"))), F.lit(0)).alias("n_all_scored_years"),
    )


def scored_by_year(cells: DataFrame) -> DataFrame:
    return medians(cells, ["year"])


def effort(cells: DataFrame) -> DataFrame:
    """Records by year and continent, and by year over ALL."""
    out = cells.groupingSets([["year", "continent"], ["year"]], "year", "continent").agg(F.grouping("continent").alias("g"), F.sum("n_rec").alias("n_rec"))
    return out.select("year", F.when(F.col("g") == 1, "ALL").otherwise(F.col("continent")).alias("continent"), "n_rec")


def extrema(series: DataFrame, x: str, y: str) -> DataFrame:
    """Least and largest y, where each is first met, the last y, and the fall from the peak to it."""
    at = series.agg(F.min(y).alias("low"), F.max(y).alias("peak"), F.min_by(x, F.struct(F.col(y), F.col(x))).alias("low_at"), F.min_by(x, F.struct(-F.col(y), F.col(x))).alias("peak_at"), F.max_by(y, x).alias("last"))
    return at.withColumn("drop", F.col("peak") - F.col("last"))
