"""Tertile labels, over all scored cells and within latitude bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cell_center, label_code, lat_band
from ..functions.scalars import INSUFFICIENT, LABELS
from . import order


def tertile(number: Column, of: Column) -> Column:
    """Label by thirds of a row's number among `of` rows; a row without a number has none."""
    third = F.floor((number - 1) * 3 / of).cast("int") + 1
    return F.when(number.isNull(), INSUFFICIENT).otherwise(F.element_at(F.array(*map(F.lit, LABELS)), third))


def labelled(cells: DataFrame, value: str = "s_rare_r3") -> DataFrame:
    """cells with label, lat_band and label_regional; ties go by place."""
    banded = cells.withColumn("lat_band", lat_band(F.col("lat_cell")))
    out = order.numbered(banded, value, ["lat_cell", "lon_cell"], {"_all": [], "_band": ["lat_band"]})
    labels = {"label": tertile(F.col("_all"), F.col("_all_of")), "label_regional": tertile(F.col("_band"), F.col("_band_of"))}
    return out.withColumns(labels).select(*cells.columns, "lat_band", "label", "label_regional")


def label_map(labels: DataFrame) -> DataFrame:
    """Scored cells as centres with label and code."""
    scored = labels.filter("s_rare_r3 is not null")
    return scored.select(cell_center(F.col("lat_cell")).alias("lat"), cell_center(F.col("lon_cell")).alias("lon"), "continent", "n_rec", F.col("s_rare_r3").alias("richness"), "label", label_code(F.col("label")).alias("label_code"))


def label_counts(labels: DataFrame) -> DataFrame:
    """`scope, label, n` for both labellings."""
    long = labels.unpivot([], ["label", "label_regional"], "scope", "value")
    return long.groupBy(F.when(F.col("scope") == "label", "global").otherwise("regional").alias("scope"), F.col("value").alias("label")).agg(F.count("*").alias("n"))
