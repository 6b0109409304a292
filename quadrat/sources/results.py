"""The nine result tables as CSV folders with fixed headers, written all or nothing.

Spark makes each part's text, and the named-files sink stages the parts and commits them together, so a
result is either the old one or the whole new one.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import NamedFiles
from .tabular import csv_rows

_CELL = ["lat_cell", "lon_cell", "continent", "n_rec", "S_obs", "S_rare10"]
_CLASS = ["Acoustic_Complexity_Index__main_value", "Bio_acoustic_Index__main_value", "Acoustic_Diversity_Index__main_value", "Acoustic_Evenness_Index__main_value", "Normalized_Difference_Sound_Index__main_value", "Spectral_Entropy__main_value", "Temporal_Entropy__main_value", "NB_peaks__main_value", "Wave_SNR__SNR", "Spectral_centroid__mean", "ZCR__mean", "RMS_energy__mean"]
_MEANS = ["Acoustic_Complexity_Index__mean", "Acoustic_Diversity_Index__main_value", "Acoustic_Evenness_Index__main_value", "Bio_acoustic_Index__main_value", "Normalized_Difference_Sound_Index__main_value", "Spectral_Entropy__main_value", "Temporal_Entropy__main_value", "NB_peaks__main_value", "Acoustic_Diversity_Index_NR__main_value", "Bio_acoustic_Index_NR__main_value", "Spectral_Entropy_NR__main_value"]
_SUMMARY = [f"{c}__{f}" for c in _CLASS for f in ("mean", "median")]
#: The results' names and headers.
RESULTS = {
    "grid_cells": [*_CELL, *_MEANS],
    "grid_cells_labeled": [*_CELL, *_MEANS, "biodiversity_label"],
    "grid_cells_labeled_regional": [*_CELL, *_MEANS, "lat_band", "biodiversity_label_regional"],
    "biodiversity_map": ["lat", "lon", "continent", "n_rec", "richness", "label", "label_code"],
    "grid_cells_yearly": ["lat_cell", "lon_cell", "continent", "year", "n_rec", "S_obs", "S_rare10"],
    "cell_change": ["lat", "lon", "first_year", "last_year", "first_richness", "last_richness", "delta", "direction"],
    "recordings_urban_class": ["id", "continent", "lat", "lon", "year", "urban_class"],
    "urban_class_summary": ["urban_class", "n_recordings", *_SUMMARY],
    "urban_class_by_year": ["year", "urban_class", "n_recordings", *_SUMMARY],
}
#: Rows of a part's chunk that are turned into text at once.
ROWS = 50_000


def write_result(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """Write df as the result `name` to folder/name.csv: the columns of its header in order, missing ones
    and nulls as empty fields, others ignored.  Parts are numbered in df's order of partitions."""
    header = RESULTS[name]
    have = {c.lower(): c for c in df.columns}
    text = lambda c: F.coalesce(F.col(f"`{have[c.lower()]}`").cast("string"), F.lit("")) if c.lower() in have else F.lit("")
    rows = df.select(*[text(c).alias(f"c{k}") for k, c in enumerate(header)])

    def parts(batches):
        from pyspark import TaskContext

        import pyarrow as pa

        part = TaskContext.get().partitionId()
        for chunk, batch in enumerate(b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = io.StringIO()
            write = csv.writer(out, lineterminator="\n")
            write.writerow(header)
            write.writerows(zip(*[c.to_pylist() for c in batch.columns]))
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{chunk:05d}.csv"]), pa.array([out.getvalue().encode()])], names=["name", "content"])

    df.sparkSession.dataSource.register(NamedFiles)
    rows.mapInArrow(parts, "name string, content binary").write.format("named_files").mode("overwrite" if mode == "overwrite" else "append").save(f"{folder}/{name}.csv")


def read_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A result as text columns."""
    return csv_rows(spark, f"{folder}/{name}.csv/*.csv", RESULTS[name])
