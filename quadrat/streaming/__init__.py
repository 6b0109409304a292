"""Streaming ingestion: the batch operators' expressions over an unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lenient_double, snap, species_set


def deduplicated(records: DataFrame, key: str = "id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once; state older than the watermark is dropped."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def incidence_counts(records: DataFrame, time: str = "ts", window: str = "1 day", cells_per_degree: int = 10) -> DataFrame:
    """Records per window, grid cell and species: what the batch rarefaction starts from."""
    placed = records.select(time, snap(lenient_double(F.col("lat").cast("string")), cells_per_degree).alias("gy"), snap(lenient_double(F.col("lon").cast("string")), cells_per_degree).alias("gx"), F.explode(species_set(F.col("gen"), F.col("sp"), F.col("also"))).alias("species_name"))
    return placed.filter("gy is not null and gx is not null").groupBy(F.window(time, window), "gy", "gx", "species_name").agg(F.count("*").alias("n_inc"))
