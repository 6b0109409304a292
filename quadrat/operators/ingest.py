"""Joining feature rows to metadata rows: ordered deduplication, left join, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _one(rows: DataFrame, keys: list[str], pick, counts: dict[str, Column] = {}) -> DataFrame:
    """One row per key, by an aggregate: partial on the map side, so a hot key costs no task."""
    held = rows.groupBy(*keys).agg(pick(F.struct(*[c for c in rows.columns if c not in keys])).alias("_r"), *[c.alias(k) for k, c in counts.items()])
    return held.select(*keys, *[F.col(f"_r.{c}" if c.isidentifier() else f"_r.`{c}`") for c in rows.columns if c not in keys], *counts)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, the last by order."""
    return _one(rows, [key], lambda r: F.max_by(r, F.col(order)))


def first_wins(rows: DataFrame, keys: list[str], *order: str, **counts: Column) -> DataFrame:
    """Of rows with one key, the first by order (a source's rank, then the row's place in it), with counts
    over all of the key's rows: the same pass makes both."""
    return _one(rows, keys, lambda r: F.min_by(r, F.struct(*order)), counts)


def left_join(rows: DataFrame, meta: DataFrame, key: str = "id") -> DataFrame:
    """All rows with their metadata or nulls.  Of a name on both sides the metadata's column wins.

    No broadcast is forced: the planner does that for metadata it knows to be small.
    """
    both = [c for c in rows.columns if c in meta.columns and c != key]
    return rows.drop(*both).join(meta.withColumn("_met", F.lit(True)), key, "left").withColumn("matched", F.coalesce("_met", F.lit(False))).drop("_met")


def union_sources(sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """All rows of ranked sources, by column name."""
    out = None
    for rank, df in sources:
        df = df.withColumn("src_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def counted(rows: DataFrame, seen: Observation, **counts: Column) -> DataFrame:
    """rows, and their number (`n`) and further counts in `seen` once an action has gone over them: the
    same pass makes both."""
    return rows.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()])


def read_counts() -> dict[str, Column]:
    """Rows read, and those of the second and third source."""
    return {"n_read": F.count("*"), "n_gap": F.count_if(F.col("src_rank") == 1), "n_hist": F.count_if(F.col("src_rank") == 2)}


def _merged_counts() -> list[Column]:
    return [F.count("*").alias("n_total"), F.count_if("matched").alias("n_matched")]


def match_counters(all_rows: DataFrame, merged: DataFrame, by: str = "continent") -> DataFrame:
    """Rows read by source, duplicates, matched, unmatched, and percent matched, per group."""
    read = all_rows.groupBy(by).agg(*[c.alias(k) for k, c in read_counts().items()])
    return _accounts(read.join(merged.groupBy(by).agg(*_merged_counts()), by, "left").fillna(0), by)


def merge_counters(merged: DataFrame, by: str = "continent") -> DataFrame:
    """match_counters of rows that carry the read_counts of their keys, so the sources are read once; by is
    one of the keys."""
    return _accounts(merged.groupBy(by).agg(*[F.sum(c).alias(c) for c in read_counts()], *_merged_counts()), by)


def _accounts(out: DataFrame, by: str) -> DataFrame:
    pct: Column = F.round(F.try_divide(F.col("n_matched") * F.lit(100.0), F.col("n_total")), 6)
    return out.select(by, "n_read", "n_gap", "n_hist", "n_total", (F.col("n_read") - F.col("n_total")).alias("n_dupes"), "n_matched", (F.col("n_total") - F.col("n_matched")).alias("n_unmatched"), pct.alias("pct_matched"))
