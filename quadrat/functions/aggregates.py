"""Aggregate expressions that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rarefied(counts: Column, n: Column, m: int = 10) -> Column:
    """Expected number of species in m of n records (Hurlbert), null if n < m.

    counts is an array of structs (c, k): k species are in c records each.  C(n-c, m) / C(n, m) is
    the product of (n-c-j) / (n-j) for j < m, so no factorials are needed and nothing overflows.
    """
    def missed(c):
        return F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), F.lit(1.0), lambda a, j: a * F.greatest(n - c - j, F.lit(0)) / F.nullif(n - j, F.lit(0)))

    total = F.aggregate(F.array_sort(F.coalesce(counts, F.array().cast("array<struct<c:bigint,k:bigint>>"))), F.lit(0.0), lambda a, x: a + x["k"] * (F.lit(1.0) - missed(x["c"])))
    return F.when(n >= m, total)
