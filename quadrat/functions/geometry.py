"""Point in polygon, boundary included, holes excluded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def in_rings(x: str, y: str, rings: str) -> Column:
    """Whether (x, y) lies on an edge of the rings or inside an odd number of them.

    Even-odd crossings over the edges of all rings make holes work; a divisor of zero (a level
    edge) can't cross, and is divided safely all the same.
    """
    edge = f"transform(sequence(1, size(r) - 1), i -> struct(r[i - 1] AS a, r[i] AS b))"
    edges = f"flatten(transform(filter({rings}, r -> size(r) > 1), r -> {edge}))"
    on = f"(e.b.x - e.a.x) * ({y} - e.a.y) = (e.b.y - e.a.y) * ({x} - e.a.x) AND {x} BETWEEN least(e.a.x, e.b.x) AND greatest(e.a.x, e.b.x) AND {y} BETWEEN least(e.a.y, e.b.y) AND greatest(e.a.y, e.b.y)"
    crosses = f"(e.a.y > {y}) <> (e.b.y > {y}) AND {x} < coalesce(try_divide((e.b.x - e.a.x) * ({y} - e.a.y), e.b.y - e.a.y), double('-inf')) + e.a.x"
    return F.expr(f"exists({edges}, e -> {on}) OR size(filter({edges}, e -> {crosses})) % 2 = 1")
