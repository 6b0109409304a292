"""Year-matched point-in-polygon tagging without a spatial index: clipped tiles and an equi-join.

A polygon is cut into tiles.  A tile that edges cross keeps just those edges and whether its corner
lies inside; a tile that none crosses is inside as a whole or isn't kept.  A point then meets one tile
of a polygon at most, and is inside if the way from the tile's corner to the point, along y and then
along x, crosses an edge an odd number of times more or less than the corner says.  So a point's test
doesn't grow with the polygon: levels of tiles are added by the number of its edges.

Whether a point is left of an edge is always the sign of one product, of the same two ends in the same
order, so rounding can't make a corner and a point disagree.  Points on an edge are inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite

#: What a kind of polygon makes a point, first of those that apply.
PRIORITY = ("city", "town")
ELSE = "rural"

#: Tiles of a level have sides of tile x 4^level.  A polygon's box touches few tiles of its coarsest level,
#: which is 0 at least; levels below are added until an edge shares its tile with about FEW others.
LEVELS = range(-12, 13)
FEW = 8
#: The sign of (x, y) against an edge from its lower to its upper end: over 0 is left of it.
_SIDE = "(e.bx - e.ax) * ({y} - e.ay) - (e.by - e.ay) * ({x} - e.ax)"


def _right(x: str, y: str) -> str:
    """Whether an edge crosses the level line from (x, y) to the right; its upper end isn't part of it."""
    return f"({y} >= e.ay AND {y} < e.by AND {_SIDE.format(x=x, y=y)} > 0)"


def _above(x: str, y: str) -> str:
    """Whether an edge that spans x is above (x, y), where a point on it counts as just right of and above it."""
    side = _SIDE.format(x=x, y=y)
    return f"(CASE WHEN e.ay = e.by THEN {side} < 0 WHEN e.bx > e.ax THEN {side} <= 0 ELSE {side} > 0 END)"


def outlines(polygons: DataFrame, tile: float, most: int, keys: list[str]) -> DataFrame:
    """Polygons' `keys, _key, rings, minx, miny, maxx, maxy, _root, _leaf`, a row for each different shape, with its
    box and its coarsest and finest level.  _key is of the shape, so equal polygons are one.  Rings that don't end
    where they begin are closed; without an area they still have edges, which points can be on.  Polygons
    without edges, or with a coordinate that isn't a finite number, are left out."""
    shut = "transform(rings, r -> if(size(r) > 0 AND r[0] <> r[size(r) - 1], concat(r, array(r[0])), r))"
    closed = polygons.select(*keys, F.expr(shut).alias("rings"))
    whole = closed.select(*keys, F.struct(F.xxhash64("rings").alias("a"), F.xxhash64(F.lit(1), "rings").alias("b")).alias("_key"), "rings").dropDuplicates([*keys, "_key"])
    x, y = F.flatten("rings").getField("x"), F.flatten("rings").getField("y")
    bad = F.array(*[F.lit(float(v)) for v in ("inf", "-inf", "nan")])
    sound = whole.filter(~F.arrays_overlap(x, bad) & ~F.arrays_overlap(y, bad)).withColumn("rings", F.expr("filter(rings, r -> size(r) > 1)"))  # a null among them makes arrays_overlap null
    box = sound.select(*keys, "_key", "rings", F.array_min(x).alias("minx"), F.array_max(x).alias("maxx"), F.array_min(y).alias("miny"), F.array_max(y).alias("maxy")).filter("minx IS NOT NULL")
    finer = F.ceil(F.log(4.0, F.greatest((F.size(x) - F.size("rings")) / F.lit(4.0 * FEW * 8), F.lit(1.0)))).cast("int")
    n = lambda lo, hi, k: F.floor(F.col(hi) / F.lit(tile * 4.0**k)).cast("double") - F.floor(F.col(lo) / F.lit(tile * 4.0**k)).cast("double") + 1
    fits = [F.when(n("minx", "maxx", k) * n("miny", "maxy", k) <= most, F.lit(k)) for k in LEVELS]
    fit = box.withColumns({"_fit": F.coalesce(*fits, F.lit(LEVELS[-1])), "_finer": finer, "_many": F.size(x) - F.size("rings") > 4 * FEW}).withColumn("_root", F.greatest("_fit", F.lit(0)))
    return fit.withColumn("_leaf", F.when(F.col("_many"), F.least("_root", F.col("_fit") - F.col("_finer"))).otherwise(F.col("_root"))).drop("_fit", "_finer", "_many")


def edges_of(rows: DataFrame, *carried: str) -> DataFrame:
    """`carried, e`: a row for each edge of the rings, from its lower to its upper end."""
    rings = rows.select(*carried, F.explode("rings").alias("r"))
    pairs = rings.select(*carried, F.explode(F.expr("arrays_zip(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1))")).alias("l"))
    ends = pairs.select(*carried, F.col("l.`0`").alias("p"), F.col("l.`1`").alias("q"))
    up = F.expr("if(p.y < q.y OR (p.y = q.y AND p.x <= q.x), struct(p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by), struct(q.x AS ax, q.y AS ay, p.x AS bx, p.y AS by))")
    return ends.select(*carried, up.alias("e"))


def clipped(polygons: DataFrame, tile: float, most: int = 64, keys: list[str] | None = None) -> DataFrame:
    """`keys, _key, _l, _tx, _ty, edges, odd`: the tiles that polygons (kind, year, rings) cover or cross,
    the edges that cross a tile, and whether its lower left corner is inside.

    Edges meet the tiles of the finest level only: a tile over them is crossed if one in it is, and its corner is one
    of theirs, as sides are powers of four of one another.  Only the edges of a single tile of the finest level
    are held together, and those of one row of corners are counted in order."""
    keys = keys or ["kind", "year"]
    ids = [*keys, "_key"]
    place = [*ids, "_l", "_ty", "_tx"]
    rows = outlines(polygons, tile, most, keys)
    side = lambda level: F.lit(tile) * F.pow(F.lit(4.0), F.col(level))
    edges = edges_of(rows.withColumn("_s", side("_leaf")), *ids, "_leaf", "_root", "_s")

    # tiles that an edge crosses, row by row; a hair wider, which does no harm
    wide = edges.withColumn("_h", F.expr("_s * 1e-9D + (abs(e.ax) + abs(e.bx) + abs(e.ay) + abs(e.by)) * 1e-15D"))
    met = wide.withColumn("_ty", F.explode(F.expr("sequence(floor((e.ay - _h) / _s), floor((e.by + _h) / _s))")))
    at = lambda y: f"if(e.by = e.ay, {{0}}, least(greatest(e.ax + (e.bx - e.ax) * coalesce(try_divide(greatest(least({y}, e.by), e.ay) - e.ay, e.by - e.ay), 0D), least(e.ax, e.bx)), greatest(e.ax, e.bx)))"
    lo, hi = at("_ty * _s").format("e.ax"), at("(_ty + 1) * _s").format("e.bx")
    met = met.withColumns({"_lo": F.expr(lo), "_hi": F.expr(hi)}).withColumn("_tx", F.explode(F.expr("sequence(floor((least(_lo, _hi) - _h) / _s), floor((greatest(_lo, _hi) + _h) / _s))")))
    crossed = met.select(*ids, "_leaf", "_root", "_ty", "_tx", "e")
    tiles = crossed.withColumnRenamed("_leaf", "_l").groupBy(*place).agg(F.collect_list("e").alias("edges"))

    # tiles beside them: those of the box on the coarsest level, and on finer ones those of a crossed tile
    up = crossed.drop("e").distinct().withColumn("_k", F.explode(F.expr("sequence(0, _root - _leaf)")))
    over = up.select(*ids, "_leaf", (F.col("_leaf") + F.col("_k")).alias("_l"), *[F.expr(f"shiftright({c}, 2 * _k)").alias(c) for c in ("_ty", "_tx")]).distinct()
    below = "flatten(transform(sequence(0L, 3L), i -> transform(sequence(0L, 3L), j -> struct(_l - 1 AS l, _ty * 4 + i AS y, _tx * 4 + j AS x, 0 AS on))))"
    near = over.withColumn("n", F.explode(F.expr(f"concat(array(struct(_l AS l, _ty AS y, _tx AS x, 1 AS on)), if(_l > _leaf, {below}, array()))")))
    tops = rows.withColumn("_l", F.col("_root")).withColumn("_s", side("_l"))
    tops = tops.withColumn("_ty", F.explode(F.expr("sequence(floor(miny / _s), floor(maxy / _s))"))).withColumn("_tx", F.explode(F.expr("sequence(floor(minx / _s), floor(maxx / _s))")))
    beside = tops.select(*place, F.lit(0).alias("on")).unionByName(near.select(*ids, *[F.col(f"n.{c[-1]}").alias(c) for c in ("_l", "_ty", "_tx")], "n.on"))
    free = beside.groupBy(*place).agg(F.max("on").alias("on")).filter("on = 0").select(*place)

    # corners: how many edges cross the row of corners to the right of each
    line = edges.withColumn("_ty", F.explode(F.expr("sequence(floor(e.ay / _s), floor(e.by / _s) + 1)"))).withColumn("_y", F.col("_ty") * F.col("_s")).filter("e.ay <= _y and _y < e.by")
    about = line.withColumn("_t", F.floor((F.expr("e.ax + (e.bx - e.ax) * try_divide(_y - e.ay, e.by - e.ay)")) / F.col("_s")))
    last = "_t - 2" + "".join(f" + cast({_right(f'((_t + ({k})) * _s)', '_y')} AS int)" for k in (-1, 0, 1))
    least = about.select(*ids, "_leaf", "_root", "_ty", F.expr(last).alias("_tx")).groupBy(*ids, "_leaf", "_root", "_ty", "_tx").agg(F.count("*").alias("c"))
    upper = least.withColumn("_k", F.explode(F.expr("sequence(0, _root - _leaf)"))).filter("_ty = shiftleft(shiftright(_ty, 2 * _k), 2 * _k)")
    ends = upper.select(*ids, (F.col("_leaf") + F.col("_k")).alias("_l"), *[F.expr(f"shiftright({c}, 2 * _k)").alias(c) for c in ("_ty", "_tx")], "c").groupBy(*place).agg(F.sum("c").alias("c"))
    kind, zero = tiles.schema["edges"].dataType, F.lit(0).cast("long").alias("c")
    both = tiles.select(*place, "edges", zero).unionByName(free.select(*place, F.array().cast(kind).alias("edges"), zero)).unionByName(ends.select(*place, F.lit(None).cast(kind).alias("edges"), "c"))
    along = Window.partitionBy(*ids, "_l", "_ty").orderBy(F.desc("_tx"), F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    odd = both.withColumn("odd", F.sum("c").over(along) % 2 == 1).filter("edges is not null")
    return odd.filter("odd or size(edges) > 0").select(*ids, "_l", "_tx", "_ty", "edges", "odd")


def inside(x: str, y: str, corner_x: str, corner_y: str) -> Column:
    """Whether (x, y) is on one of a tile's `edges` or inside, as the tile's corner is `odd`."""
    on = f"exists(edges, e -> {_SIDE.format(x=x, y=y)} = 0 AND {y} BETWEEN e.ay AND e.by AND {x} BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx))"
    along_x = f"({_right(x, y)} <> {_right(corner_x, y)})"
    along_y = f"(((e.ax > {corner_x}) <> (e.bx > {corner_x})) AND ({_above(corner_x, corner_y)} <> {_above(corner_x, y)}))"
    return F.expr(f"{on} OR (size(filter(edges, e -> {along_x} <> {along_y})) % 2 = 1) <> odd")


def needed(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles without those that lie where a polygon of the same keys covers the whole tile: its points are
    in that one, so the others can't add to what is found.  Of several that cover it one stays."""
    here = Window.partitionBy(*keys, "_l", "_tx", "_ty").orderBy(F.size("edges"))
    ranked = tiles.withColumns({"_least": F.first(F.size("edges")).over(here), "_rank": F.row_number().over(here)})
    return ranked.filter("_least > 0 or _rank = 1").drop("_least", "_rank")


def met(points: DataFrame, polygons: DataFrame, tile: float, by_year: bool, most: int = 64) -> DataFrame:
    """`pid, kind` of points in or on a polygon of a kind, some of them several times.

    A point is met only at the levels that some polygon lies on (one row of a few levels is sent to all
    tasks).  Adaptive execution splits crowded tiles.
    """
    keys = ["kind", "year"] if by_year else ["kind"]
    tiles = clipped(polygons, tile, most, keys)
    tiles = needed(tiles, keys)  # joined by merging: tiles hold edges: never all of them in the driver or in one task
    used = outlines(polygons, tile, most, keys).select(F.explode(F.sequence("_leaf", "_root")).alias("_l")).agg(F.collect_set("_l").alias("_used"))
    placed = points.select("pid", "x", "y", "year").filter(finite(F.col("x")).isNotNull() & finite(F.col("y")).isNotNull())
    held = placed.crossJoin(F.broadcast(used)).withColumn("_l", F.explode("_used")).drop("_used")
    side = F.lit(tile) * F.pow(F.lit(4.0), F.col("_l"))
    held = held.withColumn("_s", side).withColumns({"_tx": F.floor(F.col("x") / F.col("_s")), "_ty": F.floor(F.col("y") / F.col("_s"))}).drop("_s")
    at = ["_l", "_tx", "_ty", *(["year"] if by_year else [])]
    hashed = lambda rows: rows.withColumn("_at", F.xxhash64(*at))  # noqa: E731  # first of the keys, so that sorting seldom looks at the others
    pairs = hashed(held).join(hashed(tiles).hint("merge"), ["_at", *at]).withColumn("_s", side)
    return pairs.filter((F.size("edges") == 0) | inside("x", "y", "(_tx * _s)", "(_ty * _s)")).select("pid", "kind")


def points_in(points: DataFrame, polygons: DataFrame, tile: float = 1.0, by_year: bool = True, most: int = 64) -> DataFrame:
    """`pid, kind` of points (pid, x, y, year) that lie in or on a polygon of a kind, each once."""
    return met(points, polygons, tile, by_year, most).distinct()


def overlay(points: DataFrame, polygons: DataFrame, tile: float = 1.0, by_year: bool = True) -> DataFrame:
    """points with urban_class: the first kind of PRIORITY that holds the point, else ELSE."""
    place = F.min(F.when(F.col("kind") == PRIORITY[0], 0).otherwise(1))
    found = met(points, polygons, tile, by_year).groupBy("pid").agg(place.alias("_p"))
    tag = F.when(F.col("_p") == 0, PRIORITY[0]).when(F.col("_p") == 1, PRIORITY[1]).otherwise(ELSE)
    return points.join(found, "pid", "left").withColumn("urban_class", tag).drop("_p")


def extent(polygons: DataFrame, pad: float = 0.0) -> DataFrame:
    """Padded bounding box of all rings, and the aspect that keeps degrees square at its middle."""
    points = polygons.select(F.explode(F.flatten("rings")).alias("p"))
    box = points.agg((F.min("p.x") - pad).alias("minx"), (F.min("p.y") - pad).alias("miny"), (F.max("p.x") + pad).alias("maxx"), (F.max("p.y") + pad).alias("maxy"))
    return box.withColumn("aspect", F.try_divide(F.lit(1.0), F.cos(F.radians((F.col("miny") + F.col("maxy")) / 2))))
