"""Hand-computed fixtures, and properties against plain Python."""

import gzip
import json
import math
import struct
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrat import functions as fn
from quadrat.operators import cells, ingest, labels, order, spatial, summaries, temporal
from quadrat.plans import proxy
from quadrat.sources import FIELDS, NamedFiles, bad_pages, bad_rows, csv_marked, csv_rows, existing, found, good_rows, json_pages, month_range, read_result, tagged_union, unnest, write_csv, write_result
from quadrat.sources import shapefile as shp_files
from quadrat.sources.shapefile import from_bytes
from quadrat.streaming import deduplicated, incidence_counts


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_snap_and_band(spark):
    text = [("-0.35",), ("12.34",), ("",), ("abc",), ("NaN",), ("Infinity",), (None,), (" 1.05 ",)]
    assert values(spark, text, "x string", fn.snap(fn.lenient_double(F.col("x")))) == [-4, 123, None, None, None, None, None, 10]
    assert values(spark, [(-0.4,), (9.9,), (10.0,), (-10.0,)], "x double", fn.lat_band(F.col("x"))) == [-10, 0, 10, -10]


def test_species(spark):
    rows = [("A", "b", " c d ; ;A b"), (None, None, None), ("", "", " ; "), ("\tA", "b ", None)]
    got = values(spark, rows, "g string, s string, also string", fn.species_set(F.col("g"), F.col("s"), F.col("also")))
    assert [sorted(x) for x in got] == [["A b", "c d"], [], [], ["A b"]]


def test_list_text(spark):
    assert values(spark, [('["x y","z"]',), ("plain",), (None,), ("[]",)], "x string", fn.list_text(F.col("x"))) == ["x y;z", "plain", None, ""]


def test_years(spark):
    dates = [("2015-03-01",), ("15-03",), ("0000-00-00",), (None,), ("２０１５",)]
    assert values(spark, dates, "x string", fn.year_text(F.col("x"))) == ["2015", None, "0000", None, None]
    assert values(spark, dates, "x string", fn.year_between(F.col("x"), 2015, 2022)) == [2015, None, None, None, None]


def test_months(spark):
    assert values(spark, [(None,), ("5",), ("4-6",), ("6-4",)], "x string", month_range(F.col("x"))) == [[None], ["05"], ["04", "05", "06"], []]


def test_direction_growth_percent(spark):
    assert values(spark, [(0.5,), (0.51,), (-0.51,), (None,)], "x double", fn.direction(F.col("x"))) == ["flat", "up", "down", None]
    assert values(spark, [(2, 1), (0, 4), (3, 2)], "a long, b long", fn.growth(F.col("a"), F.col("b"))) == [-50, None, -34]
    assert values(spark, [(1, 3), (1, 0)], "a long, b long", fn.percent(F.col("a"), F.col("b"))) == [33.3, None]


def rarefy(incidence, n, m=10):
    if n < m:
        return None
    g = lambda a: math.lgamma(a + 1) - math.lgamma(a - m + 1)
    return sum(1.0 if n - c < m else 1 - math.exp(g(n - c) - g(n)) for c in incidence)


def test_rarefaction(spark):
    cases = [([3], 9), ([1, 2, 3], 10), ([1, 2, 3, 12], 12), ([3], 20), ([], 15)]
    cases += [(np.random.default_rng(s).integers(1, 30 + s, 12).clip(1, 30 + s).tolist(), 30 + s) for s in range(20)]
    rows = [([{"c": c, "k": k} for c, k in Counter(i).items()], n) for i, n in cases]
    got = values(spark, rows, "f array<struct<c:bigint,k:bigint>>, n long", fn.rarefied(F.col("f"), F.col("n")))
    for (incidence, n), s in zip(cases, got):
        want = rarefy(incidence, n)
        assert s is None if want is None else abs(s - want) < 1e-9 and -1e-12 <= s <= len(incidence) + 1e-9
    assert abs(got[2] - 3.8181818) < 1e-6 and abs(got[3] - 0.8947368) < 1e-6


def test_medians_and_quantiles(spark):
    def found(values, **picks):
        return order.statistics(spark.createDataFrame([(x,) for x in values], "x double"), [], ["x"], picks).first()

    med = lambda v: found(v, m=order.UPPER_MEDIAN)[0]
    assert [med([1.0, 2.0, 3.0, 4.0]), med([1.0, 2.0, 3.0]), med([])] == [3.0, 2.0, None]
    assert found([float(x) for x in range(10)], a=order.quantile(0.25), b=order.quantile(0.9), c=order.quantile(1.0))[:] == (2.0, 9.0, 9.0)


def test_classes_keep_the_order(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=300), rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), 2.0 ** np.arange(-1074.0, 1024.0), np.nextafter(2.0 ** np.arange(-40.0, 40.0), 0), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 1.7e308]])
    values = np.concatenate([values, -values])
    got = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),)], "x double").select("x", order.coarse(F.col("x")).alias("c")).collect()
    rows = sorted((r for r in got if r.x == r.x), key=lambda r: r.x)
    assert all(a.c <= b.c for a, b in zip(rows, rows[1:])) and [r.c for r in got if r.x != r.x][0] > rows[-1].c
    assert len({r.c for r in rows}) > 2000


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e6, 1e6))), min_size=1, max_size=60))
def test_order_statistics_property(spark, rows):
    df = spark.createDataFrame([(g, v, None if v is None else -v) for g, v in rows], "g string, v double, w double")
    got = {r.g: r for r in order.statistics(df, ["g"], ["v", "w"], {"median": order.MEDIAN, "upper": order.UPPER_MEDIAN, "q": order.quantile(0.75)}).collect()}
    for g in {g for g, _ in rows}:
        for name, some in (("v", sorted(v for h, v in rows if h == g and v is not None)), ("w", sorted(-v for h, v in rows if h == g and v is not None))):
            if some:
                assert got[g][f"{name}__median"] == pytest.approx(float(np.median(some))) and got[g][f"{name}__upper"] == some[len(some) // 2] and got[g][f"{name}__q"] == some[int(len(some) * 0.75)]
    ranks = order.average_ranks(df, ["g"], "v").collect()
    for r in ranks:
        some = [v for h, v in rows if h == r.g and v is not None]
        assert r["rank"] is None if r.v is None else r["rank"] == sum(x < r.v for x in some) + (sum(x == r.v for x in some) + 1) / 2
    assert len(ranks) == len(rows)


def test_average_rank_and_tertiles(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (30.0,)], "x double")
    assert sorted(r["rank"] for r in order.average_ranks(df, [], "x").collect()) == [1, 2.5, 2.5, 4]
    for n, want in ((5, ["bad", "bad", "moderate", "moderate", "good"]), (2, ["bad", "moderate"]), (1, ["bad"])):
        rows = spark.createDataFrame([(float(i), float(i), 1.0) for i in range(n)] + [(None, -1.0, 1.0)], "s_rare_r3 double, lat_cell double, lon_cell double")
        got = labels.labelled(rows).orderBy("lat_cell").collect()
        assert [r.label for r in got] == ["insufficient_data", *want]
    # one value of nearly all cells: ties go by place, in every band
    cells_ = [(1.0 if i % 20 else 2.0, float(i % 25), float(i % 7) + i / 1000) for i in range(400)] + [(None, 3.0, 0.0)]
    got = labels.labelled(spark.createDataFrame(cells_, "s_rare_r3 double, lat_cell double, lon_cell double").repartition(4)).collect()
    for column, groups in (("label", {0: cells_[:-1]}), ("label_regional", {b: [c for c in cells_[:-1] if c[1] // 10 == b] for b in (0, 1, 2)})):
        want = {c: ("bad", "moderate", "good")[min(2, k * 3 // len(some))] for some in groups.values() for k, c in enumerate(sorted(some))}
        assert {(r.s_rare_r3, r.lat_cell, r.lon_cell): r[column] for r in got if r.s_rare_r3} == want and len(got) == 401


def test_no_task_sorts_a_whole_group(spark):
    """Windows over rows or values are parted by class; those over a group alone see its classes' counts."""
    rows = spark.range(100).selectExpr("cast(id % 3 as string) g", "cast(id as double) v", "cast(id as double) lat_cell", "0D lon_cell", "cast(id as double) s_rare_r3")
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (order.statistics(rows, ["g"], ["v"], {"m": order.MEDIAN}), order.average_ranks(rows, ["g"], "v"), labels.labelled(rows), summaries.class_summary(rows, ["g"], ["v"]))]
    for plan in plans:
        assert not any(x in plan for x in ("median(", "percentile", "collect_list")) and "_c" in plan
        assert all("_n" in x for x in plan.split("\n") if "Window [" in x and "_c" not in x.split("windowspecdefinition(")[1].split(" ASC")[0])


def test_spearman_guards(spark):
    up = [(float(i), float(i * i), 1.0, float("nan")) for i in range(10)]
    df = spark.createDataFrame(up, "y double, a double, b double, c double")
    got = {r.index_name: (r.n, r.rho) for r in cells.spearman(df, "y", ["a", "b", "c"]).collect()}
    assert got["a"][0] == 10 and abs(got["a"][1] - 1) < 1e-12 and got["b"] == (10, None) and got["c"] == (0, None)
    assert all(r.rho is None for r in cells.spearman(df.limit(9), "y", ["a"]).collect())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=12, max_size=25))
def test_spearman_property(spark, pairs):
    def ranks(v):
        return np.array([sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v])

    a, b = (ranks([p[k] for p in pairs]) for k in (0, 1))
    rho = cells.spearman(spark.createDataFrame([(float(x), float(y)) for x, y in pairs], "y double, a double"), "y", ["a"]).first().rho
    if a.std() * b.std() == 0:
        assert rho is None
    else:
        assert abs(rho - np.corrcoef(a, b)[0, 1]) < 1e-9


def test_cells_keep_records_without_species(spark):
    rows = [("1", "5.01", "5.01", "africa", None, None, None)] * 6 + [("2", "5.02", "5.02", "europe", "A", "b", "")] * 5 + [("3", "x", "5", "asia", "A", "b", "")]
    rec = spark.createDataFrame(rows, "id string, lat string, lon string, continent string, gen string, sp string, also string")
    got = cells.grid_cells(rec).collect()
    assert [(r.continent, r.n_rec, r.s_obs) for r in got] == [("europe", 11, 1)] and abs(got[0].s_rare - rarefy([5], 11)) < 1e-9
    assert cells.skipped(cells.gridded(rec)).first()[:] == (12, 1)
    assert cells.grid_cells(rec.limit(0)).count() == 0


def test_change_and_trend(spark):
    rows = [("s", y, "c", 12, 3, v) for y, v in (("2015", 3.0), ("2016", None), ("2017", 3.6))] + [("t", "2015", "d", 12, 3, 1.0)]
    df = spark.createDataFrame(rows, "site string, year string, continent string, n_rec long, s_obs long, s_rare double")
    assert [(r.site, r.first_year, r.last_year, r.direction) for r in temporal.change(df, ["site"]).collect()] == [("s", "2015", "2017", "up")]
    trend = {(r.year, r.continent): r.median_richness for r in temporal.trend(df).collect()}
    assert trend["2016", "ALL"] is None and trend["2015", "ALL"] == 3.0
    assert temporal.multi_year(df, ["site"]).first().asDict() == {"n_years": 3, "n_scored_years": 2, "n_multi": 1, "n_all_years": 0, "n_all_scored_years": 1}


def test_joins(spark):
    meta = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "id long, v string, seq int")
    assert sorted((r.id, r.v) for r in ingest.last_wins(meta, "id", "seq").collect()) == [(1, "b"), (2, "c")]
    base = spark.createDataFrame([("x", 1, "base", 0), ("y", 1, "base", 0)], "continent string, id long, v string, seq int")
    every = ingest.union_sources([(0, base), (1, base.withColumn("v", F.lit("gap")).limit(1)), (2, base.withColumn("id", F.lit(9).cast("long")))])
    kept = ingest.first_wins(every, ["continent", "id"], "src_rank", "seq")
    assert sorted((r.continent, r.id, r.v) for r in kept.collect()) == [("x", 1, "base"), ("x", 9, "base"), ("y", 1, "base"), ("y", 9, "base")]
    merged = ingest.left_join(kept.drop("seq"), ingest.last_wins(meta, "id", "seq"))
    assert {r.id: (r.v, r.matched) for r in merged.collect()} == {1: ("b", True), 9: (None, False)}
    total = ingest.match_counters(every, merged).collect()
    assert all(r.n_total == r.n_matched + r.n_unmatched for r in total) and sum(r.n_dupes for r in total) == 1


def test_report_makes_its_cells_once(spark, monkeypatch):
    """Cells are made from the tables once, and the merge's sources are read once each."""
    from quadrat.plans import queries

    held, made = [], cells.grid_cells
    monkeypatch.setattr(cells, "grid_cells", lambda *a, **k: held.append(made(*a, **k)) or held[-1])
    out = queries.v1_report(spark, "/root/testdata/sf0.001")
    leaves = lambda df, column: df._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").count(column + "#")
    assert len(held) == 1 and leaves(held[0], "l_quantity") == 1
    assert leaves(out, "p_name") == 0 and leaves(out, "l_quantity") == 1 and leaves(out, "o_orderkey") == 3


def test_merge_counters_are_those_of_two_passes(spark):
    rows = spark.range(60).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 'x', 'y')) continent", "id % 20 id", "cast(id % 4 as int) src_rank", "id seq")
    every = rows.union(rows.filter("id < 5"))
    counted = ingest.first_wins(every, ["continent", "id"], "src_rank", "seq", **ingest.read_counts())
    meta = spark.createDataFrame([(k,) for k in range(0, 20, 3)], "id long")
    got = ingest.merge_counters(ingest.left_join(counted, meta))
    want = ingest.match_counters(every.filter("continent is not null"), ingest.left_join(ingest.first_wins(every, ["continent", "id"], "src_rank", "seq"), meta))
    assert sorted(got.filter("continent is not null").collect()) == sorted(want.collect()) and got.columns == want.columns


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]


def polygon_frame(spark, rows):
    from quadrat.sources.shapefile import SCHEMA

    return spark.createDataFrame(rows, SCHEMA)


def test_points_in_polygons(spark):
    pts = [(1, 1.0, 1.0), (2, 4.0, 2.0), (3, 0.0, 0.0), (4, 5.0, 1.0), (5, -1.0, 0.0), (6, 2.0, 2.0), (7, 1.5, 2.0)]
    poly = polygon_frame(spark, [("town", 2015, 1, [square(0.0, 0.0, 4.0), square(1.5, 1.5, 1.0)], 0.0, 0.0, 4.0, 4.0), ("city", 2015, 2, [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]], 0.0, 0.0, 1.0, 1.0), ("city", 2016, 3, [square(-9.0, -9.0, 99.0)], -9.0, -9.0, 90.0, 90.0)])
    points = spark.createDataFrame([(*p, 2015) for p in pts], "pid long, x double, y double, year int")
    for tile, most in ((1.0, 4096), (0.5, 4), (100.0, 4096)):
        got = {(r.pid, r.kind) for r in spatial.points_in(points, poly, tile, most=most).collect()}
        assert got == {(1, "town"), (2, "town"), (3, "town"), (7, "town"), (3, "city")}
    assert {r.pid: r.urban_class for r in spatial.overlay(points, poly).collect()} == {1: "town", 2: "town", 3: "city", 4: "rural", 5: "rural", 6: "rural", 7: "town"}


def test_clipped_tiles_are_the_whole_polygon(spark):
    """Spiky and lattice polygons, whose corners lie on tiles' sides and on one another, against all edges."""
    rng = np.random.default_rng(3)

    def spiky(x, y, r, n):
        at = [(x + r * (0.4 + 0.6 * rng.random()) * math.cos(2 * math.pi * k / n), y + r * (0.4 + 0.6 * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        return [*at, at[0]]

    def lattice(n):
        at = [(float(a), float(b)) for a, b in rng.integers(0, 9, (n, 2))]
        return [*at, at[0]]

    shapes = [[spiky(float(x), float(y), r, n)] for (x, y), r, n in zip(rng.uniform(-6, 6, (8, 2)), [0.3, 2, 5, 5] * 2, [5, 40, 600, 200] * 2)] + [[lattice(n), lattice(4)] for n in (3, 4, 7, 15)]
    rows = [(f"k{i}", 2015, i, r, 0.0, 0.0, 0.0, 0.0) for i, r in enumerate(shapes)]
    odd = [("k0", 2015, 90, shapes[0], 0.0, 0.0, 0.0, 0.0), ("k1", 2015, 91, [[(float("nan"), 0.0), (1.0, 1.0), (0.0, 2.0)]], 0.0, 0.0, 0.0, 0.0), ("k2", 2015, 92, None, 0.0, 0.0, 0.0, 0.0), ("k3", 2015, 93, [], 0.0, 0.0, 0.0, 0.0)]
    polygons = polygon_frame(spark, rows)
    at = [(i, float(x), float(y), 2015) for i, (x, y) in enumerate(rng.uniform(-9, 10, (500, 2)))] + [(1000 + i, (i % 40) / 4.0 - 0.5, i // 40 / 4.0 - 0.5, 2015) for i in range(1600)]
    points = spark.createDataFrame([*at, (9000, float("nan"), 1.0, 2015), (9001, None, 1.0, 2015), (9002, float("inf"), 1.0, 2015)], "pid long, x double, y double, year int")
    want = {tuple(r) for r in points.filter("pid < 9000").crossJoin(F.broadcast(polygons.drop("year"))).filter(fn.in_rings("x", "y", "rings")).select("pid", "kind").distinct().collect()}
    for tile, most in ((1.0, 64), (0.37, 16), (50.0, 64)):
        assert {tuple(r) for r in spatial.points_in(points, polygons.unionByName(polygon_frame(spark, odd)), tile, most=most).collect()} == want
    sizes = {}
    for n in (500, 8000):
        ring = [(3 * math.cos(2 * math.pi * k / n), 3 * math.sin(2 * math.pi * k / n)) for k in range(n)]
        sizes[n] = spatial.clipped(polygon_frame(spark, [("k", 2015, 1, [ring], 0.0, 0.0, 0.0, 0.0)]), 1.0).agg(F.max(F.size("edges")), F.count("*")).first()
    assert sizes[8000][0] <= 2 * spatial.FEW and sizes[500][0] <= 2 * spatial.FEW  # edges a point meets don't grow with the polygon's
    assert sizes[8000][1] < 8000 * 4


def made_by(df, operators):
    """Rows that the physical operators of these names put out, all together."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.groupBy().count()
        plan.collect()
        nodes, rows = [plan._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() in operators:
                rows += node.metrics().apply("numOutputRows").value()
        return rows
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_edges_meet_the_finest_tiles_only(spark):
    """Clipping's rows don't grow with the levels of tiles, of which a polygon of many edges has several."""
    ring = [(3 * math.cos(2 * math.pi * k / 8000), 3 * math.sin(2 * math.pi * k / 8000)) for k in range(8000)]
    polygons = polygon_frame(spark, [("k", 2015, 1, [ring], 0.0, 0.0, 0.0, 0.0)])
    levels = spatial.clipped(polygons, 0.1).select("_l").distinct().count()
    assert levels >= 4
    assert made_by(spatial.clipped(polygons, 0.1), ["Generate"]) < 8000 * 14


def test_unsound_outlines(spark):
    rings = [[[(0.0, 0.0), (1.0, bad), (0.0, 2.0)]] for bad in (None, float("inf"), float("-inf"), float("nan"))] + [None, [], [[]], [None], [[(1.0, 1.0)]], [square(0.0, 0.0, 1.0), [(5.0, None)]]]
    rows = [(f"k{i}", 2015, i, r, 0.0, 0.0, 0.0, 0.0) for i, r in enumerate([*rings, [square(0.0, 0.0, 1.0), [(50.0, 50.0)]], [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]]])]
    found = spatial.outlines(polygon_frame(spark, rows), 1.0, 64, ["kind"]).select("kind", "minx", "miny", "maxx", "maxy").collect()
    assert sorted(map(tuple, found)) == [("k10", 0.0, 0.0, 1.0, 1.0), ("k11", 0.0, 0.0, 1.0, 1.0)]


def test_staircases_of_many_suppliers_are_drawn_once(spark, tmp_path):
    """Keys 1,320 apart have the same place, size and kind; every other supplier has a polygon of its own."""
    spark.range(60 * 1320).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    drawn = proxy.staircases(spark, str(tmp_path), steps=3)
    assert drawn.count() == 1320 and drawn.select("kind", "rings").distinct().count() == 1320
    assert drawn.rdd.getNumPartitions() > 1  # a drawing is far larger than its supplier


def test_covered_tiles_and_no_broadcast(spark):
    """Where one polygon of a kind covers a tile the others of that kind aren't tested, and tiles, which hold
    edges, are never sent to the driver."""
    rows = [("town", 2015, i, [square(-10.0 - i / 64, -10.0, 21.0)], 0.0, 0.0, 0.0, 0.0) for i in range(50)] + [("city", 2015, 99, [square(0.0, 0.0, 0.5)], 0.0, 0.0, 0.5, 0.5)]
    points = spark.createDataFrame([(1, 0.2, 0.2, 2015), (2, 0.7, 0.7, 2015), (3, 99.0, 0.0, 2015)], "pid long, x double, y double, year int")
    polygons = polygon_frame(spark, rows)
    assert spatial.met(points, polygons, 2.0, True).count() < 8  # 101 of all pairs
    found = spatial.points_in(points, polygons, 2.0)
    assert {tuple(r) for r in found.collect()} == {(1, "town"), (2, "town"), (1, "city")}
    assert "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()


def test_score_files_are_bounded(spark, tmp_path):
    """A file with line ends in its fields is read by one task, so its rows don't grow with the table."""
    from quadrat.plans import written

    rows = [(i % 300, i * 37 % 211, i * 11 % 17, "R", "F", 0.1, 1.0) for i in range(1000)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    marked = csv_marked(spark, written.scores(spark, str(tmp_path), most=60), written.SCORE)
    files = [r["count"] for r in marked.groupBy("place.path").count().collect()]
    assert sum(files) == 1000 and max(files) <= 60
    key = lambda i, p, s: ((p * 31 + s) % 4, (p * 7919 + s * 104729) % 100003, p, s, i)
    got = [(int(r.id), int(r.part), int(r.supp)) for r in marked.orderBy("place").collect()]
    assert got == sorted((r[:3] for r in rows), key=lambda r: key(*r))


def test_page_values_as_they_stand(spark, tmp_path):
    """A page is taken in one piece, compressed or not, and one that isn't UTF-8 is a bad page."""
    text = json.dumps({"recordings": [{"id": 7, "lat": 0, "also": ["a", "b"], "q": {"k": [1]}}]}).replace('"lat": 0', '"lat": 12.50')
    (tmp_path / "page1.json").write_text(text)
    (tmp_path / "page2.json.gz").write_bytes(gzip.compress(text.encode()))
    for i, code in enumerate(("utf-16", "utf-16-le", "utf-16-be", "utf-32-be")):
        (tmp_path / f"page{3 + i}.json").write_bytes(text.encode(code))
    pages = json_pages(spark, str(tmp_path), "page*")
    assert [(r.id, r.lat, r.also, r.q) for r in unnest(pages).collect()] == [("7", "12.50", "a;b", '{"k": [1]}')] * 2
    assert sorted(r.path[-10:] for r in bad_pages(pages).collect()) == [f"page{k}.json" for k in (3, 4, 5, 6)]


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.0), ("a", float("inf")), ("b", float("nan"))], "k string, v double")
    got = {r.k: r for r in summaries.class_summary(df, ["k"], ["v"]).collect()}
    assert got["a"].n_recordings == 4 and got["a"].v__median == 1.5 and got["b"].v__mean is None
    hist = spark.range(11).select(F.col("id").cast("double").alias("x"))
    bins = {r.bin: r.n for r in summaries.histogram(hist, "x", 40).collect()}
    assert bins[40] == 1 and sum(bins.values()) == 11
    assert [r[:] for r in summaries.histogram(hist.filter("x = 3"), "x", 40).collect()] == [(1, 1)]
    assert summaries.histogram(hist.limit(0), "x", 40).count() == 0
    wide = summaries.class_pivot(spark.createDataFrame([(1, "city"), (1, "city"), (1, "rural")], "y int, c string"), "y", "c", ["city", "town", "rural"]).first()
    assert (wide.city, wide.town, wide.rural, wide.total, wide.city_pct, wide.town_pct) == (2, 0, 1, 3, 66.7, 0.0)


def test_json_pages(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "page1.json").write_text(json.dumps({"recordings": [{"id": "1", "gen": "A", "also": ["x y", "z"], "new": 1}, {"id": "2", "also": "plain"}], "n": 3}))
    (deep / "page2.json").write_text('{"recordings": [{"id": "3"')
    (tmp_path / "page3.json").write_text(json.dumps({"n": 0}))
    (tmp_path / "other.json").write_text(json.dumps({"recordings": [{"id": "4"}]}))
    pages = json_pages(spark, str(tmp_path))
    rows = unnest(pages)
    assert [(r.path.rsplit("/", 1)[1], r.reason, r.content) for r in bad_pages(pages).collect()] == [("page2.json", "not JSON", '{"recordings": [{"id": "3"')]
    assert [r.id for r in unnest(pages, place=True).orderBy("place").collect()] == ["1", "2"]
    assert rows.columns == FIELDS and sorted((r.id, r.also, r.rec) for r in rows.collect()) == [("1", "x y;z", None), ("2", "plain", None)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi", you\nthere', None)], "id string, t string, u string")
    write_csv(df, str(tmp_path / "out"), ["id", "t", "u", "missing"])
    back = csv_rows(spark, str(tmp_path / "out"), ["id", "t", "u", "missing"]).collect()
    assert [(r.id, r.t, r.u or "", r.missing or "") for r in back] == [("1", 'say "hi", you\nthere', "", "")]
    (tmp_path / "short.csv").write_text("id,t,u\n7,x\n8,y,z,w\n")
    names = ["id", "t", "u"]
    both = tagged_union(spark, {"africa": str(tmp_path / "short.csv"), "asia": str(tmp_path / "none.csv")}, names, ["id", "u"])
    assert sorted((r.id, r.u, r.continent) for r in both.collect()) == [("7", None, "africa"), ("8", "z", "africa")]
    assert existing(spark, [str(tmp_path / "none.csv")]) == [] and tagged_union(spark, {}, names).count() == 0


def shp(rings):
    points = [p for r in rings for p in r]
    xs, ys = zip(*points)
    starts = np.cumsum([0, *map(len, rings[:-1])]).tolist()
    body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
    return b"\0" * 100 + struct.pack(">ii", 1, 2) + struct.pack("<i", 0) + struct.pack(">ii", 2, len(body) // 2) + body


def test_shapefile(spark, tmp_path):
    rings = [square(0.0, 0.0, 4.0), square(1.0, 1.0, 1.0)]
    (tmp_path / "Cities_2016.shp").write_bytes(shp(rings))
    direct = shp_files.layers(spark, str(tmp_path / "Cities_2016.shp")).collect()
    for rows in (direct, from_bytes(spark, str(tmp_path / "*.shp"), "city").collect()):
        assert [(r.kind, r.year, r.poly_id, r.maxx) for r in rows] == [("city", 2016, 2, 4.0)]
        assert [[tuple(p) for p in ring] for ring in rows[0].rings] == rings


def test_layers_open_only_what_filters_ask_for(spark, tmp_path):
    rings = [square(float(k), 0.0, 2.0) for k in range(6)]
    shapes, index = shp_files.shape_bytes([[r] for r in rings])
    for folder, name, content in (("b", "Cities_2016.shp", b"not a shapefile"), ("a", "Cities_2016.shp", shapes), ("a", "Cities_2016.shx", index), ("a", "Towns_2016.shp", b"neither"), ("a", "Towns_2017.shp", shapes)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(content)
    layers = shp_files.layers(spark, str(tmp_path), bytes="300")
    one = layers.filter("kind = 'city' and year = 2016")
    assert one.rdd.getNumPartitions() > 1  # ranges of records, by the index
    got = one.orderBy("poly_id").collect()
    assert [(r.kind, r.year, r.poly_id, r.minx) for r in got] == [("city", 2016, k + 1, float(k)) for k in range(6)] and [[tuple(p) for p in r.rings[0]] for r in got] == rings
    assert layers.filter("year = 2017 and minx > 3").count() == 2 and layers.filter("year in (2017, 2019)").count() == 6
    with pytest.raises(Exception, match="no file of"):
        layers.filter("kind = 'town' and year = 2018").count()


def test_outlines_in_archives(spark, tmp_path):
    import zipfile

    shapes, _ = shp_files.shape_bytes([[square(0.0, 0.0, 1.0)], [square(5.0, 0.0, 1.0), square(7.0, 0.0, 1.0)]])
    table = shp_files.table_bytes(["x", "name", "ADMIN"], [["1", "Peru", "a"], ["2", "A.B", "b"]])
    with zipfile.ZipFile(tmp_path / "world.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("w/land.SHP", shapes)
        z.writestr("w/land.dbf", table)
    (tmp_path / "plain.shp").write_bytes(shapes)
    (tmp_path / "plain.dbf").write_bytes(table)
    shapes = shp_files.outlines(spark, str(tmp_path))
    assert sorted((r.file, r.record, r.attributes["name"]) for r in shapes.collect()) == [("plain.shp", 1, "Peru"), ("plain.shp", 2, "A.B"), ("w/land.SHP", 1, "Peru"), ("w/land.SHP", 2, "A.B")]
    assert [(r.record, len(r.rings), r.maxx) for r in shp_files.of_country(shapes, "a.b").collect()] == [(2, 2, 8.0)] * 2
    assert shp_files.of_country(shapes, "AXB").count() == 0  # a dot is no pattern


def test_a_result_is_whole_or_not_there(spark, tmp_path):
    df = spark.range(5).selectExpr("id as lat", "'a, \"b\"' as continent", "cast(null as string) as label", "9 as other").repartition(3)
    write_result(df, str(tmp_path), "biodiversity_map")
    back = read_result(spark, str(tmp_path), "biodiversity_map")
    assert back.columns == ["lat", "lon", "continent", "n_rec", "richness", "label", "label_code"]
    assert sorted((r.lat, r.continent, r.label or "") for r in back.collect()) == [(str(k), 'a, "b"', "") for k in range(5)]
    before = found(str(tmp_path), "*")
    with pytest.raises(Exception):
        write_result(df.withColumn("lat", F.when(F.col("lat") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("lat"))), str(tmp_path), "biodiversity_map")
    assert found(str(tmp_path), "*") == before and read_result(spark, str(tmp_path), "biodiversity_map").count() == 5
    write_result(df.limit(2), str(tmp_path), "biodiversity_map")
    assert read_result(spark, str(tmp_path), "biodiversity_map").count() == 2
    spark.dataSource.register(NamedFiles)
    for names in (["../x"], ["a", "a"]):
        with pytest.raises(Exception):
            spark.createDataFrame([(n, b"1") for n in names], "name string, content binary").write.format("named_files").mode("append").save(str(tmp_path / "n"))
    assert found(str(tmp_path / "n"), "*") == []


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t,u\n1,"x, ""y""\nz",2\n2,x\n3,x,y,z\n4,,\n')
    marked = csv_marked(spark, str(tmp_path), ["id", "t", "u"])
    assert sorted((r.id, r.t, r.u) for r in good_rows(marked).collect()) == [("1", 'x, "y"\nz', "2"), ("4", None, None)]
    assert sorted((r.reason, r.content.strip()) for r in bad_rows(marked).collect()) == [("too few fields", "2,x"), ("too many fields", "3,x,y,z")]


def test_streaming(spark, tmp_path):
    schema = "id string, ts timestamp, lat string, lon string, gen string, sp string, also string"
    rows = [("1", "2024-01-01 10:00:00", "5.01", "5.01", "A", "b", "c d"), ("1", "2024-01-01 10:05:00", "5.01", "5.01", "A", "b", "c d"), ("2", "2024-01-01 11:00:00", "5.02", "5.02", "A", "b", "")]
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = incidence_counts(deduplicated(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
    run = stream.writeStream.outputMode("update").format("memory").queryName("inc").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert {(r.species_name, r.n_inc) for r in spark.table("inc").collect()} == {("A b", 2), ("c d", 1)}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_core_runs_without_the_training_data_package(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "quadrat"), tmp_path / "quadrat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


if __name__ == "__main__":
    pytest.main([__file__])
