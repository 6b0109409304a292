"""One named query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import cells, ingest, labels, order, spatial, summaries, temporal
from .. import sources
from ..sources import month_range, shapefile
from . import written
from .proxy import INDICES, points, polygons, recordings, sites, staircases, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CLASSES = ["city", "town", "rural"]
STACK = ["europe", "america", "asia", "africa", "australia"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def grid(s, d):
    return cells.placed(cells.gridded(recordings(s, d)))


def grid_cells(s, d, means=()):
    return cells.grid_cells(recordings(s, d), means=means)


def kept_cells(s, d, means=()):
    """Grid cells, made once and read from the shared folder: for what goes over them more than once, which
    would make them from the tables each time."""
    made = grid_cells(s, d, means)
    made.write.parquet(folder := sources.scratch(s, "cells"))
    return s.read.schema(made.schema).parquet(folder)


def yearly(s, d):
    return temporal.yearly(sites(s, d), ["site"])


def classed(s, d):
    """Every order's class by the polygon of its year that it lies in."""
    return spatial.overlay(points(s, d), polygons(s, d), tile=2.0)


# sources and scalars
@query
def s02_month_range(s, d):
    spec = F.when(F.col("o_orderkey") % 4 == 0, None).when(F.col("o_orderkey") % 4 == 1, (F.col("o_orderkey") % 12 + 1).cast("string")).otherwise(F.concat_ws("-", (F.col("o_orderkey") % 12 + 1).cast("string"), (F.col("o_custkey") % 12 + 1).cast("string")))
    return table(s, d, "orders").select("o_orderkey", F.explode(month_range(spec)).alias("month"))


def _page_number():
    return F.regexp_extract("path", "page([0-9]+)", 1).cast("bigint")


@query
def s04_json_pages(s, d):
    """Records of all pages that can be read, in nested folders, by page and place."""
    rows = sources.unnest(sources.json_pages(s, written.pages(s, d)), place=True)
    return rows.select("id", "gen", "also", "loc", "en", F.regexp_extract("place.place.path", "page([0-9]+)", 1).cast("bigint").alias("page"))


@query
def s05_bad_pages(s, d):
    """Pages that can't be read, with the reason and how their text begins."""
    return sources.bad_pages(sources.json_pages(s, written.pages(s, d))).select(_page_number().alias("page"), "reason", F.left("content", F.lit(15)).alias("begins"))


@query
def s06_unnest(s, d):
    values = {"id": F.col("l_partkey").cast("string"), "loc": F.col("l_orderkey").cast("string"), "length": F.col("l_quantity").cast("string")}
    rec = F.struct(*[values.get(f, F.lit(None).cast("string")).alias(f) for f in sources.FIELDS])
    pages = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(rec).alias("recordings")).select("recordings", F.lit(None).cast("string").alias("corrupt"), "l_orderkey", F.lit(0).alias("place"))
    return sources.unnest(pages).select(F.col("loc").cast("bigint").alias("l_orderkey"), F.col("id").cast("bigint").alias("l_partkey"), F.col("length").cast("double").alias("l_quantity"))


@query
def s07_csv_sink(s, d):
    """Records with the fixed header, written and read back: what is missing is an empty field."""
    folder = sources.scratch(s, "flat")
    sources.write_csv(sources.unnest(sources.json_pages(s, written.pages(s, d))), folder, sources.FIELDS)
    return sources.csv_rows(s, folder, sources.FIELDS, ["id", "gen", "also", "loc"])


@query
def s08_csv_scan(s, d):
    """Quoted fields with quotes, commas and line ends."""
    return sources.csv_rows(s, written.scores(s, d), written.SCORE)


@query
def s09_pruned_scan(s, d):
    return sources.csv_rows(s, written.scores(s, d), written.SCORE, ["id", "supp"])


@query
def s09_good_rows(s, d):
    return sources.good_rows(sources.csv_marked(s, written.odd_rows(s, d), ["id", "name", "segment"])).select("id", "name", "segment")


@query
def s09_bad_rows(s, d):
    bad = sources.bad_rows(sources.csv_marked(s, written.odd_rows(s, d), ["id", "name", "segment"]))
    return bad.select(F.regexp_extract("path", "score_([0-9]+)", 1).alias("file"), "reason", F.rtrim("content").alias("content"))


@query
def s10_tagged_union(s, d):
    """One source a region; that of Asia is absent (S12)."""
    folder = written.regions(s, d)
    return sources.tagged_union(s, {r: f"{folder}/r={r}" for r in ("africa", "america", "asia", "europe", "middle east")}, ["id", "name", "segment"], ["id", "segment"])


@query
def s11_glob_scan(s, d):
    marked = sources.csv_marked(s, f"{written.odd_rows(s, d)}/score_*_meta.csv", ["id", "name", "segment"])
    return marked.groupBy(F.regexp_extract("place.path", "score_([0-9]+)", 1).alias("file")).agg(F.count("*").alias("n"))


@query
def s13_shapefile(s, d):
    """One layer of many: the filters reach the files, and of two with one name the first is read."""
    shapes = shapefile.layers(s, written.layers(s, d)).filter("kind = 'city' and year = 1996")
    return shapes.select("kind", "year", "poly_id", F.size("rings").alias("n_rings"), F.size(F.flatten("rings")).alias("n_points"), "minx", "miny", "maxx", "maxy")


@query
def s14_zipped_outline(s, d):
    found = shapefile.of_country(shapefile.outlines(s, written.outlines(s, d)), "india")
    return found.select("record", shapefile.outline_name(F.col("attributes")).alias("name"), F.element_at("attributes", "CODE").cast("int").alias("code"), "minx", "miny", "maxx", "maxy")


@query
def s15_result_sink(s, d):
    """A result table, written and read back."""
    folder = sources.scratch(s, "results")
    sources.write_result(labels.label_map(labels.labelled(kept_cells(s, d))), folder, "biodiversity_map")
    back = sources.read_result(s, folder, "biodiversity_map")
    return back.select(*[r6(F.col(c).cast("double")).alias(c) for c in ("lat", "lon", "richness")], "continent", F.col("n_rec").cast("bigint").alias("n_rec"), "label", F.col("label_code").cast("int").alias("label_code"))


@query
def s17_counters(s, d):
    """What a merge has read, skipped, dropped and matched, counted in the pass that writes its rows."""
    read, kept, met, seen = (Observation(x) for x in ("read", "kept", "met", "pages"))
    pages = ingest.counted(sources.json_pages(s, written.pages(s, d)), seen, bad=F.count("corrupt"))
    rows = ingest.counted(sources.unnest(pages, place=True), read, blank=F.count_if(F.col("en").isNull()))
    once = ingest.counted(ingest.last_wins(rows.withColumn("gen_loc", F.concat("gen", "loc")), "id", "place"), kept)
    lines = table(s, d, "lineitem").filter("l_discount > 0.05").select(F.col("l_orderkey").cast("string").alias("id")).distinct()
    merged = ingest.counted(ingest.left_join(once.select("id", "gen_loc"), lines), met, matched=F.count_if("matched"))
    merged.write.parquet(folder := sources.scratch(s, "merged"))
    counts = {"n_pages": seen.get["n"], "n_bad_pages": seen.get["bad"], "n_read": read.get["n"], "n_blank": read.get["blank"], "n_dupes": read.get["n"] - kept.get["n"], "n_matched": met.get["matched"], "n_unmatched": met.get["n"] - met.get["matched"]}
    return s.read.parquet(folder).agg(F.count("*").alias("n_written")).select("n_written", *[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()])


@query
def p01_lenient_double(s, d):
    text = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 5 == 1, "abc").otherwise(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".5 ")))
    return table(s, d, "orders").select("o_orderkey", fn.lenient_double(text).alias("x"))


@query
def p02_grid_snap(s, d):
    return cells.placed(cells.gridded(recordings(s, d))).select("id", (F.col("gy") / F.lit(10.0)).alias("lat_cell"), (F.col("gx") / F.lit(10.0)).alias("lon_cell"))


@query
def p03_skipped_coord(s, d):
    return cells.skipped(cells.gridded(recordings(s, d)))


@query
def p04_year_text(s, d):
    text = F.when(F.col("id") % 7 == 0, F.concat(F.lit("x"), "date")).otherwise(F.col("date"))
    return recordings(s, d).select("id", fn.year_text(text).alias("year")).filter("year is not null")


@query
def p05_year_range(s, d):
    return recordings(s, d).select("id", fn.year_between(F.col("date"), 1996, 1998).alias("year")).filter("year is not null")


@query
def p06_species_key(s, d):
    return table(s, d, "part").select("p_partkey", fn.species_key(F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("\t "), F.split("p_name", " ")[0])), F.when(F.col("p_partkey") % 4 != 0, F.split("p_name", " ")[1])).alias("species"))


@query
def p07_species_set(s, d):
    return sites(s, d).select("id", F.array_join(F.array_sort("species"), ";").alias("species"), F.size("species").alias("n_species"))


@query
def p08_list_text(s, d):
    names = F.to_json(F.sort_array(F.collect_set("l_returnflag")))
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(names.alias("j"))
    return rows.select("l_orderkey", fn.list_text(F.when(F.col("l_orderkey") % 2 == 0, F.col("j")).otherwise("plain, text")).alias("also"))


@query
def p09_lat_band(s, d):
    return grid_cells(s, d).select("lat_cell", "lon_cell", fn.lat_band(F.col("lat_cell")).alias("lat_band"))


@query
def p10_cell_center(s, d):
    return rounded(grid_cells(s, d).select(fn.cell_center(F.col("lat_cell")).alias("lat"), fn.cell_center(F.col("lon_cell")).alias("lon")), "lat", "lon")


@query
def p12_inf_to_null(s, d):
    odd = F.when(F.col("o_orderkey") % 4 == 0, F.lit(float("inf"))).when(F.col("o_orderkey") % 4 == 1, F.lit(float("nan"))).when(F.col("o_orderkey") % 4 == 2, F.lit(float("-inf"))).otherwise(F.col("o_totalprice"))
    return table(s, d, "orders").select("o_orderkey", fn.finite(odd).alias("x"))


@query
def p13_nan_skip_mean(s, d):
    odd = F.when(F.col("o_orderkey") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(fn.skip_nan(odd)), 4).alias("mean"))


@query
def p15_country_filter(s, d):
    return recordings(s, d).filter("cnt = 'INDIA'").select("id", "continent", "date")


@query
def p16_country_name(s, d):
    return table(s, d, "nation").filter(F.lower("n_name") == F.lower(F.lit("India"))).select("n_nationkey", "n_name")


@query
def p17_label_code(s, d):
    return labels.labelled(kept_cells(s, d)).select("lat_cell", "lon_cell", "label", fn.label_code(F.col("label")).alias("label_code"))


@query
def p18_change_direction(s, d):
    delta = F.col("o_orderkey") % 5 * 0.25 - 0.5
    return table(s, d, "orders").select("o_orderkey", fn.direction(delta, 0.25).alias("direction"))


@query
def p19_growth_pct(s, d):
    n = table(s, d, "nation")
    return n.select("n_nationkey", fn.growth(F.col("n_regionkey").cast("bigint"), F.lit(3)).alias("growth"), r6(fn.percent(F.col("n_regionkey"), F.col("n_nationkey"), None)).alias("pct"))


@query
def p20_null_default(s, d):
    """Texts of unmatched rows: null inside, empty at a sink."""
    tags = table(s, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linestatus").alias("tag"))
    joined = ingest.left_join(recordings(s, d).select("id", "cnt"), tags)
    return joined.select("id", F.coalesce("tag", F.lit("")).alias("tag"), "matched")


@query
def p21_short_names(s, d):
    names = F.array(*map(F.lit, [*sources.RESULTS["grid_cells"][6:], "other"]))
    return table(s, d, "part").select("p_partkey", fn.short_name(F.element_at(names, (F.col("p_size") % 12 + 1).cast("int"))).alias("short"))


# joins
def _sources(s, d):
    """Three overlapping sources that hold every recording between them."""
    rows = recordings(s, d).select("id", "continent", "idx_total")
    base, gap, hist = rows.filter("idx_total >= 100000"), rows.filter("idx_total < 150000"), rows.filter("idx_total >= 140000 or idx_total < 60000")
    both = ingest.union_sources([(0, base), (1, gap.withColumn("idx_total", F.col("idx_total") + 1)), (2, hist.withColumn("idx_total", F.col("idx_total") + 2))])
    return both.withColumn("seq", F.col("id"))


def _meta(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_suppkey", (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("seq"))


@query
def j01_left_join(s, d):
    meta = ingest.last_wins(_meta(s, d), "id", "seq").select("id", "seq")
    return ingest.left_join(recordings(s, d).select("id", "continent"), meta).select("id", "continent", "seq", "matched")


@query
def j02_build_last_wins(s, d):
    return ingest.last_wins(_meta(s, d), "id", "seq").select("id", "l_partkey", "l_suppkey")


@query
def j03_probe_first_wins(s, d):
    return rounded(ingest.first_wins(_sources(s, d), ["continent", "id"], "src_rank", "seq").select("continent", "id", "src_rank", "idx_total"), "idx_total")


@query
def j02_last_in_files(s, d):
    """Of rows with one id, the last as files are read."""
    rows = sources.csv_marked(s, written.scores(s, d), written.SCORE)
    return ingest.last_wins(sources.good_rows(rows), "id", "place").select("id", "part", "supp")


@query
def j03_first_in_files(s, d):
    """Of rows with one id, the first as files are read."""
    rows = sources.csv_marked(s, written.scores(s, d), written.SCORE)
    return ingest.first_wins(sources.good_rows(rows), ["id"], "place").select("id", "part", "supp")


@query
def o05_reading_order(s, d):
    """The first and the last row of each class of rows, as files are read in order of path."""
    rows = sources.csv_marked(s, written.scores(s, d), written.SCORE).withColumn("r", F.struct("id", "part", "supp"))
    ends = rows.groupBy(F.expr("(part * 31L + supp) % 4").alias("b")).agg(F.min_by("r", "place").alias("a"), F.max_by("r", "place").alias("z"), F.count("*").alias("n"))
    return ends.select("a.*", F.col("z.id").alias("last_id"), F.col("z.part").alias("last_part"), "n")


@query
def o06_first_hit(s, d):
    """Every layer is there twice, the second one moved: the first by path is read."""
    return shapefile.layers(s, written.layers(s, d)).groupBy("kind", "year").agg(F.count("*").alias("n"), F.min("minx").alias("minx"), F.max("maxx").alias("maxx"))


@query
def u02_union_continents(s, d):
    return s10_tagged_union(s, d).groupBy("continent").agg(F.count("*").alias("n"))


@query
def u01_union_dedup(s, d):
    kept = ingest.first_wins(_sources(s, d), ["continent", "id"], "src_rank", "seq")
    return kept.groupBy("continent", "src_rank").agg(F.count("*").alias("n"))


@query
def j04_match_counters(s, d):
    kept = ingest.first_wins(_sources(s, d), ["continent", "id"], "src_rank", "seq", **ingest.read_counts()).drop("seq")
    return ingest.merge_counters(ingest.left_join(kept, ingest.last_wins(_meta(s, d), "id", "seq").select("id", "seq")))


@query
def j05_pip_semi(s, d):
    return spatial.points_in(points(s, d), polygons(s, d), tile=2.0, by_year=False)


@query
def j06_pip_by_year(s, d):
    return spatial.points_in(points(s, d), polygons(s, d), tile=2.0)


@query
def j05_many_vertices(s, d):
    """Polygons of ten thousand vertices each."""
    return spatial.points_in(points(s, d), staircases(s, d), tile=2.0, by_year=False)


@query
def j07_priority_overlay(s, d):
    return spatial.overlay(points(s, d), polygons(s, d), tile=2.0).select("pid", "year", "urban_class")


@query
def j08_left_fanout(s, d):
    tags = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return recordings(s, d).filter("cnt = 'INDIA'").select("id", "date").join(tags, "id", "left")


@query
def j09_dense_years(s, d):
    counts = points(s, d).groupBy("year").agg(F.count("*").alias("n"))
    return summaries.dense(counts, {"year": list(range(1993, 2004))})


# aggregates
@query
def a01_cell_counts(s, d):
    return grid_cells(s, d).select("lat_cell", "lon_cell", "n_rec")


@query
def a02_last_continent(s, d):
    rows = cells.gridded(recordings(s, d), 1)
    return cells.placed(rows).groupBy("gy", "gx").agg(F.max("continent").alias("continent"))


@query
def a03_incidence(s, d):
    return cells.incidence(grid(s, d), ["gy", "gx"])


@query
def a04_rarefied(s, d):
    return rounded(grid_cells(s, d).select("lat_cell", "lon_cell", "n_rec", "s_obs", "s_rare"), "s_rare")


@query
def a05_cell_means(s, d):
    out = grid_cells(s, d, INDICES)
    return out.select("lat_cell", "lon_cell", *[F.round(F.col(f"mean_{c}") + 0.00003, 4).alias(f"mean_{c}") for c in INDICES])  # off the exact ties, which engines round differently


@query
def a06_cell_year(s, d):
    return rounded(yearly(s, d).select("site", "year", "continent", "n_rec", "s_obs", "s_rare"), "s_rare")


@query
def a06_roll_up(s, d):
    """Sites over all years and by year, from one state."""
    rows = cells.rolled_up(sites(s, d), ["site"])
    return rounded(rows.select("site", "over", "year", "continent", "n_rec", "s_obs", "s_rare"), "s_rare")


@query
def a07_coverage(s, d):
    return cells.coverage(grid_cells(s, d))


@query
def a08_multi_year(s, d):
    return temporal.multi_year(yearly(s, d), ["site"])


@query
def a09_first_last(s, d):
    return rounded(temporal.change(yearly(s, d), ["site"]).drop("direction"), "first_richness", "last_richness", "delta")


@query
def a10_direction_counts(s, d):
    return temporal.direction_counts(temporal.change(yearly(s, d), ["site"]))


@query
def a11_trend_grouping_sets(s, d):
    return rounded(temporal.trend(yearly(s, d)), "median_richness")


@query
def a12_group_medians(s, d):
    return rounded(summaries.group_medians(kept_cells(s, d)), "median_richness")


@query
def a13_order_quantiles(s, d):
    out = summaries.order_quantiles(kept_cells(s, d), "s_rare_r3")
    return rounded(out, *out.columns)


@query
def a14_class_summary(s, d):
    out = summaries.class_summary(classed(s, d), ["urban_class"], ["v", "x", "y"])
    return out.select("urban_class", "n_recordings", *[F.round(F.col(c) + 0.00003, 4).alias(c) for c in out.columns[2:]])  # off the exact ties


@query
def a15_year_class_summary(s, d):
    out = summaries.class_summary(classed(s, d), ["year", "urban_class"], ["v", "y"])
    return out.select("year", "urban_class", "n_recordings", *[F.round(F.col(c) + 0.00003, 4).alias(c) for c in out.columns[3:]])  # off the exact ties


@query
def a16_pivot_pct(s, d):
    return summaries.class_pivot(classed(s, d), "year", "urban_class", CLASSES)


@query
def a17_label_counts(s, d):
    return labels.label_counts(labels.labelled(kept_cells(s, d)))


@query
def a18_effort_totals(s, d):
    return temporal.effort(yearly(s, d))


@query
def a19_scored_by_year(s, d):
    return rounded(temporal.scored_by_year(yearly(s, d)), "median_richness")


@query
def a20_series_extrema(s, d):
    return temporal.extrema(points(s, d).groupBy("year").agg(F.count("*").alias("n")), "year", "n")


@query
def a21_histogram(s, d):
    return summaries.histogram(kept_cells(s, d).filter("s_rare_r3 is not null"), "s_rare_r3", 40)


@query
def a22_value_counts(s, d):
    return classed(s, d).groupBy("urban_class").agg(F.count("*").alias("n"))


@query
def a23_year_counts(s, d):
    years = recordings(s, d).select(fn.year_text(F.col("date")).alias("year")).filter("year is not null")
    return years.groupBy("year").agg(F.count("*").alias("n"))


@query
def a24_share(s, d):
    return rounded(summaries.share(classed(s, d).groupBy("urban_class").agg(F.count("*").alias("n")), ["city", "town"]), "share")


@query
def a25_extent(s, d):
    return rounded(spatial.extent(polygons(s, d), 1.0), "minx", "miny", "maxx", "maxy", "aspect")


# ranks, order, shape
@query
def w01_avg_rank(s, d):
    rows = table(s, d, "part").select("p_partkey", "p_brand", "p_size")
    return order.average_ranks(rows, ["p_brand"], "p_size").select("p_partkey", "rank")


def _correlations(cell):
    return rounded(cells.spearman(cell.filter("s_rare is not null"), "s_rare_r3", [f"mean_{c}" for c in INDICES]), "rho")


@query
def w02_spearman(s, d):
    return _correlations(kept_cells(s, d, INDICES))


@query
def w03_global_tertile(s, d):
    return labels.labelled(kept_cells(s, d)).select("lat_cell", "lon_cell", "label")


@query
def w04_band_tertile(s, d):
    return labels.labelled(kept_cells(s, d)).select("lat_cell", "lon_cell", "lat_band", "label_regional")


@query
def w05_stack_offset(s, d):
    counts = classed(s, d).groupBy("year", "urban_class").agg(F.count("*").alias("n"))
    return summaries.stack_offset(counts, "year", "urban_class", "n")


@query
def o01_sort_abs(s, d):
    found = w02_spearman(s, d)
    # as many rows as there are indices
    place = F.row_number().over(Window.orderBy(F.desc(F.abs(F.coalesce("rho", F.lit(0.0)))), "index_name"))
    return found.select("index_name", "rho", place.alias("place"))


def _best(found):
    return found.agg(F.max(F.abs("rho")).alias("best_rho"))


@query
def o02_best_rho(s, d):
    return _best(w02_spearman(s, d))


@query
def o04_distinct_years(s, d):
    return recordings(s, d).select(fn.year_text(F.col("date")).alias("year")).distinct().orderBy("year")


@query
def r01_unpivot(s, d):
    return cells.long_form(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount")), ["l_orderkey"], ["quantity", "discount"])


@query
def r02_pivot_fill(s, d):
    counts = classed(s, d).groupBy("year", "urban_class").agg(F.count("*").alias("n"))
    full = summaries.dense(counts, {"year": list(range(1994, 2003)), "urban_class": CLASSES})
    return full.groupBy("year").pivot("urban_class", CLASSES).agg(F.first("n")).na.fill(0)


@query
def r03_append_labels(s, d):
    return labels.labelled(kept_cells(s, d)).select("lat_cell", "lon_cell", "n_rec", "s_obs", "lat_band", "label", "label_regional")


# report products
def _summary(cell):
    return labels.labelled(cell).agg(F.count("*").alias("n_cells"), F.count("s_rare").alias("n_scored"), r6(F.try_divide(F.count("s_rare") * 100.0, F.count("*"))).alias("pct_scored"), *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in ("bad", "moderate", "good")])


@query
def v1_summary(s, d):
    return _summary(kept_cells(s, d))


@query
def v1_report(s, d):
    """The summary with the best correlation, of the same cells, and the merge's totals."""
    cell = kept_cells(s, d, INDICES)
    totals = j04_match_counters(s, d).agg(F.sum("n_read").alias("n_read"), F.sum("n_total").alias("n_merged"), r6(F.try_divide(F.sum("n_matched") * 100.0, F.sum("n_total"))).alias("pct_matched"))
    return _summary(cell).crossJoin(F.broadcast(_best(_correlations(cell)))).crossJoin(F.broadcast(totals))  # one row each


@query
def v2_label_map(s, d):
    return rounded(labels.label_map(labels.labelled(kept_cells(s, d))), "lat", "lon", "richness")


@query
def v3_signed_rho(s, d):
    """Correlations by size, with sign and short name."""
    found = w02_spearman(s, d)
    place = F.row_number().over(Window.orderBy(F.desc(F.abs(F.coalesce("rho", F.lit(0.0)))), "index_name"))  # as many rows as there are indices
    sign = F.when(F.col("rho") < 0, "negative").otherwise("positive")
    return found.select("index_name", "n", "rho", sign.alias("sign"), place.alias("place"))


@query
def v4_richness(s, d):
    """Histogram of richness in 40 bins, with the quantiles of all cells beside each."""
    scored = kept_cells(s, d).filter("s_rare_r3 is not null")
    quantiles = rounded(summaries.order_quantiles(scored, "s_rare_r3"), "lo", "q25", "q50", "q75", "q90", "hi")
    return summaries.histogram(scored, "s_rare_r3", 40).crossJoin(F.broadcast(quantiles))  # one row


@query
def v4_distribution(s, d):
    return summaries.histogram(temporal.change(yearly(s, d), ["site"]), "delta", 30)


@query
def v6_change(s, d):
    """Histogram of change in 30 bins, with the counts of directions."""
    changes = temporal.change(yearly(s, d), ["site"])
    counts = changes.agg(*[F.count_if(F.col("direction") == x).alias(f"n_{x}") for x in ("up", "down", "flat")])
    return summaries.histogram(changes, "delta", 30).crossJoin(F.broadcast(counts))  # one row


@query
def v6_trend(s, d):
    return rounded(temporal.trend(yearly(s, d)), "median_richness")


@query
def v7_decade(s, d):
    """Findings over all years: coverage, directions, and where the yearly median was lowest and highest."""
    years = yearly(s, d)
    changes = temporal.change(years, ["site"])
    series = rounded(temporal.scored_by_year(years).filter("median_richness is not null"), "median_richness")
    counts = changes.agg(F.count("*").alias("n_changed"), *[F.count_if(F.col("direction") == x).alias(f"n_{x}") for x in ("up", "down", "flat")])
    ends = rounded(temporal.extrema(series, "year", "median_richness"), "low", "peak", "last", "drop")
    return temporal.multi_year(years, ["site"]).crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(ends))  # one row each


@query
def v8_effort_metric(s, d):
    return rounded(temporal.medians(yearly(s, d), ["year"], F.sum("n_rec").alias("n_rec")), "median_richness")


@query
def v8_effort_stack(s, d):
    counts = yearly(s, d).groupBy("year", "continent").agg(F.sum("n_rec").alias("n_rec"))
    return summaries.stack_offset(counts, "year", "continent", "n_rec", STACK)


@query
def v8_metric_extrema(s, d):
    series = rounded(temporal.scored_by_year(yearly(s, d)).filter("median_richness is not null"), "median_richness")
    return rounded(temporal.extrema(series, "year", "median_richness"), "drop")


@query
def v9_country_years(s, d):
    """A country's records by year, of a run of years without gaps, and all its records of any year."""
    years = recordings(s, d).filter("cnt = 'INDIA'").select(fn.year_text(F.col("date")).cast("int").alias("year")).filter("year is not null")
    counts = years.groupBy("year").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return summaries.dense(counts, {"year": list(range(1996, 2004))}).crossJoin(F.broadcast(total))  # one row


@query
def v10_country_map(s, d):
    """A country's records with the class of the polygon they lie in, and its outline's padded box."""
    tags = spatial.overlay(points(s, d), polygons(s, d), tile=2.0).select(F.col("pid").alias("id"), "urban_class")
    rows = recordings(s, d).filter("cnt = 'INDIA'").select("id", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon")).filter("lat is not null and lon is not null")
    box = spatial.extent(shapefile.of_country(shapefile.outlines(s, written.outlines(s, d)), "india"), 2.0)
    return rounded(rows.join(tags, "id", "left").crossJoin(F.broadcast(box)), "lat", "lon", "aspect")  # one row


@query
def v9_country_split(s, d):
    """A country's records by year and the class of the polygon they lie in: counts, shares, stack."""
    india = recordings(s, d).filter("cnt = 'INDIA'").select(F.col("id").alias("pid"))
    tags = spatial.overlay(points(s, d).join(india, "pid", "left_semi"), polygons(s, d), tile=2.0)
    counts = tags.groupBy("year", "urban_class").agg(F.count("*").alias("n"))
    full = summaries.dense(counts, {"year": list(range(1995, 2002)), "urban_class": CLASSES})
    out = summaries.stack_offset(full, "year", "urban_class", "n", CLASSES)
    return out.withColumn("share", r6(F.try_divide("n", F.sum("n").over(Window.partitionBy("year")))))


@query
def flagship_grid_labels(s, d):
    out = labels.labelled(kept_cells(s, d))
    return out.select("lat_cell", "lon_cell", "continent", "n_rec", "s_obs", r6("s_rare_r3").alias("s_rare10"), "label", "lat_band", "label_regional")
