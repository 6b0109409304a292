"""Grid cells: counts, incidence, rarefied richness, means, coverage, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import lenient_double, rarefied, skip_nan, snap, species_set, year_text
from . import order


def gridded(recordings: DataFrame, cells_per_degree: int = 10) -> DataFrame:
    """recordings with integer cell indices `gy`, `gx`, and `species`; rows without a finite
    coordinate keep null indices."""
    return recordings.select(
        "*", snap(lenient_double(F.col("lat").cast("string")), cells_per_degree).alias("gy"), snap(lenient_double(F.col("lon").cast("string")), cells_per_degree).alias("gx"),
        species_set(F.col("gen"), F.col("sp"), F.col("also")).alias("species"),
    )


def placed(grid: DataFrame) -> DataFrame:
    return grid.filter("gy is not null and gx is not null")


def skipped(grid: DataFrame) -> DataFrame:
    """How many rows were read and how many have no cell."""
    return grid.agg(F.count("*").alias("n_read"), F.count_if(F.col("gy").isNull() | F.col("gx").isNull()).alias("skipped_coord"))


def incidence(grid: DataFrame, by: list[str]) -> DataFrame:
    """In how many records of a group each species is."""
    return grid.select(*by, F.explode("species").alias("species_name")).groupBy(*by, "species_name").agg(F.count("*").alias("n_inc"))


def _number(rows: DataFrame, column: str) -> Column:
    """A column's numbers; only what isn't one already goes by its text."""
    return F.col(column).cast("double") if isinstance(rows.schema[column].dataType, NumericType) else lenient_double(F.col(column).cast("string"))


def state(grid: DataFrame, by: list[str], means: tuple[str, ...] = (), last: str | None = "continent", home: list[str] | None = None) -> DataFrame:
    """`by, species_name, n` and more: in how many records of a group each species is, and, with a null
    species, how many records there are, their `last` and their means.  A group's rows are in one partition,
    and those of equal `home`, some of `by`.

    One pass over the records makes both.  A maximum of texts would have Spark sort the records, so they
    are first counted by hash for each text that `last` has."""
    marked = grid.select(*by, F.col(last).alias("_last") if last else F.lit(None).cast("string").alias("_last"), *[_number(grid, c).alias(c) for c in means], F.explode(F.concat(F.array(F.lit(None).cast("string")), "species")).alias("species_name"))
    whole = F.col("species_name").isNull()
    sums = [f(F.when(whole, skip_nan(F.col(c)))).alias(f"_{name}_{c}") for c in means for name, f in (("sum", F.sum), ("n", F.count))]
    each = marked.groupBy(*by, "species_name", F.when(whole, F.col("_last")).alias("_last")).agg(F.count("*").alias("_n"), *sums)
    held = each.repartition(*(home or by)).groupBy(*by, "species_name")
    return held.agg(F.sum("_n").alias("n"), *([F.max("_last").alias(last)] if last else []), *[F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")).alias(f"mean_{c}") for c in means])


def _scored(counts: DataFrame, by: list[str], m: int, more: list[str]) -> DataFrame:
    """Per group: `more`, n_rec, s_obs, s_rare, s_rare_r3, of counts that are dealt by (some of) `by`.  Species
    that are in equally many records add the same term, so they are counted before they are gathered."""
    species = F.col("species_name").isNotNull().alias("_s")
    alike = counts.groupBy(*by, species, "n").agg(F.count("*").alias("k"), *[F.max(c).alias(c) for c in more])
    of = lambda x, on: F.when(F.col("_s") == on, x)
    pair = F.struct(F.col("n").alias("c"), "k")
    out = alike.groupBy(*by).agg(*[F.max(of(F.col(c), False)).alias(c) for c in more], F.max(of(F.col("n"), False)).alias("n_rec"), F.coalesce(F.sum(of(F.col("k"), True)), F.lit(0)).cast("bigint").alias("s_obs"), F.collect_list(of(pair, True)).alias("_f"))
    return out.withColumn("s_rare", rarefied(F.col("_f"), F.col("n_rec"), m)).drop("_f").withColumn("s_rare_r3", F.round("s_rare", 3))


def richness(grid: DataFrame, by: list[str], m: int = 10, means: tuple[str, ...] = (), last: str | None = "continent") -> DataFrame:
    """Per group: `continent` (the last in order), n_rec, s_obs, s_rare, s_rare_r3 and mean_* of the
    named columns."""
    more = [*([last] if last else []), *[f"mean_{c}" for c in means]]
    out = _scored(state(grid, by, means, last), by, m, more)
    return out.select(*by, *([last] if last else []), "n_rec", *more[bool(last):], "s_obs", "s_rare", "s_rare_r3")


def rolled_up(grid: DataFrame, by: list[str], m: int = 10, last: str = "continent") -> DataFrame:
    """Richness of each group over all years, with a null year and `over` 'all', and of each group and
    year, with `over` 'year', from one state.

    Incidence is counted once by group, year and species; groups are rolled up where their states are.
    Records without a year count over all years only."""
    dated = grid.withColumn("year", year_text(F.col("date")))
    held = state(dated, [*by, "year"], (), last, home=by)
    levels = F.array(F.struct(F.lit("all").alias("over"), F.lit(None).cast("string").alias("year")), F.struct(F.lit("year").alias("over"), F.col("year").alias("year")))
    both = held.select(*by, F.explode(levels).alias("_l"), "species_name", "n", last).filter("_l.over = 'all' or _l.year is not null")
    counts = both.groupBy(*by, F.col("_l.over").alias("over"), F.col("_l.year").alias("year"), "species_name").agg(F.sum("n").alias("n"), F.max(last).alias(last))
    return _scored(counts, [*by, "over", "year"], m, [last])


def grid_cells(recordings: DataFrame, cells_per_degree: int = 10, m: int = 10, means: tuple[str, ...] = ()) -> DataFrame:
    out = richness(placed(gridded(recordings, cells_per_degree)), ["gy", "gx"], m, means)
    side = F.lit(float(cells_per_degree))
    return out.withColumns({"lat_cell": F.col("gy") / side, "lon_cell": F.col("gx") / side}).drop("gy", "gx")


def coverage(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("n_cells"), F.count_if(F.col("s_rare").isNotNull()).alias("n_scored"))


def long_form(cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key and named column: `index_name, value`."""
    return cells.unpivot(keys, columns, "index_name", "value")


def spearman(cells: DataFrame, against: str, columns: list[str], least: int = 10, places: int = 9) -> DataFrame:
    """`index_name, n, rho` of each column against one; null below `least` pairs or without variance.

    Values are ranked as rounded to `places`: means of equal numbers differ in their last bits with
    the order in which they were summed, and would tie or not by chance.  Ranks are of different values,
    so equal pairs are counted first, and no task sorts a column.  Ranks have the mean (n + 1) / 2, from
    which products are taken.
    """
    pairs = long_form(cells.select(F.col(against).cast("double").alias("_y"), *columns), ["_y"], columns).select("index_name", F.round(skip_nan(F.col("value").cast("double")), places).alias("x"), F.round(skip_nan(F.col("_y")), places).alias("y")).filter("x is not null and y is not null")
    alike = pairs.groupBy("index_name", "x", "y").agg(F.count("*").alias("w"))
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("v")) for side in "xy"])).alias("_s")
    long = alike.select("*", sides).select("index_name", "x", "y", "w", F.col("_s.side").alias("side"), F.col("_s.v").alias("v"))
    # one pass ranks both sides
    off = order.placed(long, ["index_name", "side"], "v", "w").select(F.col("_g.index_name").alias("index_name"), F.col("_g.side").alias("side"), "v", (F.col("before") + (F.col("n") - F.col("total")) / F.lit(2.0)).alias("r"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("r"))).alias(f"r{side}")
    ranks = long.join(off, ["index_name", "side", "v"]).groupBy("index_name", "x", "y").agg(F.max("w").alias("w"), of("x"), of("y"))
    total = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))
    found = ranks.groupBy("index_name").agg(F.sum("w").alias("n"), F.try_divide(total("rx", "ry"), F.sqrt(total("rx", "rx")) * F.sqrt(total("ry", "ry"))).alias("r"))
    names = cells.sparkSession.createDataFrame([(c,) for c in columns], "index_name string")
    out = names.join(found, "index_name", "left")
    return out.select("index_name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.when(F.col("n") >= least, F.col("r")).alias("rho"))
