"""The engine's relations derived from the star-schema tables: an order is a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import RINGS

INDICES = ("idx_quantity", "idx_price", "idx_discount", "idx_tax", "idx_total")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text recordings with numeric indices, site and class keys.  Orders without lines stay,
    with an empty species set; one latitude in 53 is blank."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    per = line.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_set("p_name")).alias("names"), F.avg("l_quantity").alias("idx_quantity"), F.avg("l_extendedprice").alias("idx_price"), F.avg("l_discount").alias("idx_discount"), F.avg("l_tax").alias("idx_tax"),
    )
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.lower("r_name").alias("continent"))
    who = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "continent", "n_name", "c_mktsegment", "n_nationkey")
    rows = table(spark, sf_dir, "orders").join(who, "o_custkey").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    first = F.split(F.try_element_at(names, F.lit(1)), " ")
    return rows.select(
        F.col("o_orderkey").alias("id"), "continent", F.col("n_name").alias("cnt"), F.col("o_custkey").alias("cust"), F.concat_ws("-", F.col("n_nationkey").cast("string"), "c_mktsegment").alias("site"),
        F.expr("if(o_orderkey % 53 = 0, '', cast(((o_custkey * 37) % 1400) / 10e0 - 60 + (o_orderkey % 10) / 100e0 AS string))").alias("lat"),
        F.expr("cast(((o_custkey * 91) % 3600) / 10e0 - 180 + (o_orderkey % 7) / 100e0 AS string)").alias("lon"),
        F.col("o_orderdate").cast("date").cast("string").alias("date"), first.getItem(0).alias("gen"), F.try_element_at(first, F.lit(2)).alias("sp"),
        F.array_join(F.slice(names, 2, 1000000), ";").alias("also"),
        "idx_quantity", "idx_price", "idx_discount", "idx_tax", F.col("o_totalprice").alias("idx_total"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings by site, for the yearly operators: a grid cell has too few of them in a year."""
    from ..functions import species_set

    return recordings(spark, sf_dir).withColumn("species", species_set(F.col("gen"), F.col("sp"), F.col("also")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_orderkey").alias("pid"), F.expr("((o_custkey * 91) % 3600) / 10e0 - 180 + (o_orderkey % 7) / 100e0").alias("x"),
        F.expr("((o_custkey * 37) % 1400) / 10e0 - 60 + (o_orderkey % 10) / 100e0").alias("y"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v"), F.col("o_custkey").alias("cust"),
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon per supplier: square, triangle, or square with a hole."""
    base = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.expr("((s_suppkey * 530) % 3300) / 10e0 - 180").alias("a"), F.expr("((s_suppkey * 310) % 1200) / 10e0 - 60").alias("b"), F.expr("cast(10 + s_suppkey % 5 * 5 AS double)").alias("w"),
    )
    p = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    square = f"array({p('a', 'b')}, {p('a + w', 'b')}, {p('a + w', 'b + w')}, {p('a', 'b + w')}, {p('a', 'b')})"
    hole = f"array({p('a + w / 4', 'b + w / 4')}, {p('a + w * 3 / 4', 'b + w / 4')}, {p('a + w * 3 / 4', 'b + w * 3 / 4')}, {p('a + w / 4', 'b + w * 3 / 4')}, {p('a + w / 4', 'b + w / 4')})"
    triangle = f"array({p('a', 'b')}, {p('a + w', 'b')}, {p('a', 'b + w')}, {p('a', 'b')})"
    rings = F.expr(f"CASE s_suppkey % 3 WHEN 0 THEN array({square}) WHEN 1 THEN array({triangle}) ELSE array({square}, {hole}) END").cast(RINGS)
    return base.select(
        F.when(F.col("s_suppkey") % 2 == 0, "city").otherwise("town").alias("kind"), F.expr("cast(1995 + s_suppkey % 7 AS int)").alias("year"), F.col("s_suppkey").alias("poly_id"), rings.alias("rings"),
        F.col("a").alias("minx"), F.col("b").alias("miny"), F.expr("a + w").alias("maxx"), F.expr("b + w").alias("maxy"),
    )


def staircases(spark: SparkSession, sf_dir: str, steps: int = 5000) -> DataFrame:
    """`kind, rings`: polygons with 2 x steps + 2 vertices, each what lies under a falling staircase, one for each
    supplier; suppliers with the same place, size and kind have one between them, which is drawn once.
    A drawing is 10,000 times its supplier, so few rows are spread over tasks first."""
    base = table(spark, sf_dir, "supplier").selectExpr(
        "if(s_suppkey % 2 = 0, 'city', 'town') AS kind", "((s_suppkey * 530) % 3300) / 10e0 - 180 + 1e0 / 3 AS a", "((s_suppkey * 310) % 1200) / 10e0 - 60 + 1e0 / 7 AS b", "cast(10 + s_suppkey % 5 * 5 AS double) AS w",
    )
    tread = f"struct(a + w * k / {steps} AS x, b + w * ({steps} - k) / {steps} AS y), struct(a + w * (k + 1) / {steps} AS x, b + w * ({steps} - k) / {steps} AS y)"
    ring = F.expr(f"concat(array(struct(a AS x, b AS y)), flatten(transform(sequence(0, {steps} - 1), k -> array({tread}))), array(struct(a + w AS x, b AS y), struct(a AS x, b AS y)))")
    return base.repartition(96, *base.columns).distinct().select("kind", F.array(ring).cast(RINGS).alias("rings"))
