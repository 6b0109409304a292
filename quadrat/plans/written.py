"""Files that queries read back: pages, CSVs, layers and outlines written from the star-schema tables to
a shared folder, with what real archives have: cut-off pages, odd rows, repeated ids, absent files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import NamedFiles, scratch
from ..sources.shapefile import layer_files, shape_bytes, table_bytes
from .proxy import polygons, table

SCORE = ["id", "part", "supp", "note"]


def save(files: DataFrame, folder: str) -> None:
    """Rows of `name, content` as files."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("name", F.col("content").cast("binary").alias("content")).write.format("named_files").mode("append").save(folder)


def pages(spark: SparkSession, sf_dir: str) -> str:
    """JSON pages of orders, fifty customers each, one folder a hundred pages; every seventh is cut off."""
    folder, page = scratch(spark, "pages"), F.floor(F.col("o_custkey") / 50)
    rec = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("gen"), F.array("o_orderpriority", "o_orderstatus").alias("also"), F.col("o_orderpriority").alias("loc"), F.lit(1).alias("unknown"))
    body = F.to_json(F.struct(F.collect_list(rec).alias("recordings"), F.count("*").alias("total")))
    rows = table(spark, sf_dir, "orders").groupBy(page.alias("p")).agg(body.alias("body"))
    content = F.when(F.col("p") % 7 == 3, F.expr("left(body, length(body) div 2)")).otherwise(F.col("body"))
    save(rows.select(F.format_string("set%d/page%06d.json", F.floor(F.col("p") / 100), "p").alias("name"), content.alias("content")), folder)
    return folder


def scores(spark: SparkSession, sf_dir: str, most: int = 500_000) -> str:
    """Lines as CSV rows of SCORE in an order of their own that goes on from file to file; ids repeat.  A
    note has quotes, commas and line ends, and one task reads all of such a file: none has over `most` rows."""
    folder = scratch(spark, "scores")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.expr("concat('say \"', l_returnflag, '\", ', chr(10), l_linestatus)").alias("note"), ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % 4).alias("b"), ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 100003).alias("o"))
    order = ["b", "o", "part", "supp", "id"]
    dealt = line.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select(*SCORE).write.option("maxRecordsPerFile", most).option("header", True).option("quote", '"').option("escape", '"').csv(folder)
    return folder


def odd_rows(spark: SparkSession, sf_dir: str) -> str:
    """A CSV file of customers for each nation; some rows have a field too many or too few."""
    folder = scratch(spark, "odd")
    row = F.expr("concat_ws(',', c_custkey, c_name, c_mktsegment)")
    line = F.when(F.col("c_custkey") % 11 == 5, F.concat(row, F.lit(",more"))).when(F.col("c_custkey") % 13 == 7, F.expr("concat_ws(',', c_custkey, c_name)")).otherwise(row)
    head = F.lit("id,name,segment\n")
    files = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat(head, F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n")).alias("content"))
    save(files.select(F.format_string("score_%02d_meta.csv", "c_nationkey").alias("name"), "content"), folder)
    return folder


def regions(spark: SparkSession, sf_dir: str) -> str:
    """Customers as a CSV folder for each region but one."""
    folder = scratch(spark, "regions")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lower("r_name").alias("r"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).filter("r <> 'asia'")
    rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "r").write.partitionBy("r").option("header", True).csv(folder)
    return folder


def layers(spark: SparkSession, sf_dir: str) -> str:
    """Supplier polygons as layers by kind and year, and once more, moved, in a folder that comes later."""
    folder, shapes = scratch(spark, "layers"), polygons(spark, sf_dir)
    moved = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] + 1).alias("x"), p["y"].alias("y"))))
    save(layer_files(shapes), f"{folder}/a")
    save(layer_files(shapes.withColumn("rings", moved)), f"{folder}/b")
    return folder


def outlines(spark: SparkSession, sf_dir: str) -> str:
    """A zip archive with the outline of each nation, a square, and its name, among other columns."""
    folder = scratch(spark, "outlines")

    def write(pdf):
        pdf = pdf.sort_values("k")
        squares = [[[(x, y), (x, y + 4.0), (x + 4.0, y + 4.0), (x + 4.0, y), (x, y)]] for x, y in zip(pdf["x"], pdf["y"])]
        shp, shx = shape_bytes(squares)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("ne/countries.shp", shp)
            z.writestr("ne/countries.shx", shx)
            z.writestr("ne/countries.dbf", table_bytes(["CODE", "Name", "ADMIN"], [[f"{k}", n, f"no {n}"] for k, n in zip(pdf["k"], pdf["n"])]))
        return pdf.__class__({"name": ["countries.zip"], "content": [out.getvalue()]})

    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey k", "n_name n", "n_nationkey * 7e0 - 90 x", "n_regionkey * 20e0 - 50 y")
    save(rows.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(write, "name string, content binary"), folder)  # one archive of all nations
    return folder
