"""JSON pages and CSV files in, CSV files out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import list_text

#: The fields of a metadata record, in order.
FIELDS = [
    "id", "gen", "sp", "ssp", "grp", "en", "rec", "cnt", "loc", "lat", "lon", "alt", "type", "sex", "stage", "method", "url", "file", "file-name", "lic", "q", "length", "time", "date", "uploaded",
    "also", "rmk", "animal-seen", "playback-used", "temp", "regnr", "auto", "dvc", "mic", "smp",
]


def metadata_schema() -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def reading_order() -> Column:
    """A row's place in what is read: its file's path, the block of the file, and its place in the block.

    It orders rows as a reader of all files, sorted by path, would meet them; "first" and "last" are by
    it.  To be taken right from the scan, before any shuffle."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


#: A page is read as one line: no text has this, in UTF-8, UTF-16 or UTF-32.  With `multiLine` Spark opens
#: the file anew for each value that isn't a string (such as a list in `also`) to take its text as it is.
WHOLE = "\0\0\0\0"


def json_pages(spark: SparkSession, folder: str, name: str = "page*.json") -> DataFrame:
    """Pages under folder, at any depth: `recordings` (array of records), `corrupt` (the text of a page that
    can't be parsed, else null), `path` and `place` (reading order)."""
    schema = T.StructType([T.StructField("recordings", T.ArrayType(metadata_schema())), T.StructField("_corrupt_record", T.StringType())])
    read = lambda: spark.read.option("lineSep", WHOLE).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    pages = read().schema(schema).option("mode", "PERMISSIVE").json(folder)
    pages = pages.select("recordings", F.col("_corrupt_record").alias("corrupt"), F.col("_metadata.file_path").alias("path"), reading_order().alias("place"))
    # JSON is UTF-8: of a page in UTF-16 or UTF-32, which has zeros at once, not every value can be taken as it is
    zeros = read().text(folder).filter(F.left("value", F.lit(4)).contains("\0")).select(F.col("_metadata.file_path").alias("path"), F.lit("").alias("_zeros")).distinct()
    return pages.join(F.broadcast(zeros), "path", "left").select("recordings", F.coalesce("corrupt", "_zeros").alias("corrupt"), "path", "place")


def unnest(pages: DataFrame, place: bool = False) -> DataFrame:
    """One row of all FIELDS per record of the good pages, with its `place` (page, and position there) if
    asked; a list in `also` becomes ';'-joined text.  A page without recordings brings no rows."""
    rows = pages.filter("corrupt is null").select("place", F.posexplode("recordings").alias("k", "r"))
    rows = rows.select("r.*", F.struct("place", "k").alias("place")).withColumn("also", list_text(F.col("also")))
    return rows if place else rows.drop("place")


def bad_pages(pages: DataFrame) -> DataFrame:
    """`path, reason, content` of the pages that can't be parsed."""
    reason = F.when(F.col("recordings").isNull(), "not JSON").otherwise("not JSON throughout")
    return pages.filter("corrupt is not null").select("path", reason.alias("reason"), F.col("corrupt").alias("content"))


def csv_rows(spark: SparkSession, path: str | list[str], names: list[str], columns: list[str] | None = None) -> DataFrame:
    """All-text rows of CSV files with quoted, doubled-quote and very long fields.  `names` is the
    header; short rows are filled with nulls and extra fields are dropped.  Only `columns` are read."""
    read = spark.read.schema(text_schema(names)).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("maxCharsPerColumn", -1).option("mode", "PERMISSIVE")
    df = read.csv(path)
    return df.select(*columns) if columns else df


def csv_marked(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """Rows like `csv_rows`, with `place` (reading order), and `reason` and `content` (its text) for a row
    whose number of fields isn't the header's: good rows and quarantine in one read."""
    schema = T.StructType([*text_schema(names).fields, T.StructField("_corrupt_record", T.StringType())])
    read = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("maxCharsPerColumn", -1).option("mode", "PERMISSIVE")
    rows = read.csv(path).withColumn("place", reading_order())
    # of a short row the last field is null and its text doesn't end with an empty one
    reason = F.when(F.col("_corrupt_record").isNull(), None).when(F.col(f"`{names[-1]}`").isNull() & ~F.rtrim("_corrupt_record").endswith(","), "too few fields").otherwise("too many fields")
    return rows.withColumn("reason", reason).withColumnRenamed("_corrupt_record", "content")


def good_rows(marked: DataFrame) -> DataFrame:
    return marked.filter("reason is null").drop("reason", "content")


def bad_rows(marked: DataFrame) -> DataFrame:
    """`path, reason, content` of malformed rows."""
    return marked.filter("reason is not null").select("place.path", "reason", "content")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, asked of their own file system (which may be remote)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).globStatus(where):
            found.append(path)
    return found


def tagged_union(spark: SparkSession, sources: dict[str, str], names: list[str], columns: list[str] | None = None, tag: str = "continent") -> DataFrame:
    """Rows of one CSV file per tag, tagged; absent files are skipped.  Without any file the result
    is empty with its schema."""
    out = spark.createDataFrame([], text_schema([*(columns or names), tag]))
    for name, path in sources.items():
        if existing(spark, [path]):
            out = out.unionByName(csv_rows(spark, path, names, columns).withColumn(tag, F.lit(name)))
    return out


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """The named columns, in order; a missing one and nulls are empty fields, others are ignored."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("")
    df.select(*[text(c).alias(c) for c in columns]).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def month_range(spec: Column) -> Column:
    """'5' -> [05], '4-6' -> [04, 05, 06], a reversed range -> none, null -> [null]."""
    lo = F.split(spec, "-").getItem(0).try_cast("int")
    hi = F.coalesce(F.try_element_at(F.split(spec, "-"), F.lit(2)).try_cast("int"), lo)
    months = F.transform(F.sequence(lo, hi), lambda m: F.lpad(m.cast("string"), 2, "0"))
    return F.when(spec.isNull(), F.array(F.lit(None).cast("string"))).when(lo <= hi, months).otherwise(F.array().cast("array<string>"))
