"""What the training-data operators share: reading tables, cutting lineage, Arrow helpers."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key that no task minds.
HOT = 10_000


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table.  Only Spark's own reader touches the path."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, made known to Spark.

    Only where that is unset (tests, a laptop) is a temporary folder used, never on a cluster.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quadrat-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, forget: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, which ends its lineage.

    A checkpoint carries on its estimated size, and a join's estimate is the product of both sides':
    over rounds of joins with itself that number gets so long that planning takes minutes.  With
    forget, df is written as a table, which has the size of its files.
    """
    folder = shared_folder(df.sparkSession)
    if not forget:
        return df.checkpoint(eager=True)
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is what salts are sized by."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches, max_bytes: int = 8 << 20, column: int = 1):
    """Re-slice Arrow batches so that the text column of a slice stays near max_bytes.

    A batch has up to ten thousand rows; with long texts that is too much to expand in Python.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * max_bytes / max(batch.column(column).nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def schema_of(names: str) -> pa.Schema:
    """Arrow schema of a short Spark DDL string with plain types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in names.split(","))])


def unused(df: DataFrame, n: int) -> list[str]:
    """Names of n columns that df has not."""
    taken = {c.lower() for c in df.columns}
    return list(itertools.islice((x for x in (f"_{k}" for k in itertools.count()) if x not in taken), n))


def quoted(name: str) -> str:
    """A column's name as Spark's expressions take it whole, dots and all."""
    return f"`{name.replace('`', '``')}`"


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name: the batches' are numbered, in order."""
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))]).mapInArrow(run, schema)


def look_up(rows: DataFrame, table: DataFrame, key: str, keep: str | None = None) -> DataFrame:
    """Inner join of rows with a table that has one row per (long, not null) key and `n`, how many
    rows have that key; the result has no `n`, unless keep names it.

    The rows of a key that many share would meet in one task.  Keys with over 1 / (4 x partitions)
    of all rows are fewer than 4 x partitions, whatever the input: those are broadcast, and their
    rows stay where they are.  table should be a checkpoint, since it is read twice.
    """
    spark = table.sparkSession
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT, total // (4 * partitions(spark)))
    values = [c for c in table.columns if c not in (key, "n") or c == keep]
    held = table.select(key, F.struct(*map(quoted, values)).alias("_held"), "n")
    if held.filter(hot).isEmpty():
        return rows.join(held.drop("n"), key).select(*map(quoted, rows.columns), "_held.*")
    few = F.broadcast(held.filter(hot).select(key, F.col("_held").alias("_hot")))
    # rows that are done go anywhere
    rest = rows.join(few, key, "left").withColumn("_at", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*map(quoted, rows.columns))))
    out = rest.join(held.filter(~hot).select(F.col(key).alias("_at"), "_held"), "_at", "left")
    out = out.withColumn("_held", F.coalesce("_hot", "_held")).filter("_held is not null")
    return out.select(*map(quoted, rows.columns), "_held.*")
