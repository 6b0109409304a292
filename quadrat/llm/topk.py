"""Exact top-k by exhaustive term-at-a-time accumulation.

Components are terms.  Rows are packed into blocks whose postings are kept by term; a stated set of
query rows is packed into smaller blocks, and each block of queries meets each block of rows once.
For every term the weighted postings are added to the dense score arrays of the queries that have
that term.  A partition selection keeps each query's best k of the block, and the blocks' best are
merged.  Both kinds of blocks have a fixed number of rows, so a task's memory is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES, AT_ONCE = 4096, 512, 16
PACKED = "block int, ids binary, terms int, weights binary"


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """`vec_id, weights` (floor(scale * x), x as double); rows without an id or with a null, NaN or
    infinite component, or a null vector, are left out.  A component that 64 bits can't hold is an error."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & finite(F.col("v")))
    return rows.select("vec_id", F.transform("v", lambda x: F.when(F.abs(x * F.lit(scale)) < 2.0**63, F.floor(x * F.lit(scale)).cast("long")).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))).alias("weights"))


def packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows of `vec_id, weights` in blocks of about `size` rows, and the number of blocks."""
    n = max(1, -(-rows.count() // size))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).repartition(n, "block")

    def pack(batches):
        held: dict[int, list] = {}
        for batch in batches:
            block = batch.column(2).to_numpy()
            for b in np.unique(block).tolist():
                held.setdefault(b, []).append(batch.filter(pa.array(block == b)))
        for b, parts in held.items():
            t = pa.Table.from_batches(parts)
            lists = t.column(1).combine_chunks()
            length = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            matrix = np.zeros((t.num_rows, max(1, int(length.max(initial=0)))), np.int64)
            matrix[np.arange(matrix.shape[1]) < length[:, None]] = lists.flatten().to_numpy()
            ids = t.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix[order].tobytes()])], names=["block", "ids", "terms", "weights"])

    return blocks.mapInArrow(pack, PACKED), n


def best(row_ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query ids, row ids, scores) of each query's best k rows but its own; rows in order of id.

    Sums are of the narrowest integers that hold them, of exact ones if 64 bits may not; a score
    that 64 bits can't hold is an error."""
    terms, n = min(rows.shape[1], queries.shape[1]), len(rows)
    most = float(np.abs(rows.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * max(terms, 1)
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**62 else object
    postings = []
    for t in range(terms):
        at = np.flatnonzero(rows[:, t])
        dense = 2 * len(at) > n
        postings.append((None if dense else at, np.ascontiguousarray(rows[:, t] if dense else rows[at, t], kind)))
    queries = queries.astype(kind)
    out = []
    for start in range(0, len(queries), AT_ONCE):
        some = queries[start : start + AT_ONCE]
        scores, part = np.zeros((len(some), n), kind), np.empty((len(some), n), kind)
        for t, (at, weights) in enumerate(postings):
            has = np.flatnonzero(some[:, t])
            if not len(has) or not len(weights):
                continue
            if at is not None:
                for q in has:
                    scores[q, at] += some[q, t] * weights
            elif len(has) == len(some):
                np.multiply(some[:, t, None], weights, out=part)
                scores += part
            else:
                scores[has] += some[has, t, None] * weights
        for q in range(len(some)):
            own = query_ids[start + q]
            low, high = np.searchsorted(row_ids, [own, own + 1])
            left = np.r_[0:low, high:n] if high > low else slice(None)
            ids, value = row_ids[left], scores[q][left]
            if len(ids) > k:  # all over the border, and of those on it the smallest ids
                border = np.partition(value, len(value) - k)[len(value) - k]
                over, on = np.flatnonzero(value > border), np.flatnonzero(value == border)
                top = np.concatenate([over, on[: k - len(over)]])
                ids, value = ids[top], value[top]
            value = value.astype(np.int64)  # raises OverflowError where it must
            out.append((np.full(len(ids), own), ids, value))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """`query_id, rank, vec_id, score` of each query's k largest inner products over all rows but
    those with its own id (all there are, if fewer), ties to the smaller vec_id.

    Both tables have `vec_id, weights`; missing components count as 0.  Repeated query rows count
    once, and of repeated row ids the best score counts.  Empty tables give an empty result.
    """
    held, n = packed(rows, ROWS)
    asked, _ = packed(queries, QUERIES)
    # the small blocks travel: each goes to every block of rows
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.col("ids").alias("q_ids"), F.col("terms").alias("q_terms"), F.col("weights").alias("q_weights"))
    meet = asked.join(held, "block")
    meet = meet.select("ids", "terms", "weights", "q_ids", "q_terms", "q_weights")

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, terms, w, q_ids, q_terms, q_w = (c[i].as_py() for c in batch.columns)
                got = best(np.frombuffer(ids, np.int64), np.frombuffer(w, np.int64).reshape(-1, terms), np.frombuffer(q_ids, np.int64), np.frombuffer(q_w, np.int64).reshape(-1, q_terms), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["query_id", "vec_id", "score"])

    found = meet.mapInArrow(search, "query_id long, vec_id long, score long").repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
