"""Best-fit packing of tokenised documents into fixed-length sequences (best-two-fit).

A packing depends on the lengths alone, and there are at most `capacity` of them.  So the only
thing that reaches the driver is the histogram of lengths (capacity + 1 numbers whatever the
input).  The driver packs that histogram: it fills a bin greedily with the largest documents that
fit, takes the smallest one out again if two unpacked documents fit its expanded gap more tightly,
and repeats the finished bin as often as the counts allow.  Each repeat uses a count up, so the
plan has a few entries per length.  The executors then number the pieces of each length and look
their place up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import chunks, cut, mapped, partitions, quoted, schema_of, unused

CAPACITY = 2048
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole pieces, and a shorter first one if need be."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise `doc_id, text`; one row per piece, with its ids (int32, little-endian) on request.

    The ids are those of `tokenizers`, whose file path names, with `<|endoftext|>` in a text as that
    special token.  A null text counts as empty; every document ends with id 0, so an empty one has one token.
    Null or repeated doc_ids are kept as they are; other columns are ignored.
    """
    path = path or tokens.path("byte_bpe_50k.json")
    out = schema_of(PIECE + (", ids binary" if with_ids else ""))

    def run(batches):
        bpe = tokens.byte_bpe(path, special=True)
        for batch in chunks(batches, 2 << 20):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe(text or "").astype("<u4").tobytes() + b"\0\0\0\0"
                for k, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, k, start, n, zlib.crc32(own), own)[: len(out)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


def _two(lengths: np.ndarray, free: np.ndarray, room: int) -> tuple[int, int]:
    """The two available lengths with the largest sum within room, or (0, 0)."""
    other = np.searchsorted(lengths, room - lengths, "right") - 1
    other -= (other >= 0) & (lengths[other] == lengths) & (free < 2)
    total = np.where(other >= 0, lengths + lengths[other], 0)
    best = int(total.argmax())
    return (int(lengths[best]), int(lengths[other[best]])) if total[best] else (0, 0)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack counts[length] documents of each length.  Returns sorted keys (length << 40 | first
    rank), and for each the first sequence and the offset in it: the document of that length with
    rank r >= first rank goes to sequence + (r - first rank)."""
    counts = counts.astype(np.int64).copy()
    used = np.zeros_like(counts)
    keys, firsts, offsets, sequence = [], [], [], 0
    while True:
        lengths = np.flatnonzero(counts)
        if not len(lengths):
            break
        sizes, left, gap, filled = lengths.tolist(), {}, capacity, []
        at = len(sizes)
        while gap and (at := bisect_right(sizes, gap, 0, at)):  # greedy: the largest that fits
            at -= 1
            n = min(int(counts[sizes[at]]), gap // sizes[at])
            filled += [sizes[at]] * n
            left[sizes[at]] = n
            gap -= n * sizes[at]
        if gap:  # take the smallest out if two others fill its place and the gap better
            free = counts[lengths] - np.array([left.get(x, 0) for x in sizes])
            some = free > 0
            a, b = _two(lengths[some], free[some], gap + filled[-1]) if some.any() else (0, 0)
            if a + b > filled[-1]:
                filled[-1:] = [a, b]
                left[a], left[b] = left.get(a, 0) + 1, left.get(b, 0) + 1
                if a == b:
                    left[a] = max(left[a], filled.count(a))
        times = min(int(counts[x]) // n for x, n in left.items())
        offset = 0
        for x in filled:
            keys.append(x << 40 | int(used[x]))
            firsts.append(sequence)
            offsets.append(offset)
            used[x] += times
            counts[x] -= times
            offset += x
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(firsts, np.int64)[order], np.array(offsets, np.int64)[order]


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows that have a `length` from 1 to capacity.

    items is read once and kept as a checkpoint.  Rows of one length are numbered
    in salted groups whose counts are summed before, so a length that a third of all rows share is
    spread over all tasks.  Ties and repeated rows are interchangeable: each gets its own place.
    An empty table gives an empty table.  Columns of items
    that are named like the new ones give way to them.  Raises ValueError for lengths outside 1..capacity.
    """
    spark, salts = items.sparkSession, partitions(items.sparkSession)
    columns = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    salt, count, ahead, rank, place = unused(items, 5)
    # by task and place, not by content: repeated rows are spread as well.  Written down, so that a lost task can't deal anew
    salted = cut(items.select(*map(quoted, columns)).withColumn(place, F.monotonically_increasing_id()).withColumn(salt, F.pmod(place, F.lit(salts)).cast("int")))
    by = salted.groupBy("length", salt).agg(F.count("*").alias(count))
    total = by.groupBy("length").agg(F.sum(count).alias("n")).collect()  # at most capacity rows
    if any(r["length"] is None or not 1 <= r["length"] <= capacity for r in total):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    for r in total:
        counts[r["length"]] = r["n"]
    placed = spark.sparkContext.broadcast(plan(counts, capacity))
    before = by.withColumn(ahead, F.sum(count).over(Window.partitionBy("length").orderBy(salt)) - F.col(count)).drop(count)
    number = F.row_number().over(Window.partitionBy("length", salt).orderBy(place)) - 1
    ranked = salted.withColumn(rank, number).join(before, ["length", salt]).select(*map(quoted, columns), (F.col(rank) + F.col(ahead)).alias(rank))

    def run(batches):
        keys, firsts, offsets = placed.value
        for batch in batches:
            rank = batch.column(len(columns)).to_numpy()
            key = batch.column(columns.index("length")).to_numpy().astype(np.int64) << 40 | rank
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(firsts[at] + key - keys[at]), pa.array(offsets[at])], names=[*columns, "sequence_id", "offset"])

    schema = items.select(*map(quoted, columns)).schema.add("sequence_id", "long").add("offset", "long")
    return mapped(ranked, run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack documents: where each piece goes, with a checksum of its ids.

    `pack` checkpoints the tokenised table: it is what a lost executor would otherwise cost.
    """
    return pack(pieces(docs, path, capacity), capacity)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (int32, little-endian), doc_ids in order.

    A sequence has at most `capacity` tokens, so each group is bounded.
    """
    placed = pack(pieces(docs, path, capacity, with_ids=True), capacity)
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return parts.select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
