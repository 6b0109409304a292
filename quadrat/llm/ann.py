"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search on it.

Equal vectors are one node, so a vector that a third of all rows share has one place in the graph.
The graph starts from small random-projection leaves: in each of `trees` partitions by the signs of
random projections, a node takes its nearest of its leaf.  Crowded leaves are split around their own mean,
and what no projection splits is salted, by tree, to a bounded size.  Then
NN-descent joins: every node's list and a sample of the nodes that list it meet at that node, and
those of its members that are nearer than what they have learn of each other.  Only pairs with an
entry that is new since the last round are compared.  Vectors travel as bytes with a scale; only
the search's scores are exact.

A query starts at its own node.  Each hop looks up the lists of the nearest nodes it has not yet
looked up, scores them in double precision and keeps the `beam` best, until none of those is left to
look up.  What has once fallen out of the beam can't come back, so the search ends.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .topk import finite

#: More than any number of trees; a leaf's number has its tree as the remainder.
TREES = 64
LIST = "node long, ids binary, sims binary, new binary"


def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id, v` (doubles) of rows that take part: finite, not null, not all zero, with an id."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & finite(F.col("v"))).filter(F.exists("v", lambda x: x != 0))


def _dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + coalesce(x, 0D))")


def _unpack(bodies: list[bytes], dims: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(bodies), np.uint8).reshape(len(bodies), dims + 4)
    scale = np.ascontiguousarray(raw[:, dims:]).view("<f4")
    v = raw[:, :dims].view(np.int8).astype(np.float32) * scale
    # the rounding of lengths would drown the differences within a tight cluster
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _lists(node, other, sim, new, width: int):
    """Flat entries as one packed row per node: the `width` best different ids; an entry that an
    old list has too is old."""
    order = np.lexsort((new, other, node))
    node, other, sim, new = node[order], other[order], sim[order], new[order]
    first = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])] if len(node) else np.zeros(0, bool)
    node, other, sim, new = node[first], other[first], sim[first], new[first]
    order = np.lexsort((other, -sim, node))
    node, other, sim, new = node[order], other[order], sim[order], new[order]
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
    ends = np.minimum(np.r_[starts[1:], len(node)], starts + width)
    cols = ([x[a:b].tobytes() for a, b in zip(starts, ends)] for x in (other, sim.astype(np.float32), new.astype(np.uint8)))
    return pa.RecordBatch.from_arrays([pa.array(node[starts], pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["node", "ids", "sims", "new"])


def _split(coded: DataFrame, dims: int, leaf: int, passes: int = 4, most: int = 10) -> DataFrame:
    """Leaves of more than `leaf` nodes, as tight clusters have them in every tree, split by random
    projections of their tree around the leaf's own mean.  What is still crowded is salted later."""

    def project(batches, turn):
        for batch in batches:
            leaves, v = batch.column(0).to_numpy(), _unpack(batch.column(2).to_pylist(), dims)
            out = np.zeros((len(v), most), np.float32)
            for t in np.unique(leaves % TREES):
                at = leaves % TREES == t
                out[at] = v[at] @ np.random.default_rng([19, turn, int(t)]).standard_normal((dims, most)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.float32()))], names=["leaf", "node", "body", "p"])

    done = None
    for turn in range(passes):
        sizes = cut(coded.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > leaf))
        if sizes.isEmpty():
            break
        small = coded.join(sizes, "leaf", "left_anti")
        done = small if done is None else done.unionByName(small)
        crowded = coded.join(sizes.select("leaf"), "leaf", "left_semi").select("leaf", "node", "body")
        cast = cut(crowded.mapInArrow(lambda batches, turn=turn: project(batches, turn), "leaf long, node long, body binary, p array<float>"))
        means = cast.groupBy("leaf").agg(F.array(*(F.avg(F.col("p")[k]) for k in range(most))).alias("m")).join(sizes, "leaf")
        means = means.select("leaf", "m", F.least(F.lit(most), F.ceil(F.log2(F.col("n") / leaf))).cast("int").alias("depth"))
        sides = F.concat(*(F.when((F.col("depth") > k) & (F.col("p")[k] > F.col("m")[k]), "1").otherwise("0") for k in range(most)))
        # a leaf's number keeps its tree as the remainder
        coded = cut(cast.join(means, "leaf").select((F.shiftright(F.xxhash64("leaf", sides), 16) * TREES + F.pmod("leaf", F.lit(TREES))).alias("leaf"), "node", "body"))
    return coded if done is None else done.unionByName(coded)


def _leaves(nodes: DataFrame, dims: int, trees: int, bits: int, leaf: int, width: int) -> DataFrame:
    """First lists, from random-projection leaves."""

    def code(batches):
        planes = np.random.default_rng(17).standard_normal((trees, dims, bits)).astype(np.float32)
        for batch in batches:
            v = _unpack(batch.column(1).to_pylist(), dims)
            for t in range(trees):
                codes = ((v @ planes[t]) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes * TREES + t), batch.column(0), batch.column(1)], names=["leaf", "node", "body"])

    coded = _split(cut(nodes.mapInArrow(code, "leaf long, node long, body binary")), dims, leaf)
    parts = coded.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(leaf)).alias("parts"))
    dealt = coded.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("node", "leaf"), F.col("parts"))).select("leaf", "part", "node", "body")

    def nearest(key, table):
        node, v = table.column("node").to_numpy(), _unpack(table.column("body").to_pylist(), dims)
        k, got = min(width, len(node) - 1), []
        for at in range(0, len(node) if k > 0 else 0, 512):
            sims = v[at : at + 512] @ v.T
            sims[np.arange(len(sims)), at + np.arange(len(sims))] = -np.inf
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            got.append((np.repeat(node[at : at + 512], k), node[top].ravel(), np.take_along_axis(sims, top, 1).ravel()))
        flat = [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        return pa.Table.from_batches([_lists(*flat, np.ones(len(flat[0]), np.uint8), width)])

    return dealt.groupBy("leaf", "part").applyInArrow(nearest, LIST)


def _merged(lists: DataFrame, width: int) -> DataFrame:
    """One list per node.  A node has a bounded number of lists: one a leaf or a join."""
    held = lists.groupBy("node").agg(F.collect_list(F.struct("ids", "sims", "new")).alias("l"))

    def merge(batches):
        for batch in batches:
            flat = [[], [], [], []]
            for node, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in some:
                    ids = np.frombuffer(x["ids"], np.int64)
                    for c, values in zip(flat, (np.full(len(ids), node), ids, np.frombuffer(x["sims"], np.float32), np.frombuffer(x["new"], np.uint8))):
                        c.append(values)
            yield _lists(*(np.concatenate(c) if c else np.zeros(0, np.int64) for c in flat), width)

    return held.mapInArrow(merge, LIST)


def _descend(lists: DataFrame, nodes: DataFrame, dims: int, width: int, reverse: int, learn: int, turn: int) -> DataFrame:
    """One round: what members of the same neighbourhood learn of each other, and all lists as old."""

    def flatten(batches):
        for batch in batches:
            node, ids = batch.column(0).to_numpy(), [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            n = [len(x) for x in ids]
            new = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, n)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), pa.array(new.astype(np.int32))], names=["owner", "member", "new"])

    edges = lists.mapInArrow(flatten, "owner long, member long, new int")
    back = edges.select(F.col("member").alias("owner"), F.col("owner").alias("member"), "new")
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("new"), F.xxhash64("owner", "member", F.lit(turn)), "member"))
    back = back.withColumn("p", place).filter(F.col("p") <= reverse).drop("p")
    worst = lists.select(F.col("node").alias("member"), F.col("sims"), (F.length("ids") / 8).cast("int").alias("n"))
    known = worst.join(nodes.select(F.col("node").alias("member"), "body"), "member").select("member", F.when(F.col("n") >= width, F.expr("substring(sims, -4, 4)")).alias("worst"), "body")
    met = edges.unionByName(back).join(known, "member").groupBy("owner").agg(F.collect_list(F.struct("member", "new", "worst", "body")).alias("m"))

    def join(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield _lists(*meet(batch.column(1).slice(at, 256).to_pylist()), learn * 64)

    def meet(groups):
        out = [[], [], []]
        for group in groups:
            seen = {}
            for x in group:
                if x["member"] not in seen or x["new"] > seen[x["member"]]["new"]:
                    seen[x["member"]] = x
            group = list(seen.values())
            new = np.array([x["new"] for x in group], bool)
            if len(group) < 2 or not new.any():
                continue
            ids = np.array([x["member"] for x in group])
            worst = np.array([np.frombuffer(x["worst"], "<f4")[0] if x["worst"] is not None else -2 for x in group], np.float32)
            v = _unpack([x["body"] for x in group], dims)
            sims = v @ v.T
            sims[~(new[:, None] | new[None, :])] = -3
            np.fill_diagonal(sims, -3)
            k = min(learn, len(ids) - 1)
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(sims, top, 1)
            row, col = np.nonzero(value > worst[:, None] + 1e-6)
            for c, x in zip(out, (ids[row], ids[top[row, col]], value[row, col])):
                c.append(x)
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return *flat, np.ones(len(flat[0]), np.uint8)

    old = lists.withColumn("new", F.expr("cast(repeat('\\0', cast(length(ids) / 8 as int)) as binary)"))
    return _merged(old.unionByName(met.mapInArrow(join, LIST)), width)


def start(nodes: DataFrame, dims: int, width: int = 40, trees: int = 4, leaf: int = 128) -> DataFrame:
    """First lists of `node, body`, from small leaves: most of what they hold is far from the nearest."""
    n = nodes.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    return cut(_merged(_leaves(nodes, dims, trees if bits else 1, bits, leaf, width), width))


def changed(lists: DataFrame) -> float:
    """The share of entries that came in with the last round."""
    ones = F.expr("length(replace(hex(new), '0', ''))")  # a byte an entry, 00 or 01
    row = lists.agg(F.sum(ones).alias("new"), F.sum(F.length("new")).alias("all")).first()
    return (row["new"] or 0) / max(row["all"] or 0, 1)


def graph(nodes: DataFrame, dims: int, width: int = 40, trees: int = 4, leaf: int = 128, settled: float = 0.02, reverse: int = 16, learn: int = 4) -> DataFrame:
    """The neighbour graph of `node, body` as packed lists.  nodes must be a checkpoint.

    Rounds of NN-descent go on, at every size, until at most `settled` of all entries are new in one.
    An entry only ever gives way to a nearer one, so they end.
    """
    lists, turn = start(nodes, dims, width, trees, leaf), 0
    while changed(lists) > settled:
        lists, turn = cut(_descend(lists, nodes, dims, width, reverse, learn, turn)), turn + 1
    return lists


def search(vectors: DataFrame, is_query: Column, k: int = 5, width: int = 40, beam: int = 128, ahead: int = 32, **how) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k nearest found of each query by cosine, its own row
    left out, nearest first, ties to the smaller vec_id.

    Vectors that are null, zero, or hold a null or a non-finite component take no part.  Missing
    components count as 0.  An id that is repeated with one vector counts once.  With fewer than k
    other rows all are returned; an empty table gives an empty result.
    """
    rows = usable(vectors)
    classes = cut(rows.groupBy("v").agg(F.min("vec_id").alias("node")).withColumn("norm", F.sqrt(_dot("v", "v"))))
    dims = max(1, classes.agg(F.max(F.size("v"))).first()[0] or 1)

    def body(batches):
        for batch in batches:
            v = np.zeros((batch.num_rows, dims))
            for row, x in zip(v, batch.column(1).to_pylist()):
                row[: len(x)] = x
            v /= np.abs(v).max(axis=1, keepdims=True)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            scale = np.abs(v).max(axis=1, keepdims=True) / 127
            packed = np.concatenate([np.rint(v / scale).astype(np.int8).view(np.uint8), scale.astype("<f4").view(np.uint8)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed])], names=["node", "body"])

    nodes = cut(classes.select("node", "v").mapInArrow(body, "node long, body binary"))
    lists = graph(nodes, dims, width, **how)

    def flatten(batches):
        for batch in batches:
            ids = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["node", "ids"])

    links = cut(lists.mapInArrow(flatten, "node long, ids array<long>"))
    # all rows of a query's class ask the same question; the class asks it once
    askers = rows.filter(is_query).select("vec_id", "v").distinct()
    asked = cut(askers.join(classes, "v").select(F.col("vec_id").alias("query_id"), "node"))
    asking = classes.join(asked.select("node").distinct(), "node").select(F.col("node").alias("q"), F.col("v").alias("qv"), F.col("norm").alias("qn"))
    reached = cut(asking.select("q", F.col("q").alias("node"), (_dot("qv", "qv") / (F.col("qn") * F.col("qn"))).alias("score"), F.lit(False).alias("open")))
    frontier = reached.select("q", "node")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    while not frontier.isEmpty():
        near = frontier.join(links, "node").select("q", F.explode("ids").alias("node")).distinct().join(reached.select("q", "node"), ["q", "node"], "left_anti")
        scored = near.join(asking, "q").join(classes.select("node", "v", "norm"), "node").select("q", "node", (_dot("qv", "v") / (F.col("qn") * F.col("norm"))).alias("score"), F.lit(True).alias("open"))
        kept = reached.unionByName(scored).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= beam).drop("r")
        turn = F.row_number().over(Window.partitionBy("q", "open").orderBy(F.desc("score"), "node"))
        kept = cut(kept.withColumn("go", F.col("open") & (turn <= ahead)))
        frontier = kept.filter("go").select("q", "node")
        reached = kept.select("q", "node", "score", (F.col("open") & ~F.col("go")).alias("open"))
    # k + 1 smallest ids of a class: no query can return more of them
    alike = rows.join(classes.select("v", "node"), "v").select("node", "vec_id").distinct()
    alike = alike.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("r") <= k + 1).select("node", "vec_id")
    found = asked.withColumnRenamed("node", "q").join(reached.select("q", "node", "score"), "q").join(alike, "node").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
