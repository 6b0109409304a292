"""Near-duplicate documents: all pairs whose sets of five-word shingles have a Jaccard similarity of 0.8.

No pair is left to chance.  Sets of similarity t have at least ceil(t n) shingles of either's n in
common, so all but n - ceil(t n) of them must be shared by other texts.  That is
asked first of a part: of the n - ceil(t n) + 1 + m shingles with the smallest hashes at least
floor(t m) + 1 must be shared, since the other text's size differs by a factor of t at most.  Then
of the whole sets of the texts that are left.  Shingles of those have one order for all texts, from
rare to frequent by exact counts.  Of a set of n, the first n - ceil(t n) + 1 are its keys: similar
sets share at least one.  What two sets have in common stands, from the first key that they share, in
what is left of either; so that key allows partners up to a certain size only.  Texts that share a key
meet by their sizes, in classes, and only those that allow each other do.  A passage that many
documents share, and that is too little of each to make them similar, so makes no candidates.

What counts is which texts a chain of similar pairs connects, so pairs that are connected already
needn't be compared.  Most links are found cheaply first: SimHash anchors propose stars, and then
each key's texts meet one of them, as long as that finds links.  At last all pairs of a key that are
still apart are compared.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import chunks, cut, look_up, quoted
from .components import components

WORDS, SIMILAR = 5, 0.8
#: The part of a set that is asked first is larger by this share than the fewest that pairs must meet at.
MORE = 0.15
#: Most rounds in which the texts of a key meet one of them only: the smallest, then any.
STARS = 2


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different hashes of a text's shingles, sorted.  Words are those of `simhash.fingerprint`;
    fewer than a shingle has are one shingle, also none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    parts = [b" ".join(found)] if len(found) <= words else map(b" ".join, zip(*(found[k:] for k in range(words))))
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=simhash.SEED), parts), "<u8", max(1, len(found) - words + 1)))


def similar(x: np.ndarray, y: np.ndarray, similarity: float = SIMILAR) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _keys(texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """`key, node, size`: the first shingles of each text and the size of its set; of copies in one
    task only one's."""

    def run(batches):
        seen: set[int] = set()
        for batch in chunks(batches, 2 << 20):
            keys, nodes, sizes = [np.zeros(0, np.uint64)], [], []
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    found = shingles(t, words)
                    n = len(found)
                    keys.append(found[: n - math.ceil(similarity * n - 1e-9) + 1 + math.floor(MORE * n)])
                    nodes.append(node)
                    sizes.append(n)
            n = [len(k) for k in keys[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(nodes, n), pa.int64()), pa.array(np.repeat(sizes, n), pa.int64())], names=["key", "node", "size"])

    return texts.select("node", "text").mapInArrow(run, "key long, node long, size long")


def _shared(keys: DataFrame) -> DataFrame:
    """`key, node, size, df` of the keys that more than one node has, each once; df is how many rows have it."""
    shared = cut(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", "n", F.col("n").alias("df")), forget=True)
    return look_up(keys, shared, "key").repartition("node").groupBy("node", "key", "size").agg(F.min("df").alias("df"))


def _survivors(texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """`node` of the texts that share enough of their first shingles with others."""
    need = F.floor(F.lit(similarity) * F.floor(F.lit(MORE) * F.col("size") + F.lit(1e-9)) + F.lit(1e-9))
    return _shared(_keys(texts, similarity, words)).groupBy("node", "size").agg(F.count("*").alias("k")).filter(F.col("k") > need).select("node")


def _candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """`key, node, size, most`: the rarest shingles of each set, where at least two sets meet, and the
    size of the largest set that could be similar if this is the first key both have."""

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
            n = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(n, n), pa.int64())], names=["key", "node", "size"])

    by = Window.partitionBy("node")
    met = _shared(sets.select("node", "body").mapInArrow(run, "key long, node long, size long"))
    met = met.withColumns({"k": F.count("*").over(by), "r": F.row_number().over(by.orderBy("df", "key"))})
    left = F.col("k") - F.col("r") + 1  # what both have in common is among these
    keys = met.filter(left >= F.lit(similarity) * F.col("size") - F.lit(1e-9))
    most = F.least(F.floor(F.col("size") / similarity + 1e-9), F.floor(left * (1 + similarity) / similarity + 1e-9) - F.col("size"))
    return cut(keys.select("key", "node", "size", most.cast("long").alias("most")), forget=True)


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """`a, b` of the rows of `key, node, size, most, label` that share a key, allow each other's size, and
    have different labels: a row meets those of one class of sizes after another, from its least to its most."""
    level = lambda c: F.floor(F.log(1.02, c.cast("double")) + F.lit(1e-9))
    least = F.greatest(F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-9)), F.lit(1))
    asked = rows.select("key", F.explode(F.sequence(level(least), level(F.col("most")))).alias("level"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("most").alias("most_b"), F.col("label").alias("label_b"))
    held = rows.withColumn("level", level(F.col("size")))
    return held.join(asked, ["key", "level"]).filter("label < label_b and size <= most_b and size_b <= most").select(F.col("node").alias("a"), "b")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """`node, body, fp`: shingles as bytes, and the SimHash."""

    def run(batches):
        for batch in chunks(batches, 2 << 20):
            said = batch.column(1).to_pylist()
            bodies, fps = [shingles(t, words).tobytes() for t in said], [simhash.fingerprint(t, words) for t in said]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary()), pa.array(fps, pa.int64())], names=["node", "body", "fp"])

    return texts.select("node", "text").mapInArrow(run, "node long, body binary, fp long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets are similar."""

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(s, "<u8") for s in batch.column(k).to_pylist()] for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array([similar(*p, similarity) for p in zip(x, y)], pa.bool_()))

    each = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = each.join(sets.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _proposed(sets: DataFrame) -> DataFrame:
    """`a, b`: stars of equal SimHashes, and between those that differ in up to three bits."""
    prints = cut(sets.groupBy("fp").agg(F.min("node").alias("a")), forget=True)
    equal = sets.join(prints, "fp").select("a", F.col("node").alias("b"))
    ends = prints.select(F.col("fp").alias("b"), F.col("a").alias("other"))
    near = simhash.links(prints, 3).withColumnRenamed("a", "fp").join(prints, "fp").join(ends, "b").select("a", F.col("other").alias("b"))
    return equal.unionByName(near)


def connected(texts: DataFrame, similarity: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """`node, root` of the rows of `node, text` that are similar to another one: root is the smallest
    node that a chain of similar pairs reaches.  Rows of one node must have one text."""
    some = texts.join(cut(_survivors(texts, similarity, words), forget=True), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    sets = cut(_sets(some, words), forget=True)
    keys = _candidates(sets, similarity)
    sets = cut(sets.join(keys.select("node").distinct(), "node", "left_semi"), forget=True)
    links = cut(_verified(_proposed(sets), sets, similarity), forget=True)
    for turn in range(STARS + 1):
        label = components(links)
        at = cut(keys.join(label, "node", "left").select("key", "node", "size", "most", F.coalesce("root", "node").alias("label")), forget=True)
        first = F.col("size") if turn == 0 else F.xxhash64("node", F.lit(turn))  # the smallest set is similar to all that have a partner in a shared passage
        one = F.min(F.struct(first.alias("f"), F.xxhash64("node").alias("h"), "node", "size", "most", "label")).alias("p")
        apart = cut(at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), one).filter("lo <> hi").select("key", "n", "p"), forget=True)
        last = turn == STARS or (turn and not grew)
        if not last:
            pairs = look_up(at, apart, "key").filter("label <> p.label and size <= p.most and p.size <= most").select(F.col("node").alias("a"), F.col("p.node").alias("b"))
        else:
            pairs = _pairs(look_up(at, apart.select("key", "n", F.lit(1).alias("on")), "key").drop("on"), similarity)
        found = cut(_verified(pairs, sets, similarity), forget=True)
        links, grew = links.unionByName(found), not found.isEmpty()
        if last:
            return components(links)


def apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows of `doc_id, text, node` with other nodes where different texts had the same, and `node, first,
    n` of each text.  Texts are told apart by 128 bits; those whose 64 meet by chance (a few, at ten
    billion texts) are named anew."""
    while True:
        known = cut(rows.groupBy("node", F.xxhash64(F.lit(1), "text").alias("check")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), forget=True)
        twice = known.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("node", F.lit(True).alias("twice"))
        if twice.isEmpty():
            return rows, known.select("node", "first", "n")
        other = F.when(F.col("twice"), F.xxhash64("node", "text")).otherwise(F.col("node"))
        rows = rows.join(F.broadcast(cut(twice, forget=True)), "node", "left").withColumn("node", other).drop("twice")


def near_duplicates(docs: DataFrame, similarity: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """`doc_id, component_id` for every row of `doc_id, text`: the smallest doc_id that a chain of
    similar texts reaches, the row's own included; null only where no row of it has a doc_id."""
    said = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), said.alias("text")).withColumn("node", F.xxhash64("text"))
    rows, firsts = apart(rows)
    each = firsts.join(connected(rows, similarity, words), "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))
    least = each.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(each.join(least, "root").select("node", "component_id", "n"), forget=True)
    return look_up(rows.select("doc_id", "node"), named, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """The rows whose doc_id is the smallest of its component, with all their columns.

    Rows without a doc_id are kept: they can't be told apart.  Repeated rows of a kept doc_id stay.
    """
    drop = near_duplicates(docs, similarity, words).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*map(quoted, docs.columns))
