"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits that differ in at most three places differ in at most one place of one
of their halves.  Of each half, 31 bits are compared with the words of the Hamming code of that
length, which covers every word within radius 1.  Those code words are the anchors.  A fingerprint
is replicated to every anchor within radius 1 + threshold 1 = 2: one, if it is a code word itself,
else sixteen.  So a pair within the threshold always meets at the anchor that covers either of
them, and there are 2 x 2^26 anchors, so that few others do.  What shares an anchor is compared in
full.  Only different fingerprints are replicated: copies of a text are one fingerprint.

An anchor that many near copies share is cut into blocks, and each pair of blocks is one group of
at most 2 x BLOCK rows.  A group returns a star for each of its components, never its pairs.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, look_up, quoted
from .components import components

BLOCK = 2048
SMALL = 32
SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit SimHash of a text; 0 without words.  See `fingerprints`."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if len(found) < words:
        shingles, n = [b" ".join(found)] if found else [], bool(found)
    else:
        shingles, n = map(b" ".join, zip(*(found[k:] for k in range(words)))), len(found) - words + 1
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):  # bytes hold counts up to 255
        part = hashes[at : at + 255 * 256]
        bits = np.zeros((-(-len(part) // 255) * 255, 64), np.uint8)
        bits[: len(part)] = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """`doc_id, fp` of whole texts: lower-cased A-Z, words between ASCII blanks, shingles with
    repeats, XXH64 with seed 42; a bit is set if it is in over half of the hashes.

    Fewer words than a shingle has: the whole sequence is the shingle.  No words or a null text:
    zero.  Null and repeated doc_ids are kept; other columns are ignored.
    """
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in chunks(batches):
            fps = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], schema=out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (half << 32 | code word) within radius 2 of each half, and each one's row of fps."""
    places = np.arange(32, dtype=np.uint32)
    keys, rows = [], []
    for half in (0, 1):
        word = (fps.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32) & np.uint32(0x7FFFFFFF)
        syndrome = np.zeros(len(word), np.uint32)
        for k in range(31):  # place k + 1 is bit k
            syndrome ^= np.where(word >> np.uint32(k) & 1, np.uint32(k + 1), np.uint32(0))
        other = places[None, :] ^ syndrome[:, None]  # flips i and i ^ s lead to a code word; 0 is no flip
        use = places[None, :] < other
        use[:, 0] |= syndrome == 0
        flip = lambda i: np.where(i > 0, np.uint32(1) << (np.maximum(i, 1) - 1).astype(np.uint32), np.uint32(0))
        codes = word[:, None] ^ flip(places)[None, :] ^ flip(other)
        use &= (syndrome != 0)[:, None] | (places == 0)[None, :]
        row, col = np.nonzero(use)
        keys.append(codes[row, col].astype(np.int64) | half << 32)
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is linked to by the pairs a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _reach(fps: np.ndarray, threshold: int) -> np.ndarray:
    """The first row of each row's component, for one large group, without listing its pairs."""
    root, left = np.full(len(fps), -1), np.arange(len(fps))
    while len(left):
        first, wave, left = left[0], left[:1], left[1:]
        root[first] = first
        while len(wave) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(wave), 256):
                near |= (np.bitwise_count(fps[wave[at : at + 256], None] ^ fps[None, left]) <= threshold).any(axis=0)
            wave, left = left[near], left[~near]
            root[wave] = first
    return root


def _stars(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from rows to the first row of their component; rows of a group stand together."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    size = np.diff(np.r_[starts, len(keys)])
    group = np.repeat(np.arange(len(starts)), size)
    small = (size <= SMALL)[group]
    a, b = [], []
    for off in range(1, min(SMALL, int(size.max()))):
        i = np.flatnonzero((group[off:] == group[:-off]) & small[off:])
        i = i[np.bitwise_count(fps[i] ^ fps[i + off]) <= threshold]
        a.append(i)
        b.append(i + off)
    root = _roots(len(fps), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(fps))
    for k in np.flatnonzero(size > SMALL):
        at = slice(starts[k], starts[k] + size[k])
        root[at] = starts[k] + _reach(fps[at], threshold)
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def links(distinct: DataFrame, threshold: int = 2, block: int = BLOCK) -> DataFrame:
    """`a, b`: stars that connect just those different `fp` that a chain of links connects."""
    if not 0 <= threshold <= 3:
        raise ValueError("halves with one difference cover thresholds up to 3")

    def replicate(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.column(0).slice(at, 20_000).to_numpy()
                keys, rows = anchors(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["anchor", "fp"])

    def compare(batches):
        held = None
        for batch in batches:
            now = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            now = now if held is None else np.concatenate([held, now])
            last = np.flatnonzero((now[:, :3] != now[-1, :3]).any(axis=1))
            end = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            if end:
                yield star(now[:end])
            held = now[end:]
        if held is not None and len(held):
            yield star(held)

    def star(rows):
        a, b = _stars(rows[:, :3], np.ascontiguousarray(rows[:, 3]).view(np.uint64), threshold)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    by = Window.partitionBy("anchor").orderBy("fp")
    met = (
        distinct.select("fp").mapInArrow(replicate, "anchor long, fp long")
        .select("*", (F.row_number().over(by) - 1).cast("long").alias("k"), F.count("*").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
        .filter("n > 1")
    )
    mine = F.floor(F.col("k") / block).cast("long")
    pairs = met.select("anchor", "fp", mine.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block).cast("long"))).alias("y"))
    pairs = pairs.select("anchor", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "fp")
    dealt = pairs.repartition("anchor", "x", "y").sortWithinPartitions("anchor", "x", "y", "fp")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = 2, words: int = 3) -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row of `doc_id, text`.

    component_id is the smallest doc_id reached over links of at most `threshold` differing bits,
    the row's own included; null only where no row of the component has a doc_id.  Rows that share
    a doc_id stay apart.  An empty table gives an empty one.
    """
    rows = cut(fingerprints(docs, words))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    member = components(links(distinct, threshold))
    joined = member.join(distinct, member.node == distinct.fp).select("node", "root", "first")
    named = cut(joined.groupBy("root").agg(F.min("first").alias("least")))
    linked = joined.join(named, "root").select(F.col("node").alias("fp"), "least")
    each = cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n"))
    return look_up(rows, each, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = 2, words: int = 3) -> DataFrame:
    """The rows whose doc_id is the smallest of its component, with all their columns.

    Rows without a doc_id are kept: they can't be told apart.  Repeated rows of a kept doc_id stay.
    """
    drop = near_duplicates(docs, threshold, words).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*map(quoted, docs.columns))
