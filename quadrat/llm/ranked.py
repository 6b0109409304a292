"""Ranked lexical search by Fagin's threshold algorithm.

The terms of the query items are numbered, and each document keeps a forward row (how many
terms it has, and the numbers and counts of those that some item asks for).  That table is written
once; the corpus statistics are counted from it, over all documents.

Forward rows are then taken in shards.  A shard's postings are sorted into one list a term, best
impact first.  For an item, a block of each of its lists is read in turn (round-robin, each block
twice as long as the one before); a document met for the first time is looked up in the forward rows
and scored in full.  Whatever hasn't been met scores at most the sum of the impacts that the lists
have come down to.  As soon as that is strictly below the k-th best score, the shard is done: an equal
score could still win by its id.  The shards' best are merged.

Items are taken in blocks of bounded text, so what is sent to all tasks is bounded however many
items there are; each block of items is held against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut

#: Bytes of text of the items that are searched for at once, forward rows and postings of a shard, and a list's first block.
ITEMS, ROWS, POSTINGS, FIRST = 4 << 20, 32_768, 2 << 20, 32
#: Bytes of a text that are split at once.
PART = 1 << 20
_SEPARATORS = [b for b in range(128) if not chr(b).isalnum()]
_TABLE = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
FORWARD = "doc_id long, n long, ids binary, tfs binary"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, part by part: what stands between ASCII characters that are no letters or
    digits, with A-Z in lower case."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PART)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def asked(items: DataFrame, most: int = ITEMS) -> Iterator[dict[int, Counter]]:
    """Blocks of items with the repeats of their terms.  A block has at most `most` bytes of text, or
    a single item.  Repeated rows count once; different texts of one item_id are one item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id is not null").distinct()
    rows, n = cut(rows, forget=True), 1
    block = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    while True:
        sizes = rows.groupBy(block(n).alias("b")).agg(F.sum(F.octet_length("text")).alias("s"), F.count_distinct("item_id").alias("k"))
        if sizes.filter((F.col("s") > most) & (F.col("k") > 1)).isEmpty():
            break
        n *= 2
    for b in range(n):
        out: dict[int, Counter] = {}
        for r in rows.filter(block(n) == b).collect():
            held = out.setdefault(r["item_id"], Counter())
            for part in terms(r["text"]):
                held.update(part)
        if out:
            yield out


def forward(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """`doc_id, n, ids, tfs` for every row of `doc_id, text`: the number of its terms, and the sorted
    numbers of its known terms (int32) with their counts (int64)."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known = sent.value
        for batch in chunks(batches):
            ns, ids, tfs = [], [], []
            for text in batch.column(1).to_pylist():
                n, found = 0, []
                for part in terms(text):
                    n += len(part)
                    found.append(np.array([known[w] for w in part if w in known], np.int32))
                own, tf = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
                ns.append(n)
                ids.append(own.astype(np.int32).tobytes())
                tfs.append(tf.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FORWARD)


def holding(rows: DataFrame, n_terms: int) -> np.ndarray:
    """In how many rows each known term is."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            total += np.bincount(ids, minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["id", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():  # at most a row a known term
        out[r["id"]] = r["df"]
    return out


class Shard:
    """Forward rows with the impacts of their terms, and the same postings as impact-sorted lists."""

    def __init__(self, docs: np.ndarray, unnamed: np.ndarray, m: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray, n_terms: int):
        self.docs, self.unnamed, self.ids, self.starts = docs, unnamed, ids, np.r_[0, np.cumsum(sizes)]
        row = np.repeat(np.arange(len(docs)), sizes)
        self.impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[row])
        order = np.lexsort((-self.impact, ids))
        self.list_rows, self.list_impact = row[order], self.impact[order]
        self.lists = np.searchsorted(ids[order], np.arange(n_terms + 1))
        self.weight = np.zeros(n_terms, np.int64)

    def look_up(self, rows: np.ndarray) -> np.ndarray:
        """Scores of forward rows under the weights of the item that is asked."""
        size = self.starts[rows + 1] - self.starts[rows]
        before = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.starts[rows] - before, size)
        total = np.r_[0, np.cumsum(self.weight[self.ids[at]] * self.impact[at])]
        return total[before + size] - total[before]

    def top(self, wanted: np.ndarray, weights: np.ndarray, k: int, first: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows by (score, smaller doc), scores over 0 only."""
        some = weights > 0
        wanted, weights = wanted[some], weights[some]
        begin, end = self.lists[wanted], self.lists[wanted + 1]
        self.weight[wanted] = weights
        seen = np.zeros(len(self.docs), bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = begin.copy(), first
        while (open_ := at < end).any():
            to = np.minimum(at + step, end)
            met = np.unique(np.concatenate([self.list_rows[a:b] for a, b in zip(at[open_], to[open_])]))
            met = met[~seen[met]]
            seen[met] = True
            rows, scores = np.r_[rows, met], np.r_[scores, self.look_up(met)]
            best = np.lexsort((self.docs[rows], self.unnamed[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
            at, step = to, 2 * step
            left = at < end
            if len(rows) == k and int((weights[left] * self.list_impact[at[left] - 1]).sum()) < scores[-1]:
                break
        self.weight[wanted] = 0
        return rows[scores > 0], scores[scores > 0]


def _lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms, in integers; of Python's where 64 bits might not hold them."""
    n = n if 75 * int(n.max(initial=0)) * n_docs < 2**63 else n.astype(object)
    return (25 + 75 * n * n_docs // max(n_terms, 1)).astype(np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = 10, most: int = ITEMS, rows: int = ROWS, first: int = FIRST) -> DataFrame:
    """`item_id, rank, doc_id, score`: for each row of items(item_id, text) the k documents of
    docs(doc_id, text) that score highest, scores over 0 only, ties to the smaller doc_id.

    Null and empty texts have no terms; an item without terms, or without an item_id, has no results.
    Rows without a doc_id come after their equals, repeated rows each take a rank, other columns are
    ignored, and empty tables give an empty result.
    """
    spark, out = docs.sparkSession, None
    for block in asked(items, most):
        known = {w: i for i, w in enumerate(sorted(set().union(*block.values())))}
        if known:
            found = _search(docs, block, known, k, rows, first)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.select("item_id", rank.cast("int").alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def _search(docs: DataFrame, block: dict[int, Counter], known: dict[bytes, int], k: int, most_rows: int, first: int) -> DataFrame:
    index = cut(forward(docs, known), forget=True)
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding(index, len(known)).tolist()], np.int64)
    numbered = lambda c: np.array([known[t] for t in c], np.int64)
    wanted = {item: (numbered(c), w[numbered(c)] * np.array(list(c.values()), np.int64)) for item, c in block.items() if c}
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def best(held):
        whole = pa.Table.from_batches(held)
        docs, n = whole.column("doc_id").fill_null(0).to_numpy(), whole.column("n").to_numpy()
        unnamed = whole.column("doc_id").is_null().to_numpy()
        ids, tfs = (whole.column(c).to_pylist() for c in ("ids", "tfs"))
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        shard = Shard(docs, unnamed, _lengths(n, n_docs, n_terms), sizes, np.frombuffer(b"".join(ids), np.int32), np.frombuffer(b"".join(tfs), np.int64), len(w))
        found = [(item, *shard.top(at, weights, k, first)) for item, (at, weights) in sent.value.items()]
        rows = np.concatenate([x[1] for x in found])
        item = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(docs[rows], pa.int64(), mask=unnamed[rows]), pa.array(np.concatenate([x[2] for x in found]))], names=["item_id", "doc_id", "score"])

    def run(batches):
        held, n, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, most_rows):
                part = batch.slice(at, most_rows)
                size = part.column(2).nbytes // 4
                if held and (n + part.num_rows > most_rows or postings + size > POSTINGS):
                    yield best(held)
                    held, n, postings = [], 0, 0
                held.append(part)
                n, postings = n + part.num_rows, postings + size
        if held:
            yield best(held)

    return index.filter(F.octet_length("ids") > 0).mapInArrow(run, "item_id long, doc_id long, score long")
