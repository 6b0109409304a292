"""Alignment of two tokenizers' tokens on packed bitsets of token ends.

A set bit at byte i says that a token ends with that byte.  The ends of both tokenizers are two
bitsets over the same bytes.  Their AND is the shared cuts, which end the groups; running popcounts
rank any byte among the tokens of either side, so cuts map to ranges of tokens.  Their OR are the
ends of the pieces that both sides cut the text into: each piece is the overlap of one token of A and
one of B, so it is one link, and the ranks of its last byte name its two tokens.

How many documents hold a pair of ids linked is counted per task first, so that frequent pairs are
summed where they are.  The counts come back the other way round: the most frequent pairs, at most
`SENT` of them by a histogram of the counts, are sent to all tasks, which hold them against the
documents' own pairs; only the rest is joined.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, look_up
from .tokens import byte_bpe, byte_pieces, path, piece_bpe, piece_bytes

#: Most pairs that are sent to all tasks, and pairs that a task gathers before it sums them.
SENT, GATHERED = 400_000, 1 << 22
BITS = 64


class Ends:
    """The ends of tokens over `size` bytes as a packed bitset, with running popcounts for rank."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def of(cls, lengths: np.ndarray, size: int) -> Ends:
        marks = np.zeros(-(-max(size, 1) // BITS) * BITS, np.uint8)
        marks[np.cumsum(lengths) - 1] = 1
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many tokens end before byte `at`: the number of the token that holds it."""
        word, bit = at // BITS, (at % BITS).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """All marked bytes, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of byte lengths of the tokens of A and B over the same bytes: how many tokens of A and of B end
    with each shared cut or before it, and the numbers of the tokens of each link."""
    size = int(a.sum())
    ends_a, ends_b = Ends.of(a, size), Ends.of(b, size)
    cuts = Ends(ends_a.words & ends_b.words).select()
    pieces = Ends(ends_a.words | ends_b.words).select()
    return ends_a.rank(cuts) + 1, ends_b.rank(cuts) + 1, ends_a.rank(pieces), ends_b.rank(pieces)


@lru_cache(maxsize=2)
def _written(n_a: int, n_b: int) -> list[bytes]:
    """Ids of A, then of B, as decimal text, three times: before a comma, at a group's middle, at its end."""
    return [b"%d" % i + sign for sign in (b",", b"|", b";") for n in (n_a, n_b) for i in range(n)]


def groups_text(a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, n_a: int, n_b: int) -> bytes:
    """`a1,a2|b1;a3|b2,b3` of ids and of how many tokens are in the groups up to each."""
    code = np.empty(len(a) + len(b), np.int64)
    size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    at_a = np.arange(len(a)) + np.repeat(upto_b - size_b, size_a)
    at_b = np.arange(len(b)) + np.repeat(upto_a, size_b)
    every = n_a + n_b
    code[at_a], code[at_b] = a, b + n_a
    code[at_a[upto_a - 1]] += every  # the last of A in a group
    code[at_b[upto_b - 1]] += 2 * every
    names = _written(n_a, n_b)
    return b"".join([names[c] for c in code.tolist()])[:-1]


DOCUMENT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of `row, doc_id, text`, with its different pairs of linked ids, sorted (id of A x
    size of B's vocabulary + id of B, unsigned of 32 bits if those hold it) and their occurrences."""

    def run(batches):
        tokens_a, bytes_a, tokens_b, bytes_b = byte_bpe(a_path), byte_pieces(a_path), piece_bpe(b_path), piece_bytes(b_path)
        length_a, length_b = (np.array([len(x) for x in pieces]) for pieces in (bytes_a, bytes_b))
        spelt = lambda ids, pieces: b"".join([pieces[i] for i in ids.tolist()])
        n_a, n_b = len(bytes_a), len(bytes_b)
        kind = np.uint32 if n_a * n_b < 2**32 else np.uint64
        nothing = (0, 0, 0, 0, "", b"", b"")
        for batch in chunks(batches, column=2):
            rows = []
            for text in batch.column(2).to_pylist():
                said = f" {text}".encode() if text else b""
                a, b = (tokens_a(f" {text}"), tokens_b(text)) if text else ((), ())
                if not text or spelt(a, bytes_a) != said or spelt(b, bytes_b) != said:
                    rows.append(nothing)
                    continue
                upto_a, upto_b, link_a, link_b = align(length_a[a], length_b[b])
                pairs, times = np.unique(a[link_a] * n_b + b[link_b], return_counts=True)
                digest = hashlib.sha256(groups_text(a, b, upto_a, upto_b, n_a, n_b)).hexdigest()
                rows.append((len(a), len(b), len(upto_a), len(link_a), digest, pairs.astype(kind).tobytes(), times.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2))], names=[x.split()[0] for x in DOCUMENT.split(", ")])

    return docs.select("row", "doc_id", "text").mapInArrow(run, DOCUMENT)


def _unpacked(batch: pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, occurrences, and how many pairs each row has."""
    pairs, times = (batch.column(c).to_pylist() for c in ("pairs", "times"))
    n = np.fromiter((len(x) // 4 for x in times), np.int64, len(times))
    return np.frombuffer(b"".join(pairs), kind).astype(np.int64), np.frombuffer(b"".join(times), np.uint32).astype(np.int64), n


def pair_counts(found: DataFrame, kind, gathered: int = GATHERED) -> DataFrame:
    """`pair, n`: in how many documents each pair is linked."""

    def run(batches):
        held, size = [], 0
        for batch in chunks(batches, 4 << 20, 0):
            held.append(_unpacked(batch, kind)[0])
            size += len(held[-1])
            if size >= gathered:
                pair, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                held, size = [], 0
        if size:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return found.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> Column:
    """Whether a pair is one of at most `most` that are the most frequent, whole ties in or out.

    Only a histogram of the counts is collected: exact ones up to 1,024, eighths of powers of two above."""
    level = F.when(F.col("n") <= 1024, F.col("n")).otherwise(F.ceil(F.log2("n") * 8) + 1024)
    total, border = 0, None
    for r in counts.groupBy(level.cast("long").alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():  # at most 1,500 rows
        total += r["k"]
        if total > most:
            break
        border = r["least"]
    return F.lit(False) if border is None else F.col("n") >= border


def links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, sent: int = SENT) -> DataFrame:
    """`doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` for every row of `doc_id, text`.

    A is byte-level BPE over a blank and the text, B is a SentencePiece model over the text (it adds
    the blank); special tokens' strings are plain text for both.  n_best counts the links whose pair's
    count is the highest that its id of A has, ties included; count_sum adds the counts of all links.
    A null or empty text, or one that the tokens of A or B don't spell byte by byte, has no tokens:
    zeros and ''.  Repeated rows are documents of their own, a null doc_id stays null, other columns
    are ignored, an empty table gives an empty one.
    """
    a_path, b_path = a_path or path("byte_bpe_50k.json"), b_path or path("piece_bpe_32k.model")
    n_b = len(piece_bytes(b_path))
    kind = np.uint32 if len(byte_pieces(a_path)) * n_b < 2**32 else np.uint64
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(documents(rows, a_path, b_path), forget=True)  # the row numbers are written down with the tokens
    counts = cut(pair_counts(found, kind), forget=True)
    highest = counts.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("n").alias("top"))  # at most as many as A has ids
    best = counts.withColumn("a", F.floor(F.col("pair") / n_b)).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    best = cut(best, forget=True)
    often = frequent(best, sent)
    few = best.filter(often).select("pair", "n", "best").toPandas().sort_values("pair")  # at most `sent` rows
    known = docs.sparkSession.sparkContext.broadcast((few["pair"].to_numpy(np.int64), few["n"].to_numpy(np.int64), few["best"].to_numpy(bool)))

    def held(batches):
        pair, n, best = known.value
        for batch in chunks(batches, 4 << 20, column=7):
            mine, times, size = _unpacked(batch, kind)
            at = np.searchsorted(pair, mine)
            on = np.append(pair, -1)[at] == mine
            counted, good = np.append(n, 0)[at] * on * times, np.append(best, False)[at] * on * times
            upto = np.r_[0, np.cumsum(size)]
            sums = [np.r_[0, np.cumsum(x)] for x in (good, counted)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(7)), *(pa.array(x[upto[1:]] - x[upto[:-1]]) for x in sums)], names=[*batch.schema.names[:7], "n_best", "count_sum"])

    def rest(batches):
        pair, _, _ = known.value
        for batch in chunks(batches, 4 << 20):
            mine, times, size = _unpacked(batch, kind)
            off = np.append(pair, -1)[np.searchsorted(pair, mine)] != mine
            row = np.repeat(batch.column("row").to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(row[off]), pa.array(mine[off]), pa.array(times[off])], names=["row", "pair", "times"])

    done = found.mapInArrow(held, DOCUMENT.replace("pairs binary, times binary", "n_best long, count_sum long"))
    seldom = look_up(found.select("row", "pairs", "times").mapInArrow(rest, "row long, pair long, times long"), best.filter(~often), "pair", keep="n")
    more = seldom.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long").alias(a)
    return done.join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")
