"""Language-model scoring by masked pseudo-likelihood.

Every word of a document is predicted from two words on each of its sides.  The vocabulary is that
of the whole corpus: a Spark table of one row per different word (as a 64-bit hash) with its count,
which grows with the input.  The HEAD most frequent words are classes of their own; every other word
belongs to the class of its frequency band and form (digits, letters beyond ASCII, punctuation at
the end, length).  A network with one hidden layer predicts a word's class from the classes in its
window, with an embedding of each class for each place; the word follows by its count in its class.

Documents are coded once, in chunks: a chunk has the ids of its words and asks for each of its
different words once, so a word that is everywhere has one row a chunk, and no key is hot.  The
network is trained in numpy inside the tasks: each runs through its own chunks from the same start,
and the weights are averaged by how many words they have seen, in rounds.  Words with equal classes
around them are brought together, as the network says the same of them.  Sums of weights are
folded over partitions until a few are left, so the driver sees a bounded number of them.

A document doesn't help to predict itself: its own occurrences are taken off a word's count.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut

HEAD, BANDS, FORMS = 128, 16, 6
CLASSES = HEAD + BANDS * FORMS
EDGE = CLASSES  # what stands before the first and behind the last word
PLACES = (-2, -1, 1, 2)
HIDDEN = 24
#: What is added to the count of each word of a class.
SMOOTH = 0.1
_WORD = re.compile(rb"\S+")
_DIGITS = frozenset(b"0123456789")
_ONES = np.ones(CLASSES, np.float32)


def words(text: str | None) -> list[bytes]:
    """The words between ASCII white space, lower-cased."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    return raw.split() if len(raw) < 1 << 22 else [m.group() for m in _WORD.finditer(raw)]


def form(word: bytes) -> int:
    if not _DIGITS.isdisjoint(word):
        return 0
    if not word.isascii():
        return 1
    if not word[-1:].isalnum():
        return 2
    return 3 + (len(word) > 4) + (len(word) > 8)


def key(word: bytes) -> int:
    """A 64-bit hash of which the lowest three bits are the word's form."""
    return (xxhash.xxh64_intdigest(word, 7) & ~7 | form(word)) - (1 << 63)


def coded(docs: DataFrame) -> DataFrame:
    """`chunk, doc_ids, sizes, locals, keys, counts`: a row per some megabytes of text.  locals has the
    place in keys of each word of the chunk, one document after the other, compressed."""

    def run(batches):
        for batch in chunks(batches, 16 << 20):
            seen: dict[bytes, int] = {}
            sizes, places = [], []
            for text in batch.column(1).to_pylist():
                some = words(text)
                sizes.append(len(some))
                places.append(np.fromiter((seen.setdefault(w, len(seen)) for w in some), np.uint32, len(some)))
            local = np.concatenate(places)
            counts = np.bincount(local, minlength=len(seen)).astype(np.int64)
            keys = np.fromiter(map(key, seen), np.int64, len(seen))
            blob = pa.compress(local.tobytes(), codec="zstd", asbytes=True)
            rows = [[batch.column(0).to_pylist()], [sizes], [blob], [keys], [counts]]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["doc_ids", "sizes", "locals", "keys", "counts"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = rows.mapInArrow(run, "doc_ids array<long>, sizes array<long>, locals binary, keys array<long>, counts array<long>")
    return cut(made.select(F.monotonically_increasing_id().alias("chunk"), "*"), forget=True)


def vocabulary(asked: DataFrame) -> DataFrame:
    """`word, n, class` of each different word of `word, n` rows.  Ties at the head go to the smaller hash."""
    counts = cut(asked.groupBy("word").agg(F.sum("n").alias("n")), forget=True)
    top = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(HEAD).collect()]
    head = counts.sparkSession.createDataFrame(list(zip(top, range(HEAD))), "word long, head int")
    band = F.least(F.lit(BANDS - 1), ((F.length(F.bin("n")) - 1) / 2).cast("int"))
    tail = HEAD + band * FORMS + F.col("word").bitwiseAND(F.lit(7)).cast("int")
    return counts.join(F.broadcast(head), "word", "left").select("word", "n", F.coalesce("head", tail).alias("class"))


def window(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Classes at PLACES around each word, EDGE outside its document: a row per word."""
    n, ends = len(classes), np.cumsum(sizes)
    out = np.full((n, len(PLACES)), EDGE, np.uint8)
    for k, d in enumerate(PLACES):
        left, right = max(-d, 0), max(d, 0)
        if n > left + right:
            out[left : n - right, k] = classes[right : n - left]
        for j in range(left + right):  # these look over the edge of their document
            at = ends - 1 - j if d > 0 else ends - sizes + j
            out[at[sizes > j], k] = EDGE
    return out


def alike(around: np.ndarray, piece: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of around, equal rows side by side, and where each different row begins, and the
    end; in pieces, to hold little at once."""
    for low in range(0, len(around), piece):
        some = np.ascontiguousarray(around[low : low + piece]).view(np.uint32).ravel().astype(np.uint64)
        some <<= np.uint64(32)
        some |= np.arange(low, low + len(some), dtype=np.uint64)
        some.sort()
        at = (some & np.uint64((1 << 32) - 1)).astype(np.int64)
        some >>= np.uint64(32)
        yield at, np.concatenate([[0], np.flatnonzero(some[1:] != some[:-1]) + 1, [len(some)]])


@dataclass
class Network:
    """Embeddings [place, class, hidden] and output weights [hidden + 1, class], of which the last row
    is the bias."""

    inner: np.ndarray
    outer: np.ndarray

    @classmethod
    def start(cls, totals: np.ndarray, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        inner = 0.1 * rng.standard_normal((len(PLACES), CLASSES + 1, HIDDEN))
        outer = 0.1 * rng.standard_normal((HIDDEN, CLASSES))
        prior = np.log((totals + 1) / (totals.sum() + CLASSES))
        return cls(inner.astype(np.float32), np.vstack([outer, prior]).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.inner.ravel(), self.outer.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        at, flat = len(PLACES) * (CLASSES + 1) * HIDDEN, flat.astype(np.float32)
        return cls(flat[:at].reshape(len(PLACES), CLASSES + 1, HIDDEN), flat[at:].reshape(HIDDEN + 1, CLASSES))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """The hidden layer of each row, and a column of ones for the bias."""
        total = self.inner[0].take(around[:, 0], axis=0)
        for k in range(1, len(PLACES)):
            total += self.inner[k].take(around[:, k], axis=0)
        out = np.ones((len(around), HIDDEN + 1), np.float32)
        np.tanh(total, out=out[:, :HIDDEN])
        return out

    def own_logp(self, around: np.ndarray, own: np.ndarray, block: int = 1024) -> np.ndarray:
        """log P of each word's own class.  What words with equal classes around them share is computed
        once, in blocks that stay in the processor's cache."""
        out = np.empty(len(own))
        for at, bounds in alike(around):
            for k in range(0, len(bounds) - 1, block):
                some = bounds[k : k + block + 1]
                z, here = self.hidden(around[at[some[:-1]]]) @ self.outer, at[some[0] : some[-1]]
                z -= z.max(axis=1, keepdims=True)
                row = np.repeat(np.arange(len(z)), np.diff(some))
                mine = z[row, own[here]]
                out[here] = mine - np.log(np.exp(z, out=z) @ _ONES)[row]
        return out

    def logp(self, around: np.ndarray) -> np.ndarray:
        """log P(class) for each row of classes around a word, in double precision."""
        z = self.hidden(around).astype(np.float64) @ self.outer
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class Trainer:
    """Adam on batches of (classes around, own classes of the words there, how many those are)."""

    def __init__(self, net: Network, rate: float = 0.01):
        self.net, self.rate, self.t = Network.of(net.flat().copy()), rate, 0
        parts = (self.net.inner, self.net.outer)
        self.m, self.v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]

    def gradients(self, around: np.ndarray, own: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words' mean -log P, by inner and outer.  Exponentials go through the products as they
        are; their sums divide the narrow sides."""
        net, row = self.net, np.repeat(np.arange(len(times)), times)
        h = net.hidden(around)
        p = h @ net.outer
        if np.abs(net.outer).sum(axis=0).max() > 60:  # h is within -1 and 1, so exp and its sums hold what is less
            p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        each = (p @ _ONES) / times.astype(np.float32)
        np.subtract.at(p.reshape(-1), row * CLASSES + own, each[row])
        each *= len(own)
        back = p @ net.outer[:HIDDEN].T
        back *= (1 - h[:, :HIDDEN] ** 2) / each[:, None]
        inner = np.zeros_like(net.inner)
        for k in range(len(PLACES)):  # sums of back by class
            seen = np.bincount(around[:, k], minlength=CLASSES + 1)
            some, by = np.flatnonzero(seen), np.argsort(around[:, k], kind="stable")
            inner[k][some] = np.add.reduceat(back.take(by, axis=0), (np.cumsum(seen) - seen)[some])
        h /= each[:, None]
        return inner, (p.T @ h).T

    def step(self, around: np.ndarray, own: np.ndarray, times: np.ndarray) -> None:
        self.t += 1
        for part, g, m, v in zip((self.net.inner, self.net.outer), self.gradients(around, own, times), self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            part -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def share(n: int, turn: int, every: int) -> np.ndarray:
    """Which of a chunk's n bunches a round takes: one in `every`, in no order; `every` rounds take each once."""
    return np.random.default_rng(n).permutation(n)[turn % every :: every]


def bunches(bounds: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Where bunches begin and how many words they have: runs between bounds, cut to `most` words, so that
    a frequent run goes to many batches."""
    sizes = np.diff(bounds)
    parts = -(-sizes // most)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(bounds[:-1], parts) + nth * most, np.minimum(np.repeat(sizes, parts) - nth * most, most)


def drawn(at: np.ndarray, bounds: np.ndarray, turn: int, every: int, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A round's batches of what alike gives: the place of one word of each bunch, those of all its words,
    and how many these are."""
    first, times = bunches(bounds)
    mine = share(len(first), turn, every)
    first, times = first[mine], times[mine]
    ends = np.cumsum(times)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, times.sum(), batch)), len(mine)))
    for low, high in itertools.pairwise(cuts):
        some, n = first[low:high], times[low:high]
        run = np.repeat(some - ends[low:high] + n, n) + np.arange(ends[low] - n[0], ends[high - 1])
        yield at[some], at[run], n


def train(classed: DataFrame, net: Network, rounds: int = 2, every: int = 2, batch: int = 2048, few: int = 32) -> Network:
    """The network after `rounds` of averaging.  A round's gradients take one in `every` of each chunk's
    bunches, others in each round, so with as many rounds every word of the corpus takes part once.  A
    bunch is a few words with equal classes around them, for which the network is run once; a batch has
    as many bunches as make `batch` words."""

    def run(batches, turn, start):
        trainer, seen = Trainer(Network.of(start)), 0
        for row in itertools.chain.from_iterable(b.to_pylist() for b in batches):
            own, sizes = np.frombuffer(row["classes"], np.uint8), np.array(row["sizes"], np.int64)
            around = window(own, sizes)
            for at, bounds in alike(around):
                for one, every_word, times in drawn(at, bounds, turn, every, batch):
                    trainer.step(around[one], own[every_word], times)
                    seen += len(every_word)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(trainer.net.flat().astype(np.float64) * seen).tobytes()])], names=["seen", "sums"])

    def fold(batches):
        seen, sums = 0, None
        for at in batches:
            for n, raw in zip(at.column(0).to_pylist(), at.column(1).to_pylist()):
                seen, sums = seen + n, np.frombuffer(raw) + (0 if sums is None else sums)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([sums.tobytes()])], names=["seen", "sums"])

    for turn in range(rounds):
        start = net.flat()
        parts = cut(classed.select("sizes", "classes").mapInArrow(lambda batches, turn=turn, start=start: run(batches, turn, start), "seen long, sums binary"))
        n = parts.count()
        while n > few:
            parts = cut(parts.repartition(-(-n // few)).mapInArrow(fold, "seen long, sums binary"))
            n = parts.count()
        done = parts.collect()  # at most `few` rows
        if done:
            net = Network.of(sum(np.frombuffer(r.sums) for r in done) / sum(r.seen for r in done))
    return net


@dataclass
class Model:
    classed: DataFrame  # chunk, doc_ids, sizes, classes (a byte a word), shares (summed, of each document)
    vocabulary: DataFrame
    totals: np.ndarray  # words of each class, and different ones
    network: Network


def fit(docs: DataFrame, **how) -> Model:
    """Count and code every document of `doc_id, text`, and train the network on them.  Null texts are
    empty; no documents give the network's start.  Other columns are ignored."""
    held = coded(docs)
    asked = held.select("chunk", F.arrays_zip("keys", "counts").alias("a")).select("chunk", F.posexplode("a").alias("local", "a")).select("chunk", "local", F.col("a.keys").alias("word"), F.col("a.counts").alias("n"))
    known = cut(vocabulary(asked.select("word", "n")), forget=True)
    totals = np.zeros((2, CLASSES))
    for r in known.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():  # at most CLASSES rows
        totals[:, r["class"]] = r.n, r.d
    bottom = np.log(np.maximum(totals[0] + SMOOTH * totals[1], SMOOTH))

    def classes(_, left, right):
        found = right.sort_by("local") if right.num_rows else right
        n, own = found.column("n").to_numpy().astype(float), found.column("class").to_numpy().astype(np.uint8)
        row = left.to_pylist()[0]  # chunks are different
        sizes = np.array(row["sizes"], np.int64)
        local = np.frombuffer(pa.decompress(row["locals"], int(sizes.sum()) * 4, codec="zstd", asbytes=True), np.uint32).astype(np.int64)
        pair, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(len(n), 1) + local, return_counts=True)
        doc, word = np.divmod(pair, max(len(n), 1))
        share = np.bincount(doc, times * (np.log(n[word] - times + SMOOTH) - bottom[own[word]]), len(sizes)) if len(pair) else np.zeros(len(sizes))
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64())]
        values = [[row["doc_ids"]], [row["sizes"]], [own[local].tobytes()], [share]]
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=["doc_ids", "sizes", "classes", "shares"])

    replies = asked.select(F.col("chunk").alias("whose"), "local", "word").join(known, "word").select("whose", "local", "n", "class")
    body = held.select("chunk", "doc_ids", "sizes", "locals")
    classed = cut(body.groupBy("chunk").cogroup(replies.groupBy("whose")).applyInArrow(classes, "doc_ids array<long>, sizes array<long>, classes binary, shares array<double>"), forget=True)
    return Model(classed, known, totals, train(classed, Network.start(totals[0]), **how))


def score(model: Model) -> DataFrame:
    """`doc_id, n_tokens, score, mean_logprob` of each document the model was fitted on: the summed
    log-probability of all its words.

    A null or empty text has score 0 and a null mean.  Null and repeated doc_ids are kept; an empty
    table gives an empty one.
    """
    start = model.network.flat()

    def run(batches):
        net = Network.of(start)
        for row in itertools.chain.from_iterable(b.to_pylist() for b in batches):
            own, sizes = np.frombuffer(row["classes"], np.uint8), np.array(row["sizes"], np.int64)
            logp = net.own_logp(window(own, sizes), own)
            sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), logp, len(sizes)) + np.array(row["shares"])
            mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array(sums), mean], names=["doc_id", "n_tokens", "score", "mean_logprob"])

    return model.classed.mapInArrow(run, "doc_id long, n_tokens long, score double, mean_logprob double")
