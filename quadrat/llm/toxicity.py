"""Toxicity by compression distance between two zstandard dictionaries.

zstandard trains one dictionary on whole ordinary texts and others on whole toxic texts.  What the
latter hold is mostly what both kinds of texts say, so they are pruned, by compression too: each of
their fragments is compressed under every text of the fit sample, and stays only if toxic texts
shorten it far more often than ordinary ones do.  A window costs its compressed length under the
ordinary dictionary, less that under the ordinary and the pruned toxic one together.

A window is one word between blanks: a wider one adds its neighbours' noise (the README has
figures), and equal words needn't be compressed twice.  Behind zstandard's own overhead a word is
too short to be compressed, so every window stands between a head and a tail that are in both
dictionaries and cost the same in both.

A text's score is a logistic function of how many of its words save how many bytes, so that the
threshold means a likelihood.  Dictionaries are learnt from two thirds of a bounded sample of the
rows that may be learnt from, the weights from the other third; every word of every text is scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, mapped

#: Rows of each label that are learnt from, and the bytes of all their texts; a text over a hundredth of that is not.
SAMPLE, BYTES = {0: 3000, 1: 1500}, 24 << 20
THRESHOLD = 0.3
#: Compression levels of windows, and of fragments under single texts.
LEVEL, PRUNING = 13, 5
ORDINARY_BYTES = 32_000
#: Size, segment and unit length of the dictionaries that zstandard trains on toxic texts.
TOXIC = ((4_000, 16, 6), (8_000, 24, 8), (16_000, 24, 6))
#: Standard errors, and the ratio of shares, by which toxic texts must shorten a fragment more often.
ERRORS, RATIO = 5.0, 4.0
HEAD, TAIL = bytes(range(128, 192)), bytes(range(192, 208))
SAVED = (2, 3, 4, 5, 6)
#: Bytes of text whose words are held at once.
SLICE = 1 << 20
#: Words whose saving a Python worker remembers before it starts afresh.
REMEMBERED = 100_000


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    log = dict(hash_log=17, chain_log=17, write_content_size=False, write_dict_id=False, write_checksum=False)
    how = zstandard.ZstdCompressionParameters.from_level(level, source_size=128, dict_size=len(content), **log)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


def _lengths(compressor: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, windows), "<u8", len(windows))
    spans = np.stack([np.cumsum(size) - size, size], axis=1).astype("<u8").tobytes()
    out = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(windows), spans))
    return np.fromiter((len(x) for x in out), np.int64, len(windows))


def _window(word: bytes) -> bytes:
    return HEAD + b" " + word + b" " + TAIL


def _dictionary(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """The content that zstandard selects (entropy tables, which stand before it, are left out); of
    samples that are too few or too short to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size + 4096, samples, k=k, d=d, level=3, steps=0).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def pruned(content: list[bytes], toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """The fragments, between blanks, that toxic texts shorten far more often than ordinary ones do.

    A text shortens a fragment if it saves all but three of its bytes, which a match costs."""
    found = sorted({f for c in content for f in c.split() if len(f) > 3})
    windows, least = [_window(f) for f in found], np.array([max(2, len(f) - 3) for f in found])
    if not found:
        return b""
    alone = _lengths(_compressor(HEAD + TAIL, PRUNING), windows)
    n = [sum((alone - _lengths(_compressor(t + HEAD + TAIL, PRUNING), windows) >= least).astype(float) for t in some) for some in (toxic, ordinary)]
    share, other = n[0] / len(toxic), n[1] / len(ordinary)
    error = np.sqrt((n[0] + n[1] + 1) / (len(toxic) + len(ordinary)) * (1 / len(toxic) + 1 / len(ordinary)))
    keep = (share - other > ERRORS * error) & (share > RATIO * (n[1] + 1) / len(ordinary)) & (n[0] >= 3)
    return b"".join(b" " + f for f, on in zip(found, keep) if on) + b" "


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    known: dict[bytes, int] = field(default_factory=dict)
    made: list = field(default_factory=list)

    def __getstate__(self):  # compressors stay where they are made
        return {"ordinary": self.ordinary, "toxic": self.toxic, "weights": self.weights, "known": {}, "made": []}

    def lengths(self, which: int, windows: list[bytes]) -> np.ndarray:
        if not self.made:
            self.made += [_compressor(content + HEAD + TAIL, LEVEL) for content in (self.ordinary, self.ordinary + self.toxic)]
        return _lengths(self.made[which], windows)

    def saved(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Bytes that each word of each text saves under the toxic dictionary."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({w for text in texts for w in text if w not in known})
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            windows = [_window(w) for w in some]
            known.update(zip(some, (self.lengths(0, windows) - self.lengths(1, windows)).tolist()))
        return [np.array([known[w] for w in text], np.int64) for text in texts]

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        rows = []
        for saved in self.saved(texts):
            over = [int((saved >= k).sum()) for k in SAVED]
            rows.append([1, saved.max(initial=0), *np.log1p(over), *(min(n, 1) for n in over), np.log1p(len(saved))])
        return np.array(rows, float).reshape(len(texts), -1)

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Newton's method on standardised columns; the first column is constant."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0, 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
    w = w / scale
    w[0] -= w[1:] @ mean[1:]
    return w


def unlike(each: list[list[bytes]]) -> list[int]:
    """Places of the texts that share none of four minima of hashed five-word shingles with one before
    them: near copies would count as evidence many times."""
    seen, out = set(), []
    for k, said in enumerate(each):
        found = [b" ".join(said[i : i + 5]) for i in range(max(1, len(said) - 4))]
        code = np.fromiter(map(zlib.crc32, found), np.uint32, len(found)).astype(np.uint64)
        least = {(j, int((code * np.uint64(m) & np.uint64(0xFFFFFFFF)).min())) for j, m in enumerate((1, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))}
        if not least & seen:
            out.append(k)
        seen |= least
    return out


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Dictionaries and weights of labelled texts, near copies counted once.  Without both labels every score is 0."""
    pool: dict[bytes, bytes] = {}  # equal words are one object
    each = [[pool.setdefault(w, w) for w in words(t)] for t in texts]
    some = unlike(each)
    each, labels = [each[k] for k in some], [labels[k] for k in some]
    third = np.array([zlib.crc32(b" ".join(w)) % 3 == 0 for w in each], bool)
    for y in (0, 1):  # a label that one part lacks is learnt from all
        if len({*third[np.array(labels) == y].tolist()}) < 2:
            third = None
            break
    whole = [b" " + b" ".join(w) + b" " for w in each]
    toxic, ordinary = ([t for k, (t, z) in enumerate(zip(whole, labels)) if z == y and len(t) > 2 and (third is None or not third[k])] for y in (1, 0))
    if not toxic or not ordinary:
        return Model(b"", b"")
    model = Model(_dictionary(ORDINARY_BYTES, ordinary, 64, 8), pruned([_dictionary(size, toxic, k, d) for size, k, d in TOXIC], toxic, ordinary))
    on = range(len(each)) if third is None else np.flatnonzero(third).tolist()
    model.weights = _logistic(model.features([each[k] for k in on]), np.array([labels[k] for k in on], float))
    return model


def sampled(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, most: int = BYTES) -> DataFrame:
    """`text, toxic` of at most sample[k] rows labelled k that may be learnt from: those whose
    crc32(doc_id) mod 4 is not 2, smallest hashes first, while all their texts have at most `most`
    bytes; texts of over a hundredth of that are passed over.  Repeated rows count once."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2")
    some = None
    for k, n in (sample or SAMPLE).items():
        part = rows.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        some = part if some is None else some.unionByName(part)
    few = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # at most the sample's rows
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    sizes = keyed.join(F.broadcast(few), "doc_id").select("doc_id", "th", "toxic", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).filter(F.col("n") <= most // 100)
    order = [F.xxhash64("doc_id"), "doc_id", "th"]
    sizes = sizes.distinct().orderBy(*order).limit(sum((sample or SAMPLE).values()))
    fits = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(*order))).filter(F.col("upto") <= most)  # at most the sample's rows
    return keyed.join(F.broadcast(fits.select("doc_id", "th", "toxic")), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).orderBy(*order).select("text", "toxic")


def trained(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, most: int = BYTES) -> Model:
    rows = sampled(docs, labels, sample, most).collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, held_out, score, predicted` of whole texts.

    A null or empty text is scored like any text without words.  A null doc_id is not held out.
    Repeated rows get equal scores; other columns are ignored; an empty table gives an empty one.
    """

    def run(batches):
        for batch in chunks(batches, SLICE):
            found = model.score([words(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under the threshold."""
    columns = docs.columns

    def run(batches):
        for batch in chunks(batches, SLICE, columns.index("text")):
            found = model.score([words(t) for t in batch.column(columns.index("text")).to_pylist()])
            yield batch.filter(pa.array(found < threshold)).rename_columns(columns)

    return mapped(docs, run, docs.schema)
