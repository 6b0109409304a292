"""Quality by a factorisation machine over hashed words, structure and metadata.

A text's features are its words and their shapes (capitals, digits, signs), hashed; statistics of its
structure, cut into classes at quantiles; and numeric columns of its row, cut likewise.  The machine
gives each feature a weight and a vector of a few numbers, and each pair of features the product of
their vectors.  The sum over all pairs of a text is half of (square of the sum) less (sum of the
squares), factor by factor, so a text is scored in time linear in its features.

Weights are learnt in numpy from a bounded sample of the labelled rows that may be learnt from: the
features are made by Spark, and only those of the sample reach the driver.  A fifth of the sample
says when to stop.  Every whole text is scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks

#: Rows of each label that are learnt from, and the bytes of their texts; a text over a hundredth of that is not.
SAMPLE, BYTES = {0: 5000, 1: 10_000}, 32 << 20
THRESHOLD = 0.3
#: Hashed features, factors, classes of a statistic.
HASHED, FACTORS, CLASSES = 1 << 16, 8, 12
STATISTICS = ("chars", "words", "word_length", "different", "most_frequent", "repeated", "capitals", "digits", "signs", "blanks", "lines", "line_length", "same_lines")
METADATA = ("n_chars",)
#: Learning: texts of a step, steps at most, steps between looks at the texts that say when to stop, and
#: how many looks without a gain of 2 % do; pace, shrinkage of weights and of vectors.
BATCH, STEPS, LOOK, PATIENCE, PACE, RIDGE, RIDGE_V = 48, 600, 50, 3, 0.2, 1e-5, 1e-4
#: Words that a Python worker remembers, and characters of a text that are split at once.
REMEMBERED, PART = 400_000, 1 << 20
_SHAPES = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}, **{chr(c): "9" for c in range(48, 58)}})
_RUNS = re.compile(r"(.)\1+", re.S)
_known: dict[str, tuple[int, int]] = {}


def hashed(word: str) -> tuple[int, int]:
    """Places of a word in lower case, and of its shape: kinds of characters, runs as one."""
    if word not in _known:
        if len(_known) > REMEMBERED:
            _known.clear()
        other = "".join("x" if c.islower() else "X" if c.isupper() else c for c in word.translate(_SHAPES)) if not word.isascii() else word.translate(_SHAPES)
        shape = _RUNS.sub(r"\1", other)
        _known[word] = zlib.crc32(b"w" + word.lower().encode("utf-8", "surrogatepass")) % HASHED, zlib.crc32(b"s" + shape.encode("utf-8", "surrogatepass")) % HASHED
    return _known[word]


def parts(text: str):
    """A text in parts that end at white space, where there is any in the next part."""
    at = 0
    while at < len(text):
        end = at + PART
        while end < min(len(text), at + 2 * PART) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, statistics): hashed words and shapes, each kind of length 1, and STATISTICS.

    A null text is an empty one: it has no words, and zeros as statistics."""
    text = text or ""
    words, n, repeated, length, last = Counter(), 0, 0, 0, None
    for part in parts(text):
        some = part.split()
        words.update(some)
        n += len(some)
        length += sum(map(len, some))
        repeated += sum(map(eq, some, some[1:])) + bool(some and some[0] == last)
        last = some[-1] if some else last
    lines = Counter(text.split("\n"))
    codes = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size, n_lines = max(int(codes.sum()), 1), sum(lines.values())
    letters, digits, blanks = int(codes[65:91].sum() + codes[97:123].sum() + codes[128:].sum()), int(codes[48:58].sum()), int(codes[[9, 10, 11, 12, 13, 32]].sum())
    few = max(n, 1)
    stats = [
        len(text), n, length / few, len(words) / few, max(words.values(), default=0) / few, repeated / few, int(codes[65:91].sum()) / max(letters, 1), digits / size,
        (size - letters - digits - blanks) / size if text else 0.0, blanks / size, n_lines, len(text) / n_lines, 1 - len(lines) / n_lines,
    ]
    own, shapes = {}, {}
    for word, k in words.items():
        a, b = hashed(word)
        own[a] = own.get(a, 0) + k
        shapes[b] = shapes.get(b, 0) + k
    at = np.array([*own, *shapes], np.int64)
    values = [np.log1p(np.fromiter(own.values(), float, len(own))), np.fromiter(shapes.values(), float, len(shapes))]
    value = np.concatenate([v / max(float(np.sqrt((v * v).sum())), 1e-12) for v in values])
    place, which = np.unique(at, return_inverse=True)  # a word and a shape may share a place
    return place, np.bincount(which, value, len(place)), np.array(stats, float)


@dataclass
class Rows:
    """Features of several texts, end to end."""

    place: np.ndarray
    value: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, found: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        return cls(np.concatenate([np.zeros(0, np.int64), *(p for p, _ in found)]), np.concatenate([np.zeros(0), *(v for _, v in found)]), np.array([len(p) for p, _ in found], np.int64))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Per text, the sum of x over its features."""
        end = np.cumsum(self.size)
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        return total[end] - total[end - self.size]

    def take(self, which: np.ndarray) -> Rows:
        end = np.cumsum(self.size)
        size = self.size[which]
        at = np.arange(int(size.sum())) + np.repeat(end[which] - size - (np.cumsum(size) - size), size)
        return Rows(self.place[at], self.value[at], size)


@dataclass
class Model:
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))
    borders: list[np.ndarray] = field(default_factory=list)
    metadata: tuple[str, ...] = METADATA

    def rows(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], columns: np.ndarray) -> Rows:
        """Features with the classes of statistics and metadata; a missing value has a class of its own."""
        numbers = np.concatenate([np.array([s for *_, s in found]).reshape(len(found), len(STATISTICS)), columns], axis=1)
        classes = np.stack([np.where(np.isnan(x), CLASSES, np.searchsorted(b, x, "right")) for x, b in zip(numbers.T, self.borders)], axis=1)
        at = HASHED + np.arange(classes.shape[1]) * (CLASSES + 1) + classes
        unit = np.full(at.shape[1], at.shape[1] ** -0.5)
        return Rows.of([(np.r_[p, more], np.r_[v, unit]) for (p, v, _), more in zip(found, at)])

    def margins(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of texts: bias, weights, and the factors of all pairs by sums of squares; and the
        scaled vectors with their sums."""
        linear = rows.sums(self.weights[rows.place] * rows.value)
        x = self.vectors[rows.place] * rows.value[:, None]
        whole = rows.sums(x)
        pairs = 0.5 * ((whole**2).sum(axis=1) - rows.sums((x * x).sum(axis=1)))
        return self.bias + linear + pairs, x, whole

    def score(self, texts: list[str | None], columns: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        return 1 / (1 + np.exp(-np.clip(self.margins(self.rows([features(t) for t in texts], columns))[0], -30, 30)))


def _step(model: Model, rows: Rows, y: np.ndarray, seen: list[np.ndarray]) -> None:
    """One step of AdaGrad on the logistic loss of a few texts, in place."""
    odds, x, whole = model.margins(rows)
    slope = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) / len(y)
    per = np.repeat(slope, rows.size) * rows.value
    order = np.argsort(rows.place, kind="stable")
    place, first = np.unique(rows.place[order], return_index=True)
    together = lambda g: np.add.reduceat(g[order], first, axis=0)
    gw = together(per) + RIDGE * model.weights[place]
    gv = together(per[:, None] * (np.repeat(whole, rows.size, axis=0) - x)) + RIDGE_V * model.vectors[place]
    for held, total, g in ((model.weights, seen[0], gw), (model.vectors, seen[1], gv)):
        total[place] += g * g
        held[place] -= PACE * g / np.sqrt(total[place] + 1e-8)
    model.bias -= PACE * float(slope.sum())


def fit(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], columns: np.ndarray, labels: np.ndarray, asked: np.ndarray, totals: dict[int, int], metadata: tuple[str, ...] = METADATA) -> Model:
    """A model of labelled features.  `asked` are the rows that say when to stop; totals, the labelled
    rows that the sample stands for.  With one label only, every score is that label's."""
    y = labels.astype(float)
    if len({*labels.tolist()}) < 2:
        return Model(0.0 if not len(y) else 5.0 if y[0] else -5.0, metadata=metadata)
    numbers = np.concatenate([np.array([s for *_, s in found]), columns], axis=1)
    cuts = np.arange(1, CLASSES) / CLASSES
    borders = [np.unique(np.quantile(x[~np.isnan(x)], cuts)) if (~np.isnan(x)).any() else np.zeros(0) for x in numbers.T]
    n, random = HASHED + len(borders) * (CLASSES + 1), np.random.default_rng(7)
    model = Model(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(n), random.normal(0, 0.05, (n, FACTORS)), borders, metadata)
    rows = model.rows(found, columns)
    learn, check = np.flatnonzero(~asked), np.flatnonzero(asked)
    learn = learn if len({*labels[learn].tolist()}) == 2 else np.arange(len(y))
    check = check if len({*labels[check].tolist()}) == 2 else learn
    held, seen = rows.take(check), [np.full(n, 1e-3), np.full((n, FACTORS), 1e-3)]
    best, since = (np.inf, model.bias, model.weights, model.vectors), 0
    dealt = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(dealt) < BATCH:
            dealt = np.r_[dealt, random.permutation(learn)]
        now, dealt = dealt[:BATCH], dealt[BATCH:]
        _step(model, rows.take(now), y[now], seen)
        if step % LOOK == 0:
            odds = np.clip(model.margins(held)[0], -30, 30)
            loss = float(np.mean(np.log1p(np.exp(-np.where(y[check] == 1, odds, -odds)))))
            if loss < 0.98 * best[0]:
                best, since = (loss, model.bias, model.weights.copy(), model.vectors.copy()), 0
            elif (since := since + 1) == PATIENCE:
                break
    _, bias, model.weights, model.vectors = best
    share = [totals.get(k, 0) / max(int((labels == k).sum()), 1) for k in (0, 1)]
    model.bias = bias + (float(np.log(share[1] / share[0])) if min(share) > 0 else 0.0)  # a label that the bound cut counts in full
    return model


def _numbers(docs: DataFrame, metadata: tuple[str, ...]) -> list:
    """The metadata columns as doubles, null where docs hasn't got them."""
    return [F.col(f"`{c}`").try_cast("double").alias(f"_m{k}") if c in docs.columns else F.lit(None).cast("double").alias(f"_m{k}") for k, c in enumerate(metadata)]


def _columns(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(first, batch.num_columns)], axis=1) if batch.num_columns > first else np.zeros((batch.num_rows, 0))


def learnable(labels: DataFrame) -> DataFrame:
    """`doc_id, quality` of the rows that may be learnt from: crc32(doc_id) mod 5 is not 0."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("doc_id is not null and quality in (0, 1)")
    return rows.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))


def trained(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = METADATA, sample: dict[int, int] | None = None, most: int = BYTES) -> Model:
    """A model of at most sample[k] rows labelled k, smallest hashes first, while their texts have at
    most `most` bytes together; texts of over a hundredth of that are passed over, equal texts count once."""
    sample = sample or SAMPLE
    rows = learnable(labels)
    totals = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    some = None
    for k, n in sample.items():
        part = rows.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        some = part if some is None else some.unionByName(part)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *_numbers(docs, metadata)).withColumn("th", F.xxhash64("text"))
    sizes = keyed.join(F.broadcast(some), "doc_id").groupBy("th").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "quality")).alias("r"), F.max(F.octet_length("text")).alias("n")).filter(F.col("n") <= most // 100)
    order = ["r.h", "r.doc_id", "th"]
    sizes = sizes.orderBy(*order).limit(sum(sample.values())).withColumn("upto", F.sum("n").over(Window.orderBy(*order))).filter(F.col("upto") <= most)  # at most the sample's rows
    few = keyed.join(F.broadcast(sizes.select("r.doc_id", "th", "r.quality")), ["doc_id", "th"]).dropDuplicates(["th"])

    def run(batches):
        for batch in chunks(batches):
            columns = _columns(batch, 3)
            for k, (h, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                place, value, stats = features(text)
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), batch.column(2).slice(k, 1), pa.array([place.tobytes()]), pa.array([value.tobytes()]), pa.array([np.r_[stats, columns[k]].tobytes()])], names=["th", "quality", "place", "value", "numbers"])

    held = few.select("th", "text", "quality", *[f"_m{k}" for k in range(len(metadata))]).mapInArrow(run, "th long, quality int, place binary, value binary, numbers binary").collect()  # the bounded sample
    held.sort(key=lambda r: r["th"])
    found = [(np.frombuffer(r["place"], np.int64), np.frombuffer(r["value"]), np.frombuffer(r["numbers"])[: len(STATISTICS)]) for r in held]
    columns = np.array([np.frombuffer(r["numbers"])[len(STATISTICS) :] for r in held]).reshape(len(held), len(metadata))
    return fit(found, columns, np.array([r["quality"] for r in held], int), np.array([r["th"] % 5 == 0 for r in held], bool), totals, metadata)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, held_out, score, predicted` of whole texts.

    A null or empty text is scored by its structure and metadata alone; a missing column of metadata
    counts as null.  A null doc_id is not held out.  Repeated rows get equal scores; other columns
    are ignored; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in chunks(batches, 2 << 20):
            found = model.score(batch.column(1).to_pylist(), _columns(batch, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_numbers(docs, model.metadata)).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
