"""Personal data: exact base patterns, completed by a skip-chain conditional random field.

The base patterns give spans that stay whatever the model says.  The field then labels the other
tokens that could be personal data: a token without a digit and without an at sign can only be
"other", so it is no node.  Its neighbours are chain edges between consecutive nodes, and skip
edges between a node and the last one before it in the document that has the same characters, or
the same last digits, or the same name before the at sign.  So a telephone number that is written
out once and shortened later gets one label.  Base spans clamp their nodes.  Marginals come from
loopy sum-product message passing over all documents of a batch at once.

The field is trained here, by pseudo-likelihood in numpy on generated token sequences, and only its
weights (a few hundred numbers) go to the executors.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mapped

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SURE = 0.6
SWEEPS = 12

# Possessive forms of the contract's patterns: they match the same, but never go back over a run.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EVIDENCE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
DIGITS = re.compile(r"[0-9]")
CORE = re.compile(r"[+(]?[A-Za-z0-9@](?:.*[A-Za-z0-9])?", re.S)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        else:
            done = at + 1  # no earlier character can belong to a later local part
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the contract's patterns, in that order."""
    if not EVIDENCE.search(text):
        return []
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return sorted(found)


def features(token: str) -> tuple[int, ...]:
    """Places of a token's features in the field's weights (0 is the bias)."""
    digits = "".join(DIGITS.findall(token))
    n, letters = len(digits), any(c.isalpha() for c in token)
    parts = token.strip(".,;:()[]").split(".")
    quad = len(parts) == 4 and all(p.isdecimal() and len(p) < 4 for p in parts)
    at = token.find("@")
    return tuple(k for k, on in enumerate((
        True, at > 0 and at < len(token) - 2, at == 0, n == 0, 0 < n <= 3, 3 < n <= 6, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 19, n > 19,
        letters, quad, quad and all(int(p) <= 255 for p in parts if p.isdecimal()), token.startswith("+"), "(" in token, "-" in token, "." in token and n > 0 and not quad,
        12 <= n <= 19 and luhn(digits), "/" in token or ":" in token, n == 4 and not letters, letters and n > 0 and at < 0,
    )) if on)


N_FEATURES = 21


def admitted(token: str) -> np.ndarray:
    """Log potential 0 for the labels a token may have, else very low: an address needs an at
    sign, the other kinds must not have letters."""
    letters = any(c.isalpha() for c in token)
    return np.array([0.0, 0.0 if "@" in token else -1e3, *[-1e3 if letters or "@" in token else 0.0] * 3])


#: Kinds of edges: neighbours with one blank between, other neighbours, same text, same last digits, same local part.
NEAR, FAR, SAME, TAIL, NAME = range(5)


def edges_of(tokens: list[str], gaps: list[bool]) -> list[tuple[int, int, int]]:
    """(earlier, later, kind) of the edges among one document's nodes.  gaps[i]: only a blank
    stands between nodes i and i + 1.  At most four edges lead back from a node."""
    found, last = [(i, i + 1, NEAR if near else FAR) for i, near in enumerate(gaps)], {}
    for i, token in enumerate(tokens):
        token = token.strip(".,;:()[]\"'").lower()
        digits = "".join(DIGITS.findall(token))
        keys = [(SAME, token)]
        if len(digits) >= 7:
            keys.append((TAIL, digits[-7:]))
        if token.find("@") > 0:
            keys.append((NAME, token[: token.find("@")]))
        for key in keys:
            if key in last:
                found.append((last[key], i, key[0]))
            last[key] = i
    return found


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Loopy sum-product marginals; edges has (a, b, kind), pair[kind] the log potential of (a's, b's) labels."""
    if len(edges):
        a, b, kind = edges.T
        src, dst = np.r_[a, b], np.r_[b, a]
        potential = np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)])
        back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
        message = np.zeros((len(src), unary.shape[1]))
        for _ in range(sweeps):
            belief = unary.copy()
            np.add.at(belief, dst, message)
            out = _logsum((belief[src] - message[back])[:, :, None] + potential, 1)
            out -= out.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * out
        unary = unary.copy()
        np.add.at(unary, dst, message)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def generated(seed: int = 0, documents: int = 500):
    """Token sequences with labels: personal data written out, their short later forms, and other
    numbers.  Yields (tokens, gaps, labels)."""
    rng = np.random.default_rng(seed)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda n: "".join(chr(97 + k) for k in rng.integers(0, 26, n))

    def card():
        head = str(rng.integers(1, 10)) + num(14)
        return next(head + d for d in "0123456789" if luhn(head + d))

    for _ in range(documents):
        tokens, gaps, labels = [], [], []

        def put(label, *parts):
            if tokens:
                gaps.append(bool(rng.random() < 0.3))
            gaps.extend([True] * (len(parts) - 1))
            tokens.extend(parts)
            labels.extend([label] * len(parts))

        for kind in rng.integers(0, 5, rng.integers(2, 9)):
            again = rng.random() < 0.6
            if kind == 1:
                name, host = f"{word(6)}.{num(2)}", f"mail{num(1)}"
                put(1, f"{name}@{host}.example.com")
                if again:
                    put(1, f"{name}@{host}")
            elif kind == 2:
                ip = ".".join(map(str, rng.integers(1, 256, 4)))
                put(2, ip)
                if again:
                    put(2, ip + ",")
            elif kind == 3:
                c = card()
                put(3, *([c[k : k + 4] for k in range(0, 16, 4)] if rng.random() < 0.4 else [c]))
                if again:
                    put(3, f"*{c[-8:]}" if rng.random() < 0.5 else c + ".")
            elif kind == 4:
                area, mid, line = num(3), num(3), num(4)
                put(4, "+1", f"({area})", f"{mid}-{line}")
                if again:
                    put(4, *rng.permutation([f"{mid}-{line}"]).tolist()) if rng.random() < 0.5 else put(4, f"({area})", f"{mid}-{line}")
            else:
                for _ in range(rng.integers(1, 4)):
                    other = rng.choice(["19" + num(2), num(2) + "." + num(2), f"{num(1)}.{num(1)}.{num(1)}", num(rng.integers(1, 9)), f"{num(2)}:{num(2)}", "@" + word(5), word(3) + num(2), f"{num(3)}-{num(4)}", num(rng.integers(9, 24)), "999." + num(3) + ".1.1", f"{num(4)}-{num(2)}-{num(2)}", f"{word(4)}@", word(3) + "@" + word(3), f"password={num(6)}", num(rng.integers(3, 6))])
                    if not (12 <= len(other) <= 19 and other.isdecimal() and luhn(other)):
                        put(0, other)
        yield tokens, gaps, labels


@lru_cache(maxsize=1)
def train(seed: int = 0, documents: int = 500, steps: int = 300, rate: float = 2.0, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (unary, pair) of the largest pseudo-likelihood of `generated` sequences."""
    x, y, edges, may = [], [], [], []
    for tokens, gaps, labels in generated(seed, documents):
        edges += [(len(y) + a, len(y) + b, k) for a, b, k in edges_of(tokens, gaps)]
        x += [np.bincount(features(t), minlength=N_FEATURES) for t in tokens]
        y += labels
        may += [admitted(t) for t in tokens]
    x, y, may, (a, b, kind) = np.array(x, float), np.array(y), np.array(may), np.array(edges).T
    gold, n = np.eye(len(LABELS))[y], len(LABELS)
    unary, pair = np.zeros((N_FEATURES, n)), np.zeros((5, n, n))
    for step in range(steps):
        score = x @ unary + may
        np.add.at(score, b, pair[kind, y[a]])
        np.add.at(score, a, pair[kind, :, y[b]])
        p = np.exp(score - score.max(axis=1, keepdims=True))
        off = gold - p / p.sum(axis=1, keepdims=True)
        up, both = x.T @ off / len(y), np.zeros_like(pair)
        np.add.at(both, (kind, y[a]), off[b])
        np.add.at(both.transpose(0, 2, 1), (kind, y[b]), off[a])
        share = rate / (1 + step / steps)
        unary += share * (up - ridge * unary)
        pair += share * (both / len(y) - ridge * pair)
    return unary, pair


def find(texts: list[str], model: tuple[np.ndarray, np.ndarray], sure: float = SURE) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, each as (start, kind's place, end) in order."""
    unary_w, pair = model
    based, docs, rows, clamp, edges, spots = [base_spans(t) for t in texts], [], [], [], [], []
    for d, text in enumerate(texts):
        if not EVIDENCE.search(text):
            continue
        found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        tokens = [text[s:e] for s, e in found]
        start, held, k = len(rows), based[d], 0
        taken = []
        for s, e in found:  # both in order of start
            while k < len(held) and held[k][2] <= s:
                k += 1
            over = next((x for x in held[k : k + 4] if x[0] < e and x[2] > s), None)
            taken.append(over[1] + 1 if over else -1)
        if all(t >= 0 for t in taken):
            continue  # nothing is left to label
        gaps = [text[e:s] == " " for (_, e), (s, _) in zip(found, found[1:])]
        edges += [(start + a, start + b, kind) for a, b, kind in edges_of(tokens, gaps)]
        rows += [(features(t), admitted(t)) for t in tokens]
        clamp += taken
        spots += found
        docs += [d] * len(found)
    added: list[list] = [[] for _ in texts]
    if rows:
        unary = np.array([unary_w[list(r)].sum(axis=0) + may for r, may in rows])
        fixed = np.flatnonzero(np.array(clamp) >= 0)
        unary[fixed] = -1e3
        unary[fixed, np.array(clamp)[fixed]] = 0
        p = marginals(unary, np.array(edges).reshape(-1, 3), pair)
        best = p.argmax(axis=1)
        for i in np.flatnonzero((best > 0) & (p.max(axis=1) >= sure) & (np.array(clamp) < 0)):
            d, (s, e) = docs[i], spots[i]
            if not (core := CORE.search(texts[d], s, e)):
                continue
            span, kind, mine = (core.start(), core.end()), int(best[i]) - 1, added[docs[i]]
            if mine and mine[-1][1] == kind and texts[d][mine[-1][2] : span[0]] in (" ", ") "):
                mine[-1] = (mine[-1][0], kind, span[1])
            else:
                mine.append((span[0], kind, span[1]))
    return list(zip(based, added))


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added` of whole texts.

    The counts and the checksum are of the base spans; spans lists base and added ones by start,
    then kind, as kind:start:end in code points.  A null or empty text has no spans.  Null and
    repeated doc_ids are kept; other columns are ignored; an empty table gives an empty one.
    """
    model = train()
    names = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches):
        for batch in chunks(batches):
            found = find([t or "" for t in batch.column(1).to_pylist()], model)
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(len(KINDS))]
            sums = [hashlib.sha256(_text(base).encode()).hexdigest() for base, _ in found]
            spans = [_text(sorted(base + added)) for base, added in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(sums), pa.array(spans), pa.array([len(added) for _, added in found])], names=[x.split()[0] for x in names.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, names)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or each run of spans that overlap, replaced by its first kind."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with found personal data replaced in `text`, and `n_chars`, if
    there is one, counted anew.  A null text stays null."""
    model, columns = train(), docs.columns

    def run(batches):
        for batch in chunks(batches, column=columns.index("text")):
            texts = batch.column(columns.index("text")).to_pylist()
            found = find([t or "" for t in texts], model)
            new = [t and masked(t, base + added) for t, (base, added) in zip(texts, found)]
            yield batch.set_column(columns.index("text"), "text", pa.array(new, pa.string())).rename_columns(columns)

    out = mapped(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
