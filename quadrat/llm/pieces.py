"""SentencePiece encoding, decoding, and sampling of segmentations without replacement.

A text is normalised as its model says and cut before each run of word marks, which no piece
crosses.  So its lattice is a chain of word lattices, and equal words have equal lattices: they are
built once, for all new words of a batch together, by hashing substrings.  A piece weighs
-alpha * log(1 + rank), with ranks by the model's scores (Zipf's law for a model that has only merge
ranks); a character that is no piece is its bytes.

Samples come by top-down Gumbel-top-k, which is a perturbed A-star search: the set of all
segmentations has a perturbed score, the maximum of its members'.  Along a path, each word's choice
keeps the bound, and the set of the other choices of that word gets its own maximum, truncated at
the bound.  Every such set is on the queue; the best one's word is chosen anew, without the choices
taken already, and what follows it is free.  So k distinct segmentations come out in order of their
perturbed scores, distributed as sampling without replacement, and the best set left on the queue
is the threshold of the inclusion probabilities.  All random numbers are functions of the row's
key, the sample, the word's place and the step, so that a lost executor's rows come out the same.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

ALPHA, SAMPLES = 0.25, 2
BYTES_AT_ONCE = 1 << 21
#: Characters of words whose lattices a worker keeps, and places of a long word whose edges it makes at once.
KEPT, BLOCK = 1_800_000, 1 << 15
WORD = re.compile("▁*[^▁]+|▁+")
BASE = np.uint64(0x9E3779B97F4A7C15)
SAMPLE = "doc_id long, sample int, n_pieces long, ids_crc32 long, logprob double, perturbed double, log_inclusion double, round_trip boolean"


def model_path(name: str = "piece_bpe_32k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.model")


class Pieces:
    """The vocabulary as arrays.  Ids from `size` on stand for a character's bytes."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = len(sp)
        self.byte = np.array([next((i for i in range(len(sp)) if sp.is_byte(i) and sp.id_to_piece(i) == f"<0x{b:02X}>"), sp.unk_id()) for b in range(256)])
        self.surface = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(len(sp))]
        self.told = np.frombuffer(b"".join(self.surface), np.uint8)
        self.tells = np.array([len(x) for x in self.surface])
        self.told_at = np.cumsum(self.tells) - self.tells
        usable = [i for i in range(len(sp)) if self.surface[i] and not sp.is_byte(i) and not sp.is_unused(i) and (len(sp.id_to_piece(i)) == 1 or sp.get_score(i) > -1e8)]
        usable.sort(key=lambda i: (-sp.get_score(i), i))
        self.weight = np.zeros(len(sp))
        self.weight[usable] = -alpha * np.log(2 + np.arange(len(usable)))
        self.linear = np.exp(self.weight)
        self.byte_weight = -alpha * np.log(2 + len(usable))
        self.longest = max(len(sp.id_to_piece(i)) for i in usable)
        starts: list[dict[int, int]] = [{} for _ in range(self.longest)]  # by length: how pieces begin, -1 if that is none itself
        for i in usable:
            h = 0
            for held, c in zip(starts, sp.id_to_piece(i)):
                h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                held.setdefault(h, -1)
            starts[len(sp.id_to_piece(i)) - 1][h] = i
        self.lattice = Lattices(self)
        self.tables = [tuple(np.array(c, t) for c, t in zip(zip(*sorted(held.items())), (np.uint64, np.int32))) for held in starts]

    def words(self, text: str | None) -> list[str]:
        return WORD.findall(self.processor.normalize(text)) if text else []

    def edges(self, text: np.ndarray, room: np.ndarray, row: np.ndarray | None = None):
        """All pieces in a text of code points, by place, longest first: where each place's edges
        start, and their codes, lengths and weights.  room is how far a piece may reach (1 at least);
        row numbers the places anew."""
        at, h, hits, bare = np.arange(len(text)), np.zeros(len(text), np.uint64), [], np.ones(len(text), bool)
        row = at if row is None else row
        for k, (hashes, ids) in enumerate(self.tables):  # only where some piece begins like the text
            h = h * BASE + text[at + k].astype(np.uint64) + np.uint64(1)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            met = hashes[place] == h
            hit = met & (ids[place] >= 0)
            hits.append((row[at[hit]], ids[place[hit]]))
            if not k:
                bare[at[hit]] = False
            on = met & (room[at] > k + 1)
            at, h = at[on], h[on]
        lone = np.flatnonzero(bare)
        many = np.zeros(len(text), np.int64)
        for rows in (row[lone], *(rows for rows, _ in hits)):
            many[rows] += 1
        start = np.concatenate([[0], np.cumsum(many)])
        code, step, filled = np.empty(start[-1], np.int32), np.ones(start[-1], np.int8), start[:-1].copy()
        weight = np.empty(start[-1])
        for k in range(len(hits) - 1, -1, -1):
            rows, ids = hits[k]
            e = filled[rows]
            code[e], step[e], weight[e] = ids, k + 1, self.linear[ids]
            filled[rows] += 1
        e, char = filled[row[lone]], text[lone]
        code[e] = self.size + char
        weight[e] = np.exp(self.byte_weight * (1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)))
        return start, code, step, weight

    def spelt(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the bytes of characters that are no pieces written out, and how many each code has."""
        size = np.ones(len(codes), np.int64)
        bare = np.flatnonzero(codes >= self.size)
        chars, which = np.unique(codes[bare] - self.size, return_inverse=True)
        spelt = [self.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in chars.tolist()]
        many = np.array([len(x) for x in spelt], np.int64)
        table = np.zeros((len(chars), 4), np.int64)
        for row, ids in zip(table, spelt):
            row[: len(ids)] = ids
        size[bare] = many[which]
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        whole = np.flatnonzero(codes < self.size)
        out[at[whole]] = codes[whole]
        for j in range(int(many.max(initial=0))):
            on = np.flatnonzero(many[which] > j)
            out[at[bare[on]] + j] = table[which[on], j]
        return out, size

    def ids(self, codes: np.ndarray) -> np.ndarray:
        return self.spelt(np.asarray(codes, np.int64))[0]

    def told_by(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The UTF-8 bytes that the pieces stand for, and how many each has."""
        size = self.tells[ids]
        return self.told[np.repeat(self.told_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes(), size

    def decoded(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of a text, without the blank before the first word."""
        text = self.told_by(ids)[0]
        return text[1:] if text.startswith(b" ") else text

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(path: str, alpha: float = ALPHA) -> Pieces:
    return Pieces(path, alpha)


class Lattices:
    """Word lattices.  A row is a place in a word; its edges are pieces, longest first, each with its
    length, the row it leads to (-1 at the word's end), its probability given the place, and that of
    all other edges there (summed, not subtracted, so that small shares are exact).

    Words of up to `self.short` characters are held sparsely for sampling all at once.  Those that
    came in together are a block, in which places equally far from their words' ends stand side by
    side.  They are kept for later batches until there are KEPT characters.  A longer word, such as
    a text without blanks, keeps 12 bytes a character: its edges are made again for BLOCK places at
    a time.  Probabilities are computed word by word, so what is kept does not change them.
    """

    def __init__(self, vocabulary: Pieces):
        self.vocabulary = vocabulary
        self.short = max(1, min(48, int(500 / max(1e-9, -4 * vocabulary.byte_weight))))
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.held, self.firsts_end = {}, 0
        kinds = dict.fromkeys(("length", "block", "rank", "base", "start", "stop"), np.int64) | {"to": np.int32, "code": np.int32, "step": np.int8} | dict.fromkeys(("p", "draw", "miss"), np.float64)
        for name, kind in kinds.items():
            self.held[name] = np.empty(0, kind), 0
            setattr(self, name, self.held[name][0])
        self.firsts: list[np.ndarray] = []
        self.long: dict[int, LongWord] = {}

    def number(self, words: list[str]) -> np.ndarray:
        """Each word's number; new ones get their lattice."""
        found = list(map(self.index.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        new = list(dict.fromkeys(words[i] for i in missing))
        if self.firsts_end + sum(map(len, new)) > KEPT and self.index:
            self.clear()
            return self.number(words)
        if new:
            self._add(new)
            for i in missing:
                found[i] = self.index[words[i]]
        return np.array(found, np.int64)

    def _add(self, words: list[str]):
        first = len(self.index)
        self.index.update(zip(words, range(first, first + len(words))))
        length = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(length > self.short).tolist():
            self.long[first + i] = LongWord(self.vocabulary, words[i])
        size = np.where(length > self.short, 0, length)
        text = np.frombuffer("".join([w for w, n in zip(words, size.tolist()) if n]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        room = np.repeat(np.cumsum(size), size) - np.arange(len(text))
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(words))
        reach = len(words) - np.cumsum(np.bincount(size, minlength=1))  # words with more than d characters
        firsts = np.cumsum(reach) - reach  # rows by distance to the word's last character
        row = firsts[room - 1] + np.repeat(rank, size)
        start, code, step, weight = self.vocabulary.edges(text, room, row)
        many = np.diff(start)
        far, of = np.repeat(np.arange(len(reach)), reach), np.arange(len(text)) - np.repeat(firsts, reach)
        far, of = np.repeat(far, many) - step, np.repeat(of, many)
        to = np.where(far >= 0, firsts[far] + of, -1)
        beta, p = np.ones(len(text) + 1), weight  # what to = -1 leads to weighs 1
        for d, n in enumerate(reach.tolist()):
            if n:
                a = firsts[d]
                e = slice(start[a], start[a + n])
                p[e] *= beta[to[e]]
                beta[a : a + n] = np.add.reduceat(p[e], start[a : a + n] - start[a])
                p[e] /= np.repeat(beta[a : a + n], many[a : a + n])
        small = p < 0.5
        rest = np.add.reduceat(np.where(small, p, 0), start[:-1]) if len(p) else p
        miss = np.where(small, 1 - p, np.repeat(rest, many))
        draw = p.copy()
        draw[start[1:] - 1] = 2
        rows, edges = self.firsts_end, self.held["code"][1]
        self.firsts.append(firsts + rows)
        self.firsts_end += len(text)
        self._keep(length=length, block=np.full(len(words), len(self.firsts) - 1), rank=rank, base=np.where(size > 0, firsts[size - 1] + rank + rows, -1))
        self._keep(start=start[:-1] + edges, stop=start[1:] + edges, to=np.where(to >= 0, to + rows, -1), code=code, step=step, p=p, draw=draw, miss=miss)

    def _keep(self, **arrays):
        """Append to the arrays of these names, whose room doubles when it is full."""
        for name, new in arrays.items():
            held, n = self.held[name]
            if n + len(new) > len(held):
                held = np.concatenate([held[:n], np.empty(max(n, len(new)), held.dtype)])
            held[n : n + len(new)] = new
            self.held[name] = held, n + len(new)
            setattr(self, name, held)

    def row(self, word: int, at: int) -> tuple[list, list, list]:
        """Codes, lengths and probabilities of the edges at a place of a word."""
        if word in self.long:
            return self.long[word].row(at)
        row = self.firsts[self.block[word]][self.length[word] - 1 - at] + self.rank[word]
        a, b = int(self.start[row]), int(self.stop[row])
        return self.code[a:b].tolist(), self.step[a:b].tolist(), self.p[a:b].tolist()

    def walk(self, word: int, at: int, draw) -> tuple[list, list, float, float]:
        """A path from a place of a word to its end: codes, lengths, log-probability, and the
        probability of all other paths from there."""
        codes, steps, logp, other, n = [], [], 0.0, 0.0, int(self.length[word])
        while at < n:
            code, step, p = self.row(word, at)
            k = _chosen(p, next(draw))
            if len(p) > 1:
                other += math.exp(logp) * (sum(p[:k]) + sum(p[k + 1 :]))
                logp += math.log(p[k])
            codes.append(code[k])
            steps.append(step[k])
            at += step[k]
        return codes, steps, logp, other

    def sample(self, word: np.ndarray, seed: np.ndarray):
        """A path for each occurrence of a word: number of pieces, log-probability, probability of the
        word's other paths, and codes with each occurrence's pieces in order."""
        n = len(word)
        count, logp, rest, found = np.ones(n, np.int64), np.zeros(n), np.zeros(n), []
        is_long = np.isin(word, list(self.long)) if self.long else np.zeros(n, bool)
        at = np.flatnonzero(~is_long)
        row, key, mass, other, turn = self.base[word[at]], seed[at], np.ones(len(at)), np.zeros(len(at)), 0
        while len(at):
            u, e = uniform(key, turn), self.start[row]
            share = self.draw[e]
            on = np.flatnonzero(u >= share)
            while len(on):
                u[on] -= share[on]
                e[on] += 1
                share[on] = self.draw[e[on]]
                on = on[u[on] >= share[on]]
            other += mass * self.miss[e]
            mass *= self.p[e]
            found.append((at, self.code[e]))
            row, turn = self.to[e], turn + 1
            over = np.flatnonzero(row < 0)
            done = at[over]
            count[done], logp[done], rest[done] = turn, np.log(mass[over]), other[over]
            on = np.flatnonzero(row >= 0)
            at, row, key, mass, other = at[on], row[on], key[on], mass[on], other[on]
        walks = {}
        for i in np.flatnonzero(is_long).tolist():
            codes, _, logp[i], rest[i] = self.walk(int(word[i]), 0, draws(int(seed[i])))
            walks[i], count[i] = codes, len(codes)
        offset, codes = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int64)
        for turn, (at, code) in enumerate(found):
            codes[offset[at] + turn] = code
        for i, some in walks.items():
            codes[offset[i] : offset[i] + count[i]] = some
        return count, logp, rest, codes

    def other(self, word: int, taken: Taken, seed: int) -> tuple[list, float, float]:
        """A path of a word that is not among those taken, which it joins: its codes and
        log-probability, and the probability of the paths that are left then."""
        left, draw = taken.left(self, word), draws(seed)
        node, at, codes, steps, logp = 0, 0, [], [], 0.0
        while node >= 0:
            code, step, p = self.row(word, at)
            k = _chosen(taken.weights(node, code, p, left), next(draw))
            codes.append(code[k])
            steps.append(step[k])
            logp += math.log(p[k])
            at += step[k]
            node = taken.kid(node, code[k])
        more = self.walk(word, at, draw)
        codes, steps = codes + more[0], steps + more[1]
        taken.add(codes, steps)
        return codes, logp + more[2], taken.left(self, word)[0]


class LongWord:
    """The lattice of one long word.  `rest` is the log of the summed weights of all paths from each
    place to the end; edges are made from it for a block of places when they are asked for."""

    def __init__(self, vocabulary: Pieces, word: str):
        self.vocabulary = vocabulary
        self.text = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.rest, self.block = np.zeros(len(self.text) + 1), (-1, None)
        for a in range((len(word) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            start, _, step, weight = (x.tolist() for x in self._edges(a))
            n = len(start) - 1
            tail = self.rest[a + n : a + n + vocabulary.longest]  # beta: weights scaled by exp(shift)
            shift = float(tail[0])
            beta, logs = [0.0] * n + np.exp(tail - shift).tolist(), [0.0] * n
            for i in range(n - 1, -1, -1):
                total = 0.0
                for e in range(start[i], start[i + 1]):
                    total += weight[e] * beta[i + step[e]]
                logs[i] = shift + math.log(total)
                if total < 1e-100:
                    for j in range(i + 1, min(len(beta), i + 1 + vocabulary.longest)):
                        beta[j] /= total
                    shift, total = logs[i], 1.0
                beta[i] = total
            self.rest[a : a + n] = logs

    def _edges(self, a: int):
        n = min(BLOCK, len(self.text) - a)
        text = self.text[a : a + n + self.vocabulary.longest].astype(np.int64)
        start, code, step, weight = self.vocabulary.edges(text, len(text) - np.arange(len(text)))
        e = int(start[n])
        return start[: n + 1], code[:e], step[:e], weight[:e]

    def row(self, at: int) -> tuple[list, list, list]:
        a = at // BLOCK * BLOCK
        if self.block[0] != a:
            start, code, step, weight = self._edges(a)
            row = a + np.repeat(np.arange(len(start) - 1), np.diff(start))
            p = weight * np.exp(self.rest[row + step] - self.rest[row])
            self.block = a, [x.tolist() for x in (start, code, step, p)]
        start, code, step, p = self.block[1]
        i, j = start[at - a], start[at - a + 1]
        return code[i:j], step[i:j], p[i:j]


class Taken:
    """The paths of one word that have come out, as a tree of their pieces.  Most nodes have one
    child, which is held in arrays: a long word's path is as long as its text."""

    def __init__(self, codes: list, steps: list):
        self.at, self.code, self.child = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.add(codes, steps)

    def kid(self, node: int, code: int) -> int:
        """The child that a piece leads to, or -1."""
        return self.child[node] if self.code[node] == code else self.more.get(node, {}).get(code, -1)

    def add(self, codes: list, steps: list):
        node = 0
        for code, step in zip(codes, steps):
            then = self.kid(node, code)
            if then < 0:
                then = len(self.at)
                if self.child[node] < 0:
                    self.code[node], self.child[node] = code, then
                else:
                    self.more.setdefault(node, {})[code] = then
                self.at.append(self.at[node] + step)
                self.code.append(-1)
                self.child.append(-1)
            node = then

    def weights(self, node: int, code: list, p: list, left: array) -> list[float]:
        """Of each edge of a node, the probability of the paths that are not taken."""
        if node in self.more:
            return [q * left[kid] if (kid := self.kid(node, c)) >= 0 else q for c, q in zip(code, p)]
        out = p.copy()
        out[code.index(self.code[node])] *= left[self.child[node]]
        return out

    def left(self, lattice: Lattices, word: int) -> array:
        """By node, the probability, given the node, of the paths through it that are not taken: 0
        just where all are."""
        left = array("d", bytes(8 * len(self.at)))
        for node in range(len(left) - 1, -1, -1):
            if self.child[node] >= 0:
                code, _, p = lattice.row(word, self.at[node])
                left[node] = sum(self.weights(node, code, p, left))
        return left


def _chosen(weights: list[float], u: float) -> int:
    """The place that u of the sum falls to; one of weight 0 never."""
    left, last = u * sum(weights), 0
    for k, w in enumerate(weights):
        if w > 0:
            last = k
            if left < w:
                return k
        left -= w
    return last


def draws(seed: int):
    """The numbers uniform(seed, 0), uniform(seed, 1) and so on."""
    at, n = 0, 8
    while True:
        yield from uniform(np.full(n, seed, np.uint64), np.arange(at, at + n)).tolist()
        at, n = at + n, min(2 * n, 4096)


def uniform(seed: np.ndarray, stream) -> np.ndarray:
    """Numbers in (0, 1) that depend on the seeds and the stream (or streams) only (splitmix64)."""
    z = seed + (np.atleast_1d(np.asarray(stream, np.uint64)) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def _truncated(log_mass: np.ndarray, bound, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of sets of the given log mass, given that they are at most bound."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(log_mass), -np.inf, -np.logaddexp(-bound, np.log(-np.log(u)) - log_mass))


def _log(mass):
    """Logarithm, -inf of an empty set."""
    with np.errstate(divide="ignore"):
        return np.log(mass)


def sampled(vocabulary: Pieces, texts: list[str | None], keys: list[int], k: int = SAMPLES) -> list[list[tuple]]:
    """For each text up to k (codes, logprob, perturbed, log inclusion), the largest perturbed first."""
    each = [vocabulary.words(t) for t in texts]
    lattice = vocabulary.lattice
    word = lattice.number([w for ws in each for w in ws])
    size = np.array([len(ws) for ws in each], np.int64)
    start = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(each)), size)
    place = (np.arange(len(word)) - start[doc]).astype(np.uint64)
    key = np.array(keys, np.uint64)
    seed = key[doc] + place * np.uint64(0xA24BAED4963EE407)
    bound = -np.log(-np.log(uniform(key, 9_000_000)))
    count, logp, rest, codes = lattice.sample(word, seed)
    at = np.cumsum(count) - count
    before = _before(logp, size)
    value = _truncated(before + _log(rest), bound[doc], uniform(seed, 8_000_000))
    out, paths, queue = [], [], []
    for d, (a, n) in enumerate(zip(start.tolist(), size.tolist())):
        mine = codes[at[a] : at[a + n - 1] + count[a + n - 1]] if n else codes[:0]
        paths.append([(mine, count[a : a + n], logp[a : a + n])])
        out.append([[mine, float(logp[a : a + n].sum()), float(bound[d])]])
        queue.append([value[a : a + n].copy()])  # by path: the perturbed scores of the sets left at its words
    taken: list[dict] = [{} for _ in each]
    for turn in range(1, k):
        again, first = [], []
        for d in range(len(each)):
            best = max(((float(v.max()), -p) for p, v in enumerate(queue[d]) if len(v)), default=(-np.inf, 0))
            if best[0] == -np.inf:
                continue
            b = int(queue[d][-best[1]].argmax())
            again.append((d, -best[1], b, best[0]))
            first.append(b + 1)
        if not again:
            break
        rows = [np.arange(start[d] + f, start[d] + size[d]) for (d, *_), f in zip(again, first)]
        flat = np.concatenate(rows)
        fresh = seed[flat] + np.uint64(turn * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
        n_new, logp_new, rest_new, codes_new = lattice.sample(word[flat], fresh)
        noise, heads = uniform(fresh, 8_000_000), []
        for (d, p, b, g), own in zip(again, rows):
            old, n_old, logp_old = paths[d][p]
            head = int(n_old[:b].sum())
            w = int(word[start[d] + b])
            if (p, b) not in taken[d]:
                said, steps, place_at = old[head : head + n_old[b]].tolist(), [], 0
                for code in said:
                    some, step, _ = lattice.row(w, place_at)
                    steps.append(step[some.index(code)])
                    place_at += steps[-1]
                taken[d][p, b] = Taken(said, steps)
            new, new_logp, left = lattice.other(w, taken[d][p, b], fresh_seed(keys[d], turn))
            ahead = float(logp_old[:b].sum())
            u = uniform(np.array([fresh_seed(keys[d], turn)], np.uint64), 8_500_000)
            queue[d][p][b] = _truncated(np.array([ahead + (math.log(left) if left > 0 else -np.inf)]), g, u)[0]
            heads.append((old[:head], n_old[:b], logp_old[:b], new, new_logp, ahead + new_logp))
        many = np.array([len(own) for own in rows])
        ends, c = np.cumsum(many), 0
        tails = _truncated(np.repeat([h[5] for h in heads], many) + _before(logp_new, many) + _log(rest_new), np.repeat([g for *_, g in again], many), noise)
        for (d, p, b, g), e, own, (old, n_old, logp_old, new, new_logp, _) in zip(again, ends.tolist(), rows, heads):
            part = slice(e - len(own), e)
            pieces_new = int(n_new[part].sum())
            mine = np.concatenate([old, np.array(new, np.int64), codes_new[c : c + pieces_new]])
            logs = np.concatenate([logp_old, [new_logp], logp_new[part]])
            queue[d].append(np.concatenate([np.full(b + 1, -np.inf), tails[part]]))
            paths[d].append((mine, np.concatenate([n_old, [len(new)], n_new[part]]), logs))
            out[d].append([mine, float(logs.sum()), g])
            c += pieces_new
    found = []
    for d, rows in enumerate(out):
        limit = max((float(v.max()) for v in queue[d] if len(v)), default=-np.inf)
        found.append([(codes, lp, g, _log_inclusion(lp - limit)) for codes, lp, g in rows])
    return found


def _before(logp: np.ndarray, size: np.ndarray) -> np.ndarray:
    """By word, the sum over the words before it in its text; text by text, so that it doesn't
    depend on what else is in the batch."""
    out = np.empty(len(logp))
    for end, n in zip(np.cumsum(size).tolist(), size.tolist()):
        out[end - n : end] = np.cumsum(logp[end - n : end]) - logp[end - n : end]
    return out


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))), which is x itself where it is very small."""
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 50.0)))))


def fresh_seed(key: int, turn: int) -> int:
    return (key ^ turn * 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF


def row_key(doc_id: int | None, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(b"null" if doc_id is None else int(doc_id).to_bytes(8, "little", signed=True), seed=seed)


def sample(docs: DataFrame, k: int = SAMPLES, path: str | None = None, alpha: float = ALPHA, seed: int = 0, with_ids: bool = False) -> DataFrame:
    """Up to k distinct segmentations per row of `doc_id, text`, largest perturbed score first:
    `doc_id, sample (from 1), n_pieces, ids_crc32, logprob, perturbed, log_inclusion, round_trip`, and the
    ids (int32, little-endian) on request.

    logprob is of the segmentation among all of the text, log_inclusion the logarithm of the
    probability that it is among the k given the threshold (which a long text's can't be told from 0), round_trip whether decoding gives the text back (the model turns the
    word mark into a blank).  A text has fewer rows than k if it has fewer segmentations; a null or
    empty text has one, without pieces.  Rows are seeded by doc_id, so repeated rows get equal samples.
    Other columns are ignored; an empty table gives an empty one.
    """
    path, columns = path or model_path(), SAMPLE + (", ids binary" if with_ids else "")

    def run(batches):
        vocabulary = pieces(path, alpha)
        for batch in chunks(batches, BYTES_AT_ONCE):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [(doc, text, j, *x) for doc, text, some in zip(ids, texts, sampled(vocabulary, texts, [row_key(i, seed) for i in ids], k)) for j, x in enumerate(some, 1)]
            flat, size = vocabulary.spelt(np.concatenate([x[3] for x in found]))
            told, chars = vocabulary.told_by(flat)
            ends = np.cumsum([len(x[3]) for x in found])
            ends = np.concatenate([[0], np.cumsum(size)])[ends]
            spots = np.concatenate([[0], np.cumsum(chars)])[ends].tolist()
            data, rows, a, b = flat.astype("<u4").tobytes(), [], 0, 0
            for (doc, text, j, _, logprob, perturbed, inclusion), end, spot in zip(found, ends.tolist(), spots):
                packed, said = data[4 * a : 4 * end], told[b + (told[b : b + 1] == b" ") : spot]
                rows.append((doc, j, end - a, zlib.crc32(packed), logprob, perturbed, inclusion, said == (text or "").encode("utf-8", "surrogatepass"), packed))
                a, b = end, spot
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.binary()][: 8 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in columns.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`doc_id, ids` (array of int) of whole texts by the model itself; null texts are empty."""
    path = path or model_path()

    def run(batches):
        sp = pieces(path).processor
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sp.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """`doc_id, text` of `doc_id, ids`; a null list is an empty text."""
    path = path or model_path()

    def run(batches):
        vocabulary = pieces(path)
        for batch in batches:
            texts = [vocabulary.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
