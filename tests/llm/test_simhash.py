import random

import numpy as np
import xxhash

from quadrat.llm import simhash
from quadrat.llm.components import components


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ("", " \t\n", "One", "one two", "A b C d", "ÄÖ x y z z z", "the cat " * 700):
        assert simhash.fingerprint(text) & (2**64 - 1) == plain(text)
    assert simhash.fingerprint(None) == 0


def test_anchors_meet():
    rng = np.random.default_rng(1)
    for flips in (0, 1, 2, 3):
        for _ in range(60):
            x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
            y = x
            for b in rng.choice(64, flips, replace=False):
                y ^= 1 << int(b)
            (kx, _), (ky, _) = (simhash.anchors(np.array([v], np.uint64).view(np.int64)) for v in (x, y))
            assert set(kx.tolist()) & set(ky.tolist())
            assert len(set(kx.tolist())) == len(kx) <= 32


def test_links_connect_just_what_brute_force_does(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = set(base)
    for b in base[:6]:  # chains and dense groups
        x = b
        for _ in range(30):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
    for _ in range(150):
        fps.add(base[0] ^ (1 << rng.randrange(10)) ^ (1 << rng.randrange(10)) ^ (1 << rng.randrange(10)))
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for block in (2048, 16):  # whole groups, and groups cut in blocks
        got = {r.node: r.root for r in components(simhash.links(df, 2, block)).collect()}
        groups, want = {}, {}
        for f in fps:
            groups.setdefault(got.get(signed(f), signed(f)), set()).add(f)
            want.setdefault(find(f), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path(spark):
    order = list(range(40))
    random.Random(1).shuffle(order)
    edges = [*zip(order, order[1:]), (100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, 1), (3, text.upper().lower(), 2), (8, None, 3), (9, " ", 4), (7, "other words here now", 5), (7, "other words here now", 5), (None, text, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [(d, c) for d, _, c in got] == [(0, 3), (3, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 8)]
    texts = {d or 0: t or "" for d, t, _ in rows}
    assert all(f == f"{plain(texts[d]):016x}" for d, f, _ in got)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
