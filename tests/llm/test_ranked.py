"""Threshold search against plain scoring of every document."""

import math
import re
import string
from collections import Counter

import duckdb
import numpy as np
import pytest

from quadrat.llm import queries, ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    said = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in said), sum(sum(c.values()) for _, c in said)
    df = Counter(w for _, c in said for w in c)
    out = []
    for item, query in items.items():
        scores = []
        for i, c in said:
            m = 25 + 75 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in query if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(5)
    some = [f"w{int(x)}" for x in rng.zipf(1.3, 4000).clip(1, 300)]
    texts = [" ".join(some[at : at + int(n)]) for at, n in zip(rng.integers(0, 3900, 300), rng.integers(1, 90, 300))]
    texts += [texts[0]] * 30 + ["", None, "Ünï-CODE w1_w2\tW3", "... !?", "w7 " * 3000, "x" * 300_000 + " w9", "\n" * 300_000]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[5]), (None, None)]


ITEMS = [(1, "w1 w2 w2 w250"), (2, "W7, w9; w3"), (3, None), (4, "nowhere"), (5, "ünï code Ünï"), (6, "w4 w5"), (6, "w4 w5"), (6, "w8"), (None, "w1"), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
ASKED = {1: "w1 w2 w2 w250", 2: "w7 w9 w3", 4: "nowhere", 5: "ünï code Ünï", 6: "w4 w5 w8", 7: "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"}


@pytest.mark.parametrize(("shard", "first", "most"), [(ranked.ROWS, ranked.FIRST, ranked.ITEMS), (20, 1, 40), (7, 3, 9)])
def test_same_as_scoring_all(spark, docs, shard, first, most):
    table = spark.createDataFrame([(i, t, i, "y") for i, t in docs], "doc_id long, text string, score long, `a.b` string").repartition(3)
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, rank int")
    got = rows(ranked.search(table, items, 10, most, shard, first))
    want = plain(docs, {i: words(t) for i, t in ASKED.items()}, 10)
    assert got == want and len(want) > 30


def test_lists_are_read_no_further_than_needed():
    n = 20_000
    m, sizes, ids = np.full(n, 100), np.full(n, 1), np.zeros(n, np.int64)
    shard = ranked.Shard(np.arange(n), np.zeros(n, bool), m + np.arange(n), sizes, ids, np.ones(n, np.int64), 1)
    looked = []
    scored = shard.look_up
    shard.look_up = lambda rows: looked.append(len(rows)) or scored(rows)
    found, scores = shard.top(np.array([0]), np.array([7]), 5)
    assert found.tolist() == [0, 1, 2, 3, 4] and sum(looked) < 100 and (np.diff(scores) <= 0).all()
    # all equal: an unmet document might win by its number, so none is left out
    shard = ranked.Shard(np.arange(n)[::-1].copy(), np.zeros(n, bool), m, sizes, ids, np.full(n, 3), 1)
    assert shard.docs[shard.top(np.array([0]), np.array([7]), 5)[0]].tolist() == [0, 1, 2, 3, 4]


def test_parts_of_a_text(monkeypatch):
    monkeypatch.setattr(ranked, "PART", 10)
    text = "Abc de-f  " * 50 + "é" * 100
    assert [w.decode() for part in ranked.terms(text) for w in part] == words(text)
    assert ranked._lengths(np.array([2**40, 1]), 10**9, 10**12).tolist() == [25 + 75 * 2**40 * 10**9 // 10**12, 25]


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(ranked.search(none, items)) == [] and rows(ranked.search(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), items.limit(0))) == []
    # one document: its terms weigh floor(1000 ln(4 / 3))
    assert rows(ranked.search(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), items.limit(1)))[0][:3] == (1, 1, 1)


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({queries.RANKED_SQL})").fetchall()
    assert rows(queries.op13_threshold_search(spark, sf)) == sorted(want, key=str) and len(want) >= 400
