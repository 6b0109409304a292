"""Near-duplicate documents against brute force over all pairs."""

import random

import corpus_pipeline
from quadrat.llm import near


def plain(text, words=5):
    found = (text or "").lower().split()
    return {tuple(found)} if len(found) <= words else {tuple(found[k : k + words]) for k in range(len(found) - words + 1)}


def smallest(docs, similarity=0.8):
    """Smallest doc_id of each doc's component."""
    sets, label = {d: plain(t) for d, t in docs}, {d: d for d, _ in docs}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    for _ in docs:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_edited_copies_go_in_the_pipeline(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["stone", "river", "lamp", "cloud", "field"]) + str(rng.randrange(300)) for _ in range(n))
    common = text(30)
    docs = [(k, text(n)) for k, n in enumerate([100] * 20 + [400] * 5 + [12] * 5)]
    docs += [(100 + k, edited(rng, docs[k][1], 1 + k % 4)) for k in range(25)]  # 1 to 4 words of 100 or 400
    docs += [(200 + k, docs[k][1] + f"\nread on {k}") for k in range(20)] + [(300, docs[100 - 70][1].upper())]
    docs += [(400 + k, edited(rng, docs[22][1], 8)) for k in range(30)]  # a cluster; many of its pairs aren't similar
    docs += [(500 + k, common + " " + text(20)) for k in range(10)] + [(600, "a b"), (601, "a  b"), (602, "b a"), (603, ""), (604, " "), (605, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    want = smallest(docs)
    assert sum(d != r for d, r in want.items()) > 60 and want[100] == 0 and want[500] == 500
    assert {r.doc_id: r.component_id for r in near.near_duplicates(df).collect()} == want
    kept = corpus_pipeline.dedup_documents(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, r in want.items() if d == r}
    assert corpus_pipeline.dedup_documents(spark, df.limit(0), "").count() == 0


def test_rows_without_a_doc_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "x y"), (3, "x y"), (3, "x y"), (4, "X Y"), (None, "z")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in near.keep_one(df).collect()) == ["3", "3", "None", "None"]


def test_a_shared_passage_makes_no_pairs(spark):
    """Documents with a passage in common that is too little of them: candidates don't grow with the pairs."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage, other = " ".join(word() for _ in range(90)), " ".join(word() for _ in range(9))
    for n in (200, 800):
        docs = [(k, passage + " " + " ".join(word() for _ in range(16 + k % 3)) + (" " + other if k % 5 == 0 else "")) for k in range(n)]
        docs += [(n + k, passage + " " + " ".join(word() for _ in range(k % 4))) for k in range(8)]  # these are similar to one another
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        rows = df.withColumn("node", F.col("doc_id"))
        sets = near._sets(rows, 5).cache()
        keys = near._candidates(sets, 0.8).withColumn("label", F.col("node"))
        assert near._pairs(keys, 0.8).distinct().count() < 8 * n
        sets.unpersist()
        assert {r.doc_id: r.component_id for r in near.near_duplicates(df).collect()} == smallest(docs)


def test_texts_with_one_hash_stay_apart(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z")], "doc_id long, text string").withColumn("node", F.when(F.col("text") == "z", F.lit(8)).otherwise(F.lit(7)).cast("long"))
    named, known = near.apart(rows)
    node = {r.doc_id: r.node for r in named.collect()}
    assert node[1] == node[3] != node[2] and node[4] == 8 and sorted((r["first"], r.n) for r in known.collect()) == [(1, 2), (2, 1), (4, 1)]
