import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrat.llm import packing, tokens


def placed(counts, capacity):
    """(sequence, offset, length) of every document of the plan."""
    keys, firsts, offsets = packing.plan(counts, capacity)
    out = []
    for length in np.flatnonzero(counts):
        for rank in range(counts[length]):
            key = int(length) << 40 | rank
            at = np.searchsorted(keys, key, "right") - 1
            out.append((int(firsts[at] + key - keys[at]), int(offsets[at]), int(length)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_is_gapless_and_whole(lengths):
    found = placed(np.bincount(lengths, minlength=41), 40)
    assert sorted(n for *_, n in found) == sorted(lengths)
    bins = {}
    for s, o, n in found:
        bins.setdefault(s, []).append((o, n))
    for parts in bins.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 40
    if lengths:
        assert len(bins) <= 11 / 9 * -(-sum(lengths) // 40) + 1 + sum(2 * n > 40 for n in lengths)


def test_two_replace_the_smallest():
    # greedy fills 10 with 6 and 3; 2 and 2 fill the place of 3 better
    found = placed(np.bincount([6, 3, 2, 2], minlength=11), 10)
    assert {s for s, *_ in found if (s, 0, 6) in found} and len({s for s, *_ in found}) == 2
    first = [n for s, _, n in found if s == next(s for s, o, n in found if n == 6)]
    assert sorted(first) == [2, 2, 6]


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)]
    assert packing.cuts(8, 4) == [(0, 4), (4, 4)]
    assert packing.cuts(1, 4) == [(0, 1)]


def test_same_ids_as_tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = tokens.byte_bpe(tokens.path("byte_bpe_50k.json"), special=True)

    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=60))
    def same(text):
        assert ours(text).tolist() == whole.encode(text, add_special_tokens=False).ids

    same()
    for text in ("a<|endoftext|>b", "it's  two\n\n lines\t", "naïve Ünïcode 😀 ½ ²_x", ""):
        assert ours(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    rows = [(1, "hello world", 9), (2, None, 9), (2, None, 9), (None, "", 9), (3, "word " * 300, 9), (4, "hello world", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    out = packing.pack_documents(docs, capacity=64).collect()
    ours = tokens.byte_bpe(tokens.path("byte_bpe_50k.json"), special=True)
    want = sorted((d or -1, k, s, n, zlib.crc32(np.r_[ours(t or ""), 0].astype("<u4")[s : s + n].tobytes())) for d, t, _ in rows for k, (s, n) in enumerate(packing.cuts(len(ours(t or "")) + 1, 64)))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) == -(-total // 64)
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    whole = packing.sequences(docs, capacity=64).collect()
    assert sum(len(r.ids) // 4 for r in whole) == total


def test_very_long_texts(spark):
    """Two million blanks, line feeds or letters: the ids of `tokenizers`, in the operator and the pipeline's stage."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    import corpus_pipeline

    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [c * 2_000_000 for c in (" ", "\n", "a")] + ["b" + " " * 1_000_001 + "c<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [np.r_[whole.encode(t, add_special_tokens=False).ids, 0].astype("<u4") for t in texts]
    want = sorted((d, k, zlib.crc32(x[s : s + n].tobytes())) for d, x in enumerate(ids) for k, (s, n) in enumerate(packing.cuts(len(x), packing.CAPACITY)))
    for found in (packing.pack_documents(docs), corpus_pipeline.pack_sequences(spark, docs, "")):
        assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in found.collect()) == want


def test_bad_lengths(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(0,)], "length long"), 8)


def test_repeated_rows_and_clashing_names(spark):
    rows = [(None, 700, "k", 1, 2)] * 40 + [(1, 2048, "k", 1, 2)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long, _salt string, _rank int, _0 int").withColumn("a.b", F.lit(3)).withColumn("Offset", F.lit(4))).collect()
    assert all((r["_salt"], r["_rank"], r["_0"], r["a.b"]) == ("k", 1, 2, 3) for r in got)
    assert len({(r.sequence_id, r.offset) for r in got}) == 41 and len({r.sequence_id for r in got}) == 21
