"""Token links against a walk over the bytes of both token sequences."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrat.llm import align, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def walked(a, b):
    """(groups as pairs of lists of token numbers, links) of byte lengths."""
    at = lambda n: [(int(e - x), int(e)) for e, x in zip(np.cumsum(n), n)]
    sa, sb = at(a), at(b)
    links = [(i, j) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if x < v and u < y]
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    inside = lambda spans, lo, hi: [i for i, (x, y) in enumerate(spans) if lo <= x and y <= hi]
    return [(inside(sa, lo, hi), inside(sb, lo, hi)) for lo, hi in zip([0, *cuts], cuts)], links


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), min_size=1, max_size=40), st.randoms())
def test_bitsets(lengths, random):
    ends = sorted({*random.sample(range(1, sum(lengths)), min(len(lengths), sum(lengths) - 1)), sum(lengths)}) if sum(lengths) > 1 else [1]
    other = np.diff([0, *ends])
    groups, links = walked(lengths, other)
    upto_a, upto_b, link_a, link_b = align.align(np.array(lengths), other)
    assert list(zip(link_a.tolist(), link_b.tolist())) == links
    assert [(list(range(a0, a1)), list(range(b0, b1))) for a0, a1, b0, b1 in zip([0, *upto_a], upto_a, [0, *upto_b], upto_b)] == groups
    text = align.groups_text(np.arange(len(lengths)), np.arange(len(other)), upto_a, upto_b, len(lengths), len(other)).decode()
    assert text == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "The quick brown fox jumps over the lazy dog.", "naïve café — ünïcödé 日本語 🙂\n\n\tx  y", "<|endoftext|> <s> </s> <0x0A>", "▁ is not a blank", "", None, "a", " ", "\n" * 300, "\u0000nul",
    "x" * 200_000, " " * 150_000, "don't we'll 12345 67 --- $$$ " * 60,
]


def expected(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    slow, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    slow.encode_special_tokens = True
    lengths, pieces = tokens.byte_pieces(A), tokens.piece_bytes(B)
    found = []
    for t in texts:
        a, b = (slow.encode(f" {t}", add_special_tokens=False).ids, model.encode(t)) if t else ([], [])
        if not t or any(b"".join(p[i] for i in x) != f" {t}".encode() for p, x in ((lengths, a), (pieces, b))):
            found.append(([], [], [], []))
        elif len(a) > 2000:  # the walk is quadratic
            found.append(None)
        else:
            groups, links = walked([len(lengths[i]) for i in a], [len(pieces[i]) for i in b])
            found.append((a, b, groups, [(a[i], b[j]) for i, j in links]))
    counts = Counter(p for f in found if f for p in set(f[3]))
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    digest = lambda a, b, g: hashlib.sha256(";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in g).encode()).hexdigest() if g else ""
    return [f and (len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(counts[p] == top[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), digest(*f[:3])) for f in found]


@pytest.mark.parametrize("sent", [align.SENT, 3, 0])
def test_links(spark, sent):
    rows = [(i, t, 1, "z") for i, t in enumerate(TEXTS) if t is None or len(t) < 20_000]
    rows += [(None, TEXTS[0], 1, "z"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, `row.x` string").repartition(3)
    got = sorted((tuple(r) for r in align.links(df, sent=sent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)
    assert got == sorted(((r[0], *e) for r, e in zip(rows, expected([r[1] for r in rows]))), key=str)


def test_long_texts_and_empty_table(spark):
    found = {r.doc_id: r for r in align.links(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t and len(t) > 100_000], "doc_id long, text string")).collect()}
    assert all(r.n_a > 1000 and r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best > 0 for r in found.values()) and len(found) == 2
    assert align.links(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fast_ids_are_those_of_the_file():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(A)
    for special in (False, True):
        slow.encode_special_tokens = not special
        for t in [t for t in TEXTS if t] + [c * 120_000 + "<|endoftext|> z" for c in (" ", "\n", " ", "\t ")]:
            assert tokens.byte_bpe(A, special)(t).tolist() == slow.encode(t, add_special_tokens=False).ids
