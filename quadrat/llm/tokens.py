"""Public tokenizers, as functions from text to numpy ids.  Paths are parameters; nothing is copied."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: White space in one run that the fast tokenizer's pattern surely gets over; it looks for a blank's
#: successor by stepping back, and its stack of steps ends at a million.
RUN = re.compile(r"\s{100000}")


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _special(file: str) -> dict[str, int]:
    """Special tokens and their ids; the rest of the file, vocabulary and merges, isn't parsed."""
    with open(file, encoding="utf-8") as f:
        text = f.read()
    start = text.find('"added_tokens"')
    return {x["content"]: x["id"] for x in json.JSONDecoder().raw_decode(text, text.index("[", start))[0]} if start >= 0 else {}


def _ranks(file: str) -> dict[bytes, int]:
    with open(f"{os.path.splitext(file)[0]}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def byte_bpe(file: str, special: bool = False) -> Callable[[str], np.ndarray]:
    """Byte-level BPE of a `tokenizers` file (.json).  With special, the strings of its special tokens
    in a text are those tokens, else plain text.

    The rank file of the same name beside it holds the same vocabulary, and tiktoken encodes several
    times faster with it.  It fails on very long runs of white space, so texts with such a run are
    left to `tokenizers` itself; the ids are the same.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    named = _special(file) if special else {}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(file), special_tokens=named)
    slow: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        if len(text) >= 100_000 and RUN.search(text):
            if not slow:
                slow.append(Tokenizer.from_file(file))
                slow[0].encode_special_tokens = not special
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.int64)
        return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(np.int64)  # all that are named

    return encode


@lru_cache(maxsize=4)
def byte_pieces(file: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary: the rank file has them decoded, special tokens are their strings."""
    out = {i: name.encode() for name, i in _special(file).items()} | {i: piece for piece, i in _ranks(file).items()}
    return [out.get(i, b"") for i in range(max(out) + 1)]


@lru_cache(maxsize=4)
def piece_bpe(file: str) -> Callable[[str], np.ndarray]:
    """A SentencePiece model, which puts a blank before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    return lambda text: np.array(model.encode(text, num_threads=1), np.int64)


@lru_cache(maxsize=4)
def piece_bytes(file: str) -> list[bytes]:
    """Bytes of each piece: UTF-8 with U+2581 as a blank, and the byte that a byte piece names."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return [piece(i) for i in range(model.get_piece_size())]
