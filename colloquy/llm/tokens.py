"""Token ids of the public byte-level BPE vocabulary.

The vocabulary's files lie outside the repository; their place is a parameter.  Ids are those of the
``tokenizers`` file; texts are encoded by the faster ``tiktoken`` with the same ranks, save those that hold
one of the vocabulary's special strings, which go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, as unsigned 32-bit integers.  Build one for a task: it holds some 50 MB."""
    ranks_path = f"{os.path.splitext(path)[0]}.tiktoken"
    from tokenizers import Tokenizer

    plain: Tokenizer | None = None
    special: list[str] = []

    def slow(text: str) -> np.ndarray:
        nonlocal plain
        if plain is None:
            plain = Tokenizer.from_file(path)
        return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)

    if os.path.exists(ranks_path):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in special):
                return slow(text)
            return np.array(fast.encode_ordinary(text), np.uint32)

        return encode
    return slow


def counter(path: str) -> Callable[[str], int]:
    encode = encoder(path)
    return lambda text: len(encode(text))
