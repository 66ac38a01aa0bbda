"""Token ids of the public byte-level BPE, read once in each Python worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str, pattern: str, special: str = "<|endoftext|>"):
    """text -> unsigned 32-bit ids as the tokenizer file at json_path gives them.

    The same vocabulary as ranks is several times faster; texts that hold the special token's string,
    which the tokenizer file reads as one id, go to the tokenizer itself.
    """
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @lru_cache(maxsize=1)
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    def encode(text: str) -> np.ndarray:
        if special in text:
            return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def public_paths() -> tuple[str, str, str]:
    """The parameters of encoder() for the public vocabulary of about 50,000 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
