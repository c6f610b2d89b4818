"""Token ids of a rank file, for operators that only need ids: the same ids as the vocabulary's own library gives."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import tiktoken

from .bpe import encoder


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: The end mark of the vocabulary and its split pattern.
END_MARK, END_ID = "<|endoftext|>", 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("marlstone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END_MARK: END_ID})


def ids_of(text: str | None, path: str) -> np.ndarray:
    """Ids as uint32; the end mark in a text is its own token, null is empty. Where the library's split pattern reaches its
    limit (about a million blanks on end), operator 2's encoder, which has none, encodes the whole text; it reads the
    vocabulary file that stands beside the rank file."""
    if not text:
        return np.empty(0, dtype="<u4")
    try:
        ids = _encoding(path).encode_to_numpy(text, allowed_special={END_MARK})
    except ValueError:
        ids = encoder(str(Path(path).with_suffix(".json"))).encode(text)
    return np.asarray(ids, dtype="<u4")
