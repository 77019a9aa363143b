"""Token ids of the public byte-level BPE vocabularies.

The same vocabulary comes as a ``.json`` for the *tokenizers* library and as ranks for *tiktoken*. Both give the
same ids (tested); the ranks are several times faster, so they are used first, and the other library takes over for
a text that the first one's pattern engine gives up on. Where the string of a special token stands in a text, it is that
token, as the ``.json`` has it; a vocabulary that comes as ranks alone has no special tokens. None are added.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _file(name: str, kind: str, folder: str | None) -> str:
    return f"{folder}/{name}.{kind}" if folder else vocabulary_path(f"{name}.{kind}")


@lru_cache(maxsize=4)
def special_tokens(name: str, folder: str | None = None) -> dict[str, int]:
    """The special tokens of a vocabulary, by their strings."""
    path = _file(name, "json", folder)
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", []) if t.get("special")}


@lru_cache(maxsize=4)
def _fast(name: str, folder: str | None):
    import public_tokenizers
    import tiktoken

    with open(_file(name, "tiktoken", folder), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special_tokens(name, folder))


@lru_cache(maxsize=4)
def _exact(name: str, folder: str | None):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_file(name, "json", folder))


def token_ids(text: str, name: str = VOCABULARY, folder: str | None = None) -> np.ndarray:
    """The ids of ``text`` as little-endian unsigned 32-bit integers, without added special tokens."""
    try:
        return _fast(name, folder).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
    except BaseException as e:  # the pattern engine panics on some very long runs; its panics aren't Exceptions
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return np.asarray(_exact(name, folder).encode(text, add_special_tokens=False).ids, "<u4")
