"""The public vocabularies; they stay where they are installed, and the path is a parameter."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import public_tokenizers
import tiktoken

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding(path: str = RANKS) -> tiktoken.Encoding:
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def added(path: str = JSON) -> dict[str, int]:
    """The JSON tokenizer's added tokens, which stand for themselves in a text, and their ids."""
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
