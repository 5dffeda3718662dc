"""Loading public byte-level BPE vocabularies (their paths are parameters)."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import tiktoken


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable
    Latin-1 bytes stand for themselves, the others, in order, for the
    characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def json_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level ``tokenizers`` file whose ids
    follow the order of its merges (checked), without special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_alphabet()
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab["".join(m)] for m in merges]
    if made != sorted(made):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}


@lru_cache(maxsize=4)
def rank_file(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (base64 token, id a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file: found in a text before
    anything else, as they are (checked: no stripping, no whole words)."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    for token in added:
        if token.get("lstrip") or token.get("rstrip") or token.get("single_word"):
            raise ValueError(f"{path}: {token['content']!r} is not matched as it is")
    # Where one is a prefix of another the longer is tried first.
    return {t["content"]: t["id"] for t in sorted(added, key=lambda t: -len(t["content"]))}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """Added tokens of a ``tokenizers`` file are its special tokens."""
    if path.endswith(".json"):
        return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=json_ranks(path), special_tokens=added_tokens(path))
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=rank_file(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: bytes of each id; ids that are not used are empty."""
    ranks = json_ranks(path) | {t.encode(): i for t, i in added_tokens(path).items()} if path.endswith(".json") else rank_file(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table
