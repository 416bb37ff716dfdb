"""Byte-level BPE ids of whole texts, at the speed of a word cache.

The tokenizer never looks across the place before a single space between two characters that are not
white space, so texts are cut there and each part is encoded once per Python worker.  The cache is
bounded; it only saves time.

Parts that the cache lacks go to a second, faster implementation of the same vocabulary where the two are
known to agree: the merges of the file are in the order of their ids, its pre-tokenizer is the plain
byte-level one, and the part holds Latin characters only, whose classes no Unicode version changed.
Everything else is encoded by the tokenizer itself.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

CACHE = 200_000  # parts kept per worker: the first that come, so the frequent ones
LONG_PART = 200  # characters; longer parts are encoded each time

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# str white space contains every character that a tokenizer pattern could take for white space.
_PLACES = re.compile(r"(?<=\S)(?= \S)")
_OTHER = re.compile("[^\x00-\x1b\x20-\x7e\xa1-ɏ]")


class _Odd(Exception):
    """A space of the text stands beside white space, or at an end."""


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Parts(dict):
    """Part of a text, between single spaces, to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode: Callable[[str], list[int]], prefix: str) -> None:
        self.encode, self.prefix = encode, prefix

    def __missing__(self, part: str) -> bytes:
        if not part or part[-1].isspace() or (self.prefix and part[0].isspace()):
            raise _Odd
        ids = _packed(self.encode(self.prefix + part))
        if len(part) <= LONG_PART and len(self) < CACHE:
            self[part] = ids
        return ids


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary to its byte: printable bytes stand for themselves, the others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _fast(path: str) -> Callable[[str], list[int]] | None:
    """The faster implementation of the file's vocabulary, if it is of the kind that both encode alike."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    places = [vocab.get(a + b) for a, b in merges]
    if model.get("type") != "BPE" or model.get("dropout") or places != sorted(p for p in places if p is not None):
        return None
    import tiktoken

    letters, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], bytes]:
    """Text to the bytes of its ids, as the tokenizer file at ``path`` gives them without special tokens added."""
    from tokenizers import Tokenizer

    tokenizer, fast = Tokenizer.from_file(path), _fast(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def one(part: str) -> list[int]:
        return whole(part) if fast is None or _OTHER.search(part) else fast(part)

    spaced, bare = _Parts(one, " "), _Parts(one, "")

    def encode(text: str) -> bytes:
        if any(s in text for s in special):  # their ids are made by the tokenizer, wherever they stand
            return _packed(whole(text))
        try:
            first, *rest = text.split(" ")
            return bare[first] + b"".join(map(spaced.__getitem__, rest))
        except _Odd:
            return b"".join([_packed(one(p)) for p in _PLACES.split(text)])

    return encode
