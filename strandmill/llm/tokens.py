"""Byte-level BPE ids, for use inside tasks.

The tokenizer splits a text by a fixed pattern and merges bytes within each part only, so the ids of a
text are the ids of its parts in order. Parts repeat far more often than texts; each task keeps the ids of
the parts it has met, in a table that is emptied at a fixed size.

The split's pattern names classes of code points that only the slower engine of ``regex`` knows. For texts below
U+10000 the same classes are written out as ranges, once in a process, for the engine of ``re``; other texts take the
slower one. The parts are the same.

The file's added tokens (``<|endoftext|>``) are cut out of a text before that and have ids of their own.
"""

from __future__ import annotations

import functools
import re

import public_tokenizers
import regex
from tokenizers import Tokenizer

BYTE_BPE_50K = public_tokenizers.path("byte_bpe_50k.json")
CACHED_PARTS = 1_000_000  # about 200 MB


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, others from 256."""
    plain = {b for b in range(256) if chr(b).isprintable() and b != 32}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Parts(dict):
    """Part of a text -> its ids as little-endian unsigned 32-bit integers.

    The tokenizer's model merges the bytes of one part; control strings inside a part are ordinary text.
    """

    def __init__(self, path: str):
        super().__init__()
        self.model, self.letters = Tokenizer.from_file(path).model, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        if len(self) >= CACHED_PARTS:
            self.clear()
        self[part] = packed = b"".join(i.to_bytes(4, "little") for i in ids)
        return packed


def _ranges(name: str) -> str:
    """The code points below U+10000 of a class of ``regex``, as ranges inside brackets."""
    inside = regex.compile(name).match
    held = [c for c in range(0x10000) if inside(chr(c))]
    starts = [c for c, before in zip(held, [-2, *held]) if c != before + 1]
    ends = [c for c, after in zip(held, [*held[1:], -2]) if c != after - 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


@functools.lru_cache(maxsize=1)
def splitter(pattern: str = public_tokenizers.PATTERN):
    """A function text -> its parts in order, as ``regex.findall`` gives them."""
    sets = {name: _ranges(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    sets[r"\S"] = f"^{sets[r'\s']}"

    def written(m: re.Match) -> str:
        if m[0].startswith("["):
            return re.sub(r"\\p\{\w+\}|\\s", lambda inner: sets[inner[0]], m[0])
        return f"[{sets[m[0]]}]"

    low = re.compile(re.sub(r"\[[^]]*\]|\\p\{\w+\}|\\[sS]", written, pattern)).findall
    every, high = regex.compile(pattern).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: every(text) if high(text) else low(text)


@functools.lru_cache(maxsize=4)
def encoder(path: str = BYTE_BPE_50K, added_tokens: bool = False):
    """A function text -> ids as bytes (little-endian, 4 each); null counts as the empty text.

    With ``added_tokens`` the ids are those of ``encode(text, add_special_tokens=False)``; without, added tokens inside a
    text are ordinary text, as with ``encode_special_tokens``.
    """
    parts, split = _Parts(path), splitter()

    def encode(text: str | None) -> bytes:
        return b"".join(map(parts.__getitem__, split(text))) if text else b""

    added = Tokenizer.from_file(path).get_added_tokens_decoder() if added_tokens else {}
    if not added:
        return encode
    if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
        raise ValueError("added tokens that take in their surroundings are not supported")
    own = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
    cut = re.compile("(" + "|".join(re.escape(c) for c in sorted(own, key=len, reverse=True)) + ")")

    def encode_all(text: str | None) -> bytes:
        if not text or not cut.search(text):
            return encode(text)
        return b"".join(own[piece] if i % 2 else encode(piece) for i, piece in enumerate(cut.split(text)))

    return encode_all
