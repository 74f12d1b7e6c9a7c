"""Vectorised word shingles of UTF-8 text.

A word is a run of ASCII letters and digits and of any non-ASCII characters, lower-cased.
A shingle is ``size`` consecutive words; a text of fewer words, but at least one, is one shingle.
Words are hashed eight bytes at a time, all words of a text at once, so a text costs a few passes.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64

_word_byte = np.zeros(256, bool)
_word_byte[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros after the end; a view of a padded copy."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def head(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of spans from ``at`` with ``left`` bytes to go, the next eight bytes, zeros beyond the span."""
    shift = (np.uint64(8) * np.maximum(0, 8 - left).astype(np.uint64)) & np.uint64(63)
    return eight[at] << shift >> shift


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of nonempty spans of bytes; equal bytes have equal hashes wherever they lie."""
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(starts):
        return h
    eight = eights(raw)
    some = np.flatnonzero(lengths <= LONG_SPAN)
    at, left = starts[some], lengths[some]
    while len(some):
        h[some] = mix(h[some] * np.uint64(0xD6E8FEB86659FD93) ^ head(eight, at, left))
        go = left > 8
        some, at, left = some[go], at[go] + 8, left[go] - 8
    for i in np.flatnonzero(lengths > LONG_SPAN):
        h[i] = np.frombuffer(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return h


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = _word_byte[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    return span_hashes(raw, starts, ends)


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """64-bit hashes of the shingles of a text in order, repeats included."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[i : i + n])
    return h


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted different shingle hashes of a text."""
    return np.unique(shingle_hashes(text, size))
