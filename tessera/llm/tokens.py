"""Vectorised tokenisation: words of a whole batch of texts at once, with a 64-bit hash of each.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a sum over its eight-byte pieces, each mixed with
its place in the word, so that no arrangement of letters cancels out as it can in a polynomial modulo 2**64. Equal words
have equal hashes at any place and in any batch. Hashes of spans (windows, substrings) are polynomials of such numbers,
taken from prefix sums (an odd base has an inverse modulo 2**64).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(1 << max(16, int(n - 1).bit_length()), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have)
        _tables[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def spans_hash(values: np.ndarray, start: np.ndarray, length: int | np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hashes of values[start:start+length], by prefix sums: a Rabin-Karp hash of each span."""
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64, copy=False) * powers(base, len(values)), out=prefix[1:])
        return (prefix[start + length] - prefix[start]) * powers(pow(base, -1, 2**64), len(values) + 1)[start]


def packed(x: np.ndarray, top: int = 64) -> np.ndarray:
    """Rows in the order of x, numbers below 2**top, and of their places. Numbers and places are sorted as one number, so
    every executor finds the same order; where both do not fit, low bits of x are left out."""
    bits = max(1, (len(x) - 1).bit_length())
    over = max(0, top + bits - 64)
    return (np.sort(x >> np.uint64(over) << np.uint64(bits) | np.arange(len(x), dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def exact(x: np.ndarray, top: int = 64) -> np.ndarray:
    """Rows in the order of x and of their places, whatever bits tell the numbers apart."""
    order = packed(x, top)
    a, b = x[order[:-1]], x[order[1:]]
    return np.argsort(x, kind="stable") if (a > b).any() else order


def buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) with one space after each, and where each begins (with the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    raw = [x.as_py() if x.is_valid else b"" for x in texts.cast(pa.large_binary())] if len(texts) else []
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=offsets[1:])
    return np.frombuffer(b" ".join([*raw, b""]), np.uint8), offsets


def words(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each word, and the number of the first word of each text (with the end).

    plain: A-Z count as a-z and words are runs of letters and digits (all bytes from 128 on are letters).
    """
    if len(data) > 1 << 20 and len(offsets) > 2:  # a text at a time at least: what is held does not grow with the batch
        cut = [0]
        while cut[-1] < len(offsets) - 1:
            cut.append(max(cut[-1] + 1, int(np.searchsorted(offsets, offsets[cut[-1]] + (1 << 20), side="right")) - 1))
        parts = [words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], plain) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        before = np.cumsum([0, *(len(p[0]) for p in parts)])
        start = np.concatenate([p[0] + offsets[a] for p, a in zip(parts, cut, strict=False)])
        first = np.concatenate([*(p[3][:-1] + n for p, n in zip(parts, before, strict=False)), before[-1:]])
        return start, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), first
    solid = np.zeros(len(data) + 2, np.int8)
    if plain:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        solid[1:-1] = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    else:
        solid[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    change = np.diff(solid)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    length = end - start
    return start, length, word_hash(data, start, length), np.searchsorted(start, offsets)


_SEED, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hash(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: the sum of its eight-byte pieces, each mixed with its place, and the length."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(mix((eight[start] & _LOW[np.minimum(length, 8)]) ^ _SEED))
    far = np.flatnonzero(length > 8)
    if len(far):
        many = (length[far] - 1) // 8  # pieces after the first
        first = np.cumsum(many) - many
        place = np.arange(int(many.sum())) - np.repeat(first, many) + 1
        at = np.repeat(start[far], many) + 8 * place
        left = np.minimum(np.repeat(start[far] + length[far], many) - at, 8)
        with np.errstate(over="ignore"):
            out[far] += np.add.reduceat(mix(mix((eight[at] & _LOW[left]) ^ _SEED) + place.astype(np.uint64) * _PLACE), first)
    with np.errstate(over="ignore"):
        return mix(out + length.astype(np.uint64))
