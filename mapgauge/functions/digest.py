"""MD5 of many short messages at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_S = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_G = [i for i in range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
U32 = np.uint32


def _one_block(words: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of n one-block messages; a word of `words` is an int where all messages share it."""
    a, b, c, d = (np.full(n, x, U32) for x in _START)
    f, t = np.empty(n, U32), np.empty(n, U32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        w = words[_G[i]]
        np.add(f, a, out=f)
        if isinstance(w, int):
            np.add(f, U32((w + _K[i]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, U32(_K[i]), out=f)
            np.add(f, w, out=f)
        np.left_shift(f, U32(_S[i]), out=t)
        np.right_shift(f, U32(32 - _S[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)  # what was a is no longer needed
        a, b, c, d = d, a, b, c
    return a + U32(_START[0]), b + U32(_START[1])


def digits_of(first: int, n: int) -> np.ndarray:
    """The decimal digits, as characters, of the n numbers from `first` on, all of one length: a row for each place."""
    width = len(str(first))
    k = np.arange(first, first + n, dtype=np.int64)
    return np.stack([k // 10 ** (width - 1 - p) % 10 + 48 for p in range(width)]).astype(np.uint8)


def md5_48(prefix: bytes, digits: np.ndarray) -> np.ndarray:
    """The first 12 hex digits, as a number, of md5(prefix + digits) for each column of digits (as from digits_of)."""
    width, n = digits.shape
    size = len(prefix) + width
    if size > 55:  # over one block
        start, out = hashlib.md5(prefix), []
        for tail in digits.T.tolist():
            h = start.copy()
            h.update(bytes(tail))
            out.append(int.from_bytes(h.digest()[:6], "big"))
        return np.array(out, np.int64)
    fixed = np.frombuffer((prefix + bytes(width) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")
    words: list = [int(w) for w in fixed]
    for p in range(width):
        at = len(prefix) + p
        moved = digits[p].astype(U32) << U32(8 * (at % 4))
        words[at // 4] = moved | (U32(words[at // 4]) if isinstance(words[at // 4], int) else words[at // 4])
    a, b = _one_block(words, n)
    return a.byteswap().astype(np.int64) << 16 | (b.byteswap() >> U32(16)).astype(np.int64)
