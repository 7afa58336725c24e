"""Words of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 22  # bytes that are tokenised together
EMPTY = np.zeros(0, np.int64)


def _letters() -> np.ndarray:
    """Bytes of words: ASCII letters and all bytes of longer characters (but see ``words_of``)."""
    b = np.arange(256)
    return ((b | 32) >= 97) & ((b | 32) <= 122) & (b < 128) | (b >= 128)


_LETTER = _letters()
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes spread evenly, one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def words_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words in UTF-8 bytes in lower case: runs of letters. Punctuation and
    symbols of two or three bytes (led by C2 or E2, ideographic and full-width marks) part words too."""
    letter = _LETTER[b]
    for lead, more in ((0xC2, 2), (0xE2, 3)):
        for i in range(more):
            at = np.flatnonzero(b == lead) + i
            letter[at[at < len(b)]] = False
    for lead, second in ((0xE3, 0x80), (0xEF, 0xBC)):
        at = np.flatnonzero((b[:-2] == lead) & (b[1:-1] == second)) if len(b) > 2 else EMPTY
        for i in range(3):
            letter[at + i] = False
    edge = np.diff(letter.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        run = np.cumsum(b.astype(np.uint64) * up[: len(b)] * letter, dtype=np.uint64)
        run = np.concatenate([np.zeros(1, np.uint64), run])
        h = (run[last] - run[first]) * down[first]
    return mixed(h), first


def blocks(texts: pa.Array):
    """(first row, texts) of about BLOCK bytes each; ``texts`` has no nulls."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else EMPTY
    i = 0
    while i < len(texts):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
        yield i, texts.slice(i, j - i)
        i = j


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case as one array of bytes, a line end between them, and where each begins."""
    low = pc.utf8_lower(texts).to_pylist()
    parts = [t.encode("utf-8", "replace") for t in low]
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    return np.frombuffer(b"\n".join(parts), np.uint8), starts
