"""Words and rolling n-gram hashes of UTF-8 texts, in numpy.

A word is a run of bytes other than space and 0x09-0x0D. Words become 64-bit polynomial hashes, n-grams polynomial hashes
over those; texts are scanned in chunks, so memory stays bounded however long a text is.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(71))
IS_WS = np.zeros(256, bool)
IS_WS[[0x20, *range(0x09, 0x0E)]] = True
_NEXT_WS = re.compile(rb"[\x20\x09-\x0D]")
#: Longer words (in bytes) are hashed whole by blake2b.
LONG_WORD = 4096
CHUNK = 1 << 19
with np.errstate(over="ignore"):
    _BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _BYTE[IS_WS] = 0
    _POW = np.cumprod(np.full(LONG_WORD, 0x9E3779B97F4A7C15, np.uint64))
ROLL = np.uint64(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _whole(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _chunk(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = IS_WS[buf]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = starts[0]
    buf, starts, ends = buf[first:], starts - first, ends - first
    at = np.arange(len(buf)) - np.repeat(starts, np.diff(starts, append=len(buf)))
    hashes = np.add.reduceat(_BYTE[buf] * _POW[at & (LONG_WORD - 1)], starts)
    lens = ends - starts
    hashes = mix64(hashes ^ lens.astype(np.uint64))
    for i in np.flatnonzero(lens > LONG_WORD):
        hashes[i] = _whole(buf[starts[i] : ends[i]].tobytes())
    chars = np.add.reduceat(((buf & 0xC0) != 0x80) & ~space[first:], starts, dtype=np.int64)
    return hashes, chars


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length in code points of every word."""
    n, pos, found = len(data), 0, []
    while pos < n:
        end = min(pos + CHUNK, n)
        if end < n:
            cut = max(data.rfind(bytes([c]), pos, end) for c in (0x20, *range(0x09, 0x0E)))
            if cut < 0:  # one word fills the chunk
                m = _NEXT_WS.search(data, end)
                end = m.start() if m else n
                chars = sum(int(((np.frombuffer(data, np.uint8, min(CHUNK, end - i), i) & 0xC0) != 0x80).sum()) for i in range(pos, end, CHUNK))
                found.append((np.array([_whole(data[pos:end])], np.uint64), np.array([chars], np.int64)))
                pos = end
                continue
            end = cut + 1
        found.append(_chunk(np.frombuffer(data, np.uint8, end - pos, pos)))
        pos = end
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(found) == 1:
        return found[0]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def roll(grams: np.ndarray, words_: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows from those of all windows a word shorter."""
    return grams[:-1] * ROLL + words_[n - 1 :] if len(grams) > 1 else grams[:0]


def windows(words_: np.ndarray, n: int) -> np.ndarray:
    grams = words_
    for k in range(2, n + 1):
        grams = roll(grams, words_, k)
    return grams


def texts(col: pa.Array):
    """The bytes of each text of an Arrow column, None for null."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return
    at = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].tolist()
    data = memoryview(col.buffers()[2]) if col.buffers()[2] is not None else memoryview(b"")
    null = col.is_null().to_numpy(zero_copy_only=False) if col.null_count else None
    for i in range(len(col)):
        yield None if null is not None and null[i] else bytes(data[at[i] : at[i + 1]])
