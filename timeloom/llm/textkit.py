"""Words of many texts at once: positions and 64-bit hashes by array operations, no loop over words.

A chunk of texts is one byte array. Prefix sums of ``code[byte] * BASE**index`` (modulo 2**64) give the hash of any
byte range as a difference, so memory is a few times the chunk, whatever the texts are like. A text longer than a
chunk is cut at white space.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of a 64-bit value spread over all bits (a bijection)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * U(BASE))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: Codes of bytes as they are, and with A-Z lower-cased.
EXACT, LOWER = _CODES, _CODES[_LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, CHUNK + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def pieces(data: bytes) -> Iterator[bytes]:
    """data, cut at white space into pieces of about CHUNK bytes; a longer word stays whole."""
    at = 0
    while len(data) - at > CHUNK:
        spaces = np.flatnonzero(SPACE[np.frombuffer(data, np.uint8, CHUNK, at)])
        if len(spaces):
            end = at + int(spaces[-1]) + 1
        else:
            end = at + CHUNK
            while end < len(data) and not SPACE[data[end]]:
                end += 1
        yield data[at:end]
        at = end
    yield data[at:]


class Words:
    """The words of one chunk: ``row`` (of each word), ``start`` and ``end`` in ``data``, and hashes of byte ranges."""

    def __init__(self, rows: Sequence[int], parts: Sequence[bytes], codes: np.ndarray):
        self.data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        space = SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.row = np.asarray(rows, np.int64)[np.searchsorted(begins, self.start, "right") - 1]
        up, self._down = powers(len(self.data) + 1)
        self._sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(codes[self.data] * up[: len(self.data)], out=self._sums[1:])

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        start, end = self.start if start is None else start, self.end if end is None else end
        return mixed((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


def chunks(texts: Iterable[str | None], codes: np.ndarray = EXACT) -> Iterator[Words]:
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for piece in pieces((text or "").encode("utf-8", "surrogatepass")):
            rows.append(row)
            parts.append(piece)
            size += len(piece) + 1
            if size >= CHUNK:
                yield Words(rows, parts, codes)
                rows, parts, size = [], [], 0
    if parts:
        yield Words(rows, parts, codes)


def word_hashes(texts: Sequence[str | None], codes: np.ndarray = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the words of texts[i] are hashes[bounds[i]:bounds[i + 1]]."""
    counts, found = np.zeros(len(texts) + 1, np.int64), []
    for words in chunks(texts, codes):
        counts[1:] += np.bincount(words.row, minlength=len(texts))
        found.append(words.hashes())
    return np.cumsum(counts), np.concatenate(found) if found else np.zeros(0, np.uint64)


def released() -> None:
    """Gives memory that is no longer used back to the system, as workers outlive their tasks (where the C library can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable, column: str = "text", most: int = 1 << 21) -> Iterator:
    """The batches' rows again in slices of about ``most`` characters of text, in order."""
    for batch in batches:
        sizes = np.cumsum(batch[column].str.len().fillna(0).to_numpy(np.int64) + 16)
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.iloc[at:end]
            at = end
    released()


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    return mixed(a * U(0xA24BAED4963EE407) + mixed(b + U(0x9FB21C651E98DF25)))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n values in a row."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    weights, _ = powers(n)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * weights[k]
    return mixed(total + U(n))


#: Bytes of letters and digits; those of characters beyond ASCII count as letters.
DIGIT, LETTER = np.zeros(256, bool), np.zeros(256, bool)
DIGIT[48:58] = True
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def cores(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, start, end): the words that have a letter or digit, from their first to their last one."""
    n, place = len(words.data), np.arange(len(words.data))
    plain = (DIGIT | LETTER)[words.data]
    after = np.minimum.accumulate(np.where(plain, place, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(plain, place, -1))
    start, end = after[words.start], before[words.end - 1] + 1
    which = np.flatnonzero(start < words.end)
    return which, start[which], end[which]


def counted(mask: np.ndarray) -> np.ndarray:
    """Prefix counts of a mask over bytes."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out
