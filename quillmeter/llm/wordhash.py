"""Words of Arrow texts as hashes, for Arrow functions: a few passes of numpy over the bytes, no loop over words.

The word rule is that of ``common``: A-Z count as a-z, ASCII letters and digits and all beyond ASCII belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
IS_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    IS_WORD[_lo:_hi] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 0x20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, CHUNK), base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(column: pa.Array, size: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about size bytes, so many rows at most: first row, the bytes, and where each row begins and the last ends."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, first + rows)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk: their hashes, their rows, their first bytes and lengths."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    inside = IS_WORD[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    before[begins] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[begins[begins > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWERED[data].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(bounds, start, side="right") - 1
    return h, row, start, end - start


def shingles(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of every n consecutive words of a row; a row of fewer words, but not none, is one shingle."""
    if not len(h):
        return h, row
    with np.errstate(over="ignore"):
        factor = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
        total = np.zeros(max(len(h) - n + 1, 0), dtype=np.uint64)
        for k in range(n if len(total) else 0):
            total += h[k : k + len(total)] * factor[k]
        whole = row[: len(total)] == row[n - 1 :] if len(total) else np.zeros(0, dtype=bool)
        out, rows = mix(total[whole]), row[: len(total)][whole]
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[begin, len(row)])
        short = size < n
        if short.any():
            inside = np.repeat(short, size)
            place = np.arange(len(h)) - np.repeat(begin, size)
            sums = np.add.reduceat(h[inside] * factor[place[inside]], np.r_[0, np.cumsum(size[short])[:-1]])
            out, rows = np.concatenate([out, mix(sums + size[short].astype(np.uint64))]), np.concatenate([rows, row[begin[short]]])
    return out, rows


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once a row, by row and hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]
