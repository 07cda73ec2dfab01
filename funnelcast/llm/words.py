"""Vectorised word handling on Arrow string columns.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; these are ASCII, so splitting
UTF-8 bytes is the same as splitting code points. Every routine works on slices of a
few MB (:func:`slices`), so the temporary arrays stay bounded whatever the batch size,
and a single long text is cut at white space, never truncated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK_BYTES)
        up = np.full(size, _MULTIPLIER, np.uint64)
        down = np.full(size, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 document offsets into them (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) document ranges holding at most ``max_bytes`` of text each (one document at least)."""
    _, off = raw(col)
    first, n = 0, len(off) - 1
    while first < n:
        end = int(np.searchsorted(off, off[first] + max_bytes, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


def _blocks(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about BLOCK_BYTES whose borders fall on documents or white space."""
    lo, total = 0, int(off[-1])
    while lo < total:
        hi = lo + BLOCK_BYTES
        if hi >= total:
            hi = total
        else:
            border = int(off[np.searchsorted(off, hi, side="right") - 1])
            if border > lo:
                hi = border
            else:  # inside one long document: go on to the next white space
                nxt = int(off[np.searchsorted(off, lo, side="right")])
                step = hi
                while step < nxt:
                    found = np.flatnonzero(SPACE[buf[step : min(step + 65536, nxt)]])
                    if len(found):
                        step += int(found[0])
                        break
                    step = min(step + 65536, nxt)
                hi = step
        yield lo, hi
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends (byte positions) and words per document."""
    n = len(off) - 1
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(n, np.int64)
    space = SPACE[buf]
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = off[1:] > off[:-1]
    begins, ends = off[:-1][full], off[1:][full] - 1
    first[begins], last[ends] = word[begins], word[ends]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, off))
    return starts, np.flatnonzero(last) + 1, counts


def hashes(buf: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, in order, and the number of words of each document."""
    out, counts, codes = [], np.zeros(len(off) - 1, np.int64), _byte_codes()
    for lo, hi in _blocks(buf, off):
        part = buf[lo:hi]
        inner = off[(off > lo) & (off < hi)] - lo
        edges = np.concatenate([[0], inner, [hi - lo]])
        starts, ends, _ = spans(part, edges)
        if not len(starts):
            continue
        up, down = _powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(codes[LOWER[part] if lower else part] * up[: hi - lo], out=total[1:])
        out.append(mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        which = np.searchsorted(off, starts + lo, side="right") - 1
        counts += np.bincount(which, minlength=len(counts))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def windows(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word window inside one document, and the windows per document."""
    per = np.maximum(counts - (k - 1), 0)
    if not len(h) or len(h) < k:
        return np.empty(0, np.uint64), np.zeros(len(counts), np.int64)
    m = len(h) - k + 1
    total = np.zeros(m, np.uint64)
    for i in range(k):
        total = (total + h[i : i + m]) * np.uint64(_MULTIPLIER)
        total ^= total >> np.uint64(29)
    ends = np.cumsum(counts)
    begins = ends - counts
    index = np.arange(len(h))
    inside = index + k <= np.repeat(ends, counts)
    del begins
    return mix64(total[inside[:m]]), per


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per byte) within each document."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order for running many sequences side by side, longest first.

    Returns (sequence order, token index for each slot, slot border of each step):
    slots ``border[t]:border[t + 1]`` hold token t of the first ``border[t+1]-border[t]``
    sequences in that order.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    begins = (np.cumsum(lengths) - lengths)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than t
    border = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
    t = np.repeat(np.arange(steps), active)
    rank = np.arange(border[-1]) - border[t] if steps else np.empty(0, np.int64)
    return order, begins[rank] + t, border
