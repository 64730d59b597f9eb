"""Arrow and numpy helpers that the text operators share: blocks of bounded size and hashed tokens.

Everything here works on the UTF-8 bytes of whole texts, in blocks of a few MB, so memory does not
grow with the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20

_POW = np.empty(4096, np.uint64)
_POW[0] = 1
for _i in range(1, len(_POW)):
    _POW[_i] = (int(_POW[_i - 1]) * 0x9E3779B97F4A7C15 + 0) & 0xFFFFFFFFFFFFFFFF

# byte classes: 0 white space, 1 letters, digits and all of the bytes of non-ASCII characters, 2 the rest
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return arr.cast(pa.large_string()) if not pa.types.is_large_string(arr.type) else arr


def blocks(arr: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi with their bytes and offsets into these; null counts as the empty text.

    A block has max_bytes at most, or one longer text.
    """
    arr = pc.fill_null(flat(arr), "")
    n = len(arr)
    if not n:
        return
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _cuts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of about SLICE_BYTES that end where a text or a word ends."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + SLICE_BYTES)
        if to < n:
            k = int(np.searchsorted(offs, to, side="right")) - 1
            if offs[k] > at:
                to = int(offs[k])
            else:
                while to < n:
                    space = np.flatnonzero(_CLASS[data[to : to + 4096]] == 0)
                    if len(space):
                        to += int(space[0])
                        break
                    to += 4096
                to = min(to, n)
                k = int(np.searchsorted(offs, to, side="left"))
                to = min(to, int(offs[k])) if k < len(offs) and offs[k] > at else to
        yield at, to
        at = to


def token_hashes(data: np.ndarray, offs: np.ndarray, split_marks: bool = False, lower: bool = True, shapes: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all tokens in order, and the number of tokens up to each text's start (and end).

    Tokens are runs of non-space bytes; split_marks also splits words from runs of other marks. lower folds
    ASCII and Latin-1 letters. shapes also returns a small number for each token: 0 other, 1 a word in
    capitals of two letters or more, 2 a run of marks.
    """
    out, starts, kinds = [], [], []
    for at, to in _cuts(data, offs):
        b = data[at:to]
        cls = _CLASS[b]
        if not split_marks:
            cls = (cls != 0).astype(np.uint8)
        new = np.empty(len(b), bool)
        new[0] = True
        np.not_equal(cls[1:], cls[:-1], out=new[1:])
        inside = offs[(offs > at) & (offs < to)] - at
        new[inside] = True
        seg = np.flatnonzero(new)
        low = _LOWER[b] if lower else b
        if lower:
            acc = np.flatnonzero(b[:-1] == 0xC3) + 1
            up = acc[(b[acc] >= 0x80) & (b[acc] <= 0x9E) & (b[acc] != 0x97)]
            if len(up):
                low[up] += 0x20
        lens = np.diff(np.append(seg, len(b)))
        inner = np.arange(len(b)) - np.repeat(seg, lens)
        h = np.add.reduceat((low.astype(np.uint64) + np.uint64(1)) * _POW[inner & 4095], seg)
        keep = cls[seg] != 0
        out.append(mix(h[keep]))
        starts.append(seg[keep] + at)
        if shapes:
            caps = np.logical_and.reduceat((b >= 65) & (b <= 90), seg) & (lens > 1)
            kinds.append(np.where(cls[seg] == 2, 2, caps).astype(np.uint8)[keep])
    hs = np.concatenate(out) if out else np.zeros(0, np.uint64)
    pos = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    bounds = np.searchsorted(pos, offs, side="left")
    return (hs, bounds, np.concatenate(kinds) if kinds else np.zeros(0, np.uint8)) if shapes else (hs, bounds)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds; 0 where there are none."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]
