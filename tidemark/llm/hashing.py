"""Vectorised words, rolling hashes and content-chosen anchors over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

R = np.uint64(0x9E3779B97F4A7C15)
R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=np.uint64)
#: What separates words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((R, R_INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def slices(col: pa.Array, most: int = 1 << 20):
    """(first row, offsets, bytes) of consecutive row ranges of at most `most` bytes, or of one longer text."""
    off, data = flat(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a slice: start, end (bytes), doc (row of each word) and ptr (first word of each row)."""

    def __init__(self, off: np.ndarray, data: np.ndarray):
        self.data = data
        solid = ~SPACE[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        self.start = np.flatnonzero(solid & (before | edge[:n]))
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.ptr = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.ptr))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(TABLE[self.data] * up[: len(self.data)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


class Rolling:
    """Hashes of any run of symbols, in constant time each, from prefix sums. Symbols are 64-bit values."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.total[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """mix of the polynomial hash of symbols[start : start + length]."""
        h = (self.total[start + length] - self.total[start]) * self.down[start]
        return mix(h ^ (np.asarray(length).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted; the first place of each; where each place's key is among them (np.unique with both).

    Leading bits and place are sorted as one number, which is several times faster than sorting places by keys. Keys that agree in
    those bits may be left out of order; then the nearly sorted rest is sorted in full.
    """
    n = len(keys)
    if n == 0:
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, low = keys.min(), n.bit_length()
    spread = np.uint64(64 - int(keys.max() - least).bit_length()) if keys.max() > least else np.uint64(0)
    mask = np.uint64((1 << low) - 1)
    both = (keys - least) << spread
    both &= ~mask
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    both &= mask
    turn = both.view(np.int64)
    key = keys[turn]
    if (key[1:] < key[:-1]).any():
        again = np.argsort(key, kind="stable")
        turn, key = turn[again], key[again]
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    at = np.empty(n, np.int64)
    at[turn] = np.cumsum(new) - 1
    return key[new], turn[new], at


def row_runs(ptr: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of `width` symbols that stay inside a row, and the row of each; ptr: first symbol of each row."""
    n = np.maximum(np.diff(ptr) - width + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(n.sum()) - first[row] + ptr[:-1][row], row


def anchors(symbols: np.ndarray, ptr: np.ndarray, window: int, k: int) -> dict[str, np.ndarray] | None:
    """Cut the windows of each row into segments of consecutive windows that share an anchor.

    The anchor of a window is the place of its least hashed run of k symbols (the leftmost of equals), so it depends on the
    window's own content: equal windows have the same anchor at the same offset, wherever they are. Returns, per segment, row,
    anchor, first and last window start, all as symbol places, and key, the hash of the k symbols at the anchor.
    """
    n = len(symbols)
    if n < window:
        return None
    starts, row = row_runs(ptr, window)
    if not len(starts):
        return None
    roll = Rolling(symbols)
    grams = roll.of(np.arange(n - k + 1), k)
    low = (grams & ~np.uint64((1 << 28) - 1)) | np.arange(n - k + 1, dtype=np.uint64)
    width, have = window - k + 1, 1
    while have < width:  # low[i] is the least of have places from i on
        step = min(have, width - have)
        m = len(low) - step
        low = np.minimum(low[:m], low[step:])
        have += step
    at = (low[starts] & np.uint64((1 << 28) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(at)) - 1
    anchor = at[cut]
    return {"row": row[cut], "anchor": anchor, "first": starts[cut], "last": starts[last], "key": grams[anchor], "roll": roll}


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: the first, then the differences in as few whole bytes each as the largest needs."""
    if not len(keys):
        return b""
    gaps = keys[1:] - keys[:-1]
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return keys[:1].astype("<u8").tobytes() + bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[8]
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    full = np.zeros((len(raw) + 1, 8), np.uint8)
    full[0] = np.frombuffer(blob, np.uint8, 8)
    full[1:, :width] = raw
    return np.cumsum(full.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts in 1, 2 or 4 bytes each, as the largest needs; the first byte says how many."""
    width = 1 if not len(n) or n.max() < 1 << 8 else 2 if n.max() < 1 << 16 else 4
    return bytes([width]) + n.astype(f"<u{width}").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)
