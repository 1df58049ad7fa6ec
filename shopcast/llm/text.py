"""Byte-level text helpers shared by the operators: Arrow batches in, numpy out.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All hashes
are polynomial prefix sums modulo 2**64, so the hash of any byte range or word
range costs two look-ups however long the range is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1          # odd, so it has an inverse modulo 2**64
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_table(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every executor."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(BASE) + U64(seed))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
IS_LETTER = np.zeros(256, bool)   # ASCII letters and all bytes of other scripts' characters
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = random_table(256, 17)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept and grown per worker)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, U64)
            p[1:] = U64(b)
            out.append(np.multiply.accumulate(p))
        _powers[base] = have = (out[0], out[1])
    return have


def string_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n+1 offsets of its rows (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = (int(off[0]), int(off[-1])) if len(col) else (0, 0)
    return raw[lo:hi], off - lo


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes; one long text is one run."""
    if not batch.num_rows:
        return
    _, off = string_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_bounds(raw: np.ndarray, off: np.ndarray, within: np.ndarray = ~IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of ``within`` bytes, and for each text the index of its first (n+1 values)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    w = within[raw]
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    edges = off[:-1][off[:-1] < off[1:]]
    before[edges] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    after[edges[1:] - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_sums(raw: np.ndarray, base: int = BASE, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    out = np.zeros(len(raw) + 1, U64)
    up, _ = powers(len(raw) + 1, base)
    np.cumsum(values[raw] * up[:len(raw)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = BASE) -> np.ndarray:
    """Unmixed polynomial hash of each byte range [lo, hi)."""
    _, down = powers(len(sums), base)
    return (sums[hi] - sums[lo]) * down[lo]


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = False
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixed hash of each word, word starts, word ends, first word of each text."""
    if lower:
        raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, off)
    return mix(range_hashes(prefix_sums(raw), starts, ends)), starts, ends, first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words inside a text, and the text of each run.

    A text with fewer than k words (but at least one) has one run: all its words.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = first[:-1][owner] + within
    length = np.minimum(n, k)[owner]
    sums = np.zeros(len(words) + 1, U64)
    up, down = powers(len(words) + 1)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return mix((sums[at + length] - sums[at]) * down[at] + length.astype(U64)), owner
