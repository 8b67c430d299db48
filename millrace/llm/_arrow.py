"""Words, lines and hashes of whole Arrow batches of texts, with numpy and without a loop over texts.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits: a polynomial over the bytes, mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(m, x, dtype=np.uint64)))) for x in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about max_bytes of text at most (one longer text is a piece of its own); null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(text)
        batch = batch.set_column(i, text, pc.fill_null(batch.column(i).cast(pa.large_string()), ""))
        ends = np.cumsum(pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # an idle worker keeps no more than it needs


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column without nulls, and the offsets of its texts in them."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def runs(raw: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes outside gap (a mask over the bytes); runs end with their text."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    solid = ~gap
    first, last = solid.copy(), solid.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = solid[heads]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = solid[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(raw, off, _SPACE[raw])


def is_space(raw: np.ndarray) -> np.ndarray:
    return _SPACE[raw]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    power, inverse = _power_tables(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def window_hashes(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of n words within a text: its hash and its text; a text of fewer words is one run of all of them."""
    if not len(hashes):
        return hashes, doc
    count = np.bincount(doc, minlength=int(doc[-1]) + 1)
    out, seed = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64), np.uint64(0xD6E8FEB86659FD93)
    for k in range(n):
        out = mix(out * seed + hashes[k : len(hashes) - n + 1 + k])
    whole = doc[: len(out)] == doc[n - 1 :] if len(out) else np.zeros(0, bool)
    out, at = out[whole], doc[: len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(doc, short)
        rest = np.full(len(short), np.uint64(0x632BE59BD9B4E019))
        for k in range(n - 1):
            there = count[short] > k
            rest[there] = mix(rest[there] * seed + hashes[first[there] + k])
        out, at = np.concatenate([out, rest]), np.concatenate([at, short])
    return out, at
