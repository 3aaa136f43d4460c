"""Words, shingles and byte counts of Arrow text columns, with numpy on the raw bytes.

Words are maximal runs of bytes other than space, tab, newline, vertical tab, form feed and
carriage return. Work proceeds in windows of half a megabyte that end between words, so
memory is bounded by a batch's text plus eight bytes for each word, however long a text is.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
WINDOW = 1 << 19

IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[list(WHITE)] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_FACTOR = np.uint64(int(_rng.integers(1, 2**62)) * 2 + 1)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batch size: whole texts make batches of the usual size large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def held_out(doc_id: Column | str) -> Column:
    """Rows that no model may learn from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; a null is empty. bounds has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0]: bounds[-1]], bounds - bounds[0]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base):
        out = np.full(n + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows(data: np.ndarray, bounds: np.ndarray):
    """(lo, hi) cuts of data; every cut is at a row's bound or after a white byte."""
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + WINDOW
        if hi < n:
            row = bounds[np.searchsorted(bounds, hi, "right") - 1]
            if row > lo:
                hi = int(row)
            else:
                end = int(bounds[np.searchsorted(bounds, hi, "left")])
                white = np.flatnonzero(IS_WHITE[data[lo:hi]])
                step = hi
                while not len(white) and step < end:
                    white = np.flatnonzero(IS_WHITE[data[step: step + WINDOW]]) + (step - lo)
                    step += WINDOW
                hi = lo + int(white[-1]) + 1 if len(white) else end
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, row of every word)."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for lo, hi in windows(data, bounds):
        part = data[lo:hi]
        n = len(part)
        first, last = np.searchsorted(bounds, lo, "right"), np.searchsorted(bounds, hi, "left")
        cuts = bounds[first:last] - lo  # bounds strictly inside
        solid = ~IS_WHITE[part]
        start, end = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        start[cuts] = solid[cuts]
        end[cuts - 1] = solid[cuts - 1]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        if not len(start):
            continue
        power, inverse = _powers(max(2 * WINDOW, 1 << (n - 1).bit_length()))
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * power[:n], out=prefix[1:], dtype=np.uint64)
        h = (prefix[end] - prefix[start]) * inverse[start]
        hashes.append(mix(h + (end - start).astype(np.uint64)))
        rows.append((np.searchsorted(bounds, start + lo, "right") - 1).astype(np.int32))
    return np.concatenate(hashes), np.concatenate(rows)


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every ``width`` consecutive words of one row."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = width - 1
    first = np.flatnonzero(rows[: len(rows) - last] == rows[last:])
    h = hashes[first]
    for step in range(1, width):
        h = mix(h * _FACTOR + hashes[first + step])
    return h, first


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of every text, A-Z in lower case.

    A text with fewer words than ``width`` has one shingle, all its words; without words, none.
    """
    data, bounds = buffers(column)
    hashes, rows = words(LOWERED[data], bounds)
    n = len(bounds) - 1
    found, first = shingles(hashes, rows, width)
    owner = rows[first]
    cuts = np.searchsorted(owner, np.arange(n + 1))
    sets = [np.unique(found[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
    cuts = np.searchsorted(rows, np.arange(n + 1))
    for i in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(cuts) < width)):
        h = np.full(1, len(hashes[cuts[i]: cuts[i + 1]]), dtype=np.uint64)
        for word in hashes[cuts[i]: cuts[i + 1]]:
            h = mix(h * _FACTOR + word)
        sets[i] = h
    return sets


def byte_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often every row holds every byte value."""
    n = len(bounds) - 1
    out = np.zeros((n, 256), dtype=np.int64)
    for lo, hi in windows(data, bounds):
        first = int(np.searchsorted(bounds, lo, "right")) - 1
        last = int(np.searchsorted(bounds, hi, "left"))
        lengths = np.diff(np.clip(bounds[first: last + 1], lo, hi))
        at = np.repeat(np.arange(last - first), lengths) * 256 + data[lo:hi]
        out[first:last] += np.bincount(at, minlength=(last - first) * 256).reshape(-1, 256)
    return out


def pieces(batch: pa.RecordBatch, text: str, most: int = 2 << 20):
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
