"""Vectorised views of Arrow text columns, for code that runs inside Spark tasks.

A batch of texts is looked at as one UTF-8 byte buffer plus row offsets, cut into
slices of bounded size, so that word boundaries and rolling hashes are computed by
a few numpy passes and memory does not depend on the batch size Spark chose.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python, and the setting with Spark's own value.
BATCH_BYTES = 8 << 20
_BATCH, _SPARKS_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864"
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Odd multipliers of two independent polynomial hashes and a random value for each byte.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
BYTE_VALUES = _rng.integers(1, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [\x20\x09-\x0D], the blanks between words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets of the rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes; one longer row stands alone."""
    data, offs = text_buffer(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    if which not in _powers or len(_powers[which][0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        base, inverse = BASES[which], pow(BASES[which], -1, 2**64)
        both = []
        for b in (base, inverse):
            p = np.full(size, np.uint64(b), dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[which] = both[0], both[1]
    return _powers[which]


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """n + 1 running sums from which ``span_hash`` takes the hash of any span."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data), which)[0][: len(data)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    inverse = powers(len(prefix) - 1, which)[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes outside ``gap``; runs never cross rows."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~gap[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.unique(offs[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):  # a word on both sides of a row boundary is two words
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return start, end, np.searchsorted(offs, start, side="right") - 1


def unused(name: str, columns: list[str]) -> str:
    """``name``, or the first of name_, name__, ... that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(columns: list[str], results: tuple[str, ...] | list[str]) -> list[str]:
    """The columns that are not named like a result; Spark tells names apart without their case."""
    named = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in named]


def _trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library; nothing to give back by hand
        pass


def frugal(run):
    """A partition function that gives freed memory back to the system at its end, so that idle workers stay small.

    The session's Arrow batches, of 64 MB unless it says otherwise, are made small as well: a task holds one or two
    outside the heap and Python as many.  A value that the user has set stays.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH).rstrip("b") == _SPARKS_BATCH:
        spark.conf.set(_BATCH, str(BATCH_BYTES))

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return wrapped


def to_utf8(column: pa.Array) -> list[bytes]:
    data, offs = text_buffer(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
