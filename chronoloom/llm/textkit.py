"""Vectorised UTF-8 text primitives shared by the training-data operators.

Everything works on the contiguous byte buffer of an Arrow string column, in
slices of at most ``SLICE_BYTES`` (a longer text is a slice of its own), so
the memory of a Python worker is bounded by the longest text, not by the batch.
Segment hashes absorb eight bytes a step, each through the splitmix finaliser (a
permutation of 64-bit words that is not linear); two given segments agree with
a chance of about 2**-64.  Where equal hashes would hand one segment's content
to another (caches of encodings), the bytes are compared.
Null texts are read as empty ones; operators that tell them apart use the
column's own validity.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
MASK64 = (1 << 64) - 1

#: ASCII white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII digits, ASCII letters and non-ASCII bytes.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x80:] = False
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    NOT_ALNUM[_lo : _hi + 1] = False
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[0x41:0x5B] += 0x20

#: The low n bytes of a 64-bit word.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Segments of more bytes are hashed one by one; shorter ones eight bytes a step, all together.
LONG_BYTES = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _eights(buf: np.ndarray) -> np.ndarray:
    """At every place of buf the eight bytes that begin there, as one word."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every buf[start:end]; another seed gives an independent one."""
    size, eights = ends - starts, _eights(buf)
    state = mix(size.astype(np.uint64) * _LENGTH + np.uint64((seed * 0xA24BAED4963EE407 + 0x2545F4914F6CDD1D) & MASK64))
    at, left = starts, size
    own = None  # the segments that go on; None: all
    while len(left):
        word = eights[at] & _LOW_BYTES[np.minimum(left, 8)]
        if own is None:
            state = mix((state + _STEP) ^ word)
            own = np.flatnonzero((size > 8) & (size <= LONG_BYTES))
            at, left = starts[own] + 8, size[own] - 8
        else:
            state[own] = mix((state[own] + _STEP) ^ word)
            on = np.flatnonzero(left > 8)
            own, at, left = own[on], at[on] + 8, left[on] - 8
    for k in np.flatnonzero(size > LONG_BYTES).tolist():
        state[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes(), seed)
    return state


def same_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> bool:
    """Whether every buf[start:end] equals the bytes of the same number from its place in others on."""
    size, eights = ends - starts, _eights(buf)
    far = np.flatnonzero(size > LONG_BYTES)
    for k in far.tolist():
        if starts[k] != others[k] and buf[starts[k] : ends[k]].tobytes() != buf[others[k] : others[k] + size[k]].tobytes():
            return False
    own = np.flatnonzero((starts != others) & (size <= LONG_BYTES))
    at, to, left = starts[own], others[own], size[own]
    while len(left):
        if ((eights[at] ^ eights[to]) & _LOW_BYTES[np.minimum(left, 8)]).any():
            return False
        on = np.flatnonzero(left > 8)
        at, to, left = at[on] + 8, to[on] + 8, left[on] - 8
    return True


def equal_segments(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Flags every buf[start:end] that equals as many bytes of other from its place in at on."""
    size, mine, theirs, same = ends - starts, _eights(buf), _eights(other), np.ones(len(starts), bool)
    for k in np.flatnonzero(size > LONG_BYTES).tolist():
        same[k] = buf[starts[k] : ends[k]].tobytes() == other[at[k] : at[k] + size[k]].tobytes()
    own = np.flatnonzero(size <= LONG_BYTES)
    here, there, left = starts[own], at[own], size[own]
    while len(own):
        same[own[((mine[here] ^ theirs[there]) & _LOW_BYTES[np.minimum(left, 8)]) != 0]] = False
        on = np.flatnonzero(left > 8)
        own, here, there, left = own[on], here[on] + 8, there[on] + 8, left[on] - 8
    return same


def kinds_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which segments are equal, told by their bytes: a place of each kind, and each segment's kind."""
    h = segment_hashes(buf, starts, ends)
    coded = pa.array(h).dictionary_encode()
    inverse, first = coded.indices.to_numpy(), np.empty(len(coded.dictionary), np.int64)
    first[inverse[::-1]] = np.arange(len(h) - 1, -1, -1)
    if len(h) and not (((ends - starts) == (ends - starts)[first[inverse]]).all() and same_bytes(buf, starts, ends, starts[first[inverse]])):
        raw, held = buf.tobytes(), {}  # two different segments share a hash
        inverse = np.array([held.setdefault(raw[s:e], len(held)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        _, first = np.unique(inverse, return_index=True)
    return first, inverse


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every k consecutive entries of h; len(h)-k+1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[i : i + n]
    return mix(out + np.uint64(k))


def sequence_hash(h: np.ndarray) -> np.uint64:
    return window_hashes(h, len(h))[0]


class Texts:
    """A slice of rows: their bytes, row boundaries, and what is cut from them."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lut: np.ndarray | None = None):
        self.buf = buf if lut is None else lut[buf]
        self.offsets = offsets
        self.rows = len(offsets) - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of flags (one per byte) over each row."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends of maximal runs of other bytes within rows, and the
        rows' bounds in these arrays."""
        sep = separators[self.buf]
        n = len(sep)
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = sep[:-1], sep[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[edges] = True
        after[edges - 1] = True
        starts = np.flatnonzero(~sep & before)
        ends = np.flatnonzero(~sep & after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends of \\n-split lines (an empty row has one empty line), bounds."""
        cuts = np.flatnonzero(self.buf == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], cuts + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], cuts]), kind="stable")
        per = self.per_row(self.buf == 10) + 1
        return starts, ends, np.concatenate([[0], np.cumsum(per)])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (length rows + 1) of a string column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES, lut: np.ndarray | None = None) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive row ranges (first, last, Texts) of at most limit bytes, or one row."""
    buf, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, Texts(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lut)
        i = j


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For each item its row, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows_in_rows(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Start positions of the k-item windows that stay within one row."""
    last = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(n)
    return at[at + k <= last]


def keyed(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.uint64]:
    """Hashes with their row in the lowest bits, and the mask of those bits."""
    mask = np.uint64((1 << max(1, int(rows - 1).bit_length())) - 1)
    return (h & ~mask) | row.astype(np.uint64), mask


def distinct_per_row(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Number of different hashes of each row."""
    key, mask = keyed(h, row, rows)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] & mask).astype(np.int64), minlength=rows)


def repeated_in_row(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Flags the hashes that their row holds twice or more."""
    key, _ = keyed(h, row, rows)
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


#: What a worker keeps between tasks of one kind, by name: how it is dropped.
HELD: dict[str, Callable[[], None]] = {}


def released(run, keep: str | None = None):
    """run, before which a worker drops what it holds for tasks of other kinds, and after
    which it gives memory that it no longer uses back to the system: workers
    wait for their next task beside the JVM, under one limit."""

    def and_give_back(batches):
        for name, drop in HELD.items():
            if name != keep:
                drop()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL(None).malloc_trim(0)

    return and_give_back


def map_batches(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | dict]) -> DataFrame:
    """df.mapInArrow with a function of one batch that returns a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = work(batch)
            for out in [made] if isinstance(made, dict) else made:
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name].cast(f.type) for f in fields], names=fields.names)
                if out.num_rows:
                    yield out

    return df.mapInArrow(released(run), schema)
