"""Bit arrays that many tasks fill together: bounded Bloom filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

SEGMENT_BITS = 1 << 16
BITS_PER_ITEM, MAX_BITS = 16, 1 << 28


def size_for(items: int, bits_per_item: int = BITS_PER_ITEM, max_bits: int = MAX_BITS) -> int:
    """A power of two: bits_per_item for each item, up to max_bits (32 MB)."""
    return min(max_bits, max(SEGMENT_BITS, 1 << int(items * bits_per_item - 1).bit_length()))


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def marked(flags: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = places(h, len(flags))
    return flags[a] & flags[b]


def marked_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same for a filter of eight bits a byte."""
    a, b = places(h, 8 * len(bits))
    return (bits[a >> 3] >> (7 - (a & 7)) & bits[b >> 3] >> (7 - (b & 7)) & 1).astype(bool)


def packed(flags: np.ndarray) -> bytes:
    """A segment as set positions while that is shorter, else as bits."""
    at = np.flatnonzero(flags)
    return b"p" + at.astype(np.uint16).tobytes() if 2 * len(at) < len(flags) // 8 else b"b" + np.packbits(flags).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"b":
        return np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).astype(bool)
    flags = np.zeros(SEGMENT_BITS, bool)
    flags[np.frombuffer(data, np.uint16, offset=1)] = True
    return flags


def id_hash(ids: np.ndarray) -> np.ndarray:
    return tk.mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def gathered(parts: DataFrame, bits: int) -> np.ndarray:
    """The filter of (segment, bits) rows, eight bits a byte: bits / 8 bytes in all."""
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r.segment * SEGMENT_BITS // 8 : (r.segment + 1) * SEGMENT_BITS // 8] = np.packbits(unpacked(r.bits))
    return out


def of_ids(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the one long column of ids, eight bits a byte; bounded by MAX_BITS."""
    bits = size_for(max(ids.count(), 1))

    def fill(batches):
        flags = np.zeros(bits, bool)
        for batch in batches:
            for place in places(id_hash(batch.column(0).to_numpy()), bits):
                flags[place] = True
        for s in range(0, bits, SEGMENT_BITS):
            own = flags[s : s + SEGMENT_BITS]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([s // SEGMENT_BITS], pa.int32()), pa.array([packed(own)], pa.binary())], names=["segment", "bits"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[s] = held[s] | unpacked(b) if s in held else unpacked(b)
        for s, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([packed(own)], pa.binary())], names=["segment", "bits"])

    schema = "segment int, bits binary"
    return gathered(ids.mapInArrow(tk.released(fill), schema).repartition("segment").mapInArrow(tk.released(merge), schema), bits)


def maybe_in(spark: SparkSession, bits: np.ndarray, column: Column) -> Column:
    """Whether the long column may be in the filter: what is certainly not in it needs no
    join.  Only this column is sent to Python."""
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(ids: pd.Series) -> pd.Series:
        return pd.Series(marked_bits(sent.value, id_hash(ids.to_numpy(np.int64))))

    return test(column)
