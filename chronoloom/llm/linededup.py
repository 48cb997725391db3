"""Line deduplication with two Bloom filters.

Pass 1 hashes every line's key.  Each task keeps two bit arrays, bits set once
and bits set twice; sparse pieces of them are merged by segment (a bit that two
tasks have set counts as set twice), so no key that two documents share can be
missing from the second filter.  Pass 2 tests each line against the second
filter; only suspected repeats are shuffled, as two 64-bit hashes and the
document id, for exact confirmation (smallest and largest document of a key
differ) and the choice of the first occurrence.  Pass 3 drops the lines.

The filters have ``bits_per_line`` bits a line at any size.  One filter has at most
``max_bits`` (32 MB by default; a task holds two of that size, and the second one is what is
broadcast).  More lines than that holds go in rounds: the hashes are dealt to as many
ranges as it takes, and passes 1 and 2 are made for each.  Beyond MAX_ROUNDS more passes would cost
more than they save: filters get fuller then and let more lines through to the exact
step, which grows with the lines alone; the result is the same.

Edge cases: a null or empty text is one empty line, whose key is too short to be
dropped; repeated rows with one id are one document; a null id comes after all
others; ties can't occur, as the smallest id keeps its lines; an empty table
yields an empty result.  A text whose lines are all dropped becomes empty.  Other
columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .bitsets import BITS_PER_ITEM, MAX_BITS, SEGMENT_BITS, gathered, marked_bits, packed, places, size_for, unpacked
from .common import id_and_text, written

MIN_CHARS = 10
BITS_PER_LINE = BITS_PER_ITEM
MAX_ROUNDS = 16
#: Keys that are broadcast: at most so many (2 MB), each held by at least so many documents.
HOT_KEYS, HOT_ROWS = 1 << 16, 1000
LAST_ID = (1 << 63) - 1  # stands for a null id
SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def line_keys(texts: tk.Texts, min_chars: int):
    """starts, ends and row bounds of all lines; hashes of the keys, and whether they are long enough.

    texts must be in lower case."""
    starts, ends, bounds = texts.lines()
    filled = np.flatnonzero(~tk.SPACE[texts.buf])
    a = np.searchsorted(filled, starts)
    b = np.searchsorted(filled, ends)
    some = b > a
    first, last = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    first[some], last[some] = filled[a[some]], filled[b[some] - 1] + 1
    lead = np.zeros(len(texts.buf) + 1, np.int64)
    np.cumsum((texts.buf & 0xC0) != 0x80, out=lead[1:])
    return starts, ends, bounds, tk.segment_hashes(texts.buf, first, last), lead[last] - lead[first] >= min_chars, (first, last)


def _second(texts: tk.Texts, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Another 64-bit hash, with a seed of its own."""
    return tk.segment_hashes(texts.buf, first, last, seed=1)


def rounds_of(rows: DataFrame, bits_per_line: int, max_bits: int) -> tuple[int, int]:
    """How many rounds the lines need, and the bits of each one's filters."""
    n = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
    rounds = min(MAX_ROUNDS, max(1, -(-n * bits_per_line // max_bits)))
    return rounds, size_for(-(-n // rounds), bits_per_line, max_bits)


def _of_round(h: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """Whether hashes belong to a round; by other bits than their places in the filter."""
    return np.ones(len(h), bool) if rounds == 1 else tk.mix(h + np.uint64(rounds)) % np.uint64(rounds) == np.uint64(number)


def twice_seen(rows: DataFrame, bits: int, min_chars: int, number: int = 0, rounds: int = 1) -> np.ndarray:
    """The second filter of a round, eight bits a byte: covers every key of it that two rows hold."""

    def fill(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for _, _, texts in tk.slices(batch.column(1), lut=tk.LOWER):
                *_, bounds, h, long, _ = line_keys(texts, min_chars)
                long &= _of_round(h, number, rounds)
                row = tk.row_of(bounds)[long]
                key, _ = tk.keyed(h[long], row, texts.rows)
                _, at = np.unique(key, return_index=True)  # once for each row
                kinds, n = np.unique(h[long][at], return_counts=True)
                again = kinds[(n > 1) | marked_bits(once, kinds)]
                for own, filled in ((again, twice), (kinds, once)):
                    for at in places(own, bits):
                        np.bitwise_or.at(filled, at >> 3, (0x80 >> (at & 7)).astype(np.uint8))
        step = SEGMENT_BITS // 8
        for s in range(0, bits // 8, step):
            if once[s : s + step].any():
                a, b = (packed(np.unpackbits(x[s : s + step]).astype(bool)) for x in (once, twice))
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s // step], pa.int32()), "once": pa.array([a], pa.binary()), "twice": pa.array([b], pa.binary())})

    def merge(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                a, b = unpacked(a), unpacked(b)
                if s in held:
                    once, twice = held[s]
                    twice |= b | (once & a)
                    once |= a
                else:
                    held[s] = [a, b]
        for s, (_, twice) in held.items():
            if twice.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "twice": pa.array([packed(twice)], pa.binary())})

    parts = rows.mapInArrow(fill, "segment int, once binary, twice binary").repartition("segment").mapInArrow(merge, "segment int, twice binary")
    return gathered(parts.withColumnRenamed("twice", "bits"), bits)  # max_bits / 8 bytes in all


def suspected(rows: DataFrame, min_chars: int, bits_per_line: int, max_bits: int) -> list[DataFrame]:
    """(id, h, g) of the lines that the second filter holds, once for each document; a written table for each round."""
    rounds, bits = rounds_of(rows, bits_per_line, max_bits)
    out = []
    for number in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(twice_seen(rows, bits, min_chars, number, rounds))

        def suspect(batch: pa.RecordBatch, sent=sent, number=number):
            for i, j, texts in tk.slices(batch.column(1), lut=tk.LOWER):
                *_, bounds, h, long, (first, last) = line_keys(texts, min_chars)
                at = np.flatnonzero(long & _of_round(h, number, rounds) & marked_bits(sent.value, h))
                row = tk.row_of(bounds)[at]
                key, _ = tk.keyed(h[at], row, texts.rows)
                at, row = (x[np.unique(key, return_index=True)[1]] for x in (at, row))
                ids = batch.column(0).slice(i, j - i).fill_null(LAST_ID).to_numpy()
                yield {"id": ids[row], "h": h[at].view(np.int64), "g": _second(texts, first[at], last[at]).view(np.int64)}

        out.append(written(tk.map_batches(rows, "id long, h long, g long", suspect), "suspects"))
        sent.unpersist()
    return out


def repeated_lines(rows: DataFrame, min_chars: int, bits_per_line: int, max_bits: int) -> DataFrame:
    """(id, drop): for each document id the hashes of keys whose lines it loses."""
    suspects = reduce(DataFrame.unionByName, suspected(rows, min_chars, bits_per_line, max_bits))
    repeats = suspects.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first <> last")
    repeats = written(repeats.select("h", "g", "first", "n"), "repeats")
    # Rows of the most frequent keys aren't shuffled to one task: those keys, HOT_KEYS at most, go to the rows.
    hot = repeats.where(F.col("n") >= HOT_ROWS).orderBy(F.col("n").desc(), "h", "g").limit(HOT_KEYS).select("h", "g", F.col("first").alias("hot"))
    rows = suspects.join(F.broadcast(hot), ["h", "g"], "left")
    others = rows.where("hot is null").drop("hot").join(repeats.drop("n"), ["h", "g"])
    lost = rows.where("id > hot").select("id", "h").unionByName(others.where("id > first").select("id", "h"))
    return lost.groupBy("id").agg(F.collect_set("h").alias("drop"))  # a set of one document's own lines


def _with_drops(docs: DataFrame, rows: DataFrame, id_column, row, min_chars: int, bits_per_line: int, max_bits: int) -> DataFrame:
    """(row, drop): every document as the column row, and its hashes to drop."""
    drops = repeated_lines(rows, min_chars, bits_per_line, max_bits)
    return docs.select(F.coalesce(id_column, F.lit(LAST_ID)).alias("id"), row.alias("row")).join(drops, "id", "left").select("row", "drop")


def _kept_lines(texts: tk.Texts, raw: np.ndarray, drops: pa.Array, min_chars: int):
    """Per row: lines before, lines dropped, kept text as bytes."""
    starts, ends, bounds, h, long, _ = line_keys(texts, min_chars)
    counts = np.diff(bounds)
    data = raw.tobytes()
    for r, drop in enumerate(drops.to_pylist()):
        a, b = bounds[r], bounds[r + 1]
        if not drop:
            yield int(counts[r]), 0, data[texts.offsets[r] : texts.offsets[r + 1]]
            continue
        lost = long[a:b] & np.isin(h[a:b], np.array(drop, np.int64).view(np.uint64))
        keep = np.flatnonzero(~lost) + a
        yield int(counts[r]), int(lost.sum()), b"\n".join(data[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, bits_per_line: int = BITS_PER_LINE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the digest of the kept text, for every document."""
    rows = id_and_text(docs, doc_id, text)
    joined = _with_drops(rows, rows, F.col("doc_id"), F.struct("doc_id", "text"), min_chars, bits_per_line, max_bits).select("row.*", "drop")

    def drop(batch: pa.RecordBatch):
        for i, j, texts in tk.slices(batch.column(1)):
            low = tk.Texts(texts.buf, texts.offsets, tk.LOWER)
            made = list(_kept_lines(low, texts.buf, batch.column(2).slice(i, j - i), min_chars))
            yield {"doc_id": batch.column(0).slice(i, j - i), "n_lines": [m[0] for m in made], "n_dropped": [m[1] for m in made], "kept_sha256": [hashlib.sha256(m[2]).hexdigest() for m in made]}

    return tk.map_batches(joined, SCHEMA, drop)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, bits_per_line: int = BITS_PER_LINE, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with their kept texts, all other columns as they are; a null text stays null."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    joined = _with_drops(docs, id_and_text(docs, doc_id, text), F.col(f"`{doc_id}`").cast("long"), row, min_chars, bits_per_line, max_bits)
    place, own = docs.columns.index(text), len(docs.columns)

    def drop(batches):
        for batch in batches:
            column = batch.column(place)
            out = []
            for i, j, texts in tk.slices(column):
                low = tk.Texts(texts.buf, texts.offsets, tk.LOWER)
                out += [m[2].decode() for m in _kept_lines(low, texts.buf, batch.column(own).slice(i, j - i), min_chars)]
            columns = [batch.column(c) for c in range(own)]
            columns[place] = pa.array(out, column.type, mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:own])

    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)])
    return joined.select("row.*", "drop").toDF(*plain.names, "drop").mapInArrow(drop, plain).toDF(*docs.columns)  # names with dots can't be sent


REPORT_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
d AS (SELECT k.doc_id, i, line, r.key IS NOT NULL AND k.doc_id > first AS lost FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM d GROUP BY doc_id
"""
