"""Token-id output as one wavelet matrix per shard.

Documents go to shards in ascending id order.  A shard's ids are stored as
succinct bit-planes, highest bit first: each plane holds one bit of every id,
in an order that the planes above have stably sorted by theirs, with counts of
ones every 512 bits, so that access, rank, select and counting of any id read
log2(vocabulary) planes of the one compressed file.  Files are rows of a Parquet
table (part, seq, ..., payload) in a folder that all executors share; a payload
can also be written to and read from a file of its own.

Document ids may repeat or be null (nulls first); equal ids are ordered by a
hash of their text.  Null and empty texts hold the end id only.  A shard holds
``shard_ids`` ids or one longer document.  Other columns are ignored, whatever
their names.  An empty table yields no shards.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import id_and_text, shared_dir

MAGIC = b"CLWM0001"
BLOCK = 512
SHARD_IDS = 2_000_000
CACHE_PIECES = 700_000
#: Texts encoded at a time: more of them have fewer kinds of pieces each.
SLICE_BYTES = 1 << 21
END_ID = 2
#: UTF-8 of white space beyond ASCII; texts with it are encoded whole.
WIDE_SPACE = tuple(c.encode() for c in "\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))) + tuple(bytes([c]) for c in range(0x1C, 0x20))
#: Kinds of bytes: 1 ASCII white space, 2 other ASCII than letters and digits, 3 letters, 4 bytes that begin other white space.
_KIND = np.zeros(256, np.uint8)
_KIND[:0x80] = 2
_KIND[0x30:0x3A] = 0
_KIND[[x[0] for x in WIDE_SPACE]] = 4
_KIND[tk.SPACE] = 1
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 3
#: Each byte's character in byte-level vocabularies; newlines, which stand between words, are spaces.
_CHARACTER = np.arange(256, dtype="<u2")
_unprinted = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_CHARACTER[_unprinted] = 0x100 + np.arange(len(_unprinted))
_CHARACTER[0x0A] = 0x20
WORDS_A_TEXT = 1000
SHARDS = "part int, seq int, first_id long, n_documents long, n_ids long, ids_before long, payload binary"


class WaveletMatrix:
    """Bit-planes over a sequence of non-negative integers below 2**levels."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], blocks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.blocks = n, planes, zeros, blocks

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(values.max()).bit_length()) if len(values) else 1
        kind = np.uint16 if levels <= 16 else np.uint32
        values = values.astype(kind)
        planes, zeros, blocks = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (values & kind(1 << level)) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            blocks.append(_block_counts(packed))
            low = np.flatnonzero(~bit)  # places, not masks: random bits defeat branch prediction
            zeros.append(len(low))
            if level:
                values = np.concatenate([values.take(low), values.take(np.flatnonzero(bit))])
        return cls(len(values), planes, zeros, blocks)

    def decode(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last one up."""
        levels = len(self.planes)
        values = np.zeros(self.n, np.uint16 if levels <= 16 else np.uint32)
        for k in range(levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n).astype(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~bit)] = values[: self.zeros[k]]
            above[np.flatnonzero(bit)] = values[self.zeros[k] :] | values.dtype.type(1 << (levels - 1 - k))
            values = above
        return values

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block, byte = i // BLOCK, i // 8
        ones = int(self.blocks[k][block]) + int(np.bitwise_count(self.planes[k][block * BLOCK // 8 : byte]).sum())
        return ones + (int(self.planes[k][byte] >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def _bit(self, k: int, i: int) -> int:
        return self.planes[k][i // 8] >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The value at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            bit = self._bit(k, i)
            value = value << 1 | int(bit)
            i = self.zeros[k] + self._ones(k, i) if bit else i - self._ones(k, i)
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        start = 0
        for k in range(len(self.planes)):
            if value >> (len(self.planes) - 1 - k) & 1:
                start, end = self.zeros[k] + self._ones(k, start), self.zeros[k] + self._ones(k, end)
            else:
                start, end = start - self._ones(k, start), end - self._ones(k, end)
        return start, end

    def rank(self, value: int, end: int) -> int:
        """How often value stands before place end."""
        if value >> len(self.planes):
            return 0
        start, stop = self._range(value, end)
        return stop - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, nth: int) -> int:
        """The place of the nth (from 0) occurrence of value, or -1."""
        if value >> len(self.planes) or nth >= self.count(value):
            return -1
        at = self._range(value, self.n)[0] + nth
        for k in range(len(self.planes) - 1, -1, -1):
            if value >> (len(self.planes) - 1 - k) & 1:
                at = self._select_bit(k, at - self.zeros[k], True)
            else:
                at = self._select_bit(k, at, False)
        return at

    def _select_bit(self, k: int, nth: int, one: bool) -> int:
        ones = self.blocks[k].astype(np.int64)
        before = ones if one else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, nth, "right")) - 1
        bits = np.unpackbits(self.planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8]) == one
        return block * BLOCK + int(np.flatnonzero(bits)[nth - before[block]])


def _block_counts(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of BLOCK bits, and in all."""
    size = BLOCK // 8
    ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % size))).reshape(-1, size).sum(1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])


def to_bytes(ids: np.ndarray, doc_ids: np.ndarray, null_id: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of a shard: header, document table, then plane by plane, each part
    compressed by itself so that a reader of some planes opens only those."""
    matrix = WaveletMatrix.build(ids)
    packer = zstandard.ZstdCompressor(level=1)
    parts = [doc_ids.astype("<i8").tobytes(), np.packbits(null_id).tobytes(), lengths.astype("<i8").tobytes()]
    for plane, blocks in zip(matrix.planes, matrix.blocks, strict=True):
        parts += [plane.tobytes(), blocks.astype("<u4").tobytes()]
    packed = [packer.compress(p) for p in parts]
    head = struct.pack("<8sQQI", MAGIC, len(ids), len(lengths), len(matrix.planes)) + struct.pack(f"<{len(matrix.zeros)}Q", *matrix.zeros)
    return head + struct.pack(f"<{len(packed)}Q", *map(len, packed)) + b"".join(packed)


def from_bytes(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, document ids, flags of null ids, and document lengths of a shard's file."""
    magic, n, documents, levels = struct.unpack_from("<8sQQI", data)
    if magic != MAGIC:
        raise ValueError("not a shard file")
    at = struct.calcsize("<8sQQI")
    zeros = list(struct.unpack_from(f"<{levels}Q", data, at))
    at += 8 * levels
    sizes = struct.unpack_from(f"<{3 + 2 * levels}Q", data, at)
    at += 8 * len(sizes)
    opener, parts = zstandard.ZstdDecompressor(), []
    for size in sizes:
        parts.append(opener.decompress(data[at : at + size]) if size else b"")
        at += size
    planes = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
    blocks = [np.frombuffer(p, "<u4") for p in parts[4::2]]
    flags = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=documents).astype(bool)
    return WaveletMatrix(n, planes, zeros, blocks), np.frombuffer(parts[0], "<i8"), flags, np.frombuffer(parts[2], "<i8")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Tokenizer.from_file(path)


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, twice as long or more if n entries wouldn't fit."""
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(len(array), n - len(array)), array.dtype)])


class Encoder:
    """Ids of texts as the library gives them, each kind of piece encoded once.

    No token of the byte-level vocabulary's pattern goes on from other
    characters into white space, or from a letter into other ASCII than letters and
    digits, so a text may be cut before each run of ASCII white space and between
    letters (up to U+027F) and these; the ids of its pieces, one after the other, are its ids.
    Texts with special strings or other white space are encoded whole.  A piece
    of letters, with a space before them or not, is one token of the pattern: the
    library gets it without the search for the pattern's tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = _tokenizer(path)
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.token_bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.clear()

    def clear(self) -> None:
        self.ids, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.bytes, self.byte_starts = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.int64)
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of hashes
        self.used = self.pieces = 0

    def _ids(self, texts: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and where each text's end."""
        got = [x.ids for x in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(ends[-1]) if len(got) else 0), ends

    def _ids_of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are one token of the pattern each; the bytes of their ids tell where they end."""
        texts = [_CHARACTER[np.frombuffer(b"\n".join(words[k : k + WORDS_A_TEXT]), np.uint8)].tobytes().decode("utf-16-le") for k in range(0, len(words), WORDS_A_TEXT)]
        ids, _ = self._ids(texts, self.merges)
        at, ends = np.cumsum(self.token_bytes[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        if not len(at) or at[-1] != ends[-1]:  # a vocabulary without some bytes
            return self._ids([w.decode() for w in words])
        return ids, np.searchsorted(at, ends) + 1

    def _add(self, keys: list[bytes], plain: np.ndarray) -> np.ndarray:
        """Encodes new pieces and keeps their ids, one after the other; plain ones as words.  Returns their places."""
        place = np.zeros(len(keys), np.int64)
        for words in (True, False):
            at = np.flatnonzero(plain == words)
            if not len(at):
                continue
            own = [keys[k] for k in at.tolist()]
            ids, ends = self._ids_of_words(own) if words else self._ids([k.decode() for k in own])
            self.ids, self.starts = _room(self.ids, self.used + len(ids)), _room(self.starts, self.pieces + len(own) + 1)
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[self.pieces + 1 : self.pieces + 1 + len(own)] = self.used + ends
            data, size = b"".join(own), np.fromiter(map(len, own), np.int64, len(own))
            end = int(self.byte_starts[self.pieces])
            self.bytes, self.byte_starts = _room(self.bytes, end + len(data)), _room(self.byte_starts, self.pieces + len(own) + 1)
            self.bytes[end : end + len(data)] = np.frombuffer(data, np.uint8)
            self.byte_starts[self.pieces + 1 : self.pieces + 1 + len(own)] = end + np.cumsum(size)
            place[at] = np.arange(self.pieces, self.pieces + len(own))
            self.used, self.pieces = self.used + len(ids), self.pieces + len(own)
        return place

    def _find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Places of pieces that are kept, told by their bytes; -1 for others."""
        place = np.full(len(hashes), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = np.flatnonzero(self.hashes[at] == hashes)
            held, s, e = self.place[at[known]], starts[known], ends[known]
            fit = np.flatnonzero(self.byte_starts[held + 1] - self.byte_starts[held] == e - s)
            fit = fit[tk.equal_segments(buf, s[fit], e[fit], self.bytes[: self.byte_starts[self.pieces]], self.byte_starts[held[fit]])]
            place[known[fit]] = held[fit]
        return place

    def _keep(self, hashes: np.ndarray, place: np.ndarray) -> None:
        """From now on the pieces are found; of those with one hash, only the first."""
        hashes, first = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.hashes, hashes)
        if len(self.hashes):
            new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes
            hashes, first, at = hashes[new], first[new], at[new]
        self.hashes, self.place = np.insert(self.hashes, at, hashes), np.insert(self.place, at, place[first])

    def encode(self, texts: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one after the other, and each row's number of ids."""
        buf, raw, n = texts.buf, texts.buf.tobytes(), len(texts.buf)
        if self.pieces > CACHE_PIECES:
            self.clear()
        kind = _KIND[buf]
        latin = np.flatnonzero((buf[:-1] >= 0xC3) & (buf[:-1] < 0xCA))  # U+00C0 to U+027F: letters but for \xd7 and \xf7
        pair = buf[latin].astype(np.int32) << 8 | buf[latin + 1]
        latin = latin[(pair & 0xC0 == 0x80) & (pair != 0xC397) & (pair != 0xC3B7)]
        kind[latin] = kind[latin + 1] = 3
        white, letter, start = kind == 1, kind == 3, np.zeros(n, bool)
        start[1:] = (white[1:] & ~white[:-1]) | (letter[:-1] & (kind[1:] == 2))
        start[texts.offsets[:-1][texts.offsets[:-1] < texts.offsets[1:]]] = True
        for odd in (*self.special, *(WIDE_SPACE if (kind == 4).any() else ())):
            at = raw.find(odd)
            while at >= 0:  # the whole row becomes one piece
                r = int(np.searchsorted(texts.offsets, at, "right")) - 1
                a, b = int(texts.offsets[r]), int(texts.offsets[r + 1])
                start[a + 1 : b] = letter[a:b] = False
                at = raw.find(odd, b)
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        first, inverse = tk.kinds_of(buf, starts, ends)
        s, e = starts[first], ends[first]
        hashes = tk.segment_hashes(buf, s, e)
        place = self._find(buf, s, e, hashes)
        if len(new := np.flatnonzero(place < 0)):
            letters = np.zeros(n + 1, np.int32)
            np.cumsum(letter, out=letters[1:])
            s, e = s[new], e[new]
            own = letters[e] - letters[s]
            plain = (own > 0) & (own + (buf[s] == 0x20) == e - s)
            place[new] = self._add([raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], plain)
            self._keep(hashes[new], place[new])
        begin, length = self.starts[place][inverse], (self.starts[place + 1] - self.starts[place])[inverse]
        total = np.cumsum(length)
        at = np.repeat((begin - (total - length)).astype(np.int32), length)
        at += np.arange(len(at), dtype=np.int32)
        ids = self.ids.take(at)
        sums = np.concatenate([[0], total])
        cut = np.searchsorted(starts, texts.offsets)
        return ids, sums[cut[1:]] - sums[cut[:-1]]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder: what it has encoded serves the worker's next tasks too."""
    return Encoder(path)


tk.HELD["encoder"] = _encoder.cache_clear


def write_shards(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes the documents into shards under path, in ascending id order.

    vocabulary is the path of a tokenizer file installed on every worker."""
    rows = id_and_text(docs, doc_id, text).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def shards(batches):
        encoder, part = _encoder(vocabulary), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, ...]] = []
        seq = before = waiting = 0

        def flush():
            ids, lengths, names, nulls = (np.concatenate(x) for x in zip(*held, strict=True))
            data = to_bytes(ids, names, nulls, lengths)
            held.clear()
            row = {"part": part, "seq": seq, "first_id": None if nulls[0] else int(names[0]), "n_documents": len(lengths), "n_ids": len(ids), "ids_before": before, "payload": data}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for i, j, texts in tk.slices(batch.column(1), SLICE_BYTES):
                own = batch.column(0).slice(i, j - i)
                ids, lengths = encoder.encode(texts)
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, np.uint32(end_id))
                held.append((ids, lengths + 1, own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)))
                waiting += len(ids)
                if waiting >= shard_ids:
                    yield flush()
                    seq, before, waiting = seq + 1, before + waiting, 0
        if held:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SHARDS))
    ordered.mapInArrow(tk.released(shards, "encoder"), SHARDS).write.option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files under path."""
    rows = spark.read.schema(SHARDS).parquet(path)
    start, parts = 0, []
    for r in rows.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator():  # one row a write task
        parts.append((r.part, start))
        start += r.n
    offsets = F.broadcast(spark.createDataFrame(parts, "part int, part_start long"))
    joined = rows.join(offsets, "part").select((F.col("part_start") + F.col("ids_before")).alias("start"), "payload")

    def documents(batch: pa.RecordBatch):
        for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            matrix, names, nulls, lengths = from_bytes(payload.as_py())
            ends = np.cumsum(lengths)
            data = memoryview(matrix.decode().astype("<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            yield {"doc_id": pa.array(names, mask=nulls), "start": first + ends - lengths, "n_tokens": lengths, "ids_crc32": crc}

    return tk.map_batches(joined, "doc_id long, start long, n_tokens long, ids_crc32 long", documents)


def round_trip(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Writes the documents to a new folder and reads the index of their ids back."""
    path = f"{shared_dir(docs.sparkSession)}/wavelet-{uuid.uuid4().hex}"
    write_shards(docs, vocabulary, path, **options)
    return read_shards(docs.sparkSession, path)
