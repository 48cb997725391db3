"""Benchmark decontamination by a prefix-filtered set join.

An item's windows of ``width`` consecutive words (a shorter item is one window)
are sets of shingles (``SHINGLE`` words, or the whole of a shorter window) that a
document must contain whole.  Shingles are ordered by rarity (document frequency
over the whole corpus), and with a containment threshold of one a window's
necessary prefix is its rarest shingle: only documents with that one can hold
it.  Each place of a prefix shingle in a document proposes the windows that it is
the prefix of; the length bound (the text must reach from the window's first to
its last word) and the positional bound (the shingle must stand at its own
place in the window) leave candidates, and each is verified exactly by the
hash of the item-sized run of document words.  Candidates are made and verified
``CHUNK`` at a time, so that frequent shingles take time but no more memory.

The windows are broadcast while the benchmark has at most ``block_words`` words
(it is measured first); beyond that the benchmark is cut into blocks of that
size: documents are then written once with a key, each block is joined with all of
them, its places are written by key alone, and merged and joined to the documents at the end.

Edge cases: null and empty texts have no words and hit nothing; items without
words have no windows; items without an id count under the empty one; repeated items with one id
count once, repeated documents are judged one by one; an empty benchmark leaves
every document clean; other columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import id_and_text, small_batches, written

WIDTH, SHINGLE = 10, 3
#: Candidates that are made and verified at a time.
CHUNK = 1 << 18
BLOCK_WORDS = 2_000_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WindowIndex:
    """The windows of a block of items under their prefix shingles."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.width = width
        buf = pa.array([t for _, t in items], pa.string())
        hashes: list[np.ndarray] = []
        for _, _, texts in tk.slices(buf, lut=tk.LOWER):
            starts, ends, bounds = texts.words(tk.NOT_ALNUM)
            h = tk.segment_hashes(texts.buf, starts, ends)
            hashes += [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.items = [k for k, _ in items]
        self.words = hashes
        self.sizes = sorted({min(SHINGLE, width, len(h)) for h in hashes if len(h)})
        shingles = [tk.window_hashes(h, min(SHINGLE, width, len(h))) for h in hashes if len(h)]
        self.vocabulary = np.unique(np.concatenate(shingles)) if shingles else np.zeros(0, np.uint64)

    def shingles(self, h: np.ndarray, bounds: np.ndarray, known: np.ndarray):
        """For each size: places of the shingles of rows of word hashes that are among
        the known ones (sorted), and which they are."""
        for size in self.sizes if len(known) else ():
            place = tk.windows_in_rows(bounds, size, len(h))
            found = tk.window_hashes(h, size)[place]
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            same = known[at] == found
            yield place[same], at[same]

    def order(self, frequency: np.ndarray) -> None:
        """Chooses each window's prefix shingle, given their document frequencies."""
        windows: dict[tuple[int, int], tuple[int, set[int]]] = {}
        postings: list[tuple[int, int, int, int]] = []  # shingle, offset, length, window
        for item, h in enumerate(self.words):
            k = min(self.width, len(h))
            if not k:
                continue
            size = min(SHINGLE, k)
            ids = np.searchsorted(self.vocabulary, tk.window_hashes(h, size))
            rank = frequency[ids] * (len(self.vocabulary) + 1) + ids
            for i, key in enumerate(tk.window_hashes(h, k).tolist()):
                if (k, key) in windows:
                    windows[k, key][1].add(item)
                    continue
                offset = int(np.argmin(rank[i : i + k - size + 1]))
                windows[k, key] = (len(windows), {item})
                postings.append((int(ids[i + offset]), offset, k, len(windows) - 1))
        self.keys = np.array([key for _, key in windows], np.uint64)
        self.of_window = [np.array(sorted(x)) for _, x in windows.values()]
        table = np.array(sorted(postings), np.int64).reshape(-1, 4)
        prefix, first, count = np.unique(table[:, 0], return_index=True, return_counts=True)
        self.prefix, self.first, self.count = self.vocabulary[prefix], first, count
        self.offset, self.length, self.window = table[:, 1], table[:, 2], table[:, 3]
        self.lengths = np.unique(self.length)

    def places(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, length and window of all occurrences in rows of word hashes."""
        runs: dict[int, np.ndarray] = {}
        out = [(np.zeros(0, np.int64),) * 3]
        for place, token in self.shingles(h, bounds, self.prefix):
            sums = np.cumsum(self.count[token])
            a = 0
            while a < len(place):
                b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + CHUNK, "right")))
                out.append(self._verified(h, bounds, place[a:b], token[a:b], runs))
                a = b
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _verified(self, h, bounds, place, token, runs):
        n = self.count[token]
        posting = np.repeat(self.first[token] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(place, n)
        start, length = at - self.offset[posting], self.length[posting]
        row = np.searchsorted(bounds, at, "right") - 1
        fits = (start >= bounds[row]) & (start + length <= bounds[row + 1])
        start, length, window = start[fits], length[fits], self.window[posting[fits]]
        same = np.zeros(len(start), bool)
        for k in self.lengths:
            of = np.flatnonzero(length == k)
            if len(of):
                if k not in runs:
                    runs[k] = tk.window_hashes(h, int(k))
                same[of] = runs[k][start[of]] == self.keys[window[of]]
        return start[same], length[same], window[same]


def _blocks(benchmark: DataFrame, item_id: str, text: str, width: int, block_words: int):
    """WindowIndex for each block of items; the number of blocks follows from a count of words."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n // 2 + 1  # a word and its end are two characters at least
    n = -(-words // block_words)
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield n, WindowIndex([(r.item_id, r.text) for r in block.toLocalIterator()], width)


def _frequency(docs: DataFrame, index: WindowIndex) -> np.ndarray:
    """Over all documents: how many hold each shingle of the block's vocabulary."""
    vocabulary = index.vocabulary

    def count(batch: pa.RecordBatch):
        total = np.zeros(len(vocabulary), np.int64)
        for _, _, texts in tk.slices(batch.column(0), lut=tk.LOWER):
            starts, ends, bounds = texts.words(tk.NOT_ALNUM)
            h = tk.segment_hashes(texts.buf, starts, ends)
            for place, at in index.shingles(h, bounds, vocabulary):
                pair = np.unique(at * np.int64(texts.rows) + tk.row_of(bounds)[place])
                total += np.bincount(pair // max(texts.rows, 1), minlength=len(vocabulary))
        used = np.flatnonzero(total)
        return {"word": used, "n": total[used]}

    out = np.zeros(len(vocabulary), np.int64)
    counted = tk.map_batches(docs.select("text"), "word long, n long", count).groupBy("word").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():  # one row a shingle of the block at most
        out[r.word] = r.n
    return out


def _found(index: WindowIndex):
    """Batch function: adds this block's places (start and end word) and item ids."""

    def find(batch: pa.RecordBatch):
        text, spans, items = batch.schema.get_field_index("text"), batch.schema.get_field_index("_spans"), batch.schema.get_field_index("_items")
        for i, j, texts in tk.slices(batch.column(text), lut=tk.LOWER):
            starts, ends, bounds = texts.words(tk.NOT_ALNUM)
            start, length, window = index.places(tk.segment_hashes(texts.buf, starts, ends), bounds)
            row = np.searchsorted(bounds, start, "right") - 1
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(texts.rows + 1))
            part = batch.slice(i, j - i)
            old_spans = part.column(spans).to_pylist()
            old_items = part.column(items).to_pylist()
            for r in np.flatnonzero(np.diff(cut)):
                own = order[cut[r] : cut[r + 1]]
                at = start[own] - bounds[r]
                old_spans[r] = merged([*zip(*[iter(old_spans[r])] * 2), *zip(at.tolist(), (at + length[own]).tolist(), strict=True)])
                got = {index.items[x] for w in np.unique(window[own]) for x in index.of_window[w]}
                old_items[r] = sorted(got.union(old_items[r]))
            columns = [part.column(c) for c in range(part.num_columns)]
            columns[spans], columns[items] = pa.array(old_spans, pa.list_(pa.int64())), pa.array(old_items, pa.list_(pa.string()))
            if (n := part.schema.get_field_index("_n_words")) >= 0:
                columns[n] = pa.array(np.diff(bounds), pa.int64())
            yield [*columns]

    return find


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Union of half-open spans as a flat ascending list: start, end, start, end."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def places(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document as the struct _row, its text, and _n_words, _spans (flat word
    spans that are hit) and _items (ids that occur)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    own = F.col(f"`{text}`").cast("string").alias("text")
    nothing = [F.lit(0).cast("long").alias("_n_words"), F.array().cast("array<long>").alias("_spans"), F.array().cast("array<string>").alias("_items")]
    rows, hits, table = small_batches(docs).select(row, own, *nothing), [], None
    for n, index in _blocks(benchmark, item_id, item_text, width, block_words):
        index.order(_frequency(docs.select(own), index))
        find = _found(index)

        def run(batches, find=find):
            for batch in batches:
                for columns in find(batch):
                    yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        if n == 1:
            return rows.mapInArrow(tk.released(run), rows.schema)
        if table is None:  # the documents are written once, whatever the number of blocks
            table = written(docs.select(F.monotonically_increasing_id().alias("_key"), row, own), "decontam")
        own_hits = table.select("_key", "text", *nothing)
        own_hits = own_hits.mapInArrow(tk.released(run), own_hits.schema).drop("text")
        hits.append(written(own_hits if not hits else own_hits.where(F.size("_spans") > 0), "decontam-hits"))
    if table is None:
        return rows
    every = reduce(DataFrame.unionByName, hits).groupBy("_key").agg(F.max("_n_words").alias("_n_words"), F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))

    def join_spans(batches):
        for batch in batches:
            spans = [merged(list(zip(*[iter(x)] * 2, strict=True))) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), batch.column(3)], names=batch.schema.names)

    return table.join(every.mapInArrow(join_spans, every.schema), "_key").drop("_key")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = id_and_text(docs, doc_id, text)
    found = places(rows, benchmark, **options).select("_row.doc_id", "_n_words", "_spans", "_items")

    def digest(batch: pa.RecordBatch):
        spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        return {"doc_id": batch.column(0), "n_words": batch.column(1), "n_hit": n_hit, "n_items": list(map(len, items)), "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": [x > 0 for x in n_hit]}

    return tk.map_batches(found, SCHEMA, digest)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that no benchmark window occurs in, with all their columns, whatever their names."""
    return places(docs, benchmark, text, **options).where(F.size("_spans") == 0).select("_row.*")


CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest([array_to_string(w[i : i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS win FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT k FROM n),
p AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS win FROM d, s WHERE len(w) >= k),
m AS (SELECT doc_id, n.k, i, item_id FROM p JOIN n ON p.k = n.k AND p.win = n.win),
h AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM m) GROUP BY doc_id),
j AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id)
"""
