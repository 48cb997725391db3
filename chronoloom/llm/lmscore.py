"""Language-model scores from a log-frequency Bloom filter.

Tokens are words (maximal runs of other than ASCII white space, A-Z
lower-cased) and one end of text.  Documents whose id's crc32 leaves the
remainder ``held`` modulo ``modulus`` are held out; all others train.  The runs of 1 to
``order`` tokens (a start of text before the first) are counted exactly over the
whole corpus.  A count is quantised to a level on a scale that grows by the factor 1.5; the
filter holds the pairs (run, 1), ..., (run, level), so a level is found by
probing 1, 2, ... until a miss: it is never too low, and too high by d with a
chance of about 0.0065**d.  A token's probability is Dirichlet-smoothed order by
order, (c(hw) + MU p(w|h')) / (c(h) + MU), down to (c(w) + 1) / (N + V + 1); no run
counts more than its context.

Plan: tasks count runs by hash before shuffling and send sorted blobs by segment
(the hash's first bits; the number of segments follows the input's bytes, so a
segment's work is bounded).  A task of the shuffle sums a segment's counts and fills its part of
the filter, BITS bits for each pair at any size of the corpus.  Parts are broadcast
together while they are at most ``max_bytes``; a larger filter goes in rounds of
at most that, and what a round has found is written beside the texts
(a byte for each token and order), so no result depends on the number of rounds.
The exact counts of the base score come from a broadcast of the HOT most frequent
words and, for all others, from a join on the word; frequency is counted over all
documents, so no joined key is frequent.

Edge cases: null and empty texts are one token, the end; null ids hash as the
empty text; repeated rows are documents of their own; without training documents
N and V are 0 and every probability is 1 (scores 0); an empty table gives an
empty result; a very long text is one slice, whole; other columns are ignored,
whatever their names.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import discard, id_and_text, written

MODULUS, HELD, ORDER, MU = 7, 2, 2, 4.0
BITS, PROBES, MAX_BYTES = 12, 4, 1 << 27
SEGMENT_TEXT, FLUSH, BLOB = 8 << 20, 1 << 22, 8192
HOT = 1 << 17
START, END = tk.mix(np.arange(1, 3, dtype=np.uint64))
_LEVEL_STEP = 0x9E3779B97F4A7C15
#: The least count of each level: 1, 2, 3, 4, 6, 8, 12, ... by the factor 1.5, up to 2**62.
LEAST = np.array(sorted({-(-(3**j) // 2**j) for j in range(107)}), np.int64)
#: What a level counts for: the middle of its counts; level 0 is none.
COUNT_OF = np.concatenate([[0.0], (LEAST[:-1] + LEAST[1:] - 1) / 2, [float(LEAST[-1])]])


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, "right")


class Runs:
    """The token sequences of a slice of texts, each with its start and end, one after another."""

    def __init__(self, texts: tk.Texts):
        first, last, bounds = texts.words(tk.SPACE)
        words = np.diff(bounds)
        self.bounds = bounds + 2 * np.arange(len(bounds))
        self.tokens = np.empty(self.bounds[-1], np.uint64)
        row = tk.row_of(bounds)
        self.tokens[np.arange(len(first)) + 2 * row + 1] = tk.segment_hashes(texts.buf, first, last)
        self.tokens[self.bounds[:-1]], self.tokens[self.bounds[1:] - 1] = START, END
        self.n_tokens = words + 1
        self.row = tk.row_of(self.bounds)

    def hashes(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of so many tokens, and the places where they end."""
        at = tk.windows_in_rows(self.bounds, order, len(self.tokens))
        return tk.window_hashes(self.tokens, order)[at], at + order - 1


def _blobs(h: np.ndarray, counts: tuple[np.ndarray, ...], shift: int, single: bool):
    """Rows (segment, single, hashes, counts) of sorted hashes, at most BLOB in each."""
    segment = h >> np.uint64(shift) if shift < 64 else np.zeros(len(h), np.uint64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(h)]])
    out = [(int(segment[s]), single, h[s : min(s + BLOB, b)].tobytes(), b"".join(c[s : min(s + BLOB, b)].astype("<u4").tobytes() for c in counts)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for s in range(a, b, BLOB)]
    if out:
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["segment", "single", "hashes", "counts"])


def _counted(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order, and for each the sums of the weights."""
    by = np.argsort(keys)
    keys = keys[by]
    start = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(keys) else np.zeros(0, np.int64)
    return keys[start], *(np.add.reduceat(w[by], start) if len(keys) else w for w in weights)


def run_counts(rows: DataFrame, order: int, segments: int) -> DataFrame:
    """Sorted blobs of what each task has counted, dealt out by segment: single tokens with
    their counts in training and in all documents, longer runs of training documents with theirs."""
    shift = 64 - (segments - 1).bit_length()

    def run(batches):
        single, longer = [], []

        def flush():
            if single:
                h, train, every = _counted(np.concatenate([h for h, _ in single]), np.concatenate([t for _, t in single]).astype(np.int64), np.ones(sum(len(h) for h, _ in single), np.int64))
                yield from _blobs(h, (train, every), shift, True)
            if longer:
                h, n = np.unique(np.concatenate(longer), return_counts=True)
                once = n == 1  # most are, and need no count
                yield from _blobs(h[once], (), shift, False)
                yield from _blobs(h[~once], (n[~once],), shift, False)
            single.clear()
            longer.clear()

        held = 0
        for batch in batches:
            trains = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, texts in tk.slices(batch.column(2), lut=tk.LOWER):
                runs = Runs(texts)
                own = trains[i:j][runs.row]
                single.append((runs.hashes(1)[0], own))
                for o in range(2, order + 1):
                    h, ends = runs.hashes(o)
                    longer.append(h[own[ends]])
                held += order * len(own)
                if held >= FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "segment int, single boolean, hashes binary, counts binary")


def filled(events: np.ndarray, levels: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of bits, and the packed filter, of hashes with their levels."""
    bits = max(64, -(-BITS * int(levels.sum()) // 64) * 64)
    flags = np.zeros(bits, bool)
    level, left = 1, events
    while len(left):
        for place in _places(left, level, np.full(len(left), bits, np.uint64)):
            flags[place] = True
        left, levels = left[levels > level], levels[levels > level]
        level += 1
    return bits, np.packbits(flags, bitorder="little")


def _places(h: np.ndarray, level: int, bits: np.ndarray):
    key = tk.mix(h + np.uint64(level * _LEVEL_STEP & tk.MASK64))
    low, step = key & np.uint64(0xFFFFFFFF), key >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield ((low + np.uint64(i) * step & np.uint64(0xFFFFFFFF)) * bits >> np.uint64(32)).astype(np.int64)


def filter_parts(blobs: DataFrame) -> DataFrame:
    """A row for each segment: its part of the filter, and its words with exact counts."""
    parts = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def made(segment, rows):
        of = lambda x, kind: np.frombuffer(x, kind)
        single, longer = ([r for r in rows if r[0]], [r for r in rows if not r[0]])
        h1, train, every = _counted(np.concatenate([of(r[1], np.uint64) for r in single]), *(np.concatenate([of(r[2], "<u4").reshape(2, -1)[k] for r in single]).astype(np.int64) for k in (0, 1))) if single else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        h2, n = _counted(np.concatenate([of(r[1], np.uint64) for r in longer]), np.concatenate([of(r[2], "<u4").astype(np.int64) if r[2] else np.ones(len(r[1]) // 8, np.int64) for r in longer])) if longer else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        seen = train > 0
        bits, packed = filled(np.concatenate([h1[seen], h2]), levels_of(np.concatenate([train[seen], n])))
        values = [segment, bits, packed.tobytes(), h1.tobytes(), train.tobytes(), every.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], names=["segment", "n_bits", "bits", "words", "train", "every"])

    def run(batches):
        own, held = None, []
        for batch in batches:
            for segment, *row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if segment != own and held:
                    yield made(own, held)
                    held = []
                own = segment
                held.append(row)
        if held:
            yield made(own, held)

    dealt = blobs.repartition(parts, "segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(run, "segment long, n_bits long, bits binary, words binary, train binary, every binary")


def word_counts(parts: DataFrame) -> DataFrame:
    """hash, train, every: each different token's exact counts in training and in all documents."""

    def run(batches):
        for batch in batches:
            for words, train, every in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (words, train, every)], names=["hash", "train", "every"])

    return parts.select("words", "train", "every").mapInArrow(run, "hash long, train long, every long").where(F.col("hash") != F.lit(int(_start_hash().view(np.int64))))


def _start_hash() -> np.ndarray:
    return tk.window_hashes(np.array([START], np.uint64), 1)[0]


@dataclass
class Levels:
    """Some consecutive segments of the filter: from, to, where each begins (bytes), its bits, and the bytes."""

    first: int
    last: int
    shift: int
    begins: np.ndarray
    bits: np.ndarray
    data: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        """The level of each hash (0: none), by probes until a miss; 0 outside these segments."""
        out = np.zeros(len(h), np.uint8)
        segment = (h >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(h), np.int64)
        at = np.flatnonzero((segment >= self.first) & (segment < self.last))
        own = segment[at] - self.first
        begins, bits = self.begins[own], self.bits[own]
        at, begins, bits = at[bits > 0], begins[bits > 0], bits[bits > 0].astype(np.uint64)
        level = 1
        while len(at):
            hit = np.ones(len(at), bool)
            for place in _places(h[at], level, bits):
                hit &= (self.data[begins + (place >> 3)] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            at, begins, bits = at[hit], begins[hit], bits[hit]
            out[at] = level
            level += 1
        return out


def _rounds(parts: DataFrame, segments: int, max_bytes: int) -> list[tuple[int, int]]:
    """Ranges of segments of at most max_bytes each (one segment at least): a row of sizes a segment."""
    sizes = np.zeros(segments, np.int64)
    for r in parts.select("segment", "n_bits").toLocalIterator():
        sizes[r.segment] = r.n_bits // 8
    out, first, total = [], 0, 0
    for s, size in enumerate(sizes.tolist()):
        if total and total + size > max_bytes:
            out.append((first, s))
            first, total = s, 0
        total += size
    return [*out, (first, segments)]


def _gathered(parts: DataFrame, first: int, last: int, segments: int) -> Levels:
    """The segments first to last on the driver; their bytes are bounded by the caller."""
    held = parts.where((F.col("segment") >= first) & (F.col("segment") < last)).select("segment", "n_bits", "bits")
    begins, bits, data, at = np.zeros(last - first, np.int64), np.zeros(last - first, np.int64), [], 0
    for r in held.toLocalIterator():
        begins[r.segment - first], bits[r.segment - first] = at, r.n_bits
        data.append(np.frombuffer(r.bits, np.uint8))
        at += len(r.bits)
    return Levels(first, last, 64 - (segments - 1).bit_length(), begins, bits, np.concatenate(data) if data else np.zeros(1, np.uint8))


def probabilities(runs: Runs, levels: list[np.ndarray], tokens: int, vocabulary: int) -> np.ndarray:
    """Smoothed probability of every token (0 at starts, which aren't predicted)."""
    counts = [COUNT_OF[x] for x in levels]
    start = np.zeros(len(runs.tokens), bool)
    start[runs.bounds[:-1]] = True
    p = np.minimum(1.0, (counts[0] + 1) / (tokens + vocabulary + 1))
    for o in range(1, len(counts)):
        context = np.zeros(len(p))
        context[1:] = counts[o - 1][:-1]  # of the run of o tokens that ends just before
        ends = runs.hashes(o + 1)[1]
        fits = np.zeros(len(p), bool)
        fits[ends] = True
        own = np.minimum(counts[o], context)
        p = np.where(fits, (own + MU * p) / (context + MU), p)
    p[start] = 0
    return p


SCORED = "_row long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_sum double, score double, cold array<long>"


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, modulus: int = MODULUS, held: int = HELD, max_bytes: int = MAX_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = id_and_text(docs, doc_id, text).select("doc_id", (F.crc32(name.cast("binary")) % modulus == held).alias("held_out"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = 1 << max(4, (size // SEGMENT_TEXT).bit_length())
    parts = written(filter_parts(run_counts(rows, order, segments)), "lm-filter")
    words = word_counts(parts)
    tokens, vocabulary = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()

    top = words.orderBy(F.desc("every"), "hash").limit(hot).select("hash", "train").toArrow()  # hot rows at most
    keys, values = (top.column(c).to_numpy() for c in (0, 1))
    by = np.argsort(keys.view(np.uint64))
    frequent = spark.sparkContext.broadcast((keys.view(np.uint64)[by], values[by]))

    def probed(batch, part, done):
        """Slices of a batch, with the levels found so far and in this part."""
        for i, j, texts in tk.slices(batch.column(3), lut=tk.LOWER):
            runs = Runs(texts)
            found = []
            for o in range(1, order + 1):
                h, ends = runs.hashes(o)
                different, of = np.unique(h, return_inverse=True)
                level = np.zeros(len(runs.tokens), np.uint8)
                level[ends] = part.of(different)[of]
                found.append(level)
            if done is not None:
                before = [np.frombuffer(x, np.uint8).reshape(order, -1) for x in done[i:j].to_pylist()]
                found = [f | np.concatenate([b[k] for b in before]) for k, f in enumerate(found)]
            yield i, j, runs, found

    def onward(part):
        def run(batches):
            for batch in batches:
                out = []
                for _, _, runs, found in probed(batch, part.value, batch.column(4) if batch.num_columns > 4 else None):
                    out += [b"".join(f[a:b].tobytes() for f in found) for a, b in zip(runs.bounds[:-1].tolist(), runs.bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=["_row", "doc_id", "held_out", "text", "levels"])

        return run

    def finish(part):
        def run(batches):
            keys, values = frequent.value
            for batch in batches:
                for i, j, runs, found in probed(batch, part.value, batch.column(4) if batch.num_columns > 4 else None):
                    p = probabilities(runs, found, tokens, vocabulary)
                    said = p > 0
                    row, n = runs.row[said], j - i
                    h = runs.hashes(1)[0][said]
                    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                    known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                    c = np.where(known, values[at], 0) if len(keys) else np.zeros(len(h), np.int64)
                    rare = np.bincount(row[~known], minlength=n)
                    cold = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)]), pa.int32()), pa.array(h[~known].view(np.int64)))
                    sums = [np.bincount(row, w, n) for w in (c > 0, np.log10(c + 1.0), np.log10(p[said]))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k)[i:j] for k in range(3)), pa.array(runs.n_tokens), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), cold], names=["_row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_sum", "score", "cold"])

        return run

    state = rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "held_out", "text")
    turns, before = _rounds(parts, segments, max_bytes), None
    for first, last in turns[:-1]:
        sent = spark.sparkContext.broadcast(_gathered(parts, first, last, segments))
        state = written(state.mapInArrow(onward(sent), "_row long, doc_id long, held_out boolean, text string, levels binary"), "lm-levels")
        sent.unpersist()
        if before is not None:
            discard(before)
        before = state
    sent = spark.sparkContext.broadcast(_gathered(parts, *turns[-1], segments))
    found = written(state.mapInArrow(finish(sent), SCORED), "lm-scores")
    sent.unpersist()
    if before is not None:
        discard(before)

    rare = found.select("_row", F.explode("cold").alias("hash")).join(words.where("train > 0").select("hash", "train"), "hash")
    rare = rare.groupBy("_row").agg(F.count("*").alias("n"), F.sum(F.log10(F.col("train") + 1.0)).alias("total"))
    both = found.drop("cold").join(rare, "_row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    base = plus("hot_sum", F.col("total")) - F.col("n_tokens") * F.log10(F.lit(float(max(tokens, 0) + vocabulary + 1)))
    return both.select("doc_id", "held_out", "n_tokens", plus("hot_known", F.col("n")).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
