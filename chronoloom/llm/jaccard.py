"""N-gram Jaccard join with signature trees.

A document is the set of its distinct k-word shingles; two link when
100 * intersection >= percent * union.  Links, and the components they form, are
found exactly:

1. Equal sets are one node.
2. Nodes are routed to *canopies* so that linked nodes meet in one.  Linked sets
   differ in at most H shingles, H following from their sizes; a set is dealt by
   hash into m > H segments, the same m for all sets of a size band, and linked
   sets have m - H equal segments or more.  By the prefix principle two sets
   need only be compared when the H + 1 rarest segments of each have one in common;
   rarity comes from counts of the corpus's most frequent shingles.
   A canopy is a connected component of nodes that share digests of these.
3. Each canopy gets a signature tree: leaves are nodes in an order that puts
   similar sets next to each other, every tree node holds the OR of its members'
   token bitmaps, its range of sizes, and the most shingles that share a bit.
   A dual traversal compares pairs of tree nodes and prunes those whose maximum
   possible overlap is too small for their sizes, or whose members are all
   connected already; pairs of leaves that remain are verified on the sets.
4. A canopy of over ``BLOCK_SHINGLES`` is cut into blocks with a tree each, every
   block with the canopy's pivots (the nodes that share most of their digests).
   Nodes outside the canopy's largest component are then traversed against
   all other blocks, so every pair that isn't connected has been compared.

Edge cases: null and empty texts have no shingles and link with nothing; a text
of fewer than k words is one shingle, its whole sequence; repeated rows are
equal sets; a null id is never the smallest of its component unless all are
null; an empty table yields an empty result; other columns are ignored, or carried
along whatever their names.  Very long texts are one set in one task's memory.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitsets
from . import textkit as tk
from .common import discard, id_and_text, written

WORDS, PERCENT = 3, 90
BAND = 1.5
BLOCK_SHINGLES, PIVOTS = 1_000_000, 16
BITS, FAN = 2048, 8
HEAVY_DOCUMENTS, HEAVY_SHINGLES = 8, 1 << 20
#: Shingles that a task of the frequency count holds at a time.
HELD_SHINGLES = 2_000_000
LAST_ID = (1 << 63) - 1


# ------------------------------------------------------------ sets and routing


def shingle_sets(texts: tk.Texts, words: int) -> list[np.ndarray]:
    """Per row: the sorted distinct 64-bit hashes of its shingles."""
    starts, ends, bounds = texts.words(tk.SPACE)
    h = tk.segment_hashes(texts.buf, starts, ends)
    windows = tk.window_hashes(h, words)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(windows[a : b - words + 1]))
        elif b > a:
            out.append(np.array([tk.sequence_hash(h[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """The id of a set: a 64-bit digest of its shingles."""
    raw = int(s.sum(dtype=np.uint64)) * 0xD1342543DE82EF95 + int(np.bitwise_xor.reduce(s)) + len(s)
    return int(tk.mix(np.array([raw & tk.MASK64], np.uint64)).view(np.int64)[0])


@lru_cache(maxsize=None)
def band_limits(band: int) -> tuple[int, int]:
    """Smallest and largest size of a band."""
    low = math.ceil(BAND**band - 1e-9)
    return low, max(low, math.ceil(BAND ** (band + 1) - 1e-9) - 1)


def band_of(size: int) -> int:
    band = max(0, int(math.log(size) / math.log(BAND)))
    while band_limits(band)[1] < size:
        band += 1
    while band and band_limits(band)[0] > size:
        band -= 1
    return band


def may_differ(size: int, other: int, percent: int) -> int:
    """In how many shingles linked sets of these sizes, or smaller ones, differ at most."""
    return (100 - percent) * (size + other) // (100 + percent)


@lru_cache(maxsize=None)
def band_segments(band: int, percent: int) -> int:
    """Segments m of a band: as many as leave each about two shingles (three at 85
    percent and more), and more than the sets of a linked pair differ in."""
    high = band_limits(band)[1]
    return max(may_differ(high, high * 100 // percent, percent) + 1, -(-high // (3 if percent >= 85 else 2)))


NO_HEAVY = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def routing_keys(s: np.ndarray, percent: int, heavy: tuple[np.ndarray, np.ndarray] = NO_HEAVY) -> np.ndarray:
    """Digests of a set's rarest segments, for its own band and, where a smaller
    partner can be in the band below, for that one.

    Of the m segments at most H differ between linked sets, so m - H or more are equal.
    In one order for all sets, the first H + 1 of each then have an equal one
    among them.  The order puts frequent segments last, so that what many sets share
    isn't what brings two together: empty segments, then by the number of sets
    that hold its rarest shingle (heavy: sorted shingles, and their numbers),
    then those of few shingles."""
    size, out = len(s), []
    own = band_of(size)
    bands = [b for b in range(own, -1, -1) if b == own or size * percent <= 100 * band_limits(b)[1]]
    salted = tk.mix(s + np.uint64(0x632BE59BD9B4E019))
    sets = np.zeros(size, np.int64)
    if len(heavy[0]):
        at = np.minimum(np.searchsorted(heavy[0], s), len(heavy[0]) - 1)
        sets = np.where(heavy[0][at] == s, heavy[1][at], 0)
    for band in bands:
        m = band_segments(band, percent)
        keep = may_differ(size, size * 100 // percent if band == own else band_limits(band)[1], percent) + 1
        segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as s is
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        count = np.diff(np.append(first, size))
        digest = np.add.reduceat(salted, first) + tk.mix(segment[first] + np.uint64((band + 1) << 40)) + count.astype(np.uint64)
        if keep < len(first):
            digest = digest[np.lexsort((digest, -count, np.minimum.reduceat(sets, first)))[:keep]]
        out.append(digest)
        if keep > len(first):  # an empty segment equals an empty one
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), segment[first])
            out.append(np.sort(tk.mix(empty + np.uint64((band + 1) << 40)))[: keep - len(first)])
    return tk.mix(np.concatenate(out))


# ------------------------------------------------------------ the signature tree


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.up))), np.int64, len(self.up))


class SignatureTree:
    """Levels of nodes over sets in a locality order; level 0 has one node a set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        size = np.array([len(s) for s in sets], np.int64)
        words = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, s in enumerate(sets):
            bit = s & np.uint64(BITS - 1)
            np.bitwise_or.at(words[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        crowd = size - np.bitwise_count(words).sum(1, dtype=np.int64)
        self.levels = [(words, size, size, crowd)]
        while len(words) > 1:
            cut = np.arange(0, len(words), FAN)
            words = np.bitwise_or.reduceat(words, cut, axis=0)
            low, high, crowd = np.minimum.reduceat(self.levels[-1][1], cut), np.maximum.reduceat(self.levels[-1][2], cut), np.maximum.reduceat(crowd, cut)
            self.levels.append((words, low, high, crowd))

    def may_link(self, level: int, i: np.ndarray, other: SignatureTree, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether pairs of nodes of a level can hold linked sets: their size ranges
        and maximum possible overlap against the least overlap that a link needs."""
        wa, la, ha, ca = self.levels[level]
        wb, lb, hb, cb = other.levels[level]
        ok = (100 * ha[i] >= percent * lb[j]) & (100 * hb[j] >= percent * la[i])
        at = np.flatnonzero(ok)
        a, b = i[at], j[at]
        common = np.bitwise_count(wa[a] & wb[b]).sum(1, dtype=np.int64) + np.maximum(ca[a], cb[b])
        most = np.minimum(np.minimum(ha[a], hb[b]), common)
        ok[at] = (100 + percent) * most >= percent * (la[a] + lb[b])
        return ok


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def locality_order(sets: list[np.ndarray]) -> np.ndarray:
    """Positions by smallest shingle, then by size: copies and near copies stand together."""
    return np.lexsort(([len(s) for s in sets], [s[0] for s in sets]))


def _uniform(tree: SignatureTree, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, least and greatest component label below each node."""
    out = [(label, label)]
    for _ in tree.levels[1:]:
        cut = np.arange(0, len(out[-1][0]), FAN)
        out.append((np.minimum.reduceat(out[-1][0], cut), np.maximum.reduceat(out[-1][1], cut)))
    return out


def dual_traversal(tree: SignatureTree, other: SignatureTree, forest: Forest, places: np.ndarray, other_places: np.ndarray, percent: int, chunk: int = 1 << 15) -> list[tuple[int, int]]:
    """Links (positions in the forest) that join components, between two trees or within one.

    The two trees must have as many levels; places map leaves to the forest."""
    same, links = tree is other, []
    top = len(tree.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    roots = forest.roots()
    ranges, other_ranges = _uniform(tree, roots[places]), _uniform(other, roots[other_places])
    stale = 0
    while stack:
        level, i, j = stack.pop()
        if stale > 64:
            roots = forest.roots()
            ranges, other_ranges, stale = _uniform(tree, roots[places]), _uniform(other, roots[other_places]), 0
        (la, ha), (lb, hb) = ranges[level], other_ranges[level]
        joined = (la[i] == ha[i]) & (lb[j] == hb[j]) & (la[i] == lb[j])
        if same and level:
            joined &= i != j
            joined |= (i == j) & (la[i] == ha[i])
        i, j = i[~joined], j[~joined]
        ok = tree.may_link(level, i, other, j, percent)
        i, j = i[ok], j[ok]
        if not level:
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if same and a == b:
                    continue
                x, y = int(places[a]), int(other_places[b])
                if forest.find(x) != forest.find(y) and linked(tree.sets[a], other.sets[b], percent):
                    forest.join(x, y)
                    links.append((x, y))
                    stale += 1
            continue
        n, m = len(tree.levels[level - 1][1]), len(other.levels[level - 1][1])
        step = np.arange(FAN)
        a = np.repeat((i[:, None] * FAN + step).ravel(), FAN)
        b = np.repeat(j[:, None] * FAN + step, FAN, axis=0).ravel()
        ok = (a < n) & (b < m)
        if same:
            ok &= a <= b
        a, b = a[ok], b[ok]
        for k in range(0, len(a), chunk):
            stack.append((level - 1, a[k : k + chunk], b[k : k + chunk]))
    return links


def _padded(tree: SignatureTree, levels: int) -> SignatureTree:
    while len(tree.levels) < levels:
        tree.levels.append(tree.levels[-1])
    return tree


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of all links among the sets (no two of them equal)."""
    order = locality_order(sets)
    sets = [sets[k] for k in order]
    forest, links = Forest(len(sets)), []
    for i in range(1, len(sets)):  # neighbours first: they leave little to traverse
        if linked(sets[i - 1], sets[i], percent):
            forest.join(i - 1, i)
            links.append((i - 1, i))
    if len(sets) > 2:
        tree, places = SignatureTree(sets), np.arange(len(sets))
        links += dual_traversal(tree, tree, forest, places, places, percent)
    return [(int(order[a]), int(order[b])) for a, b in links]


def cross_links(left: list[np.ndarray], left_label: list[int], right: list[np.ndarray], right_label: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between two lists of sets, between different components only."""
    a, b = locality_order(left), locality_order(right)
    n = len(left)
    forest, first = Forest(n + len(right)), {}
    for k, label in enumerate([*left_label, *right_label]):
        forest.join(first.setdefault(label, k), k)
    x, y = SignatureTree([left[k] for k in a]), SignatureTree([right[k] for k in b])
    levels = max(len(x.levels), len(y.levels))
    links = dual_traversal(_padded(x, levels), _padded(y, levels), forest, a, b + n, percent)
    return [(i, j - n) for i, j in links]


# ------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b); label is the component's least node.

    Large-star and small-star steps in turn, each written to the shared folder;
    a node with many neighbours is only ever aggregated or the skewed side of a join."""
    least, most = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    edges = written(edges.where("a <> b").select(most, least).distinct(), "edges")
    state = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, edges = edges, written(small, "edges")
        discard(before)
        new = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


# ------------------------------------------------------------ the join


def _sets_of(texts: list[str], words: int) -> list[np.ndarray]:
    return [s for _, _, t in tk.slices(pa.array(texts, pa.large_string()), lut=tk.LOWER) for s in shingle_sets(t, words)]


def _told_apart(docs: DataFrame) -> DataFrame:
    """doc_id and text (see id_and_text) with place, a digest of the text: rows that
    repeat an id, or have none, are told apart by it."""
    return docs.withColumn("place", F.xxhash64("text"))


def _nodes(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, place, n_shingles, node (null without shingles)."""

    def work(batch: pa.RecordBatch):
        for i, j, texts in tk.slices(batch.column(1), lut=tk.LOWER):
            sets = shingle_sets(texts, words)
            yield {"doc_id": batch.column(0).slice(i, j - i), "place": batch.column(2).slice(i, j - i), "n_shingles": list(map(len, sets)), "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())}

    return tk.map_batches(rows.select("doc_id", "text", "place"), "doc_id long, place long, n_shingles long, node long", work)


def heavy_shingles(rows: DataFrame, words: int, least: int = HEAVY_DOCUMENTS, most: int = HEAVY_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the number of sets that hold each: at
    least ``least``, and at most ``most`` shingles (16 MB).  Tasks send those that
    they have seen twice; what counts as heavy changes the cost of routing,
    never its result."""

    def run(batches):
        seen, held, total = set(), [], 0
        for batch in batches:
            for _, _, texts in tk.slices(batch.column(1), lut=tk.LOWER):
                for s in shingle_sets(texts, words):
                    if len(s) and (node := node_of(s)) not in seen:
                        seen.add(node)
                        held.append(s)
                        total += len(s)
                if total > HELD_SHINGLES:
                    yield from _twice(held)
                    held, total, _ = [], 0, seen.clear()
        yield from _twice(held)

    counted = rows.mapInArrow(tk.released(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = counted.orderBy(F.col("n").desc(), "h").limit(most).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _twice(held: list[np.ndarray]):
    if held:
        kinds, n = np.unique(np.concatenate(held), return_counts=True)
        kinds, n = kinds[n > 1], n[n > 1]
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], names=["h", "n"])


def _memberships(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, node): the routing keys of all sets; copies within a task once."""
    heavy = rows.sparkSession.sparkContext.broadcast(heavy_shingles(rows, words))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, texts in tk.slices(batch.column(1), lut=tk.LOWER):
                keys, nodes, counts = [], [], []
                for s in shingle_sets(texts, words):
                    if not len(s) or (node := node_of(s)) in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(node)
                    keys.append(routing_keys(s, percent, heavy.value))
                    nodes.append(node)
                    counts.append(len(keys[-1]))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), counts))], names=["key", "node"])

    return rows.mapInArrow(tk.released(run), "key long, node long")


def _stars(memberships: DataFrame) -> DataFrame:
    """(a, b, n): least node of each key with every other one, and how often."""

    def run(batches):
        key, least = None, None
        for batch in batches:
            k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            first = np.concatenate([[k[0] != key], k[1:] != k[:-1]])
            begin = np.where(first, np.arange(len(k)), 0)
            np.maximum.accumulate(begin, out=begin)
            center = n[begin]
            if not first[0]:
                center[: int(np.argmax(first)) if first.any() else len(k)] = least
            key, least = k[-1], center[-1]
            other = center != n
            if other.any():
                pairs, count = np.unique(np.stack([center[other], n[other]]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(count)], names=["a", "b", "n"])

    ordered = memberships.repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(tk.released(run), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _grouped(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Streams the groups of keys, each as a dict of column lists, through work."""
    names = rows.columns

    def run(batches):
        held, current = {c: [] for c in names}, None
        for batch in batches:
            columns = {c: batch.column(i).to_pylist() for i, c in enumerate(names)}
            for r, own in enumerate(zip(*(columns[k] for k in keys), strict=True)):
                if own != current and current is not None:
                    if (out := work(held)).num_rows:
                        yield out
                    held = {c: [] for c in names}
                current = own
                for c in names:
                    held[c].append(columns[c][r])
        if current is not None and (out := work(held)).num_rows:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tk.released(run), schema)


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def links(rows: DataFrame, nodes: DataFrame, words: int, percent: int, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): a spanning forest of the links between nodes; rows has doc_id, text and
    place, nodes is the table of :func:`_nodes`.  Of all rows of a node one gives
    the text."""
    stars = written(_stars(_memberships(rows, words, percent)), "stars")
    canopy = written(components(stars.select("a", "b")).withColumnsRenamed({"label": "canopy"}), "canopies")
    row = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), "place")
    own = nodes.where("node is not null").groupBy("node").agg(F.min(row).alias("_row"), F.first("n_shingles").alias("n")).select("node", "n", "_row.*")
    members = canopy.join(own, "node")
    blocks = members.groupBy("canopy").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    members = written(members.join(blocks, "canopy").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("_at", F.xxhash64("_id", "place")), "members")
    texts = rows.select(F.xxhash64(F.coalesce("doc_id", F.lit(LAST_ID)), "place").alias("_at"), "text")
    texts = texts.where(bitsets.maybe_in(rows.sparkSession, bitsets.of_ids(members.select("_at")), F.col("_at")))  # texts of no canopy aren't shuffled
    texts = texts.groupBy("_at").agg(F.first("text").alias("text"))  # repeated rows once

    def first_round(g):
        own: dict[int, np.ndarray] = {}
        for node, s in zip(g["node"], _sets_of(g["text"], words), strict=True):
            if len(s) and node_of(s) == node:
                own[node] = s
        at = list(own)
        return _pairs([(at[i], at[j]) for i, j in block_links(list(own.values()), percent)])

    columns = ["canopy", "block", "node", "text"]
    large = members.where("blocks > 1")
    if large.isEmpty():
        return _grouped(members.join(texts, "_at").select(*columns), ["canopy", "block"], first_round, "a long, b long")

    degree = stars.select(F.col("a").alias("node"), "n").unionByName(stars.select(F.col("b").alias("node"), "n")).groupBy("node").agg(F.sum("n").alias("shared"))
    rank = F.struct((-F.col("shared") / F.col("n")).alias("s"), "node")
    top = large.join(degree, "node").groupBy("canopy", F.col("block").alias("_b")).agg(F.min(rank).alias("t")).groupBy("canopy").agg(F.slice(F.array_sort(F.collect_list("t")), 1, PIVOTS).alias("t"))  # one a block: the best of each
    pivots = large.join(top.select("canopy", F.explode("t.node").alias("node")), ["canopy", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = members.unionByName(pivots).dropDuplicates(["canopy", "block", "node"])
    found = written(_grouped(placed.join(texts, "_at").select(*columns), ["canopy", "block"], first_round, "a long, b long"), "links")

    labels = components(found)
    large = written(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "large")
    sizes = large.groupBy("canopy", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("canopy").agg(F.max(F.struct("k", "label")).alias("main"))
    rest = large.join(main, "canopy").where("label <> main.label").drop("main")
    parts = rest.groupBy("canopy").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("parts"))
    rest = rest.join(parts, "canopy").select("canopy", "_at", "node", "label", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("rest"))
    every = large.join(parts, "canopy").select("canopy", "_at", "node", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", F.lit(False).alias("rest"))

    def second_round(g):
        sides: tuple[dict, dict] = ({}, {})
        for node, label, is_rest, s in zip(g["node"], g["label"], g["rest"], _sets_of(g["text"], words), strict=True):
            if len(s) and node_of(s) == node:
                sides[0 if is_rest else 1][node] = (s, label)
        if not sides[0] or not sides[1]:
            return _pairs([])
        (x, y) = (list(side) for side in sides)
        got = cross_links([s for s, _ in sides[0].values()], [b for _, b in sides[0].values()], [s for s, _ in sides[1].values()], [b for _, b in sides[1].values()], percent)
        return _pairs([(x[i], y[j]) for i, j in got])

    more = _grouped(rest.unionByName(every).join(texts, "_at").select("canopy", "part", "block", "node", "label", "rest", "text"), ["canopy", "part", "block"], second_round, "a long, b long")
    return found.unionByName(more)


def _classed(rows: DataFrame, words: int, percent: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The table of :func:`_nodes`, and (node, label) of all its nodes."""
    nodes = written(_nodes(rows, words), "nodes")
    label = components(links(rows, nodes, words, percent, block_shingles))
    held = nodes.where("node is not null").select("node").distinct()
    return nodes, held.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    nodes, label = _classed(_told_apart(id_and_text(docs, doc_id, text)), words, percent, block_shingles)
    first = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")).join(label, "node")
    ids = first.groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = first.join(ids, "label").select("node", "component_id")
    alone = nodes.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return nodes.where("node is not null").join(of_node, "node").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One document of each class, with all columns whatever their names: that of the
    smallest id (a null id comes after all others; rows that repeat an id are told
    apart by their text, and of rows that repeat both one stays).  Documents
    without shingles all stay."""
    rows = _told_apart(id_and_text(docs, doc_id, text))
    nodes, label = _classed(rows, words, percent, block_shingles)
    row = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), "place")
    of_node = nodes.where("node is not null").groupBy("node").agg(F.min(row).alias("least")).join(label, "node")
    stays = of_node.groupBy("label").agg(F.min("least").alias("stays"))
    of_node = of_node.join(stays, "label").select("node", "stays")
    judged = nodes.where("node is not null").withColumn("_row", row).join(of_node, "node").groupBy("_row").agg(F.count("*").alias("n"), F.first(F.col("_row") == F.col("stays")).alias("stays"))
    judged = written(judged.where("n > 1 or not stays").select("_row.*", "stays"), "judged")  # all but those that just stay
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("place"))
    at = F.xxhash64("_id", "place")
    some = bitsets.maybe_in(docs.sparkSession, bitsets.of_ids(judged.select(at)), at)
    # Documents that are certainly not judged otherwise stay where they are; the others are joined.
    kept = whole.where(~some).select("whole").unionByName(whole.where(some).join(judged, ["_id", "place"], "left_anti").select("whole"))
    if not (repeats := judged.where("stays")).isEmpty():
        one = whole.join(repeats, ["_id", "place"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("_id", "place").orderBy("_id")))
        kept = kept.unionByName(one.where("n = 1").select("whole"))
    return kept.select("whole.*")


CLASSES_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, hash(list_sort(s)) AS node FROM s),
u AS (SELECT node, min(n.doc_id) AS id, any_value(n) AS n FROM n WHERE n > 0 GROUP BY node),
t AS (SELECT u.id, u.n, unnest(s.s) AS x FROM u JOIN s ON u.id = s.doc_id),
f AS (SELECT x, count(*) AS df FROM t GROUP BY x),
r AS (SELECT t.id, t.n, t.x, row_number() OVER (PARTITION BY t.id ORDER BY df, t.x) AS p FROM t JOIN f USING (x)),
p AS (SELECT id, n, x FROM r WHERE p <= n - ceil(0.9 * n)::BIGINT + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
i AS (SELECT a, b, na, nb, (SELECT count(*) FROM t x JOIN t y ON x.x = y.x WHERE x.id = a AND y.id = b) AS k FROM c),
e AS (SELECT a, b FROM i WHERE 100 * k >= 90 * (na + nb - k)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
z(id, seen) AS (SELECT id, id FROM u UNION SELECT g.b, z.seen FROM z JOIN g ON z.id = g.a),
m AS (SELECT id, min(seen) AS first FROM z GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE m.first END AS component_id FROM n LEFT JOIN u ON u.node = n.node AND n.n > 0 LEFT JOIN m ON m.id = u.id
"""
