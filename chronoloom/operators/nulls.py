"""Null sequences, Monte Carlo calibration, and fixed-budget assays.

A replicate is a row: sequences are gathered once per session (a session's marks
are one array), replicates fan out from spark.range, and each is an independent
piece of work for one Arrow batch; only its figures are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lcg
from ..session import checkpointed, dealt
from .align import TOGETHER, aligned_cells, best_windows, cell_figures, coded_pairs, paired, timing_costs, to_arrow, without_overlaps

KEEP, BLOCK = 5, 50


def arrays(events: DataFrame) -> DataFrame:
    """session_id, marks, gaps (null as -1): a session's sequence as arrays."""
    rows = events.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "mark", F.coalesce("gap_ms", F.lit(-1)).alias("gap")))).alias("e"))
    return rows.select("session_id", F.col("e.mark").alias("marks"), F.col("e.gap").alias("gaps"))


CONSTRUCTIONS = {
    "order": lambda marks, seed: lcg.order_null(marks, seed),
    "doublet": lambda marks, seed: lcg.doublet_null(marks, seed),
    "markov": lambda marks, seed: lcg.markov_null(marks, seed)[0],
}


@lru_cache(maxsize=64)
def _jumps(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms that take a generator's state one to 2 ** bits - 1 draws on."""
    a, c, out = 1, 0, []
    for _ in range((1 << bits) - 1):
        a, c = a * lcg.MULTIPLIER & lcg.M64, (c * lcg.MULTIPLIER + lcg.INCREMENT) & lcg.M64
        out.append((a, c))
    made = np.array(out, np.uint64).reshape(-1, 2)
    return made[:, 0], made[:, 1]


def _drawn(states: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The next draws of each generator (generators by steps, before they are held to a bound), and its state after them."""
    a, c = (x[:steps] for x in _jumps(steps.bit_length()))
    made = states[:, None] * a + c
    return (made >> np.uint64(33)).astype(np.uint32), made[:, -1] if steps else states


def _skipped(states: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Each generator's state after so many draws."""
    factors, terms = _jumps(int(draws.max()).bit_length())
    at = np.maximum(draws - 1, 0)
    return np.where(draws > 0, states * factors[at] + terms[at], states) if len(factors) else states


#: Draws of attempts that are looked at together.
AHEAD = 40_000


def _edges(path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Successors by state, in the order of the path, where each state's begin, how many it has, and the states they follow."""
    order = np.argsort(path[:-1], kind="stable")
    degree = np.bincount(path[:-1], minlength=int(path.max()) + 1)
    return path[1:][order], np.cumsum(degree) - degree, degree, path[:-1][order]


def doublet_nulls(path: np.ndarray, seeds: list[int], attempts: int = 200) -> np.ndarray:
    """What lcg.doublet_null makes of a path of states (numbered as they appear) for each seed, all at once."""
    out = np.tile(path, (len(seeds), 1))
    if len(path) < 3:
        return out
    follow, begin, degree, source = _edges(path)
    end, states = path[-1], np.array([s | 1 for s in seeds], np.uint64)
    others = np.flatnonzero((degree > 0) & (np.arange(len(degree)) != end))
    fresh, began = states.copy(), np.zeros(len(seeds), int)  # draws that the attempts have taken
    last, left, tried = np.full((len(seeds), len(degree)), len(path)), np.arange(len(seeds)), 0
    while len(left) and tried < attempts:
        # Every attempt takes as many draws, so several are looked at together; the first that leads counts.
        ahead = min(attempts - tried, max(1, AHEAD // (len(left) * max(len(others), 1))))
        draws, after = _drawn(states[left], len(others) * ahead)
        states[left] = after
        draws = draws.reshape(len(left) * ahead, len(others)) % degree[others].astype(np.uint32)
        hop = np.full((len(draws), len(degree)), end, np.int32)
        hop[:, others] = (follow.astype(np.int32))[begin[others] + draws]
        row = np.arange(0, hop.size, len(degree), dtype=np.int32)[:, None]
        for _ in range(len(degree).bit_length()):
            hop = hop.ravel()[hop + row]
        leads = (hop == end).all(1).reshape(len(left), ahead)
        first, some = leads.argmax(1), leads.any(1)
        chosen = np.flatnonzero(some)
        last[left[chosen, None], others] = draws.reshape(len(left), ahead, len(others))[chosen, first[chosen]]
        began[left] += np.where(some, first + 1, ahead) * len(others)
        left, tried = left[~some], tried + ahead
    made = np.setdiff1d(np.arange(len(seeds)), left)
    if not len(made):
        return out
    # Each state's last edge goes to the end of its own, the others are shuffled.
    final, place = last[made][:, source], np.arange(len(source)) - begin[source]
    place = np.where((place == degree[source] - 1) & (source != end), final, place + (place >= final))
    edges = follow[begin[source] + place]
    free = degree - np.isin(np.arange(len(degree)), others)
    steps = np.maximum(free - 1, 0)
    draws, _ = _drawn(_skipped(fresh[made], began[made]), int(steps.sum()))
    drawn = np.cumsum(steps) - steps
    for i in range(int(free.max()) - 1, 0, -1):
        own = np.flatnonzero(free > i)
        here, there = begin[own] + i, begin[own] + (draws[:, drawn[own] + free[own] - 1 - i] % np.uint32(i + 1))
        a, b = edges[:, here], np.take_along_axis(edges, there, 1)
        edges[:, here] = b
        np.put_along_axis(edges, there, a, 1)
    rows, at, following = np.arange(len(made)), out[made, 0], np.tile(begin, (len(made), 1))
    for step in range(1, len(path)):
        taken = following[rows, at]
        following[rows, at] = taken + 1
        at = edges[rows, taken]
        out[made, step] = at
    return out


def markov_nulls(path: np.ndarray, seeds: list[int]) -> np.ndarray:
    """What lcg.markov_null makes of a path of states (numbered as they appear) for each seed, all at once."""
    out = np.tile(path, (len(seeds), 1))
    if len(path) < 2:
        return out
    follow, begin, degree, _ = _edges(path)
    none = degree == 0  # the last state alone can have no successor: any mark follows it
    follow, begin, degree = np.concatenate([follow, path]), np.where(none, len(follow), begin), np.where(none, len(path), degree).astype(np.uint32)
    draws, _ = _drawn(np.array([s | 1 for s in seeds], np.uint64), len(path) - 1)
    at = out[:, 0]
    for step in range(1, len(path)):
        at = follow[begin[at] + draws[:, step - 1] % degree[at]]
        out[:, step] = at
    return out


def made_nulls(path: np.ndarray, construction: str, first: int, last: int, n: int, side: int = 0) -> np.ndarray:
    """The null realisations first to last - 1 of n of a path of states (numbered as they appear): a row each."""
    if construction == "order":
        return path[permutations(len(path), side, n)[first:last]]
    seeds = [lcg.null_seed(r, side) for r in range(first, last)]
    return (doublet_nulls if construction == "doublet" else markov_nulls)(path, seeds)


def replicates(sequences: DataFrame, construction: str, n: int, side: int = 0) -> DataFrame:
    """session_id, replicate, marks, gaps of n null realisations of each session."""
    make = CONSTRUCTIONS[construction]
    rows = sequences.crossJoin(sequences.sparkSession.range(n).select(F.col("id").cast("int").alias("replicate")))  # n is a parameter
    rows = rows.select("session_id", "replicate", "marks", "gaps")

    def run(batches):
        for batch in batches:
            made = [make(m, lcg.null_seed(r, side)) for m, r in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.string())), batch.column(3)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def fidelity(sequences: DataFrame, constructions: tuple[str, ...], n: int) -> DataFrame:
    """session_id, construction, replicate and sequence.null_fidelity's figures of n nulls of each construction: a
    session is one row of work, its nulls are compared where they are made and only figures leave."""
    from .sequence import FIDELITY, fidelity_columns, realised_figures

    def run(batches):
        for batch in batches:
            for session, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                code = {m: i for i, m in enumerate(dict.fromkeys(marks))}
                own = np.array([code[m] for m in marks], int)
                figures = fidelity_columns(realised_figures(own, np.vstack([made_nulls(own, kind, 0, n, n) for kind in constructions])))
                many = n * len(constructions)
                yield pa.RecordBatch.from_arrays([pa.array([session] * many), pa.array([c for c in constructions for _ in range(n)]), pa.array(np.tile(np.arange(n, dtype=np.int32), len(constructions))), *figures], names=["session_id", "construction", "replicate", "transition_tv", "absent", "max_state_tv", "marginal_tv"])

    rows = sequences.where("session_id is not null").where(F.size("marks") > 1).select("session_id", "marks")  # one mark has no transition
    return rows.mapInArrow(run, f"session_id string, construction string, replicate int, {FIDELITY}")


def timing_nulls(sequences: DataFrame) -> DataFrame:
    """Each session with its gaps (all but the first) in another order, and the offsets
    (from the first event) that follow; marks stay where they are."""

    def run(batches):
        for batch in batches:
            gaps = [lcg.timing_null(g) for g in batch.column(2).to_pylist()]
            offsets = [np.cumsum([0, *g[1:]]).tolist() for g in gaps]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gaps, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int64()))], names=["session_id", "marks", "gaps", "offsets"])

    return sequences.select("session_id", "marks", "gaps").mapInArrow(run, "session_id string, marks array<string>, gaps array<long>, offsets array<long>")


def timing_steps(ga: list, gb: list) -> np.ndarray:
    """What aligning each event of one sequence with each of another costs by their gaps."""
    from .align import FLOOR_MS, RATIO_FULL, TIMING_WEIGHT

    with np.errstate(invalid="ignore", divide="ignore"):
        lx, ly = np.log(np.asarray(ga, float) + FLOOR_MS), np.log(np.asarray(gb, float) + FLOOR_MS)
    return TIMING_WEIGHT * np.minimum(1.0, np.abs(lx[:, None] - ly[None, :]) / math.log(RATIO_FULL))


def aligned_totals(va: np.ndarray, vb: np.ndarray, timing: np.ndarray, k: int) -> np.ndarray:
    """Totals of all pairs of windows of k events of two sequences (marks as integers)."""
    from .align import GAP, SUBSTITUTION, TIMING_WEIGHT

    # A step depends on the two events alone, so a cell's steps are a stretch of one matrix.
    plain = np.where(va[:, None] == vb[None, :], 0.0, SUBSTITUTION)
    timed = plain + timing
    n, m = len(va) - k + 1, len(vb) - k + 1
    row = [np.full((n, m), float(j)) for j in range(k + 1)]
    for i in range(k):
        new = [np.full((n, m), float(i + 1))]
        for j in range(k):
            best = row[j] + (timed if i and j else plain)[i : i + n, j : j + m]
            np.minimum(best, row[j + 1] + GAP, out=best)
            new.append(np.minimum(best, new[j] + GAP, out=best))
        row = new
    return row[k] / (k + TIMING_WEIGHT * (k - 1))


def _search(va: np.ndarray, vb: np.ndarray, timing: np.ndarray, k: int, keep: int) -> list[float]:
    if len(va) < k or len(vb) < k:
        return []
    counts = np.bincount(np.concatenate([va, vb]))
    with np.errstate(divide="ignore"):
        surprise = -np.log(counts / (len(va) + len(vb)))
    out = []
    for i, j in without_overlaps(np.round(aligned_totals(va, vb, timing, k), 12), k, keep):
        a = va[i : i + k]
        out.append(float(surprise[a[a == vb[j : j + k]]].sum()))
    return sorted(out, reverse=True)


def _codes(ma: list, mb: list) -> dict:
    return {m: i for i, m in enumerate(dict.fromkeys([*ma, *mb]))}


def complete_search(ma: list, ga: list, mb: list, gb: list, k: int, keep: int = KEEP) -> list[float]:
    """Pooled surprisals of the pairs that a greedy pass along the ranking keeps, largest first."""
    code = _codes(ma, mb)
    return _search(np.array([code[m] for m in ma], int), np.array([code[m] for m in mb], int), timing_steps(ga, gb), k, keep)



def ladder_gains(va: np.ndarray, vb: np.ndarray, timing: np.ndarray, spans: tuple[int, ...], exact: bool = False):
    """Yields (k, gains) for each span that fits: alignments of all pairs of windows of k
    events in all replicates (the last axis of va and vb), from one programme.

    The cell (i, j) of windows that start together is the same for every span, so the
    longest span's programme holds all others on its diagonal.  A gain is 2k less the cost:
    with gaps of 1 each a step is the largest of its two neighbours and of the
    diagonal one plus 2 less the cost of aligning.  Gains are 16-bit numbers of units, as
    many in a gap as the longest span allows (2048 up to 15 events); timing is
    rounded to units, so a gain is off by k / 2 of them at most.  Exact gains are doubles."""
    from .align import GAP, SUBSTITUTION

    n, m, many = len(va), len(vb), va.shape[1]
    spans = [k for k in sorted(spans) if k <= min(n, m)]
    if not spans:
        return
    kind, units = (float, 1) if exact else (np.uint16, 1 << int(math.log2(65535 / (2 * spans[-1]))))
    first = np.where(va[:, None] == vb[None, :], kind(2 * GAP * units), kind((2 * GAP - SUBSTITUTION) * units))
    later = first - (timing if exact else np.rint(timing * units).astype(kind))[:, :, None]
    # Windows lie one after another in flat arrays, so that a step is one stretch of numbers: windows that would reach
    # beyond an end hold numbers without meaning and are left out at last.
    first, later = first.reshape(-1), later.reshape(-1)
    row = [np.empty((n - spans[0] + 1) * m * many, kind) for _ in range(spans[-1] + 1)]
    spare, sizes = [np.empty_like(row[0]) for _ in range(2)], {k: ((n - k) * m + m - k + 1) * many for k in spans}
    for i in range(spans[-1]):
        above = None
        for j in range(spans[-1]):
            size = sizes[next(k for k in spans if k > max(i, j))]  # longer windows start in fewer places
            begin, place = (i * m + j) * many, spare.pop()
            own = place[:size]
            if i and j:
                np.add(above[:size], later[begin : begin + size], out=own)
            else:
                own[...] = first[begin : begin + size]
            if i:
                np.maximum(own, row[j + 1][:size], out=own)
            if j:
                np.maximum(own, row[j][:size], out=own)
            if above is not None:
                spare.append(above)
            above, row[j + 1] = row[j + 1], place
        spare.append(above)
        if i + 1 in spans:
            yield i + 1, row[i + 1][: (n - i) * m * many].reshape(n - i, m, many)[:, : m - i]


def window_totals(a: np.ndarray, b: np.ndarray, timing: np.ndarray) -> np.ndarray:
    """Totals of some pairs of windows (marks: pairs by k; timing: pairs by k by k), to twelve decimals."""
    from .align import GAP, SUBSTITUTION, TIMING_WEIGHT

    k = a.shape[1]
    row = [np.full(len(a), float(j)) for j in range(k + 1)]
    for i in range(k):
        new = [np.full(len(a), float(i + 1))]
        for j in range(k):
            step = np.where(a[:, i] == b[:, j], 0.0, SUBSTITUTION)
            if i and j:
                step += timing[:, i, j]
            new.append(np.minimum(row[j] + step, np.minimum(row[j + 1], new[j]) + GAP))
        row = new
    return np.round(row[k] / (k + TIMING_WEIGHT * (k - 1)), 12)


def kept_places(left: np.ndarray, va: np.ndarray, vb: np.ndarray, timing: np.ndarray, k: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each replicate the first keep choices of a greedy pass along its ranking
    (places in a and in b, -1: nothing left), ties by place.

    left holds the gains, replicates first, and is used up (0: gone).  Where rounded
    gains are nearer than that can tell, the exact totals of those pairs decide;
    totals are compared to twelve decimals."""
    from .align import TIMING_WEIGHT

    exact = left.dtype == float
    if exact:
        np.rint(left * (1e12 / (k + TIMING_WEIGHT * (k - 1))), out=left)
    flat, columns = left.reshape(len(left), -1), left.shape[2]
    found, step = np.full((2, len(left), keep), -1), np.arange(k)
    for q in range(keep):
        best = flat.argmax(1)
        most = flat[np.arange(len(flat)), best]
        if not exact:
            every, least = np.arange(len(flat)), np.maximum(most.astype(np.int32) - k, 1).astype(np.uint16)
            flat[every, best] = 0
            tied = np.flatnonzero(flat.max(1) >= least)  # another one is near
            flat[every, best] = most
        if not exact and len(tied):
            r, at = np.nonzero(flat[tied] >= least[tied, None])
            i, j = (at // columns)[:, None] + step, (at % columns)[:, None] + step
            totals = window_totals(va[i, tied[r][:, None]], vb[j, tied[r][:, None]], timing[i[:, :, None], j[:, None, :]])
            by = np.lexsort((at, totals, r))
            best[tied] = at[by[np.searchsorted(r, np.arange(len(tied)))]]
        i, j = best // columns, best % columns
        some = flat[np.arange(len(flat)), best] > 0
        found[:, some, q] = i[some], j[some]
        for axis, at in ((1, i), (2, j)):  # what overlaps a choice is gone
            left *= np.expand_dims(np.abs(np.arange(left.shape[axis]) - at[:, None]) >= k, 3 - axis).astype(left.dtype)
    return found[0], found[1]


#: Cells of the replicates that are aligned together (they stay in a core's cache) and that are ranked together.
CACHED, RANKED = 1 << 16, 1 << 20


def all_searches(va: np.ndarray, vb: np.ndarray, timing: np.ndarray, spans: tuple[int, ...], keep: int = KEEP) -> dict[int, np.ndarray]:
    """k -> pooled surprisals of what each replicate's search keeps, largest first (replicates by
    keep; -inf: nothing left), of replicates in the columns of va and vb."""
    size, many = int(max(va.max(initial=0), vb.max(initial=0))) + 1, va.shape[1]
    counts = np.zeros((size, many), np.int64)
    for v in (va, vb):
        np.add.at(counts, (v, np.arange(many)), 1)
    with np.errstate(divide="ignore"):
        surprise = -np.log(counts / (len(va) + len(vb)))
    out = {k: np.full((many, keep), -np.inf) for k in spans}
    fit, cells = [k for k in spans if k <= min(len(va), len(vb))], len(va) * len(vb)
    exact = many == 1  # one search has no others to share the cost of ties with
    together, ranked = (max(1, x // max(cells, 1)) for x in (CACHED, RANKED))
    for first in range(0, many if fit else 0, ranked):
        own = slice(first, first + ranked)
        a, b, s = va[:, own], vb[:, own], surprise[:, own]
        gained = {k: np.empty((a.shape[1], len(va) - k + 1, len(vb) - k + 1), float if exact else np.uint16) for k in fit}
        for r in range(0, a.shape[1], together):
            for k, gains in ladder_gains(a[:, r : r + together], b[:, r : r + together], timing, fit, exact):
                gained[k][r : r + together] = gains.transpose(2, 0, 1)
        column = np.arange(a.shape[1])[:, None, None]
        for k in fit:
            i, j = kept_places(gained[k], a, b, timing, k, keep)
            step = np.arange(k)
            x, y = a[i[:, :, None] + step, column], b[j[:, :, None] + step, column]
            t = np.where(x == y, s[x, column], 0.0).sum(2)
            t[i < 0] = -np.inf
            out[k][own] = -np.sort(-t, axis=1)
    return out


def _blocks(sequences: DataFrame, pairs: DataFrame, first: int, last: int, block: int) -> DataFrame:
    """A row of work for each pair (with its other columns) and up to block replicates: sequences are dealt out once a block."""
    side = lambda s: sequences.select(F.col("session_id").alias(s), F.col("marks").alias(f"m{s}"), F.col("gaps").alias(f"g{s}"))
    spark = sequences.sparkSession
    rows = pairs.join(side("a"), "a").join(side("b"), "b").crossJoin(spark.range(first, last, block).select(F.col("id").cast("int").alias("first")))  # last is a parameter
    own = [c for c in pairs.columns if c not in ("a", "b")]
    return dealt(rows.select("a", "b", "first", "ma", "ga", "mb", "gb", *own), "a", "b", "first")


def _realised(ma: list, mb: list, first: int, last: int, n: int, construction: str) -> tuple[np.ndarray, np.ndarray]:
    """Marks as integers of the replicates first to last (-1: observed) of both sequences, in columns."""
    make, code = CONSTRUCTIONS[construction], _codes(ma, mb)
    coded = lambda marks: np.array([code[m] for m in marks], int)
    ca, cb = coded(ma), coded(mb)
    if construction == "order":  # one permutation for all sequences of a length
        own = slice(max(first, 0), last)
        sides = [c[permutations(len(c), side, n)[own]] for side, c in ((0, ca), (1, cb))]
    else:
        sides = [np.array([coded(make(m, lcg.null_seed(r, side))) for r in range(max(first, 0), last)], int).reshape(-1, len(m)) for side, m in ((0, ma), (1, mb))]
    if first < 0:
        sides = [np.vstack([c[None], x]) for c, x in zip((ca, cb), sides, strict=True)]
    return sides[0].T.copy(), sides[1].T.copy()


def searches(sequences: DataFrame, pairs: DataFrame, spans: tuple[int, ...], n: int, construction: str = "order") -> DataFrame:
    """a, b, k, replicate (-1: observed), t, top: the complete search of each span and replicate.

    The observed pair and its nulls go through the same code.  A row of work is
    up to BLOCK replicates of a pair; all of its spans come from one programme."""

    def run(batches):
        for batch in batches:
            for a, b, first, ma, ga, mb, gb in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                last = min(first + BLOCK, n)
                found = all_searches(*_realised(ma, mb, first, last, n, construction), timing_steps(ga, gb), spans)
                rows = [(k, r, [x for x in top if x > -math.inf]) for k in spans for r, top in zip(range(first, last), found[k].tolist(), strict=True)]
                ks, rs, tops = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(rows)), pa.array([b] * len(rows)), pa.array(ks, pa.int32()), pa.array(rs, pa.int32()), pa.array([t[0] if t else None for t in tops], pa.float64()), pa.array(tops, pa.list_(pa.float64()))], names=["a", "b", "k", "replicate", "t", "top"])

    return _blocks(sequences, pairs, -1, n, BLOCK).mapInArrow(run, "a string, b string, k int, replicate int, t double, top array<double>")


PARTS = "a string, b string, k int, first int, searched int, observed double, observed_top array<double>, nulls array<double>, top_exceedances array<int>"


def null_parts(sequences: DataFrame, pairs: DataFrame, spans: tuple[int, ...], first: int, last: int, construction: str = "order", block: int = 4 * BLOCK) -> DataFrame:
    """A row for each pair, span and block of the replicates first to last: what the observed
    search found, the nulls' largest values (those that found any), and how many
    nulls reach the observed values rank by rank.  With a column ks in pairs only those spans are searched."""
    some = "ks" in pairs.columns

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            out = []
            for a, b, begin, ma, ga, mb, gb, *ks in zip(*columns, strict=True):
                own = tuple(ks[0]) if some else spans
                end = min(begin + block, last)
                va, vb = _realised(ma, mb, begin, end, last, construction)
                ca, cb = _realised(ma, mb, -1, 0, 0, construction)
                found = all_searches(np.hstack([ca, va]), np.hstack([cb, vb]), timing_steps(ga, gb), own)
                for k in own:
                    observed, nulls = found[k][0], found[k][1:]
                    top = [x for x in observed.tolist() if x > -math.inf]
                    over = [int((nulls[:, q] >= observed[q]).sum()) if q < len(top) else 0 for q in range(KEEP)]
                    out.append((a, b, k, begin, end - begin, top[0] if top else None, top, nulls[nulls[:, 0] > -math.inf, 0].tolist(), over))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), fields, strict=True)], names=fields.names)

    fields = to_arrow(PARTS)  # on the driver: it needs the session
    return _blocks(sequences, pairs.select("a", "b", *(["ks"] if some else [])), first, last, block).mapInArrow(run, PARTS)


def calibrated(sequences: DataFrame, pairs: DataFrame, spans: tuple[int, ...], n: int, construction: str = "order", threshold: float = 0.01) -> DataFrame:
    """What :func:`tail` says of all searches of n replicates, from a row a block of
    replicates: only their largest values are shuffled."""
    parts = null_parts(sequences, pairs, spans, 0, n, construction).groupBy("a", "b", "k").agg(
        F.first("observed").alias("observed"), F.first("observed_top").alias("observed_top"), F.sum("searched").alias("replicates"), F.sort_array(F.flatten(F.collect_list("nulls"))).alias("nulls"), F.collect_list("top_exceedances").alias("over"))
    add = lambda r: F.aggregate(F.col("over"), F.lit(0).cast("long"), lambda s, x: s + F.get(x, F.lit(r)))
    reach = F.size(F.filter("nulls", lambda x: x >= F.col("observed"))).cast("long")
    realizations = F.size("nulls").cast("long")
    rows = parts.withColumns({"realizations": realizations, "exceedances": F.when(F.col("observed").isNull(), realizations).otherwise(reach), "below": F.when(F.col("observed").isNull(), F.lit(0)).otherwise(realizations - reach), "top_exceedances": F.array(*map(add, range(KEEP)))})
    return _judged(rows, threshold)


def _judged(rows: DataFrame, threshold: float) -> DataFrame:
    p = (1 + F.col("exceedances")) / (1 + F.col("replicates"))
    return rows.select("a", "b", "k", "observed", "replicates", "realizations", "exceedances", "below", p.alias("tail"), (p <= threshold).alias("exceptional"), *[nearest_rank(F.col("nulls"), q).alias(f"q{int(100 * q):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)], F.get("nulls", F.size("nulls") - 1).alias("null_max"), "top_exceedances", ((F.col("realizations") > 0) & F.col("observed").isNotNull() & (F.col("exceedances") == 0)).alias("certified"), F.when(F.col("exceedances") > 0, (F.col("replicates") + 1) / (F.col("exceedances") + 1)).alias("expected_early_stop"))


def assay(sequences: DataFrame, pairs: DataFrame, spans: tuple[int, ...], budget: int, waves: tuple[int, ...] = (8, 32, 128)) -> DataFrame:
    """The fixed-budget assay of every cell (a, b, k): a cell is certified if its search
    finds something, some null does, and every null of the budget stays strictly below.

    Replicates run in waves that end at the given numbers and at the budget.  A
    wave takes only the cells that no null has refuted so far (anti-join on the
    refuted ones), because no later null can undo a refutation; the verdict is that of the whole
    budget.  Per cell: certified, searched (nulls it cost), refuting (of those), wave
    (in which it was refuted; null: in none), first_refuting (the replicate's number) and
    expected_early_stop, (searched + 1) / (refuting + 1)."""
    left = pairs.select("a", "b", F.array(*map(F.lit, spans)).alias("ks"))
    bounds = [0, *(w for w in waves if w < budget), budget]
    refuted, alive = [], None
    for wave, (first, last) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1):
        parts = null_parts(sequences, left, spans, first, last)
        # A search that finds nothing is refuted by every null; nulls that find nothing refute nothing.
        reaches = F.transform("nulls", lambda t: t >= F.col("observed"))
        nothing = F.col("observed").isNull()
        parts = parts.withColumns({
            "refuting": F.when(nothing, F.col("searched")).otherwise(F.size(F.filter(reaches, lambda x: x))),
            "earliest": F.when(nothing, F.col("first")).otherwise(F.col("first") + F.nullif(F.array_position(reaches, True), F.lit(0)).cast("int") - 1),
        })
        parts = parts.groupBy("a", "b", "k").agg(F.first("observed").alias("seen"), F.sum("searched").alias("n"), F.sum(F.size("nulls")).alias("realizations"), F.max(F.array_max("nulls")).alias("null_max"), F.sum("refuting").alias("refuting"), F.min("earliest").alias("first_refuting"))
        cells = parts.withColumnsRenamed({"seen": "observed", "n": "searched"})
        if alive is not None:
            before = alive.select("a", "b", "k", F.col("searched").alias("s0"), F.col("realizations").alias("r0"), F.col("null_max").alias("m0"))
            cells = cells.join(before, ["a", "b", "k"]).withColumns({"searched": F.col("searched") + F.col("s0"), "realizations": F.col("realizations") + F.col("r0"), "null_max": F.greatest("null_max", "m0")}).drop("s0", "r0", "m0")
        cells = checkpointed(cells)
        refuted.append(cells.where("refuting > 0").withColumn("wave", F.lit(wave)))
        alive = cells.join(refuted[-1].select("a", "b", "k"), ["a", "b", "k"], "left_anti")
        left = alive.groupBy("a", "b").agg(F.sort_array(F.collect_list("k")).alias("ks"))  # at most a row for each span
    rows = reduce(DataFrame.unionByName, refuted, alive.withColumn("wave", F.lit(None).cast("int")))
    certified = F.col("observed").isNotNull() & (F.col("realizations") > 0) & (F.col("refuting") == 0)
    return rows.select("a", "b", "k", "observed", "null_max", F.lit(budget).alias("budget"), "searched", "realizations", "refuting", "wave", "first_refuting", certified.alias("certified"), F.when(F.col("refuting") > 0, (F.col("searched") + 1) / (F.col("refuting") + 1)).alias("expected_early_stop"))


def nearest_rank(sorted_values, q: float):
    """The value at round(q * (n - 1)) of an ascending array column."""
    at = F.round(F.lit(q) * (F.size(sorted_values) - 1)).cast("int")
    return F.get(sorted_values, at)


def with_observed(found: DataFrame, *names: str) -> DataFrame:
    """The null searches with what the observed one found (a join would run all searches twice)."""
    from pyspark.sql import Window

    own = Window.partitionBy("a", "b", "k")
    rows = found.withColumns({"observed" if n == "t" else f"observed_{n}": F.max(F.when(F.col("replicate") < 0, F.col(n))).over(own) for n in names})
    return rows.where("replicate >= 0")


def tail(found: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Per pair and span: observed, exceedances, tail (1 + exceedances) / (1 + n), quantiles and
    rank-wise exceedances of the null searches, and the strict certificate."""
    rows = with_observed(found, "t", "top")
    at_least = F.col("t") >= F.col("observed")
    out = rows.groupBy("a", "b", "k", "observed", "observed_top").agg(
        F.count("*").alias("replicates"),
        F.count("t").alias("realizations"),
        F.when(F.col("observed").isNull(), F.count("t")).otherwise(F.count_if(at_least)).alias("exceedances"),
        F.count_if(F.col("t") < F.col("observed")).alias("below"),
        F.sort_array(F.collect_list("t")).alias("nulls"),
        F.array(*[F.count_if(F.get("top", F.lit(r)) >= F.get("observed_top", F.lit(r))) for r in range(KEEP)]).alias("top_exceedances"),
    )
    return _judged(out, threshold)


RETAINED = "a string, b string, k int, rank int, a_start int, b_start int, considered long, matches int, event_norm double, timing_norm double, total double, exact boolean"


def retained_search(sequences: DataFrame, pairs: DataFrame, spans: tuple[int, ...], keep: int = 40) -> DataFrame:
    """What a greedy pass along each pair's ranking keeps for each span, with coordinates, figures,
    whether the marks are the same, and how many pairs of windows were considered.

    One programme ranks all spans; figures are made for what is kept alone."""
    fields = to_arrow(RETAINED)  # on the driver: it needs the session

    def run(batches):
        for batch in batches:
            out = []
            for a, b, ma, ga, mb, gb in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                code, timing = _codes(ma, mb), timing_steps(ga, gb)
                va, vb = (np.array([code[m] for m in marks], int)[:, None] for marks in (ma, mb))
                for k, gains in ladder_gains(va, vb, timing, spans, exact=True):
                    i, j = (x[0][x[0] >= 0] for x in kept_places(gains.transpose(2, 0, 1).copy(), va, vb, timing, k, keep))
                    at = np.arange(k)
                    x, y, gx, gy = va[i[:, None] + at, 0], vb[j[:, None] + at, 0], np.array(ga, float)[i[:, None] + at], np.array(gb, float)[j[:, None] + at]
                    cells = aligned_cells(k, k, lambda p, q, x=x, y=y: x[:, p] == y[:, q], lambda p, q, gx=gx, gy=gy: timing_costs(gx[:, p], gy[:, q]), (len(i),))
                    f = cell_figures(cells[k][k], k)
                    out += zip([a] * len(i), [b] * len(i), [k] * len(i), range(1, len(i) + 1), i.tolist(), j.tolist(), [gains.size] * len(i), f["matches"].tolist(), f["event_norm"].tolist(), f["timing_norm"].tolist(), f["total"].tolist(), (f["matches"] == k).tolist(), strict=True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), fields, strict=True)], names=fields.names)

    return paired(sequences, pairs).mapInArrow(run, RETAINED)


BINS = 20
EVIDENCE = ("a string, b string, k int, a_start int, b_start int, part string, observed double, realizations int, null_mean double, null_stddev double, "
            "null_min double, null_max double, at_or_below int, empirical_p double, separation double, standardized_separation double, histogram string")  # fmt: skip


@lru_cache(maxsize=256)
def permutations(length: int, side: int, n: int) -> np.ndarray:
    """The places from which the first n order nulls of a sequence of that length take their marks."""
    return np.array([lcg.order_null(list(range(length)), lcg.null_seed(r, side)) for r in range(n)], np.int32).reshape(n, length)


def summary(samples: np.ndarray, observed: float) -> dict:
    """What a null sample says about one observed distance."""
    mean, spread = float(samples.mean()), float(samples.std())
    at = int((samples <= observed).sum())
    bins = np.bincount(np.minimum((samples * BINS).astype(int), BINS - 1), minlength=BINS)
    return {"observed": observed, "realizations": len(samples), "null_mean": mean, "null_stddev": spread, "null_min": float(samples.min()), "null_max": float(samples.max()), "at_or_below": at, "empirical_p": (1 + at) / (1 + len(samples)), "separation": mean - observed, "standardized_separation": (mean - observed) / spread if spread > 0 else None, "histogram": ",".join(map(str, bins))}


def event_and_timing(wa: np.ndarray, wb: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Events that differ and cost of timing on the best path of pairs of windows (marks: places by pairs) whose timing is
    the same (late: places by places): :func:`align.aligned_cells`, by what its totals are made of alone."""
    from .align import TOLERANCE

    # A cell costs one for whatever differs; all cells of an anti-diagonal are made at once, from the two before it.
    k, many = wa.shape
    back, timed = wb[::-1], np.zeros((k, k))
    timed[1:, 1:] = late[1:, 1:]
    cost, timing, events = np.zeros((3, k + 1, many)), np.zeros((3, k + 1, many)), np.zeros((3, k + 1, many), np.int16)
    for d in range(2 * k + 1):
        c, t, e = (x[d % 3] for x in (cost, timing, events))
        (c1, t1, e1), (c2, t2, e2) = ([x[(d - at) % 3] for x in (cost, timing, events)] for at in (1, 2))
        low, high = max(1, d - k), min(k, d - 1)
        if low <= high:
            here, above = slice(low, high + 1), slice(low - 1, high)
            differ = wa[above] != back[k - d + low : k - d + high + 1]
            step = timed[np.arange(low - 1, high), d - 1 - np.arange(low, high + 1)][:, None]
            diagonal = c2[above] + differ
            diagonal += step
            other = np.minimum(c1[above], c1[here])
            other += 1
            first, second = diagonal - other <= TOLERANCE, c1[above] - c1[here] <= TOLERANCE
            np.minimum(diagonal, other, out=c[here])
            t[here] = np.where(first, t2[above] + step, np.where(second, t1[above], t1[here]))
            e[here] = np.where(first, e2[above] + differ, np.where(second, e1[above], e1[here]) + np.int16(1))
        if d <= k:
            for at in (0, d):
                c[at], t[at], e[at] = d, 0, d
    return events[2 * k % 3, k].astype(np.int64), timing[2 * k % 3, k]


def _against_nulls(va: np.ndarray, ga: np.ndarray, vb: np.ndarray, gb: np.ndarray, i: int, j: int, k: int, n: int) -> list[dict]:
    """The windows of k events at i and j against the same places of n order nulls, by part."""
    from .align import TIMING_WEIGHT

    # The first column is the observed pair; gaps stay where they are.
    wa, wb = (np.vstack([v[at : at + k], v[permutations(len(v), side, n)[:, at : at + k]]]).T.copy() for side, (v, at) in enumerate(((va, i), (vb, j))))
    event, timing = event_and_timing(wa, wb, timing_costs(ga[i : i + k, None], gb[None, j : j + k]))
    parts = {"total": (event + timing) / (k + TIMING_WEIGHT * (k - 1)), "event_norm": event / k}
    return [{"k": k, "a_start": i, "b_start": j, "part": part} | summary(f[1:], float(f[0])) for part, f in parts.items()]


def evidence(sequences: DataFrame, spans: DataFrame, k: int, n: int) -> DataFrame:
    """Each fixed pair of spans (a, b, a_start, b_start, of k events) against the same
    places of n order nulls of both sequences: total and event part, summarised."""
    side = lambda s: sequences.select(F.col("session_id").alias(s), F.col("marks").alias(f"m{s}"), F.col("gaps").alias(f"g{s}"))
    rows = dealt(spans.select("a", "b", "a_start", "b_start").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "ga", "mb", "gb", "a_start", "b_start"), "a", "b")
    fields = to_arrow(EVIDENCE)  # on the driver: it needs the session

    def run(batches):
        for batch in batches:
            places = zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)
            out = [{"a": a, "b": b} | x for (a, b, sides, _), (i, j) in zip(coded_pairs(batch), places, strict=True) for x in _against_nulls(*sides, i, j, k, n)]
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)

    return rows.mapInArrow(run, EVIDENCE)


def best_evidence(sequences: DataFrame, pairs: DataFrame, spans: tuple[int, ...], n: int) -> DataFrame:
    """:func:`evidence` of the best pair of windows of each pair of sessions and span; a pair is one row of work, from the search on."""
    fields = to_arrow(EVIDENCE)  # on the driver: it needs the session

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                held = coded_pairs(batch.slice(begin, TOGETHER))
                found = [(*x, k) for k, *places, _ in best_windows([x[2] for x in held], spans, 1) for x in zip(*(p.tolist() for p in places), strict=True)]
                out = [{"a": held[r][0], "b": held[r][1]} | x for r, i, j, k in found for x in _against_nulls(*held[r][2], i, j, k, n)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, fields)

    return paired(sequences, pairs).mapInArrow(run, EVIDENCE)


# The seed of arbitrary draws, and how many the effect takes.
DRAW_SEED, DRAWS = 0x00C0FFEE5E1EC700, 1000


@lru_cache(maxsize=4)
def raw_draws(n: int) -> np.ndarray:
    g = lcg.Lcg(DRAW_SEED)
    return np.array([g.below(1 << 31) for _ in range(n)], np.int64)


def ranked_at(values: np.ndarray, q: float) -> float:
    """The value at round(q * (n - 1)), halves up, of ascending values."""
    return float(values[int(q * (len(values) - 1) + 0.5)])


def arbitrary_scores(sequences: DataFrame, pairs: DataFrame, spans: tuple[int, ...], draws: int = DRAWS) -> DataFrame:
    """a, b, k, arbitrary_median, arbitrary_q99: pooled surprisals of windows drawn without any search."""
    schema = "a string, b string, k int, arbitrary_median double, arbitrary_q99 double"

    fields = to_arrow(schema)  # on the driver: it needs the session

    def run(batches):
        raw = raw_draws(2 * draws)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                code = _codes(r["ma"], r["mb"])
                va, vb = (np.array([code[m] for m in r[f"m{s}"]]) for s in "ab")
                surprise = -np.log(np.bincount(np.concatenate([va, vb])) / (len(va) + len(vb)))
                for k in spans:
                    n, m = len(va) - k + 1, len(vb) - k + 1
                    if n < 1 or m < 1:
                        continue
                    wa, wb = (v[(raw[i::2] % c)[:, None] + np.arange(k)] for i, v, c in ((0, va, n), (1, vb, m)))
                    scores = np.sort(np.where(wa == wb, surprise[wa], 0.0).sum(1))
                    out.append({"a": r["a"], "b": r["b"], "k": k, "arbitrary_median": ranked_at(scores, 0.5), "arbitrary_q99": ranked_at(scores, 0.99)})
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)

    side = lambda s: sequences.select(F.col("session_id").alias(s), F.col("marks").alias(f"m{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb").mapInArrow(run, schema)


def selection_effect(found: DataFrame, arbitrary: DataFrame) -> DataFrame:
    """What searching alone does to a score: the median of the nulls' largest values
    against windows drawn without a search."""
    chosen = found.where("replicate >= 0").groupBy("a", "b", "k").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rows = arbitrary.join(chosen.select("a", "b", "k", nearest_rank(F.col("t"), 0.5).alias("selected_median")), ["a", "b", "k"])
    return rows.withColumns({"margin": F.col("selected_median") - F.col("arbitrary_q99"), "confirmed": F.col("selected_median") > F.col("arbitrary_median")})


def corpus_coverage(sequences: DataFrame, spans: tuple[int, ...], n: int) -> DataFrame:
    """Best coverage of each span per replicate of doublet nulls of all sessions (replicate -1: observed).

    Windows are counted set-wise: (replicate, k, window) -> distinct sessions."""
    places = sequences.select("session_id").distinct().select("session_id", F.row_number().over(_sessions()).alias("place"))  # ids alone
    ordered = sequences.select("session_id", "marks").join(places, "session_id")
    rows = dealt(ordered.crossJoin(sequences.sparkSession.range(-1, n).select(F.col("id").cast("int").alias("replicate"))), "session_id", "replicate")

    made = lambda out: pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["replicate", "k", "gram"])

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for marks, place, r in zip(*(batch.column(c).to_pylist() for c in range(1, 4)), strict=True):
                own = marks if r < 0 else lcg.doublet_null(marks, lcg.corpus_seed(r, place - 1))
                for k in spans:
                    grams = {"\x1f".join(own[i : i + k]) for i in range(len(own) - k + 1)}
                    for g in grams:
                        for column, value in zip(out, (r, k, g), strict=True):
                            column.append(value)
                if len(out[0]) > 100_000:
                    yield made(out)
                    out = ([], [], [])
            yield made(out)

    grams = rows.mapInArrow(run, "replicate int, k int, gram string")  # each gram once per session
    return grams.groupBy("replicate", "k", "gram").agg(F.count("*").alias("sessions")).groupBy("replicate", "k").agg(F.max("sessions").alias("best"))


def _sessions():
    from pyspark.sql import Window

    return Window.orderBy("session_id")


def coverage_nulls(coverage: DataFrame) -> DataFrame:
    """Per span: median, 95 and 99 % (nearest rank) and largest null coverage, and the observed one."""
    nulls = coverage.where("replicate >= 0").groupBy("k").agg(F.sort_array(F.collect_list("best")).alias("v"))
    own = coverage.where("replicate < 0").select("k", F.col("best").alias("observed"))
    rows = nulls.join(own, "k")
    return rows.select("k", F.size("v").alias("replicates"), nearest_rank(F.col("v"), 0.5).alias("median"), nearest_rank(F.col("v"), 0.95).alias("q95"), nearest_rank(F.col("v"), 0.99).alias("q99"), F.element_at("v", -1).alias("max"), "observed", ((1 + F.size(F.filter("v", lambda x: x >= F.col("observed")))) / (1 + F.size("v"))).alias("tail"))


def entropies(codes: np.ndarray) -> np.ndarray:
    """The entropy of each row; its shares are summed from the least up, so that equal counts give equal numbers."""
    rows, n = codes.shape
    ordered = np.sort(codes, axis=1)
    new = np.ones((rows, n), bool)
    np.not_equal(ordered[:, 1:], ordered[:, :-1], out=new[:, 1:])
    starts = np.flatnonzero(new)
    counts = np.diff(starts, append=rows * n)
    most = int(counts.max()) + 1
    many = np.bincount(starts // n * most + counts, minlength=rows * most)  # how many values of a row occur how often
    p = np.arange(1, most) / n
    terms, sizes = np.repeat(np.tile(np.concatenate([[0.0], p * np.log(p)]), rows), many), new.sum(1)
    begin, out = np.cumsum(sizes) - sizes, np.empty(rows)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        out[own] = -terms[begin[own, None] + np.arange(size)].sum(1)
    return out


def measures(codes: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    """For each row of codes: share of immediate repetitions, mean run length, and the entropy of
    pairs of neighbours over twice that of the marks (nan where that is 0)."""
    n = codes.shape[1]
    if n < 2:
        return None, np.full(len(codes), float(n)) if n else None, None
    same = (codes[:, 1:] == codes[:, :-1]).sum(1)
    states = int(codes.max()) + 1
    codes = codes.astype(np.int32 if states < 46_000 else np.int64)
    single, pair = entropies(codes), entropies(codes[:, :-1] * codes.dtype.type(states) + codes[:, 1:])
    return same / (n - 1), n / (n - same), np.divide(pair, 2 * single, out=np.full(len(codes), np.nan), where=single > 0)


#: Marks of null realisations that are held at once.
STATES = 1 << 21
MEASURES = ("immediate repetition rate", "mean run length", "transition entropy ratio")
STRUCTURE = "session_id string, construction string, measure string, observed double, null_median double, null_min double, null_max double, exceedances int, outside boolean, identical int, distinct int"


def structure_nulls(sequences: DataFrame, constructions: tuple[str, ...], n: int) -> DataFrame:
    """Each measure of a session against n nulls of it: median, range and exceedances, whether
    it lies outside the range; and how many nulls repeat the session or differ."""
    kinds = F.explode(F.array(*map(F.lit, constructions)))
    rows = dealt(sequences.select("session_id", "marks", kinds.alias("construction")), "session_id", "construction")

    fields = to_arrow(STRUCTURE)  # on the driver: it needs the session

    def run(batches):
        for batch in batches:
            out = []
            for session, marks, kind in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                code = {m: i for i, m in enumerate(dict.fromkeys(marks))}
                own = np.array([code[m] for m in marks], int)
                identical, distinct, parts, step = 0, set(), [], max(1, STATES // max(len(own), 1))
                for first in range(0, n, step):
                    nulls = made_nulls(own, kind, first, min(first + step, n), n)
                    identical += int((nulls == own).all(1).sum())
                    distinct.update(x.tobytes() if len(own) < 4096 else hashlib.sha256(x.tobytes()).digest() for x in nulls)
                    parts.append(measures(np.vstack([own[None], nulls])))  # the first row is the session itself
                shared = {"session_id": session, "construction": kind, "identical": identical, "distinct": len(distinct)}
                for name, *values in zip(MEASURES, *parts, strict=True):
                    if values[0] is None:
                        continue
                    observed, v = float(values[0][0]), np.sort(np.concatenate([x[1:] for x in values]))
                    if math.isnan(observed) or np.isnan(v).any():
                        continue
                    out.append(shared | {"measure": name, "observed": observed, "null_median": ranked_at(v, 0.5), "null_min": float(v[0]), "null_max": float(v[-1]), "exceedances": int((v >= observed).sum()), "outside": bool(observed < v[0] or observed > v[-1])})
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)

    return rows.mapInArrow(run, STRUCTURE)
