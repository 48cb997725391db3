"""Alignment of event windows, rankings over it, and scores of paired windows.

The alignment of two windows of k events is a k x k dynamic programme.  It is
unrolled into column expressions, one projection per anti-diagonal, so the JVM
compiles it and no row leaves it.  Each cell carries the cost and the counts of
its best path; on ties (within TOLERANCE) the diagonal comes before deletion and
deletion before insertion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt

# Fixed values of the metric: costs, weight of timing, damping in milliseconds, ratio of a full penalty.
SUBSTITUTION, GAP, TIMING_WEIGHT, FLOOR_MS, RATIO_FULL = 1.0, 1.0, 0.5, 100.0, 4.0
TOLERANCE = 1e-12
FIELDS = "cmsdint"  # cost, matches, substitutions, deletions, insertions, timed pairs (n), timing cost (t)


def timing_sql(a: str, b: str) -> str:
    return f"least(1.0D, abs(ln(({a} + {FLOOR_MS}D) / ({b} + {FLOOR_MS}D))) / ln({RATIO_FULL}D))"


def timing_term(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(F.log((a + FLOOR_MS) / (b + FLOOR_MS))) / F.log(F.lit(RATIO_FULL)))


def _edge(i: int, j: int) -> dict[str, str]:
    return {"c": f"{float(i + j)}D", "m": "0", "s": "0", "d": str(i), "i": str(j), "n": "0", "t": "0.0D"}


def layers(k: int, l: int | None = None) -> list[dict[str, str]]:
    """Expressions by column for each anti-diagonal, over a_i, b_j (marks) and x_i, y_j (gaps); spans of k and l events."""
    l = k if l is None else l

    def at(i: int, j: int) -> dict[str, str]:
        return {f: f"{f}_{i}_{j}" for f in FIELDS} if i and j else _edge(i, j)

    out = []
    for total in range(2, k + l + 1):
        first, second = {}, {}
        for i in range(max(1, total - l), min(k, total - 1) + 1):
            j = total - i
            diagonal, delete, insert = at(i - 1, j - 1), at(i - 1, j), at(i, j - 1)
            timed = i > 1 and j > 1
            same, time = f"a_{i} = b_{j}", f"{TIMING_WEIGHT}D * {timing_sql(f'x_{i}', f'y_{j}')}" if timed else "0.0D"
            first[f"p_{i}_{j}"] = f"CASE WHEN {same} THEN 0.0D ELSE {SUBSTITUTION}D END"
            first[f"q_{i}_{j}"] = time
            by_diagonal, by_delete, by_insert = f"({diagonal['c']} + p_{i}_{j} + q_{i}_{j})", f"({delete['c']} + {GAP}D)", f"({insert['c']} + {GAP}D)"
            second[f"c_{i}_{j}"] = f"least({by_diagonal}, {by_delete}, {by_insert})"
            pick = lambda f, d, e, n, bd=by_diagonal, be=by_delete, bi=by_insert: f"CASE WHEN {bd} - least({be}, {bi}) <= {TOLERANCE}D THEN {d} WHEN {be} - {bi} <= {TOLERANCE}D THEN {e} ELSE {n} END"
            second[f"m_{i}_{j}"] = pick("m", f"{diagonal['m']} + CASE WHEN {same} THEN 1 ELSE 0 END", delete["m"], insert["m"])
            second[f"s_{i}_{j}"] = pick("s", f"{diagonal['s']} + CASE WHEN {same} THEN 0 ELSE 1 END", delete["s"], insert["s"])
            second[f"d_{i}_{j}"] = pick("d", diagonal["d"], f"{delete['d']} + 1", insert["d"])
            second[f"i_{i}_{j}"] = pick("i", diagonal["i"], delete["i"], f"{insert['i']} + 1")
            second[f"n_{i}_{j}"] = pick("n", f"{diagonal['n']} + {int(timed)}", delete["n"], insert["n"])
            second[f"t_{i}_{j}"] = pick("t", f"{diagonal['t']} + q_{i}_{j}", delete["t"], insert["t"])
        out += [first, second]
    return out


def results(k: int, l: int | None = None) -> dict[str, str]:
    """The alignment's figures from the last cell."""
    l = k if l is None else l
    c, longest = f"_{k}_{l}", max(k, l)
    event = f"(s{c} + d{c} + i{c}) * 1.0D"
    return {
        "matches": f"m{c}",
        "substitutions": f"s{c}",
        "deletions": f"d{c}",
        "insertions": f"i{c}",
        "timed_pairs": f"n{c}",
        "event_cost": event,
        "timing_cost": f"t{c}",
        "event_norm": f"{event} / {longest}",
        "timing_norm": f"CASE WHEN n{c} = 0 THEN 0.0D ELSE t{c} / ({TIMING_WEIGHT}D * n{c}) END",
        "total": f"({event} + t{c}) / {longest + TIMING_WEIGHT * (longest - 1)}D",
    }


def align(pairs: DataFrame, k: int, l: int | None = None) -> DataFrame:
    """Adds the alignment's figures to pairs with a_marks, a_gaps of k events and b_marks, b_gaps of l (else k)."""
    l = k if l is None else l
    keep = [c for c in pairs.columns if c not in ("a_gaps", "b_gaps")]
    cells = {f"{name}_{i}": f"{column}[{i - 1}]" for name, column, n in (("a", "a_marks", k), ("b", "b_marks", l), ("x", "a_gaps", k), ("y", "b_gaps", l)) for i in range(1, n + 1)}
    rows = pairs.selectExpr(*keep, *[f"{e} AS {n}" for n, e in cells.items()])
    own = [*cells]
    made: list[list[str]] = []
    for layer in layers(k, l):
        rows = rows.selectExpr(*keep, *own, *[c for m in made[-4:] for c in m], *[f"{e} AS {n}" for n, e in layer.items()])
        made.append([*layer])
    return rows.selectExpr(*keep, *[f"{e} AS {n}" for n, e in results(k, l).items()])


ALIGNED = "a string, b string, a_start int, b_start int, matches int, substitutions int, deletions int, insertions int, timed_pairs int, event_cost double, timing_cost double, event_norm double, timing_norm double, total double"


def aligned_cells(rows: int, columns: int, same, time, shape) -> list[list[tuple]]:
    """The programme over arrays: for every cell the cost, the timing part of it, and the counts of its best path.

    same(i, j) and time(i, j) give, for the events i and j of each alignment of the
    given shape, whether marks agree and what timing costs (None: nothing).
    The counts are packed, FIELD_BITS each: matches, substitutions, deletions, insertions, timed pairs."""
    import numpy as np

    kind = np.int32 if 5 * FIELD_BITS < 31 and max(rows, columns) < 1 << FIELD_BITS - 1 else np.int64
    bits = FIELD_BITS if kind == np.int32 else 12
    one = [kind(1 << bits * f) for f in range(5)]
    edge = lambda i, j: (np.full(shape, float(i + j)), np.zeros(shape), np.full(shape, i * one[2] + j * one[3], kind))
    table = [[edge(0, j) for j in range(columns + 1)]]
    for i in range(1, rows + 1):
        row = [edge(i, 0)]
        for j in range(1, columns + 1):
            agree = same(i - 1, j - 1)
            late = time(i - 1, j - 1) if i > 1 and j > 1 else None
            (cd, td, nd), (ce, te, ne), (ci, ti, ni) = table[-1][j - 1], table[-1][j], row[-1]
            by_diagonal, step = cd + np.where(agree, 0.0, SUBSTITUTION), np.where(agree, one[0], one[1])
            if late is not None:
                by_diagonal, td, step = by_diagonal + late, td + late, step + one[4]
            by_delete, by_insert = ce + GAP, ci + GAP
            other = np.minimum(by_delete, by_insert)
            first, second = by_diagonal - other <= TOLERANCE, by_delete - by_insert <= TOLERANCE
            row.append((np.minimum(by_diagonal, other), np.where(first, td, np.where(second, te, ti)), np.where(first, nd + step, np.where(second, ne + one[2], ni + one[3]))))
        table.append(row)
    return table


#: Bits of a packed count: paths of up to 31 events in 32-bit words, longer ones in 64-bit words.
FIELD_BITS = 6


def cell_figures(cell: tuple, longest: int) -> dict:
    """The alignment's figures from a cell of :func:`aligned_cells`."""
    import numpy as np

    _, timing, packed = cell
    bits = FIELD_BITS if packed.dtype == np.int32 else 12
    m, s, d, i, n = (packed >> bits * f & (1 << bits) - 1 for f in range(5))
    event = SUBSTITUTION * s + GAP * (d + i)
    return {"matches": m, "substitutions": s, "deletions": d, "insertions": i, "timed_pairs": n, "event_cost": event, "timing_cost": timing, "event_norm": event / longest, "timing_norm": np.where(n > 0, timing / (TIMING_WEIGHT * np.maximum(n, 1)), 0.0), "total": (event + timing) / (longest + TIMING_WEIGHT * (longest - 1))}


def timing_costs(x, y, log=None):
    """What aligning events costs by their gaps (arrays that broadcast)."""
    import numpy as np

    with np.errstate(invalid="ignore", divide="ignore"):
        return TIMING_WEIGHT * np.minimum(1.0, np.abs((log or np.log)((x + FLOOR_MS) / (y + FLOOR_MS))) / np.log(RATIO_FULL))


def window_alignments(ma, ga, mb, gb, k: int) -> dict:
    """The same programme for all pairs of windows of two sequences (integer marks and
    gaps) at once: each cell is a matrix over (window of a, window of b), a
    stretch of one matrix of the two sequences' events."""
    n, m = len(ma) - k + 1, len(mb) - k + 1
    agree, late = ma[:, None] == mb[None, :], timing_costs(ga[:, None], gb[None, :])
    table = aligned_cells(k, k, lambda i, j: agree[i : i + n, j : j + m], lambda i, j: late[i : i + n, j : j + m], (n, m))
    return cell_figures(table[k][k], k)


#: Alignments of one sequence with itself that are held at once, and that are one row of work.
HELD, WORK = 1 << 16, 1 << 26


def library_log(x):
    """Logarithms by the C library, as SQL's ln takes them; the JVM's differ in the last bit, which orders ties."""
    import math

    import numpy as np

    return np.array([math.log(v) for v in x.ravel().tolist()]).reshape(x.shape)


def own_pairs(sequences: DataFrame, k: int, top: int | None = None, varied: bool = False, start: int | None = None) -> DataFrame:
    """Alignments of all pairs of disjoint windows of each session, a before b, or the first top
    of each row of work by total and places; with start, of the window there and all disjoint ones.

    varied: only windows of more than two different marks.  A row of work is a session with some of its
    windows (all, up to WORK alignments), which are aligned HELD at a time."""
    rows = sequences.where("session_id is not null").select("session_id", "marks", "gaps", (F.size("marks") - k + 1).alias("n")).where(F.col("n") > (start or 0))
    step = F.greatest(F.lit(1), (F.lit(WORK) / F.col("n")).cast("int"))
    begins = F.explode(F.sequence(F.lit(0), F.col("n") - 1, step)) if start is None else F.lit(start)
    rows = rows.withColumn("begin", begins)
    rows = rows.withColumn("end", F.least(F.col("begin") + (step if start is None else F.lit(1)), F.col("n")))
    rows = dealt(rows.select("session_id", "begin", "end", "marks", "gaps"), "session_id", "begin")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for session, begin, end, marks, gaps in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                code = {m: i for i, m in enumerate(dict.fromkeys(marks))}
                v, g = np.array([code[m] for m in marks]), np.array(gaps, float)
                for found in _own_ranked(v, g, k, begin, end, top, varied, start is not None):
                    yield pa.RecordBatch.from_arrays([pa.array([session] * len(found["total"])), *(pa.array(x.astype(np.int32)) if c.endswith("start") or c in COUNTS else pa.array(x) for c, x in found.items())], names=["session_id", *found])

    return rows.mapInArrow(run, ALIGNED.replace("a string, b string", "session_id string"))


def _own_ranked(v, g, k: int, begin: int, end: int, top: int | None, varied: bool, both: bool):
    """Yields a_start, b_start and figures of the windows from begin to end - 1 against those after
    them (both: also before them), a part at a time, or the first top by total and places."""
    import numpy as np

    n, kept = len(v) - k + 1, None
    rich = np.array([len(set(v[i : i + k].tolist())) > 2 for i in range(n)]) if varied else np.ones(n, bool)
    while begin < end:
        other = 0 if both else begin + k
        if other >= n:
            break
        last = min(end, begin + max(1, HELD // (n - other)))
        a, b = slice(begin, last + k - 1), slice(other, n + k - 1)
        shape = (last - begin, n - other)
        agree, late = v[a, None] == v[None, b], timing_costs(g[a, None], g[None, b], library_log)
        table = aligned_cells(k, k, lambda i, j: agree[i : i + shape[0], j : j + shape[1]], lambda i, j: late[i : i + shape[0], j : j + shape[1]], shape)  # noqa: B023
        here, there = np.arange(begin, last)[:, None], np.arange(other, n)
        apart = (abs(there - here) if both else there - here) >= k
        at = np.flatnonzero(apart & rich[begin:last, None] & rich[other:n])
        figures = {c: x.ravel()[at] for c, x in cell_figures(table[k][k], k).items()}
        figures = {"a_start": at // shape[1] + begin, "b_start": at % shape[1] + other} | figures
        begin = last
        if top is None:
            yield figures
            continue
        if kept is not None:
            figures = {c: np.concatenate([kept[c], x]) for c, x in figures.items()}
        best = np.sort(first_of(figures["total"], top))  # in order of places, which later parts go on with
        kept = {c: x[best] for c, x in figures.items()}
    if kept is not None:
        yield kept


def cross_pairs(sequences: DataFrame, pairs: DataFrame, k: int, top: int | None = None) -> DataFrame:
    """Alignments of all pairs of windows of the sessions of each given pair (a, b), or
    the first top of each pair's ranking.

    sequences has session_id, marks and gaps (nulls.arrays).  A pair of sessions
    is one row of work: its windows are aligned as matrices in an Arrow batch,
    some hundred times faster than row by row in compiled columns, whose code
    grows with k * k beyond what the JVM compiles."""
    rows = paired(sequences, pairs)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for a, b, found in _searched(batches, k):
            n, m = found["total"].shape
            keep = np.arange(n * m)
            if top is not None:
                keep = first_of(found["total"].ravel(), top)  # ties by window positions
            columns = {"a": [a] * len(keep), "b": [b] * len(keep), "a_start": keep // m, "b_start": keep % m} | {c: v.ravel()[keep] for c, v in found.items()}
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) if c in "ab" else pa.array(np.asarray(v).astype(np.int32)) if c.endswith("start") or c in COUNTS else pa.array(v) for c, v in columns.items()], names=list(columns))

    return rows.mapInArrow(run, ALIGNED)


#: Pairs of sessions whose candidates are aligned together; costs that other sums could order otherwise are nearer than this.
TOGETHER, NEAR = 64, 1e-9


def best_windows(rows: list[tuple], spans: tuple[int, ...], top: int):
    """Yields (k, row, a_start, b_start, figures) for each span: of each row (marks and gaps of two sequences; marks as
    integers) the first top pairs of windows, in order of total and places, as :func:`cross_pairs` has them.

    One programme of costs ranks all spans; figures are made only for pairs of windows that can be among the first."""
    import numpy as np

    from .nulls import ladder_gains

    near = {k: [] for k in spans}
    for r, (va, ga, vb, gb) in enumerate(rows):
        late, agree = timing_costs(ga[:, None], gb[None, :]), va[:, None] == vb[None, :]
        for k, gains in ladder_gains(va[:, None], vb[:, None], late, spans, exact=True):
            gained, m = gains[:, :, 0].ravel(), gains.shape[1]
            at = np.flatnonzero(gained >= -np.partition(-gained, top - 1)[top - 1] - NEAR) if top < len(gained) else np.arange(len(gained))
            i, j = at // m, at % m
            p, q = i + np.arange(k)[:, None, None], j + np.arange(k)[:, None]
            near[k].append((np.full(len(at), r), i, j, agree[p, q], late[p, q]))
    for k, found in near.items():
        if found:
            row, i, j, agree, late = (np.concatenate(x, axis=-1) for x in zip(*found, strict=True))
            table = aligned_cells(k, k, lambda p, q: agree[p, q], lambda p, q: late[p, q], row.shape)  # noqa: B023
            figures = cell_figures(table[k][k], k)
            order = np.lexsort((figures["total"], row))  # ties by place, in which candidates are
            begins = np.searchsorted(row, np.arange(len(rows)))
            order = order[np.arange(len(row)) - begins[row[order]] < top]
            yield k, row[order], i[order], j[order], {c: x[order] for c, x in figures.items()}


def coded_pairs(batch) -> list[tuple]:
    """Rows of a, b, marks and gaps of both sides as (a, b, (marks as integers, gaps, both sides'), number of marks)."""
    import numpy as np

    out = []
    for a, b, ma, ga, mb, gb in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
        code = {m: i for i, m in enumerate(dict.fromkeys([*ma, *mb]))}
        out.append((a, b, (np.array([code[m] for m in ma], int), np.array(ga, float), np.array([code[m] for m in mb], int), np.array(gb, float)), len(code)))
    return out


def agreement_tails(marks, have, total, agreed):
    """agreement_tail of many spans of equal length at once: marks (spans by places), how often the population has each
    of them, its size, and how many places agree."""
    from math import comb

    import numpy as np

    many, n = marks.shape
    equal = marks[:, :, None] == marks[:, None, :]
    places, first = equal.sum(2), ~np.tril(equal, -1).any(2)
    combs = np.array([[comb(p, m) for m in range(n + 1)] for p in range(n + 1)], float)
    sums = [np.ones(many)] + [np.zeros(many)] * n
    for i in range(n):
        own = np.where(first[:, i], places[:, i], 0)
        most = int(own.max(initial=0))
        ways, falling = combs[own], [np.ones(many)]
        for m in range(most):
            falling.append(falling[-1] * np.maximum(have[:, i] - m, 0))
        new = [np.zeros(many) for _ in range(n + 1)]
        for size, value in enumerate(sums):
            for m in range(min(most, n - size) + 1):
                new[size + m] += value * ways[:, m] * falling[m]
        sums = new
    tail, below = np.zeros(many), np.ones(many)
    signed = np.array([[(-1) ** (j - k) * comb(j - 1, k - 1) if 0 < k <= j else 0 for j in range(n + 1)] for k in range(n + 1)], float)
    for j in range(1, n + 1):
        below = below * (total - j + 1)
        tail += signed[agreed, j] * (sums[j] / below)
    return np.where(agreed == 0, 1.0, np.minimum(1.0, np.maximum(tail, 2.2250738585072014e-308)))


def best_surprisals(sequences: DataFrame, pairs: DataFrame, spans: tuple[int, ...], top: int) -> DataFrame:
    """k, a, b, a_start, b_start, surprisal (:func:`surprisal`) of the first top pairs of windows of each pair of sessions
    and span of at most 12 events; a pair is one row of work, from the search to the score."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                held = coded_pairs(batch.slice(begin, TOGETHER))
                a, b = (pa.array([x[c] for x in held], pa.string()) for c in (0, 1))
                rows, sizes = [x[2] for x in held], np.array([x[3] for x in held])
                sides = []
                for side in (0, 2):  # marks of all rows one after another, and each row's counts of them
                    v = [x[side] for x in rows]
                    lengths = np.array([len(x) for x in v])
                    sides.append((np.concatenate(v), np.cumsum(lengths) - lengths, lengths, np.concatenate([np.bincount(x, minlength=s) for x, s in zip(v, sizes, strict=True)])))
                codes = np.cumsum(sizes) - sizes
                for k, row, i, j, _ in best_windows(rows, spans, top):
                    x, y = (flat[(start[row] + at)[:, None] + np.arange(k)] for (flat, start, _, _), at in zip(sides, (i, j), strict=True))
                    agreed = (x == y).sum(1)
                    tails = [agreement_tails(own, counts[codes[row][:, None] + own], lengths[row], agreed) for own, (_, _, lengths, counts) in ((x, sides[1]), (y, sides[0]))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), a.take(pa.array(row)), b.take(pa.array(row)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(0.5 * (-np.log(tails[0]) - np.log(tails[1])))], names=["k", "a", "b", "a_start", "b_start", "surprisal"])

    return paired(sequences, pairs).mapInArrow(run, "k int, a string, b string, a_start int, b_start int, surprisal double")


COUNTS = ("matches", "substitutions", "deletions", "insertions", "timed_pairs")


def first_of(values, n: int):
    """Places of the n smallest values, ties by place."""
    import numpy as np

    if n < len(values):
        limit = np.partition(values, n - 1)[n - 1]
        at = np.flatnonzero(values <= limit)
        return at[np.argsort(values[at], kind="stable")][:n]
    return np.argsort(values, kind="stable")


def _searched(batches, k: int):
    """a, b and the figures of all pairs of their windows, for each row of two sequences."""
    import numpy as np

    for batch in batches:
        for a, b, ma, ga, mb, gb in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if len(ma) < k or len(mb) < k:
                continue
            code = {m: i for i, m in enumerate(dict.fromkeys([*ma, *mb]))}
            coded = lambda marks, code=code: np.array([code[m] for m in marks])
            yield a, b, window_alignments(coded(ma), np.array(ga, float), coded(mb), np.array(gb, float), k)


def paired(sequences: DataFrame, pairs: DataFrame) -> DataFrame:
    side = lambda s: sequences.select(F.col("session_id").alias(s), F.col("marks").alias(f"m{s}"), F.col("gaps").alias(f"g{s}"))
    return dealt(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "ga", "mb", "gb"), "a", "b")


def cross_totals(sequences: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """What the search of each pair (a, b) sums to; summed where it is searched."""

    def run(batches):
        import pyarrow as pa

        out = [{"a": a, "b": b, "pairs": f["total"].size, "total": float(f["total"].sum()), "best": float(f["total"].min())} | {c: int(f[c].sum()) for c in COUNTS} for a, b, f in _searched(batches, k)]
        if out:
            yield pa.RecordBatch.from_pylist(out)

    return paired(sequences, pairs).mapInArrow(run, "a string, b string, pairs long, total double, best double, " + ", ".join(f"{c} long" for c in COUNTS))


def with_marks(aligned: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds a_marks and b_marks to pairs of windows by their positions."""
    for s in "ab":
        aligned = aligned.join(windows.select(F.col("session_id").alias(s), F.col("start").alias(f"{s}_start"), F.col("marks").alias(f"{s}_marks")), [s, f"{s}_start"])
    return aligned


def ranked(aligned: DataFrame, *within: str) -> DataFrame:
    """Adds rank: best total first, then by window positions."""
    return aligned.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy("total", "a_start", "b_start")))


def without_overlaps(totals, k: int, keep: int) -> list[tuple[int, int]]:
    """Greedy suppression along the ranking of a matrix of totals: a pair stays unless
    either of its windows overlaps that of one that has stayed.  By repeated
    minimum: what overlaps a choice leaves the matrix."""
    import numpy as np

    out, left = [], np.array(totals, float)
    while len(out) < keep:
        i, j = divmod(int(left.argmin()), left.shape[1])
        if not np.isfinite(left[i, j]):
            break
        out.append((i, j))
        left[max(0, i - k + 1) : i + k] = np.inf
        left[:, max(0, j - k + 1) : j + k] = np.inf
    return out


# ------------------------------------------------------------ boundaries of a pair

RADIUS, FEWEST = 3, 3  # how far a boundary moves, and how short a span gets


def boundary_moves(seeds: DataFrame, radius: int = RADIUS, fewest: int = FEWEST) -> DataFrame:
    """All moves of the four boundaries of each seed (a_from, a_to, b_from, b_to, and the
    lengths a_size and b_size of the sequences): the moved spans, and whether they are valid."""
    step = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    rows = seeds
    for name in ("a_from", "a_to", "b_from", "b_to"):
        rows = rows.withColumn(f"d_{name}", step)
    for name in ("a_from", "a_to", "b_from", "b_to"):
        rows = rows.withColumn(name, F.col(name) + F.col(f"d_{name}"))
    valid = F.lit(True)
    for s in "ab":
        valid = valid & (F.col(f"{s}_from") >= 0) & (F.col(f"{s}_to") <= F.col(f"{s}_size")) & (F.col(f"{s}_to") - F.col(f"{s}_from") >= fewest)
    return rows.withColumn("valid", valid)


def prefix_tables(va, ga, vb, gb, starts_a, starts_b, rows: int, columns: int):
    """aligned_cells of the spans that begin at each of the given places and are of up
    to rows and columns events; cells beyond a sequence's end mean nothing."""
    import numpy as np

    at = lambda v, s, i: v[np.minimum(s + i, len(v) - 1)]
    return aligned_cells(rows, columns, lambda i, j: at(va, starts_a, i) == at(vb, starts_b, j), lambda i, j: timing_costs(at(ga, starts_a, i), at(gb, starts_b, j)), starts_a.shape)


REFINED = "a string, b string, evaluated int, rejected int, seed_total double, points int, a_from int, a_to int, b_from int, b_to int, retained int, total double, frontier string"


def refine(sequences: DataFrame, seeds: DataFrame, radius: int = RADIUS, fewest: int = FEWEST) -> DataFrame:
    """Every valid move of the four boundaries of each seed (a, b, a_from, a_to, b_from,
    b_to), scored; the Pareto frontier of lower total and more events retained (of
    the shorter span), and its pick: the longest that is no worse than the
    seed, else the best.

    One table for each pair of starts holds all ends, so a seed is
    (2 * radius + 1) ** 2 tables at once and not their square of alignments."""
    side = lambda s: sequences.select(F.col("session_id").alias(s), F.col("marks").alias(f"m{s}"), F.col("gaps").alias(f"g{s}"))
    rows = dealt(seeds.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_from", "a_to", "b_from", "b_to", "ma", "ga", "mb", "gb"), "a", "b")

    fields = to_arrow(REFINED)  # on the driver: it needs the session

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [x for r in batch.to_pylist() if (x := refined(r, radius, fewest))]
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)

    return rows.mapInArrow(run, REFINED)


def to_arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def refined(r: dict, radius: int, fewest: int) -> dict | None:
    import numpy as np

    code = {m: i for i, m in enumerate(dict.fromkeys([*r["ma"], *r["mb"]]))}
    va, vb = np.array([code[m] for m in r["ma"]]), np.array([code[m] for m in r["mb"]])
    ga, gb = np.array(r["ga"], float), np.array(r["gb"], float)
    moves = np.arange(-radius, radius + 1)
    valid = lambda x, y, v: (x >= 0) & (y <= len(v)) & (y - x >= fewest)
    if not (valid(r["a_from"], r["a_to"], va) and valid(r["b_from"], r["b_to"], vb)):
        return None
    sa, sb = (x.ravel() for x in np.meshgrid(r["a_from"] + moves, r["b_from"] + moves, indexing="ij"))
    most_a, most_b = r["a_to"] - r["a_from"] + 2 * radius, r["b_to"] - r["b_from"] + 2 * radius
    table = prefix_tables(va, ga, vb, gb, np.maximum(sa, 0), np.maximum(sb, 0), most_a, most_b)
    found = []
    for n in range(fewest, most_a + 1):
        for m in range(fewest, most_b + 1):
            total = cell_figures(table[n][m], max(n, m))["total"]
            ok = valid(sa, sa + n, va) & valid(sb, sb + m, vb) & (np.abs(sa + n - r["a_to"]) <= radius) & (np.abs(sb + m - r["b_to"]) <= radius)
            found += [(min(n, m), float(total[x]), int(sa[x]), int(sa[x]) + n, int(sb[x]), int(sb[x]) + m) for x in np.flatnonzero(ok)]
    seed = next(x[1] for x in found if x[2:] == (r["a_from"], r["a_to"], r["b_from"], r["b_to"]))
    best: dict[int, tuple] = {}
    for x in found:  # ties by the moves, which order as the boundaries do
        if x[0] not in best or x[1:] < best[x[0]][1:]:
            best[x[0]] = x
    frontier, least = [], float("inf")
    for retained in sorted(best, reverse=True):
        if best[retained][1] < least:
            least = best[retained][1]
            frontier.append(best[retained])
    good = [x for x in frontier if x[1] <= seed]
    pick = good[0] if good else frontier[-1]
    every = (2 * radius + 1) ** 4
    return {"a": r["a"], "b": r["b"], "evaluated": len(found), "rejected": every - len(found), "seed_total": seed, "points": len(frontier), "a_from": pick[2], "a_to": pick[3], "b_from": pick[4], "b_to": pick[5], "retained": pick[0], "total": pick[1], "frontier": ",".join(f"{x[0]}:{x[2]}-{x[3]}:{x[4]}-{x[5]}" for x in frontier)}


# ------------------------------------------------------------ scores of pairs


def with_counts(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Adds each side's mark counts (a map over its vocabulary) and number of events."""
    counts = events.groupBy("session_id", "mark").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("mark", "n"))).alias("counts"), F.sum("n").alias("total"))
    for side in "ab":
        pairs = pairs.join(counts.select(F.col("session_id").alias(side), F.col("counts").alias(f"{side}_counts"), F.col("total").alias(f"{side}_total")), side)
    return pairs


def _at_least_one(counts: str, mark: Column) -> Column:
    return F.greatest(F.coalesce(F.try_element_at(F.col(counts), mark), F.lit(1)), F.lit(1))


def scores() -> dict[str, Column]:
    """Name -> score of equally long spans a_marks and b_marks (with_counts gives the rest)."""
    a, b = F.col("a_marks"), F.col("b_marks")
    k = F.size(a)
    agreed = F.filter(F.zip_with(a, b, lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    place = F.sequence(F.lit(0), k - 1)
    novel = F.filter(F.transform(place, lambda i: F.when((F.get(a, i) == F.get(b, i)) & (F.array_position(a, F.get(a, i)) == i + 1), F.get(a, i))), lambda x: x.isNotNull())
    own = lambda m: -F.log(_at_least_one("a_counts", m) / F.greatest(F.col("a_total"), F.lit(1)))
    pooled = lambda m: -F.log((_at_least_one("a_counts", m) + _at_least_one("b_counts", m)) / (F.greatest(F.col("a_total"), F.lit(1)) + F.greatest(F.col("b_total"), F.lit(1))))
    total = lambda marks, f: F.aggregate(marks, F.lit(0.0), lambda s, m: s + f(m))
    n = F.size(agreed)
    r1 = total(agreed, pooled)
    return {
        "agreements": n.cast("double"),
        "agreement_rate": n / k,
        "distinct_agreements": F.size(F.array_distinct(agreed)).cast("double"),
        "distinct_agreement_rate": F.size(F.array_distinct(agreed)) / k,
        "span_distinct": F.size(F.array_distinct(a)).cast("double"),
        "first_occurrence_agreements": F.size(novel).cast("double"),
        "negative_repeats": -(k - F.size(F.array_distinct(a))).cast("double"),
        "rarity_of_agreements": total(agreed, own),
        "novel_rarity": total(novel, own),
        "r1_pooled_sum": r1,
        "r2_pooled_mean": F.when(n == 0, 0.0).otherwise(r1 / n),
        "r3_pooled_density": r1 / k,
    }


def score(pairs: DataFrame, *names: str) -> DataFrame:
    every = scores()
    return pairs.withColumns({n: every[n] for n in names or every})


def agreement_tail(target: list[str], population: dict[str, int], total: int, k: int) -> float | None:
    """Chance that a span drawn without order from the population agrees with
    target in k places or more: subset sums and Jordan's formula."""
    from math import comb, prod

    n = len(target)
    if not 0 < n <= 12 or total < n or k > n:
        return None
    if k == 0:
        return 1.0
    falling = lambda x, m: prod(range(x - m + 1, x + 1)) if m <= x else 0
    # Sets of places count by how many of each mark they hold, so a product over marks
    # of (ways to choose, falling factorial) replaces the enumeration of subsets.
    sums = [1.0] + [0.0] * n
    for mark in dict.fromkeys(target):
        places, have = target.count(mark), population.get(mark, 0)
        new = [0.0] * (n + 1)
        for size, value in enumerate(sums):
            for m in range(min(places, n - size) + 1):
                new[size + m] += value * comb(places, m) * falling(have, m)
        sums = new
    sums = [s / falling(total, j) if s else 0.0 for j, s in enumerate(sums)]
    tail = sum((-1) ** (j - k) * comb(j - 1, k - 1) * sums[j] for j in range(k, n + 1))
    return min(1.0, max(tail, 2.2250738585072014e-308))


def surprisal(pairs: DataFrame) -> DataFrame:
    """Adds surprisal: mean of -ln of both directions' agreement tails (Arrow batches:
    inclusion-exclusion over marks has no column form)."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*pairs.schema.fields, StructField("surprisal", DoubleType())])

    def run(batches):
        import math

        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist(maps_as_pydicts="strict")
            out = []
            for r in rows:
                n = sum(x == y for x, y in zip(r["a_marks"], r["b_marks"], strict=True))
                f, b = agreement_tail(r["a_marks"], r["b_counts"], r["b_total"], n), agreement_tail(r["b_marks"], r["a_counts"], r["a_total"], n)
                out.append(None if f is None or b is None else 0.5 * (-math.log(f) - math.log(b)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "surprisal"])

    return pairs.mapInArrow(run, schema)
