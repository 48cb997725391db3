"""Marked event sequences, their windows, and what is counted over them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt


def by_session():
    return Window.partitionBy("session_id").orderBy("pos")


def mark(version="version", kind="kind", tool="tool_name") -> Column:
    """v{version}:{kind}, with /{tool} where a tool name was delivered."""
    return F.concat(F.lit("v"), F.col(version).cast("string"), F.lit(":"), F.col(kind), F.coalesce(F.concat(F.lit("/"), F.col(tool)), F.lit("")))


def project(ledger: DataFrame, channels: tuple[str, ...] = ("observed",)) -> DataFrame:
    """session_id, pos, sequence, mark, offset_ms, gap_ms, clamped.

    Offsets count from the earliest record of all channels; gaps from the
    previous retained record, in order of sequence; a clock that went back is a
    gap of 0 that is flagged."""
    origin = F.min("epoch_ns").over(Window.partitionBy("session_id"))
    kept = ledger.withColumn("_origin", origin).where(F.col("channel").isin(*channels))
    order = Window.partitionBy("session_id").orderBy("sequence")
    step = F.col("epoch_ns") - F.lag("epoch_ns").over(order)
    return kept.withColumn("_step", step).select(
        "session_id",
        (F.row_number().over(order) - 1).alias("pos"),
        "sequence",
        mark().alias("mark"),
        F.expr("(epoch_ns - _origin) div 1000000").alias("offset_ms"),
        F.expr("greatest(_step, 0) div 1000000").alias("gap_ms"),
        F.coalesce(F.col("_step") < 0, F.lit(False)).alias("clamped"),
    )


def windows(events: DataFrame, k: int) -> DataFrame:
    """session_id, start, marks and gaps of every window of k events; the first
    gap is null, having no predecessor in the window."""
    frame = by_session().rowsBetween(0, k - 1)
    rows = events.select("session_id", F.col("pos").alias("start"), F.collect_list("mark").over(frame).alias("marks"), F.collect_list(F.coalesce("gap_ms", F.lit(-1))).over(frame).alias("gaps"))
    return rows.where(F.size("marks") == k)


def distinct_marks(marks: Column | str = "marks") -> Column:
    return F.size(F.array_distinct(marks))


def degenerate(marks: Column | str = "marks") -> Column:
    return distinct_marks(marks) <= 2


def marginals(events: DataFrame) -> DataFrame:
    """Counts of marks, ranked by count, then by label."""
    counts = events.groupBy("session_id", "mark").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("n").desc(), "mark")))


def envelope(events: DataFrame) -> DataFrame:
    """Vocabulary, most and least counts, singletons, and deciles of counts (linear interpolation)."""
    counts = events.groupBy("session_id", "mark").agg(F.count("*").alias("n"))
    q = F.percentile("n", F.array(*[F.lit(x / 10) for x in range(11)]))
    rows = counts.groupBy("session_id").agg(F.count("*").alias("vocabulary"), F.max("n").alias("max_count"), F.min("n").alias("min_count"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum("n").alias("events"), q.alias("q"))
    return rows.select("*", *[F.col("q")[k].alias(f"d{k}") for k in range(11)]).drop("q")


def approaches(events: DataFrame, spans: tuple[int, ...] = (3, 4, 6, 8, 12)) -> DataFrame:
    """Per span k: the boundary N**((k-1)/k), and how many marks are more frequent."""
    counts = events.groupBy("session_id", "mark").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("session_id")))
    rows = counts.select("session_id", "n", "total", F.explode(F.array(*map(F.lit, spans))).alias("k"))
    boundary = F.pow(F.col("total").cast("double"), (F.col("k") - 1) / F.col("k"))
    return rows.withColumn("boundary", boundary).groupBy("session_id", "k").agg(F.max("boundary").alias("boundary"), F.max(F.col("n") / F.col("boundary")).alias("max_margin"), F.count_if(F.col("n") > F.col("boundary")).alias("marks_above"))


def transitions(events: DataFrame) -> DataFrame:
    """(session_id, source, target, n) of consecutive marks."""
    pairs = events.select("session_id", F.lag("mark").over(by_session()).alias("source"), F.col("mark").alias("target"))
    return pairs.where("source is not null").groupBy("session_id", "source", "target").agg(F.count("*").alias("n"))


def divergence(events: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """For each given pair (a, b), else each session and the next one by id: total variation
    of transitions and of marks, the largest of a state's successors, and absent transitions."""
    follow = adjacent_pairs(events) if pairs is None else pairs
    sides = follow.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("session_id"), F.lit(1).alias("first")), F.struct(F.col("b").alias("session_id"), F.lit(0).alias("first")))).alias("x")).select("a", "b", "x.*")

    def shares(rows: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
        total = F.sum("n").over(Window.partitionBy("session_id", *within))
        both = sides.join(rows.withColumn("p", F.col("n") / total), "session_id")
        return both.groupBy("a", "b", *keys).agg(F.sum(F.when(F.col("first") == 1, F.col("p")).otherwise(0.0)).alias("pa"), F.sum(F.when(F.col("first") == 0, F.col("p")).otherwise(0.0)).alias("pb"))

    gap = F.abs(F.col("pa") - F.col("pb"))
    t = transitions(events)
    whole = shares(t, ["source", "target"], []).groupBy("a", "b").agg((0.5 * F.sum(gap)).alias("transition_tv"), F.count_if((F.col("pa") > 0) & (F.col("pb") == 0)).alias("absent"))
    states = shares(t, ["source", "target"], ["source"]).groupBy("a", "b", "source").agg((0.5 * F.sum(gap)).alias("tv"), F.sum("pa").alias("sa"), F.sum("pb").alias("sb")).where("sa > 0 and sb > 0").groupBy("a", "b").agg(F.max("tv").alias("max_state_tv"))
    marks = shares(events.groupBy("session_id", "mark").agg(F.count("*").alias("n")), ["mark"], []).groupBy("a", "b").agg((0.5 * F.sum(gap)).alias("marginal_tv"))
    return whole.join(states, ["a", "b"], "left").join(marks, ["a", "b"])


def structure(events: DataFrame) -> DataFrame:
    """Share of immediate repetitions, mean run length, and the entropy of pairs
    of marks over twice that of marks."""
    before = F.lag("mark").over(by_session())
    runs = events.select("session_id", "mark", (F.col("mark") == before).alias("same")).groupBy("session_id").agg(F.count("*").alias("n"), F.avg(F.col("same").cast("double")).alias("immediate_repetition"), (F.count("*") / (F.count_if(~F.col("same")) + 1)).alias("mean_run_length"))
    entropy = lambda total: F.sum(-(F.col("n") / total) * F.ln(F.col("n") / total))
    single = events.groupBy("session_id", "mark").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy("session_id"))).groupBy("session_id").agg(entropy(F.col("t")).alias("h1"))
    pair = transitions(events).withColumn("t", F.sum("n").over(Window.partitionBy("session_id"))).groupBy("session_id").agg(entropy(F.col("t")).alias("h2"))
    return runs.join(single, "session_id").join(pair, "session_id").select("session_id", "immediate_repetition", "mean_run_length", F.when(F.col("h1") > 0, F.col("h2") / (2 * F.col("h1"))).alias("entropy_ratio"))


def repeated_grams(events: DataFrame, k: int) -> DataFrame:
    """Per session: windows of k marks that occur more than once, and positions in them."""
    grams = windows(events, k).groupBy("session_id", "marks").agg(F.count("*").alias("n"), F.collect_list("start").alias("starts")).where("n > 1")
    positions = grams.select("session_id", "marks", F.explode("starts").alias("s")).select("session_id", "marks", F.explode(F.sequence(F.col("s"), F.col("s") + k - 1)).alias("p"))
    return positions.groupBy("session_id").agg(F.count_distinct("marks").alias("repeated_grams"), F.count_distinct("p").alias("positions"))


def best_coverage(events: DataFrame, spans: tuple[int, ...] = (3, 4, 6, 8, 12)) -> DataFrame:
    """Per span: the most sessions that share one window of marks, and how many windows are shared at all."""
    rows = None
    for k in spans:
        own = windows(events, k).select(F.lit(k).alias("k"), "session_id", F.xxhash64("marks").alias("h"), F.array_join("marks", "\x1f").alias("gram"))
        rows = own if rows is None else rows.unionByName(own)
    grams = rows.groupBy("k", "gram").agg(F.count_distinct("session_id").alias("sessions"))
    return grams.groupBy("k").agg(F.max("sessions").alias("best_sessions"), F.count_if(F.col("sessions") > 1).alias("shared_grams"), F.count("*").alias("grams"))


def automaton(marks: list) -> tuple[list[dict], list[int], list[int]]:
    """Suffix automaton of a sequence: each state's steps by mark, its suffix link and longest length; at most two states a mark."""
    steps, link, length, last = [{}], [-1], [0], 0
    for mark in marks:
        new, at = len(steps), last
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at >= 0 and mark not in steps[at]:
            steps[at][mark] = new
            at = link[at]
        if at >= 0:
            to = steps[at][mark]
            if length[to] == length[at] + 1:
                link[new] = to
            else:  # the state stands for longer runs as well: one of its own for the shorter
                copy = len(steps)
                steps.append(dict(steps[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and steps[at].get(mark) == to:
                    steps[at][mark] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return steps, link, length


def longest_run_in(held: tuple[list[dict], list[int], list[int]], marks: list) -> int:
    """The longest run of marks that the automaton's sequence holds."""
    steps, link, length = held
    at = run = longest = 0
    for mark in marks:
        while at and mark not in steps[at]:
            at = link[at]
            run = length[at]
        if mark in steps[at]:
            at, run = steps[at][mark], run + 1
        longest = max(longest, run)
    return longest


def longest_shared_run(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) of sessions: the longest run of equal marks.

    A pair costs its two lengths, however often marks repeat: the automaton of a
    is built once for the pairs of a that come one after another, and b walks through it."""
    held = events.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "mark"))).getField("mark").alias("marks"))
    side = lambda s: held.select(F.col("session_id").alias(s), F.col("marks").alias(f"m{s}"))
    rows = dealt(pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "ma", "mb"), "a", "b").sortWithinPartitions("a")

    def run(batches):
        name, own = None, None
        for batch in batches:
            out = []
            for a, b, ma, mb in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if own is None or a != name:
                    name, own = a, automaton(ma or [])
                out.append((a, b, longest_run_in(own, mb or [])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["a", "b", "longest"])

    return rows.mapInArrow(run, "a string, b string, longest long")


def realised_figures(own, nulls) -> tuple:
    """transition_tv, absent, max_state_tv (nan: no state in common) and marginal_tv of each row of nulls (states
    as numbers) against one path of as many states, as :func:`divergence` has them."""
    import numpy as np

    both = np.vstack([own[None], nulls]).astype(np.int64)
    rows, states = len(both), int(both.max()) + 1

    def counted(codes):
        found, place = np.unique(codes, return_inverse=True)
        place = place.reshape(codes.shape) + np.arange(rows)[:, None] * len(found)
        return found, np.bincount(place.ravel(), minlength=rows * len(found)).reshape(rows, len(found))

    steps, n = counted(both[:, :-1] * states + both[:, 1:])
    share = n / n.sum(1, keepdims=True)
    transition = 0.5 * np.abs(share[0] - share[1:]).sum(1)
    absent = ((n[0] > 0) & (n[1:] == 0)).sum(1)
    begins = np.flatnonzero(np.diff(steps // states, prepend=-1))  # steps are in order of their sources
    left = np.add.reduceat(n, begins, axis=1)
    within = n / np.maximum(np.repeat(left, np.diff(begins, append=len(steps)), axis=1), 1)
    apart = 0.5 * np.add.reduceat(np.abs(within[0] - within[1:]), begins, axis=1)
    common = (left[0] > 0) & (left[1:] > 0)
    state = np.where(common.any(1), np.where(common, apart, -1.0).max(1), np.nan)
    marks = counted(both)[1] / both.shape[1]
    return transition, absent, state, 0.5 * np.abs(marks[0] - marks[1:]).sum(1)


FIDELITY = "transition_tv double, absent long, max_state_tv double, marginal_tv double"


def fidelity_columns(figures: tuple) -> list:
    """Arrow columns of :func:`realised_figures`."""
    import numpy as np

    transition, absent, state, marginal = figures
    return [pa.array(transition), pa.array(absent.astype(np.int64)), pa.array(state, mask=np.isnan(state)), pa.array(marginal)]


def null_fidelity(events: DataFrame, nulls: DataFrame, *keys: str) -> DataFrame:
    """What :func:`divergence` says of each null realisation (session_id, the given keys, marks as an array, of as many
    marks as the session) against the session that it realises: one row a realisation, compared where the two meet."""
    own = events.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "mark"))).getField("mark").alias("own"))
    rows = nulls.select("session_id", *keys, "marks").join(own, "session_id").where(F.size("own") > 1)  # one mark has no transition

    def run(batches):
        import numpy as np

        for batch in batches:
            out = []
            for marks, held in zip(batch.column(len(keys) + 1).to_pylist(), batch.column(len(keys) + 2).to_pylist(), strict=True):
                code = {m: i for i, m in enumerate(dict.fromkeys([*held, *marks]))}
                out.append(realised_figures(*(np.array([[code[m] for m in x]]) if x is marks else np.array([code[m] for m in x]) for x in (held, marks))))
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], *fidelity_columns([np.concatenate(x) for x in zip(*out, strict=True)])], names=["session_id", *keys, "transition_tv", "absent", "max_state_tv", "marginal_tv"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in ("session_id", *keys)), FIDELITY]))


def null_identity(events: DataFrame, nulls: DataFrame, *within: str) -> DataFrame:
    """session_id, the given keys, realizations, how many repeat the session itself, how many differ from each other, and
    the identical share: by digests of the sequences."""
    digest = lambda marks: F.sha2(F.concat_ws("\x1f", marks), 256)
    own = events.groupBy("session_id").agg(digest(F.sort_array(F.collect_list(F.struct("pos", "mark"))).getField("mark")).alias("own"))
    rows = nulls.select("session_id", *within, digest(F.col("marks")).alias("digest")).join(own, "session_id")
    counted = rows.groupBy("session_id", *within).agg(F.count("*").alias("realizations"), F.count_if(F.col("digest") == F.col("own")).alias("identical"), F.count_distinct("digest").alias("distinct"))
    return counted.withColumn("identical_fraction", F.col("identical") / F.col("realizations"))


def adjacent_pairs(events: DataFrame) -> DataFrame:
    """(a, b): each session and the next one by id: every session, but few of the pairs."""
    sessions = events.select(F.col("session_id").alias("a")).distinct()
    return sessions.withColumn("b", F.lead("a").over(Window.orderBy("a"))).where("b is not null")  # one row a session


def all_pairs(events: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of a set of sessions that the caller has bounded (a corpus of at most 64)."""
    first = events.select("session_id").distinct()
    return first.select(F.col("session_id").alias("a")).join(first.select(F.col("session_id").alias("b")), F.col("a") < F.col("b"))


def corpus_pairs(events: DataFrame, admitted: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of the admitted sessions (at most 64), and each session with the next one by id."""
    return all_pairs(events.select("session_id").distinct().join(admitted, "session_id", "left_semi")).union(adjacent_pairs(events)).distinct()
