"""Registered alignment, ranking and scoring queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import nulls as N
from ..operators import sequence as Q
from .sequences import _COUNTS, _E, PAIRS_SQL, events, pairs, rounded, windows_sql

K, TOP = 4, 5
LADDER = (3, 4, 6, 8, 12)
SPANS = (3, 4, 5, 6)
FIGURES = ("event_norm", "timing_cost", "timing_norm", "total")


def _top(found, *within):
    return rounded(A.ranked(found, *within).where(F.col("rank") <= TOP), *FIGURES)


def top_pairs(s, d):
    return _top(A.own_pairs(N.arrays(events(s, d)), K, TOP), "session_id")


def top_varied_pairs(s, d):
    """Only windows of more than two different marks."""
    return _top(A.own_pairs(N.arrays(events(s, d)), K, TOP, varied=True), "session_id")


def neighbours(s, d):
    return _top(A.own_pairs(N.arrays(events(s, d)), K, TOP, start=0), "session_id")


def _cross(s, d, top=None):
    e = events(s, d)
    return e, A.cross_pairs(N.arrays(e), Q.adjacent_pairs(e), K, top)


def cross_pairs(s, d):
    return rounded(A.ranked(_cross(s, d, TOP)[1], "a", "b"), *FIGURES)


def _corpus(s, d, top=None, add=lambda found, k: found):
    """The cross search of each span of the corpus over all of its pairs."""
    a, p, out = N.arrays(events(s, d)), pairs(s, d), None
    for k in SPANS:
        own = add(A.cross_pairs(a, p, k, top).withColumn("k", F.lit(k)), k)
        out = own if out is None else out.unionByName(own)
    return out


def corpus_pairs(s, d):
    return rounded(A.ranked(_corpus(s, d, TOP), "k", "a", "b"), *FIGURES)


def _totals(s, d, k, p):
    return A.cross_totals(N.arrays(events(s, d)), p, k).withColumns({"total": F.round("total", 6), "best": F.round("best", 9)})


def cross_totals(s, d):
    """What the whole cross search sums to."""
    return _totals(s, d, K, Q.adjacent_pairs(events(s, d)))


def corpus_totals(s, d):
    p, out = pairs(s, d), None
    for k in SPANS:
        own = _totals(s, d, k, p).withColumn("k", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def _best(s, d, n=50):
    e, found = _cross(s, d, n)
    return A.with_counts(A.with_marks(found, Q.windows(e, K)), e)


def _corpus_best(s, d, n=50):
    e = events(s, d)
    return A.with_counts(_corpus(s, d, n, lambda found, k: A.with_marks(found, Q.windows(e, k))), e)


def scored(s, d):
    return rounded(A.score(_best(s, d)).select("a", "b", "a_start", "b_start", *A.scores()), *A.scores())


def corpus_scored(s, d):
    return rounded(A.score(_corpus_best(s, d)).select("k", "a", "b", "a_start", "b_start", *A.scores()), *A.scores())


def surprisals(s, d, n=50):
    return rounded(A.best_surprisals(N.arrays(events(s, d)), pairs(s, d), SPANS, n), "surprisal")


def complete_search(s, d):
    """Greedy selection of the ranking, then the largest pooled surprisal, for each span of the ladder."""
    found = N.searches(N.arrays(events(s, d)), pairs(s, d), LADDER, 0)
    return found.select("a", "b", "k", F.size("top").alias("kept"), F.round("t", 9).alias("t"), F.concat_ws(",", F.transform("top", lambda x: F.round(x, 9).cast("string"))).alias("top"))


def timing(s, d):
    """Timing terms of a grid of gaps."""
    grid = s.sql("SELECT cast(a AS double) AS a, cast(b AS double) AS b FROM (SELECT explode(sequence(0, 4000, 250)) AS a) CROSS JOIN (SELECT explode(sequence(0, 4000, 250)) AS b)")
    return rounded(grid.withColumn("timing", A.timing_term(F.col("a"), F.col("b"))), "timing")


def budgets(s, d):
    alpha = s.sql("SELECT explode(array(0.2D, 0.1D, 0.05D, 0.02D, 0.01D, 0.005D, 0.001D)) AS alpha")
    return alpha.withColumn("budget", F.ceil(F.log(1 / F.col("alpha")) / F.log(1 / (1 - F.col("alpha")))))


def frontier(s, d):
    """Pareto frontier of one session's neighbours: least total for each number of
    matches, kept where no pair with more matches costs as little; and its two picks."""
    from pyspark.sql import Window

    best = A.own_pairs(N.arrays(events(s, d)), K, start=0).groupBy("session_id", "matches").agg(F.min(F.struct("total", "b_start")).alias("x"))
    above = Window.partitionBy("session_id").orderBy(F.col("matches").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = best.withColumn("before", F.min("x.total").over(above)).where(F.col("before").isNull() | (F.col("x.total") < F.col("before")))
    picked = rows.groupBy("session_id").agg(F.count("*").alias("points"), F.max_by("x.b_start", F.when(F.col("x.total") <= 0.5, F.col("matches"))).alias("longest"), F.min_by("x.b_start", F.struct("x.total", -F.col("matches"))).alias("lowest"))
    return picked.select("session_id", "points", F.coalesce("longest", "lowest").alias("designated"), "lowest")


QUERIES = {
    "q02_top_pairs": top_pairs,
    "q02_top_varied_pairs": top_varied_pairs,
    "q03_neighbours": neighbours,
    "q04_cross_pairs": cross_pairs,
    "q04_cross_totals": cross_totals,
    "q04_corpus_pairs": corpus_pairs,
    "q04_corpus_totals": corpus_totals,
    "q09_scores": scored,
    "q09_corpus_scores": corpus_scored,
    "q11_surprisal": surprisals,
    "q12_complete_search": complete_search,
    "m01_timing_term": timing,
    "m04_null_budget": budgets,
    "k07_frontier": frontier,
}


def _duck(text: str) -> str:
    import re

    return re.sub(r"(?<![A-Za-z_])(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", r"\1::DOUBLE", text)


def dp_sql(source: str, keep: list[str], k: int, name: str = "al", l: int | None = None) -> str:
    """The unrolled programme as CTEs over source (with marks and gaps of both sides)."""
    cells = {f"{n}_{i}": f"{c}[{i}]" for n, c, m in (("a", "a_marks", k), ("b", "b_marks", l or k), ("x", "a_gaps", k), ("y", "b_gaps", l or k)) for i in range(1, m + 1)}
    out = [f"{name}0 AS MATERIALIZED (SELECT {', '.join(keep)}, {', '.join(f'{e} AS {n}' for n, e in cells.items())} FROM {source})"]
    every = A.layers(k, l)
    for i, layer in enumerate(every):
        out.append(f"{name}{i + 1} AS (SELECT *, {', '.join(f'{_duck(e)} AS {n}' for n, e in layer.items())} FROM {name}{i})")
    out.append(f"{name} AS MATERIALIZED (SELECT {', '.join(keep)}, {', '.join(f'{_duck(e)} AS {n}' for n, e in A.results(k, l).items())} FROM {name}{len(every)})")
    return ", ".join(out)


_KEEP = ["session_id", "a_start", "b_start", "a_marks", "b_marks"]
_FIG = "matches, substitutions, deletions, insertions, timed_pairs, event_cost, round(timing_cost, 9) AS timing_cost, round(event_norm, 9) AS event_norm, round(timing_norm, 9) AS timing_norm, round(total, 9) AS total"


def _self(where: str, k: int = K) -> str:
    return f"{_E}, {windows_sql(k)}, pr AS (SELECT x.session_id, x.start AS a_start, y.start AS b_start, x.marks AS a_marks, y.marks AS b_marks, x.gaps AS a_gaps, y.gaps AS b_gaps FROM wn x JOIN wn y ON x.session_id = y.session_id AND {where}), {dp_sql('pr', _KEEP, k)}"


def _ranked(within: str, keep: str) -> str:
    return f"SELECT {keep}, {_FIG}, rank FROM (SELECT *, row_number() OVER (PARTITION BY {within} ORDER BY total, a_start, b_start) AS rank FROM al) WHERE rank <= {TOP}"


_CROSS = f"{_E}, {PAIRS_SQL}, {windows_sql(K)}, pr AS (SELECT fp.a, fp.b, x.start AS a_start, y.start AS b_start, x.marks AS a_marks, y.marks AS b_marks, x.gaps AS a_gaps, y.gaps AS b_gaps FROM fp JOIN wn x ON x.session_id = a JOIN wn y ON y.session_id = b), {dp_sql('pr', ['a', 'b', 'a_start', 'b_start', 'a_marks', 'b_marks'], K)}"
_BEST50 = f"{_CROSS}, {_COUNTS}, tt AS (SELECT session_id, sum(n) AS total FROM mc GROUP BY ALL), bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY total, a_start, b_start) AS rank FROM al) WHERE rank <= 50), po AS (SELECT a, b, a_start, b_start, unnest(range(1, {K} + 1)) AS i, a_marks, b_marks FROM bs), pc AS (SELECT po.*, a_marks[i] AS m, a_marks[i] = b_marks[i] AS ag, list_position(a_marks, a_marks[i]) = i AS fo, coalesce(x.n, 1) AS na, coalesce(y.n, 1) AS nb, ta.total AS ta, tb.total AS tb FROM po JOIN tt ta ON ta.session_id = a JOIN tt tb ON tb.session_id = b LEFT JOIN mc x ON x.session_id = a AND x.mark = a_marks[i] LEFT JOIN mc y ON y.session_id = b AND y.mark = a_marks[i])"
_R1 = "coalesce(sum(-ln((na + nb)::DOUBLE / (ta + tb))) FILTER (WHERE ag), 0)"

ORACLE_SQL = {
    "q02_top_pairs": f"{_self(f'y.start >= x.start + {K}')} {_ranked('session_id', 'session_id, a_start, b_start')}",
    "q02_top_varied_pairs": f"{_self(f'y.start >= x.start + {K} AND len(list_distinct(x.marks)) > 2 AND len(list_distinct(y.marks)) > 2')} {_ranked('session_id', 'session_id, a_start, b_start')}",
    "q03_neighbours": f"{_self(f'x.start = 0 AND abs(y.start - x.start) >= {K}')} {_ranked('session_id', 'session_id, a_start, b_start')}",
    "q04_cross_pairs": f"{_CROSS} {_ranked('a, b', 'a, b, a_start, b_start')}",
    "q04_cross_totals": f"{_CROSS} SELECT a, b, count(*) AS pairs, round(sum(total), 6) AS total, round(min(total), 9) AS best, sum(matches)::BIGINT AS matches, sum(substitutions)::BIGINT AS substitutions, sum(deletions)::BIGINT AS deletions, sum(insertions)::BIGINT AS insertions, sum(timed_pairs)::BIGINT AS timed_pairs FROM al GROUP BY a, b",
    "q09_scores": f"{_BEST50} SELECT a, b, a_start, b_start, count(*) FILTER (WHERE ag)::DOUBLE AS agreements, round(count(*) FILTER (WHERE ag) / {K}, 9) AS agreement_rate, count(DISTINCT m) FILTER (WHERE ag)::DOUBLE AS distinct_agreements, round(count(DISTINCT m) FILTER (WHERE ag) / {K}, 9) AS distinct_agreement_rate, count(DISTINCT m)::DOUBLE AS span_distinct, count(*) FILTER (WHERE ag AND fo)::DOUBLE AS first_occurrence_agreements, (count(DISTINCT m) - {K})::DOUBLE AS negative_repeats, round(coalesce(sum(-ln(na::DOUBLE / ta)) FILTER (WHERE ag), 0), 9) AS rarity_of_agreements, round(coalesce(sum(-ln(na::DOUBLE / ta)) FILTER (WHERE ag AND fo), 0), 9) AS novel_rarity, round({_R1}, 9) AS r1_pooled_sum, round(CASE WHEN count(*) FILTER (WHERE ag) = 0 THEN 0 ELSE {_R1} / count(*) FILTER (WHERE ag) END, 9) AS r2_pooled_mean, round({_R1} / {K}, 9) AS r3_pooled_density FROM pc GROUP BY a, b, a_start, b_start",
    "m01_timing_term": "SELECT a::DOUBLE AS a, b::DOUBLE AS b, round(least(1.0, abs(ln((a + 100.0) / (b + 100.0))) / ln(4.0)), 9) AS timing FROM (SELECT unnest(range(0, 4001, 250)) AS a), (SELECT unnest(range(0, 4001, 250)) AS b)",
    "m04_null_budget": "SELECT alpha::DOUBLE AS alpha, ceil(ln(1 / alpha::DOUBLE) / ln(1 / (1 - alpha::DOUBLE)))::BIGINT AS budget FROM (SELECT unnest([0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.001]) AS alpha)",
    "k07_frontier": f"{_self(f'x.start = 0 AND abs(y.start - x.start) >= {K}')}, g AS (SELECT session_id, matches, min((total, b_start)) AS x FROM al GROUP BY ALL), h AS (SELECT session_id, matches, x[1] AS total, x[2] AS b_start, min(x[1]) OVER (PARTITION BY session_id ORDER BY matches DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g), f AS (SELECT * FROM h WHERE before IS NULL OR total < before) SELECT session_id, count(*) AS points, coalesce(arg_max(b_start, matches) FILTER (WHERE total <= 0.5), arg_min(b_start, (total, -matches))) AS designated, arg_min(b_start, (total, -matches)) AS lowest FROM f GROUP BY session_id",
}
