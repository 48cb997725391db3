"""Studies of the alignment and its scores: perturbed figures, asymmetry, orderings,
crossings, equality patterns, regions, and the gate of a fixed-budget assay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .align import score, scores

# ------------------------------------------------------------ perturbations of one figure

# The figure of four calls (tools in order, offsets of requests and successes in
# milliseconds), and the gaps of the sequence that has nothing to do with it.
TOOLS = ("SyntheticReader", "SyntheticSearcher", "SyntheticEditor", "SyntheticShell")
OFFSETS = (100, 300, 600, 900, 1200, 1500, 1800, 2200)
UNRELATED_GAPS = (120, 5880)
JITTERS = (0.10, 0.30, 1.00, 3.00)


def figure() -> tuple[list[str], list[int]]:
    """Marks and gaps of the unperturbed figure (its first gap is -1: none)."""
    marks = [f"v2:{kind}/{tool}" for tool in TOOLS for kind in ("tool_requested", "tool_succeeded")]
    return marks, [-1, *(b - a for a, b in zip(OFFSETS, OFFSETS[1:], strict=False))]


def perturbations() -> dict[str, tuple[list[str], list[int]]]:
    """The figure and what it is made into, one deviation each."""
    marks, gaps = figure()
    out = {"exact": (marks, gaps)}
    for part in JITTERS:  # every gap, longer and shorter in turn
        moved = [g if g < 0 else int(max(0.0, g * (1 + (part if i % 2 == 0 else -part))) + 0.5) for i, g in enumerate(gaps)]
        out[f"{part:.0%} timing jitter"] = (marks, moved)
    out["one inserted event"] = ([*marks[:2], marks[0], *marks[2:]], [*gaps[:2], 300, *gaps[2:]])
    out["one omitted event"] = ([*marks[:3], *marks[4:]], [*gaps[:3], gaps[4] + gaps[3], *gaps[5:]])
    out["one substituted identity"] = ([*marks[:-1], marks[-1].replace("succeeded", "failed")], gaps)
    out["unrelated sequence"] = ([marks[i % 2] for i in range(8)], [-1, *(UNRELATED_GAPS[i % 2 == 0] for i in range(1, 8))])
    return out


def perturbation_pairs(spark: SparkSession) -> DataFrame:
    """variant, the figure (a) and the variant (b)."""
    a = figure()
    return spark.createDataFrame([(name, *a, *b) for name, b in perturbations().items()], "variant string, a_marks array<string>, a_gaps array<bigint>, b_marks array<string>, b_gaps array<bigint>")


def ladder(n: Column) -> Column:
    """Spans to try for a figure of n events: 3, and those up to two away from n."""
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(3)), F.sequence(F.greatest(n - 2, F.lit(0)), n + 2)), lambda k: k >= 3)))


# ------------------------------------------------------------ properties of scores


def asymmetry(candidates: DataFrame, name: str = "rarity_of_agreements") -> DataFrame:
    """Adds agreements, and a score with both orders of the sides: forward, backward, delta."""
    swapped = candidates
    for column in ("marks", "counts", "total"):
        swapped = swapped.withColumnsRenamed({f"a_{column}": "_held", f"b_{column}": f"a_{column}"}).withColumnRenamed("_held", f"b_{column}")
    keys = ["a", "b", "a_start", "b_start"]
    forward = score(candidates, "agreements", name).select(*keys, "rank", F.col("agreements").cast("int").alias("agreements"), F.round(name, 9).alias("forward"))
    backward = swapped.select(*keys, F.round(scores()[name], 9).alias("backward"))
    return forward.join(backward, keys).withColumn("delta", F.abs(F.col("forward") - F.col("backward")))


def _pairs_of(samples: DataFrame, *within: str) -> DataFrame:
    side = lambda s: samples.select(*within, *[F.col(c).alias(f"{s}_{c}") for c in ("rank", "agreements", "forward", "backward")])
    return side("l").join(side("r"), list(within))


def ordering_check(samples: DataFrame, *within: str) -> DataFrame:
    """Per candidate set: what each order of the sides picks (the last on ties), and
    how many pairs of candidates the two orders rank differently."""
    picks = samples.groupBy(*within).agg(F.count("*").alias("candidates"), F.max(F.struct("forward", "rank"))["rank"].alias("forward_pick"), F.max(F.struct("backward", "rank"))["rank"].alias("backward_pick")).where("candidates > 1")
    rows = _pairs_of(samples, *within).where("l_rank < r_rank")
    differs = F.signum(F.col("l_forward") - F.col("r_forward")) != F.signum(F.col("l_backward") - F.col("r_backward"))
    counts = rows.groupBy(*within).agg(F.count("*").alias("comparisons"), F.count_if(differs).alias("inversions"))
    return picks.join(counts, list(within)).withColumn("pick_changed", F.col("forward_pick") != F.col("backward_pick"))


def crossings(samples: DataFrame, *within: str) -> DataFrame:
    """Per candidate set: pairs in which fewer agreements score higher, and the widest margin."""
    rows = _pairs_of(samples, *within).where("l_agreements < r_agreements and l_forward > r_forward")
    return rows.groupBy(*within).agg(F.count("*").alias("crossings"), F.round(F.max(F.col("l_forward") - F.col("r_forward")), 9).alias("widest"))


def equality_pattern(pairs: DataFrame) -> DataFrame:
    """Adds what of two spans survives relabelling: which places of the first are
    equal (row by row), where the two agree, and whether its last mark stands earlier."""
    a, b = F.col("a_marks"), F.col("b_marks")
    bit = lambda same: F.when(same, "1").otherwise("0")
    within = F.array_join(F.transform(a, lambda x: F.array_join(F.transform(a, lambda y: bit(x == y)), "")), "|")
    across = F.array_join(F.zip_with(a, b, lambda x, y: bit(x == y)), "")
    tail = F.array_contains(F.slice(a, 1, F.size(a) - 1), F.element_at(a, -1))
    return pairs.withColumns({"within": within, "across": across, "tail_repeats_span": tail})


# ------------------------------------------------------------ places


def first_windows_within(events: DataFrame, regions: DataFrame, k: int) -> DataFrame:
    """The first window of k events of a session that lies in each of its half-open
    regions (session_id, region, from_ms, to_ms); null where none does."""
    last = F.lead("offset_ms", k - 1).over(Window.partitionBy("session_id").orderBy("pos"))
    placed = events.select("session_id", F.col("pos").alias("start"), F.col("offset_ms").alias("start_ms"), last.alias("last_ms")).where("last_ms is not null")
    inside = (F.col("start_ms") >= F.col("from_ms")) & (F.col("last_ms") < F.col("to_ms"))
    return regions.join(placed, "session_id", "left").groupBy("session_id", "region").agg(F.min(F.when(inside, F.col("start"))).alias("start"))


def profiled_dimensions(stats: DataFrame, most: int = 8) -> DataFrame:
    """The dimensions of a session that are worth a profile: those that are not empty,
    fullest first, then in the order of families and labels; the first ``most`` are profiled."""
    family = F.array_position(F.array(*map(F.lit, ("records", "channel", "kind", "tool_name", "distinct_correlation_ids", "recorded_response_json_bytes"))), F.substring_index("dimension", ":", 1))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("nonzero_buckets").desc(), family, "dimension"))
    rows = stats.where("nonzero_buckets > 0").withColumn("rank", place)
    return rows.select("session_id", "dimension", F.col("nonzero_buckets").alias("occupied"), "rank", (F.col("rank") <= most).alias("profiled"))


def display_name(label: Column, projection: str) -> Column:
    """A mark for readers: raw ones without their version, workflow ones by category alone."""
    cut = ":" if projection == "raw" else "/"
    rest = F.substring(label, F.locate(cut, label) + 1, F.length(label))
    return F.when(F.locate(cut, label) == 0, label).otherwise(F.replace(rest, F.lit("/"), F.lit(" ")) if projection == "raw" else rest)


# ------------------------------------------------------------ the gate of a fixed-budget assay

# Fixed values of the assay: level, budget, null construction, spans, specimens, controls, and the
# number of certified cells that a strong result needs.
ALPHA, BUDGET, REFERENCE_REPLICATES, STRONG = 0.01, 459, 999, 15
NULL_MODE, SEEDS = "order-permutation (order_null_seeded)", "null_seed(0..459, {0,1})"
SPANS = (3, 4, 6, 8, 12)
SPECIMENS = ("8b68dece", "57f18ff9", "f5c18299", "7d95c414")
CONTROLS = ("negative control", "positive control")
# Published tails of each pair of specimens, by span.
GRID = {
    "8b68dece x 57f18ff9": (0.157, 0.004, 0.005, 0.004, 0.007),
    "8b68dece x f5c18299": (0.004, 0.003, 0.015, 0.002, 0.075),
    "8b68dece x 7d95c414": (0.133, 0.031, 0.027, 0.003, 0.002),
    "57f18ff9 x f5c18299": (0.035, 0.001, 0.001, 0.001, 0.001),
    "57f18ff9 x 7d95c414": (0.002, 0.001, 0.001, 0.001, 0.001),
    "f5c18299 x 7d95c414": (0.001, 0.001, 0.001, 0.001, 0.001),
}


def published_grid(spark: SparkSession) -> DataFrame:
    """specimen, k, tail, exceedances, exceptional and certified of the published cells."""
    rows = spark.createDataFrame([(s, k, t) for s, tails in GRID.items() for k, t in zip(SPANS, tails, strict=True)], "specimen string, k int, tail double")
    over = F.greatest(F.round(F.col("tail") * (REFERENCE_REPLICATES + 1)).cast("int") - 1, F.lit(0))
    return rows.withColumn("exceedances", over).withColumns({"exceptional": F.col("tail") <= ALPHA, "certified": F.col("exceedances") == 0})


def against_grid(cells: DataFrame) -> DataFrame:
    """Cells (specimen, k, certified, ...) with what was published for them, and whether it agrees."""
    old = published_grid(cells.sparkSession).withColumnsRenamed({"certified": "old_certified"})
    rows = cells.join(F.broadcast(old), ["specimen", "k"], "left")  # 30 rows
    return rows.withColumns({"agrees_tail": F.col("certified") == F.col("exceptional"), "agrees_max": F.col("certified") == F.col("old_certified")})


def gate(runs: DataFrame, cells: DataFrame) -> DataFrame:
    """Whether each run is the assay as it was fixed, and what its result is called.

    runs: run, alpha, budget, specimens (array), controls_passed; cells: run, role
    (control or cell), specimen, k, certified, seeds, null_mode.  Conditions are
    compared as sets, never by counts alone; the protocol comes first, then the
    controls, then the grid, then the number of certified cells."""
    key = F.concat("specimen", F.lit(" k="), F.col("k").cast("string"))
    names = lambda pairs: F.array(*[F.lit(f"{s} k={k}") for s in pairs for k in SPANS])
    is_cell = F.col("role") == "cell"
    seen = cells.withColumn("key", key).groupBy("run").agg(
        F.array_sort(F.collect_set(F.when(F.col("seeds") != SEEDS, F.col("seeds")))).alias("seeds"),
        F.array_sort(F.collect_set(F.when(F.col("null_mode") != NULL_MODE, F.col("null_mode")))).alias("modes"),
        F.collect_set(F.when(~is_cell, F.col("key"))).alias("controls"),
        F.collect_set(F.when(is_cell, F.col("key"))).alias("keys"),
        F.count_if(is_cell).alias("n_cells"),
        F.count_if(is_cell & F.col("certified")).alias("certified"),
    )
    rows = runs.join(seen, "run", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("seeds", "modes", "controls", "keys")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_cells", "certified")})
    held = lambda pairs: lambda have: (F.size(F.array_except(names(pairs), have)) > 0) | (F.size(F.array_except(have, names(pairs))) > 0)
    derived = F.ceil(F.log(1 / F.col("alpha")) / F.log(1 / (1 - F.col("alpha"))))
    expected = F.array(*map(F.lit, SPECIMENS))
    protocol = {
        "alpha": F.col("alpha") != ALPHA,
        "budget": (F.col("budget") != BUDGET) | (F.col("budget") != derived),
        "seeds": F.size("seeds") > 0,
        "null_mode": F.size("modes") > 0,
        "controls": F.size(F.array_except(names(CONTROLS), F.col("controls"))) > 0,
    }
    grid = {
        "duplicate_cells": F.col("n_cells") > F.size("keys"),
        "cell_set": held(GRID)(F.col("keys")),
        "cell_count": F.size("keys") != len(GRID) * len(SPANS),
        "unmatched_cells": F.size(F.array_except(F.col("keys"), names(GRID))) > 0,
        "specimens": (F.size(F.array_except(expected, F.col("specimens"))) > 0) | (F.size(F.array_except(F.col("specimens"), expected)) > 0) | (F.size("specimens") != len(SPECIMENS)),
    }
    listed = lambda conditions: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    rows = rows.withColumns({"protocol": listed(protocol), "grid": listed(grid)})
    called = F.when(F.size("protocol") > 0, "DIAGNOSTIC / UNCLASSIFIED").when(~F.col("controls_passed"), "FALSIFICATION").when(F.size("grid") > 0, "DIAGNOSTIC / UNCLASSIFIED").when(F.col("certified") >= STRONG, "STRONG").otherwise("WEAK / MIXED")
    return rows.select("run", F.array_join("protocol", ",").alias("protocol"), F.array_join("grid", ",").alias("grid"), "certified", called.alias("classification"))


def costs(cells: DataFrame) -> DataFrame:
    """Null searches and pairs of windows that each run's cells cost, against the same coverage at 999 replicates."""
    rows = cells.groupBy("run").agg(F.sum("budget").alias("null_searches"), F.sum(2 * F.col("budget")).alias("null_datasets"), F.sum(F.round(F.col("considered") * F.col("budget"))).cast("long").alias("evaluations"), (F.count("*") * REFERENCE_REPLICATES).alias("reference_searches"))
    return rows.withColumns({"avoided": F.greatest(F.col("reference_searches") - F.col("null_searches"), F.lit(0)), "ratio": F.when(F.col("null_searches") > 0, F.round(F.col("reference_searches") / F.col("null_searches"), 9))})
