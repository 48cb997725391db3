"""Registered studies of alignment, scores and assays, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import controls as control_values
from ..functions.controls import CONTROLS
from ..operators import align as A
from ..operators import corpus as C
from ..operators import nulls as N
from ..operators import profile as P
from ..operators import sequence as Q
from ..operators import signal as S
from ..operators import studies as T
from ..session import checkpointed, dealt
from ..sources import recordings as R
from ..sources.events import LEDGER_SQL, ledger
from .alignments import _BEST50, K, _best, dp_sql
from .corpus import _ACTIONS, _FLOW, _families_sql, _workflow
from .sequences import ORACLE_SQL as _SEQUENCES
from .sequences import _DENSE, _E, EVENTS_SQL, PAIRS_SQL, WIDTH, events, pairs, rounded, signal_ledger
from .sources import files
from .statistics import _STATE, PROFILE_LADDER, PROFILE_WIDTH, REPLICATES

LADDER = T.SPANS
KEEP = 40
FIGURES = ("event_cost", "timing_cost", "event_norm", "timing_norm", "total")


def ladders(s, d):
    rows = s.range(0, 41).select(F.col("id").cast("int").alias("n"))
    return rows.select("n", F.explode(T.ladder(F.col("n")).cast("array<int>")).alias("k"))


def perturbations(s, d):
    """Each variant of the figure, aligned with it."""
    rows, out = T.perturbation_pairs(s), None
    for n in (7, 8, 9):
        own = A.align(rows.where(F.size("b_marks") == n), 8, n).drop("a_marks", "b_marks")
        out = own if out is None else out.unionByName(own)
    return rounded(out, *FIGURES)


def _seeds(s, d):
    """The best pair of windows of each session and the next one by id, as spans."""
    e = events(s, d)
    a = N.arrays(e)
    sizes = lambda side: a.select(F.col("session_id").alias(side), F.size("marks").alias(f"{side}_size"))
    best = A.cross_pairs(a, Q.adjacent_pairs(e), K, 1)
    spans = best.select("a", "b", F.col("a_start").alias("a_from"), (F.col("a_start") + K).alias("a_to"), F.col("b_start").alias("b_from"), (F.col("b_start") + K).alias("b_to"))
    return a, spans.join(sizes("a"), "a").join(sizes("b"), "b")


def boundary_moves(s, d):
    """How many moves of each seed's boundaries are valid, and how short and long they make it."""
    moved = A.boundary_moves(_seeds(s, d)[1])
    return moved.groupBy("a", "b").agg(F.count_if("valid").alias("evaluated"), F.count_if(~F.col("valid")).alias("rejected"), F.min(F.when(F.col("valid"), F.col("a_to") - F.col("a_from"))).alias("shortest"), F.max(F.when(F.col("valid"), F.col("b_to") - F.col("b_from"))).alias("longest"))


def refinement(s, d):
    a, seeds = _seeds(s, d)
    return rounded(A.refine(a, seeds.drop("a_size", "b_size")), "seed_total", "total")


def search_space(s, d):
    """Pairs of windows that the search considers, for every span of the ladder and pair of sessions."""
    n = events(s, d).groupBy("session_id").agg(F.count("*").alias("n"))
    side = lambda x: n.select(F.col("session_id").alias(x), F.col("n").alias(f"n{x}"))
    rows = Q.adjacent_pairs(events(s, d)).join(side("a"), "a").join(side("b"), "b").withColumn("k", F.explode(F.array(*map(F.lit, LADDER))))
    count = lambda x: F.greatest(F.col(f"n{x}") - F.col("k") + 1, F.lit(0))
    return rows.select("a", "b", "k", (count("a") * count("b")).alias("considered"))


def _kept(s, d):
    return N.retained_search(N.arrays(events(s, d)), pairs(s, d), LADDER, KEEP)


def retained(s, d):
    """Up to 40 pairs of windows that each search keeps, for every span of the ladder of the corpus."""
    return rounded(_kept(s, d), "event_norm", "timing_norm", "total")


def discovered(s, d):
    """Exact windows that searches keep: how many pairs of sessions find them, and their best R1."""
    e = events(s, d)
    marks = N.arrays(e).select(F.col("session_id").alias("a"), "marks")
    own = _kept(s, d).where("exact").join(marks, "a").withColumn("a_marks", F.slice("marks", F.col("a_start") + 1, F.col("k"))).drop("marks")
    own = A.score(A.with_counts(own.withColumn("b_marks", F.col("a_marks")), e), "r1_pooled_sum")
    out = own.groupBy("k", "a_marks").agg(F.count_distinct("a", "b").alias("discovered_by_pairs"), F.max("r1_pooled_sum").alias("best_r1"))
    return out.select("k", F.concat_ws("|", "a_marks").alias("marks"), "discovered_by_pairs", F.round("best_r1", 9).alias("best_r1"))


def _samples(s, d):
    best = A.ranked(_best(s, d), "a", "b")
    return T.asymmetry(best)


def asymmetry(s, d):
    return rounded(_samples(s, d).select("a", "b", "a_start", "b_start", "agreements", "forward", "backward", "delta"), "delta")


def patterns(s, d):
    return T.equality_pattern(_best(s, d)).select("a", "b", "a_start", "b_start", "within", "across", "tail_repeats_span")


def regions(s, d):
    """The first window of four events in each half of a session."""
    halves = events(s, d).groupBy("session_id").agg((F.max("offset_ms") + 1).alias("end")).withColumn("half", F.expr("end div 2"))
    both = halves.select("session_id", F.explode(F.array(F.struct(F.lit("first").alias("region"), F.lit(0).cast("long").alias("from_ms"), F.col("half").alias("to_ms")), F.struct(F.lit("second").alias("region"), F.col("half").alias("from_ms"), F.col("end").alias("to_ms")))).alias("r")).select("session_id", "r.*")
    return T.first_windows_within(events(s, d), both, K)


def receipts(s, d):
    """For each family of the raw sequences and each of its sessions the first three places, as spans of records."""
    return C.receipts(events(s, d)).select("k", F.concat_ws("|", "marks").alias("marks"), "session_id", "receipts")


def display(s, d):
    raw = events(s, d).select(F.lit("raw").alias("projection"), F.col("mark").alias("label"), T.display_name(F.col("mark"), "raw").alias("shown"))
    flow = _workflow(s, d).select(F.concat(F.lit("v2:tool_"), "outcome", F.lit("/"), "mark").alias("label"))
    return raw.unionByName(flow.select(F.lit("workflow").alias("projection"), "label", T.display_name(F.col("label"), "workflow").alias("shown"))).distinct()


def timing_nulls(s, d):
    """Gaps dealt anew: how often each session has each gap, and where its last event comes to stand."""
    rows = N.timing_nulls(N.arrays(events(s, d))).select("session_id", F.posexplode("gaps").alias("pos", "gap"), F.element_at("offsets", -1).alias("last_offset"))
    return rows.where("pos > 0").groupBy("session_id", "gap", "last_offset").agg(F.count("*").alias("n"))


def _runs():
    """Runs of the assay: the one as fixed, and others that each leave it in one way."""
    sure = {(x, k): t <= 0.001 for x, tails in T.GRID.items() for k, t in zip(T.SPANS, tails, strict=True)}
    cells = [("cell", x, k, ok, T.SEEDS, T.NULL_MODE) for (x, k), ok in sure.items()]
    controls = [("control", x, k, x[0] == "p", T.SEEDS, T.NULL_MODE) for x in T.CONTROLS for k in T.SPANS]
    put = lambda rows, at, value: [(*r[:at], value, *r[at + 1 :]) for r in rows]
    every = {
        "as fixed": controls + cells,
        "few certified": controls + [(*c[:3], c[3] and i % 3 == 0, *c[4:]) for i, c in enumerate(cells)],
        "one cell missing": controls + cells[:-1],
        "one cell twice": controls + cells + cells[:1],
        "another span": controls + put(cells[:1], 2, 16) + cells[1:],
        "other seeds": controls + put(cells[:2], 4, "null_seed(0..99, {0,1})") + cells[2:],
        "another null": put(controls, 5, "doublet") + cells,
        "no controls": cells,
        "failed control": controls,
        "another level": controls + cells,
        "another specimen": controls + cells,
    }
    specimens = {"another specimen": [*T.SPECIMENS[:3], "00000000"]}
    runs = [(name, 0.05 if name == "another level" else T.ALPHA, T.BUDGET, specimens.get(name, [*T.SPECIMENS]), name != "failed control") for name in every]
    return runs, [(name, *c) for name, rows in every.items() for c in rows]


def gate(s, d):
    runs, cells = _runs()
    return T.gate(s.createDataFrame(runs, "run string, alpha double, budget int, specimens array<string>, controls_passed boolean"), s.createDataFrame(cells, "run string, role string, specimen string, k int, certified boolean, seeds string, null_mode string"))


def grid_agreement(s, d):
    cells = s.createDataFrame([c[2:5] for c in _runs()[1] if c[0] == "few certified"], "specimen string, k int, certified boolean")
    return T.against_grid(cells)


def costs(s, d):
    """What a fixed-budget assay over each session and its next one would cost."""
    rows = search_space(s, d).select(F.concat_ws("|", "a").alias("run"), "considered", F.lit(T.BUDGET).alias("budget"))
    return T.costs(rows)


def profiled(s, d):
    return T.profiled_dimensions(S.stats(signal_ledger(s, d), WIDTH))


def linked(s, d):
    """The first motif that joins the two halves of a session, by both criteria."""
    ends = ledger(s, d).groupBy("session_id").agg(F.expr("(max(epoch_ns) - min(epoch_ns)) div 1000000 + 1").alias("end")).withColumn("half", F.expr("end div 2"))
    both = ends.select("session_id", F.lit("halves").alias("region"), F.lit(0).cast("long").alias("a_from"), F.col("half").alias("a_to"), F.col("half").alias("b_from"), F.col("end").alias("b_to"))
    series = P.series(S.dense(signal_ledger(s, d), PROFILE_WIDTH))
    return P.linked_regions(P.scans(series, PROFILE_LADDER), both, PROFILE_WIDTH)


def file_eligibility(s, d):
    """The sessions as files, some damaged, every tenth of them twice.

    Lines are parsed twice, for the replays and for the records of the sound files: a row a file is kept in between."""
    twice = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 10 == 0
    every = files(s, d).select(F.explode(F.when(twice, F.array("path", F.concat(F.lit("z-"), "path"))).otherwise(F.array("path"))).alias("path"), "content")
    replays = checkpointed(dealt(R.recordings(every).select("path", "status", "records", "session_id"), "path"))
    led = R.ledger(every, replays).withColumn("session_id", F.col("path"))
    rows = replays.select("path", "status", "records", F.lit(True).alias("has_time"), R.identity().alias("key"))
    return C.file_eligibility(rows, C.actions(led))


def _controls(s, *names):
    rows = [side for name in names for side in CONTROLS[name]]
    return s.createDataFrame(rows, "session_id string, marks array<string>, gaps array<bigint>")


def control_events(s, d, *names):
    both = _controls(s, *names)
    return both.select("session_id", F.posexplode(F.arrays_zip("marks", "gaps")).alias("pos", "e")).select("session_id", "pos", F.col("e.marks").alias("mark"), F.col("e.gaps").alias("gap_ms"))


def control_calibration(s, d):
    """Each pair of controls against its own nulls: order nulls of symbols drawn one by one, pair-keeping nulls of walks."""
    out = None
    for kind, construction in (("", "order"), ("first-order ", "doublet")):
        names = [f"{kind}negative control", f"{kind}positive control"]
        pairs = s.createDataFrame([tuple(x[0] for x in CONTROLS[n]) for n in names], "a string, b string")
        own = N.calibrated(_controls(s, *names), pairs, LADDER, REPLICATES, construction).select("a", "b", "k", "observed", "exceedances", "tail", "exceptional", "certified")
        out = own if out is None else out.unionByName(own)
    return rounded(out, "observed", "tail")


QUERIES = {
    "n15_controls": lambda s, d: control_events(s, d, "negative control", "positive control"),
    "n16_walk_controls": lambda s, d: control_events(s, d, "first-order negative control", "first-order positive control"),
    "n15_control_calibration": control_calibration,
    "q05_ladder": ladders,
    "q06_perturbation_sweep": perturbations,
    "q07_boundary_moves": boundary_moves,
    "q08_refinement": refinement,
    "q13_search_space": search_space,
    "q14_retained_search": retained,
    "a33_discovered_families": discovered,
    "q15_asymmetry": asymmetry,
    "a44_ordering_check": lambda s, d: T.ordering_check(_samples(s, d), "a", "b"),
    "a45_crossings": lambda s, d: T.crossings(_samples(s, d), "a", "b"),
    "q17_equality_patterns": patterns,
    "f04_first_windows": regions,
    "w09_receipts": receipts,
    "p16_display_names": display,
    "n03_timing_nulls": timing_nulls,
    "n13_assay_gate": gate,
    "j10_grid_agreement": grid_agreement,
    "a42_assay_costs": costs,
    "k11_profiled_dimensions": profiled,
    "f13_linked_regions": linked,
    "f09_file_eligibility": file_eligibility,
}


def _list(values) -> str:
    return "[" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in values) + "]"


def _perturbed_sql() -> str:
    a, parts, out = T.figure(), [], []
    for n in (7, 8, 9):
        rows = ", ".join(f"({name!r}, {_list(a[0])}, {_list(a[1])}::BIGINT[], {_list(b[0])}, {_list(b[1])}::BIGINT[])" for name, b in T.perturbations().items() if len(b[0]) == n)
        parts.append(f"s{n} AS (SELECT * FROM (VALUES {rows}) v(variant, a_marks, a_gaps, b_marks, b_gaps)), {dp_sql(f's{n}', ['variant'], 8, f'v{n}', n)}")
        out.append(f"SELECT variant, matches, substitutions, deletions, insertions, timed_pairs, {', '.join(f'round({c}, 9) AS {c}' for c in FIGURES)} FROM v{n}")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


_W = f"WITH {LEDGER_SQL}"
_ELIGIBLE = f"{_ACTIONS}, el AS (SELECT session_id FROM (SELECT session_id, row_number() OVER (ORDER BY session_id) AS r FROM ac GROUP BY session_id HAVING count(*) >= 12 AND count(DISTINCT category) >= 2) WHERE r <= 64)"


def _of_corpus(sql: str, name: str) -> str:
    """SQL over each session and the next one, put over all pairs of eligible sessions too."""
    head, rest = sql.split(f"{name} AS (SELECT * FROM (SELECT session_id AS a", 1)
    adjacent, rest = rest.split("WHERE b IS NOT NULL)", 1)
    return f"{head}{_ELIGIBLE}, f0 AS (SELECT * FROM (SELECT session_id AS a{adjacent}WHERE b IS NOT NULL), {name} AS (SELECT x.session_id AS a, y.session_id AS b FROM el x JOIN el y ON x.session_id < y.session_id UNION SELECT a, b FROM f0){rest}"


_NEXT = f"{_E}, {PAIRS_SQL}, sz AS (SELECT session_id, count(*) AS n FROM ev GROUP BY ALL)"
_SEED = f"{_BEST50}, sz AS (SELECT session_id, count(*) AS n FROM ev GROUP BY ALL), sd AS (SELECT al.a, al.b, a_start AS af, a_start + {K} AS au, b_start AS bf, b_start + {K} AS bu, x.n AS na, y.n AS nb FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY total, a_start, b_start) AS r FROM al) al JOIN sz x ON x.session_id = a JOIN sz y ON y.session_id = b WHERE r = 1)"
_MOVE = "(SELECT unnest(range(-3, 4)) AS {0})"
_SAMPLES = f"{_BEST50}, sm AS (SELECT a, b, a_start, b_start, count(*) FILTER (WHERE ag)::INT AS agreements, round(coalesce(sum(-ln(na::DOUBLE / ta)) FILTER (WHERE ag), 0), 9) AS forward, round(coalesce(sum(-ln(nb::DOUBLE / tb)) FILTER (WHERE ag), 0), 9) AS backward FROM pc GROUP BY ALL), rs AS (SELECT sm.*, rank FROM sm JOIN bs USING (a, b, a_start, b_start))"
_CANON = "list_position(['records', 'channel', 'kind', 'tool_name', 'distinct_correlation_ids', 'recorded_response_json_bytes'], string_split(dimension, ':')[1])"


def _gate_sql() -> str:
    runs, cells = _runs()
    lit = lambda v: "true" if v is True else "false" if v is False else _list(v) if isinstance(v, list) else repr(v)
    values = lambda rows: ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    keys = lambda pairs: _list(f"{s} k={k}" for s in pairs for k in T.SPANS)
    return f"""WITH r AS (SELECT * FROM (VALUES {values(runs)}) v(run, alpha, budget, specimens, passed)), c AS (SELECT *, specimen || ' k=' || k AS key FROM (VALUES {values(cells)}) v(run, role, specimen, k, ok, seeds, mode)),
x AS (SELECT run, alpha::DOUBLE AS alpha, budget, specimens, passed, (SELECT count(*) FROM c WHERE c.run = r.run AND seeds <> {T.SEEDS!r}) AS bad_seeds, (SELECT count(*) FROM c WHERE c.run = r.run AND mode <> {T.NULL_MODE!r}) AS bad_modes,
 (SELECT count(*) FROM (SELECT unnest({keys(T.CONTROLS)}) AS key EXCEPT SELECT key FROM c WHERE c.run = r.run AND role = 'control')) AS no_control,
 (SELECT count(*) FROM c WHERE c.run = r.run AND role = 'cell') AS n, (SELECT count(DISTINCT key) FROM c WHERE c.run = r.run AND role = 'cell') AS kinds,
 (SELECT count(*) FROM (SELECT unnest({keys(T.GRID)}) AS key EXCEPT SELECT key FROM c WHERE c.run = r.run AND role = 'cell')) AS missing, (SELECT count(*) FROM (SELECT key FROM c WHERE c.run = r.run AND role = 'cell' EXCEPT SELECT unnest({keys(T.GRID)}) AS key)) AS odd,
 (SELECT count(*) FROM c WHERE c.run = r.run AND role = 'cell' AND ok) AS certified FROM r),
y AS (SELECT *, [m FOR m IN [CASE WHEN alpha <> 0.01 THEN 'alpha' END, CASE WHEN budget <> 459 OR budget <> ceil(ln(1 / alpha) / ln(1 / (1 - alpha))) THEN 'budget' END, CASE WHEN bad_seeds > 0 THEN 'seeds' END, CASE WHEN bad_modes > 0 THEN 'null_mode' END, CASE WHEN no_control > 0 THEN 'controls' END] IF m IS NOT NULL] AS p,
 [m FOR m IN [CASE WHEN n > kinds THEN 'duplicate_cells' END, CASE WHEN missing > 0 OR odd > 0 THEN 'cell_set' END, CASE WHEN kinds <> 30 THEN 'cell_count' END, CASE WHEN odd > 0 THEN 'unmatched_cells' END, CASE WHEN list_sort(specimens) <> list_sort({_list(T.SPECIMENS)}) THEN 'specimens' END] IF m IS NOT NULL] AS g FROM x)
SELECT run, coalesce(array_to_string(p, ','), '') AS protocol, coalesce(array_to_string(g, ','), '') AS grid, certified, CASE WHEN len(p) > 0 THEN 'DIAGNOSTIC / UNCLASSIFIED' WHEN NOT passed THEN 'FALSIFICATION' WHEN len(g) > 0 THEN 'DIAGNOSTIC / UNCLASSIFIED' WHEN certified >= 15 THEN 'STRONG' ELSE 'WEAK / MIXED' END AS classification FROM y"""


def _grid_sql() -> str:
    cells = ", ".join(f"({c[2]!r}, {c[3]}, {'true' if c[4] else 'false'})" for c in _runs()[1] if c[0] == "few certified")
    old = ", ".join(f"({s!r}, {k}, {t})" for s, tails in T.GRID.items() for k, t in zip(T.SPANS, tails, strict=True))
    return f"SELECT c.specimen, c.k, certified, tail::DOUBLE AS tail, CASE WHEN tail IS NOT NULL THEN greatest(round(tail * 1000) - 1, 0)::INT END AS exceedances, tail <= 0.01 AS exceptional, round(tail * 1000) <= 1 AS old_certified, certified = (tail <= 0.01) AS agrees_tail, certified = (round(tail * 1000) <= 1) AS agrees_max FROM (VALUES {cells}) c(specimen, k, certified) LEFT JOIN (VALUES {old}) o(specimen, k, tail) USING (specimen, k)"


def _controls_sql() -> str:
    sums = [sum(control_values.WEIGHTS[: i + 1]) for i in range(12)]
    sides = ", ".join(f"({i}, {'ab'[i]!r}, {n}, {seed | 1}::HUGEINT)" for i, (n, seed) in enumerate(zip(control_values.LENGTHS, control_values.SEEDS, strict=True)))
    sites = ", ".join(f"({i}, {x})" for i, own in enumerate(control_values.SITES) for x in own)
    return f"""WITH RECURSIVE g AS (SELECT *, 0 AS n FROM (VALUES {sides}) v(side, name, len, x) UNION ALL SELECT side, name, len, {_STATE}, n + 1 FROM g WHERE n < 2 * len), w(sym, upto) AS (VALUES {', '.join(f'({i}, {x})' for i, x in enumerate(sums))}),
sy AS (SELECT side, name, n - 1 AS pos, min(sym) AS sym FROM g JOIN w ON x // 8589934592 % 100 < upto WHERE n BETWEEN 1 AND len GROUP BY ALL), gp AS (SELECT side, n - len - 1 AS pos, CASE WHEN n = len + 1 THEN -1 ELSE 500 + (x // 8589934592 % 4500)::BIGINT END AS gap FROM g WHERE n > len),
pl AS (SELECT side, site + i AS pos, fig[i + 1] AS sym FROM (VALUES {sites}) s(side, site), (SELECT {_list(control_values.FIGURE)} AS fig, unnest(range(12)) AS i)), ct AS (SELECT 'negative-' || name AS session_id, side, pos, sym FROM sy UNION ALL SELECT 'positive-' || name, sy.side, sy.pos, coalesce(pl.sym, sy.sym) FROM sy LEFT JOIN pl USING (side, pos))
SELECT session_id, pos::INT AS pos, format('v2:tool_requested/synthetic-{{:02d}}', sym) AS mark, gap AS gap_ms FROM ct JOIN gp USING (side, pos)"""


ORACLE_SQL = {
    "n15_controls": _controls_sql(),
    "a25_corpus_divergence": _of_corpus(_SEQUENCES["a25_divergence"], "nx"),
    "q16_corpus_shared_run": _of_corpus(_SEQUENCES["q16_longest_shared_run"], "fp"),
    "q05_ladder": "SELECT DISTINCT n::INT AS n, k::INT AS k FROM (SELECT n, unnest(list_append(range(greatest(n - 2, 0), n + 3), 3)) AS k FROM range(41) t(n)) WHERE k >= 3",
    "q06_perturbation_sweep": _perturbed_sql(),
    "q07_boundary_moves": f"{_SEED}, mv AS (SELECT a, b, af + p >= 0 AND bf + u >= 0 AND au + q <= na AND bu + v <= nb AND (au + q) - (af + p) >= 3 AND (bu + v) - (bf + u) >= 3 AS ok, (au + q) - (af + p) AS la, (bu + v) - (bf + u) AS lb FROM sd, {_MOVE.format('p')}, {_MOVE.format('q')}, {_MOVE.format('u')}, {_MOVE.format('v')}) SELECT a, b, count(*) FILTER (WHERE ok) AS evaluated, count(*) FILTER (WHERE NOT ok) AS rejected, min(la) FILTER (WHERE ok) AS shortest, max(lb) FILTER (WHERE ok) AS longest FROM mv GROUP BY a, b",
    "q13_search_space": f"{_NEXT} SELECT a, b, k::INT AS k, greatest(x.n - k + 1, 0) * greatest(y.n - k + 1, 0) AS considered FROM fp JOIN sz x ON x.session_id = a JOIN sz y ON y.session_id = b, (SELECT unnest({_list(LADDER)}) AS k)",
    "q15_asymmetry": f"{_SAMPLES} SELECT a, b, a_start, b_start, agreements, forward, backward, round(abs(forward - backward), 9) AS delta FROM rs",
    "a44_ordering_check": f"{_SAMPLES}, pk AS (SELECT a, b, count(*) AS candidates, max((forward, rank))[2] AS forward_pick, max((backward, rank))[2] AS backward_pick FROM rs GROUP BY a, b HAVING count(*) > 1), iv AS (SELECT l.a, l.b, count(*) AS comparisons, count(*) FILTER (WHERE sign(l.forward - r.forward) <> sign(l.backward - r.backward)) AS inversions FROM rs l JOIN rs r ON l.a = r.a AND l.b = r.b AND l.rank < r.rank GROUP BY ALL) SELECT a, b, candidates, forward_pick, backward_pick, comparisons, inversions, forward_pick <> backward_pick AS pick_changed FROM pk JOIN iv USING (a, b)",
    "a45_crossings": f"{_SAMPLES} SELECT l.a, l.b, count(*) AS crossings, round(max(l.forward - r.forward), 9) AS widest FROM rs l JOIN rs r ON l.a = r.a AND l.b = r.b AND l.agreements < r.agreements AND l.forward > r.forward GROUP BY ALL",
    "q17_equality_patterns": f"{_BEST50} SELECT a, b, a_start, b_start, array_to_string([array_to_string([CASE WHEN x = y THEN '1' ELSE '0' END FOR y IN a_marks], '') FOR x IN a_marks], '|') AS within, array_to_string([CASE WHEN a_marks[i] = b_marks[i] THEN '1' ELSE '0' END FOR i IN range(1, {K} + 1)], '') AS across, list_contains(a_marks[1:{K - 1}], a_marks[{K}]) AS tail_repeats_span FROM bs",
    "f04_first_windows": f"{_E}, hv AS (SELECT session_id, (max(offset_ms) + 1) AS e FROM ev GROUP BY ALL), rg AS (SELECT session_id, 'first' AS region, 0 AS f, e // 2 AS t FROM hv UNION ALL SELECT session_id, 'second', e // 2, e FROM hv), pl AS (SELECT session_id, pos, offset_ms AS o, lead(offset_ms, {K - 1}) OVER (PARTITION BY session_id ORDER BY pos) AS l FROM ev) SELECT rg.session_id, region, min(pos) AS start FROM rg LEFT JOIN pl ON pl.session_id = rg.session_id AND o >= f AND l < t GROUP BY ALL",
    "w09_receipts": f"{_W.replace('WITH ', 'WITH RECURSIVE ', 1)}, {EVENTS_SQL}, {_families_sql('ev')} SELECT r.k::INT AS k, array_to_string(r.marks, '|') AS marks, r.session_id, string_agg(x.sequence || '-' || y.sequence, ',' ORDER BY n) AS receipts FROM fmr r JOIN fm USING (k, marks) JOIN ev x ON x.session_id = r.session_id AND x.pos = r.s JOIN ev y ON y.session_id = r.session_id AND y.pos = r.s + r.k - 1 WHERE n <= 3 GROUP BY r.k, r.marks, r.session_id",
    "p16_display_names": f"{_W}, {EVENTS_SQL}, {_FLOW} SELECT DISTINCT 'raw' AS projection, mark AS label, replace(substr(mark, position(':' IN mark) + 1), '/', ' ') AS shown FROM ev UNION SELECT 'workflow', 'v2:tool_' || outcome || '/' || mark, mark FROM wf",
    "n03_timing_nulls": f"{_E} SELECT session_id, gap_ms AS gap, (sum(sum(gap_ms)) OVER (PARTITION BY session_id))::BIGINT AS last_offset, count(*) AS n FROM ev WHERE pos > 0 GROUP BY session_id, gap_ms",
    "n13_assay_gate": _gate_sql(),
    "j10_grid_agreement": _grid_sql(),
    "a42_assay_costs": f"{_NEXT}, sp AS (SELECT a, greatest(x.n - k + 1, 0) * greatest(y.n - k + 1, 0) AS c FROM fp JOIN sz x ON x.session_id = a JOIN sz y ON y.session_id = b, (SELECT unnest({_list(LADDER)}) AS k)) SELECT a AS run, (459 * count(*))::BIGINT AS null_searches, (918 * count(*))::BIGINT AS null_datasets, (459 * sum(c))::BIGINT AS evaluations, (999 * count(*))::BIGINT AS reference_searches, (540 * count(*))::BIGINT AS avoided, round(999 / 459, 9) AS ratio FROM sp GROUP BY a",
    "k11_profiled_dimensions": f"{_W}, {_DENSE} SELECT session_id, dimension, nonzero_buckets AS occupied, row_number() OVER w AS rank, row_number() OVER w <= 8 AS profiled FROM st WHERE nonzero_buckets > 0 WINDOW w AS (PARTITION BY session_id ORDER BY nonzero_buckets DESC, {_CANON}, dimension)",
}
