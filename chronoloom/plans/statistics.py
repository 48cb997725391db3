"""Registered null, calibration, Haar and matrix-profile queries and their SQL."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import lcg
from ..functions.controls import CONTROLS
from ..operators import nulls as N
from ..operators import profile as P
from ..operators import sequence as Q
from ..operators import signal as S
from .alignments import LADDER
from .sequences import _COUNTS, _DENSE, _PAIRS, _W, WIDTH, dense_sql, divergence_sql, eligible, events, pairs, rounded, signal_ledger

PROFILE_WIDTH = 12_000_000
PROFILE_LADDER = (2, 4, 8, 16, 32, 64, 128)  # the six lengths of the reference in buckets, and 4
REPLICATES, ADEQUACY = 999, 199
BUDGET = 459  # nulls of the assay, from its threshold of 1 %
DRAWS, SEARCHES = 4000, 400  # of the selection effect


def draws(s, d):
    """Ten draws from each of some seeds."""

    def run(batches):
        for batch in batches:
            out = []
            for seed in batch.column(0).to_pylist():
                g = lcg.Lcg(seed)
                out += [{"seed": seed, "n": n, "draw": g.below(1000)} for n in range(1, 11)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("seed", pa.int64()), ("n", pa.int32()), ("draw", pa.int64())]))

    return s.range(0, 200, 1, 4).withColumnRenamed("id", "seed").mapInArrow(run, "seed long, n int, draw long")


def _sequences(s, d):
    return N.arrays(events(s, d))


def _calibration(s, d):
    found = N.calibrated(N.arrays(events(s, d)), pairs(s, d), LADDER, REPLICATES)
    names = [c for c in found.columns if c == "observed" or c[0] == "q" or c in ("tail", "null_max", "expected_early_stop")]
    return rounded(found.withColumn("top_exceedances", F.concat_ws(",", F.col("top_exceedances").cast("array<string>"))), *names)


def _realised(s, d):
    """Five realisations of every session under the order and the first-order null."""
    made = [N.replicates(_sequences(s, d), kind, 5).select("session_id", F.lit(kind).alias("construction"), "replicate", "marks") for kind in ("order", "markov")]
    return made[0].unionByName(made[1])


def _fidelity(s, d):
    """Of the nulls of _realised, each compared where it is made."""
    return rounded(N.fidelity(_sequences(s, d), ("order", "markov"), 5), "transition_tv", "max_state_tv", "marginal_tv")


def _assay(s, d):
    """Every cell of the corpus at the fixed budget, in waves that leave refuted cells out."""
    return rounded(N.assay(N.arrays(events(s, d)), pairs(s, d), LADDER, BUDGET), "observed", "null_max", "expected_early_stop")


def _evidence(s, d):
    """The best pair of windows of each pair of sessions and span, against nulls of the same places."""
    out = N.best_evidence(N.arrays(events(s, d)), pairs(s, d), LADDER, REPLICATES)
    return rounded(out, "observed", "null_mean", "null_stddev", "null_min", "null_max", "empirical_p", "separation", "standardized_separation")


def _selection(s, d):
    """The selection effect as it was fixed: on the control without a figure, at a span of 8 events."""
    sides = CONTROLS["negative control"]
    rows = s.createDataFrame([*sides], "session_id string, marks array<string>, gaps array<bigint>")
    pair = s.createDataFrame([tuple(x[0] for x in sides)], "a string, b string")
    return rounded(N.selection_effect(N.searches(rows, pair, (8,), SEARCHES), N.arbitrary_scores(rows, pair, (8,), DRAWS)), "arbitrary_median", "arbitrary_q99", "selected_median", "margin")


def _haar(s, d):
    return P.haar(P.series(S.dense(signal_ledger(s, d), WIDTH)), WIDTH)


def _profile_series(s, d):
    """All dimensions that a session has."""
    return P.series(S.dense(signal_ledger(s, d), PROFILE_WIDTH))


def _profiles(rows, windows):
    return P.profiles(rows, windows).select("session_id", "dimension", "m", "start", F.round("distance", 5).alias("distance"), "masked")


QUERIES = {
    "n01_draws": draws,
    "n02_order_nulls": lambda s, d: N.replicates(_sequences(s, d), "order", 5).select("session_id", "replicate", F.concat_ws("|", "marks").alias("marks")),
    "n06_doublet_nulls": lambda s, d: N.replicates(_sequences(s, d), "doublet", 5).select("session_id", "replicate", F.concat_ws("|", "marks").alias("marks")),
    "n07_markov_nulls": lambda s, d: N.replicates(_sequences(s, d), "markov", 5).select("session_id", "replicate", F.concat_ws("|", "marks").alias("marks")),
    "n02_null_multisets": lambda s, d: N.replicates(_sequences(s, d), "order", 3).select("session_id", "replicate", F.explode("marks").alias("mark")).groupBy("session_id", "replicate", "mark").agg(F.count("*").alias("n")),
    "n06_null_transitions": lambda s, d: N.replicates(_sequences(s, d), "doublet", 2).select("session_id", "replicate", F.posexplode(F.zip_with(F.expr("slice(marks, 1, size(marks) - 1)"), F.expr("slice(marks, 2, size(marks) - 1)"), lambda x, y: F.concat(x, F.lit(">"), y)))).groupBy("session_id", "replicate", F.col("col").alias("step")).agg(F.count("*").alias("n")),
    "n08_calibration": _calibration,
    "n12_assay": _assay,
    "a25_null_fidelity": _fidelity,
    "n11_null_identity": lambda s, d: rounded(Q.null_identity(events(s, d), _realised(s, d), "construction"), "identical_fraction"),
    "n05_null_evidence": _evidence,
    "n09_selection_effect": _selection,
    "n10_structure_nulls": lambda s, d: rounded(N.structure_nulls(_sequences(s, d), ("order", "doublet", "markov"), ADEQUACY), "null_median", "null_min", "null_max", "observed"),
    "n11_corpus_coverage": lambda s, d: rounded(N.coverage_nulls(N.corpus_coverage(_sequences(s, d).join(eligible(s, d), "session_id", "left_semi"), (3, 4, 5, 6), REPLICATES)), "tail"),
    "q18_haar": lambda s, d: rounded(_haar(s, d).where("level is not null").select("session_id", "dimension", "level", "scale_ms", "coefficients", "energy", "remainder"), "energy", "remainder"),
    "q19_haar_spectrum": lambda s, d: rounded(P.spectrum(_haar(s, d)), "energy", "share", "impulse_share", "ratio"),
    "q20_haar_silence": lambda s, d: rounded(P.silence(_haar(s, d)), "input", "detail").withColumn("residual", F.round("residual", 6) + 0.0),
    "q21_matrix_profile": lambda s, d: _profiles(_profile_series(s, d).where("dimension in ('records', 'kind:v2:tool_requested')"), (8,)),
    "q21_all_profiles": lambda s, d: _profiles(_profile_series(s, d), PROFILE_LADDER),
    "q21_motifs_discords": lambda s, d: P.scans(_profile_series(s, d), PROFILE_LADDER),
}


# The product of two 64-bit numbers overflows a HUGEINT's sign, so the multiplier is applied in two halves.
_STATE = "(((x * 1481765933::HUGEINT % 18446744073709551616::HUGEINT) * 4294967296::HUGEINT + x * 1284865837::HUGEINT) % 18446744073709551616::HUGEINT + 1442695040888963407::HUGEINT) % 18446744073709551616::HUGEINT"
_HAAR = f"""{_DENSE}, xs AS (SELECT session_id, dimension, list(value ORDER BY bucket) AS x FROM dn GROUP BY ALL),
hr AS (SELECT session_id, dimension, 0 AS level, x, NULL::DOUBLE[] AS detail, NULL::DOUBLE AS remainder FROM xs
UNION ALL SELECT session_id, dimension, level + 1, [(x[2 * k - 1] + x[2 * k]) / sqrt(2) FOR k IN range(1, len(x) // 2 + 1)], [(x[2 * k - 1] - x[2 * k]) / sqrt(2) FOR k IN range(1, len(x) // 2 + 1)], CASE WHEN len(x) % 2 = 1 THEN x[len(x)] END FROM hr WHERE len(x) >= 2),
hl AS (SELECT session_id, dimension, level, ({WIDTH} * pow(2, level))::BIGINT AS scale_ms, len(detail)::INT AS coefficients, list_sum([v * v FOR v IN detail]) AS energy, remainder FROM hr WHERE level > 0)"""
_R = _W.replace("WITH ", "WITH RECURSIVE ", 1)
_EV = "ev AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY sequence) AS pos, 'v' || version || ':' || kind || coalesce('/' || tool_name, '') AS mark FROM ledger WHERE channel = 'observed')"

_SEEDS = ", ".join(f"({r}, {lcg.null_seed(r, 0) | 1}::HUGEINT)" for r in range(5))
_LISTS = f"{_EV}, sq AS (SELECT session_id, list(mark ORDER BY pos) AS m FROM ev GROUP BY session_id), sd(r, x) AS (VALUES {_SEEDS})"
_SHUFFLED = f"sf AS (SELECT session_id, r, len(m) - 1 AS i, x, m FROM sq, sd UNION ALL SELECT session_id, r, i - 1, x, [CASE q WHEN i + 1 THEN m[j] WHEN j THEN m[i + 1] ELSE m[q] END FOR q IN range(1, len(m) + 1)] FROM (SELECT *, (x // 8589934592 % (i + 1))::BIGINT + 1 AS j FROM (SELECT session_id, r, i, m, {_STATE} AS x FROM sf WHERE i > 0)))"
_WALKED = f"af AS (SELECT session_id, mark, list(next ORDER BY pos) AS l FROM (SELECT *, lead(mark) OVER (PARTITION BY session_id ORDER BY pos) AS next FROM ev) WHERE next IS NOT NULL GROUP BY ALL), wk AS (SELECT session_id, r, 1 AS n, x, m[1] AS c, m[1] AS o, m FROM sq, sd UNION ALL SELECT session_id, r, n + 1, x, nx, o || '|' || nx, m FROM (SELECT w.*, ch[(x // 8589934592 % len(ch))::BIGINT + 1] AS nx FROM (SELECT v.*, coalesce(l, m) AS ch FROM (SELECT session_id, r, n, c, o, m, {_STATE} AS x FROM wk WHERE n < len(m)) v LEFT JOIN af ON af.session_id = v.session_id AND af.mark = v.c) w))"

_MADE = re.sub(r"\bev\b", "e0", f"{_LISTS}, {_SHUFFLED}, {_WALKED}") + ", nl AS (SELECT session_id, 'order' AS construction, r, m FROM sf WHERE i = 0 UNION ALL SELECT session_id, 'markov', r, string_split(o, '|') FROM wk WHERE n = len(m))"
_BESIDE = "nd AS MATERIALIZED (SELECT *, session_id || '#' || construction || '#' || r AS id FROM nl), ev AS MATERIALIZED (SELECT session_id, pos, mark FROM e0 UNION ALL SELECT id, unnest(range(1, len(m) + 1)), unnest(m) FROM nd), nx AS (SELECT session_id AS a, id AS b FROM nd)"

ORACLE_SQL = {
    "a25_null_fidelity": f"{_R}, {_MADE}, {_BESIDE}, {_COUNTS}, {_PAIRS}, {divergence_sql('fd')} SELECT session_id, construction, r::INT AS replicate, transition_tv, absent, max_state_tv, marginal_tv FROM fd JOIN nd ON nd.id = fd.b",
    "n11_null_identity": f"{_R}, {_MADE}, ow AS (SELECT session_id, list(mark ORDER BY pos) AS own FROM e0 GROUP BY session_id) SELECT session_id, construction, count(*) AS realizations, count(*) FILTER (WHERE m = own) AS identical, count(DISTINCT m) AS distinct, round(count(*) FILTER (WHERE m = own) / count(*), 9) AS identical_fraction FROM nl JOIN ow USING (session_id) GROUP BY ALL",
    "n02_order_nulls": f"{_R}, {_LISTS}, {_SHUFFLED} SELECT session_id, r::INT AS replicate, array_to_string(m, '|') AS marks FROM sf WHERE i = 0",
    "n07_markov_nulls": f"{_R}, {_LISTS}, {_WALKED} SELECT session_id, r::INT AS replicate, o AS marks FROM wk WHERE n = len(m)",
    "n01_draws": f"WITH RECURSIVE g AS (SELECT seed, 0 AS n, (seed | 1)::HUGEINT AS x FROM (SELECT unnest(range(200)) AS seed) UNION ALL SELECT seed, n + 1, {_STATE} FROM g WHERE n < 10) SELECT seed, n, (x // 8589934592 % 1000)::BIGINT AS draw FROM g WHERE n > 0",
    "n02_null_multisets": f"{_W}, {_EV} SELECT session_id, r::INT AS replicate, mark, count(*) AS n FROM ev, (SELECT unnest(range(3)) AS r) GROUP BY ALL",
    "n06_null_transitions": f"{_W}, {_EV} SELECT session_id, r::INT AS replicate, step, count(*) AS n FROM (SELECT session_id, lag(mark) OVER (PARTITION BY session_id ORDER BY pos) || '>' || mark AS step FROM ev), (SELECT unnest(range(2)) AS r) WHERE step IS NOT NULL GROUP BY ALL",
    "q18_haar": f"{_R}, {_HAAR} SELECT session_id, dimension, level, scale_ms, coefficients, round(energy, 9) AS energy, round(remainder, 9) AS remainder FROM hl",
    "q19_haar_spectrum": f"{_R}, {_HAAR}, sh AS (SELECT *, CASE WHEN sum(energy) OVER w > 0 THEN energy / sum(energy) OVER w ELSE 0 END AS share, pow(2, -level) / sum(pow(2, -level)) OVER w AS impulse_share FROM hl WINDOW w AS (PARTITION BY session_id, dimension)) SELECT session_id, dimension, level, scale_ms, round(energy, 9) AS energy, round(share, 9) AS share, round(impulse_share, 9) AS impulse_share, round(share / impulse_share, 9) AS ratio FROM sh",
    "q20_haar_silence": f"{_R}, {_HAAR}, en AS (SELECT session_id, dimension, list_sum([v * v FOR v IN x]) AS input, list_min(x) = list_max(x) AS constant FROM xs), dt AS (SELECT session_id, dimension, sum(energy) AS detail, count(remainder) AS remainders FROM hl GROUP BY ALL) SELECT session_id, dimension, round(input, 9) AS input, round(coalesce(detail, 0), 9) AS detail, coalesce(remainders, 0) AS remainders, 0.0::DOUBLE AS residual, CASE WHEN coalesce(detail, 0) > 0 THEN NULL WHEN input = 0 THEN 'empty' WHEN constant THEN 'constant' ELSE 'only_in_remainders' END AS silence FROM en LEFT JOIN dt USING (session_id, dimension)",
    "q21_matrix_profile": f"""{_W}, {dense_sql(PROFILE_WIDTH)}, xs AS MATERIALIZED (SELECT session_id, dimension, bucket, value FROM dn WHERE dimension IN ('records', 'kind:v2:tool_requested')),
ws AS MATERIALIZED (SELECT * FROM (SELECT session_id, dimension, bucket AS start, sum(value) OVER w AS s, sum(value * value) OVER w AS q, min(value) OVER w = max(value) OVER w AS c, count(*) OVER w AS n FROM xs WINDOW w AS (PARTITION BY session_id, dimension ORDER BY bucket ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8),
dt AS (SELECT * FROM (SELECT a.session_id, a.dimension, a.bucket AS i, b.bucket AS j, sum(a.value * b.value) OVER w AS dot, count(*) OVER w AS n FROM xs a JOIN xs b ON a.session_id = b.session_id AND a.dimension = b.dimension AND b.bucket - a.bucket > 2 WINDOW w AS (PARTITION BY a.session_id, a.dimension, b.bucket - a.bucket ORDER BY a.bucket ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8),
ds AS (SELECT d.session_id, d.dimension, i, j, round(1e9 * CASE WHEN a.c AND b.c THEN 0 WHEN a.c OR b.c THEN 16 ELSE greatest(0, 16 * (1 - (8 * dot - a.s * b.s) / (sqrt(8 * a.q - a.s * a.s) * sqrt(8 * b.q - b.s * b.s)))) END)::BIGINT AS z FROM dt d JOIN ws a ON a.session_id = d.session_id AND a.dimension = d.dimension AND a.start = i JOIN ws b ON b.session_id = d.session_id AND b.dimension = d.dimension AND b.start = j),
bb AS (SELECT session_id, dimension, start, min(z * 65536 + other) AS x FROM (SELECT session_id, dimension, i AS start, j AS other, z FROM ds UNION ALL SELECT session_id, dimension, j, i, z FROM ds) GROUP BY ALL)
SELECT w.session_id, w.dimension, 8 AS m, w.start::INT AS start, round(sqrt(x // 65536 / 1e9), 5) AS distance, w.c OR coalesce(o.c, false) AS masked FROM ws w LEFT JOIN bb USING (session_id, dimension, start) LEFT JOIN ws o ON o.session_id = w.session_id AND o.dimension = w.dimension AND o.start = x % 65536""",
}
