"""Registered signal and sequence queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import sequence as Q
from ..operators import signal as S
from ..sources.events import LEDGER_SQL, ledger

WIDTH = 60_000_000  # milliseconds; the events of a session span days
SCALES = tuple(x * 1_000 for x in S.SCALES_MS)


def signal_ledger(spark, sf_dir):
    """The ledger with the bytes of recorded responses (props, normalised, of successes)."""
    return ledger(spark, sf_dir).withColumn("response_bytes", F.when((F.col("kind") == "tool_succeeded") | ((F.col("version") == 1) & (F.col("kind") == "observed_tool_finished")), F.octet_length(F.replace("props", F.lit(" ")))))


def events(spark, sf_dir):
    return Q.project(ledger(spark, sf_dir))


def eligible(spark, sf_dir):
    """The sessions that eligibility admits to the corpus, 64 at most."""
    led = ledger(spark, sf_dir)
    return C.eligibility(C.actions(led), led).where("skipped is null").select("session_id")


def pairs(spark, sf_dir):
    """All pairs of the sessions that eligibility admits, and adjacent ones of all."""
    return Q.corpus_pairs(events(spark, sf_dir), eligible(spark, sf_dir))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def _windows(spark, sf_dir):
    w = Q.windows(events(spark, sf_dir), 4)
    return w.select("session_id", "start", F.concat_ws("|", "marks").alias("marks"), F.concat_ws(",", F.slice(F.col("gaps"), 2, 3).cast("array<string>")).alias("gaps"), Q.distinct_marks().alias("distinct_marks"), Q.degenerate().alias("degenerate"))


QUERIES = {
    "a16_signal_axis": lambda s, d: S.axis(ledger(s, d), WIDTH),
    "a16_signal_buckets": lambda s, d: S.dense(signal_ledger(s, d), WIDTH),
    "a18_signal_stats": lambda s, d: rounded(S.stats(signal_ledger(s, d), WIDTH), "mean", "stddev"),
    "a19_signal_zscores": lambda s, d: S.zscores(signal_ledger(s, d), WIDTH).withColumn("z", F.round("z", 6)),
    "a20_signal_scales": lambda s, d: S.scales(ledger(s, d), SCALES),
    "p10_event_sequence": lambda s, d: events(s, d),
    "w03_windows": _windows,
    "a21_marginals": lambda s, d: Q.marginals(events(s, d)),
    "a22_envelope": lambda s, d: rounded(Q.envelope(events(s, d)), *[f"d{k}" for k in range(11)]),
    "a23_approaches": lambda s, d: rounded(Q.approaches(events(s, d)), "boundary", "max_margin"),
    "a24_transitions": lambda s, d: Q.transitions(events(s, d)),
    "a25_divergence": lambda s, d: rounded(Q.divergence(events(s, d)), "transition_tv", "max_state_tv", "marginal_tv"),
    "a25_corpus_divergence": lambda s, d: rounded(Q.divergence(events(s, d), pairs(s, d)), "transition_tv", "max_state_tv", "marginal_tv"),
    "a29_structure": lambda s, d: rounded(Q.structure(events(s, d)), "immediate_repetition", "mean_run_length", "entropy_ratio"),
    "a27_repeated_grams": lambda s, d: Q.repeated_grams(events(s, d), 4),
    "a32_best_coverage": lambda s, d: Q.best_coverage(events(s, d)),
    "q16_longest_shared_run": lambda s, d: Q.longest_shared_run(e := events(s, d), Q.adjacent_pairs(e)),
    "q16_corpus_shared_run": lambda s, d: Q.longest_shared_run(events(s, d), pairs(s, d)),
}

_W = f"WITH {LEDGER_SQL}"
EVENTS_SQL = """ev AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY sequence) - 1 AS pos, sequence, mark, (epoch_ns - origin) // 1000000 AS offset_ms, greatest(step, 0) // 1000000 AS gap_ms, coalesce(step < 0, false) AS clamped
FROM (SELECT *, epoch_ns - lag(epoch_ns) OVER (PARTITION BY session_id ORDER BY sequence) AS step, 'v' || version || ':' || kind || coalesce('/' || tool_name, '') AS mark FROM (SELECT *, min(epoch_ns) OVER (PARTITION BY session_id) AS origin FROM ledger) WHERE channel = 'observed'))"""
_E = f"{_W}, {EVENTS_SQL}"
_BYTES = "CASE WHEN kind = 'tool_succeeded' OR (version = 1 AND kind = 'observed_tool_finished') THEN strlen(replace(props, ' ', '')) END"


def axis_sql(width: int) -> str:
    ns = width * 1_000_000
    return f"ax AS (SELECT session_id, min(epoch_ns) AS origin_ns, (max(epoch_ns) - min(epoch_ns)) // 1000000 AS span_ms, (max(epoch_ns) - min(epoch_ns)) // {ns} + 1 AS buckets, ((max(epoch_ns) - min(epoch_ns)) // 1000000) % {width} AS final_bucket_observed_ms FROM ledger GROUP BY session_id)"


def dense_sql(width: int) -> str:
    ns = width * 1_000_000
    return f"""{axis_sql(width)}, bk AS (SELECT l.*, (epoch_ns - origin_ns) // {ns} AS bucket FROM ledger l JOIN ax USING (session_id)),
sp AS (SELECT session_id, bucket, dimension, count(*)::DOUBLE AS value FROM (SELECT session_id, bucket, unnest(['records', 'channel:' || channel, 'kind:v' || version || ':' || kind, 'tool_name:' || tool_name]) AS dimension FROM bk) WHERE dimension IS NOT NULL GROUP BY ALL
UNION ALL SELECT session_id, bucket, 'distinct_correlation_ids', count(DISTINCT (version, corr_id)) FILTER (WHERE corr_id IS NOT NULL)::DOUBLE FROM bk GROUP BY ALL HAVING count(corr_id) > 0
UNION ALL SELECT session_id, bucket, 'recorded_response_json_bytes', sum({_BYTES})::DOUBLE FROM bk GROUP BY ALL HAVING sum({_BYTES}) > 0),
dn AS (SELECT g.session_id, g.dimension, g.bucket, coalesce(value, 0.0) AS value FROM (SELECT session_id, dimension, unnest(range(buckets)) AS bucket FROM (SELECT DISTINCT session_id, dimension FROM sp) JOIN ax USING (session_id)) g LEFT JOIN sp USING (session_id, dimension, bucket)),
st AS (SELECT session_id, dimension, sum(value) AS sum, avg(value) AS mean, stddev_pop(value) AS stddev, min(value) AS min, max(value) AS max, count(*) FILTER (WHERE value <> 0) AS nonzero_buckets, min(value) = max(value) AS constant FROM dn GROUP BY ALL)"""


_AXIS, _DENSE = axis_sql(WIDTH), dense_sql(WIDTH)


def windows_sql(k: int, name: str = "wn") -> str:
    return f"{name} AS (SELECT * FROM (SELECT session_id, pos AS start, list(mark) OVER w AS marks, list(gap_ms) OVER w AS gaps FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)) WHERE len(marks) = {k})"


_COUNTS = "mc AS (SELECT session_id, mark, count(*) AS n FROM ev GROUP BY ALL)"
_PAIRS = "tr AS (SELECT session_id, source, target, count(*) AS n FROM (SELECT session_id, lag(mark) OVER (PARTITION BY session_id ORDER BY pos) AS source, mark AS target FROM ev) WHERE source IS NOT NULL GROUP BY ALL)"
_QUANTILES = ", ".join(f"round(quantile_cont(n, {k / 10}), 9) AS d{k}" for k in range(11))
_SPANS = (3, 4, 6, 8, 12)
PAIRS_SQL = "fp AS (SELECT * FROM (SELECT session_id AS a, lead(session_id) OVER (ORDER BY session_id) AS b FROM (SELECT DISTINCT session_id FROM ev)) WHERE b IS NOT NULL)"


def _tv(source: str, keys: str, share: str) -> str:
    join = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    out = ", ".join(f"coalesce(x.{k}, y.{k}) AS {k}" for k in keys.split(", "))
    return f"(SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, {out}, coalesce(x.p, 0) AS pa, coalesce(y.p, 0) AS pb FROM (SELECT f.a, f.b, r.* FROM nx f JOIN (SELECT *, n / sum(n) OVER (PARTITION BY {share}) AS p FROM {source}) r ON r.session_id = f.a) x FULL JOIN (SELECT f.a, f.b, r.* FROM nx f JOIN (SELECT *, n / sum(n) OVER (PARTITION BY {share}) AS p FROM {source}) r ON r.session_id = f.b) y ON x.a = y.a AND x.b = y.b AND {join})"


def divergence_sql(name: str) -> str:
    """Divergence of the pairs nx (a, b) by their transitions tr and counts of marks mc."""
    return f"""t1 AS (SELECT a, b, round(0.5 * sum(abs(pa - pb)), 9) AS transition_tv, count(*) FILTER (WHERE pa > 0 AND pb = 0) AS absent FROM {_tv('tr', 'source, target', 'session_id')} GROUP BY ALL), t2 AS (SELECT a, b, round(max(tv), 9) AS max_state_tv FROM (SELECT a, b, source, 0.5 * sum(abs(pa - pb)) AS tv FROM {_tv('tr', 'source, target', 'session_id, source')} GROUP BY ALL HAVING sum(pa) > 0 AND sum(pb) > 0) GROUP BY ALL), t3 AS (SELECT a, b, round(0.5 * sum(abs(pa - pb)), 9) AS marginal_tv FROM {_tv('mc', 'mark', 'session_id')} GROUP BY ALL), {name} AS (SELECT * FROM t1 LEFT JOIN t2 USING (a, b) JOIN t3 USING (a, b))"""


ORACLE_SQL = {
    "a16_signal_axis": f"{_W}, {_AXIS} SELECT * FROM ax",
    "a16_signal_buckets": f"{_W}, {_DENSE} SELECT * FROM dn",
    "a18_signal_stats": f"{_W}, {_DENSE} SELECT session_id, dimension, sum, round(mean, 9) AS mean, round(stddev, 9) AS stddev, min, max, nonzero_buckets, constant FROM st",
    "a19_signal_zscores": f"{_W}, {_DENSE} SELECT session_id, dimension, bucket, round(CASE WHEN constant THEN 0 ELSE (value - mean) / stddev END, 6) AS z FROM dn JOIN st USING (session_id, dimension)",
    "a20_signal_scales": f"{_W}, o AS (SELECT session_id, epoch_ns - min(epoch_ns) OVER (PARTITION BY session_id) AS d FROM ledger), c AS (SELECT session_id, width_ms::INT AS width_ms, d // (width_ms * 1000000) AS bucket, count(*) AS n FROM o, (SELECT unnest([{', '.join(map(str, SCALES))}])::BIGINT AS width_ms) GROUP BY ALL) SELECT session_id, width_ms, sum(n)::BIGINT AS total, count(*) AS occupied, max(n) AS peak, max(bucket) + 1 AS buckets FROM c GROUP BY ALL",
    "p10_event_sequence": f"{_E} SELECT * FROM ev",
    "w03_windows": f"{_E}, {windows_sql(4)} SELECT session_id, start, array_to_string(marks, '|') AS marks, array_to_string(gaps[2:], ',') AS gaps, len(list_distinct(marks)) AS distinct_marks, len(list_distinct(marks)) <= 2 AS degenerate FROM wn",
    "a21_marginals": f"{_E}, {_COUNTS} SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, mark) AS rank FROM mc",
    "a22_envelope": f"{_E}, {_COUNTS} SELECT session_id, count(*) AS vocabulary, max(n) AS max_count, min(n) AS min_count, count(*) FILTER (WHERE n = 1) AS singletons, sum(n)::BIGINT AS events, {_QUANTILES} FROM mc GROUP BY session_id",
    "a23_approaches": f"{_E}, {_COUNTS}, b AS (SELECT session_id, n, k, pow((sum(n) OVER (PARTITION BY session_id, k))::DOUBLE, (k - 1) / k) AS boundary FROM mc, (SELECT unnest([{', '.join(map(str, _SPANS))}]) AS k)) SELECT session_id, k, round(max(boundary), 9) AS boundary, round(max(n / boundary), 9) AS max_margin, count(*) FILTER (WHERE n > boundary) AS marks_above FROM b GROUP BY ALL",
    "a24_transitions": f"{_E}, {_PAIRS} SELECT * FROM tr",
    "a25_divergence": f"{_E}, {_COUNTS}, {_PAIRS}, nx AS (SELECT * FROM (SELECT session_id AS a, lead(session_id) OVER (ORDER BY session_id) AS b FROM (SELECT DISTINCT session_id FROM ev)) WHERE b IS NOT NULL), {divergence_sql('fd')} SELECT * FROM fd",
    "a29_structure": f"{_E}, {_COUNTS}, {_PAIRS}, r AS (SELECT session_id, avg(same::INT) AS rep, count(*) / (1 + count(*) FILTER (WHERE NOT same)) AS run FROM (SELECT session_id, mark = lag(mark) OVER (PARTITION BY session_id ORDER BY pos) AS same FROM ev) GROUP BY ALL), h1 AS (SELECT session_id, sum(-p * ln(p)) AS h FROM (SELECT session_id, n / sum(n) OVER (PARTITION BY session_id) AS p FROM mc) GROUP BY ALL), h2 AS (SELECT session_id, sum(-p * ln(p)) AS h FROM (SELECT session_id, n / sum(n) OVER (PARTITION BY session_id) AS p FROM tr) GROUP BY ALL) SELECT session_id, round(rep, 9) AS immediate_repetition, round(run, 9) AS mean_run_length, round(CASE WHEN h1.h > 0 THEN h2.h / (2 * h1.h) END, 9) AS entropy_ratio FROM r JOIN h1 USING (session_id) JOIN h2 USING (session_id)",
    "a27_repeated_grams": f"{_E}, {windows_sql(4)}, g AS (SELECT session_id, marks, unnest(l) AS s FROM (SELECT session_id, marks, list(start) AS l FROM wn GROUP BY session_id, marks HAVING count(*) > 1)) SELECT session_id, count(DISTINCT marks) AS repeated_grams, count(DISTINCT p) AS positions FROM (SELECT session_id, marks, unnest(range(s, s + 4)) AS p FROM g) GROUP BY session_id",
    "a32_best_coverage": f"{_E}, {', '.join(windows_sql(k, f'w{k}') for k in _SPANS)} SELECT k, max(n) AS best_sessions, count(*) FILTER (WHERE n > 1) AS shared_grams, count(*) AS grams FROM ({' UNION ALL '.join(f'SELECT {k} AS k, marks, count(DISTINCT session_id) AS n FROM w{k} GROUP BY marks' for k in _SPANS)}) GROUP BY k",
    "q16_longest_shared_run": f"{_E}, {PAIRS_SQL}, m AS (SELECT a, b, x.pos AS i, x.pos - y.pos AS d, x.pos - row_number() OVER (PARTITION BY a, b, x.pos - y.pos ORDER BY x.pos) AS isl FROM fp JOIN ev x ON x.session_id = a JOIN ev y ON y.session_id = b AND y.mark = x.mark) SELECT a, b, coalesce(max(n), 0) AS longest FROM fp LEFT JOIN (SELECT a, b, d, isl, count(*) AS n FROM m GROUP BY ALL) USING (a, b) GROUP BY a, b",
}
