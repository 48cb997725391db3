"""Registered corpus queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import nulls as N
from ..operators import sequence as Q
from ..sources.events import LEDGER_SQL, ledger
from .inspection import _GROUPS
from .sequences import EVENTS_SQL
from .statistics import REPLICATES


def _actions(s, d):
    return C.actions(ledger(s, d))


def _workflow(s, d):
    led = ledger(s, d)
    return C.workflow(C.actions(led), led)


def _shown(df):
    return df.withColumn("marks", F.concat_ws("|", "marks")).drop("session_set")


def _families(s, d):
    return _shown(C.families(_workflow(s, d)))


def _ranked(s, d):
    found = C.ranked(C.families(_workflow(s, d)), "workflow")
    out = C.folded(C.subsumed(found))
    return _shown(C.strength(out, F.lit(100)).withColumn("name", C.name(F.col("marks"))))


def judged(flow, eligible):
    """Ranked families of a corpus of so many sessions, with their strength against nulls of it."""
    found = C.folded(C.subsumed(C.ranked(C.families(flow), "workflow")))
    nulls = N.corpus_coverage(N.arrays(flow), C.LADDER, REPLICATES)
    return C.strength(found, F.lit(eligible), C.exceptional_from(nulls)).withColumn("name", C.name(F.col("marks")))


def _corpus_families(s, d):
    led = ledger(s, d)
    acts = C.actions(led)
    kept = C.eligibility(acts, led).where("skipped is null").select("session_id")
    return _shown(judged(C.workflow(acts.join(kept, "session_id", "left_semi"), led), kept.count()))


def _raw(s, d):
    found = C.families(Q.project(ledger(s, d)))
    return _shown(found.withColumns({"alternates": C.alternates(F.col("marks")), "single_tool": C.single_tool(F.col("marks"))}))


def _comparison(s, d):
    w = _workflow(s, d)
    a = C.families(w.where(F.length("session_id") % 2 == 0))
    b = C.families(w.where(F.length("session_id") % 2 == 1))
    return C.compare(a, b).withColumn("marks", F.concat_ws("|", "marks"))


def _widths(s, d):
    """Shortest prefix (8, then 4 more each) that tells all padded ids apart."""
    ids = ledger(s, d).select(F.lpad(F.md5("session_id"), 32, "0").alias("i")).distinct()
    tried = ids.select(F.explode(F.array(*[F.lit(w) for w in range(8, 33, 4)])).alias("w"), "i")
    return tried.groupBy("w").agg((F.count_distinct(F.expr("left(i, w)")) == F.count("*")).alias("ok")).where("ok").agg(F.min("w").alias("width"))


QUERIES = {
    "p11_actions": _actions,
    "p15_workflow": _workflow,
    "f07_shell_categories": lambda s, d: ledger(s, d).where("command is not null").groupBy(C.shell_category(F.col("command")).alias("category")).agg(F.count("*").alias("n")),
    "f09_eligibility": lambda s, d: C.eligibility(_actions(s, d), ledger(s, d)),
    "a38_session_facts": lambda s, d: C.session_facts(_actions(s, d)),
    "a33_families": _families,
    "a35_ranked_families": _ranked,
    "a35_corpus_families": _corpus_families,
    "f10_raw_families": _raw,
    "j09_comparison": _comparison,
    "p19_identity_width": _widths,
}

_W = f"WITH {LEDGER_SQL}"
_IN = lambda c, xs: f"{c} IN ({', '.join(repr(x) for x in xs)})"
_PROG = lambda t: f"lower(regexp_extract(trim({t}, '\"'''), '[^/]*$'))"
_STARTS = lambda c: f"regexp_matches({c}, '^({'|'.join(C.SCRIPT_VERIFY)})')"
_SHELL = f"""CASE WHEN {_IN('pg', C.VERIFY_PROGRAMS)} OR (pg = 'cargo' AND {_IN('t1', C.CARGO_VERIFY)}) OR ({_IN('pg', ('npm', 'pnpm', 'yarn', 'bun'))} AND (t1 = 'test' OR (t1 = 'run' AND {_STARTS('t2')}))) OR (pg = 'npx' AND {_IN('t1', C.NPX_VERIFY)}) OR ({_IN('pg', ('node', 'deno'))} AND t1 = '--test') OR (pg = 'make' AND {_STARTS('t1')}) THEN 'verify'
WHEN {_IN('pg', C.VCS_PROGRAMS)} THEN 'version-control' WHEN {_IN('pg', C.INSPECT_PROGRAMS)} THEN 'inspect' ELSE 'shell' END"""
_TOKENS = f"tk AS (SELECT *, {_PROG('tok[j + 1]')} AS pg, coalesce(lower(tok[j + 2]), '') AS t1, coalesce(lower(tok[j + 3]), '') AS t2 FROM (SELECT *, CASE WHEN {_PROG('tok[1]')} = 'cd' THEN coalesce(list_position(tok, '&&'), 0) ELSE 0 END AS j FROM (SELECT *, string_split(trim(regexp_replace(command, '\\s+', ' ', 'g')), ' ')[1:16] AS tok FROM {{src}})))"
_CATEGORY = "CASE WHEN tool = 'Bash' THEN CASE WHEN command IS NULL THEN 'shell' ELSE " + _SHELL + " END " + " ".join(f"WHEN {_IN('tool', t)} THEN '{n}'" for n, t in C.TOOLS.items()) + " ELSE 'other' END"
_ACTIONS = f"""{_GROUPS}, nm AS (SELECT session_id, version, corr_id, arg_min(tool_name, sequence) FILTER (WHERE tool_name IS NOT NULL) AS tool, arg_min(command, sequence) FILTER (WHERE command IS NOT NULL AND version = 2) AS command, max(sequence) AS last_sequence FROM ledger WHERE corr_id IS NOT NULL GROUP BY ALL),
ac0 AS (SELECT g.session_id, g.version, g.corr_id, first_sequence, CASE WHEN classes > 1 THEN 'disagreeing' WHEN succeeded <> '' THEN 'succeeded' WHEN failed <> '' THEN 'failed' WHEN denied <> '' THEN 'denied' ELSE 'no-outcome-observed' END AS outcome, tool, command, last_sequence FROM grouped g JOIN nm USING (session_id, version, corr_id) WHERE shape <> 'reported_intent_only'), {_TOKENS.format(src='ac0')},
ac AS (SELECT session_id, version, corr_id, first_sequence, outcome, tool, last_sequence, category, category || CASE WHEN outcome = 'succeeded' THEN '' ELSE '!' || outcome END AS mark, row_number() OVER (PARTITION BY session_id ORDER BY first_sequence) - 1 AS pos FROM (SELECT *, {_CATEGORY} AS category FROM tk))"""
_FLOW = f"{_ACTIONS}, wf AS (SELECT session_id, pos, first_sequence, last_sequence, mark, category, outcome, tool, greatest(epoch_ns - lag(epoch_ns) OVER (PARTITION BY session_id ORDER BY pos), 0) // 1000000 AS gap_ms FROM ac JOIN (SELECT session_id, sequence AS first_sequence, epoch_ns FROM ledger) USING (session_id, first_sequence))"


def _families_sql(source: str, name: str = "fm", where: str = "true") -> str:
    each = " UNION ALL ".join(f"SELECT * FROM (SELECT {k} AS k, session_id, pos AS start, list(mark) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS marks FROM {source} WHERE {where}) WHERE len(marks) = {k}" for k in C.LADDER)
    # The greedy pass: from each start, the next one at least k further on.
    return f"""{name}w AS MATERIALIZED ({each}), {name}g AS (SELECT k, marks, session_id, list(start ORDER BY start) AS starts FROM {name}w GROUP BY ALL),
{name}r AS (SELECT k, marks, session_id, starts, starts[1] AS s, 1 AS n FROM {name}g UNION ALL SELECT k, marks, session_id, starts, list_min([x FOR x IN starts IF x >= s + k]), n + 1 FROM {name}r WHERE len([x FOR x IN starts IF x >= s + k]) > 0),
{name}n AS (SELECT k, marks, session_id, max(n) AS n FROM {name}r GROUP BY ALL),
{name} AS MATERIALIZED (SELECT k, marks, count(*) AS sessions, sum(n)::BIGINT AS occurrences, list(session_id ORDER BY session_id) AS session_set, len(list_distinct(marks))::INT AS distinct_marks, len(list_distinct(marks)) <= 2 AS low_diversity, list_max([len([y FOR y IN marks IF y = x]) FOR x IN marks]) * 3 >= k * 2 AS mark_dominance FROM {name}n GROUP BY ALL HAVING count(*) >= 2)"""


_SHOW = "k, array_to_string(marks, '|') AS marks, sessions, occurrences, distinct_marks, low_diversity, mark_dominance"
_R = _W.replace("WITH ", "WITH RECURSIVE ", 1)
_RANKED = f"""{_FLOW}, {_families_sql('wf')}, rk AS (SELECT *, row_number() OVER (ORDER BY sessions DESC, occurrences DESC, k DESC, marks) AS rank FROM fm), ri AS (SELECT *, format('workflow-{{:03d}}', rank) AS id FROM rk),
sb AS (SELECT a.id, arg_min(b.id, b.rank) AS subsumed_by FROM ri a JOIN ri b ON a.session_set = b.session_set AND b.k > a.k AND list_contains([b.marks[i : i + a.k - 1] FOR i IN range(1, b.k - a.k + 2)], a.marks) GROUP BY a.id),
rs AS (SELECT ri.*, subsumed_by, list_sort(list_distinct(marks)) AS ky, subsumed_by IS NULL AND NOT low_diversity AND NOT mark_dominance AS op FROM ri LEFT JOIN sb USING (id)),
hd AS (SELECT ky, min(rank) FILTER (WHERE op) AS head, count(*) FILTER (WHERE op) - 1 AS variants FROM rs GROUP BY ky)"""

ORACLE_SQL = {
    "p11_actions": f"{_W}, {_ACTIONS} SELECT * FROM ac",
    "p15_workflow": f"{_W}, {_FLOW} SELECT * FROM wf",
    "f07_shell_categories": f"{_W}, {_TOKENS.format(src='(SELECT command FROM ledger WHERE command IS NOT NULL)')} SELECT {_SHELL} AS category, count(*) AS n FROM tk GROUP BY 1",
    "f09_eligibility": f"{_W}, {_ACTIONS}, e AS (SELECT l.session_id, records, coalesce(actions, 0) AS actions, coalesce(categories, 0) AS categories FROM (SELECT session_id, count(*) AS records FROM ledger GROUP BY 1) l LEFT JOIN (SELECT session_id, count(*) AS actions, count(DISTINCT category) AS categories FROM ac GROUP BY 1) a USING (session_id)), y AS (SELECT *, CASE WHEN records = 0 THEN 'no_complete_records' WHEN actions < 12 THEN 'too_few_actions' WHEN categories < 2 THEN 'vocabulary_too_small' END AS why FROM e) SELECT session_id, records, actions, categories, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY why IS NULL ORDER BY session_id) > 64 THEN 'corpus_full' END) AS skipped FROM y",
    "a38_session_facts": f"{_W}, {_ACTIONS}, tt AS (SELECT session_id, arg_min(tool, (-n, tool)) AS top_tool FROM (SELECT session_id, tool, count(*) AS n FROM ac GROUP BY ALL) GROUP BY 1) SELECT session_id, count(*) AS actions, {', '.join(f'count(*) FILTER (WHERE category = {c!r}) AS c_{c.replace("-", "_")}' for c in C.CATEGORIES)}, {', '.join(f'count(*) FILTER (WHERE outcome = {o!r}) AS o_{o.replace("-", "_")}' for o in C.OUTCOMES)}, any_value(top_tool) AS top_tool FROM ac JOIN tt USING (session_id) GROUP BY session_id",
    "a33_families": f"{_R}, {_FLOW}, {_families_sql('wf')} SELECT {_SHOW} FROM fm",
    "a35_ranked_families": f"{_R}, {_RANKED}, nr AS (SELECT id, list({{'s': s, 'n': n}} ORDER BY g) AS runs FROM (SELECT id, g, any_value(m) AS s, count(*) AS n FROM (SELECT id, i, m, sum(c) OVER (PARTITION BY id ORDER BY i) AS g FROM (SELECT id, i, m, CASE WHEN m = lag(m) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS c FROM (SELECT id, unnest(marks) AS m, unnest(range(k)) AS i FROM ri))) GROUP BY id, g) GROUP BY id) SELECT id, {_SHOW}, rank::INT AS rank, subsumed_by, CASE WHEN rank = head THEN variants ELSE 0 END AS variants, CASE WHEN head IS NOT NULL AND rank <> head THEN format('workflow-{{:03d}}', head) END AS variant_of, CASE WHEN low_diversity OR mark_dominance THEN 'probably_recorder_grammar' WHEN sessions * 2 >= 100 THEN 'descriptively_common' ELSE 'weak_lead' END AS strength, array_to_string([r.s || CASE WHEN r.n > 1 THEN '×' || r.n ELSE '' END FOR r IN runs], '–') || CASE WHEN len(runs) > 2 AND runs[1].s = runs[len(runs)].s THEN ' loop' ELSE '' END AS name FROM rs JOIN hd USING (ky) JOIN nr USING (id)",
    "f10_raw_families": f"{_R}, {EVENTS_SQL}, {_families_sql('ev')} SELECT {_SHOW}, len([i FOR i IN range(1, k) IF NOT ((regexp_matches(marks[i], 'tool_requested|observed_tool_started') AND regexp_matches(marks[i + 1], 'tool_succeeded|tool_failed|tool_denied|observed_tool_finished')) OR (regexp_matches(marks[i + 1], 'tool_requested|observed_tool_started') AND regexp_matches(marks[i], 'tool_succeeded|tool_failed|tool_denied|observed_tool_finished')))]) = 0 AS alternates, contains(marks[1], '/') AND len(list_distinct([regexp_replace(m, '^[^/]*', '') FOR m IN marks])) = 1 AS single_tool FROM fm",
    "j09_comparison": f"{_R}, {_FLOW}, {_families_sql('wf', 'fa', 'length(session_id) % 2 = 0')}, {_families_sql('wf', 'fb', 'length(session_id) % 2 = 1')} SELECT array_to_string(coalesce(fa.marks, fb.marks), '|') AS marks, fa.sessions AS before, fb.sessions AS after, CASE WHEN fa.sessions IS NULL THEN 'gained' WHEN fb.sessions IS NULL THEN 'lost' WHEN fb.sessions > fa.sessions THEN 'strengthened' WHEN fb.sessions < fa.sessions THEN 'weakened' ELSE 'unchanged' END AS change FROM fa FULL JOIN fb ON fa.marks = fb.marks",
    "p19_identity_width": f"{_W} SELECT min(w)::INT AS width FROM (SELECT w, count(DISTINCT left(i, w)) = count(*) AS ok FROM (SELECT DISTINCT md5(session_id) AS i FROM ledger), (SELECT unnest([8, 12, 16, 20, 24, 28, 32]) AS w) GROUP BY w) WHERE ok",
}
