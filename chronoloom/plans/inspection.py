"""Registered inspection queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocabulary import ANOMALIES, KINDS, OPENINGS, OUTCOMES, quoted
from ..operators import inspect as I
from ..sources.events import LEDGER_SQL, ledger


def csv(name: str):
    """An array of sequence numbers as text, so that both engines compare alike."""
    return F.concat_ws(",", F.col(name).cast("array<string>")).alias(name)


def _tool_groups(spark, sf_dir):
    lists = ("intents", "openings", "outcomes", "succeeded", "failed", "denied")
    return I.tool_groups(ledger(spark, sf_dir)).select("session_id", "version", "corr_id", "first_sequence", *map(csv, lists), F.concat_ws(",", "tool_names").alias("tool_names"), "classes", "shape", "opening", "outcome")


def _subagents(spark, sf_dir):
    return I.subagents(ledger(spark, sf_dir)).select("session_id", "subject_agent", "first_sequence", csv("started"), csv("stopped"), F.concat_ws(",", F.array_sort(F.transform("types", lambda x: F.coalesce(x, F.lit("(none)"))))).alias("types"), F.concat_ws(",", "parents").alias("parents"))


def _timestamps(spark, sf_dir):
    return I.timestamps(ledger(spark, sf_dir)).withColumn("back_receipts", csv("back_receipts"))


def _shuffled_clock(spark, sf_dir):
    """The same over an order that is not that of time: clocks go back here."""
    d = ledger(spark, sf_dir)
    from pyspark.sql import Window

    return I.timestamps(d.withColumn("sequence", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("sequence") % 7, "sequence")))).withColumn("back_receipts", csv("back_receipts"))


def _anomalies(spark, sf_dir):
    return I.anomalies(ledger(spark, sf_dir)).select("session_id", "kind", "id", csv("receipts"), "place")


def _search(spark, sf_dir):
    return I.search(ledger(spark, sf_dir), text="READ", channel=("observed", "reported"), agent_id=("unattributed", "a1"), anomalous=True).select("session_id", "sequence", "kind", "tool_name")


QUERIES = {
    "p03_ledger": lambda s, d: ledger(s, d).select("session_id", "sequence", "epoch_ns", "version", "kind", "channel", "adapter", "mechanism", "corr_id", "tool_name", "outcome", "agent_id", "agent_type", "subject_agent", "subject_type", "parent_agent", "prompt_id", "duration_ms", "interrupted", "command"),
    "a01_by_channel": lambda s, d: I.by_channel(ledger(s, d)),
    "a02_by_event_kind": lambda s, d: I.by_kind(ledger(s, d)),
    "a03_by_adapter": lambda s, d: I.by_value(ledger(s, d), "adapter"),
    "a04_by_mechanism": lambda s, d: I.by_value(ledger(s, d), "mechanism"),
    "a05_session_boundaries": lambda s, d: I.session_boundaries(ledger(s, d)),
    "a06_current_agents": lambda s, d: I.current_agents(ledger(s, d)),
    "a07_tool_groups": _tool_groups,
    "a08_group_shapes": lambda s, d: I.group_shapes(ledger(s, d)),
    "a12_subagents": _subagents,
    "a13_coverage": lambda s, d: I.coverage(ledger(s, d)),
    "a14_timestamps": _timestamps,
    "w01_clock_went_back": _shuffled_clock,
    "a15_anomalies": _anomalies,
    "j11_anomaly_index": lambda s, d: I.anomaly_index(ledger(s, d)),
    "f02_facet_search": _search,
}

_W = f"WITH {LEDGER_SQL}"
_KINDS_SQL = "(VALUES " + ", ".join(f"({v}, '{k}')" for v, kinds in KINDS.items() for k in kinds) + ")"
_LIST = "coalesce(array_to_string(list_sort(list(sequence) FILTER (WHERE {w})), ','), '')"
_CLASS = "CASE WHEN kind = 'tool_succeeded' OR outcome = 'succeeded' THEN 'succeeded' WHEN kind = 'tool_failed' OR outcome = 'failed' THEN 'failed' WHEN kind = 'tool_denied' THEN 'denied' END"
_GROUPS = f"""grouped AS (SELECT *, CASE WHEN o = 0 AND x = 0 THEN 'reported_intent_only' WHEN o > 1 OR x > 1 OR classes > 1 THEN 'ambiguous' WHEN x = 0 THEN 'opening_without_outcome' WHEN o = 0 THEN 'outcome_without_opening' ELSE 'paired_lifecycle' END AS shape
FROM (SELECT session_id, version, corr_id, min(sequence) AS first_sequence, count(*) FILTER (WHERE kind IN ({quoted(OPENINGS)})) AS o, count(*) FILTER (WHERE kind IN ({quoted(OUTCOMES)})) AS x, count(DISTINCT {_CLASS})::INT AS classes,
{_LIST.format(w="kind = 'reported_intent'")} AS intents, {_LIST.format(w=f"kind IN ({quoted(OPENINGS)})")} AS openings, {_LIST.format(w=f"kind IN ({quoted(OUTCOMES)})")} AS outcomes,
{_LIST.format(w=f"{_CLASS} = 'succeeded'")} AS succeeded, {_LIST.format(w=f"{_CLASS} = 'failed'")} AS failed, {_LIST.format(w=f"{_CLASS} = 'denied'")} AS denied,
coalesce(string_agg(DISTINCT tool_name, ',' ORDER BY tool_name), '') AS tool_names, min(sequence) FILTER (WHERE kind IN ({quoted(OPENINGS)})) AS first_o, min(sequence) FILTER (WHERE kind IN ({quoted(OUTCOMES)})) AS first_x, coalesce(array_to_string(list_sort(list(sequence) FILTER (WHERE tool_name IS NOT NULL)), ','), '') AS named, count(DISTINCT tool_name) AS names
FROM ledger WHERE corr_id IS NOT NULL GROUP BY ALL))"""
_TIMES = """SELECT session_id, min(epoch_ns) AS earliest_ns, arg_min(sequence, (epoch_ns, sequence)) AS earliest_sequence, max(epoch_ns) AS latest_ns, arg_max(sequence, (epoch_ns, -sequence)) AS latest_sequence, count(*) FILTER (WHERE back) AS non_monotonic, coalesce(array_to_string(list_sort(list(sequence) FILTER (WHERE back)), ','), '') AS back_receipts
FROM (SELECT session_id, sequence, epoch_ns, lag(epoch_ns) OVER (PARTITION BY session_id ORDER BY sequence) > epoch_ns AS back FROM {t}) GROUP BY session_id"""
_COVER = " UNION ALL ".join(
    f"SELECT session_id, '{f}' AS field, count(*) FILTER (WHERE {w}) AS population, count(*) FILTER (WHERE {w} AND {f} IS NOT NULL) AS present, count(*) FILTER (WHERE {w} AND {f} IS NULL) AS absent FROM ledger GROUP BY session_id"
    for f, w in {"duration_ms": "kind IN ('tool_succeeded', 'tool_failed')", "interrupted": "kind = 'tool_failed'", "parent_agent": "kind IN ('subagent_started', 'subagent_stopped')", "prompt_id": "version = 2"}.items()
)
_ANOMALIES = f"""{_GROUPS}, edges AS (SELECT session_id, {_LIST.format(w="kind = 'session_started'")} AS s, {_LIST.format(w="kind = 'session_ended'")} AS e, count(*) FILTER (WHERE kind = 'session_started') AS ns, count(*) FILTER (WHERE kind = 'session_ended') AS ne FROM ledger GROUP BY session_id),
agents AS (SELECT session_id, subject_agent, {_LIST.format(w="kind = 'subagent_started'")} AS started, {_LIST.format(w="kind = 'subagent_stopped'")} AS stopped FROM ledger WHERE subject_agent IS NOT NULL GROUP BY ALL),
typed AS (SELECT session_id, a, array_to_string(list_sort(list(sequence)), ',') AS r FROM (SELECT session_id, sequence, agent_id AS a, agent_type AS t FROM ledger UNION ALL SELECT session_id, sequence, subject_agent, subject_type FROM ledger) WHERE a IS NOT NULL AND t IS NOT NULL GROUP BY session_id, a HAVING count(DISTINCT t) > 1),
found AS (
SELECT session_id, 0 AS ordinal, NULL::VARCHAR AS id, '' AS receipts FROM edges WHERE ns = 0
UNION ALL SELECT session_id, 1, NULL, '' FROM edges WHERE ne = 0
UNION ALL SELECT session_id, 2, NULL, s FROM edges WHERE ns > 1
UNION ALL SELECT session_id, 3, NULL, e FROM edges WHERE ne > 1
UNION ALL SELECT session_id, 4, corr_id, openings FROM grouped WHERE o > 1
UNION ALL SELECT session_id, 5, corr_id, outcomes FROM grouped WHERE x > 1
UNION ALL SELECT session_id, 6, corr_id, outcomes FROM grouped WHERE classes > 1
UNION ALL SELECT session_id, 7, corr_id, openings FROM grouped WHERE x = 0 AND o > 0
UNION ALL SELECT session_id, 8, corr_id, outcomes FROM grouped WHERE o = 0 AND x > 0
UNION ALL SELECT session_id, 9, corr_id, intents FROM grouped WHERE o = 0 AND x = 0
UNION ALL SELECT session_id, 10, corr_id, named FROM grouped WHERE names > 1
UNION ALL SELECT session_id, 11, subject_agent, stopped FROM agents WHERE started = ''
UNION ALL SELECT session_id, 12, subject_agent, started FROM agents WHERE stopped = ''
UNION ALL SELECT session_id, 13, a, r FROM typed)"""
_NAMES = "[" + quoted(ANOMALIES) + "]"
_INDEX = f"indexed AS (SELECT session_id, sequence, string_agg(DISTINCT {_NAMES}[ordinal + 1], ',' ORDER BY {_NAMES}[ordinal + 1]) AS anomalies FROM (SELECT session_id, ordinal, unnest(string_split(receipts, ','))::BIGINT AS sequence FROM found WHERE receipts <> '') GROUP BY ALL)"

ORACLE_SQL = {
    "p03_ledger": f"{_W} SELECT session_id, sequence, epoch_ns, version, kind, channel, adapter, mechanism, corr_id, tool_name, outcome, agent_id, agent_type, subject_agent, subject_type, parent_agent, prompt_id, duration_ms, interrupted, command FROM ledger",
    "a01_by_channel": f"{_W} SELECT s.session_id, c.channel, count(l.sequence) AS records, coalesce(array_to_string(list_sort(list(l.sequence) FILTER (WHERE l.sequence IS NOT NULL)), ','), '') AS receipts FROM (SELECT DISTINCT session_id FROM ledger) s CROSS JOIN (VALUES ('reported'), ('observed'), ('recorder')) c(channel) LEFT JOIN ledger l ON l.session_id = s.session_id AND l.channel = c.channel GROUP BY ALL",
    "a02_by_event_kind": f"{_W} SELECT s.session_id, s.version, c.kind, count(l.sequence) AS records, coalesce(array_to_string(list_sort(list(l.sequence) FILTER (WHERE l.sequence IS NOT NULL)), ','), '') AS receipts FROM (SELECT DISTINCT session_id, version FROM ledger) s JOIN {_KINDS_SQL} c(version, kind) ON c.version = s.version LEFT JOIN ledger l ON l.session_id = s.session_id AND l.kind = c.kind GROUP BY ALL",
    **{f"a0{n}_by_{v}": f"{_W} SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_sequence) AS place FROM (SELECT session_id, {v}, count(*) AS records, min(sequence) AS first_sequence FROM ledger GROUP BY ALL)" for n, v in ((3, "adapter"), (4, "mechanism"))},
    "a05_session_boundaries": f"{_W} SELECT session_id, {_LIST.format(w="kind = 'session_started'")} AS session_started, {_LIST.format(w="kind = 'session_ended'")} AS session_ended FROM ledger GROUP BY session_id",
    "a06_current_agents": f"{_W} SELECT session_id, CASE WHEN version = 1 THEN 'not_representable' WHEN agent_id IS NULL THEN 'not_supplied' ELSE 'supplied' END AS attribution, agent_id, count(*) AS records, min(sequence) AS first_sequence FROM ledger GROUP BY ALL",
    "a07_tool_groups": f"{_W}, {_GROUPS} SELECT session_id, version, corr_id, first_sequence, intents, openings, outcomes, succeeded, failed, denied, tool_names, classes, shape, CASE WHEN shape = 'paired_lifecycle' THEN first_o END AS opening, CASE WHEN shape = 'paired_lifecycle' THEN first_x END AS outcome FROM grouped",
    "a08_group_shapes": f"{_W}, {_GROUPS} SELECT shape, count(*) AS groups FROM grouped GROUP BY shape",
    "a12_subagents": f"{_W} SELECT session_id, subject_agent, min(sequence) AS first_sequence, {_LIST.format(w="kind = 'subagent_started'")} AS started, {_LIST.format(w="kind = 'subagent_stopped'")} AS stopped, string_agg(DISTINCT coalesce(subject_type, '(none)'), ',' ORDER BY coalesce(subject_type, '(none)')) AS types, coalesce(string_agg(DISTINCT parent_agent, ',' ORDER BY parent_agent), '') AS parents FROM ledger WHERE subject_agent IS NOT NULL GROUP BY ALL",
    "a13_coverage": f"{_W} {_COVER}",
    "a14_timestamps": f"{_W} {_TIMES.format(t='ledger')}",
    "w01_clock_went_back": f"{_W}, o AS (SELECT session_id, epoch_ns, row_number() OVER (PARTITION BY session_id ORDER BY sequence % 7, sequence) AS sequence FROM ledger) {_TIMES.format(t='o')}",
    "a15_anomalies": f"{_W}, {_ANOMALIES} SELECT session_id, {_NAMES}[ordinal + 1] AS kind, id, receipts, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN receipts = '' THEN 9223372036854775807 ELSE string_split(receipts, ',')[1]::BIGINT END, ordinal, id ASC NULLS FIRST) AS place FROM found",
    "j11_anomaly_index": f"{_W}, {_ANOMALIES}, {_INDEX} SELECT session_id, sequence, kind, tool_name, anomalies FROM ledger JOIN indexed USING (session_id, sequence)",
    "f02_facet_search": f"{_W}, {_ANOMALIES}, {_INDEX} SELECT session_id, sequence, kind, tool_name FROM ledger WHERE channel IN ('observed', 'reported') AND (agent_id IS NULL OR agent_id = 'a1') AND lower(concat_ws(' ', session_id, channel, adapter, mechanism, kind, corr_id, tool_name, agent_id, subject_agent, prompt_id)) LIKE '%read%' AND (session_id, sequence) IN (SELECT session_id, sequence FROM indexed)",
}
