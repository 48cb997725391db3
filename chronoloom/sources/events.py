"""The events table read as recordings: one session per user, ordered by time.

Column expressions are SQL that Spark and DuckDB read alike, so that every query
over the ledger has an independent oracle over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_COMMANDS = "CASE k % 8 WHEN 0 THEN 'cargo test --all' WHEN 1 THEN 'git status' WHEN 2 THEN 'ls -la' WHEN 3 THEN 'cd web && npm run lint' WHEN 4 THEN '/usr/bin/rg foo | wc' WHEN 5 THEN 'python build.py' WHEN 6 THEN '\"make\" check' ELSE 'npx vitest' END"
_V2 = "CASE WHEN e % 89 = 0 THEN 'session_started' WHEN e % 89 = 1 THEN 'session_ended' WHEN e % 89 = 2 THEN 'subagent_started' WHEN e % 89 = 3 THEN 'subagent_stopped' WHEN t = 'signup' THEN 'reported_intent' WHEN t = 'view' THEN 'tool_requested' WHEN t = 'purchase' THEN 'tool_succeeded' WHEN t = 'error' THEN 'tool_failed' ELSE 'tool_denied' END"
_V1 = "CASE WHEN e % 89 = 0 THEN 'session_started' WHEN e % 89 = 1 THEN 'session_ended' WHEN t = 'signup' THEN 'reported_intent' WHEN t IN ('view', 'click') THEN 'observed_tool_started' ELSE 'observed_tool_finished' END"
_TOOL = "kind NOT IN ('session_started', 'session_ended', 'subagent_started', 'subagent_stopped')"

#: Layers of (name, expression); a layer sees the names of those before it.
LAYERS: list[dict[str, str]] = [
    {"version": "CASE WHEN u % 4 = 0 THEN 1 ELSE 2 END", "kind": f"CASE WHEN u % 4 = 0 THEN {_V1} ELSE {_V2} END"},
    {
        "channel": "CASE WHEN kind IN ('session_started', 'session_ended') THEN 'recorder' WHEN kind = 'reported_intent' THEN 'reported' ELSE 'observed' END",
        "adapter": "CASE WHEN e % 17 = 0 THEN 'importer' ELSE 'hook' END",
        "mechanism": "t",
        "corr_id": f"CASE WHEN {_TOOL} THEN cast(k AS varchar(20)) END",
        "tool_name": f"CASE WHEN {_TOOL} AND kind <> 'reported_intent' THEN CASE WHEN e % 13 = 0 THEN t WHEN k % 5 = 0 THEN 'Bash' WHEN k % 5 = 1 THEN 'Read' WHEN k % 5 = 2 THEN 'Edit' WHEN k % 5 = 3 THEN 'Grep' ELSE 'WebSearch' END END",
        "outcome": "CASE WHEN kind = 'observed_tool_finished' THEN CASE WHEN t = 'error' THEN 'failed' ELSE 'succeeded' END END",
        "agent_id": "CASE WHEN version = 2 AND e % 5 = 0 THEN 'a' || cast(k % 3 AS varchar(20)) END",
        "subject_agent": "CASE WHEN kind IN ('subagent_started', 'subagent_stopped') THEN 's' || cast(k % 4 AS varchar(20)) END",
        "prompt_id": "CASE WHEN version = 2 AND e % 7 = 0 THEN 'p' || cast(k AS varchar(20)) END",
        "duration_ms": "CASE WHEN kind IN ('tool_succeeded', 'tool_failed') AND e % 3 <> 0 THEN cast(floor(abs(v)) AS bigint) END",
        "interrupted": "CASE WHEN kind = 'tool_failed' AND e % 2 = 0 THEN e % 4 = 0 END",
        "intent_text": "CASE WHEN kind = 'reported_intent' THEN 'intent ' || t END",
    },
    {
        "agent_type": "CASE WHEN agent_id IS NOT NULL AND e % 2 = 0 THEN 'explore' WHEN agent_id IS NOT NULL AND e % 3 = 0 THEN 'plan' END",
        "subject_type": "CASE WHEN subject_agent IS NOT NULL AND e % 3 <> 0 THEN 't' || cast(e % 3 AS varchar(20)) END",
        "parent_agent": "CASE WHEN subject_agent IS NOT NULL AND e % 2 = 0 THEN 'a' || cast(k % 3 AS varchar(20)) END",
        "command": f"CASE WHEN tool_name = 'Bash' AND version = 2 THEN {_COMMANDS} END",
    },
]


def _layered(base: str) -> str:
    for layer in LAYERS:
        base = f"SELECT *, {', '.join(f'{expr} AS {name}' for name, expr in layer.items())} FROM ({base})"
    return base


_BASE = "SELECT cast(user_id AS varchar(20)) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, {ns} AS epoch_ns, event_id AS e, user_id AS u, event_type AS t, value AS v, {k} AS k, props FROM {table}"
COLUMNS = ("session_id", "sequence", "epoch_ns", *(n for layer in LAYERS for n in layer), "props")

#: The ledger as the first CTE of an oracle: f"WITH {LEDGER_SQL} SELECT ...".
LEDGER_SQL = f"ledger AS (SELECT {', '.join(COLUMNS)} FROM ({_layered(_BASE.format(ns='epoch_us(ts) * 1000', k="cast(json_extract_string(props, '$.k') AS bigint)", table='events'))}))"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, in the columns of the ledger."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sql = _layered(_BASE.format(ns="unix_micros(cast(ts AS timestamp)) * 1000", k="cast(get_json_object(props, '$.k') AS bigint)", table="{events}"))
    return spark.sql(sql, events=events).select(*COLUMNS)
