"""Registered queries over recordings as files of JSON lines: replay, append, hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inspect as I
from ..sources import append as A
from ..sources import hooks as H
from ..sources import recordings as R
from ..sources.events import LEDGER_SQL, ledger

_AT = "2026-01-01T00:00:00Z"


def _emissions(s, d):
    """The events as version 2 emissions, one a record."""
    rows = ledger(s, d)
    kind = F.when(F.col("kind") == "observed_tool_started", "tool_requested").when(F.col("outcome") == "failed", "tool_failed").when(F.col("kind") == "observed_tool_finished", "tool_succeeded").otherwise(F.col("kind"))
    command = F.coalesce(F.to_json(F.struct("command")), F.lit("{}"))
    return rows.select(
        "session_id", "sequence", "epoch_ns", kind.alias("kind"), "channel", "adapter", "mechanism", "prompt_id", "agent_id", "agent_type", "subject_agent", "subject_type", "parent_agent", F.col("corr_id").alias("tool_use_id"), "tool_name",
        command.alias("tool_input"), F.col("props").alias("tool_response"), "duration_ms", "interrupted", F.lit("no such file\n\"quoted\"").alias("error_text"), F.lit("startup").alias("source"), F.lit(None).cast("string").alias("reason"), "intent_text",
        F.lit(_AT).alias("recorded_at"),
    )


def files(s, d):
    """One file a session, in six of seven damaged by its number: cut short, a line
    missing, a blank line, another session, an unknown field, another version."""
    rows = A.with_line(_emissions(s, d))
    held = rows.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "line"))).getField("line").alias("l"))
    u = F.col("session_id").cast("bigint") % 7
    second = lambda find, put: F.concat(F.slice("l", 1, 1), F.array(F.replace(F.get("l", F.lit(1)), F.lit(find), F.lit(put))), F.slice(F.col("l"), F.lit(3), F.size("l")))
    lines = (
        F.when(u == 2, F.concat(F.slice("l", 1, 2), F.slice(F.col("l"), F.lit(4), F.size("l"))))
        .when(u == 3, F.concat(F.slice("l", 1, 2), F.array(F.lit("  ")), F.slice(F.col("l"), F.lit(3), F.size("l"))))
        .when(u == 4, second('"session_id":"', '"session_id":"x'))
        .when(u == 5, second('"schema_version":2', '"schema_version":2,"extra":1'))
        .when(u == 6, second('"schema_version":2', '"schema_version":3'))
        .otherwise(F.col("l"))
    )
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    return held.withColumn("t", text).select(F.concat("session_id", F.lit(".ndjson")).alias("path"), F.when(u == 1, F.expr("left(t, length(t) - 6)")).otherwise(F.col("t")).cast("binary").alias("content"))


def _replay(s, d):
    return R.recordings(files(s, d)).select("path", "status", "error_line", "records", "session_id", "version")


def _replayed_shapes(s, d):
    """Tool groups from the JSON lines of sound files."""
    return I.tool_groups(R.ledger(files(s, d))).select("session_id", "corr_id", "shape", "first_sequence", F.size("openings").alias("openings"), F.size("outcomes").alias("outcomes"))


def _append(s, d, emissions=lambda rows: rows.where("sequence <= 3")):
    rows = emissions(_emissions(s, d)).withColumn("n", F.col("sequence")).withColumn("file_name", F.concat("session_id", F.lit(".ndjson"))).drop("sequence", "recorded_at")
    rows = rows.withColumn("channel", F.when(F.col("n") == 3, "reported").otherwise(F.col("channel")))
    held = R.recordings(files(s, d)).withColumnRenamed("path", "file_name")
    return A.append(rows, held, F.lit(_AT)).select("file_name", "n", "refused", F.col("sequence").cast("bigint").alias("sequence"), F.col("line").isNotNull().alias("written"))


def _payloads(s, d):
    rows = ledger(s, d)
    hook = F.element_at(F.array(*[F.lit(h) for h in (*H.HOOKS, "Notification")]), (F.col("sequence") % 9 + 1).cast("int"))
    row = F.struct(
        hook.alias("hook_event_name"),
        F.when(F.col("sequence") % 11 == 0, "../up").otherwise(F.concat(F.lit("u"), "session_id")).alias("session_id"),
        F.col("corr_id").alias("tool_use_id"),
        F.lit("Bash").alias("tool_name"),
        F.when(F.col("sequence") % 13 > 0, F.struct(F.coalesce("command", F.lit("ls")).alias("command"), F.when(F.col("sequence") % 2 == 0, F.lit("look around")).otherwise("  ").alias("description"))).alias("tool_input"),
        F.struct(F.lit(0).alias("exit")).alias("tool_response"),
        F.when(F.col("sequence") % 4 > 0, "failed").alias("error"),
        F.coalesce("agent_id", "subject_agent").alias("agent_id"),
        F.lit("/home/x").alias("cwd"),
        F.when(F.col("sequence") % 17 == 0, 1).alias("novel"),
    )
    return rows.select("session_id", "sequence", F.to_json(row).alias("payload")).withColumnsRenamed({"session_id": "payload_session", "sequence": "payload_n"})


def _hooks(s, d):
    return H.translate(_payloads(s, d), strict=True).select("payload_session", "payload_n", "error", "n", "channel", "mechanism", "kind", "tool_use_id", "agent_id", "subject_agent", "intent_text")


QUERIES = {
    "s02_replay": _replay,
    "s05_replayed_groups": _replayed_shapes,
    "s13_append": _append,
    "s13_append_all": lambda s, d: _append(s, d, lambda rows: rows),
    "s16_replayed_lines": lambda s, d: R.replayed(files(s, d)).groupBy("path").agg(F.count("*").alias("lines"), F.max("line_no").cast("bigint").alias("last")),
    "s16_exits": lambda s, d: R.exits(files(s, d)),
    "s20_identities": lambda s, d: R.identities(files(s, d)),
    "s20_keys": lambda s, d: R.identities(files(s, d)).select("path", "key"),
    "s21_hooks": _hooks,
    "s27_key_counts": lambda s, d: H.key_counts(_payloads(s, d)),
}

_W = f"WITH {LEDGER_SQL}"
_U = "session_id::BIGINT % 7"
_STATUS = f"CASE {_U} WHEN 1 THEN 'truncated' WHEN 2 THEN 'sequence_violation' WHEN 3 THEN 'blank_line' WHEN 4 THEN 'session_mismatch' WHEN 5 THEN 'malformed_record' WHEN 6 THEN 'mixed_schema_versions' ELSE 'complete' END"
_HOOK = "[" + ", ".join(f"'{h}'" for h in (*H.HOOKS, "Notification")) + "][sequence % 9 + 1]"
_KINDS = " ".join(f"WHEN '{h}' THEN '{k}'" for h, (k, _) in H.HOOKS.items())
_HOOKED = f"""p AS (SELECT *, {_HOOK} AS hook, sequence % 13 > 0 AS has_input, coalesce(agent_id, subject_agent) AS agent, sequence % 4 > 0 AS has_error FROM ledger),
q AS (SELECT *, CASE WHEN hook = 'Notification' THEN 'unsupported_hook:Notification' WHEN sequence % 17 = 0 THEN 'unmodelled_fields:novel' WHEN sequence % 11 = 0 THEN 'unsafe_session_id'
WHEN hook IN ('PreToolUse', 'PostToolUse', 'PostToolUseFailure', 'PermissionDenied') AND corr_id IS NULL THEN 'missing_field:tool_use_id' WHEN hook IN ('PreToolUse', 'PostToolUse', 'PostToolUseFailure', 'PermissionDenied') AND NOT has_input THEN 'missing_field:tool_input'
WHEN hook = 'PostToolUseFailure' AND NOT has_error THEN 'missing_field:error' WHEN hook IN ('SubagentStart', 'SubagentStop') AND agent IS NULL THEN 'missing_field:agent_id' END AS err FROM p),
r AS (SELECT *, unnest(CASE WHEN err IS NOT NULL THEN [NULL] WHEN hook = 'PreToolUse' AND has_input AND sequence % 2 = 0 THEN [1, 2] ELSE [1] END) AS n FROM q)"""

ORACLE_SQL = {
    "s02_replay": f"{_W} SELECT session_id || '.ndjson' AS path, {_STATUS} AS status, CASE {_U} WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 2 END::BIGINT AS error_line, CASE WHEN {_U} = 0 THEN count(*) WHEN {_U} = 1 THEN count(*) - 1 ELSE 0 END AS records, CASE WHEN {_U} < 2 THEN session_id END AS session_id, CASE WHEN {_U} < 2 THEN 2 END::BIGINT AS version FROM ledger GROUP BY ledger.session_id",
    "s05_replayed_groups": f"{_W}, l AS (SELECT *, max(sequence) OVER (PARTITION BY session_id) AS last FROM ledger WHERE {_U} < 2), g AS (SELECT session_id, corr_id, min(sequence) AS first_sequence, count(*) FILTER (WHERE kind IN ('tool_requested', 'observed_tool_started'))::INT AS openings, count(*) FILTER (WHERE kind NOT IN ('tool_requested', 'observed_tool_started', 'reported_intent'))::INT AS outcomes, count(DISTINCT CASE WHEN kind = 'tool_succeeded' OR outcome = 'succeeded' THEN 1 WHEN kind = 'tool_failed' OR outcome = 'failed' THEN 2 WHEN kind = 'tool_denied' THEN 3 END) AS classes FROM l WHERE corr_id IS NOT NULL AND (sequence < last OR {_U} = 0) GROUP BY ALL) SELECT session_id, corr_id, CASE WHEN openings = 0 AND outcomes = 0 THEN 'reported_intent_only' WHEN openings > 1 OR outcomes > 1 OR classes > 1 THEN 'ambiguous' WHEN outcomes = 0 THEN 'opening_without_outcome' WHEN openings = 0 THEN 'outcome_without_opening' ELSE 'paired_lifecycle' END AS shape, first_sequence, openings, outcomes FROM g",
    "s13_append": f"{_W}, t AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS records FROM ledger), a AS (SELECT session_id, sequence AS n, records, CASE WHEN n = 3 AND kind <> 'reported_intent' THEN 'channel_not_allowed' WHEN {_U} = 1 THEN 'append_after_truncation' WHEN {_U} > 1 THEN 'corrupt_recording' END AS refused FROM t WHERE sequence <= 3) SELECT session_id || '.ndjson' AS file_name, n, refused, CASE WHEN refused IS NULL THEN records + row_number() OVER (PARTITION BY session_id, refused IS NULL ORDER BY n) END AS sequence, refused IS NULL AS written FROM a",
    "s13_append_all": f"{_W}, t AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS records FROM ledger), a AS (SELECT session_id, sequence AS n, records, CASE WHEN n = 3 AND kind <> 'reported_intent' THEN 'channel_not_allowed' WHEN {_U} = 1 THEN 'append_after_truncation' WHEN {_U} > 1 THEN 'corrupt_recording' END AS refused FROM t) SELECT session_id || '.ndjson' AS file_name, n, refused, CASE WHEN refused IS NULL THEN records + row_number() OVER (PARTITION BY session_id, refused IS NULL ORDER BY n) END AS sequence, refused IS NULL AS written FROM a",
    "s16_replayed_lines": f"{_W} SELECT session_id || '.ndjson' AS path, count(*) - ({_U} = 1)::INT AS lines, count(*) - ({_U} = 1)::INT AS last FROM ledger WHERE {_U} < 2 GROUP BY session_id",
    "s16_exits": f"{_W} SELECT session_id || '.ndjson' AS path, {_STATUS} AS status, CASE {_U} WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS exit FROM ledger GROUP BY session_id",
    "s20_keys": f"{_W} SELECT session_id || '.ndjson' AS path, session_id AS key FROM ledger GROUP BY session_id",
    "s21_hooks": f"{_W}, {_HOOKED} SELECT session_id AS payload_session, sequence AS payload_n, err AS error, n, CASE n WHEN 1 THEN 'observed' WHEN 2 THEN 'reported' END AS channel, 'command-hook:' || CASE n WHEN 1 THEN hook WHEN 2 THEN hook || '#tool_input.description' END AS mechanism, CASE n WHEN 1 THEN CASE hook {_KINDS} END WHEN 2 THEN 'reported_intent' END AS kind, CASE WHEN n = 2 OR (n = 1 AND hook IN ('PreToolUse', 'PostToolUse', 'PostToolUseFailure', 'PermissionDenied')) THEN corr_id END AS tool_use_id, CASE WHEN hook NOT IN ('SubagentStart', 'SubagentStop') THEN agent END AS agent_id, CASE WHEN hook IN ('SubagentStart', 'SubagentStop') THEN agent END AS subject_agent, CASE WHEN n = 2 THEN 'look around' END AS intent_text FROM r",
    "s27_key_counts": f"{_W}, {_HOOKED}, k AS (SELECT hook, unnest(['hook_event_name', 'session_id', 'tool_name', 'tool_response', 'cwd', CASE WHEN corr_id IS NOT NULL THEN 'tool_use_id' END, CASE WHEN has_input THEN 'tool_input' END, CASE WHEN has_error THEN 'error' END, CASE WHEN agent IS NOT NULL THEN 'agent_id' END, CASE WHEN sequence % 17 = 0 THEN 'novel' END]) AS key FROM p) SELECT hook, key, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY ALL",
}
