"""Hook payloads translated to emissions, by columns.

Eight hooks are supported; a PreToolUse whose input has a non-blank description
gives a second, reported record.  Unknown keys are ignored, or in strict mode
refused, but for those known to be left out on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADAPTER = "command-hook"
# Hooks with the fields that they need and the event kind they become; keys that are known.
HOOKS = {
    "SessionStart": ("session_started", ()),
    "PreToolUse": ("tool_requested", ("tool_use_id", "tool_name", "tool_input")),
    "PostToolUse": ("tool_succeeded", ("tool_use_id", "tool_name", "tool_input", "tool_response")),
    "PostToolUseFailure": ("tool_failed", ("tool_use_id", "tool_name", "tool_input", "error")),
    "PermissionDenied": ("tool_denied", ("tool_use_id", "tool_name", "tool_input")),
    "SubagentStart": ("subagent_started", ("agent_id",)),
    "SubagentStop": ("subagent_stopped", ("agent_id",)),
    "SessionEnd": ("session_ended", ()),
}
MODELLED = ("hook_event_name", "session_id", "prompt_id", "agent_id", "agent_type", "source", "reason", "tool_use_id", "tool_name", "tool_input", "tool_response", "duration_ms", "error", "is_interrupt", "parent_agent_id", "parent_agent_type")
LEFT_OUT = ("cwd", "transcript_path", "agent_transcript_path", "permission_mode", "effort", "last_assistant_message", "stop_hook_active", "background_tasks", "session_crons")


def _get(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("p", f"$.{name}", kind)


def _present(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("p", f"$.{name}", "variant")) != "VOID"


def translate(payloads: DataFrame, column: str = "payload", strict: bool = False) -> DataFrame:
    """payload_id (any other columns), error, and one row per emission: n, session_id,
    file_name, channel, mechanism, kind, context and event fields."""
    keep = [c for c in payloads.columns if c != column]
    rows = payloads.withColumn("p", F.try_parse_json(F.trim(column))).withColumn("hook", _get("hook_event_name")).withColumn("session_id", _get("session_id"))
    keys = F.array_sort(F.array_except(F.json_object_keys(F.trim(column)), F.array(*map(F.lit, MODELLED + LEFT_OUT))))
    missing = F.lit(None).cast("string")
    for hook, (_, needs) in HOOKS.items():
        gone = F.coalesce(*[F.when(~F.coalesce(_present(n), F.lit(False)), F.lit(n)) for n in needs]) if needs else F.lit(None)
        missing = F.when(F.col("hook") == hook, gone).otherwise(missing)
    error = (
        F.when(F.col("p").isNull() | F.col("hook").isNull() | F.col("session_id").isNull(), "malformed")
        .when(~F.col("hook").isin(*HOOKS), F.concat(F.lit("unsupported_hook:"), "hook"))
        .when(F.lit(strict) & (F.size(keys) > 0), F.concat(F.lit("unmodelled_fields:"), F.array_join(keys, ",")))
        .when(~F.rlike("session_id", F.lit("^[A-Za-z0-9_-]{1,128}$")), "unsafe_session_id")
        .when(missing.isNotNull(), F.concat(F.lit("missing_field:"), missing))
    )
    rows = rows.withColumn("error", error)
    kind = F.lit(None).cast("string")
    for hook, (name, _) in HOOKS.items():
        kind = F.when(F.col("hook") == hook, name).otherwise(kind)
    described = F.when(F.schema_of_variant(F.try_variant_get("p", "$.tool_input.description", "variant")) == "STRING", _get("tool_input.description"))
    said = F.when((F.col("hook") == "PreToolUse") & (F.trim(described) != ""), described)
    child = F.col("hook").isin("SubagentStart", "SubagentStop")
    mechanism = F.concat(F.lit("command-hook:"), "hook")
    observed = F.struct(F.lit(1).alias("n"), F.lit("observed").alias("channel"), mechanism.alias("mechanism"), kind.alias("kind"), F.lit(None).cast("string").alias("text"))
    reported = F.struct(F.lit(2).alias("n"), F.lit("reported").alias("channel"), F.concat(mechanism, F.lit("#tool_input.description")).alias("mechanism"), F.lit("reported_intent").alias("kind"), said.alias("text"))
    made = F.when(F.col("error").isNull(), F.when(said.isNotNull(), F.array(observed, reported)).otherwise(F.array(observed)))
    out = rows.withColumn("e", F.explode_outer(made))
    tool = F.col("e.kind").isin("tool_requested", "tool_succeeded", "tool_failed", "tool_denied")
    return out.select(
        *keep,
        "error",
        "e.n",
        "session_id",
        F.when(F.col("error").isNull(), F.concat("session_id", F.lit(".ndjson"))).alias("file_name"),
        "e.channel",
        F.lit(ADAPTER).alias("adapter"),
        "e.mechanism",
        "e.kind",
        _get("prompt_id").alias("prompt_id"),
        F.when(~child, _get("agent_id")).alias("agent_id"),
        F.when(~child, _get("agent_type")).alias("agent_type"),
        F.when(child, _get("agent_id")).alias("subject_agent"),
        F.when(child, _get("agent_type")).alias("subject_type"),
        F.when(child, _get("parent_agent_id")).alias("parent_agent"),
        F.when(tool | (F.col("e.kind") == "reported_intent"), _get("tool_use_id")).alias("tool_use_id"),
        F.when(tool, _get("tool_name")).alias("tool_name"),
        F.when(tool, F.get_json_object(F.trim(column), "$.tool_input")).alias("tool_input"),
        F.when(F.col("e.kind") == "tool_succeeded", F.get_json_object(F.trim(column), "$.tool_response")).alias("tool_response"),
        F.when(F.col("e.kind").isin("tool_succeeded", "tool_failed"), _get("duration_ms", "bigint")).alias("duration_ms"),
        F.when(F.col("e.kind") == "tool_failed", _get("is_interrupt", "boolean")).alias("interrupted"),
        F.when(F.col("e.kind") == "tool_failed", _get("error")).alias("error_text"),
        F.when(F.col("e.kind") == "session_started", _get("source")).alias("source"),
        F.when(F.col("e.kind") == "session_ended", _get("reason")).alias("reason"),
        F.col("e.text").alias("intent_text"),
    )


def key_counts(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """How often each top-level key arrives with each hook."""
    rows = payloads.select(F.get_json_object(column, "$.hook_event_name").alias("hook"), F.explode(F.json_object_keys(column)).alias("key"))
    return rows.groupBy("hook", "key").agg(F.count("*").alias("n"))
