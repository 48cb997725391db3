"""Closed vocabularies of the record model."""

from __future__ import annotations

# Channels, event kinds by version, and the channels each kind may come through.
CHANNELS = ("reported", "observed", "recorder")
KINDS = {
    1: ("session_started", "session_ended", "reported_intent", "observed_tool_started", "observed_tool_finished"),
    2: ("session_started", "session_ended", "reported_intent", "tool_requested", "tool_succeeded", "tool_failed", "tool_denied", "subagent_started", "subagent_stopped"),
}
ANOMALIES = (
    "missing_session_start",
    "missing_session_end",
    "duplicate_session_start",
    "duplicate_session_end",
    "duplicate_openings",
    "duplicate_outcomes",
    "conflicting_outcomes",
    "opening_without_outcome",
    "outcome_without_opening",
    "reported_intent_without_observed_evidence",
    "divergent_tool_names",
    "subagent_stop_without_start",
    "subagent_start_without_stop",
    "divergent_agent_types",
)
OPENINGS = ("tool_requested", "observed_tool_started")
OUTCOMES = ("tool_succeeded", "tool_failed", "tool_denied", "observed_tool_finished")
TOOL_KINDS = OPENINGS + OUTCOMES


def allowed_channels(kind: str) -> tuple[str, ...]:
    if kind in ("session_started", "session_ended"):
        return ("recorder", "observed")
    return ("reported",) if kind == "reported_intent" else ("observed",)


def quoted(values) -> str:
    """A SQL list of string literals."""
    return ", ".join("'" + v + "'" for v in values)
