"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names, for each role, the header it is shown under and whether its
text counts for the loss; it also holds the marks of turns, the escape character
and the transitions that make a turn order valid.  Each turn becomes three text
segments, header, text and end, with a loss flag each; control strings inside a
text (and the escape character itself) are escaped, so a formatted conversation
can be read back exactly.

Conversations are dealt by id and stream through a task turn by turn in order:
no conversation is held in memory, however long.  (Its running state
and digest are one sequential computation, so one conversation is one task's
work; rows are small next to the texts that a task can stream.)

Edge cases: a null text is an empty one; a null role reads back as an empty
role; unknown roles are formatted under their escaped name, never for the loss,
and break the order; null conversation ids are one conversation; equal turn
numbers are ordered by role and text, null turns come first; repeated rows are
turns of their own; a very long conversation streams through one task; other columns are
ignored, whatever their names; an empty table yields nothing.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import written


@dataclass(frozen=True)
class Template:
    headers: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    open: str = "### "
    named: str = ": "
    close: str = " </turn>\n"
    marks: tuple[str, ...] = ("###", "</turn>")
    escape: str = "\\"
    #: state -> role -> next state; what is absent is an invalid turn, after which the state is the role's own.
    order: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple[str, ...] = ("assistant",)

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, 2 * self.escape)
        for mark in self.marks:
            text = text.replace(mark, self.escape + mark)
        return text

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def header(self, role: str) -> str:
        """Known roles by their headers; others after a question mark, with every colon escaped."""
        return self.open + (self.headers[role] if role in self.headers else "?" + self.escaped(role).replace(":", self.escape + ":")) + self.named

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.header(role), False), (self.escaped(text), role in self.loss_roles), (self.close, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of formatted turns, by scanning for unescaped marks."""
        esc = re.escape(self.escape)
        plain = f"(?:{esc}.|(?!{re.escape(self.close)})[^{esc}])*"
        turn = re.compile(f"{re.escape(self.open)}((?:{esc}.|(?!{re.escape(self.named)})[^{esc}])*){re.escape(self.named)}({plain}){re.escape(self.close)}", re.S)
        roles = {v: k for k, v in self.headers.items()}
        out, at = [], 0
        while at < len(formatted):
            m = turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            name = m[1]
            out.append((self.unescaped(name[1:]) if name.startswith("?") else roles[name], self.unescaped(m[2])))
            at = m.end()
        return out

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """Next state, and whether the turn is in order."""
        after = self.order.get(state, {}).get(role)
        return (after, True) if after else (role if role in self.order else state, False)


SEGMENTS = "conv_id long, place long, turn_no long, segment int, text string, loss boolean, in_order boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, n_invalid long"


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Whole conversations in one task each, in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(conversations: DataFrame, template: Template | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Three segments a turn: conv_id, place (of the segment in the conversation),
    turn_no, segment (0 header, 1 text, 2 end), text, loss, in_order."""
    template = template or Template()
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        conv, state, place = object(), "start", 0
        for batch in batches:
            out = {k: [] for k in ("conv_id", "place", "turn_no", "segment", "text", "loss", "in_order")}
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if c != conv:
                    conv, state, place = c, "start", 0
                state, ok = template.step(state, role)
                for k, (part, loss) in enumerate(template.segments(role, text)):
                    for name, value in zip(out, (c, place + k, place // 3, k, part, loss, ok), strict=True):
                        out[name].append(value)
                place += 3
            yield pa.RecordBatch.from_arrays([pa.array(out["conv_id"], pa.int64()), pa.array(out["place"], pa.int64()), pa.array(out["turn_no"], pa.int64()), pa.array(out["segment"], pa.int32()), pa.array(out["text"], pa.string()), pa.array(out["loss"], pa.bool_()), pa.array(out["in_order"], pa.bool_())], names=list(out))

    return _in_order(rows, "turn", "role", "text").mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, from the formatted segments alone."""
    template = template or Template()

    def run(batches):
        conv, held = object(), None

        def row():
            turns, loss, loss_chars, chars, n, bad, state = held
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "valid": bad == 0 and state in template.final, "n_invalid": bad}

        pending, out = "", []
        for batch in batches:
            for c, segment, text, loss in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if held is None or c != conv:
                    if held:
                        out.append(row())
                    conv, held, pending = c, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, "start"], ""
                held[3] += len(text)
                pending += text
                if loss:
                    plain = template.unescaped(text)
                    held[1].update(plain.encode())
                    held[2] += len(plain)
                if segment == 2:
                    for role, said in template.parse(pending):
                        held[0].update(f"{role}\n{said}\n".encode())
                        held[4] += 1
                        held[6], ok = template.step(held[6], role)
                        held[5] += not ok
                    pending = ""
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if held:
            out.append(row())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(DIGEST))
    return _in_order(segments.select("conv_id", "place", "segment", "text", "loss"), "place").mapInArrow(run, DIGEST)


def digests(conversations: DataFrame, template: Template | None = None, **columns) -> DataFrame:
    """Formats all conversations into a table in the shared folder and reads it back."""
    return read_back(written(format_turns(conversations, template, **columns), "chat"), template)


#: The conversation that the query adds: control strings inside its texts.
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

DIGEST_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  '### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '?' || replace(replace(replace(replace(coalesce(role, ''), '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') END || ': '
  || replace(replace(replace(coalesce(text, ''), '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || ' </turn>' || chr(10) AS shown FROM c),
s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM t),
v AS (SELECT *, NOT coalesce(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE role = 'user' END, false) AS bad FROM s)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown))::BIGINT AS formatted_chars, count(*) FILTER (WHERE bad) = 0 AND max(role) FILTER (WHERE back = 1) = 'assistant' AS valid, count(*) FILTER (WHERE bad)::BIGINT AS n_invalid
FROM v GROUP BY conv_id
"""
