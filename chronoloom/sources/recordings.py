"""Recordings as newline-delimited JSON, read strictly.

One file is one session.  A file is scanned whole (binaryFile), because its tail
decides what it is: bytes after the last newline are a truncated record, kept as
an offset and a length and never decoded.  Complete lines are checked by columns,
in a fixed order, and the first failing line of a file gives its error:
invalid UTF-8 anywhere in the complete lines comes before all; then, line by
line, blank, unreadable version, a version that differs from the first line's,
an unsupported version, a malformed record, a channel the kind can't come
through, a sequence number that isn't the line number, another session.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import CHANNELS, KINDS, allowed_channels

# Fields of events by version and kind; s string, u unsigned, b boolean, j any JSON; ? may be absent.
EVENTS: dict[int, dict[str, dict[str, str]]] = {
    1: {
        "session_started": {},
        "session_ended": {},
        "reported_intent": {"text": "s", "tool_call_id": "s?"},
        "observed_tool_started": {"tool_call_id": "s", "tool_name": "s", "arguments": "j"},
        "observed_tool_finished": {"tool_call_id": "s", "outcome": "s", "result": "j"},
    },
    2: {
        "session_started": {"source": "s?"},
        "session_ended": {"reason": "s?"},
        "reported_intent": {"text": "s", "tool_use_id": "s?"},
        "tool_requested": {"tool_use_id": "s", "tool_name": "s", "requested_input": "j"},
        "tool_succeeded": {"tool_use_id": "s", "tool_name": "s", "effective_input": "j", "response": "j", "duration_ms": "u?"},
        "tool_failed": {"tool_use_id": "s", "tool_name": "s", "effective_input": "j", "error": "s", "interrupted": "b?", "duration_ms": "u?"},
        "tool_denied": {"tool_use_id": "s", "tool_name": "s", "requested_input": "j"},
        "subagent_started": {"agent_id": "s", "agent_type": "s?", "parent_agent_id": "s?", "parent_agent_type": "s?"},
        "subagent_stopped": {"agent_id": "s", "agent_type": "s?", "parent_agent_id": "s?", "parent_agent_type": "s?"},
    },
}
CONTEXT = ("prompt_id", "agent_id", "agent_type")
TIME = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d{1,9})?([Zz]|[+-]\d\d:\d\d)$"


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every *.ndjson file in a folder (files only, found by name).

    Spark's file sources pass over empty files, which are complete recordings of
    no records; they are added from the folder's listing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ndjson").load(path).select("path", "content")
    empty = [(p, bytearray()) for p in empty_files(spark, path)]
    return found.unionByName(spark.createDataFrame(empty, found.schema)) if empty else found


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """The *.ndjson files of no bytes in a folder: one listing, and only their names are kept."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return [str(f.getPath()) for f in listed if f.isFile() and not f.getLen() and f.getPath().getName().endswith(".ndjson")]


def tails(files: DataFrame) -> DataFrame:
    """path, prefix (complete lines as text), valid_utf8, tail_offset and tail_bytes; without
    prefix if files are lines by byte ranges (ranges.ranges)."""
    if "content" not in files.columns:
        ended = F.coalesce("terminated", F.lit(False))
        end = F.coalesce(F.max(F.when(ended, F.col("offset") + F.octet_length("raw") + 1)), F.lit(0))
        per = files.groupBy("path", "size").agg(F.coalesce(F.bool_and(F.when(ended, F.is_valid_utf8(F.col("raw").cast("string")))), F.lit(True)).alias("valid_utf8"), end.alias("tail_offset"))
        return per.select("path", "valid_utf8", "tail_offset", (F.col("size") - F.col("tail_offset")).alias("tail_bytes"))
    text = F.decode("content", "ISO-8859-1")  # a character a byte
    back = F.locate("\n", F.reverse(text))
    kept = F.when(back == 0, 0).otherwise(F.length("content") - back + 1)
    raw = F.substring(F.col("content"), F.lit(1), kept.cast("int"))
    return files.withColumn("_raw", raw).select(
        "path",
        F.when(F.is_valid_utf8(F.col("_raw").cast("string")), F.col("_raw").cast("string")).alias("prefix"),
        F.is_valid_utf8(F.col("_raw").cast("string")).alias("valid_utf8"),
        kept.cast("bigint").alias("tail_offset"),
        (F.length("content") - kept).cast("bigint").alias("tail_bytes"),
    )


def lines(files: DataFrame) -> DataFrame:
    """path, line_no, line of all complete lines; a carriage return at the end is dropped."""
    if "content" not in files.columns:
        bad = tails(files).where("not valid_utf8").select("path")
        held = files.where("terminated").join(bad, "path", "left_anti")
        return held.select("path", "line_no", F.regexp_replace(F.col("raw").cast("string"), "\r$", "").alias("line"))
    held = tails(files).where("valid_utf8 and tail_offset > 0")
    cut = F.split(F.expr("left(prefix, length(prefix) - 1)"), "\n")
    return held.select("path", F.posexplode(cut).alias("_n", "_l")).select("path", (F.col("_n") + 1).cast("bigint").alias("line_no"), F.regexp_replace("_l", "\r$", "").alias("line"))


def _type(path: str) -> Column:
    """Type name of a JSON value; VOID is null, and a missing value is SQL null."""
    return F.schema_of_variant(F.try_variant_get("v", path, "variant"))


def _signature(path: str) -> Column:
    """An object's keys with a letter for each value's type: s string, u integer,
    b boolean, n null, o other; null when it isn't an object."""
    entries = F.map_entries(F.try_variant_get("v", path, "map<string,variant>"))

    def entry(e):
        t = F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID"))
        letter = F.when(t == "STRING", "s").when(t == "BOOLEAN", "b").when(t == "VOID", "n").when((t == "BIGINT") | t.rlike(r"^DECIMAL\(\d+,0\)"), "u").otherwise("o")
        return F.concat(e["key"], F.lit(":"), letter)

    return F.transform(entries, entry)


def _options(fields: dict[str, str]) -> list[str]:
    """Every entry that a signature may hold."""
    return [f"{f}:{x}" for f, t in fields.items() for x in ("sbuno" if t[0] == "j" else t[0] + ("n" if t.endswith("?") else ""))]


def _keys(fields: dict[str, str]) -> int:
    return sum(not t.endswith("?") for t in fields.values())


def _sound(signature: Column, options: Column, needed: Column, count: Column) -> Column:
    """No entry beyond the options, and all needed keys."""
    keys = F.transform(signature, lambda e: F.substring_index(e, ":", 1))
    return F.coalesce((F.size(F.array_except(signature, options)) == 0) & (F.size(F.array_intersect(keys, needed)) == count), F.lit(False))


def _object(path: str, fields: dict[str, str]) -> Column:
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    return _sound(_signature(path), lit(_options(fields)), lit([f for f, t in fields.items() if not t.endswith("?")]), F.lit(_keys(fields)))


def _event() -> Column:
    """Whether the event is one of its version's, with its fields and no others.

    Version 1's session events take no fields; others in them are ignored."""
    names, options, needed, count = [], [], [], []
    for version, kinds in EVENTS.items():
        for kind, fields in kinds.items():
            every = {"kind": "s", **fields}
            names.append(F.lit(f"{version}:{kind}"))
            options.append(F.array(*map(F.lit, _options(every))))
            needed.append(F.array(*[F.lit(f) for f, t in every.items() if not t.endswith("?")]))
            count.append(F.lit(_keys(every)))
    key = F.concat(F.col("version").cast("string"), F.lit(":"), F.col("kind"))
    at = F.array_position(F.array(*names), key)
    pick = lambda xs: F.get(F.array(*xs), (at - 1).cast("int"))
    free = (F.col("version") == 1) & F.col("kind").isin("session_started", "session_ended")
    return F.coalesce(at > 0, F.lit(False)) & (free | _sound(_signature("$.event"), pick(options), pick(needed), pick(count)))


def epoch_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text, with up to nine fraction digits."""
    whole = F.regexp_replace(F.regexp_replace(text, r"\.\d+", ""), "[Tt ]", "T")
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 9, "0").cast("bigint")
    return F.unix_seconds(F.try_to_timestamp(F.upper(whole), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))) * 1_000_000_000 + fraction


def checked(files: DataFrame) -> DataFrame:
    """Lines with their parsed fields and error (null where the line is in order)."""
    rows = lines(files).withColumn("v", F.try_parse_json("line"))
    version = F.when((_type("$.schema_version") == "BIGINT"), F.try_variant_get("v", "$.schema_version", "bigint"))
    rows = rows.withColumn("version", version).withColumn("session_id", F.try_variant_get("v", "$.session_id", "string"))
    if "content" in files.columns:
        order = Window.partitionBy("path").orderBy("line_no")
        rows = rows.withColumn("first_version", F.first("version").over(order)).withColumn("first_session", F.first("session_id").over(order))
    else:  # no task gets all lines of a long file
        rows = rows.join(rows.where("line_no = 1").select("path", F.col("version").alias("first_version"), F.col("session_id").alias("first_session")), "path")
    rows = rows.withColumn("sequence", F.try_variant_get("v", "$.sequence", "decimal(20,0)")).withColumn("recorded_at", F.try_variant_get("v", "$.recorded_at", "string"))
    rows = rows.withColumn("kind", F.try_variant_get("v", "$.event.kind", "string")).withColumn("channel", F.try_variant_get("v", "$.provenance.channel", "string"))
    number = lambda path: F.coalesce(F.try_variant_get("v", path, "decimal(20,0)") >= 0, F.lit(True))
    sound = (
        _object("$", {"schema_version": "u", "session_id": "s", "sequence": "u", "recorded_at": "s", "provenance": "j", "event": "j", "context": "j?"})
        & number("$.sequence")
        & F.coalesce(F.rlike("recorded_at", F.lit(TIME)), F.lit(False))
        & _object("$.provenance", {"channel": "s", "adapter": "s", "mechanism": "s"})
        & F.coalesce(F.col("channel").isin(*CHANNELS), F.lit(False))
        & (_type("$.context").isNull() | ((F.col("version") == 2) & _object("$.context", dict.fromkeys(CONTEXT, "s?"))))
        & _event()
        & number("$.event.duration_ms")
        & F.coalesce(F.try_variant_get("v", "$.event.outcome", "string").isin("succeeded", "failed"), F.lit(True))
    )
    allowed = F.lit(False)
    for kind in sorted({k for kinds in KINDS.values() for k in kinds}):
        allowed = F.when(F.col("kind") == kind, F.col("channel").isin(*allowed_channels(kind))).otherwise(allowed)
    error = (
        F.when(F.trim("line") == "", "blank_line")
        .when(F.col("version").isNull(), "malformed_record")
        .when(F.col("version") != F.col("first_version"), "mixed_schema_versions")
        .when(~F.col("version").isin(1, 2), "unsupported_schema_version")
        .when(~sound, "malformed_record")
        .when(~allowed, "channel_not_allowed")
        .when(F.col("sequence") != F.col("line_no"), "sequence_violation")
        .when(F.col("session_id") != F.col("first_session"), "session_mismatch")
    )
    return rows.withColumn("error", error)


def recordings(files: DataFrame) -> DataFrame:
    """One row per file: status (complete, truncated or the first error), its line, records, session, tail."""
    per = checked(files).groupBy("path").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("error"), F.min(F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("error_line"), F.count("*").alias("n"), F.first("first_session").alias("session_id"), F.first("first_version").alias("version"))
    rows = tails(files).join(per, "path", "left")
    status = F.when(~F.col("valid_utf8"), "invalid_utf8").when(F.col("error").isNotNull(), F.col("error")).when(F.col("tail_bytes") > 0, "truncated").otherwise("complete")
    bad = ~status.isin("complete", "truncated")
    return rows.select("path", status.alias("status"), "error_line", F.when(bad, 0).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("records"), F.when(~bad, F.col("session_id")).alias("session_id"), F.when(~bad, F.col("version")).alias("version"), F.when(F.col("tail_bytes") > 0, F.col("tail_offset")).alias("tail_offset"), "tail_bytes")


def ledger(files: DataFrame, replays: DataFrame | None = None) -> DataFrame:
    """The records of sound files in the columns of the ledger, with the raw line; replays: the files' recordings, if at hand."""
    replays = recordings(files) if replays is None else replays
    sound = replays.where("status in ('complete', 'truncated')").select("path")
    rows = checked(files).join(sound, "path", "left_semi")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    raw = lambda p: F.get_json_object("line", p)
    child = F.col("kind").isin("subagent_started", "subagent_stopped")
    response = F.when(F.col("kind") == "tool_succeeded", raw("$.event.response")).when(F.col("kind") == "observed_tool_finished", raw("$.event.result"))
    return rows.select(
        "path",
        "session_id",
        F.col("sequence").cast("bigint").alias("sequence"),
        epoch_ns(F.col("recorded_at")).alias("epoch_ns"),
        "recorded_at",
        F.col("version").cast("int").alias("version"),
        "kind",
        "channel",
        get("$.provenance.adapter").alias("adapter"),
        get("$.provenance.mechanism").alias("mechanism"),
        F.coalesce(get("$.event.tool_use_id"), get("$.event.tool_call_id")).alias("corr_id"),
        get("$.event.tool_name").alias("tool_name"),
        get("$.event.outcome").alias("outcome"),
        get("$.context.agent_id").alias("agent_id"),
        get("$.context.agent_type").alias("agent_type"),
        get("$.context.prompt_id").alias("prompt_id"),
        F.when(child, get("$.event.agent_id")).alias("subject_agent"),
        F.when(child, get("$.event.agent_type")).alias("subject_type"),
        F.when(child, get("$.event.parent_agent_id")).alias("parent_agent"),
        get("$.event.duration_ms", "bigint").alias("duration_ms"),
        get("$.event.interrupted", "boolean").alias("interrupted"),
        get("$.event.text").alias("intent_text"),
        get("$.event.source").alias("source"),
        get("$.event.reason").alias("reason"),
        get("$.event.error").alias("error_text"),
        F.coalesce(_type("$.event.requested_input") != "VOID", F.lit(False)).alias("has_requested_input"),
        F.coalesce(_type("$.event.effective_input") != "VOID", F.lit(False)).alias("has_effective_input"),
        F.coalesce(F.coalesce(_type("$.event.response"), _type("$.event.result")) != "VOID", F.lit(False)).alias("has_response"),
        F.coalesce(F.when(_type("$.event.requested_input.command") == "STRING", get("$.event.requested_input.command")), F.when(_type("$.event.effective_input.command") == "STRING", get("$.event.effective_input.command"))).alias("command"),
        response.alias("response"),
        "line",
    )


def fingerprint(content: Column) -> Column:
    """FNV-1a, 64 bits, as 16 hex digits (Arrow batches: it needs wrapping arithmetic)."""
    @F.pandas_udf("string")
    def fnv(column: pd.Series) -> pd.Series:
        held = column.dropna()
        size = np.array([len(x) for x in held], np.int64)
        data = np.frombuffer(b"".join(held), np.uint8).astype(np.uint64)
        start, h = np.cumsum(size) - size, np.full(len(size), 0xCBF29CE484222325, np.uint64)
        live = np.argsort(-size, kind="stable")  # longest first: those that go on are a prefix
        for i in range(int(size.max()) if len(size) else 0):  # a byte of every file at a time
            live = live[: np.searchsorted(-size[live], -i)]
            h[live] = (h[live] ^ data[start[live] + i]) * np.uint64(0x100000001B3)
        return pd.Series([f"{x:016x}" for x in h.tolist()], held.index).reindex(column.index)

    return fnv(content)


#: Exit status of a replay: complete, cut short, or not sound.
EXIT = {"complete": 0, "truncated": 2}


def replayed(files: DataFrame) -> DataFrame:
    """path, line_no, line of sound files, in order of path and line; what a replay prints."""
    sound = recordings(files).where("status in ('complete', 'truncated')").select("path")
    return lines(files).select("path", "line_no", "line").join(sound, "path", "left_semi").orderBy("path", "line_no")


def exits(files: DataFrame) -> DataFrame:
    """path, status and exit status of a replay of each file."""
    status = F.lit(1)
    for name, code in EXIT.items():
        status = F.when(F.col("status") == name, code).otherwise(status)
    return recordings(files).select("path", "status", status.alias("exit"))


def identity(path: str = "path", session: str = "session_id") -> Column:
    """What tells a file from others: the session's id, else the file's name without ending."""
    return F.coalesce(session, F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def identities(files: DataFrame) -> DataFrame:
    """path, fingerprint of the bytes, and key: the session's id, else the file's name without ending."""
    held = recordings(files).select("path", F.col("session_id").alias("_session"))
    return files.select("path", fingerprint(F.col("content")).alias("fingerprint")).join(held, "path").select("path", "fingerprint", identity("path", "_session").alias("key"))


def normal_bytes(json_text: Column) -> Column:
    """UTF-8 length of a JSON value with sorted keys and no spaces."""
    @F.pandas_udf("long")
    def size(column: pd.Series) -> pd.Series:
        import json

        def one(text):
            if text is None:
                return None
            try:
                value = json.loads(text)
            except ValueError:  # get_json_object gives strings without quotes
                value = text
            return len(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode())

        return column.map(one).astype("Int64")

    return size(json_text)
