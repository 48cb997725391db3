"""Appending emissions to recordings.

A batch of emissions is numbered after each recording's last record and checked
before anything is written; what is refused stays out with its reason.  A
:class:`Log` keeps accepted lines in one folder, a partition for each batch: a
batch that is tried again takes the place of what it wrote before, so nothing
is written twice, and its numbers follow from the batches before it alone.
Batches come one at a time, as in foreachBatch; a :class:`SharedLog` takes several writers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import KINDS, allowed_channels

LARGEST = 18446744073709551615
#: Event fields by kind: (name in the record, column of the emission, whether it is JSON text).
FIELDS = {
    "session_started": [("source", "source", False)],
    "session_ended": [("reason", "reason", False)],
    "reported_intent": [("text", "intent_text", False), ("tool_use_id", "tool_use_id", False)],
    "tool_requested": [("requested_input", "tool_input", True), ("tool_name", "tool_name", False), ("tool_use_id", "tool_use_id", False)],
    "tool_succeeded": [("duration_ms", "duration_ms", None), ("effective_input", "tool_input", True), ("response", "tool_response", True), ("tool_name", "tool_name", False), ("tool_use_id", "tool_use_id", False)],
    "tool_failed": [("duration_ms", "duration_ms", None), ("effective_input", "tool_input", True), ("error", "error_text", False), ("interrupted", "interrupted", None), ("tool_name", "tool_name", False), ("tool_use_id", "tool_use_id", False)],
    "tool_denied": [("requested_input", "tool_input", True), ("tool_name", "tool_name", False), ("tool_use_id", "tool_use_id", False)],
    "subagent_started": [("agent_id", "subject_agent", False), ("agent_type", "subject_type", False), ("parent_agent_id", "parent_agent", False)],
    "subagent_stopped": [("agent_id", "subject_agent", False), ("agent_type", "subject_type", False), ("parent_agent_id", "parent_agent", False)],
}


def _text(c: Column) -> Column:
    """A JSON string literal."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def _value(c: Column, raw: bool | None) -> Column:
    """A JSON value: text, JSON text (raw; text when it isn't JSON), or bare (raw is None)."""
    if raw is None:
        return c.cast("string")
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(_text(c)) if raw else _text(c)


def _member(name: str, value: Column) -> Column:
    """A member of an object, left out when null."""
    return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def with_line(emissions: DataFrame) -> DataFrame:
    """Adds line: the record as one line of JSON, keys in order, absent fields left out.

    Values are rendered once, in a projection of their own, and then put together by kind."""
    kinds = {c: raw for fields in FIELDS.values() for _, c, raw in fields if c in emissions.columns}
    kinds |= dict.fromkeys(("agent_id", "agent_type", "prompt_id", "adapter", "channel", "mechanism", "recorded_at", "session_id"), False) | {"sequence": None}
    rows = emissions.withColumns({f"_r_{c}": _value(F.col(c), raw) for c, raw in kinds.items()})
    shown = lambda c: F.col(f"_r_{c}")
    event = F.lit(None).cast("string")
    for kind, fields in FIELDS.items():
        own = _object(F.lit(f'"kind":"{kind}"'), *[_member(n, shown(c)) for n, c, _ in fields if c in kinds])
        event = F.when(F.col("kind") == kind, own).otherwise(event)
    context = ("agent_id", "agent_type", "prompt_id")
    line = _object(
        F.when(F.coalesce(*context).isNotNull(), F.concat(F.lit('"context":'), _object(*[_member(n, shown(n)) for n in context]))),
        F.concat(F.lit('"event":'), event),
        F.concat(F.lit('"provenance":'), _object(*[_member(n, shown(n)) for n in ("adapter", "channel", "mechanism")])),
        _member("recorded_at", shown("recorded_at")),
        F.lit('"schema_version":2'),
        _member("sequence", shown("sequence")),
        _member("session_id", shown("session_id")),
    )
    return rows.withColumn("line", line).drop(*[f"_r_{c}" for c in kinds])


def append(emissions: DataFrame, recordings: DataFrame, recorded_at: Column | None = None, order: str = "n") -> DataFrame:
    """emissions (with file_name) against recordings (file_name, status, version,
    session_id, records): adds refused (null when accepted), sequence, recorded_at and line.

    Accepted emissions of a file are numbered in the given order after its last record."""
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if recorded_at is None else recorded_at
    held = recordings.select("file_name", F.col("status").alias("_status"), F.col("version").alias("_version"), F.col("session_id").alias("_session"), F.col("records").cast("decimal(20,0)").alias("_records"))
    rows = emissions.join(held, "file_name", "left")
    allowed = F.lit(False)
    for kind in KINDS[2]:
        allowed = F.when(F.col("kind") == kind, F.col("channel").isin(*allowed_channels(kind))).otherwise(allowed)
    refused = (
        F.when(~allowed, "channel_not_allowed")
        .when(F.col("_status") == "truncated", "append_after_truncation")
        .when(F.col("_status").isNotNull() & (F.col("_status") != "complete"), "corrupt_recording")
        .when((F.col("_records") > 0) & (F.col("_version") != 2), "append_version_mismatch")
        .when((F.col("_records") > 0) & (F.col("_session") != F.col("session_id")), "emission_session_mismatch")
        .when(F.col("_records") >= F.lit(str(LARGEST)).cast("decimal(20,0)"), "sequence_exhausted")
    )
    rows = rows.withColumn("refused", refused).withColumn("recorded_at", at)
    place = F.row_number().over(Window.partitionBy("file_name", F.col("refused").isNull()).orderBy(order))
    rows = rows.withColumn("sequence", F.when(F.col("refused").isNull(), F.coalesce("_records", F.lit(0)) + place).cast("decimal(20,0)"))
    rows = with_line(rows.drop("_status", "_version", "_session", "_records"))
    return rows.withColumn("line", F.when(F.col("refused").isNull(), F.col("line")))


class Log:
    """Recordings as a Parquet table of lines (file_name, sequence, line) by batch."""

    SCHEMA = "file_name string, sequence decimal(20,0), line string, batch long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def lines(self, before: int | None = None) -> DataFrame:
        """All lines, or those of earlier batches."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows if before is None else rows.where(F.col("batch") < before)

    def ends(self, before: int | None = None) -> DataFrame:
        """What appending needs to know of each recording."""
        return ends_of(self.lines(before))

    def append(self, emissions: DataFrame, batch: int, recorded_at: Column | None = None, order: str = "n") -> DataFrame:
        """Writes what of a batch is accepted; returns (file_name, refused, n) of the rest."""
        rows = append(emissions, self.ends(batch), recorded_at, order)
        kept = rows.where("refused is null").select("file_name", "sequence", "line", F.lit(batch).cast("long").alias("batch"))
        kept.repartition("file_name").sortWithinPartitions("file_name", "sequence").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)
        return rows.where("refused is not null").groupBy("file_name", "refused").agg(F.count("*").alias("n"))

    def contents(self) -> DataFrame:
        """path, content: the recordings as bytes, for replay."""
        held = self.lines().groupBy("file_name").agg(F.sort_array(F.collect_list(F.struct("sequence", "line"))).getField("line").alias("l"))
        return held.select(F.col("file_name").alias("path"), F.concat(F.array_join("l", "\n"), F.lit("\n")).cast("binary").alias("content"))

    def into(self, stream: DataFrame, checkpoint: str, order: str = "n"):
        """Appends a stream of emissions, batch by batch."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: self.append(rows, batch, order=order)).start()


class SharedLog:
    """A log that several writers append to at once, by optimistic commits.

    A commit is a file ``_commits/<number>`` that names a folder of lines; it is created only if
    no one has created it (HDFS renames in one step), so commits have one order.
    A writer numbers its batch against the commits that it has seen and writes the lines
    aside; if another commit comes first, it numbers again after that one.  Lines of
    folders that no commit names don't exist.  A commit also says whose batch
    it is: a batch that was committed before isn't written again."""

    TRIES = 100

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._system = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def commits(self) -> list[tuple[int, str, str]]:
        """(number, folder, batch) of all commits, in order: a short line each."""
        if not self._system.exists(self._at("_commits")):
            return []
        found = []
        for f in self._system.listStatus(self._at("_commits")):
            number = f.getPath().getName()
            if number.isdigit():
                with_stream = self._system.open(f.getPath())
                try:
                    folder, batch = bytes(with_stream.readAllBytes()).decode().split("\n", 1)
                finally:
                    with_stream.close()
                found.append((int(number), folder, batch))
        return sorted(found)

    def lines(self, commits: list | None = None) -> DataFrame:
        """file_name, sequence, line of the given commits, or of all."""
        folders = [f"{self.path}/{folder}" for _, folder, _ in (self.commits() if commits is None else commits)]
        schema = "file_name string, sequence decimal(20,0), line string"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _commit(self, number: int, folder: str, batch: str) -> bool:
        """Whether this writer is the first to create the commit; the name shows only when its text is whole."""
        aside = self._at(f"_commits/.{uuid.uuid4().hex}")
        out = self._system.create(aside, False)
        out.write(f"{folder}\n{batch}".encode())
        out.close()
        target = self._at(f"_commits/{number:020d}")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._system.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:  # FileContext's rename refuses a name that exists
            context.rename(aside, target, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self._system.delete(aside, False)
            return False

    def append(self, emissions: DataFrame, batch: str, recorded_at: Column | None = None, order: str = "n") -> DataFrame:
        """Commits what of a batch is accepted; returns (file_name, refused, n) of the rest.

        batch names this batch among all of all writers."""
        refusals = lambda rows: rows.where("refused is not null").groupBy("file_name", "refused").agg(F.count("*").alias("n"))
        for _ in range(self.TRIES):
            seen = self.commits()
            before = next((i for i, c in enumerate(seen) if c[2] == batch), len(seen))
            rows = append(emissions, ends_of(self.lines(seen[:before])), recorded_at, order)
            if before < len(seen):
                return refusals(rows)
            folder = f"lines-{uuid.uuid4().hex}"
            kept = rows.where("refused is null").select("file_name", "sequence", "line")
            kept.repartition("file_name").sortWithinPartitions("file_name", "sequence").write.parquet(f"{self.path}/{folder}")
            if self._commit(seen[-1][0] + 1 if seen else 1, folder, batch):
                return refusals(rows)
            self._system.delete(self._at(folder), True)  # another writer was first
        raise RuntimeError(f"{self.TRIES} other commits came first")


def ends_of(lines: DataFrame) -> DataFrame:
    """file_name, status, version, session_id, records: what appending needs to know, from each
    recording's last line alone (they are complete: nothing else is written)."""
    last = lines.groupBy("file_name").agg(F.max("sequence").alias("records"), F.max_by("line", "sequence").alias("line"))
    return last.select("file_name", F.lit("complete").alias("status"), F.get_json_object("line", "$.schema_version").cast("long").alias("version"), F.get_json_object("line", "$.session_id").alias("session_id"), "records")
