"""Numbering and appending emissions as they arrive.

A recording's state is its status, version, session and last sequence number, whatever
its length: records are numbered in order of arrival, and none is dropped as late,
since a clock that goes back is counted elsewhere and never repaired.  A batch's
rows of one recording are ordered by the given column.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.vocabulary import KINDS, allowed_channels
from ..sources.append import LARGEST, with_line


def numbered(emissions: DataFrame, session: str = "session_id", order: str = "n") -> DataFrame:
    """The stream with a continuous sequence number for each session."""
    schema = StructType([*emissions.schema.fields, StructField("sequence", LongType())])

    def run(key, frames, state):
        last = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values(order, kind="stable")
            frame["sequence"] = range(last + 1, last + 1 + len(frame))
            last += len(frame)
            yield frame
        state.update((last,))

    return emissions.groupBy(session).applyInPandasWithState(run, schema, StructType([StructField("last", LongType())]), "append", "NoTimeout")


class Appender(StatefulProcessor):
    """Judges and numbers one recording's emissions; its state is what its last line says."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "status string, version long, session_id string, records string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        text = lambda x: None if pd.isna(x) else str(x)
        self.end.update((text(r["status"]), None if pd.isna(r["version"]) else int(r["version"]), text(r["session_id"]), text(r["records"]) or "0"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [f for f in rows if len(f)]
        if not held:  # a recording that only has an initial state
            return
        status, version, session, records = self.end.get() if self.end.exists() else ("complete", None, None, "0")
        last = int(Decimal(records))
        frame = pd.concat(held).sort_values(self.order, kind="stable")  # one batch of one recording
        refused, sequence = [], []
        for allowed, own in zip(frame["channel_is_allowed"], frame["session_id"], strict=True):
            why = None
            if not allowed:
                why = "channel_not_allowed"
            elif status == "truncated":
                why = "append_after_truncation"
            elif status != "complete":
                why = "corrupt_recording"
            elif last and version != 2:
                why = "append_version_mismatch"
            elif last and session != own:
                why = "emission_session_mismatch"
            elif last >= LARGEST:
                why = "sequence_exhausted"
            else:
                last, version, session = last + 1, 2, own
            refused.append(why)
            sequence.append(None if why else str(last))
        self.end.update((status, version, session, str(last)))
        yield frame.drop(columns="channel_is_allowed").assign(refused=refused, sequence=sequence)

    def close(self) -> None:
        pass


def appended(emissions: DataFrame, ends: DataFrame | None = None, order: str = "n") -> DataFrame:
    """The stream of emissions (with file_name, session_id, kind, channel, recorded_at) with refused (null when
    accepted), sequence and line; refused ones stay in it with their reason.

    ends (file_name, status, version, session_id, records) says how recordings stand
    when the stream first starts; after that, and after a restart from the checkpoint, the state does.
    A recording that isn't known begins empty; its first accepted emission gives its session.
    State stores need RocksDB: spark.sql.streaming.stateStore.providerClass."""
    allowed = F.lit(False)
    for kind in KINDS[2]:
        allowed = F.when(F.col("kind") == kind, F.coalesce(F.col("channel").isin(*allowed_channels(kind)), F.lit(False))).otherwise(allowed)
    rows = emissions.withColumn("channel_is_allowed", F.coalesce(allowed, F.lit(False)))
    schema = StructType([*emissions.schema.fields, StructField("refused", StringType()), StructField("sequence", StringType())])
    before = ends.select("file_name", "status", "version", "session_id", F.col("records").cast("string").alias("records")).groupBy("file_name") if ends is not None else None
    found = rows.groupBy("file_name").transformWithStateInPandas(Appender(order), schema, "Append", "None", before)
    lined = with_line(found.withColumn("sequence", F.col("sequence").cast("decimal(20,0)")))
    return lined.withColumn("line", F.when(F.col("refused").isNull(), F.col("line")))
