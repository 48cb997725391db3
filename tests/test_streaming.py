"""Numbering and appending go on from batch to batch, and from one run of the stream to the next."""

from __future__ import annotations

import json

from chronoloom.streaming.ingest import appended, numbered


def test_numbers_continue(spark, tmp_path):
    source, where = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "session_id string, n long"
    for start in (0, 3):
        spark.createDataFrame([("a", start + k) for k in range(3)] + [("b", start)], schema).coalesce(1).write.mode("append").parquet(source)
        query = numbered(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", where).trigger(availableNow=True).start()
        query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.session_id, r.n, r.sequence) for r in rows) == [*(("a", k, k + 1) for k in range(6)), ("b", 0, 1), ("b", 3, 2)]


EMISSION = "file_name string, session_id string, n int, kind string, channel string, adapter string, mechanism string, tool_use_id string, tool_name string, tool_input string, prompt_id string, agent_id string, agent_type string, recorded_at string"


def test_append_with_state_refuses_and_continues_after_a_restart(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, where = (str(tmp_path / x) for x in ("in", "out", "state"))
    full = str(2**64 - 1)
    ends = spark.createDataFrame([("held", "complete", 2, "h", "5"), ("cut", "truncated", 2, "c", "3"), ("bad", "malformed_record", None, None, "0"), ("old", "complete", 1, "o", "4"), ("full", "complete", 2, "f", full), ("edge", "complete", 2, "e", str(2**64 - 2))], "file_name string, status string, version long, session_id string, records string")

    def row(file, n, session=None, channel="observed"):
        return (file, session or file[0], n, "tool_requested", channel, "t", "m", f"i{n}", "Bash", '{"a":1}', None, None, None, "2026-01-01T00:00:00Z")

    batches = [
        [row("held", 2), row("held", 1), row("held", 3, "other"), row("held", 4, channel="reported"), row("cut", 1), row("bad", 1), row("old", 1), row("full", 1), row("edge", 1), row("edge", 2), row("new", 1, "x"), row("new", 2, "y")],
        [row("held", 5), row("new", 3, "x"), row("new", 4, "y"), row("cut", 2)],
    ]
    try:
        for rows in batches:  # the second run starts from the checkpoint
            spark.createDataFrame(rows, EMISSION).coalesce(1).write.mode("append").parquet(source)
            stream = appended(spark.readStream.schema(EMISSION).parquet(source), ends)
            stream.select("file_name", "n", "refused", "sequence", "line").writeStream.format("parquet").option("path", out).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(name, before)
    got = {(r.file_name, r.n): r for r in spark.read.parquet(out).collect()}
    numbers = {k: int(r.sequence) for k, r in got.items() if r.refused is None}
    assert numbers == {("held", 1): 6, ("held", 2): 7, ("held", 5): 8, ("edge", 1): 2**64 - 1, ("new", 1): 1, ("new", 3): 2}
    refused = {("held", 3): "emission_session_mismatch", ("held", 4): "channel_not_allowed", ("cut", 1): "append_after_truncation", ("cut", 2): "append_after_truncation", ("bad", 1): "corrupt_recording", ("old", 1): "append_version_mismatch", ("full", 1): "sequence_exhausted", ("edge", 2): "sequence_exhausted", ("new", 2): "emission_session_mismatch", ("new", 4): "emission_session_mismatch"}
    assert {k: r.refused for k, r in got.items() if r.refused} == refused and all(got[k].line is None for k in refused)
    assert json.loads(got["held", 5].line)["sequence"] == 8 and json.loads(got["held", 5].line)["session_id"] == "h"


def test_buckets_of_a_stream_equal_those_of_the_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    from chronoloom.operators import signal
    from chronoloom.plans.sequences import WIDTH, signal_ledger
    from chronoloom.streaming.buckets import bucketed

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, where = (str(tmp_path / x) for x in ("in", "out", "state"))
    whole = signal_ledger(spark, "/root/testdata/sf0.001").select("session_id", "epoch_ns", "version", "channel", "kind", "tool_name", "corr_id", "response_bytes").cache()
    batch = F.pmod(F.xxhash64("session_id", "epoch_ns", "corr_id"), F.lit(3))
    try:
        for k in range(3):  # any order: a later batch holds earlier records and moves origins
            whole.where(batch == k).coalesce(1).write.mode("append").parquet(source)
            changes = bucketed(spark.readStream.schema(whole.schema).parquet(source), WIDTH).withColumn("run", F.lit(k))
            changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(name, before)
    rows = spark.read.parquet(out).collect()
    last = {(r.session_id, r.dimension, r.bucket): r for r in sorted(rows, key=lambda r: r.run)}
    got = {k: r.value for k, r in last.items() if r.value}
    assert got == {(r.session_id, r.dimension, r.bucket): r.value for r in signal.sparse(whole, WIDTH).collect()}
    assert any(r.value == 0 for r in rows)  # origins did move
    axis = {r.session_id: (r.origin_ns, r.buckets) for r in signal.axis(whole, WIDTH).collect()}
    assert {s: (r.origin_ns, r.buckets) for (s, _, _), r in sorted(last.items(), key=lambda x: x[1].run)} == axis
