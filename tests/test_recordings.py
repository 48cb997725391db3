"""Strict reading of recordings: every kind of damage, tails, order of checks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from chronoloom.sources import append, ranges, recordings
from chronoloom.sources import recordings as R


def record(n, session="s", version=2, channel="recorder", event=None, **more):
    return {"schema_version": version, "session_id": session, "sequence": n, "recorded_at": "2026-01-01T00:00:00.123456789Z", "provenance": {"channel": channel, "adapter": "a", "mechanism": "m"}, "event": event or {"kind": "session_started"}, **more}


def tool(n, kind="tool_requested", **fields):
    return record(n, channel="observed", event={"kind": kind, "tool_use_id": "t", "tool_name": "Bash", "requested_input": {"command": "ls"}, **fields})


def text(*records, end="\n"):
    return ("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + end).encode()


CASES = {
    "sound": (text(record(1), tool(2)), "complete", None),
    "cut": (text(record(1), tool(2))[:-9], "truncated", None),
    "fragment_only": (b'{"schema', "truncated", None),
    "empty": (b"", "complete", None),
    "carriage_returns": (text(record(1), tool(2)).replace(b"\n", b"\r\n"), "complete", None),
    "blank": (text(record(1), "", tool(3)), "blank_line", 2),
    "not_json": (text(record(1), "{nope"), "malformed_record", 2),
    "bad_utf8": (text(record(1)) + b"\xff\n" + text("{nope"), "invalid_utf8", None),
    "bad_utf8_in_fragment": (text(record(1)) + b"\xff", "truncated", None),
    "unknown_version": (text(record(1, version=9)), "unsupported_schema_version", 1),
    "mixed": (text(record(1), record(2, version=1)), "mixed_schema_versions", 2),
    "wrong_channel": (text(record(1, channel="reported")), "channel_not_allowed", 1),
    "skipped": (text(record(1), tool(3)), "sequence_violation", 2),
    "starts_at_two": (text(record(2)), "sequence_violation", 1),
    "other_session": (text(record(1), record(2, session="t")), "session_mismatch", 2),
    "unknown_field": (text(record(1, extra=1)), "malformed_record", 1),
    "unknown_event_field": (text(record(1), tool(2, extra=1)), "malformed_record", 2),
    "wrong_type": (text(record(1), tool(2, tool_name=5)), "malformed_record", 2),
    "null_option": (text(record(1, event={"kind": "session_started", "source": None})), "complete", None),
    "missing_field": (text(record(1, channel="observed", event={"kind": "tool_denied", "tool_use_id": "t"})), "malformed_record", 1),
    "bad_time": (text(record(1) | {"recorded_at": "yesterday"}), "malformed_record", 1),
    "version_one": (text(record(1, version=1), record(2, version=1, channel="observed", event={"kind": "observed_tool_finished", "tool_call_id": "c", "outcome": "failed", "result": None})), "complete", None),
    "version_one_context": (text(record(1, version=1, context={})), "malformed_record", 1),
}


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("recordings")
    for name, (data, _, _) in CASES.items():
        (folder / f"{name}.ndjson").write_bytes(data)
    (folder / "notes.txt").write_text("not a recording")
    files = R.contents(spark, str(folder))
    return {r.path.rsplit("/", 1)[1][:-7]: r for r in R.recordings(files).collect()}, files


def test_only_recordings_are_found(read):
    assert set(read[0]) == set(CASES)


@pytest.mark.parametrize("name", sorted(CASES))
def test_status(read, name):
    _, status, line = CASES[name]
    assert (read[0][name].status, read[0][name].error_line) == (status, line)


def test_tail_is_bytes(read):
    data = CASES["cut"][0]
    at = data.rindex(b"\n") + 1
    assert (read[0]["cut"].tail_offset, read[0]["cut"].tail_bytes) == (at, len(data) - at)


def test_ledger_keeps_nanoseconds(read):
    rows = [r for r in R.ledger(read[1]).collect() if r.path.endswith("/sound.ndjson")]
    assert [r.sequence for r in sorted(rows, key=lambda r: r.sequence)] == [1, 2]
    assert rows[0].epoch_ns % 1_000_000_000 == 123456789
    assert {r.command for r in rows} == {None, "ls"}


def test_fingerprint(spark):
    df = spark.createDataFrame([(bytearray(b""),), (bytearray(b"a"),)], "c binary")
    assert [r.f for r in df.select(R.fingerprint(df.c).alias("f")).collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c"]


def test_normal_bytes(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [1, 2]}',), (None,), ('"é"',)], "j string")
    assert [r.n for r in df.select(R.normal_bytes(df.j).alias("n")).collect()] == [len('{"a":[1,2],"b":1}'), None, 4]


def test_log_is_read_back_and_a_retry_writes_nothing_twice(spark, tmp_path):
    """Batches of emissions, one tried again, one of a stream; then a strict replay."""
    log = append.Log(spark, f"file://{tmp_path}/log")

    def batch(first, n, channel="observed"):
        rows = [(f"s{k}.ndjson", f"s{k}", i, "tool_requested", channel, "t", "m", f"c{i}", "Bash", '{"a":1}') for k in range(3) for i in range(first, first + n)]
        return spark.createDataFrame(rows, "file_name string, session_id string, n int, kind string, channel string, adapter string, mechanism string, tool_use_id string, tool_name string, tool_input string").withColumns({c: F.lit(None).cast("string") for c in ("prompt_id", "agent_id", "agent_type")})

    assert log.append(batch(1, 4), 0, F.lit("2026-01-01T00:00:00Z")).isEmpty()
    assert log.append(batch(5, 3), 1).isEmpty()
    assert log.append(batch(5, 3), 1).isEmpty()  # the same batch again
    refused = log.append(batch(8, 2, "reported"), 2).collect()
    assert sum(r.n for r in refused) == 6 and {r.refused for r in refused} == {"channel_not_allowed"}
    found = recordings.recordings(log.contents()).collect()
    assert [(r.path, r.status, r.records, r.session_id) for r in sorted(found)] == [(f"s{k}.ndjson", "complete", 7, f"s{k}") for k in range(3)]
    assert [r.line_no for r in recordings.replayed(log.contents()).where("path = 's1.ndjson'").collect()] == list(range(1, 8))


def test_fingerprints_of_many_files(spark):
    def plain(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    data = [b"", b"a", b"foobar", bytes(range(256)) * 3, None]
    rows = spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, d in enumerate(data)], "i int, content binary")
    got = {r.i: r.f for r in rows.select("i", recordings.fingerprint(F.col("content")).alias("f")).collect()}
    assert got == {i: plain(d) if d is not None else None for i, d in enumerate(data)}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ranges")
    for name, (data, _, _) in CASES.items():
        (folder / f"{name}.ndjson").write_bytes(data)
    (folder / "long.ndjson").write_bytes(text(record(1), *(tool(n, requested_input={"text": "é" * (n % 50)}) for n in range(2, 300))))
    (folder / "late_fault.ndjson").write_bytes(text(record(1), *(tool(n) for n in range(2, 200)), tool(201)) + b'{"cut')
    (folder / "marked.ndjson").write_bytes(b"\xef\xbb\xbf" + text(record(1), tool(2)) + b"tail")
    return str(folder)


@pytest.mark.parametrize("limit", ["2k", "128m"])
def test_byte_ranges_read_what_whole_files_do(spark, folder, limit):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    held = {n: spark.conf.get(n) for n in (name, "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set(name, limit)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        short = lambda p: p.rsplit("/", 1)[1]
        cut = ranges.ranges(spark, folder)
        whole = recordings.contents(spark, folder)
        status = lambda files: sorted((short(r.path), *r[1:]) for r in recordings.recordings(files).collect())
        assert status(cut) == status(whole)
        lines = lambda files: sorted((short(r.path), r.line_no, r.line) for r in recordings.lines(files).collect())
        assert lines(cut) == lines(whole)
        for r in cut.where("raw is not null").collect():
            data = open(f"{folder}/{short(r.path)}", "rb").read()
            assert data[r.offset : r.offset + len(r.raw)] == r.raw and r.terminated == (data[r.offset + len(r.raw) :][:1] == b"\n")
        if limit == "2k":
            parts = spark.read.option("lineSep", "\n").text(f"{folder}/long.ndjson").rdd.getNumPartitions()
            assert parts > 20  # one file is many tasks
    finally:
        for n, v in held.items():
            spark.conf.set(n, v)
    assert spark.conf.get(name) == before


def test_ends_read_the_last_line_alone(spark, folder, tmp_path):
    long = text(record(1), *(tool(n, requested_input={"text": "x" * 200}) for n in range(2, 5000)))
    (tmp_path / "big.ndjson").write_bytes(long)
    (tmp_path / "wide.ndjson").write_bytes(text(record(1), tool(2, requested_input={"text": "y" * 30000})))
    (tmp_path / "none.ndjson").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r for r in ranges.ends(spark, str(tmp_path)).collect()}
    assert (got["big.ndjson"].status, got["big.ndjson"].records, got["big.ndjson"].version, got["big.ndjson"].session_id) == ("complete", 4999, 2, "s")
    assert got["big.ndjson"].bytes_read == ranges.STEP < len(long) / 100
    assert got["wide.ndjson"].records == 2 and got["wide.ndjson"].bytes_read <= 30000 + 2 * ranges.STEP
    assert (got["none.ndjson"].status, got["none.ndjson"].records, got["none.ndjson"].bytes_read) == ("complete", 0, 0)
    got = {r.path.rsplit("/", 1)[1][:-7]: r for r in ranges.ends(spark, folder).collect()}
    for name, (data, status, _) in CASES.items():
        if status in ("complete", "truncated"):
            assert got[name].status == status and got[name].fragment == len(data) - data.rfind(b"\n") - 1
        if status == "complete":
            assert got[name].records == data.count(b"\n")
    assert got["not_json"].status == "malformed_record"


def emitted(spark, writer, first, n, channel="observed", files=2):
    rows = [(f"s{k}.ndjson", f"s{k}", i, "tool_requested", channel, "t", "m", f"{writer}-{i}", "Bash", '{"a":1}') for k in range(files) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "file_name string, session_id string, n int, kind string, channel string, adapter string, mechanism string, tool_use_id string, tool_name string, tool_input string").withColumns({c: F.lit(None).cast("string") for c in ("prompt_id", "agent_id", "agent_type")})


def test_writers_at_once_leave_continuous_sequences(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/shared"

    def writes(writer):
        log = append.SharedLog(spark, path)
        for b in range(3):
            assert log.append(emitted(spark, writer, 10 * b, 2), f"{writer}-{b}").isEmpty()

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(writes, "xyz"))
    log = append.SharedLog(spark, path)
    assert [n for n, _, _ in log.commits()] == list(range(1, 10)) and len({b for _, _, b in log.commits()}) == 9
    rows = log.lines().collect()
    for k in range(2):
        own = sorted((int(r.sequence), json.loads(r.line)) for r in rows if r.file_name == f"s{k}.ndjson")
        assert [n for n, _ in own] == list(range(1, 19)) == [r["sequence"] for _, r in own]
        ids = [r["event"]["tool_use_id"] for _, r in own]
        assert sorted(ids) == sorted(f"{w}-{10 * b + i}" for w in "xyz" for b in range(3) for i in range(2))
        for w in "xyz":  # each writer's emissions keep their order
            assert [x for x in ids if x[0] == w] == [f"{w}-{10 * b + i}" for b in range(3) for i in range(2)]


def test_a_loser_numbers_again_and_a_retry_commits_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/shared"
    log, other = append.SharedLog(spark, path), append.SharedLog(spark, path)
    commit, lost = log._commit, []

    def late(number, folder, batch):
        if not lost:  # the other writer commits between this one's numbering and its commit
            lost.append(number)
            other.append(emitted(spark, "o", 0, 3), "o-0")
        return commit(number, folder, batch)

    monkeypatch.setattr(log, "_commit", late)
    log.append(emitted(spark, "m", 0, 2), "m-0")
    refused = log.append(emitted(spark, "m", 5, 1, "reported"), "m-1").collect()
    assert sum(r.n for r in refused) == 2 and {r.refused for r in refused} == {"channel_not_allowed"}
    again = sorted((r.file_name, int(r.sequence)) for r in log.lines().collect())
    log.append(emitted(spark, "m", 0, 2), "m-0")
    assert lost == [1] and [b for _, _, b in log.commits()] == ["o-0", "m-0", "m-1"]
    assert again == [(f"s{k}.ndjson", n) for k in range(2) for n in range(1, 6)] == sorted((r.file_name, int(r.sequence)) for r in log.lines().collect())
    folders = {p.name for p in (tmp_path / "shared").iterdir() if p.name.startswith("lines-")}
    assert folders == {f for _, f, _ in log.commits()}  # the loser's lines are gone
