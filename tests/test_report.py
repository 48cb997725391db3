"""The report says what the facts say, again and again the same, and holds no command."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chronoloom.operators import corpus as C
from chronoloom.plans import report
from chronoloom.sources.events import ledger


def test_report(spark):
    rows = ledger(spark, "/root/testdata/sf0.001")
    document = report.facts(rows, "small")
    text = report.to_json(document)
    assert json.loads(text) == document
    assert report.render(json.loads(text)) == report.render(document)
    assert document["eligible"] == sum(s["skipped"] is None for s in document["sessions"])
    for command in ("cargo test", "git status", "npm run"):
        assert command not in text
    assert document["leads"] and document["leads"][0]["name"] in report.render(document)


def test_comparison_and_files(spark, tmp_path):
    flow = C.workflow(C.actions(rows := ledger(spark, "/root/testdata/sf0.001")), rows)
    a, b = (C.families(flow.where(F.col("session_id").cast("long") % 2 == k)) for k in (0, 1))
    document = report.comparison(a, b, ("even", "odd"), (8, 7))
    assert sum(document["counts"].values()) == C.compare(a, b).count()
    shown = report.render_comparison(document)
    assert all(f"## {m.capitalize()} ({n})" in shown for m, n in document["counts"].items())
    for f in document["families"]["gained"]:
        assert f["before"] is None and f["after"] >= 2 and f["marks"] in shown
    facts = report.facts(rows, "small")
    report.write(str(tmp_path / "out"), facts, [{"identity": "x"}], 12, "2026-01-01T00:00:00Z")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["facts.json", "manifest.json", "report.md", "run.json"]
    assert json.loads((tmp_path / "out/facts.json").read_text()) == facts
    assert sum(facts["by_category"].values()) == sum(facts["by_outcome"].values()) == sum(a["actions"] for a in facts["actions"])
    assert sum(facts["by_strength"].values()) == facts["families"]


def test_file_eligibility(spark):
    """Every reason, and the order of the rules."""
    files = [(f"{k:02d}.ndjson", key, status, n, True) for k, (key, status, n) in enumerate([("a", "complete", 30), ("a", "complete", 30), ("b", "malformed_record", 0), ("c", "complete", 0), (None, "complete", 5), ("d", "truncated", 20), ("e", "complete", 20), ("a", "complete", 9), ("f", "complete", 30), ("g", "complete", 30), ("f", "complete", 30)])]
    files.append(("99.ndjson", "h", "complete", 3, False))
    table = spark.createDataFrame(files, "path string, key string, status string, records int, has_time boolean")
    many = {"00.ndjson": "iv", "01.ndjson": "iv", "06.ndjson": "ii", "08.ndjson": "iv", "09.ndjson": "iv", "10.ndjson": "iv"}
    acts = [(p, kinds[i % 2]) for p, kinds in many.items() for i in range(12)] + [("05.ndjson", "i")] * 3
    found = {r.path[:2]: r.skipped for r in C.file_eligibility(table, spark.createDataFrame(acts, "session_id string, category string"), 2).collect()}
    assert found == {"00": None, "01": "duplicate_identity", "02": "replay_failed", "03": "no_complete_records", "04": "no_complete_records", "05": "too_few_actions", "06": "vocabulary_too_small", "07": "duplicate_identity", "08": None, "09": "corpus_full", "10": "duplicate_identity", "99": "no_timestamps"}
