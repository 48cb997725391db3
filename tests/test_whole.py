"""Queries that take the whole of their input, on inputs where a part would differ."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from chronoloom import registry
from chronoloom.operators import corpus, nulls
from chronoloom.operators import sequence as Q
from chronoloom.plans import report, statistics
from chronoloom.plans.sequences import pairs
from chronoloom.sources.events import ledger

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def all_of(spark):
    """All pairs of eligible sessions, and adjacent ones."""
    led = ledger(spark, SF)
    ids = sorted(r.session_id for r in Q.project(led).select("session_id").distinct().collect())
    fit = {r.session_id for r in corpus.eligibility(corpus.actions(led), led).where("skipped is null").collect()}
    return {(a, b) for a in ids for b in ids if a < b and {a, b} <= fit} | set(zip(ids, ids[1:], strict=False))


def test_pair_searches_take_all_pairs(spark):
    want = all_of(spark)
    assert len(want) > 14
    assert [tuple(r) for r in pairs(spark, SF).orderBy("a", "b").collect()] == sorted(want)
    for name in ("q12_complete_search", "q16_corpus_shared_run", "a25_corpus_divergence"):
        assert {(r.a, r.b) for r in QUERIES[name](spark, SF).select("a", "b").collect()} == want
    for name in ("q04_corpus_totals", "q11_surprisal"):
        assert {(r.k, r.a, r.b) for r in QUERIES[name](spark, SF).select("k", "a", "b").distinct().collect()} == {(k, a, b) for k in (3, 4, 5, 6) for a, b in want}


def test_run_between_sessions_that_are_not_adjacent(spark):
    rows = [(s, i, m) for s, marks in (("1", "abcde"), ("2", "vwxyz"), ("3", "abcde")) for i, m in enumerate(marks)]
    e = spark.createDataFrame(rows, "session_id string, pos int, mark string")
    p = Q.corpus_pairs(e, e.select("session_id").where("session_id <> '2'"))
    assert {(r.a, r.b): r.longest for r in Q.longest_shared_run(e, p).collect()} == {("1", "2"): 0, ("1", "3"): 5, ("2", "3"): 0}


def test_calibration_can_find_an_exceptional_pair(spark):
    r = random.Random(3)
    motif = list("mnopqrstuvwx")
    rows = [(s, [*(r.choice("abc") for _ in range(20)), *motif, *(r.choice("abc") for _ in range(20))], [-1] + [500] * 51) for s in "12"]
    two = spark.createDataFrame(rows, "session_id string, marks array<string>, gaps array<long>")
    pair = spark.createDataFrame([("1", "2")], "a string, b string")
    got = {x.k: x for x in nulls.tail(nulls.searches(two, pair, statistics.LADDER, statistics.REPLICATES)).collect()}
    assert sorted(got) == [3, 4, 6, 8, 12] and {x.replicates for x in got.values()} == {999}
    assert got[12].tail == 1 / 1000 and got[12].exceptional and got[12].certified
    assert statistics.ADEQUACY == 199


def test_strength_by_eligible_sessions_and_nulls(spark):
    best = spark.createDataFrame([(r, 3, 2 + (r < 9)) for r in range(999)], "replicate int, k int, best int")
    assert corpus.exceptional_from(best) == {3: 3}
    found = spark.createDataFrame([(3, 3, False), (3, 2, False), (4, 8, False), (3, 3, True)], "k int, sessions int, low_diversity boolean").withColumn("mark_dominance", F.lit(False))
    got = [r.strength for r in corpus.strength(found, F.lit(15), {3: 3}).collect()]
    assert got == ["promising_beyond_local_grammar", "weak_lead", "descriptively_common", "probably_recorder_grammar"]


def test_report_lists_all_sessions(spark, monkeypatch):
    monkeypatch.setattr(report, "judged", lambda flow, eligible: spark.createDataFrame([], "id string, name string, k int, marks array<string>, sessions int, occurrences int, variants int, strength string, rank int, subsumed_by string, variant_of string"))
    small = ledger(spark, SF)
    many = small.limit(1).drop("session_id").crossJoin(spark.range(700).select(F.concat(F.lit("s"), "id").alias("session_id")))
    document = report.facts(many.select(*small.columns), "many")
    assert len(document["sessions"]) == 700 and document["skipped"] == {"too_few_actions": 700}
    assert "0 of 700 sessions are eligible" in report.render(document)


def test_append_takes_all_emissions(spark):
    rows = QUERIES["s13_append_all"](spark, SF).collect()
    records = {r.session_id: r.n for r in ledger(spark, SF).groupBy("session_id").agg(F.count("*").alias("n")).collect()}
    assert len(rows) == sum(records.values())
    for name, n in records.items():
        own = sorted((r for r in rows if r.file_name == f"{name}.ndjson"), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(1, n + 1))
        assert [r.sequence for r in own if r.written] == list(range(n + 1, n + 1 + sum(r.written for r in own)))
        assert all(r.written == (r.refused is None) for r in own) and any(r.written for r in own) == (int(name) % 7 == 0)


def test_scans_take_all_dimensions_and_lengths(spark):
    series = {(r.session_id, r.dimension): len(r.x) for r in statistics._profile_series(spark, SF).select("session_id", "dimension", "x").collect()}
    want = {(s, d, m) for (s, d), n in series.items() for m in (2, 4, 8, 16, 32, 64, 128) if n > m}
    assert len({d for _, d, _ in want}) > 2
    for name in ("q21_motifs_discords", "q21_all_profiles"):
        assert {tuple(r) for r in QUERIES[name](spark, SF).select("session_id", "dimension", "m").distinct().collect()} == want
