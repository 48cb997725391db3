"""What larger tables have shown: ties in the last bit, and work that outgrew its limits."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom import registry
from chronoloom.functions import lcg
from chronoloom.operators import align
from chronoloom.operators import nulls as null_ops
from chronoloom.operators import profile
from chronoloom.operators import sequence as sequence_ops
from chronoloom.sources.events import ledger

from .oracle import check


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Sessions whose best pairs of windows tie but for the last bit of a logarithm."""
    out = tmp_path_factory.mktemp("tied")
    duckdb.sql(f"COPY (SELECT event_id + c * 100000 AS event_id, ts, user_id + c * 1500 AS user_id, event_type, value, props FROM '/root/testdata/sf0.1/events.parquet', (SELECT unnest([1, 2]) AS c) WHERE user_id IN (627, 592)) TO '{out}/events.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["q02_top_pairs", "q02_top_varied_pairs", "q03_neighbours", "k07_frontier"])
def test_ties_in_the_last_bit_are_ranked_as_by_sql(spark, tied, name):
    assert check(spark, registry.queries()[name], registry.oracle_sql()[name], tied) >= 4


def plain_total(a, b, x, y):
    """The alignment's total as the SQL states it, step by step, with the C library's logarithm."""
    k, table = len(a), {}
    for i in range(k + 1):
        for j in range(k + 1):
            if not i or not j:
                table[i, j] = (float(i + j), i + j, 0.0)
                continue
            q = 0.5 * min(1.0, abs(math.log((x[i - 1] + 100.0) / (y[j - 1] + 100.0))) / math.log(4.0)) if i > 1 and j > 1 else 0.0
            (cd, ed, td), (ce, ee, te), (ci, ei, ti) = table[i - 1, j - 1], table[i - 1, j], table[i, j - 1]
            same = a[i - 1] == b[j - 1]
            cd, ce, ci = cd + (0.0 if same else 1.0) + q, ce + 1.0, ci + 1.0
            best = (ed + (not same), td + q) if cd - min(ce, ci) <= 1e-12 else (ee + 1, te) if ce - ci <= 1e-12 else (ei + 1, ti)
            table[i, j] = (min(cd, ce, ci), *best)
    _, event, timing = table[k, k]
    return (event * 1.0 + timing) / (k + 0.5 * (k - 1))


@pytest.mark.parametrize("start", [None, 0, 3])
def test_totals_of_own_pairs_have_every_digit_of_the_sql(spark, tied, start):
    rows = null_ops.arrays(sequence_ops.project(ledger(spark, tied)))
    held = {r.session_id: r for r in rows.collect()}
    found = align.own_pairs(rows, 4, start=start).collect()
    n = {s: len(r.marks) - 3 for s, r in held.items()}
    assert len(found) == sum(sum(1 for i in ([start] if start is not None else range(m)) for j in range(m) if (abs(j - i) if start is not None else j - i) >= 4) for m in n.values())
    for r in found[::7]:
        s, i, j = held[r.session_id], slice(r.a_start, r.a_start + 4), slice(r.b_start, r.b_start + 4)
        assert r.total == plain_total(s.marks[i], s.marks[j], s.gaps[i], s.gaps[j])


def test_own_pairs_in_parts_keep_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    v, g = rng.integers(0, 4, 40), rng.integers(0, 5, 40) * 1000.0
    for top, varied, both in ((5, False, False), (5, True, False), (None, False, True)):
        whole = [*align._own_ranked(v, g, 4, 0, 37 if not both else 1, top, varied, both)]
        monkeypatch.setattr(align, "HELD", 50)
        parts = [*align._own_ranked(v, g, 4, 0, 37 if not both else 1, top, varied, both)]
        monkeypatch.undo()
        for c in whole[0]:
            assert np.array_equal(np.concatenate([x[c] for x in whole]), np.concatenate([x[c] for x in parts]))


def test_whole_profiles_are_those_of_tiles(spark):
    """Short series go without tiles to merge: the same places, flags and distances, ties and lone windows included."""
    rng = np.random.default_rng(9)
    series = {f"{i}": rng.poisson(rate, n).astype(float) for i, (rate, n) in enumerate([(0.02, 90), (0.3, 77), (3, 60), (0, 12), (0.1, 9), (0.5, 3)])}
    series["halves"], series["one"] = rng.integers(0, 3, 50) / 2, np.array([0.0] * 6 + [1.0] + [0.0] * 6)
    rows = spark.createDataFrame([("s", d, x.tolist()) for d, x in series.items()], "session_id string, dimension string, x array<double>")
    lengths = (2, 4, 8, 32, 64)
    key = lambda r: (r.dimension, r.m, r.start)
    whole, tiles = (sorted(profile.profiles(rows, lengths, whole=w).collect(), key=key) for w in (1024, 0))
    assert [(*key(r), r.nearest, r.masked) for r in whole] == [(*key(r), r.nearest, r.masked) for r in tiles] and len(whole) > 1000
    assert [r.distance for r in whole] == pytest.approx([r.distance for r in tiles], abs=1e-4)
    assert sorted(map(repr, profile.scans(rows, lengths).collect())) == sorted(map(repr, profile.scans(rows, lengths, whole=0).collect()))


@pytest.mark.parametrize("length", [1, 2, 3, 7, 40, 90])
@pytest.mark.parametrize("kinds", [1, 2, 5, 30])
def test_nulls_made_at_once_are_those_made_one_by_one(length, kinds):
    raw = np.random.default_rng(length * 31 + kinds).integers(0, kinds, length).tolist()
    place = {m: i for i, m in enumerate(dict.fromkeys(raw))}
    path = np.array([place[m] for m in raw])
    seeds = [lcg.null_seed(r, 1) for r in range(25)]
    assert null_ops.doublet_nulls(path, seeds).tolist() == [lcg.doublet_null(path.tolist(), s) for s in seeds]
    assert null_ops.doublet_nulls(path, seeds, 1).tolist() == [lcg.doublet_null(path.tolist(), s, 1) for s in seeds]
    assert null_ops.markov_nulls(path, seeds).tolist() == [lcg.markov_null(path.tolist(), s)[0] for s in seeds]


def test_entropies_of_equal_counts_are_equal():
    rng = np.random.default_rng(2)
    rows = np.array([rng.permutation(np.repeat(np.arange(9), np.arange(9) + 1)) for _ in range(20)])
    p = np.arange(1, 10) / 45
    found = null_ops.entropies(rows)
    assert len(set(found.tolist())) == 1 and found[0] == pytest.approx(-(p * np.log(p)).sum(), abs=1e-12)


def test_structure_against_nulls_made_one_by_one(spark):
    marks = ["a", "b", "a", "c", "c", "b", "a", "d", "a", "b"]
    rows = spark.createDataFrame([("s", marks, [0] * 10), ("one", ["a"], [0]), ("same", ["a"] * 6, [0] * 6)], "session_id string, marks array<string>, gaps array<bigint>")
    found = {(r.session_id, r.construction, r.measure): r for r in null_ops.structure_nulls(rows, ("order", "doublet", "markov"), 40).collect()}
    for kind in ("order", "doublet", "markov"):
        own = [null_ops.CONSTRUCTIONS[kind](marks, lcg.null_seed(r, 0)) for r in range(40)]
        r = found["s", kind, "immediate repetition rate"]
        rates = sorted(sum(x == y for x, y in zip(m, m[1:], strict=False)) / 9 for m in own)
        assert (r.identical, r.distinct) == (own.count(marks), len({*map(tuple, own)}))
        assert (r.null_min, r.null_max, r.exceedances) == (rates[0], rates[-1], sum(x >= r.observed for x in rates))
    assert all(found["s", "doublet", m].exceedances == 40 for m in null_ops.MEASURES)  # pairs stay, so all measures do
    assert {k[2] for k in found if k[0] == "one"} == {"mean run length"} and {k[2] for k in found if k[0] == "same"} == {*null_ops.MEASURES[:2]}


def test_fidelity_moves_only_figures(spark):
    """Nulls are compared in the session's row of work: the plan has no more exchanges than gathering sequences takes."""
    rows = spark.createDataFrame([("s", list("abacabad"), [0] * 8), ("t", ["a"], [0]), ("u", list("ab"), [0, 0])], "session_id string, marks array<string>, gaps array<bigint>")
    found = null_ops.fidelity(rows, ("order", "markov"), 5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    held = spark.createDataFrame([(r.session_id, i, m) for r in rows.collect() for i, m in enumerate(r.marks)], "session_id string, pos long, mark string")
    for kind in ("order", "markov"):
        made = null_ops.replicates(rows, kind, 5).select(F.concat_ws("#", "session_id", "replicate").alias("b"), F.col("session_id").alias("a"), "marks").localCheckpoint()
        both = held.unionByName(made.select(F.col("b").alias("session_id"), F.posexplode("marks").alias("pos", "mark")))
        want = {(r.a, int(r.b.split("#")[1])): r for r in sequence_ops.divergence(both, made.select("a", "b")).collect()}
        got = {(r.session_id, r.replicate): r for r in found.where(f"construction = '{kind}'").collect()}
        assert got.keys() == want.keys() and len(got) == 10
        for k, r in got.items():
            assert (r.transition_tv, r.marginal_tv, r.absent) == (pytest.approx(want[k].transition_tv), pytest.approx(want[k].marginal_tv), want[k].absent)
            assert r.max_state_tv == (None if want[k].max_state_tv is None else pytest.approx(want[k].max_state_tv))


def test_surprisals_of_the_best_pairs_are_those_of_each_step(spark, tied):
    """The search to the score in one row of work gives what ranking, joining and scoring one by one give."""
    events = sequence_ops.project(ledger(spark, tied))
    rows, pairs = null_ops.arrays(events), sequence_ops.all_pairs(events)
    got = {(r.k, r.a, r.b, r.a_start, r.b_start): r.surprisal for r in align.best_surprisals(rows, pairs, (3, 6), 20).collect()}
    for k in (3, 6):
        best = align.with_counts(align.with_marks(align.cross_pairs(rows, pairs, k, 20), sequence_ops.windows(events, k)), events)
        want = {(k, r.a, r.b, r.a_start, r.b_start): r.surprisal for r in align.surprisal(best).collect()}
        assert {x for x in got if x[0] == k} == set(want) and len(want) == 20 * pairs.count()
        assert all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_tails_at_once_are_those_one_by_one():
    rng = np.random.default_rng(6)
    for n in (1, 3, 6, 12):
        marks, counts = rng.integers(0, 5, (200, n)), np.array([0, 1, 3, 9, 20])
        agreed, total = rng.integers(0, n + 1, 200), np.full(200, int(counts.sum()))
        found = align.agreement_tails(marks, counts[marks], total, agreed)
        want = [align.agreement_tail(m.tolist(), dict(enumerate(counts.tolist())), 33, int(k)) for m, k in zip(marks, agreed, strict=True)]
        assert found.tolist() == pytest.approx(want, rel=1e-9)


def test_evidence_of_the_best_pairs_is_that_of_each_step(spark, tied):
    events = sequence_ops.project(ledger(spark, tied))
    rows, pairs = null_ops.arrays(events), sequence_ops.all_pairs(events)
    got = sorted(map(repr, null_ops.best_evidence(rows, pairs, (3, 8), 60).collect()))
    want = [repr(r) for k in (3, 8) for r in null_ops.evidence(rows, align.cross_pairs(rows, pairs, k, 1), k, 60).collect()]
    assert got == sorted(want) and len(got) == 2 * 2 * pairs.count()


def test_events_and_timing_are_those_of_all_figures():
    rng = np.random.default_rng(8)
    for k in (1, 3, 7):
        wa, wb, late = rng.integers(0, 3, (k, 400)), rng.integers(0, 3, (k, 400)), rng.choice([0, 0.25, 0.5, 0.1], (k, k))
        event, timing = null_ops.event_and_timing(wa, wb, late)
        f = align.cell_figures(align.aligned_cells(k, k, lambda i, j: wa[i] == wb[j], lambda i, j: late[i, j], (400,))[k][k], k)  # noqa: B023
        assert np.array_equal(event, f["event_cost"]) and np.array_equal(timing, f["timing_cost"])


def test_file_eligibility_parses_lines_twice(spark, monkeypatch):
    """Once for the replays and once for the records of sound files, however often their figures are used."""
    from chronoloom.plans import studies
    from chronoloom.sources import recordings

    parsed, checked = [], recordings.checked
    monkeypatch.setattr(recordings, "checked", lambda files: parsed.append(1) or checked(files))
    found = studies.file_eligibility(spark, "/root/testdata/sf0.001")
    assert len(parsed) == 2
    assert found.count() == 17 and found.where("path like 'z-%'").count() == 2


def test_retained_search_of_each_span_begins_with_its_best_pair(spark, tied):
    """What a span's search uses up is a copy: the programme goes on with the gains for longer spans."""
    rows = null_ops.arrays(sequence_ops.project(ledger(spark, tied)))
    pairs = rows.select("session_id").crossJoin(rows.select(F.col("session_id").alias("b"))).where("session_id < b").withColumnRenamed("session_id", "a")
    found = {(r.a, r.b, r.k): (r.a_start, r.b_start, r.total) for r in null_ops.retained_search(rows, pairs, (3, 4, 6), 3).where("rank = 1").collect()}
    assert len(found) == 3 * pairs.count()
    for k in (3, 4, 6):
        for r in align.cross_pairs(rows, pairs, k, 1).collect():
            assert found[r.a, r.b, k][2] == pytest.approx(r.total, abs=1e-9)
