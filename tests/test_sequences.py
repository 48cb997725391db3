"""Alignment, nulls, profiles and tails against plain versions."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import lcg
from chronoloom.operators import align, nulls, profile
from chronoloom.operators import sequence as sequence_ops


def plain_alignment(a, x, b, y):
    """The textbook programme with a backtrack that prefers the diagonal, then deletion."""
    k, m = len(a), len(b)
    time = lambda i, j: 0.5 * min(1, abs(math.log((x[i] + 100) / (y[j] + 100))) / math.log(4)) if i and j else 0.0
    cost = [[float(i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(k + 1)]
    for i, j in itertools.product(range(1, k + 1), range(1, m + 1)):
        cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]) + time(i - 1, j - 1), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    i, j, out = k, m, Counter()
    while i or j:
        step = (a[i - 1] != b[j - 1]) + time(i - 1, j - 1) if i and j else 0
        if i and j and abs(cost[i][j] - cost[i - 1][j - 1] - step) <= 1e-12:
            out["matches" if a[i - 1] == b[j - 1] else "substitutions"] += 1
            out["timing_cost"] += time(i - 1, j - 1)
            i, j = i - 1, j - 1
        elif i and abs(cost[i][j] - cost[i - 1][j] - 1) <= 1e-12:
            out["deletions"] += 1
            i -= 1
        else:
            out["insertions"] += 1
            j -= 1
    return out


@pytest.mark.parametrize("k", [3, 4, 6])
def test_alignments_agree(spark, k):
    r = random.Random(k)
    rows = [(i, [r.choice("abcd") for _ in range(k)], [r.choice([0, 50, 200, 1000, 90000]) for _ in range(k)], [r.choice("abcd") for _ in range(k)], [r.choice([0, 50, 200, 90000]) for _ in range(k)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a_marks array<string>, a_gaps array<bigint>, b_marks array<string>, b_gaps array<bigint>")
    unrolled = {x.id: x for x in align.align(df, k).collect()}
    code = {m: i for i, m in enumerate("abcd")}
    for i, a, x, b, y in rows:
        want = plain_alignment(a, x, b, y)
        matrix = align.window_alignments(np.array([code[m] for m in a]), np.array(x, float), np.array([code[m] for m in b]), np.array(y, float), k)
        for name in ("matches", "substitutions", "deletions", "insertions", "timing_cost"):
            assert unrolled[i][name] == pytest.approx(want[name])
            assert float(matrix[name][0, 0]) == pytest.approx(want[name])


def test_agreement_tail_against_all_permutations():
    population, target = list("aabbc"), list("abc")
    counts = Counter(population)
    draws = list(itertools.permutations(population, 3))
    for k in range(4):
        want = sum(sum(x == y for x, y in zip(d, target, strict=True)) >= k for d in draws) / len(draws)
        assert align.agreement_tail(target, counts, 5, k) == pytest.approx(max(want, 2.3e-308), abs=1e-12)


def test_nulls_keep_what_they_promise():
    marks = [random.Random(4).choice("aabbcde") for _ in range(120)]
    assert Counter(lcg.order_null(marks)) == Counter(marks)
    for seed in range(5):
        got = lcg.doublet_null(marks, seed)
        assert Counter(zip(got, got[1:], strict=False)) == Counter(zip(marks, marks[1:], strict=False))
        assert got[0] == marks[0] and got[-1] == marks[-1]
        walk, fell = lcg.markov_null(marks, seed)
        assert len(walk) == len(marks) and fell >= 0
    assert sorted(lcg.timing_null([0, 5, 7, 9])) == [0, 5, 7, 9]
    assert lcg.doublet_null(["a", "b"], 1) == ["a", "b"]


def test_complete_search_is_greedy_over_the_ranking():
    r = random.Random(9)
    ma, mb = [r.choice("abc") for _ in range(20)], [r.choice("abc") for _ in range(18)]
    ga, gb = [r.randrange(1000) for _ in ma], [r.randrange(1000) for _ in mb]
    k, counts = 3, Counter(ma + mb)
    ranking = sorted((round((lambda w: w["substitutions"] + w["deletions"] + w["insertions"] + w["timing_cost"])(plain_alignment(ma[i : i + k], ga[i : i + k], mb[j : j + k], gb[j : j + k])) / (k + 0.5 * (k - 1)), 12), i, j) for i in range(18) for j in range(16))
    kept = []
    for _, i, j in ranking:
        if all(abs(i - p) >= k and abs(j - q) >= k for p, q in kept):
            kept.append((i, j))
        if len(kept) == 5:
            break
    want = sorted((sum(-math.log(counts[ma[i + t]] / 38) for t in range(k) if ma[i + t] == mb[j + t]) for i, j in kept), reverse=True)
    assert nulls.complete_search(ma, ga, mb, gb, k) == pytest.approx(want)


def test_matrix_profile_hand_vectors():
    best, place, constant = profile.matrix_profile(np.array([1.0, 2, 3, 4, 1, 2, 3, 4]), 4)
    assert best[0] == pytest.approx(0, abs=1e-4) and place[0] == 4 and not constant.any()
    best, _, constant = profile.matrix_profile(np.ones(12), 4)
    assert constant.all() and (best == 0).all()


def test_haar_energy_identity(spark):
    rows = [("s", str(n), [float((i * 7) % 5) for i in range(n)]) for n in range(1, 20)]
    levels = profile.haar(spark.createDataFrame(rows, "session_id string, dimension string, x array<double>"), 10)
    for r in profile.silence(levels).collect():
        assert r.residual == pytest.approx(0, abs=1e-9)


def test_seeds_differ_by_side_and_realisation():
    assert len({lcg.null_seed(r, s) for r in range(50) for s in range(2)}) == 100
    assert lcg.Lcg(6).state == 7


def test_greedy_count(spark):
    from chronoloom.operators.corpus import greedy_count

    row = spark.createDataFrame([(list("aaaaa"), list("aa"))], "l array<string>, s array<string>")
    assert row.select(greedy_count(F.col("l"), F.col("s")).alias("n")).first().n == 2


def plain_profile(x, m):
    """Every pair of windows, normalised one by one."""
    w = [np.array(x[i : i + m], float) for i in range(len(x) - m + 1)]
    flat = [v.max() == v.min() for v in w]
    z = [v * 0 if f else (v - v.mean()) / v.std() for v, f in zip(w, flat, strict=True)]
    out = []
    for i in range(len(w)):
        near = [(round(0.0 if flat[i] and flat[j] else 2.0 * m if flat[i] or flat[j] else float(((z[i] - z[j]) ** 2).sum()), 6), j) for j in range(len(w)) if abs(i - j) > profile.zone_of(m)]
        d, j = min(near, default=(None, None))
        out.append((i, d, j, bool(flat[i] or (j is not None and flat[j]))))
    return out


SERIES = {"counts": [0, 0, 0, 0, 0, 1, 3, 0, 2, 1, 3, 0, 2, 0, 0, 0, 0, 0, 0, 5, 1, 3, 0, 2], "flat": [2] * 9, "parts": [0.5, 1.25, -3.0, 0.5, 1.5, 2.75, 0.5, 1.25, -3.0, 0.5, 1e6], "short": [1, 2]}


@pytest.mark.parametrize("small", [0, 512])
def test_one_tile_gives_the_plain_profile(small):
    for x in SERIES.values():
        for m in (2, 4, 8):
            if len(x) > m:
                held, profile.SMALL = profile.SMALL, small
                best, place, constant = profile.matrix_profile(np.array(x, float), m)
                profile.SMALL = held
                want = plain_profile(x, m)
                assert place.tolist() == [-1 if j is None else j for _, _, j, _ in want]
                assert best.tolist() == pytest.approx([math.inf if d is None else d**0.5 for _, d, _, _ in want], abs=1e-3)


@pytest.mark.parametrize("tile", [3, 7, 1 << 14])
def test_tiles_as_rows_give_the_plain_profile(spark, tile):
    rows = spark.createDataFrame([("s", d, [float(v) for v in x]) for d, x in SERIES.items()], "session_id string, dimension string, x array<double>")
    got = {}
    for r in profile.profiles(rows, (2, 4, 8), tile).collect():
        got.setdefault((r.dimension, r.m), []).append((r.start, None if r.distance is None else round(r.distance**2, 6), r.nearest, r.masked))
    want = {(d, m): plain_profile(x, m) for d, x in SERIES.items() for m in (2, 4, 8) if len(x) > m}
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("tile", [5, 1 << 14])
def test_scans(spark, tile):
    x = [float(v) for v in SERIES["counts"]]
    rows = spark.createDataFrame([("s", "counts", x), ("s", "flat", [2.0] * 9)], "session_id string, dimension string, x array<double>")
    found = {r.dimension: r for r in profile.scans(rows, (4,), 2, tile).collect()}
    r, plain = found["counts"], plain_profile(x, 4)
    seen = sorted((d, i, j) for i, d, j, hidden in plain if d is not None and not hidden)
    assert (r.subsequences, r.constant_subsequences) == (len(plain), sum(len(set(x[i : i + 4])) == 1 for i in range(len(plain))))
    assert (r.motifs[0].a, r.motifs[0].b) == tuple(sorted(seen[0][1:])) and r.motifs[0].distance == pytest.approx(seen[0][0] ** 0.5, abs=1e-3)
    assert r.discords[0].distance == pytest.approx(seen[-1][0] ** 0.5, abs=1e-3)
    null = lcg.Lcg(lcg.SHUFFLE_SEED, odd=False).shuffle(x)
    least = min(d for _, d, _, hidden in plain_profile(null, 4) if d is not None and not hidden)
    assert r.null_best == pytest.approx(least**0.5, abs=1e-3) and r.separation == pytest.approx((r.null_best - r.motifs[0].distance) / 4)
    assert found["flat"].motifs == [] and found["flat"].constant_subsequences == 6 and found["flat"].separation is None


def test_long_series_is_many_rows_of_work(spark):
    r = np.random.default_rng(3)
    x = r.poisson(2, 6000).astype(float)
    x[4000:4032] = x[100:132]  # a motif far apart
    rows = spark.createDataFrame([("s", "d", x.tolist())], "session_id string, dimension string, x array<double>")
    found = profile.profiles(rows, (32,), 1024).orderBy("start").collect()
    best, place, _ = profile.matrix_profile(x, 32)
    assert [f.nearest for f in found] == place.tolist() and [f.distance for f in found] == pytest.approx(best.tolist())
    assert found[100].nearest == 4000 and found[100].distance == 0


def test_linked_regions_of_far_buckets(spark):
    scanned = spark.createDataFrame([("s", "d", 4, [(500, 9000, 0.5)])], "session_id string, dimension string, m int, motifs array<struct<a:int,b:int,distance:double>>")
    ms = 12_000_000
    regions = spark.createDataFrame([("s", "far", 0, 600 * ms, 8000 * ms, 10**12), ("s", "none", 0, 10, 20, 30), ("s", "edge", 0, 501 * ms, 9001 * ms, 10**12)], "session_id string, region string, a_from long, a_to long, b_from long, b_to long")
    found = {r.region: (r.linking, r.overlapping) for r in profile.linked_regions(scanned, regions, ms).collect()}
    assert found == {"far": (0, 0), "none": (None, None), "edge": (None, 0)}


def plain_shared_run(a, b):
    return max((n for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))]), default=0)


def test_automaton_finds_the_longest_shared_run():
    r = random.Random(4)
    for _ in range(300):
        a, b = (r.choices("abc"[: r.randrange(1, 4)], k=r.randrange(0, 14)) for _ in range(2))
        held = sequence_ops.automaton(a)
        assert sequence_ops.longest_run_in(held, b) == plain_shared_run(a, b) and len(held[0]) <= 2 * len(a) + 1


def test_long_runs_of_one_mark_end(spark):
    rows = spark.range(100_000).select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("session_id"), F.col("id").alias("pos"), F.lit("m").alias("mark"))
    rows = rows.where("session_id = 'x' or pos < 70000").unionByName(spark.createDataFrame([("z", 0, "other")], "session_id string, pos long, mark string"))
    pairs = spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string")
    assert {(r.a, r.b): r.longest for r in sequence_ops.longest_shared_run(rows, pairs).collect()} == {("x", "y"): 70_000, ("x", "z"): 0}


def test_null_fidelity_and_identity(spark):
    events = spark.createDataFrame([("s", i, m) for i, m in enumerate("abab")] + [("t", 0, "a"), ("t", 1, "a")], "session_id string, pos long, mark string")
    made = spark.createDataFrame([("s", 0, list("abab")), ("s", 1, list("bbaa")), ("s", 2, list("bbaa")), ("t", 0, list("aa"))], "session_id string, replicate int, marks array<string>")
    got = {(r.session_id, r.replicate): r for r in sequence_ops.null_fidelity(events, made, "replicate").collect()}
    same, other = got["s", 0], got["s", 1]
    assert (same.transition_tv, same.max_state_tv, same.marginal_tv, same.absent) == (0, 0, 0, 0) and got["t", 0].transition_tv == 0
    # ab, ba, ab against bb, ba, aa: two thirds of ab are gone, bb and aa are new.
    assert other.transition_tv == pytest.approx(2 / 3) and other.absent == 1 and other.marginal_tv == 0
    counted = {r.session_id: (r.realizations, r.identical, r.distinct, r.identical_fraction) for r in sequence_ops.null_identity(events, made).collect()}
    assert counted == {"s": (3, 1, 2, pytest.approx(1 / 3)), "t": (1, 1, 1, 1.0)}
