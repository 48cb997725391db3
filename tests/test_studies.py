"""Studies without SQL against plain versions: refinement, retained search, evidence, draws."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from chronoloom.functions import controls, lcg
from chronoloom.operators import align, nulls, studies
from chronoloom.plans import statistics
from chronoloom.plans import studies as plans

from .test_sequences import plain_alignment


def total(a, x, b, y):
    w, longest = plain_alignment(a, x, b, y), max(len(a), len(b))
    return (w["substitutions"] + w["deletions"] + w["insertions"] + w["timing_cost"]) / (longest + 0.5 * (longest - 1))


def sequence(r, n):
    return [r.choice("abcde") for _ in range(n)], [r.randrange(2000) for _ in range(n)]


@pytest.mark.parametrize("at", [(4, 8, 5, 9), (0, 3, 1, 5), (9, 14, 10, 14)])
def test_refinement_scores_every_move(at):
    r = random.Random(sum(at))
    (ma, ga), (mb, gb) = sequence(r, 14), sequence(r, 15)
    moved = []
    for d in itertools.product(range(-2, 3), repeat=4):
        a, b, c, e = (p + q for p, q in zip(at, d, strict=True))
        if a >= 0 and c >= 0 and b <= 14 and e <= 15 and b - a >= 3 and e - c >= 3:
            moved.append((min(b - a, e - c), round(total(ma[a:b], ga[a:b], mb[c:e], gb[c:e]), 12), a, b, c, e))
    got = align.refined({"a": "x", "b": "y", "a_from": at[0], "a_to": at[1], "b_from": at[2], "b_to": at[3], "ma": ma, "ga": ga, "mb": mb, "gb": gb}, 2, 3)
    assert got["evaluated"] == len(moved) and got["rejected"] == 5**4 - len(moved)
    best = {n: min(x[1:] for x in moved if x[0] == n) for n in {x[0] for x in moved}}
    frontier, least = [], 9.0
    for n in sorted(best, reverse=True):
        if best[n][0] < least - 1e-12:
            least = best[n][0]
            frontier.append((n, best[n]))
    assert got["points"] == len(frontier)
    seed = round(total(ma[at[0] : at[1]], ga[at[0] : at[1]], mb[at[2] : at[3]], gb[at[2] : at[3]]), 12)
    good = [x for x in frontier if x[1][0] <= seed + 1e-12]
    n, want = good[0] if good else frontier[-1]
    assert got["retained"] == n and got["total"] == pytest.approx(want[0]) and got["seed_total"] == pytest.approx(seed)
    assert align.refined({"a": "x", "b": "y", "a_from": 0, "a_to": 2, "b_from": 0, "b_to": 4, "ma": ma, "ga": ga, "mb": mb, "gb": gb}, 2, 3) is None


def test_retained_search(spark):
    r, k = random.Random(5), 3
    (ma, ga), (mb, gb) = sequence(r, 20), sequence(r, 17)
    rows = spark.createDataFrame([("x", ma, ga), ("y", mb, gb), ("z", ["a"], [0])], "session_id string, marks array<string>, gaps array<bigint>")
    ranking = sorted((round(total(ma[i : i + k], ga[i : i + k], mb[j : j + k], gb[j : j + k]), 12), i, j) for i in range(18) for j in range(15))
    kept = []
    for t, i, j in ranking:
        if all(abs(i - p) >= k and abs(j - q) >= k for _, p, q in kept):
            kept.append((t, i, j))
    found = nulls.retained_search(rows, spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string"), (k, 30), 40).orderBy("rank").collect()
    assert [(r.a_start, r.b_start) for r in found] == [(i, j) for _, i, j in kept]
    assert [r.total for r in found] == pytest.approx([t for t, _, _ in kept])
    assert all(r.considered == 18 * 15 and r.exact == (ma[r.a_start : r.a_start + k] == mb[r.b_start : r.b_start + k]) for r in found)


def plain_search(ma, ga, mb, gb, k, keep):
    """All windows ranked by the alignment's own definition, the greedy pass, and the pooled surprisals."""
    n, m = len(ma) - k + 1, len(mb) - k + 1
    ranking = sorted((round(total(ma[i : i + k], ga[i : i + k], mb[j : j + k], gb[j : j + k]), 12), i, j) for i in range(n) for j in range(m))
    kept = []
    for _, i, j in ranking:
        if len(kept) < keep and all(abs(i - p) >= k and abs(j - q) >= k for p, q in kept):
            kept.append((i, j))
    counts, every = Counter(ma) + Counter(mb), len(ma) + len(mb)
    return sorted((sum(-np.log(counts[x] / every) for x, y in zip(ma[i : i + k], mb[j : j + k], strict=True) if x == y) for i, j in kept), reverse=True)


@pytest.mark.parametrize("marks", ["ab", "abcdefgh"])
def test_all_replicates_at_once_equal_a_plain_search(marks):
    """Few marks give many ties, which the rounded programme has to resolve exactly."""
    r, spans = random.Random(len(marks)), (3, 4, 6)
    ma, ga = [r.choice(marks) for _ in range(15)], [-1, *(r.choice([0, 0, 100, 900]) for _ in range(14))]
    mb, gb = [r.choice(marks) for _ in range(12)], [-1, *(r.choice([0, 0, 100, 900]) for _ in range(11))]
    va, vb = nulls._realised(ma, mb, -1, 9, 9, "order")
    found = nulls.all_searches(va, vb, nulls.timing_steps(ga, gb), (*spans, 14))
    alone = nulls.all_searches(va[:, :1], vb[:, :1], nulls.timing_steps(ga, gb), spans)
    name = dict(enumerate(dict.fromkeys([*ma, *mb])))
    for k in spans:
        for c in range(10):
            want = plain_search([name[x] for x in va[:, c]], ga, [name[x] for x in vb[:, c]], gb, k, nulls.KEEP)
            assert [x for x in found[k][c] if x > -np.inf] == pytest.approx(want)
            assert c or [x for x in alone[k][0] if x > -np.inf] == pytest.approx(want)
    assert (found[14] == -np.inf).all()


def corpus_of(spark, seed=9, n=5):
    r = random.Random(seed)
    figure = list("cadbecafdb")
    rows = [(s, *sequence(r, 30)) for s in "uvwxyz"[:n]]
    for _, m, _ in rows[:2]:  # a figure that two of them share
        m[8:18] = figure
    rows.append(("short", ["a", "b"], [-1, 5]))
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2)]
    return spark.createDataFrame(rows, "session_id string, marks array<string>, gaps array<bigint>"), spark.createDataFrame(pairs, "a string, b string")


@pytest.mark.parametrize("construction", ["order", "markov"])
def test_calibration_from_parts_equals_that_of_all_searches(spark, construction):
    rows, pairs = corpus_of(spark, n=3)
    key = lambda r: (r.a, r.b, r.k)
    parts = sorted(nulls.calibrated(rows, pairs, (3, 6, 40), 21, construction).collect(), key=key)
    whole = sorted(nulls.tail(nulls.searches(rows, pairs, (3, 6, 40), 21, construction)).collect(), key=key)
    assert len(parts) == len(whole) == 18
    for p, w in zip(parts, whole, strict=True):
        for name in w.asDict():
            x, y = p[name], w[name]
            assert x == y or x == pytest.approx(y), (key(p), name)


def test_assay_in_waves_has_the_verdict_of_the_whole_budget(spark):
    rows, pairs = corpus_of(spark)
    budget, spans = 60, (3, 6, 10)
    found = {(r.a, r.b, r.k): r for r in nulls.assay(rows, pairs, spans, budget, (4, 16)).collect()}
    whole = nulls.searches(rows, pairs, spans, budget).collect()
    observed = {(r.a, r.b, r.k): r.t for r in whole if r.replicate < 0}
    assert set(found) == set(observed) and len(found) == 45
    for cell, t in observed.items():
        samples = {r.replicate: r.t for r in whole if (r.a, r.b, r.k) == cell and r.replicate >= 0}
        reach = [i for i in sorted(samples) if t is None or (samples[i] is not None and samples[i] >= t)]
        r = found[cell]
        assert r.certified == (t is not None and any(x is not None for x in samples.values()) and not reach)
        if reach:
            end = next(w for w in (4, 16, budget) if w > reach[0])
            assert (r.first_refuting, r.searched, r.refuting) == (reach[0], end, sum(i < end for i in reach))
        else:
            assert (r.first_refuting, r.searched, r.wave) == (None, budget, None)
    assert any(r.certified for r in found.values()) and {r.wave for r in found.values()} >= {1, None}


def test_evidence_of_fixed_spans(spark):
    r, k, n = random.Random(6), 4, 60
    (ma, ga), (mb, gb) = sequence(r, 12), sequence(r, 15)
    rows = spark.createDataFrame([("x", ma, ga), ("y", mb, gb)], "session_id string, marks array<string>, gaps array<bigint>")
    spans = spark.createDataFrame([("x", "y", 3, 6)], "a string, b string, a_start int, b_start int")
    got = {e.part: e for e in nulls.evidence(rows, spans, k, n).collect()}
    at = lambda m, g, s: (m[s : s + k], g[s : s + k])
    samples = [total(*at(lcg.order_null(ma, lcg.null_seed(i, 0)), ga, 3), *at(lcg.order_null(mb, lcg.null_seed(i, 1)), gb, 6)) for i in range(n)]
    own = total(*at(ma, ga, 3), *at(mb, gb, 6))
    e = got["total"]
    assert e.observed == pytest.approx(own) and e.null_mean == pytest.approx(np.mean(samples)) and e.null_stddev == pytest.approx(np.std(samples))
    assert (e.null_min, e.null_max) == pytest.approx((min(samples), max(samples)))
    assert abs(e.at_or_below - sum(s <= own for s in samples)) <= sum(abs(s - own) < 1e-9 for s in samples)
    assert e.empirical_p == (1 + e.at_or_below) / (n + 1) and sum(map(int, e.histogram.split(","))) == n
    assert 0 <= got["event_norm"].observed <= 1


def test_shared_permutations_are_the_order_nulls():
    marks = [random.Random(1).choice("abcd") for _ in range(30)]
    for side in (0, 1):
        for r, p in enumerate(nulls.permutations(30, side, 7)):
            assert [marks[i] for i in p] == lcg.order_null(marks, lcg.null_seed(r, side))


def test_measures():
    same, run, ratio = nulls.measures(np.array([0, 0, 1, 2, 2, 2]))
    assert same == 3 / 5 and run == 2
    entropy = lambda c: -sum(v / sum(c) * np.log(v / sum(c)) for v in c)
    assert ratio == pytest.approx(entropy([1, 1, 1, 2]) / (2 * entropy([2, 1, 3])))
    assert nulls.measures(np.array([4])) == (None, 1.0, None) and nulls.measures(np.array([1, 1])) == (1.0, 2.0, None)


def test_null_structure_and_draws(spark):
    r = random.Random(8)
    rows = spark.createDataFrame([(s, *sequence(r, 40)) for s in "xy"], "session_id string, marks array<string>, gaps array<bigint>")
    found = nulls.structure_nulls(rows, ("order", "doublet"), 15).collect()
    assert len(found) == 2 * 2 * 3 and Counter(x.measure for x in found) == dict.fromkeys(nulls.MEASURES, 4)
    # The doublet null keeps pairs of neighbours, so these measures can't move.
    assert all(not x.outside and x.exceedances == 15 for x in found if x.construction == "doublet")
    pair = spark.createDataFrame([("x", "y")], "a string, b string")
    effect = nulls.selection_effect(nulls.searches(rows, pair, (3, 4), 12), nulls.arbitrary_scores(rows, pair, (3, 4))).collect()
    assert len(effect) == 2 and all(e.confirmed for e in effect)
    raw = lcg.Lcg(nulls.DRAW_SEED)
    assert nulls.raw_draws(4).tolist() == [raw.below(1 << 31) for _ in range(4)]


def test_perturbed_figures():
    every = studies.perturbations()
    assert len(every) == 9 and {len(m) for m, _ in every.values()} == {7, 8, 9}
    assert every["exact"][1] == [-1, 200, 300, 300, 300, 300, 300, 400]
    assert every["100% timing jitter"][1] == [-1, 0, 600, 0, 600, 0, 600, 0] and every["300% timing jitter"][1][1] == 0
    a = every["exact"]
    assert total(*a, *every["exact"]) == 0
    far = {name: total(*a, *b) for name, b in every.items()}
    assert far["10% timing jitter"] < far["30% timing jitter"] < far["100% timing jitter"] < far["unrelated sequence"]


#: Published tails of the controls of symbols drawn one by one, at spans 3, 4, 6, 8 and 12.
PUBLISHED = {"negative": (0.657, 0.825, 0.425, 0.035, 0.358), "positive": (0.396, 0.109, 0.005, 0.001, 0.001)}


def test_controls_calibrate_as_published(spark):
    got = {(r.a, r.k): r for r in plans.control_calibration(spark, None).collect()}
    for name, tails in PUBLISHED.items():
        assert [got[f"{name}-a", k].tail for k in plans.LADDER] == pytest.approx(list(tails), abs=1e-9)
    # A walk's planted figure is no more than its own steps explain, until it is long.
    assert len(got) == 20 and not any(got["first-order negative-a", k].certified for k in plans.LADDER)


def test_walks_keep_to_their_steps():
    for name in ("first-order negative control", "first-order positive control"):
        for _, marks, gaps in controls.CONTROLS[name]:
            path = [int(m[-2:]) for m in marks]
            assert all(b in controls.followers(a) for a, b in itertools.pairwise(path)) and gaps[0] == -1
            held = sum(tuple(path[i : i + 12]) == controls.WALK_FIGURE for i in range(len(path) - 11))
            assert held == (2 if "positive" in name else 0)


def test_selection_effect_as_published(spark):
    r = statistics._selection(spark, None).first()
    assert (round(r.arbitrary_median, 4), round(r.selected_median, 4), round(r.margin, 4), r.confirmed) == (1.6094, 11.0187, 3.6344, True)
