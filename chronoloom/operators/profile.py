"""Haar multiresolution and matrix profiles of dense series.

A series is one array per (session, dimension).  Haar levels are higher-order
functions over that array, so no level shuffles; the profile's distance matrix
is cut into tiles of diagonals, and a tile is a row of work.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lcg
from ..session import dealt
from .align import to_arrow


def series(dense: DataFrame) -> DataFrame:
    """session_id, dimension, x: values in order of buckets."""
    rows = dense.groupBy("session_id", "dimension").agg(F.sort_array(F.collect_list(F.struct("bucket", "value"))).alias("s"))
    return rows.select("session_id", "dimension", F.col("s.value").alias("x"))


def haar(rows: DataFrame, base_ms: int, levels: int = 24) -> DataFrame:
    """One row per series and level: detail coefficients, energy, and the sample that
    an odd length leaves over at that level."""
    steps = rows.select("session_id", "dimension", "x", F.array().cast("array<struct<level:int,detail:array<double>,remainder:double>>").alias("levels"))

    def step(state, level):
        x = state["x"]
        half = (F.size(x) / 2).cast("int")
        pair = lambda sign: F.transform(F.sequence(F.lit(0), half - 1), lambda k: (F.get(x, 2 * k) + sign * F.get(x, 2 * k + 1)) / math.sqrt(2))
        made = F.struct(level.alias("level"), pair(-1).alias("detail"), F.when(F.size(x) % 2 == 1, F.element_at(x, -1)).alias("remainder"))
        return F.when(F.size(x) < 2, state).otherwise(F.struct(pair(1).alias("x"), F.concat(state["levels"], F.array(made)).alias("levels")))

    folded = steps.select("session_id", "dimension", F.col("x").alias("samples"), F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.struct("x", "levels"), step).alias("s"))
    energy = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    per = folded.select("session_id", "dimension", "samples", F.col("s.x").alias("approximation"), F.explode_outer("s.levels").alias("l"))
    return per.select(
        "session_id",
        "dimension",
        "l.level",
        (F.lit(base_ms) * F.pow(F.lit(2.0), "l.level")).cast("bigint").alias("scale_ms"),
        F.size("l.detail").alias("coefficients"),
        energy(F.col("l.detail")).alias("energy"),
        F.col("l.remainder").alias("remainder"),
        energy(F.col("samples")).alias("input_energy"),
        energy(F.col("approximation")).alias("approximation_energy"),
        (F.array_min("samples") == F.array_max("samples")).alias("constant"),
    )


def spectrum(levels: DataFrame) -> DataFrame:
    """Each level's share of detail energy against that of a single impulse."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id", "dimension")
    detail, null = F.sum("energy").over(w), F.pow(F.lit(2.0), -F.col("level"))
    share = F.when(detail > 0, F.col("energy") / detail).otherwise(0.0)
    impulse = null / F.sum(null).over(w)
    return levels.where("level is not null").select("session_id", "dimension", "level", "scale_ms", "energy", share.alias("share"), impulse.alias("impulse_share"), (share / impulse).alias("ratio"))


def silence(levels: DataFrame) -> DataFrame:
    """Per series: the residual of the energy identity, remainders, and why it has no detail."""
    rows = levels.groupBy("session_id", "dimension").agg(F.coalesce(F.sum("energy"), F.lit(0.0)).alias("detail"), F.coalesce(F.sum(F.col("remainder") * F.col("remainder")), F.lit(0.0)).alias("left"), F.count("remainder").alias("remainders"), F.first("input_energy").alias("input"), F.first("approximation_energy").alias("kept"), F.first("constant").alias("constant"))
    why = F.when(F.col("detail") > 0, F.lit(None)).when(F.col("input") == 0, "empty").when(F.col("constant"), "constant").otherwise("only_in_remainders")
    return rows.select("session_id", "dimension", "input", "detail", "remainders", (F.col("input") - F.col("detail") - F.col("left") - F.col("kept")).alias("residual"), why.cast("string").alias("silence"))


# ------------------------------------------------------------ matrix profile


#: Windows along a side of a tile of the distance matrix.
TILE = 1 << 14
#: Up to so many windows of a tile are compared in one matrix.
SMALL = 512
UNIT = 1e9  # squared distances are compared to nine decimals


def _moments(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's sum, the inverse of m times its spread (0 if constant), and whether it is constant."""
    total = lambda v: (c := np.concatenate([[0.0], np.cumsum(v)]))[m:] - c[:-m]
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    constant = w.max(1) == w.min(1)
    sums, spread = total(x), m * total(x * x) - total(x) ** 2
    return sums, np.where(constant | (spread <= 0), 0.0, 1 / np.sqrt(np.where(spread > 0, spread, 1.0))), constant


def tile_minima(a: np.ndarray, b: np.ndarray, m: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a tile of diagonals: each window of a against those of b that begin first to last - 1
    samples later than it does (both from the same place of a series), and the other way
    round.  Least squared distance in 1 / UNIT and the shift where it is (of a's windows
    the least, of b's the greatest: the least place); inf and 0 where there is none.

    Dot products run along a diagonal as differences of one cumulative sum, or
    are one matrix product where the tile is small; for counts they are
    exact, after a whole number near the mean is taken off."""
    middle = np.rint(b.mean())
    a, b = a - middle, b - middle
    (sa, ia, ca), (sb, ib, cb) = _moments(a, m), _moments(b, m)
    best_a, best_b = np.full(len(sa), np.inf), np.full(len(sb), np.inf)
    at_a, at_b = np.zeros(len(sa), np.int64), np.zeros(len(sb), np.int64)
    some = bool(ca.any() and cb.any())
    if len(sa) <= SMALL:
        windows = np.lib.stride_tricks.sliding_window_view
        dot = (m * (windows(a, m) @ windows(b, m).T) - sa[:, None] * sb) * ia[:, None] * ib
        if some:
            dot += ca[:, None] & cb
        square = np.maximum(np.rint((1.0 - dot) * (2 * m * UNIT)), 0.0)
        row, column = np.arange(len(sa)), np.arange(len(sb))
        later = column - row[:, None]
        square[(later < first) | (later >= last)] = np.inf
        near, before = square.argmin(1), square.argmin(0)
        best_a, best_b = square[row, near], square[before, column]
        return best_a, np.where(np.isfinite(best_a), near - row, 0), best_b, np.where(np.isfinite(best_b), column - before, 0)
    for d in range(first, last):
        n = min(len(sa), len(sb) - d)
        if n <= 0:
            break
        other = slice(d, d + n)
        run = np.cumsum(a[: n + m - 1] * b[d : d + n + m - 1])
        dot = run[m - 1 :].copy()
        dot[1:] -= run[:-m]
        dot *= m
        dot -= sa[:n] * sb[other]
        dot *= ia[:n]
        dot *= ib[other]
        if some:
            dot += ca[:n] & cb[other]  # two constant windows are at distance 0
        np.subtract(1.0, dot, out=dot)
        dot *= 2 * m * UNIT
        np.rint(dot, out=dot)
        np.maximum(dot, 0.0, out=dot)
        less = dot < best_a[:n]
        np.copyto(best_a[:n], dot, where=less)
        np.copyto(at_a[:n], d, where=less)
        less = dot <= best_b[other]
        np.copyto(best_b[other], dot, where=less)
        np.copyto(at_b[other], d, where=less)
    return best_a, at_a, best_b, at_b


def zone_of(m: int) -> int:
    """How far apart windows have to begin to be compared: more than this."""
    return math.ceil(m / 4)


def profile_minima(rows: DataFrame, windows: tuple[int, ...], keys: tuple[str, ...], tile: int = TILE) -> DataFrame:
    """keys, m, n (windows of the series), start, square, nearest, constant of every window of every series x.

    The upper triangle of a series' distance matrix is cut into tiles of at most
    tile windows by tile diagonals.  A tile is a row of work with the two stretches
    that it needs, whatever series it is of; minima of a window are merged over its tiles."""
    sized = rows.select(*keys, "x", F.explode(F.array(*map(F.lit, windows))).alias("m")).where((F.col("m") >= 2) & (F.size("x") > F.col("m")))
    sized = sized.withColumn("n", F.size("x") - F.col("m") + 1)
    cut = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(tile))).alias("row"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1 - F.col("row"), F.lit(tile))).alias("shift"))
    stretch = lambda start, n: F.slice("x", start + 1, n + F.col("m") - 1)
    work = dealt(cut.select(*keys, "m", "n", "row", "shift", stretch(F.col("row"), F.lit(tile)).alias("a"), stretch(F.col("row") + F.col("shift"), F.lit(2 * tile - 1)).alias("b")), *keys, "m", "row", "shift")

    def run(batches):
        for batch in batches:
            fixed = [batch.column(i).to_pylist() for i in range(len(keys))]
            for k, (m, n, row, shift) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(len(keys), len(keys) + 4)), strict=True)):
                a, b = (batch.column(len(keys) + i)[k].values.to_numpy(zero_copy_only=False) for i in (4, 5))
                first = max(0, zone_of(m) + 1 - shift)
                best_a, at_a, best_b, at_b = tile_minima(a, b, m, first, tile)
                here, there = np.arange(len(best_a)) + row, np.arange(len(best_b)) + row + shift
                flat = lambda x: np.lib.stride_tricks.sliding_window_view(x, m)
                for start, best, near, x in ((here, best_a, here + shift + at_a, a), (there, best_b, there - shift - at_b, b)):
                    # A window without a neighbour in this tile is left out, but for its own row on the diagonal.
                    own = np.isfinite(best) | (shift == 0 and start is here)
                    w = flat(x)[own]
                    count = int(own.sum())
                    if count:
                        yield pa.RecordBatch.from_arrays([*(pa.array([c[k]] * count, batch.schema.field(i).type) for i, c in enumerate(fixed)), *(pa.array([v] * count, pa.int32()) for v in (m, n)), pa.array(start[own], pa.int32()), pa.array(best[own] / UNIT), pa.array(near[own], pa.int32(), mask=~np.isfinite(best[own])), pa.array(w.max(1) == w.min(1))], names=names)

    names = [*keys, "m", "n", "start", "square", "nearest", "constant"]
    kinds = dict(rows.dtypes)
    found = work.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "m int, n int, start int, square double, nearest int, constant boolean"]))
    merged = found.groupBy(*keys, "m", "n", "start").agg(F.min(F.struct("square", "nearest")).alias("x"), F.first("constant").alias("constant"))
    return merged.select(*keys, "m", "n", "start", F.nullif("x.square", F.lit(math.inf)).alias("square"), F.col("x.nearest").alias("nearest"), "constant")


def matrix_profile(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z-normalised distances of each window of m samples of one short series to its nearest
    one outside the exclusion zone, their places (least on ties), and flags of constant windows.

    Two constant windows are at distance 0, a constant and another at sqrt(2 m)."""
    n = len(x) - m + 1
    best_a, at_a, best_b, at_b = tile_minima(x, x, m, zone_of(m) + 1, n)
    here = np.arange(n)
    before = (best_b < np.inf) & (best_b <= best_a)  # the least place is the earlier one
    best, place = np.where(before, best_b, best_a), np.where(before, here - at_b, here + at_a)
    place[~np.isfinite(best)] = -1
    return np.sqrt(best / UNIT), place, _moments(x, m)[2]


#: Series of up to so many samples have their whole profiles made by one row of work, without tiles to merge.
WHOLE = 1024


def _least_apart(others: np.ndarray, own: np.ndarray, zone: int) -> np.ndarray:
    """For each of own places the least of the other places (ascending) that is outside its zone, -1 if none is."""
    after = np.append(others, -1)[np.searchsorted(others, own + zone, "right")]
    return np.where(np.abs(others[0] - own) > zone, others[0], after)


def whole_profiles(x: np.ndarray, windows: tuple[int, ...]):
    """Yields (m, square, nearest, constant) of every window of one short series for each length that fits: what
    tiles find, in 1 / UNIT; inf and -1 where a window has no neighbour.

    Only windows that vary are compared in a matrix; those that don't are at known distances."""
    x = x - np.rint(x.mean()) if len(x) else x
    total = lambda v: np.concatenate([[0], np.cumsum(v)])
    sums, squares, changes = total(x), total(x * x), total(x[1:] != x[:-1])
    for m in windows:
        n = len(x) - m + 1
        if m < 2 or n < 2:
            continue
        zone, far = zone_of(m), 2 * m * UNIT
        s, constant = sums[m:] - sums[:-m], changes[m - 1 :] == changes[:n]
        best, nearest = np.full(n, np.inf), np.full(n, -1)
        varied, plain = np.flatnonzero(~constant), np.flatnonzero(constant)
        if len(varied):
            w, s = np.lib.stride_tricks.as_strided(x, (n, m), x.strides * 2)[varied], s[varied]
            spread = m * (squares[m:] - squares[:-m])[varied] - s * s
            if spread.min() <= 0:  # numbers that aren't counts can vary by less than their sums tell
                spread[spread <= 0] = np.inf
            inverse = 1 / np.sqrt(spread)
            d = w @ w.T
            d *= m
            d -= s[:, None] * s
            d *= inverse[:, None] * inverse
            np.subtract(1.0, d, out=d)
            d *= far
            np.rint(d, out=d)
            place = varied.astype(np.int32)
            d[np.abs(place[:, None] - place) <= zone] = np.inf
            at = d.argmin(1)
            least = d[np.arange(len(at)), at]
            best[varied], nearest[varied] = np.maximum(least, 0.0), np.where(least < np.inf, varied[at], -1)
        if len(plain):
            first = _least_apart(plain, np.arange(n), zone)
            distance = np.where(constant, 0.0, far)
            better = (first >= 0) & ((distance < best) | (distance == best) & (first < nearest))
            best[better], nearest[better] = distance[better], first[better]
            alone = plain[nearest[plain] < 0]
            if len(alone) and len(varied):
                nearest[alone] = _least_apart(varied, alone, zone)
                best[alone] = np.where(nearest[alone] >= 0, far, np.inf)
        yield m, best, nearest, constant


def _lists(column) -> list[np.ndarray]:
    """The arrays of an Arrow column of lists of numbers."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _listed(arrays: list[np.ndarray], kind, mask=None) -> pa.Array:
    """An Arrow column of lists (mask: which numbers are null)."""
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays), kind, mask=None if mask is None else np.concatenate(mask)))


def top_motifs(best: np.ndarray, place: np.ndarray, m: int, k: int) -> list[tuple[int, int, float]]:
    """Greedy pairs of least distance, each excluding windows around both of its places."""
    free, zone, out = np.isfinite(best) & (place >= 0), math.ceil(m / 4), []
    order = np.argsort(best, kind="stable")
    for i in order[free[order]].tolist():
        j = int(place[i])
        if len(out) == k:
            break
        if free[i] and free[j]:
            out.append((int(min(i, j)), int(max(i, j)), float(best[i])))
            for c in (int(i), j):
                free[max(0, c - zone) : c + zone + 1] = False
    return out


def top_discords(best: np.ndarray, m: int, k: int) -> list[tuple[int, float]]:
    """Greedy places of greatest finite distance, each excluding its surroundings."""
    free, zone, out = np.isfinite(best) & (best > 0), math.ceil(m / 4), []
    order = np.argsort(-np.where(np.isfinite(best), best, -1), kind="stable")
    for i in order[free[order]].tolist():
        if len(out) == k:
            break
        if free[i]:
            out.append((int(i), float(best[i])))
            free[max(0, i - zone) : i + zone + 1] = False
    return out


def profiles(rows: DataFrame, windows: tuple[int, ...], tile: int = TILE, whole: int = WHOLE) -> DataFrame:
    """session_id, dimension, m, start, distance, nearest, masked: raw counts go in.

    masked: the window or its nearest one is constant.  Series of up to whole samples are a row of work each, others go in tiles."""
    keys = ("session_id", "dimension")
    rows = rows.select(*keys, "x")
    found = profile_minima(rows.where(F.size("x") > min(whole, tile)), windows, keys, tile)
    other = found.where("constant").select(*keys, "m", F.col("start").alias("nearest"), F.lit(True).alias("beside"))
    both = found.join(other, [*keys, "m", "nearest"], "left")
    long = both.select(*keys, "m", "start", F.sqrt("square").alias("distance"), "nearest", (F.col("constant") | F.coalesce("beside", F.lit(False))).alias("masked"))
    fields = to_arrow(WHOLE_PROFILES)  # on the driver: it needs the session

    def run(batches):
        for batch in batches:
            out = []
            for place, x in enumerate(_lists(batch.column(2))):
                out += [(place, m, np.sqrt(best / UNIT), nearest, constant | constant[nearest] & (nearest >= 0)) for m, best, nearest, constant in whole_profiles(x, windows)]
                if out and (place + 1 == batch.num_rows or sum(len(o[2]) for o in out) > 1 << 17):
                    at, ms, distances, places, masked = zip(*out, strict=True)
                    held, absent = batch.take(pa.array(at)), [p < 0 for p in places]
                    columns = [*held.columns[:2], pa.array(ms, pa.int32()), _listed(distances, pa.float64(), absent), _listed(places, pa.int32(), absent), _listed(masked, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], names=fields.names)
                    out = []

    short = dealt(rows.where(F.size("x") <= min(whole, tile)), *keys).mapInArrow(run, WHOLE_PROFILES)
    each = short.select(*keys, "m", F.posexplode(F.arrays_zip("distance", "nearest", "masked")).alias("start", "w"))
    return each.select(*keys, "m", "start", "w.distance", "w.nearest", "w.masked").unionByName(long)


WHOLE_PROFILES = "session_id string, dimension string, m int, distance array<double>, nearest array<int>, masked array<boolean>"


SCANS = "session_id string, dimension string, m int, subsequences int, constant_subsequences int, motifs array<struct<a:int,b:int,distance:double>>, discords array<struct<at:int,distance:double>>, null_best double, separation double"


@lru_cache(maxsize=256)
def shuffling(length: int) -> np.ndarray:
    """The places from which the null of a series of that length takes its samples."""
    return np.array(lcg.Lcg(lcg.SHUFFLE_SEED, odd=False).shuffle(list(range(length))), int)


def shuffled(rows: DataFrame) -> DataFrame:
    """Every series in the fixed random order of its null."""

    def run(batches):
        for batch in batches:
            made = [x[shuffling(len(x))] for x in _lists(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.list_(pa.float64()))], names=batch.schema.names)

    return rows.select("session_id", "dimension", "x").mapInArrow(run, "session_id string, dimension string, x array<double>")


def scanned(session, dimension, m: int, own: tuple, null: tuple, k: int) -> dict:
    """A scan of a series and length from the profiles of the series and of its null: (distances, places, constant windows)."""
    masked = lambda best, place, constant: np.where(constant | constant[np.maximum(place, 0)], np.inf, best)
    best, beside = masked(*own), masked(*null)
    motifs, least = top_motifs(best, own[1], m, k), top_motifs(beside, null[1], m, 1)
    least = least[0][2] if least else None
    return {"session_id": session, "dimension": dimension, "m": m, "subsequences": len(best), "constant_subsequences": int(own[2].sum()), "motifs": [dict(zip(("a", "b", "distance"), x, strict=True)) for x in motifs], "discords": [dict(zip(("at", "distance"), x, strict=True)) for x in top_discords(best, m, k)], "null_best": least, "separation": (least - motifs[0][2]) / (2 * math.sqrt(m)) if least is not None and motifs else None}


def scans(rows: DataFrame, windows: tuple[int, ...], k: int = 3, tile: int = TILE, whole: int = WHOLE) -> DataFrame:
    """One row per series and window length: counts, motifs, discords, null and separation.

    A series of up to whole samples is a row of work.  Profiles of longer ones and of their shuffled nulls come from tiles; what is
    gathered per series and length is the profile alone, one number and place for each window."""
    keys = ("session_id", "dimension", "null")
    rows = rows.select("session_id", "dimension", "x")
    own = rows.where(F.size("x") > min(whole, tile))
    every = own.withColumn("null", F.lit(False)).unionByName(shuffled(own).withColumn("null", F.lit(True)))
    found = profile_minima(every, windows, keys, tile)
    gathered = lambda null: F.sort_array(F.collect_list(F.when(F.col("null") == null, F.struct("start", F.sqrt("square").alias("best"), "nearest", "constant"))))
    each = found.groupBy("session_id", "dimension", "m").agg(gathered(False).alias("p"), gathered(True).alias("q"))
    flat = each.select("session_id", "dimension", "m", *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "pq" for c in ("best", "nearest", "constant")))
    fields = to_arrow(SCANS)  # on the driver: it needs the session

    def side(best, nearest, constant):
        return np.array([math.inf if x is None else x for x in best]), np.array([-1 if x is None else x for x in nearest], int), np.array(constant, bool)

    def run(batches):
        for batch in batches:
            out = [scanned(r["session_id"], r["dimension"], r["m"], *(side(r[f"{x}_best"], r[f"{x}_nearest"], r[f"{x}_constant"]) for x in "pq"), k) for r in batch.to_pylist()]
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)

    def run_whole(batches):
        for batch in batches:
            out = []
            for session, dimension, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), strict=True):
                made = (whole_profiles(v, windows) for v in (x, x[shuffling(len(x))]))
                out += [scanned(session, dimension, a[0], *((np.sqrt(best / UNIT), place, constant) for _, best, place, constant in (a, b)), k) for a, b in zip(*made, strict=True)]
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)

    short = dealt(rows.where(F.size("x") <= min(whole, tile)), "session_id", "dimension").mapInArrow(run_whole, SCANS)
    return short.unionByName(flat.mapInArrow(run, SCANS))


def linked_regions(scanned: DataFrame, regions: DataFrame, bucket_ms: int) -> DataFrame:
    """The first motif of each scan of a session that joins two of its half-open regions (session_id,
    region, a_from, a_to, b_from, b_to in milliseconds): by where its spans start
    (linking), and by whether they reach in (overlapping).  Ranks count from 0; null
    where no motif does."""
    rows = scanned.join(regions, "session_id")
    width = F.col("m").cast("bigint") * bucket_ms

    ms = lambda bucket: bucket.cast("bigint") * bucket_ms

    def first(hits):
        both = lambda p, q: hits(p, F.col("a_from"), F.col("a_to")) & hits(q, F.col("b_from"), F.col("b_to"))
        found = F.transform("motifs", lambda x, i: F.when(both(ms(x["a"]), ms(x["b"])) | both(ms(x["b"]), ms(x["a"])), i))
        return F.array_min(F.filter(found, lambda i: i.isNotNull()))

    starts = lambda at, a, b: (at >= a) & (at < b)
    reaches = lambda at, a, b: (at < b) & (at + width > a)
    return rows.select("session_id", "dimension", "m", "region", first(starts).alias("linking"), first(reaches).alias("overlapping"))
