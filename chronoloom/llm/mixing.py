"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) take the ``weights`` in turn.  Together
they get ``share`` of all words; a source's target stops at ``cap`` times its
words and the excess goes to the others by weight.  A document of a source is
expected target / words times in the mix.  Within its source the documents are
ranked (largest first, then by a digest of the id), expected copies are
prefix-summed along the ranks, one random offset per source is added, and a
document is emitted once per integer boundary that its part of the sum crosses.
So each has the floor or the ceiling of its expected copies, and because
neighbours in rank have similar sizes, a source's words miss its target by at
most its largest document.

No group is sorted in one task: ranks come from counts per (source, size,
digest bucket), prefix-summed level by level over ranges of sizes; only rows of
one source, size and bucket meet in a window.

Edge cases: null or empty texts have size 0 and take 0 words; null sources are a
source of their own; null ids are ranked by a digest of their texts; repeated rows
are separate documents (rows that share a digest and a size are ranked in one
sorted stream); a very long text is one row like any other; an empty table gives an empty mix; other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_in, written

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2, "mix-1"
#: Ranges of sizes, widest first, over which counts are prefix-summed.
RANGES = (4096, 64)
BUCKET_HEX = 3  # 4096 digest buckets for each source and size


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """From (key, source, source_size), one row a source, adds target.

    The fixed point of resharing is min(cap * size, weight * level) for one
    level; sources that stop at their cap are those with the least cap / weight.
    The window runs over one row per source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", w.cast("long")).withColumn("most", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "place")
    everything = Window.partitionBy()
    rows = rows.withColumn("before_most", F.sum("most").over(by_ratio) - F.col("most")).withColumn("rest_weight", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
    rows = rows.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    rows = rows.withColumn("level", (F.col("total") - F.col("before_most")) / F.col("rest_weight"))
    rows = rows.withColumn("turn", F.row_number().over(by_ratio))
    water = F.min(F.when(F.col("most") > F.col("weight") * F.col("level"), F.struct("turn", "level"))).over(everything)
    rows = rows.withColumn("water", water)  # of the first source that doesn't stop at its cap
    capped = F.col("water").isNull() | (F.col("turn") < F.col("water.turn"))
    return rows.withColumn("target", F.when(capped, F.col("most").cast("double")).otherwise(F.col("weight") * F.col("water.level"))).select("key", "source", "source_size", "target")


def _offset(source_key: Column, seed: str) -> Column:
    """A number from 0 up to 1 that depends on seed and source only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), source_key)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _offsets(rows: DataFrame) -> DataFrame:
    """(key, size, bucket, offset): how many rows of the key come before the bucket."""
    bins = [f"_bin{w}" for w in RANGES]
    levels = [*bins, "size", "_bucket"]
    counts = rows.groupBy("_key", *[F.floor(F.col("size") / w).alias(name) for name, w in zip(bins, RANGES, strict=True)], "size", _bucket().alias("_bucket")).agg(F.count("*").alias("_n"))
    steps = []
    for k, level in enumerate(levels):
        at = ["_key", *levels[: k + 1]]
        sums = counts.groupBy(*at).agg(F.sum("_n").alias("_n")) if k < len(levels) - 1 else counts
        order = F.col(level).asc() if level == "_bucket" else F.col(level).desc()
        before = F.sum("_n").over(Window.partitionBy(*at[:-1]).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
        steps.append(sums.withColumn(f"_before{k}", before).drop("_n"))
    offsets = reduce(lambda a, b: b.join(a, [c for c in a.columns if not c.startswith("_before")]), steps)
    return offsets.select("_key", "size", "_bucket", reduce(lambda a, b: a + b, [F.col(f"_before{k}") for k in range(len(levels))]).alias("_offset"))


def _bucket() -> Column:
    return F.substring("_digest", 1, BUCKET_HEX)


def _ranked(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds rank (from 1) in each key by size descending and digest ascending."""
    rows = rows.withColumn("_bucket", _bucket())
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_key", "size", "_bucket").orderBy("_digest")))
    return rows.join(offsets, ["_key", "size", "_bucket"]).withColumn("_rank", F.col("_offset") + F.col("_in"))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED, payload: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies (and
    all its columns, as the struct _row, with payload).

    Texts are read once to write (id, source, size, digest), from which sums,
    counts and ranks are made, and once more where they are part of the result."""
    column = lambda name: F.col(f"`{name}`")
    key = F.coalesce(F.concat(F.lit("s"), column(source).cast("string")), F.lit("n"))
    name = column(doc_id).cast("string")
    digest = F.when(name.isNull(), F.md5(F.coalesce(column(text).cast("string"), F.lit("")))).otherwise(F.md5(name))
    thin = [column(doc_id).cast("long").alias("doc_id"), column(source).cast("string").alias("source"), key.alias("_key"), words_in(column(text)).alias("size"), digest.alias("_digest")]
    rows = written(docs.select(*thin), "sizes")
    sizes = rows.groupBy(F.col("_key").alias("key"), "source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, weights, share, cap).select(F.col("key").alias("_key"), "source_size", "target")
    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = lambda rank: F.floor(share_of * rank + _offset(F.col("_key"), seed))
    offsets = _offsets(rows)
    if payload:
        rows = docs.select(*thin, F.struct(*map(column, docs.columns)).alias("_row"))
    ranked = _ranked(rows, offsets).join(aims, "_key")
    return ranked.select("doc_id", "size", "source_size", "target", (at(F.col("_rank")) - at(F.col("_rank") - 1)).cast("long").alias("copies"), *(["_row"] if payload else []))


def plan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with all their columns, each as often as it is taken."""
    rows = copies(docs, payload=True, **options).where(F.col("copies") > 0)
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


PLAN_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM d GROUP BY k, source),
p AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS most FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / w, source ASC NULLS LAST) AS i, sum(most) OVER (ORDER BY most / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) - most AS below,
  sum(w) OVER () - sum(w) OVER (ORDER BY most / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) + w AS rest, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM p),
l AS (SELECT *, (total - below)::DOUBLE / rest::DOUBLE AS level FROM o),
f AS (SELECT min(i) AS i FROM l WHERE NOT (most <= w * level)),
g AS (SELECT l.i, level FROM l JOIN f ON l.i = f.i),
t AS (SELECT k, source_size, CASE WHEN l.i < coalesce((SELECT i FROM g), 1 << 30) THEN most::DOUBLE ELSE w * (SELECT level FROM g) END AS target FROM l),
r AS (SELECT doc_id, size, k, row_number() OVER (PARTITION BY k ORDER BY size DESC, md5(coalesce(doc_id::VARCHAR, ''))) AS n FROM d),
u AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e, ('0x' || substr(md5('mix-1:' || r.k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x FROM r JOIN t USING (k))
SELECT doc_id, size, source_size, target, (size * (floor(e * n + x) - floor(e * (n - 1) + x)))::BIGINT AS taken FROM u
"""
