"""Importance resampling towards a target distribution, in DataFrame functions only.

Features are runs of 1 to ``max_words`` consecutive words (maximal runs of
ASCII letters, digits and other than ASCII characters, A-Z lower-cased); a
feature's bucket is the crc32 of its bytes modulo ``buckets``.  Both corpora's
features are counted by bucket; a bucket's gain is the smoothed log ratio of its
shares in the target and in the source, in floored thousandths.  A document
weighs the sum of its features' gains, a Gumbel variate that depends on its id
and the seed is added, and the ``percent`` of the eligible documents (of
``min_words`` words at least) with the highest scores are drawn without replacement.

Plan: exploded features are counted by bucket before any shuffle, so a word that
a third of all texts hold is one row a task.  The gain table has a row a
bucket, whatever the corpus; it is written once and broadcast.  A document's
features lie together in a task, so its sum is one row before it is shuffled.
Ranks come from one distributed sort: rows are dealt by ranges of (score, id),
sorted within partitions and written with partition and place; a partition's
offset is the prefix sum over the partitions' counts (one row a partition).

Edge cases: null and empty texts have no features, weight 0, and are not
eligible under the default ``min_words``; null ids hash as the empty text and
come last in ties; repeated rows are separate documents (equal ones rank in
either order, which gives the same rows); an empty table gives an empty result
and an empty target gives gains against zero counts; a very long text is one
array of words in one task, whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BUCKETS, MAX_WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Words of texts that aren't lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else; ASCII words take the quicker way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def _features(words: Column, max_words: int) -> Column:
    """All runs of 1 to max_words of an array of words, joined by one space."""


    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(words, *(runs(n) for n in range(2, max_words + 1))) if max_words > 1 else words


def exploded(docs: DataFrame, text: str, max_words: int, buckets: int, *ids: Column) -> DataFrame:
    """A row for each feature: its bucket (null in the one row of a document without
    any), the document's number of words, and the ids."""
    words = F.coalesce(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    rows = docs.select(*ids, words.alias("_words"))
    rows = rows.select(*rows.columns[:-1], F.size("_words").cast("long").alias("_n"), F.explode_outer(_features(F.col("_words"), max_words)).alias("_feature"))
    return rows.select(*rows.columns[:-1], (F.crc32(_lowered(F.col("_feature")).cast("binary")) % buckets).cast("int").alias("bucket"))


def bucket_counts(docs: DataFrame, text: str, max_words: int, buckets: int, name: str) -> DataFrame:
    """bucket, name: how many features fall into it; summed within tasks first."""
    rows = exploded(docs, text, max_words, buckets).where("bucket IS NOT NULL")
    return rows.groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket; the window runs over a row a bucket, no more."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(bucket_counts(docs, text, max_words, buckets, "s"), "bucket", "left").join(bucket_counts(target, text, max_words, buckets, "t"), "bucket", "left").fillna(0, ["s", "t"])
    whole = Window.partitionBy()
    double = lambda x, plus: x.cast("double") + F.lit(float(plus))
    ratio = double(F.col("t"), 1) * double(F.sum("s").over(whole), buckets) / (double(F.col("s"), 1) * double(F.sum("t").over(whole), buckets))
    return rows.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate in floored thousandths, from a digest of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32)))))


def scores(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    gain = written(gains(docs, target, text, max_words, buckets), "gains")
    own = [F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row")]  # tells repeated rows apart
    rows = exploded(docs, text, max_words, buckets, *own).join(F.broadcast(gain), "bucket", "left")
    sums = rows.groupBy("_row", "doc_id", "_n").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return sums.select("doc_id", F.col("_n").alias("n_words"), "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, **options) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and its rank if it is drawn (else null)."""
    rows = scores(docs, target, doc_id, text, **options)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("_eligible"), F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = written(rows.withColumn("_eligible", F.col("n_words") >= min_words), "scores").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The partition's number is in the upper bits, the row's place in it in the lower 33.
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.count_if("_eligible").alias("_able"))
    offsets = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"), F.floor(F.lit(percent) * F.sum("_able").over(Window.partitionBy()) / 100).alias("_drawn"))
    rank = F.col("_before") + F.col("_place") + 1
    ranked = placed.join(F.broadcast(offsets), "_part")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("_eligible") & (rank <= F.col("_drawn")), rank).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id and rank of the drawn documents, best first within each partition."""
    return resample(docs, target, doc_id, **options).where("rank IS NOT NULL").select("doc_id", "rank")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
RESAMPLE_SQL = rf"""
WITH tab AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS MATERIALIZED (SELECT coalesce({_WORDS}, []) AS w FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, unnest(w) AS x FROM d),
bw AS MATERIALIZED (SELECT unnest(w) AS x FROM b),
v AS MATERIALIZED (SELECT x, hex(encode(x)) AS hx FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
k AS MATERIALIZED (SELECT x, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(hx, 2 * i + 1, 2))::BIGINT FOR i IN range(len(hx) // 2)]), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN k USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN k USING (x) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000) / ((s.n::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN k USING (x) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS all_n FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN n <= floor(10 * all_n / 100) THEN n END AS rank FROM r LEFT JOIN o USING (doc_id)
"""
