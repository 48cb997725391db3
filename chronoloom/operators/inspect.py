"""Inspection of recordings: tallies, tool groups, subagents, coverage, anomalies.

All functions take a ledger (one row per record, ordered by ``sequence`` in each
session) and return DataFrames; each claim carries the ascending sequence
numbers that support it.  Every operator is one hash aggregation by session (and
id), so a session's records are combined map-side before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import ANOMALIES, CHANNELS, KINDS, OPENINGS, OUTCOMES, TOOL_KINDS


def receipts(condition: Column | None = None) -> Column:
    """Ascending sequence numbers of the rows that meet the condition."""
    own = F.col("sequence") if condition is None else F.when(condition, F.col("sequence"))
    return F.sort_array(F.collect_list(own))


def kind_in(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def tally(ledger: DataFrame, vocabulary: DataFrame | None, *values: str) -> DataFrame:
    """Receipts by value; with a vocabulary, values without records are there too."""
    seen = ledger.groupBy("session_id", *values).agg(receipts().alias("receipts"))
    if vocabulary is not None:
        sessions = ledger.select("session_id", *({"version"} & set(values))).distinct()
        rows = sessions.join(F.broadcast(vocabulary), "version") if "version" in values else sessions.crossJoin(F.broadcast(vocabulary))
        seen = rows.join(seen, ["session_id", *values], "left")
    n = F.coalesce(F.size("receipts"), F.lit(0))
    return seen.select("session_id", *values, F.when(F.col("receipts").isNull(), F.lit(0)).otherwise(n).cast("long").alias("records"), F.concat_ws(",", F.col("receipts").cast("array<string>")).alias("receipts"))


def by_channel(ledger: DataFrame) -> DataFrame:
    names = ledger.sparkSession.createDataFrame([(c,) for c in CHANNELS], "channel string")  # three rows
    return tally(ledger, names, "channel")


def by_kind(ledger: DataFrame) -> DataFrame:
    """Every kind of the session's version, with zeros."""
    names = ledger.sparkSession.createDataFrame([(v, k) for v, kinds in KINDS.items() for k in kinds], "version int, kind string")  # 14 rows
    return tally(ledger, names, "version", "kind")


def by_value(ledger: DataFrame, value: str) -> DataFrame:
    """Receipts by delivered value, with the order in which values first appear."""
    seen = ledger.groupBy("session_id", value).agg(F.count("*").alias("records"), F.min("sequence").alias("first_sequence"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("first_sequence")))


def session_boundaries(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("session_id").agg(*[F.concat_ws(",", receipts(kind_in(k)).cast("array<string>")).alias(k) for k in ("session_started", "session_ended")])


def current_agents(ledger: DataFrame) -> DataFrame:
    """Records by agent attribution: a supplied id, none supplied, or not representable (version 1)."""
    state = F.when(F.col("version") == 1, "not_representable").when(F.col("agent_id").isNull(), "not_supplied").otherwise("supplied")
    return ledger.groupBy("session_id", state.alias("attribution"), "agent_id").agg(F.count("*").alias("records"), F.min("sequence").alias("first_sequence"))


def _classes() -> Column:
    """What an outcome record says: succeeded, failed or denied."""
    return F.when(kind_in("tool_succeeded") | (F.col("outcome") == "succeeded"), "succeeded").when(kind_in("tool_failed") | (F.col("outcome") == "failed"), "failed").when(kind_in("tool_denied"), "denied")


def tool_groups(ledger: DataFrame) -> DataFrame:
    """One row per (session, version, correlation id): evidence, shape, interval, delivered names.

    The shape is decided in this order: no observed record; more than one opening,
    outcome or class of outcome; one half missing; a pair."""
    rows = ledger.where(F.col("corr_id").isNotNull()).withColumn("class", _classes())
    groups = rows.groupBy("session_id", "version", "corr_id").agg(
        F.min("sequence").alias("first_sequence"),
        receipts(kind_in("reported_intent")).alias("intents"),
        receipts(kind_in(*OPENINGS)).alias("openings"),
        receipts(kind_in(*OUTCOMES)).alias("outcomes"),
        *[receipts(F.col("class") == c).alias(c) for c in ("succeeded", "failed", "denied")],
        F.array_sort(F.collect_set("tool_name")).alias("tool_names"),
        F.size(F.collect_set("class")).alias("classes"),
    )
    n_open, n_out = F.size("openings"), F.size("outcomes")
    shape = (
        F.when((n_open == 0) & (n_out == 0), "reported_intent_only")
        .when((n_open > 1) | (n_out > 1) | (F.col("classes") > 1), "ambiguous")
        .when(n_out == 0, "opening_without_outcome")
        .when(n_open == 0, "outcome_without_opening")
        .otherwise("paired_lifecycle")
    )
    paired = F.col("shape") == "paired_lifecycle"
    return groups.withColumn("shape", shape).withColumn("opening", F.when(paired, F.get("openings", F.lit(0)))).withColumn("outcome", F.when(paired, F.get("outcomes", F.lit(0))))


def group_shapes(ledger: DataFrame) -> DataFrame:
    """How many groups of each shape; counts only, so no receipts are gathered."""
    rows = ledger.where(F.col("corr_id").isNotNull()).withColumn("class", _classes())
    g = rows.groupBy("session_id", "version", "corr_id").agg(
        F.count_if(kind_in(*OPENINGS)).alias("o"), F.count_if(kind_in(*OUTCOMES)).alias("x"), *[F.max((F.col("class") == c).cast("int")).alias(c) for c in ("succeeded", "failed", "denied")]
    )
    classes = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("succeeded", "failed", "denied")), F.lit(0))
    shape = F.when((F.col("o") == 0) & (F.col("x") == 0), "reported_intent_only").when((F.col("o") > 1) | (F.col("x") > 1) | (classes > 1), "ambiguous").when(F.col("x") == 0, "opening_without_outcome").when(F.col("o") == 0, "outcome_without_opening").otherwise("paired_lifecycle")
    return g.groupBy(shape.alias("shape")).agg(F.count("*").alias("groups"))


def subagents(ledger: DataFrame) -> DataFrame:
    """Child agents: receipts of starts and stops, delivered types and parents (null is a delivered value)."""
    rows = ledger.where(F.col("subject_agent").isNotNull())
    return rows.groupBy("session_id", "subject_agent").agg(
        F.min("sequence").alias("first_sequence"),
        receipts(kind_in("subagent_started")).alias("started"),
        receipts(kind_in("subagent_stopped")).alias("stopped"),
        F.transform(F.array_sort(F.collect_set(F.struct("subject_type"))), lambda x: x["subject_type"]).alias("types"),
        F.array_sort(F.collect_set("parent_agent")).alias("parents"),
    )


def coverage(ledger: DataFrame) -> DataFrame:
    """Four rows a session: of the records that could carry a field, how many do."""
    fields = {"duration_ms": kind_in("tool_succeeded", "tool_failed"), "interrupted": kind_in("tool_failed"), "parent_agent": kind_in("subagent_started", "subagent_stopped"), "prompt_id": F.col("version") == 2}
    counts = ledger.groupBy("session_id").agg(*[F.count_if(can).alias(f"{f}_n") for f, can in fields.items()], *[F.count_if(can & F.col(f).isNotNull()).alias(f"{f}_p") for f, can in fields.items()])
    return counts.select("session_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_n").alias("population"), F.col(f"{f}_p").alias("present"), (F.col(f"{f}_n") - F.col(f"{f}_p")).alias("absent")) for f in fields])).alias("c")).select("session_id", "c.*")


def timestamps(ledger: DataFrame) -> DataFrame:
    """Extrema with the earliest record that has them, and records whose clock went back."""
    before = F.lag("epoch_ns").over(Window.partitionBy("session_id").orderBy("sequence"))
    rows = ledger.select("session_id", "sequence", "epoch_ns", (before > F.col("epoch_ns")).alias("back"))
    return rows.groupBy("session_id").agg(
        F.min("epoch_ns").alias("earliest_ns"),
        F.min_by("sequence", F.struct("epoch_ns", "sequence")).alias("earliest_sequence"),
        F.max("epoch_ns").alias("latest_ns"),
        F.max_by("sequence", F.struct("epoch_ns", -F.col("sequence"))).alias("latest_sequence"),
        F.count_if("back").alias("non_monotonic"),
        receipts(F.col("back")).alias("back_receipts"),
    )


def anomalies(ledger: DataFrame) -> DataFrame:
    """session_id, kind, ordinal, id, receipts, place: in order of the earliest
    supporting record (absences last), then of kind, then of id."""
    edge = ledger.groupBy("session_id").agg(receipts(kind_in("session_started")).alias("s"), receipts(kind_in("session_ended")).alias("e"))
    groups = tool_groups(ledger)
    named = ledger.where(F.col("corr_id").isNotNull() & F.col("tool_name").isNotNull()).groupBy("session_id", "version", "corr_id").agg(receipts().alias("r"), F.count_distinct("tool_name").alias("n"))
    agents = subagents(ledger)
    typed = ledger.select("session_id", "sequence", F.explode(F.array(F.struct(F.col("agent_id").alias("a"), F.col("agent_type").alias("t")), F.struct(F.col("subject_agent").alias("a"), F.col("subject_type").alias("t")))).alias("x")).where("x.a is not null and x.t is not null")
    typed = typed.groupBy("session_id", "x.a").agg(receipts().alias("r"), F.count_distinct("x.t").alias("n"))
    none = F.array().cast("array<bigint>")
    opened, out = F.size("openings"), F.size("outcomes")
    found = [
        (edge, 0, F.size("s") == 0, F.lit(None), none),
        (edge, 1, F.size("e") == 0, F.lit(None), none),
        (edge, 2, F.size("s") > 1, F.lit(None), F.col("s")),
        (edge, 3, F.size("e") > 1, F.lit(None), F.col("e")),
        (groups, 4, opened > 1, F.col("corr_id"), F.col("openings")),
        (groups, 5, out > 1, F.col("corr_id"), F.col("outcomes")),
        (groups, 6, F.col("classes") > 1, F.col("corr_id"), F.col("outcomes")),
        (groups, 7, (out == 0) & (opened > 0), F.col("corr_id"), F.col("openings")),
        (groups, 8, (opened == 0) & (out > 0), F.col("corr_id"), F.col("outcomes")),
        (groups, 9, (opened == 0) & (out == 0), F.col("corr_id"), F.col("intents")),
        (named, 10, F.col("n") > 1, F.col("corr_id"), F.col("r")),
        (agents, 11, F.size("started") == 0, F.col("subject_agent"), F.col("stopped")),
        (agents, 12, F.size("stopped") == 0, F.col("subject_agent"), F.col("started")),
        (typed, 13, F.col("n") > 1, F.col("a"), F.col("r")),
    ]

    def each(tests):  # one explode over each source rather than one scan for each kind
        options = F.array(*[F.when(when, F.struct(F.lit(k).alias("ordinal"), i.cast("string").alias("id"), r.alias("receipts"))) for _, k, when, i, r in tests])
        return tests[0][0].select("session_id", F.explode(options).alias("a")).where("a is not null").select("session_id", "a.*")

    rows = reduce(DataFrame.unionByName, [each([f for f in found if f[0] is source]) for source in (edge, groups, named, agents, typed)])
    order = Window.partitionBy("session_id").orderBy(F.coalesce(F.get("receipts", F.lit(0)), F.lit((1 << 63) - 1)), "ordinal", F.col("id").asc_nulls_first())
    names = F.array(*map(F.lit, ANOMALIES))
    return rows.withColumn("kind", F.get(names, F.col("ordinal"))).withColumn("place", F.row_number().over(order))


def anomaly_index(ledger: DataFrame) -> DataFrame:
    """Records that anomalies cite, with the kinds that cite them."""
    cited = anomalies(ledger).select("session_id", "kind", F.explode("receipts").alias("sequence"))
    kinds = cited.groupBy("session_id", "sequence").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("anomalies"))
    return ledger.select("session_id", "sequence", "kind", "tool_name").join(kinds, ["session_id", "sequence"])


def search(ledger: DataFrame, text: str | None = None, payload: bool = False, anomalous: bool = False, **facets) -> DataFrame:
    """Records that meet all facets (a value, or one of several; agent_id may be
    'unattributed'), hold the text in their metadata (case ignored), and are cited by an anomaly."""
    rows = ledger
    for name, values in facets.items():
        values = [values] if isinstance(values, str) else [*values]
        test = F.col(name).isin(*values)
        if name == "agent_id" and "unattributed" in values:
            test = F.coalesce(test, F.lit(False)) | F.col(name).isNull()
        rows = rows.where(test)
    if text:
        fields = ["session_id", "channel", "adapter", "mechanism", "kind", "corr_id", "tool_name", "agent_id", "subject_agent", "prompt_id", *(["props", "intent_text", "command"] if payload else [])]
        rows = rows.where(F.lower(F.concat_ws(" ", *fields)).contains(text.lower()))
    if anomalous:
        rows = rows.join(anomaly_index(ledger).select("session_id", "sequence"), ["session_id", "sequence"], "left_semi")
    return rows


def tool_records() -> Column:
    return kind_in(*TOOL_KINDS)
