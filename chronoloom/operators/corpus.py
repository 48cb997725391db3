"""Cross-session corpus analysis: actions, shapes that sessions share, and a report.

A session's tool groups become a stream of actions (category and outcome).
Windows of 3 to 6 marks that occur in two sessions or more are families; their
support is counted without overlaps.  Prevalence is a groupBy of windows, so it
scales with records, not with pairs of sessions.  Command text is classified and
dropped: no output holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, dealt
from .inspect import tool_groups
from .sequence import windows

LADDER = (3, 4, 5, 6)
MIN_ACTIONS, MIN_CATEGORIES, MAX_SESSIONS = 12, 2, 64

# Program names and subcommands that decide a shell command's category, and tools by category.
INSPECT_PROGRAMS = ("cat", "ls", "head", "tail", "wc", "find", "which", "grep", "rg", "ag", "du", "stat", "diff", "tree")
VERIFY_PROGRAMS = ("pytest", "vitest", "jest", "tsc", "mypy", "ruff", "rspec", "phpunit", "gotestsum")
VCS_PROGRAMS = ("git", "gh", "jj", "hg", "svn")
CARGO_VERIFY = ("test", "clippy", "fmt", "check", "bench")
NPX_VERIFY = ("tsc", "vitest", "jest", "eslint", "playwright", "mocha")
SCRIPT_VERIFY = ("test", "check", "lint", "typecheck", "verify")
TOOLS = {
    "inspect": ("Read", "Grep", "Glob", "LS", "NotebookRead"),
    "modify": ("Edit", "MultiEdit", "Write", "NotebookEdit"),
    "research": ("WebSearch", "WebFetch"),
    "delegate": ("Task", "Agent"),
}
CATEGORIES = ("inspect", "modify", "verify", "version-control", "research", "delegate", "shell", "other")
OUTCOMES = ("succeeded", "failed", "denied", "no-outcome-observed", "disagreeing")


def _program(token: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(token, "^[\"']+|[\"']+$", ""), "/"), -1))


def shell_category(command: Column) -> Column:
    """By the leading program only; a command that starts with cd is read after its first &&."""
    tokens = F.slice(F.split(F.trim(F.regexp_replace(command, r"\s+", " ")), " "), 1, 16)
    jump = F.when(_program(F.get(tokens, F.lit(0))) == "cd", F.array_position(tokens, "&&")).otherwise(0)
    at = lambda k: F.get(tokens, jump.cast("int") + k)
    program, first, second = _program(at(0)), F.coalesce(F.lower(at(1)), F.lit("")), F.coalesce(F.lower(at(2)), F.lit(""))
    starts = lambda c: F.rlike(c, F.lit("^(" + "|".join(SCRIPT_VERIFY) + ")"))
    verify = (
        program.isin(*VERIFY_PROGRAMS)
        | ((program == "cargo") & first.isin(*CARGO_VERIFY))
        | (program.isin("npm", "pnpm", "yarn", "bun") & ((first == "test") | ((first == "run") & starts(second))))
        | ((program == "npx") & first.isin(*NPX_VERIFY))
        | (program.isin("node", "deno") & (first == "--test"))
        | ((program == "make") & starts(first))
    )
    return F.when(verify, "verify").when(program.isin(*VCS_PROGRAMS), "version-control").when(program.isin(*INSPECT_PROGRAMS), "inspect").otherwise("shell")


def category(tool: Column, command: Column) -> Column:
    out = F.when(tool == "Bash", F.when(command.isNull(), "shell").otherwise(shell_category(command)))
    for name, tools in TOOLS.items():
        out = out.when(tool.isin(*tools), name)
    return out.otherwise("other")


def actions(ledger: DataFrame) -> DataFrame:
    """One row per tool group with observed evidence, in order of its first record:
    tool (earliest delivered), category, outcome, mark, interval of sequence numbers."""
    groups = tool_groups(ledger).where("shape <> 'reported_intent_only'")
    outcome = F.when(F.col("classes") > 1, "disagreeing").when(F.size("succeeded") > 0, "succeeded").when(F.size("failed") > 0, "failed").when(F.size("denied") > 0, "denied").otherwise("no-outcome-observed")
    named = ledger.where("corr_id is not null").groupBy("session_id", "version", "corr_id").agg(F.min_by("tool_name", F.when(F.col("tool_name").isNotNull(), F.col("sequence"))).alias("tool"), F.min_by("command", F.when(F.col("command").isNotNull() & (F.col("version") == 2), F.col("sequence"))).alias("command"), F.max("sequence").alias("last_sequence"))
    rows = groups.select("session_id", "version", "corr_id", "first_sequence", outcome.alias("outcome")).join(named, ["session_id", "version", "corr_id"])
    rows = rows.withColumn("category", category(F.col("tool"), F.col("command"))).drop("command")
    mark = F.concat("category", F.when(F.col("outcome") == "succeeded", "").otherwise(F.concat(F.lit("!"), "outcome")))
    return rows.withColumn("mark", mark).withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("first_sequence")) - 1)


def workflow(acts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Actions as an event sequence: gaps between the first records of consecutive actions."""
    at = ledger.select("session_id", F.col("sequence").alias("first_sequence"), "epoch_ns")
    rows = acts.join(at, ["session_id", "first_sequence"])
    step = F.col("epoch_ns") - F.lag("epoch_ns").over(Window.partitionBy("session_id").orderBy("pos"))
    return rows.withColumn("_step", step).select("session_id", "pos", "first_sequence", "last_sequence", "mark", "category", "outcome", "tool", F.expr("greatest(_step, 0) div 1000000").alias("gap_ms"))


def eligibility(acts: DataFrame, ledger: DataFrame, most: int = MAX_SESSIONS) -> DataFrame:
    """Why a session is left out, by the first rule that applies; the capacity rule
    counts, in order of id, sessions that pass all others."""
    counted = acts.groupBy("session_id").agg(F.count("*").alias("actions"), F.count_distinct("category").alias("categories"))
    rows = ledger.groupBy("session_id").agg(F.count("*").alias("records")).join(counted, "session_id", "left").fillna(0, ["actions", "categories"])
    why = F.when(F.col("records") == 0, "no_complete_records").when(F.col("actions") < MIN_ACTIONS, "too_few_actions").when(F.col("categories") < MIN_CATEGORIES, "vocabulary_too_small")
    rows = rows.withColumn("why", why)
    taken = rows.where("why is null").orderBy("session_id").limit(most).select("session_id", F.lit(True).alias("taken"))  # the corpus, no more
    rows = rows.join(F.broadcast(taken), "session_id", "left")
    return rows.select("session_id", "records", "actions", "categories", F.coalesce("why", F.when(F.col("taken").isNull(), "corpus_full")).alias("skipped"))


def file_eligibility(files: DataFrame, acts: DataFrame, most: int = MAX_SESSIONS) -> DataFrame:
    """Why a file is left out of a corpus, by the first rule that applies.

    files: path, key (its identity), status of its replay, records, has_time; acts: the
    actions of each file, with its path as session_id.  A file repeats an
    identity when one before it by path is in the corpus under the same key; the
    capacity rule counts, in order of path, the files that pass all others."""
    counted = acts.groupBy(F.col("session_id").alias("path")).agg(F.count("*").alias("actions"), F.count_distinct("category").alias("categories"))
    rows = files.join(counted, "path", "left").fillna(0, ["actions", "categories"])
    unsound = F.when(~F.col("status").isin("complete", "truncated"), "replay_failed").when((F.col("records") == 0) | F.col("key").isNull(), "no_complete_records").when(~F.col("has_time"), "no_timestamps")
    poor = F.when(F.col("actions") < MIN_ACTIONS, "too_few_actions").when(F.col("categories") < MIN_CATEGORIES, "vocabulary_too_small")
    rows = checkpointed(dealt(rows.withColumns({"unsound": unsound, "poor": poor}).drop("has_time"), "path"))  # a row a file, read twice
    passes = rows.where("unsound is null and poor is null").groupBy("key").agg(F.min("path").alias("first"))
    taken = passes.orderBy("first").limit(most).withColumn("taken", F.lit(True))  # one row a key of the corpus
    rows = rows.join(F.broadcast(taken), "key", "left")
    why = F.coalesce("unsound", F.when(F.col("taken") & (F.col("first") < F.col("path")), "duplicate_identity"), "poor", F.when(F.col("taken").isNull(), "corpus_full"))
    return rows.select("path", "key", "status", "records", "actions", "categories", why.alias("skipped"))


def session_facts(acts: DataFrame) -> DataFrame:
    """Counts by category and outcome with zeros, and the most used tool (name on ties)."""
    tools = acts.groupBy("session_id", "tool").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.min_by("tool", F.struct(-F.col("n"), "tool")).alias("top_tool"))
    clean = lambda x: x.replace("-", "_")
    counts = acts.groupBy("session_id").agg(F.count("*").alias("actions"), *[F.count_if(F.col("category") == c).alias(f"c_{clean(c)}") for c in CATEGORIES], *[F.count_if(F.col("outcome") == o).alias(f"o_{clean(o)}") for o in OUTCOMES])
    return counts.join(tools, "session_id")


def greedy_count(labels: Column, shape: Column) -> Column:
    """Occurrences of shape in labels without overlaps, left to right."""
    k = F.size(shape)
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("free"))
    hit = lambda s, i: (i >= s["free"]) & (F.slice(labels, i + 1, k) == shape)
    return F.when(F.size(labels) < k, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(labels) - k), state, lambda s, i: F.when(hit(s, i), F.struct((s["n"] + 1).alias("n"), (i + k).alias("free"))).otherwise(s))["n"])


def _greedy_starts(starts: Column, k: Column) -> Column:
    """Of ascending starts those that a left-to-right pass without overlaps keeps."""
    return F.aggregate(starts, F.array().cast("array<int>"), lambda kept, s: F.when((F.size(kept) == 0) | (s >= F.element_at(kept, -1) + k), F.concat(kept, F.array(s.cast("int")))).otherwise(kept))


def families(events: DataFrame, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """Windows of marks that two sessions or more hold: k, marks, sessions,
    occurrences (without overlaps), distinct marks, low diversity and dominance flags."""
    rows = None
    for k in ladder:
        own = windows(events, k).select(F.lit(k).alias("k"), "session_id", "start", "marks")
        rows = own if rows is None else rows.unionByName(own)
    held = rows.groupBy("k", "marks", "session_id").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    held = held.withColumn("n", F.size(_greedy_starts(F.col("starts"), F.col("k"))))
    found = held.groupBy("k", "marks").agg(F.count("*").alias("sessions"), F.sum("n").alias("occurrences"), F.sort_array(F.collect_list("session_id")).alias("session_set")).where("sessions >= 2")
    top = F.array_max(F.transform(F.array_distinct("marks"), lambda m: F.size(F.filter("marks", lambda x: x == m))))
    return found.withColumns({"distinct_marks": F.size(F.array_distinct("marks")), "low_diversity": F.size(F.array_distinct("marks")) <= 2, "mark_dominance": top * 3 >= F.col("k") * 2})


def receipts(events: DataFrame, ladder: tuple[int, ...] = LADDER, most: int = 3) -> DataFrame:
    """k, marks, session_id and the first places, without overlaps, of each family in
    each session that holds it, as first-last sequence numbers."""
    order = Window.partitionBy("session_id").orderBy("pos")
    rows = None
    for k in ladder:
        last = F.lead("sequence", k - 1).over(order)
        own = windows(events, k).join(events.select("session_id", F.col("pos").alias("start"), F.concat("sequence", F.lit("-"), last).alias("span")), ["session_id", "start"])
        own = own.select(F.lit(k).alias("k"), "session_id", "start", "marks", "span")
        rows = own if rows is None else rows.unionByName(own)
    held = rows.groupBy("k", "marks", "session_id").agg(F.sort_array(F.collect_list(F.struct("start", "span"))).alias("at"))
    kept = F.slice(_greedy_starts(F.col("at.start"), F.col("k")), 1, most)
    spans = F.transform(F.filter("at", lambda x: F.array_contains(kept, x["start"].cast("int"))), lambda x: x["span"])
    sessions = F.count("*").over(Window.partitionBy("k", "marks"))
    return held.withColumn("sessions", sessions).where("sessions >= 2").select("k", "marks", "session_id", F.array_join(spans, ",").alias("receipts"))


def alternates(marks: Column) -> Column:
    """Whether neighbours are always a request and an outcome."""
    opening = lambda m: F.rlike(m, F.lit("tool_requested|observed_tool_started"))
    outcome = lambda m: F.rlike(m, F.lit("tool_succeeded|tool_failed|tool_denied|observed_tool_finished"))
    places = F.sequence(F.lit(0), F.size(marks) - 2)
    return F.forall(places, lambda i: (opening(F.get(marks, i)) & outcome(F.get(marks, i + 1))) | (outcome(F.get(marks, i)) & opening(F.get(marks, i + 1))))


def single_tool(marks: Column) -> Column:
    name = lambda m: F.when(F.contains(m, F.lit("/")), F.regexp_replace(m, "^[^/]*/", ""))
    first = name(F.get(marks, F.lit(0)))
    return first.isNotNull() & F.forall(marks, lambda m: F.coalesce(name(m) == first, F.lit(False)))


def ranked(found: DataFrame, projection: str) -> DataFrame:
    """Adds id: sessions, occurrences and span descending, then marks."""
    place = F.row_number().over(Window.orderBy(F.col("sessions").desc(), F.col("occurrences").desc(), F.col("k").desc(), "marks"))  # one row a family of a bounded corpus
    return found.withColumn("rank", place).withColumn("id", F.format_string(projection + "-%03d", "rank"))


def subsumed(found: DataFrame) -> DataFrame:
    """Adds subsumed_by: the first longer family with the same sessions that holds the marks in a row."""
    key = F.xxhash64("session_set")
    a = found.withColumn("_s", key)
    b = found.select(F.col("id").alias("by_id"), F.col("rank").alias("by_rank"), F.col("k").alias("by_k"), F.col("marks").alias("by_marks"), F.col("session_set").alias("by_set"), key.alias("_s"))
    holds = F.exists(F.sequence(F.lit(1), F.col("by_k") - F.col("k") + 1), lambda i: F.slice("by_marks", i, F.col("k")) == F.col("marks"))
    longer = a.join(b, "_s").where((F.col("by_k") > F.col("k")) & (F.col("by_set") == F.col("session_set"))).where(holds)
    first = longer.groupBy("id").agg(F.min_by("by_id", "by_rank").alias("subsumed_by"))
    return found.join(first, "id", "left")


def folded(found: DataFrame) -> DataFrame:
    """Families with the same set of marks under the best that is neither subsumed nor quarantined:
    variant_of for the others of the kind, variants for the representative."""
    open_ = F.col("subsumed_by").isNull() & ~F.col("low_diversity") & ~F.col("mark_dominance")
    rows = found.withColumn("_key", F.array_sort(F.array_distinct("marks"))).withColumn("_open", open_)
    w = Window.partitionBy("_key")
    rows = rows.withColumn("_head", F.min(F.when(F.col("_open"), F.col("rank"))).over(w))
    rows = rows.withColumn("_head_id", F.max(F.when(F.col("rank") == F.col("_head"), F.col("id"))).over(w)).withColumn("_variants", F.count_if(F.col("_open") & (F.col("rank") != F.col("_head"))).over(w))
    own = F.col("rank") == F.col("_head")
    return rows.withColumn("variants", F.when(own, F.col("_variants")).otherwise(0)).withColumn("variant_of", F.when(F.col("_head").isNotNull() & ~own, F.col("_head_id"))).drop("_key", "_open", "_head", "_head_id", "_variants")


def name(pipeline: Column) -> Column:
    """Steps run-length encoded, with ' loop' when over two runs end as they began."""
    runs = F.aggregate(pipeline, F.array().cast("array<struct<s:string,n:int>>"), lambda acc, p: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["s"] == p), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(p.alias("s"), (F.element_at(acc, -1)["n"] + 1).alias("n"))))).otherwise(F.concat(acc, F.array(F.struct(p.alias("s"), F.lit(1).alias("n"))))))
    shown = F.array_join(F.transform(runs, lambda r: F.when(r["n"] == 1, r["s"]).otherwise(F.concat(r["s"], F.lit("×"), r["n"].cast("string")))), "–")
    return F.concat(shown, F.when((F.size(runs) > 2) & (F.get(runs, F.lit(0))["s"] == F.element_at(runs, -1)["s"]), " loop").otherwise(""))


def exceptional_from(coverage: DataFrame, threshold: float = 0.01) -> dict[int, int]:
    """Span -> the least number of sessions whose tail among the null coverages is within the threshold."""
    out = {}
    for r in coverage.where("replicate >= 0").groupBy("k").agg(F.collect_list("best").alias("v")).collect():  # one row a span
        tail = lambda c, v=r.v: (1 + sum(x >= c for x in v)) / (1 + len(v))
        out[r.k] = next((c for c in range(1, max(r.v) + 2) if tail(c) <= threshold), None)
    return {k: c for k, c in out.items() if c is not None}


def strength(found: DataFrame, eligible: Column, exceptional: dict[int, int] | None = None) -> DataFrame:
    quarantined = F.col("low_diversity") | F.col("mark_dominance")
    beyond = F.lit(False)
    for k, least in (exceptional or {}).items():
        beyond = beyond | ((F.col("k") == k) & (F.col("sessions") >= least))
    return found.withColumn("strength", F.when(quarantined, "probably_recorder_grammar").when(beyond, "promising_beyond_local_grammar").when(F.col("sessions") * 2 >= eligible, "descriptively_common").otherwise("weak_lead"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer join of two runs' families on their marks: gained, lost, strengthened, weakened, unchanged."""
    a, b = before.select("marks", F.col("sessions").alias("before")), after.select("marks", F.col("sessions").alias("after"))
    change = F.when(F.col("before").isNull(), "gained").when(F.col("after").isNull(), "lost").when(F.col("after") > F.col("before"), "strengthened").when(F.col("after") < F.col("before"), "weakened").otherwise("unchanged")
    return a.join(b, "marks", "full_outer").withColumn("change", change)
