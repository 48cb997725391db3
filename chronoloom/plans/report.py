"""The corpus report: facts as one JSON document, and Markdown made from the facts alone.

Facts hold one row per session of the ledger, eligible (at most 64) or left out with
its reason, the numbers of both, and the families that lead.  Command text never gets here; only categories do.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import corpus as C
from .corpus import judged

LEADS, BACKGROUND, SHOWN = 5, 6, 20
MOVEMENTS = ("gained", "strengthened", "weakened", "lost", "unchanged")


def facts(ledger: DataFrame, label: str) -> dict:
    """Totals, sessions with the reason they are left out for, and ranked families of those that aren't."""
    acts = C.actions(ledger)
    why = C.eligibility(acts, ledger)
    kept = acts.join(why.where("skipped is null").select("session_id"), "session_id", "left_semi")
    flow = C.workflow(kept, ledger)
    eligible = why.where("skipped is null").count()
    found = judged(flow, eligible)
    open_ = found.where("subsumed_by is null and variant_of is null")
    columns = ("id", "name", "k", "marks", "sessions", "occurrences", "variants", "strength")

    def top(rows: DataFrame, n: int) -> list[dict]:
        return [r.asDict(recursive=True) for r in rows.orderBy("rank").limit(n).select(*columns).collect()]

    plain = lambda rows: [r.asDict(recursive=True) for r in rows.collect()]
    return {
        "label": label,
        "sessions": plain(why.orderBy("session_id")),
        "eligible": eligible,
        "skipped": {r.skipped: r.n for r in why.where("skipped is not null").groupBy("skipped").agg(F.count("*").alias("n")).collect()},
        "actions": plain(C.session_facts(kept).orderBy("session_id")),
        "families": found.count(),
        "by_category": _sums(kept, "category", C.CATEGORIES),
        "by_outcome": _sums(kept, "outcome", C.OUTCOMES),
        "tools": [r.asDict() for r in kept.groupBy("tool").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tool").limit(SHOWN).collect()],
        "unpaired": kept.where("outcome = 'no-outcome-observed'").count(),
        "by_strength": {r.strength: r.n for r in found.groupBy("strength").agg(F.count("*").alias("n")).collect()},
        "subsumed": found.where("subsumed_by is not null").count(),
        "leads": top(open_.where("strength <> 'probably_recorder_grammar'"), LEADS),
        "background": top(open_.where("strength = 'probably_recorder_grammar'"), BACKGROUND),
    }


def _sums(rows: DataFrame, column: str, names: tuple[str, ...]) -> dict[str, int]:
    """Counts of each name, zeros kept."""
    held = {r[0]: r.n for r in rows.groupBy(column).agg(F.count("*").alias("n")).collect()}
    return {n: held.get(n, 0) for n in names}


def manifest(files: DataFrame, judged_files: DataFrame, width: int = 8) -> list[dict]:
    """What went in: each file's identity (shortened), fingerprint, bytes, records, whether it
    is cut short, and why it was left out; files has path, fingerprint and bytes."""
    rows = judged_files.join(files, "path").orderBy("path")
    return [r.asDict() for r in rows.select(F.left("key", F.lit(width)).alias("identity"), "fingerprint", "bytes", "records", (F.col("status") == "truncated").alias("truncated"), "actions", "skipped").collect()]


def comparison(before: DataFrame, after: DataFrame, labels: tuple[str, str], eligible: tuple[int, int]) -> dict:
    """How the families of one corpus stand in another: numbers of each movement, and
    its best supported families; a document of bounded size."""
    both = C.compare(before, after).withColumn("support", F.coalesce("before", F.lit(0)) + F.coalesce("after", F.lit(0)))
    both = both.withColumn("name", C.name(F.col("marks"))).withColumn("line", F.array_join("marks", " > "))
    place = F.row_number().over(Window.partitionBy("change").orderBy(F.col("support").desc(), "line"))
    shown = both.withColumn("place", place).where(F.col("place") <= SHOWN).orderBy("change", "place").collect()
    counts = {r.change: r.n for r in both.groupBy("change").agg(F.count("*").alias("n")).collect()}
    return {
        "labels": list(labels),
        "eligible": list(eligible),
        "counts": {m: counts.get(m, 0) for m in MOVEMENTS},
        "families": {m: [{"name": r["name"], "marks": r.line, "before": r.before, "after": r.after} for r in shown if r.change == m] for m in MOVEMENTS},
    }


def render_comparison(document: dict) -> str:
    """Markdown from a comparison."""
    (a, b), (na, nb) = document["labels"], document["eligible"]
    out = [f"# Corpus comparison: {b} against {a}", "", f"{a} has {na} eligible sessions, {b} has {nb}; shapes are matched on their exact steps, and a shape can gain sessions and still be a smaller share.", ""]
    for m in MOVEMENTS:
        out += [f"## {m.capitalize()} ({document['counts'][m]})", ""]
        held = lambda n, of, label: f"{n} of {of} sessions in {label}" if n is not None else f"not found in {label}"
        out += [f"- **{f['name']}** (`{f['marks']}`): {held(f['before'], na, a)}, {held(f['after'], nb, b)}" for f in document["families"][m]] or ["None."]
        if document["counts"][m] > SHOWN:
            out.append(f"- and {document['counts'][m] - SHOWN} more")
        out.append("")
    return "\n".join(out)


def write(folder: str, document: dict, inputs: list[dict], elapsed_ms: int, generated_at: str) -> None:
    """facts.json, manifest.json and report.md, the same for the same corpus, and run.json, which alone may differ."""
    os.makedirs(folder, exist_ok=True)
    held = {"facts.json": to_json(document), "manifest.json": to_json({"inputs": inputs}), "report.md": render(document), "run.json": to_json({"elapsed_ms": elapsed_ms, "generated_at": generated_at})}
    for name, text in held.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text.rstrip("\n") + "\n")


def to_json(document: dict) -> str:
    return json.dumps(document, sort_keys=True, indent=1, ensure_ascii=False)


def render(document: dict) -> str:
    """Markdown from a facts document."""
    total = document["eligible"] + sum(document["skipped"].values())
    actions = sum(document["by_category"].values())
    lead = document["leads"][0]["name"] if document["leads"] else None
    out = [f"# Corpus report: {document['label']}", "", "## In short", "", f"{document['eligible']} of {total} sessions are eligible; they share {document['families']} shapes." + (f" The first lead is {lead}." if lead else " None of them is a lead."), ""]
    out += ["## The corpus at a glance", "", f"{actions} actions in {document['eligible']} sessions; {document['unpaired']} have no observed outcome.", ""]
    for title, names in (("category", C.CATEGORIES), ("outcome", C.OUTCOMES)):
        out += [f"| {title} | actions |", "|-|-|", *[f"| {n} | {document['by_' + title][n]} |" for n in names], ""]
    out += ["| tool | actions |", "|-|-|", *[f"| {t['tool'] or '(none)'} | {t['n']} |" for t in document["tools"]], ""]
    skipped = [s for s in document["sessions"] if s["skipped"]]
    if skipped:
        out += ["## Sessions left out", "", *[f"{n} for {why.replace('_', ' ')}." for why, n in sorted(document["skipped"].items())], "", *[f"- {s['session_id'][:8]}: {s['skipped'].replace('_', ' ')}" for s in skipped], ""]
    for title, key in (("Leads", "leads"), ("Probably the recorder's own grammar", "background")):
        out += [f"## {title}", ""]
        out += [f"- **{f['name']}** ({f['id']}): in {f['sessions']} sessions, {f['occurrences']} times, {f['variants']} variants" for f in document[key]] or ["None."]
        out.append("")
    out += ["## What the shapes are worth", "", *[f"- {n} {why.replace('_', ' ')}" for why, n in sorted(document["by_strength"].items())], f"- {document['subsumed']} are part of a longer shape of the same sessions", ""]
    out += ["## Limits", "", "A shape is an order of categories and outcomes, not of intentions. Sessions of few actions or one category are left out, and at most 64 are read. A strength says how a shape stands against sequences with the same pairs of steps, not what it is good for.", ""]
    return "\n".join(out)
