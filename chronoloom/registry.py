"""All registered queries of the event-log engine, and their SQL."""

from __future__ import annotations

from pathlib import Path

from .plans import alignments, corpus, inspection, sequences, sources, statistics, studies

MODULES = (inspection, sequences, alignments, statistics, corpus, sources, studies)
ROOT = str(Path(__file__).resolve().parent.parent)


def workers_find_package(spark) -> None:
    """Python workers look for this package where the driver has found it."""
    held = spark.sparkContext.environment
    if ROOT not in held.get("PYTHONPATH", "").split(":"):
        held["PYTHONPATH"] = ":".join(x for x in (ROOT, held.get("PYTHONPATH")) if x)


def runnable(query):
    """The query, with the package on its workers' path."""

    def run(spark, sf_dir):
        workers_find_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: runnable(v) for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
