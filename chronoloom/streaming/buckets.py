"""Origin-aligned buckets of a stream (signal.sparse as it arrives).

Buckets start at a session's earliest record, and that may arrive last.  The state of a
session is its origin, its latest time, and its records by slots of one bucket's width that are aligned
to the epoch: a bucket lies in two neighbouring slots, so a batch reads and writes only the slots
that it touches.  When an earlier record moves the origin, the buckets of the
session are made anew from all slots, and those that are gone come out as zeros.  There is no
watermark and nothing is dropped as late.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDS, BYTES = "distinct_correlation_ids", "recorded_response_json_bytes"
CHANGES = "session_id string, dimension string, bucket long, value double, buckets long, origin_ns long"


def cells(entries: list, origin: int, width: int) -> dict[tuple[str, int], float]:
    """(dimension, bucket) -> value of entries (epoch_ns, dimensions, id, bytes); only what isn't zero."""
    out: Counter = Counter()
    ids = defaultdict(set)
    for at, dimensions, own, size in entries:
        bucket = (at - origin) // width
        for d in dimensions:
            out[d, bucket] += 1.0
        if own is not None:
            ids[IDS, bucket].add(own)
        if size:
            out[BYTES, bucket] += size
    return dict(out) | {k: float(len(v)) for k, v in ids.items()}


class Buckets(StatefulProcessor):
    def __init__(self, width_ns: int):
        self.width = width_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.axis = handle.getValueState("axis", "origin_ns long, latest_ns long")
        self.slots = handle.getMapState("slots", "slot long", "entries string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        w, new = self.width, defaultdict(list)
        for frame in rows:
            for at, dimensions, own, size in zip(frame["epoch_ns"], frame["dimensions"], frame["corr"], frame["response_bytes"], strict=True):
                new[int(at) // w].append([int(at), list(dimensions), own if isinstance(own, str) else None, None if pd.isna(size) else float(size)])
        if not new:
            return
        times = [e[0] for entries in new.values() for e in entries]
        before, latest = self.axis.get() if self.axis.exists() else (None, max(times))
        origin, latest = min(times if before is None else [before, *times]), max(latest, *times)
        held = {}  # slots as they were
        if before is not None and origin < before:
            held = {k[0]: json.loads(v[0]) for k, v in self.slots.iterator()}
            gone = dict.fromkeys(cells([e for x in held.values() for e in x], before, w), 0.0)
            touched = None
        else:
            gone, touched = {}, {(t - origin) // w for t in times}
            for slot in {(origin + b * w) // w + i for b in touched for i in (0, 1)}:
                if self.slots.containsKey((slot,)):
                    held[slot] = json.loads(self.slots.getValue((slot,))[0])
        for slot, entries in new.items():
            held[slot] = held.get(slot, []) + entries
            self.slots.updateValue((slot,), (json.dumps(held[slot]),))
        self.axis.update((origin, latest))
        found = cells([e for x in held.values() for e in x if touched is None or (e[0] - origin) // w in touched], origin, w)
        changes = [(key[0], d, b, v) for (d, b), v in (gone | found).items()]
        yield pd.DataFrame(changes, columns=["session_id", "dimension", "bucket", "value"]).assign(buckets=(latest - origin) // w + 1, origin_ns=origin)

    def close(self) -> None:
        pass


def bucketed(ledger: DataFrame, width_ms: int) -> DataFrame:
    """The changes of (session_id, dimension, bucket) -> value as records of the ledger arrive, with the session's number of
    buckets and its origin so far: a key's last change is its value, 0 where there is none (any more).

    State stores need RocksDB: spark.sql.streaming.stateStore.providerClass."""
    labels = F.array(F.lit("records"), F.concat(F.lit("channel:"), "channel"), F.concat(F.lit("kind:v"), F.col("version").cast("string"), F.lit(":"), "kind"), F.concat(F.lit("tool_name:"), "tool_name"))
    rows = ledger.where("epoch_ns is not null").select("session_id", "epoch_ns", F.array_compact(labels).alias("dimensions"), F.concat_ws(":", F.col("version").cast("string"), "corr_id").alias("corr"), "corr_id", F.col("response_bytes").cast("double").alias("response_bytes"))
    rows = rows.withColumn("corr", F.when(F.col("corr_id").isNotNull(), F.col("corr"))).drop("corr_id")
    return rows.groupBy("session_id").transformWithStateInPandas(Buckets(width_ms * 1_000_000), CHANGES, "Append", "None")
