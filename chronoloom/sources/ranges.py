"""Recordings read by byte ranges, and their ends alone.

:func:`ranges` reads files through Spark's text source, which cuts them into byte ranges
of spark.sql.files.maxPartitionBytes and hands every line to the range that it begins
in; no row holds a file, and a file is as many tasks as it has ranges.  Line numbers and
offsets follow from the ranges' own counts, a row a range.  Its result goes wherever
``recordings`` takes files: recordings(), checked(), ledger(), replayed(), exits().

:func:`ends` reads the last line of each file and no more: from the end back in blocks of
8 KiB, through pyarrow's file systems (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .recordings import empty_files

NEWLINE = "\n"
BOM = b"\xef\xbb\xbf"  # the text source takes it off a file's first line


def _numbered(batches):
    """Adds each line's number and first byte within its range, from 0; a range's lines come one after another."""
    last, count, size = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
        new = np.array([i for i in range(len(keys)) if keys[i] != (keys[i - 1] if i else last)], np.int64)
        start = np.concatenate([[0], new]) if not len(new) or new[0] else new
        first = np.repeat(start, np.diff(np.append(start, len(keys))))
        n = np.arange(len(keys)) - first
        ends = np.cumsum(pc.binary_length(batch.column(3)).to_numpy().astype(np.int64) + 1)
        within = np.concatenate([[0], ends[:-1]])
        within -= within[first]
        if not len(new) or new[0]:
            on = slice(new[0] if len(new) else len(keys))
            n[on] += count
            within[on] += size
        last, count, size = keys[-1], int(n[-1]) + 1, int(within[-1]) + len(batch.column(3)[-1].as_py()) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(within)], names=["path", "size", "block", "raw", "n", "within"])


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """path, size, line_no, offset, raw (a line's bytes), terminated, of every *.ndjson file of a folder.

    A line that no newline ends is the file's tail.  Empty files have one row, without a line."""
    text = spark.read.option("pathGlobFilter", "*.ndjson").option("lineSep", NEWLINE).text(path)
    held = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))
    rows = held.mapInArrow(_numbered, "path string, size long, block long, raw binary, n long, within long")
    per = held.groupBy("path", "size", "block").agg(F.count("*").alias("lines"), F.sum(F.octet_length("raw") + 1).alias("bytes"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marked = F.col("size") - F.sum("bytes").over(Window.partitionBy("path")) >= len(BOM) - 1
    sums = per.select("path", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), marked.alias("marked"))
    rows = rows.join(sums, ["path", "block"])
    first = F.col("marked") & (F.col("n") + F.col("lines_before") == 0)
    shift = F.when(F.col("marked") & ~first, len(BOM)).otherwise(0)
    rows = rows.select("path", "size", (F.col("lines_before") + F.col("n") + 1).alias("line_no"), (F.col("bytes_before") + F.col("within") + shift).alias("offset"), F.when(first, F.concat(F.lit(BOM), F.col("raw"))).otherwise(F.col("raw")).alias("raw"))
    rows = rows.withColumn("terminated", F.col("offset") + F.octet_length("raw") < F.col("size"))
    empty = empty_files(spark, path)
    return rows.unionByName(spark.createDataFrame([(p, 0, None, 0, None, False) for p in empty], rows.schema)) if empty else rows


#: Bytes of a step back from a file's end.
STEP = 8192


def last_line(file, size: int) -> tuple[bytes | None, int, int]:
    """From an open file: its last complete line (None: there is none, or a fragment follows), the length of an
    unterminated fragment, and how many bytes were read."""
    held, at = b"", size
    while at > 0:
        start = max(0, at - STEP)
        file.seek(start)
        held = file.read(at - start) + held
        at = start
        ended = held.endswith(b"\n")
        cut = held.rfind(b"\n", 0, len(held) - 1 if ended else len(held))
        if cut >= 0 or at == 0:
            line = held[cut + 1 :]
            return (line[:-1], 0, size - at) if ended else (None, len(line), size - at)
    return None, 0, 0


ENDS = "path string, status string, line binary, fragment long, bytes_read long"


def ends(spark: SparkSession, path: str) -> DataFrame:
    """path, status, version, session_id, records, fragment, bytes_read of every *.ndjson file: what
    appending needs to know, from a file's last line alone.

    status is complete (an empty file is, with no records), truncated (a fragment follows the last newline) or malformed_record (a
    last line that is no record); the lines before it aren't looked at."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ndjson").load(path).select("path", "length")  # contents aren't read
    empty = empty_files(spark, path)
    if empty:
        found = found.unionByName(spark.createDataFrame([(p, 0) for p in empty], found.schema))

    def run(batches):
        from pyarrow.fs import FileSystem

        for batch in batches:
            out = []
            for p, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = FileSystem.from_uri(p if "://" in p else p.replace("file:/", "file:///", 1) if p.startswith("file:/") else f"file://{p}")
                with system.open_input_file(name) as file:
                    line, fragment, read = last_line(file, size)
                out.append((p, "truncated" if fragment else "complete", line, fragment, read))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["path", "status", "line", "fragment", "bytes_read"])

    rows = found.mapInArrow(run, ENDS)
    text = F.when(F.is_valid_utf8(F.col("line").cast("string")), F.col("line").cast("string"))
    rows = rows.withColumn("v", F.try_parse_json(text))
    get = lambda p, t: F.try_variant_get("v", p, t)
    rows = rows.withColumns({"version": get("$.schema_version", "bigint"), "session_id": get("$.session_id", "string"), "records": get("$.sequence", "decimal(20,0)")})
    sound = F.col("version").isin(1, 2) & F.col("session_id").isNotNull() & (F.col("records") >= 1)
    status = F.when(F.col("line").isNotNull() & ~F.coalesce(sound, F.lit(False)), "malformed_record").otherwise(F.col("status"))
    return rows.select("path", status.alias("status"), "version", "session_id", F.coalesce("records", F.lit(0)).cast("decimal(20,0)").alias("records"), "fragment", "bytes_read")
