"""Line deduplication in rounds: bits a line stay as they are, whatever the number of lines."""

from __future__ import annotations

import random

import numpy as np

from chronoloom.llm import linededup


def test_rounds_keep_suspects_few_and_results_whole(spark):
    r = random.Random(2)
    line = lambda: "".join(r.choice("abcdefghij") for _ in range(16))
    shared = [line() for _ in range(300)]
    rows = [(i, "\n".join([*(line() for _ in range(60)), r.choice(shared), "short"])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    small = docs.selectExpr("doc_id AS id", "text")
    rounds, bits = linededup.rounds_of(small, 16, 1 << 17)
    assert (rounds, bits) == (6, 1 << 17)
    tables = linededup.suspected(small, linededup.MIN_CHARS, 16, 1 << 17)
    suspects = sum(t.count() for t in tables)
    keys = [{x.h for x in t.select("h").distinct().collect()} for t in tables]
    assert len(tables) == 6 and all(not a & b for i, a in enumerate(keys) for b in keys[:i])  # a key is of one round
    assert 650 <= suspects <= 700 + 0.06 * 700 * 60
    key = lambda found: sorted(map(tuple, found.collect()))
    assert key(linededup.report(docs, max_bits=1 << 17)) == key(linededup.report(docs))


def test_filters_are_as_large_as_their_bits(spark):
    rows = spark.createDataFrame([(1, "a line that is long enough\nanother line of some length"), (2, "A line that is long enough ")], "id long, text string")
    found = linededup.twice_seen(rows, 1 << 16, 10)
    assert found.nbytes == (1 << 16) // 8 and 1 <= int(np.unpackbits(found).sum()) <= 2
