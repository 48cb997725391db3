"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing
columns: what test_operators.py doesn't hold of chat formatting, token counts and the pipeline."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline as C
from chronoloom.llm import bpecount, chat
from chronoloom.llm.common import written

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")


def test_chat_of_an_empty_table(spark):
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_of_repeated_rows_long_conversations_and_clashing_columns(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    rows += [(2, n, "user" if n % 2 == 0 else "assistant", f"turn {n} ### " + "x" * (n % 7)) for n in range(6000)]
    rows += [(3, 0, "user", "y" * 300_000), (3, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, "other", 1, None) for r in rows], "conv_id long, turn long, role string, text string, segment string, loss int, n_turns string")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    for conv in (1, 2, 3):
        own = [(role, text or "") for c, _, role, text in rows if c == conv]
        told = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in own).encode()).hexdigest()
        loss = "".join(text for role, text in own if role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars) == (len(own), told, len(loss))
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert not got[1].valid and got[2].valid


def test_token_counts_of_edges(spark):
    import tokenizers

    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a null id"), (4, "again"), (4, "again"), (5, "long text, é 漢字 " * 20_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_tokens string, n_bytes int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpecount.token_counts(df, path).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert bpecount.token_counts(df.limit(0), path).count() == 0


def stages(spark, docs):
    out = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        out.append(written(stage(spark, out[-1], SF), "edges"))
        assert k == len(C.STAGES) - 1 or out[-1].dtypes == docs.dtypes
    return out


def test_pipeline_of_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    letters = lambda n: "".join("aeioulnrst"[int(c)] for c in str(n))
    long = "word0 of " + " ".join(f"{letters(i)} {letters(7 * i + 3)}" for i in range(100, 15_000))
    odd = [(None, long, "en", None, 1), (9001, None, "en", "a", 0), (9002, "", None, "a", 0), (9003, long + " end", "en", "b", 1), (9004, " \n", "en", None, 2), (None, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(30))  # repeated rows
    docs = docs.selectExpr("*", "1 AS size", "'x' AS _row", "doc_id AS row", "text AS label")
    steps = stages(spark, docs)
    kept = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in steps[:-1]]
    assert not {9001, 9002, 9004} & {i for i, _ in kept[1]} and all(t for _, t in kept[1])
    assert sum(t is not None and t.startswith("word0 of") for _, t in kept[1]) == 2  # two near copies of the long text, one without an id
    assert sum(t.startswith("word0 of") for _, t in kept[2]) == 1
    ids = [i for i, _ in kept[2] if i is not None]
    assert len(ids) == len(set(ids))  # repeated rows were one group
    assert steps[-1].count() == len(kept[4])


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).selectExpr("*", "1 AS size")
    assert all(s.count() == 0 for s in stages(spark, docs))
