"""The pipeline: every stage's decisions take effect on what came before."""

from __future__ import annotations

import pytest

import corpus_pipeline as C
from chronoloom.llm import quality
from chronoloom.llm.common import written

from .test_operators import PLAIN, lower, plain_classes

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        steps.append(written(stage(spark, steps[-1], SF), "test"))
        assert k == len(C.STAGES) - 1 or steps[-1].columns == columns
    texts = [[(r.doc_id, r.text) for r in s.collect()] for s in steps[:-1]]
    ids = [[i for i, _ in t] for t in texts]

    kept = {r.doc_id for r in quality.score(docs).where("kept").collect()}
    assert sorted(ids[1]) == sorted(kept)

    heads = {c for _, _, c in plain_classes(texts[1], 5, 80)} | {d for d, n, _ in plain_classes(texts[1], 5, 80) if not n}
    assert sorted(ids[2]) == sorted(heads)

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = PLAIN.findall(lower(r.text))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if w}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = PLAIN.findall(lower(text))
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert sorted(ids[3]) == sorted(i for i, t in texts[2] if clean(t))
    assert set(ids[4]) <= set(ids[3]) and max(map(ids[4].count, set(ids[4]))) <= 2
    assert sorted(r.doc_id for r in steps[-1].collect()) == sorted(ids[4])
