"""Each operator against a plain version on small tables with nulls, empty and long
texts, ties, repeated rows, an empty table, and columns with clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import bpecount, chat, decontam, jaccard, licenses, linededup, mixing, pii, quality, textkit, wavelet
from chronoloom.llm import queries as llm

from ..oracle import check

SF = "/root/testdata/sf0.001"
SPACES, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
P = pytest.importorskip("public_tokenizers")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def thue_morse(n, flip=0):
    """A text of n letters; with its flip it has equal polynomial hashes modulo 2**64."""
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß漢") for _ in range(r.randrange(1, 6)))
    base = [" ".join(word() for _ in range(r.randrange(1, 120))) for _ in range(25)]
    out = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):  # near copies
        w = t.split(" ")
        w[r.randrange(len(w))] = "changed"
        out.append((100 + i, " ".join(w)))
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "one two"), (205, base[3]), (206, base[3].upper()), (None, base[4]), (207, "x " * 20000), (207, "x " * 20000)]
    out += [(300 + i, f"Shared line of some length\nown {word()} {i}\n  SHARED LINE of some length  \nshort\n{word()}") for i in range(6)]
    out += [(400, "Licensed under the Apache License, Version 2.0. Mail a.b@c.example.org or +1 (988) 555-2485, 10.0.0.256 10.0.0.25 4387513035237269"), (401, "gnu GENERAL public-license; cc by, MIT License cc")]
    for k, n in enumerate((1024, 2048, 8192)):
        x, y = thue_morse(n), thue_morse(n, 1)
        out += [(500 + 10 * k, x), (501 + 10 * k, y), (502 + 10 * k, x + "\n" + y), (503 + 10 * k, x + "\n" + x + "\n" + x)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, ("a", "b", None)[k % 3], 1, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, n_words int, kept string")


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def same(found, want, key=repr):
    assert sorted(found, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(set(llm.ORACLE_SQL)))
def test_sql(spark, name):
    assert check(spark, llm.QUERIES[name], llm.ORACLE_SQL[name], SF)


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    path = P.path("word_bpe_49k.json")
    for df in (quality.score(none), quality.keep(none), jaccard.classes(none), jaccard.representatives(none), linededup.report(none), linededup.deduplicate(none), licenses.scan(none), mixing.plan(none), mixing.mix(none), pii.scan(none), bpecount.token_counts(none, path), decontam.contamination(none, bench), decontam.clean(none, bench), wavelet.round_trip(none, P.path("byte_bpe_50k.json"))):
        assert df.count() == 0


def test_chat_round_trip():
    t, r = chat.Template(), random.Random(1)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "system", "", "to:ol### "]), "".join(r.choice(["\\", "###", " ", "</turn>", "\n", "a", ": ", "### User: "]) for _ in range(r.randrange(8)))) for _ in range(4)]
        assert t.parse("".join(s for role, said in turns for s, _ in t.segments(role, said))) == turns


def test_chat_order(spark):
    c = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (3, 1, None, "z"), (3, None, "user", "é"), (None, 0, "user", "n")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(c).collect()}
    assert got[1].valid and got[2].n_invalid == 1 and not got[3].valid
    assert got[1].loss_chars == 0 and got[2].loss_chars == 1 and got[3].n_turns == 2
    assert got[3].turns_sha256 == hashlib.sha256("user\né\n\nz\n".encode()).hexdigest()


def test_quality_base(rows, docs):
    want = []
    for i, t in rows:
        w = SPACES.findall(t or "")
        lines = [x for x in (t or "").split("\n") if SPACES.search(x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        cover = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    found = quality.score(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found], want)
    assert not any(r.kept and r.base_failed for r in found)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)


def test_quality_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.score(d).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("p")).collect()
    share = {r.quality: r.p for r in got}
    assert share[1] > 0.98 and share[0] < 0.1


def test_accuracies_are_recovered():
    r = np.random.default_rng(2)
    good = r.random(20000) < 0.8
    right = np.linspace(0.7, 0.95, len(quality.RULES))
    v = np.where(r.random((20000, len(right))) < 0.3, 0, np.where((r.random((20000, len(right))) < right) == good[:, None], 1, 2)).astype(np.uint8)
    kinds, n = np.unique(v, axis=0, return_counts=True)
    model = quality.fit(kinds, n.astype(float))
    assert np.abs(model.accuracies() - right).max() < 0.05
    assert ((model.posterior(v.astype(int)) > 0.5) == good).mean() > 0.95


def plain_ids(rows, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return {(i, x): t.encode(x or "", add_special_tokens=False).ids for i, x in rows}


def test_token_shards(rows, docs):
    path = P.path("byte_bpe_50k.json")
    ids = plain_ids(rows, path)
    found = wavelet.round_trip(docs, path, shard_ids=500).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in found), key=lambda x: (x is not None, x))
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    crc = lambda x: zlib.crc32(np.array([*x, 2], "<u4").tobytes())
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in found], [(i, len(ids[i, x]) + 1, crc(ids[i, x])) for i, x in rows])


def test_wavelet_operations():
    v = np.random.default_rng(3).integers(0, 300, 3000)
    data = wavelet.to_bytes(v, np.array([7]), np.array([False]), np.array([3000]))
    m, names, nulls, lengths = wavelet.from_bytes(data)
    assert (m.decode() == v).all() and names[0] == 7 and lengths[0] == 3000 and not nulls[0]
    for x in (0, 5, 299, 301):
        at = np.flatnonzero(v == x)
        assert m.count(x) == len(at) and m.rank(x, 1000) == (at < 1000).sum()
        assert [m.select(x, k) for k in range(len(at))] == at.tolist() and m.select(x, len(at)) == -1
    assert [m.access(i) for i in range(0, 3000, 97)] == v[::97].tolist()


def test_token_counts(rows, docs):
    path = P.path("word_bpe_49k.json")
    more = ["a<|endoftext|>b", "ΑΣ Σ é", "It's  WE'LL 12.5 ½", "x" * 2000]
    ids = plain_ids([*rows, *enumerate(more)], path)
    found = bpecount.token_counts(docs, path).collect()
    same([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found], [(i, len((x or "").encode()), len(ids[i, x]), len(ids[i, x]) > 2048) for i, x in rows])
    table = bpecount.load(path)
    for i, x in enumerate(more):
        assert table.count(x, {}) == len(ids[i, x])


PATTERNS = [
    (0, re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    (1, re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    (2, re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(re.sub("[ -]", "", m)) <= 19 and pii.luhn(re.sub("[ -]", "", m))),
    (3, re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def test_personal_data_base(rows, docs):
    plain = lambda t: sorted((m.start(), k, m.end()) for k, p, ok in PATTERNS for m in p.finditer(t) if ok(m[0]))
    r = random.Random(8)
    for _ in range(5000):
        t = "".join(r.choice("0123456789..@+ -()ab") for _ in range(r.randrange(40)))
        assert pii.base_spans(t) == plain(t)
    for row in pii.scan(docs).collect():
        texts = [t for i, t in rows if i == row.doc_id]
        base = [pii.joined(plain(t or "")) for t in texts]
        assert row.base_sha256 in {hashlib.sha256(b.encode()).hexdigest() for b in base}
        assert any(set(b.split(",")) - {""} <= set(row.spans.split(",")) for b in base)


def test_model_finds_held_out_spans():
    r, model = np.random.default_rng(1234), pii.trained()
    found = wanted = false = 0
    for _ in range(150):
        text, spans = pii.example(r)
        got = {(a, k, b) for a, k, b, sure in pii.model_spans(model, [text])[0] if sure >= pii.CONFIDENCE and pii.plausible(k, text[a:b])}
        wanted, found, false = wanted + len(spans), found + len(got & set(spans)), false + len(got - set(spans))
    assert found / wanted > 0.7 and false < 0.05 * wanted


def test_decoding_against_all_paths():
    """Best path and label probabilities, by enumeration of all paths."""
    model, r = pii.BiLstmCrf(), np.random.default_rng(3)
    model.p["S"] = r.standard_normal((9, 9)).astype(np.float32)
    e = r.standard_normal((3, 4, 9)).astype(np.float32)
    paths, sure = model.decode(e)
    every = np.array(list(itertools.product(range(9), repeat=4)))
    for k in range(3):
        score = sum(e[k, t, every[:, t]] for t in range(4)) + sum(model.p["S"][every[:, t], every[:, t + 1]] for t in range(3))
        weight = np.exp(score - score.max())
        assert paths[k].tolist() == every[score.argmax()].tolist()
        want = [weight[every[:, t] == paths[k, t]].sum() / weight.sum() for t in range(4)]
        assert sure[k] == pytest.approx(want, abs=1e-4)


def test_windows_are_reconciled():
    r = random.Random(7)
    for _ in range(200):
        spans = {(a, r.randrange(4), a + r.randrange(1, 6)): r.random() for a in [r.randrange(20) for _ in range(6)]}
        apart = lambda c: all(x[2] <= y[0] or y[2] <= x[0] for x, y in itertools.combinations(c, 2))
        best = max(sum(spans[x] for x in c) for n in range(len(spans) + 1) for c in itertools.combinations(spans, n) if apart(c))
        got = pii.reconciled(spans)
        assert apart(got) and sum(x[3] for x in got) == pytest.approx(best)


def test_a_long_number():
    """A long stretch of digits takes time in proportion, and hides nothing around it."""
    text = "7" * 300_000 + " mail a.b (@) example.org and 4387 5130 3523 7269"
    base, every = pii.all_spans(pii.trained(), [text])[0]
    assert set(base) <= set(every) and any(k == 2 for _, k, _ in base)


def plain_classes(rows, words, percent):
    sets = []
    for _, t in rows:
        w = SPACES.findall(lower(t))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(d, first.get(find(i), d))
    return [(d, len(s), first.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 10**6), (5, 80, 10**6), (3, 90, 120), (5, 80, 120)])
def test_jaccard_classes(rows, docs, words, percent, block):
    found = jaccard.classes(docs, words=words, percent=percent, block_shingles=block)
    same([tuple(r) for r in found.collect()], plain_classes(rows, words, percent))


def test_one_of_each_class_stays(docs):
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {c for _, n, c in plain_classes([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if c is not None}
    assert {i for i in ids if i is not None} == want and len([i for i in ids if i is not None]) == len(want)


def test_routing_loses_no_pair():
    r = np.random.default_rng(0)
    draw = lambda n: np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    for percent in (80, 90):
        for n in (1, 5, 9, 10, 20, 60, 300, 2000):
            for _ in range(20):
                a = draw(n)
                cut = int(n * (1 - percent / 100) / 2)
                b = np.unique(np.concatenate([r.permutation(a)[cut:], draw(cut)]))
                heavy = np.sort(r.permutation(a)[: n // 2]), r.integers(8, 99, n // 2)
                if jaccard.linked(a, b, percent):
                    assert set(jaccard.routing_keys(a, percent, heavy)) & set(jaccard.routing_keys(b, percent, heavy))


@pytest.mark.parametrize("bits", [1 << 16, 1 << 28])
def test_line_dedup(rows, docs, bits):
    strip = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
    key = lambda x: lower(strip.sub("", x))
    last = (1 << 63) - 1
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(last if i is None else i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) != (last if i is None else i))]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    same([tuple(r) for r in linededup.report(docs, max_bits=bits).collect()], want)
    out = linededup.deduplicate(docs, max_bits=bits)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_licenses(rows, docs):
    want = []
    for i, t in rows:
        w = PLAIN.findall(lower(t))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want.append((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    found = licenses.scan(docs).collect()
    same([tuple(r)[:6] for r in found], want)
    apache = next(r for r in found if r.doc_id == 400)
    assert apache.labels == "apache,apache-2.0" and apache.score == 1.0
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in found)


def test_mixing_comes_near_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = mixing.plan(d).join(d.select("doc_id", "source"), "doc_id")
    for r in p.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("a"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.a) <= r.m
    assert p.where("taken > 2 * size").isEmpty()
    assert mixing.mix(d).count() == p.agg(F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0))).first()[0]
    same(mixing.plan(d).collect(), mixing.plan(d.repartition(7)).collect())


def test_mixing_edges(docs):
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(docs).columns == docs.columns


@pytest.mark.parametrize("block", [20, 10**6])
def test_decontamination(spark, rows, docs, block):
    bench = [(1, " ".join(rows[0][1].split()[:15])), (2, "one two"), (3, rows[5][1]), (3, rows[5][1]), (4, None), (None, "x x x"), (5, " ".join(["x"] * 12)), (10, ""), (11, thue_morse(1024)), (12, thue_morse(2048, 1))]
    windows = []
    for k, t in bench:
        w = PLAIN.findall(lower(t))
        n = min(10, len(w))
        windows += [("" if k is None else str(k), tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if w else []
    want = []
    for i, t in rows:
        w = PLAIN.findall(lower(t))
        hit, items = set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    items.add(item)
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    table = spark.createDataFrame(bench, "item_id long, text string")
    same([tuple(r) for r in decontam.contamination(docs, table, block_words=block).collect()], want)
    assert decontam.clean(docs, table, block_words=block).count() == sum(not x[5] for x in want)


def test_windows_of_common_words():
    """Many windows of a few common words: chunks of candidates, and all occurrences."""
    r = random.Random(2)
    items = [(str(k), " ".join(r.choice("abcd") for _ in range(10))) for k in range(20_000)]
    index = decontam.WindowIndex(items, 10)
    index.order(np.ones(len(index.vocabulary), np.int64))
    words = [r.choice("abcd") for _ in range(3000)]
    _, _, t = next(textkit.slices(pa.array([" ".join(words)])))
    starts, ends, bounds = t.words(textkit.NOT_ALNUM)
    start, length, window = index.places(textkit.segment_hashes(t.buf, starts, ends), bounds)
    texts = {x for _, x in items}
    assert sorted(start.tolist()) == [i for i in range(2991) if " ".join(words[i : i + 10]) in texts] and set(length.tolist()) <= {10}


CLASHING = ("_id", "_drop", "_keep", "_row", "_items", "_n_words", "_spans", "_at", "_key", "size", "id", "row", "drop", "place", "whole", "n", "a.b")


def test_other_columns_pass_through(spark, rows, docs):
    bench = spark.createDataFrame([(1, " ".join(rows[0][1].split()[:15]), "x", "y")], "item_id long, text string, _items string, _spans string")
    wide = docs.select("*", *[F.lit(c).alias(c) for c in CLASHING])
    for kept in (quality.keep(wide), jaccard.representatives(wide), linededup.deduplicate(wide), decontam.clean(wide, bench), mixing.mix(wide)):
        assert kept.columns == wide.columns
        got = kept.collect()
        assert got and all(tuple(r)[-len(CLASHING) :] == CLASHING for r in got)
    renamed = wide.withColumnsRenamed({"doc_id": "key.1", "text": "body.1"})
    assert decontam.clean(renamed, bench, text="body.1").count() == decontam.clean(docs, bench).count()
    assert jaccard.representatives(renamed, "key.1", "body.1").count() == jaccard.representatives(docs).count()
    assert linededup.deduplicate(renamed, "key.1", "body.1").count() == docs.count()
    assert mixing.mix(renamed, doc_id="key.1", text="body.1").columns == renamed.columns


def test_rows_without_id_and_with_the_same_id(spark):
    """Null ids and repeated ids cost no more than others, and lose no unlinked text."""
    rows = [(None, f"null {k} " + " ".join(f"w{k}x{j}" for j in range(12))) for k in range(3000)]
    rows += [(7, "one text " + " ".join(f"p{j}" for j in range(12)))] * 2 + [(7, "another text " + " ".join(f"q{j}" for j in range(12)))] + [(None, rows[5][1])] * 50
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = sorted((r.text for r in jaccard.representatives(table).collect()))
    assert kept == sorted({t for _, t in rows})
    found = jaccard.classes(table)
    assert found.count() == len(rows) and found.where("doc_id is null and component_id is null").count() == 3050


def test_pieces_of_tokens():
    """Texts of white space, stops, special strings and newlines in all orders."""
    from tokenizers import Tokenizer

    path, r = P.path("byte_bpe_50k.json"), random.Random(4)
    t, encoder = Tokenizer.from_file(path), wavelet.Encoder(path)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\xa0", "\u2003", "\x1c", "a", "word", "É", "漢字", "—", "'s", "12", ",", ".", "<|endoftext|>", "\0", "!\n"]
    for _ in range(60):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(50)]
        for _, _, x in textkit.slices(pa.array(texts)):
            ids, n = encoder.encode(x)
            assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == t.encode(texts[0], add_special_tokens=False).ids
            assert ids.tolist() == [k for text in texts for k in t.encode(text, add_special_tokens=False).ids]


def ids_of(encoder, texts):
    got = []
    for _, _, x in textkit.slices(pa.array(texts)):
        ids, n = encoder.encode(x)
        got += [k.tolist() for k in np.split(ids, np.cumsum(n)[:-1])]
    return got


def test_words_of_tokens_skip_the_pattern():
    """Words are one piece whatever mark follows, and only their merges are asked of the library."""
    from tokenizers import Tokenizer

    path, r = P.path("byte_bpe_50k.json"), random.Random(5)
    t, encoder = Tokenizer.from_file(path), wavelet.Encoder(path)
    plain = lambda texts: [t.encode(x, add_special_tokens=False).ids for x in texts]
    words = ["".join(r.choice("abcdeöéßIñ") for _ in range(r.randrange(2, 12))) for _ in range(3000)]
    marks = ["###", "***", ".", "'s", "-x"]
    texts = [" ".join(w + r.choice(marks) for w in r.choices(words, k=9)) for _ in range(2000)]
    assert ids_of(encoder, texts) == plain(texts)
    assert encoder.pieces <= 2 * len(set(words)) + len(marks)  # at the beginning of a text, and after a space
    encoder.tokenizer = None  # the search for the pattern's tokens
    new = ["Zürich ñandu " + w for w in words]
    assert ids_of(encoder, new) == plain(new)


def test_latin_letters_of_tokens():
    """Each letter up to U+027F and its neighbours, beside letters, marks, digits and joining accents."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, encoder = Tokenizer.from_file(path), wavelet.Encoder(path)
    texts = [x.replace("@", chr(c)) for c in [*range(0x300), 0x301, 0x3C9, 0x416, 0x660, 0x2014, 0x6F22, 0x1F600] for x in ("@", " @", "a@b", "a@.", "@'s", "'@", "it'@l @ll", "1@2", "@\u0301, e\u0301@", "x @ y@\n@")]
    assert ids_of(encoder, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_odd_vocabularies_of_tokens(tmp_path):
    """A special string of letters alone, and bytes without a token."""
    from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

    lettered = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lettered.add_special_tokens([AddedToken("stop", normalized=False)])
    poor = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "Ġ": 2, "ab": 3, "Ġab": 4}, merges=[("a", "b"), ("Ġ", "ab")]))
    poor.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    texts = ["nonstop stops", "stop", " stop", "ab abc cab", "", "c", "ab ab", "a.b ab. é"]
    for k, t in enumerate((lettered, poor)):
        t.save(path := str(tmp_path / f"{k}.json"))
        assert ids_of(wavelet.Encoder(path), texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_kept_pieces_are_told_by_their_bytes(monkeypatch):
    """Short and long pieces, found again, with their own hashes and with few of them."""
    from tokenizers import Tokenizer

    path, r = P.path("byte_bpe_50k.json"), random.Random(6)
    t, own = Tokenizer.from_file(path), textkit.segment_hashes
    words = ["".join(r.choice("abé—1") for _ in range(n)) for n in [*range(1, 20), 255, 256, 257, 600] for _ in range(20)]
    for few in (False, True):
        if few:
            monkeypatch.setattr(textkit, "segment_hashes", lambda *x: own(*x) & np.uint64(7))
        encoder = wavelet.Encoder(path)
        for _ in range(6):
            texts = [" ".join(r.choices(words, k=6)) for _ in range(30)]
            assert ids_of(encoder, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(encoder.hashes) == (len(np.unique(encoder.hashes)) if few else encoder.pieces)


def test_equal_hashes_share_no_content(monkeypatch):
    monkeypatch.setattr(textkit, "segment_hashes", lambda buf, starts, ends, seed=0: np.zeros(len(starts), np.uint64))
    buf = np.frombuffer(b"ab cd ab", np.uint8)
    first, inverse = textkit.kinds_of(buf, np.array([0, 3, 6]), np.array([2, 5, 8]))
    assert first.tolist() == [0, 1] and inverse.tolist() == [0, 1, 0]


def test_hashes_tell_segments_apart():
    for n in (8, 64, 256, 512, 1024, 2048, 4096, 8192):
        both = np.frombuffer((thue_morse(n) + thue_morse(n, 1)).encode(), np.uint8)
        assert len(set(textkit.segment_hashes(both, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    r = random.Random(1)
    words = list({"".join(r.choice("ab\0c") for _ in range(r.randrange(1, 8))) for _ in range(3000)})
    _, _, t = next(textkit.slices(pa.array([" ".join(words)]), limit=1 << 30))
    starts, ends, _ = t.words(textkit.SPACE)
    assert len(np.unique(textkit.segment_hashes(t.buf, starts, ends))) == len(words)
