"""Licence notices with changed, missing and added words, against every stretch compared word by word."""

from __future__ import annotations

import random

import pytest

from chronoloom.llm import licenses

SHARE, ROOM = 0.8, 3


def common(a, b):
    """Longest common subsequence by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_labels(text):
    """label -> best score over every template and every stretch of the text."""
    w, out = text.split(), {}
    for t in licenses.TEMPLATES:
        words = t.words.split()
        spare = next(n for n in range(len(words), -1, -1) if (len(words) - n) / len(words) >= SHARE)
        if sum(x in w for x in words) < len(words) - spare or any(f" {m} " not in f" {text} " for m in t.mandatory):
            continue
        for s in range(len(w)):
            stretch = w[s : s + len(words) + max(spare, ROOM)]
            if all(f" {m} " in f" {' '.join(stretch)} " for m in t.mandatory):
                if (score := common(words, stretch) / len(words)) >= SHARE:
                    out[t.label] = max(out.get(t.label, 0), score)
    return out


def method(text, index):
    import numpy as np

    h = licenses._hashes(text)
    at = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
    known = np.flatnonzero(index.vocabulary[at] == h)
    places = {int(w): known[at[known] == w] for w in np.unique(at[known])}
    present = np.zeros((1, len(index.vocabulary)), bool)
    present[0, list(places)] = True
    return index.scan(h, places, np.flatnonzero(index.candidates(present)[0]))


def outside(t, i, n):
    """Whether a change of n words from i on leaves the template's mandatory phrases whole."""
    words = t.words.split()
    return all(f" {m} " in f" {' '.join([*words[:i], *['#'] * n, *words[i + n :]])} " for m in t.mandatory)


def test_every_run_of_changed_dropped_or_added_words_is_forgiven():
    """Runs of 1 to 6 words at every place: at 80 % in order, and with the phrases whole, a notice is never lost."""
    index, tried = licenses.LicenseIndex(), 0
    for t in licenses.TEMPLATES:
        words = t.words.split()
        spare = next(n for n in range(len(words), -1, -1) if (len(words) - n) / len(words) >= SHARE)
        for n in range(1, 7):
            for i in range(len(words) - n + 1):
                changed = [*words[:i], *(f"other{k}" for k in range(n)), *words[i + n :]]
                dropped = [*words[:i], *words[i + n :]]
                whole = outside(t, i, n)
                for text in (changed, dropped) if whole and n <= spare else ():
                    tried += 1
                    assert method("before it " + " ".join(text) + " after it", index).get(t.label, 0) >= (len(words) - n) / len(words) - 1e-9
                if n <= max(spare, ROOM) and all(f" {m} " in f" {' '.join([*words[:i], '#', *words[i:]])} " for m in t.mandatory):
                    tried += 1
                    assert method(" ".join([*words[:i], *["acme"] * n, *words[i:]]), index).get(t.label, 0) == 1
    assert tried > 2000


def test_damaged_notices_among_licence_words_equal_every_stretch():
    index, r, found = licenses.LicenseIndex(), random.Random(3), 0
    fill = "alpha beta gamma the of and software license to in this is a any terms under version".split()
    for _ in range(150):
        words = [r.choice(fill) for _ in range(r.randrange(12))]
        for _ in range(r.randrange(1, 3)):
            t = r.choice(licenses.TEMPLATES).words.split()
            for _ in range(r.randrange(6)):
                k = r.randrange(len(t))
                if (kind := r.random()) < 0.4:
                    t[k] = r.choice(fill)
                elif kind < 0.7:
                    t[k:k] = [r.choice(fill)] * r.randrange(1, 4)
                elif len(t) > 4:
                    del t[k : k + r.randrange(1, 4)]
            words += t + [r.choice(fill) for _ in range(r.randrange(12))]
        want = plain_labels(" ".join(words))
        assert method(" ".join(words), index) == pytest.approx(want)
        found += len(want)
    assert found > 60


@pytest.mark.parametrize("n", [1, 5, 63, 64, 65, 170])
def test_common_length(n):
    r = random.Random(n)
    for _ in range(20):
        a, b = r.choices("abcd", k=n), r.choices("abcde", k=r.randrange(n + 9))
        masks = [sum(1 << k for k, x in enumerate(a) if x == y) for y in b]
        assert licenses.common_length([m for m in masks if m], n) == common(a, b)


def test_scan_of_documents(spark):
    bsd = next(t.words for t in licenses.TEMPLATES if t.label == "bsd")
    texts = ["x y " + bsd.replace("modification", "modifications") + " z", "under the lesser general public license here", "redistribution and use by ACME Corporation Incorporated in source and binary forms, with or without modification, are permitted.", None, "", "MIT License " + "the " * 5000]
    rows = [*enumerate(texts), (None, bsd), (1, texts[1])]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, labels string, score double")
    found = sorted(licenses.scan(df).collect(), key=lambda x: (x.doc_id is None, x.doc_id))
    assert len(found) == 8
    assert found[0].labels == "bsd" and round(found[0].score, 2) == 0.93
    assert found[1].labels == found[2].labels == "lgpl" and found[1].score == 0.8
    assert found[3].labels == "bsd" and found[3].score > 0.9  # four words put in, of which three have room
    assert (found[4].n_words, found[4].labels, found[4].score, found[4].first_word) == (0, "", 0.0, None)
    assert found[6].labels == "mit" and found[6].n_words == 5002 and found[7].labels == "bsd"
