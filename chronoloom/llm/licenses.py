"""Licence scans with a positional rare-token index.

Each template is a run of words that a licence notice holds.  Words are weighed by
inverse document frequency over the whole corpus (one counting pass), and the
index lists, for every licence word, its positions in the templates.  A template's
score at a stretch of a file is the length of the longest common subsequence of the two over
the template's; a stretch has room for as many words put in as the
threshold lets be missing, and for SLACK at least.  A notice is any stretch that reaches the threshold
and holds the template's mandatory phrases, word by word; the best one's score counts.

Stretches are found through the file's highest-IDF words of the template.  Words
that the file doesn't hold are missing anyway, so of the others only so many more may be: of
twice as many and one looked up, more than half of those that may not be missing must
stand within the template's reach of a start (their places less their positions,
intersected).  Every stretch at the threshold has such a start, so none is missed.

Base phrases are matched at every place and their labels always stay; the
method adds the labels of verified templates.  ``score`` is 1 with a base place, else
the best score of a template; ``method_score`` is the latter alone.

Edge cases: null and empty texts have no words, no labels (empty strings) and
score 0; first_word and last_word are null without base places; repeated rows
are scanned one by one; null ids pass through; very long texts are one slice, whole; an empty
table yields an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import id_and_text

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    mandatory: tuple[str, ...]


# Words of public licence notices, and the phrases without which a notice is not theirs.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("gpl-2.0", "gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind", ("this permission notice shall be included", "substantial portions of the software")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code", "following disclaimer")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software", "with or without fee")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("required by applicable law", "warranties or conditions of any kind")),
    Template("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published", "version 3")),
    Template("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published", "version 2")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors", "use of this software")),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("dedicated the work to the public domain", "copyright law")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("permission is hereby granted", "to deal in the software without restriction")),
    Template("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code", "redistributions in binary form")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("to endorse or promote products", "specific prior written permission")),
    Template("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("copyright holders and contributors", "fitness for a particular purpose")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("distribute this software", "this permission notice appear in all copies")),
    Template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("permission is granted to anyone", "must not be misrepresented")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license as published",)),
    Template("lgpl-2.1", "gnu lesser general public license version 2 1", ("lesser general public license", "version 2 1")),
    Template("lgpl-3.0", "gnu lesser general public license version 3", ("lesser general public license", "version 3")),
    Template("agpl-3.0", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("affero general public license as published", "version 3")),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization", "covered by this license")),
    Template("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license", ("common development and distribution license",)),
    Template("artistic-2.0", "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0", ("artistic license 2 0",)),
    Template("wtfpl", "do what the fuck you want to public license", ("you want to public license",)),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-nd-4.0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives",)),
    Template("cc-by-nc-sa-4.0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("creative commons attribution noncommercial sharealike",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, method_score double"


def _hashes(words: str) -> np.ndarray:
    _, _, texts = next(tk.slices(pa.array([words])))
    starts, ends, _ = texts.words(tk.SPACE)
    return tk.segment_hashes(texts.buf, starts, ends)


def _places(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    n = max(len(h) - len(phrase) + 1, 0)
    same = np.ones(n, bool)
    for i in range(len(phrase) if n else 0):
        same &= h[i : i + n] == phrase[i]
    return np.flatnonzero(same)


#: Words that may be put into any notice, however short.
SLACK = 3


class LicenseIndex:
    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] | None = None, slack: int = SLACK, threshold: float = 0.8):
        self.templates, self.slack, self.threshold = templates, slack, threshold
        self.base = [(_hashes(k), v) for k, v in (BASE if base is None else base).items()]
        self.words = [_hashes(t.words) for t in templates]
        self.mandatory = [[_hashes(m) for m in t.mandatory] for t in templates]
        self.vocabulary = np.unique(np.concatenate(self.words))
        # How many words of each template a stretch at the threshold may lack.
        self.spare = [max(n for n in range(len(h) + 1) if (len(h) - n) / len(h) >= threshold) for h in self.words]
        #: How many words may be put in.
        self.room = [max(n, slack) for n in self.spare]
        self.ids = [np.searchsorted(self.vocabulary, h) for h in self.words]
        #: For each template the positions of every word of it, as bits.
        self.bits = [{int(w): sum(1 << k for k in np.flatnonzero(i == w).tolist()) for w in np.unique(i)} for i in self.ids]
        # Template words by vocabulary words: how often.
        self.holds = np.array([np.bincount(i, minlength=len(self.vocabulary)) for i in self.ids])
        self.weigh(np.zeros(len(self.vocabulary), np.int64), 0)

    def weigh(self, frequency: np.ndarray, documents: int) -> None:
        """Orders each template's words by their inverse document frequency."""
        self.idf = np.array([math.log((documents + 1) / (n + 1)) for n in frequency])
        self.order = [sorted(range(len(i)), key=lambda k, i=i: (-self.idf[i[k]], k)) for i in self.ids]

    def candidates(self, present: np.ndarray) -> np.ndarray:
        """Which templates each file (rows: flags of the vocabulary words it holds) has words enough for."""
        return present.astype(np.int32) @ self.holds.T >= np.array([len(w) - s for w, s in zip(self.words, self.spare, strict=True)])

    def base_places(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """Start positions of each base phrase within rows."""
        out = []
        for phrase, label in self.base:
            k, at = len(phrase), _places(h, phrase)
            row = np.searchsorted(bounds, at, "right") - 1
            out.append((at[at + k <= bounds[row + 1]], label))
        return out

    def starts(self, t: int, places: dict[int, np.ndarray]) -> np.ndarray:
        """Where template t may begin in a file, given the places of the words it holds."""
        held = [k for k in self.order[t] if int(self.ids[t][k]) in places]
        lacking = self.spare[t] - (len(self.words[t]) - len(held))
        used = held[: 2 * lacking + 1]
        # Of the words looked up at most so many are missing from a stretch at the threshold.
        needed = len(used) - lacking
        # A word stands so much before its place there at most (words before it are missing), or
        # behind it (words are put in before it, and words after it are missing).
        before, behind = self.spare[t], self.room[t] + self.spare[t]
        near = np.concatenate([np.unique(places[int(self.ids[t][k])] - k) for k in used]) if used else np.zeros(0, np.int64)
        tried = np.unique((near[:, None] + np.arange(-behind, before + 1)).ravel())
        if needed < 1 or not len(tried):
            return tried[:0]
        agree = np.zeros(len(tried), np.int64)
        for k in used:
            own = np.unique(places[int(self.ids[t][k])] - k)
            agree += np.searchsorted(own, tried + behind, "right") > np.searchsorted(own, tried - before)
        return np.unique(np.maximum(tried[agree >= needed], 0))

    def scan(self, h: np.ndarray, places: dict[int, np.ndarray], templates: np.ndarray) -> dict[str, float]:
        """label -> best score of verified templates in one file, from the places of its licence words."""
        found: dict[str, float] = {}
        for t in templates.tolist():
            tried, length, label = self.starts(t, places), len(self.words[t]) + self.room[t], self.templates[t].label
            for phrase in self.mandatory[t]:
                stands = _places(h, phrase)
                # The first place of the phrase from the start on lies in the stretch.
                first = np.searchsorted(stands, tried)
                tried = tried[(first < len(stands)) & (np.append(stands, len(h))[first] + len(phrase) <= tried + length)]
            if not len(tried):
                continue
            at = np.concatenate([places[w] for w in self.bits[t] if w in places])
            masks = [m for w, m in self.bits[t].items() if w in places for _ in range(len(places[w]))]
            order = np.argsort(at, kind="stable")
            at, masks = at[order], [masks[k] for k in order.tolist()]
            for a, b in np.unique(np.stack([np.searchsorted(at, tried), np.searchsorted(at, tried + length)], 1), axis=0).tolist():
                score = common_length(masks[a:b], len(self.words[t])) / len(self.words[t])
                if score >= self.threshold and score > found.get(label, 0.0):
                    found[label] = score
        return found


def common_length(masks: list[int], n: int) -> int:
    """Longest common subsequence of a template of n words and a stretch, given for each word of the
    stretch the bits of its positions in the template: a row of the table is one number."""
    full = (1 << n) - 1
    row = full
    for m in masks:
        same = row & m
        row = (row + same | row - same) & full
    return n - row.bit_count()


def _fit(texts_only: DataFrame, index: LicenseIndex) -> None:
    vocabulary = index.vocabulary

    def count(batch: pa.RecordBatch):
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for _, _, texts in tk.slices(batch.column(0), lut=tk.LOWER):
            starts, ends, bounds = texts.words(tk.NOT_ALNUM)
            h = tk.segment_hashes(texts.buf, starts, ends)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            known = np.flatnonzero(vocabulary[at] == h)
            pair = np.unique(at[known] * np.int64(texts.rows) + tk.row_of(bounds)[known])
            total += np.bincount(pair // texts.rows, minlength=len(vocabulary))
            n += texts.rows
        return {"word": [-1, *range(len(vocabulary))], "n": [n, *total]}

    got = {r.word: r.n for r in tk.map_batches(texts_only, "word long, n long", count).groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one row a template word
    index.weigh(np.array([got.get(k, 0) for k in range(len(vocabulary))]), got.get(-1, 0))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: LicenseIndex | None = None) -> DataFrame:
    """One row per document: words, base places, base labels, all labels, best score (1 with a base place), the method's own."""
    index = index or LicenseIndex()
    rows = id_and_text(docs, doc_id, text)
    _fit(rows.select("text"), index)

    def look(batch: pa.RecordBatch):
        vocabulary = index.vocabulary
        for i, j, texts in tk.slices(batch.column(1), lut=tk.LOWER):
            starts, ends, bounds = texts.words(tk.NOT_ALNUM)
            h = tk.segment_hashes(texts.buf, starts, ends)
            n = texts.rows
            n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for at, label in index.base_places(h, bounds):
                row = np.searchsorted(bounds, at, "right") - 1
                n_base += np.bincount(row, minlength=n)
                np.minimum.at(first, row, at - bounds[row])
                np.maximum.at(last, row, at - bounds[row])
                for r in np.unique(row):
                    base[r].add(label)
            scores = (n_base > 0).astype(float)
            labels = [set(x) for x in base]
            best = np.zeros(n)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            place = np.flatnonzero(vocabulary[at] == h)
            word, row = at[place], np.searchsorted(bounds, place, "right") - 1
            present = np.zeros((n, len(vocabulary)), bool)
            present[row, word] = True
            wanted = index.candidates(present)
            cut = np.searchsorted(row, np.arange(n + 1))
            for r in np.flatnonzero(wanted.any(1)):
                own, where = word[cut[r] : cut[r + 1]], place[cut[r] : cut[r + 1]] - bounds[r]
                order = np.argsort(own, kind="stable")
                kinds, first_at = np.unique(own[order], return_index=True)
                got = index.scan(h[bounds[r] : bounds[r + 1]], dict(zip(kinds.tolist(), np.split(where[order], first_at[1:]), strict=True)), np.flatnonzero(wanted[r]))
                labels[r] |= got.keys()
                best[r] = max([0.0, *got.values()])
            scores = np.maximum(scores, best)
            none = n_base == 0
            yield {"doc_id": batch.column(0).slice(i, j - i), "n_words": np.diff(bounds), "n_base": n_base, "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none), "base_labels": [",".join(sorted(x)) for x in base], "labels": [",".join(sorted(x)) for x in labels], "score": scores, "method_score": best}

    return tk.map_batches(rows, SCHEMA, look)
