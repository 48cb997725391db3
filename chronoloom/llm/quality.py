"""Quality rules by weak supervision.

Rules look at a document's features and vote good, bad, or abstain.  No rule is
trusted by itself: expectation-maximisation over the counts of vote patterns
(at most 3**rules of them, whatever the corpus size) estimates how often each
rule is right on good and on bad documents, and a document is kept when its
posterior probability of being good reaches ``threshold``.  A base test rejects
texts of under ``min_words`` words or with over half of their words in repeated
three-word windows.

Edge cases: a null or empty text has no words, so base_failed is true and kept
false; its rules all abstain.  Repeated rows are judged one by one.  Null ids
pass through.  A very long text is one slice, whole.  An empty table yields an empty result.  Other columns of the
input are ignored by :func:`score` and carried along by :func:`keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import id_and_text, small_batches

GOOD, ABSTAIN, BAD = 1, 0, 2
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True
UPPER, LETTER, SHOUT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
LETTER[0xC0:] = True  # lead bytes of multi-byte characters
SHOUT[list(b"!?")] = True
MIN_WORDS = 50

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_shout", "n_lines", "n_distinct", "n_short", "n_lone")
SCORE_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, posterior double, votes string"


def features(texts: tk.Texts) -> dict[str, np.ndarray]:
    """Per row: word_chars in code points, symbols, duplicate lines, and so on."""
    starts, ends, bounds = texts.words(tk.SPACE)
    row, n = tk.row_of(bounds), texts.rows
    h = tk.segment_hashes(texts.buf, starts, ends)
    space, lead = tk.SPACE[texts.buf], (texts.buf & 0xC0) != 0x80

    first, last, line_bounds = texts.lines()
    line_row = tk.row_of(line_bounds)
    filled = np.zeros(len(space) + 1, np.int64)
    np.cumsum(~space, out=filled[1:])
    worded = filled[last] > filled[first]
    lines = np.bincount(line_row[worded], minlength=n)
    distinct_lines = tk.distinct_per_row(tk.segment_hashes(texts.buf, first[worded], last[worded]), line_row[worded], n)

    at = tk.windows_in_rows(bounds, 3, len(h))
    covered = np.zeros(len(h), bool)
    if len(at):
        twice = at[tk.repeated_in_row(tk.window_hashes(h, 3)[at], row[at], n)]
        for k in range(3):
            covered[twice + k] = True
    short = (ends - starts) <= 3
    lone = (ends - starts == 1) & SYMBOLS[texts.buf[starts]]
    return {
        "n_words": np.diff(bounds),
        "word_chars": texts.per_row(~space & lead),
        "n_symbols": texts.per_row(SYMBOLS[texts.buf]),
        "n_dup_lines": lines - distinct_lines,
        "n_repeat_words": np.bincount(row[covered], minlength=n),
        "n_upper": texts.per_row(UPPER[texts.buf]),
        "n_letters": texts.per_row(LETTER[texts.buf]),
        "n_shout": texts.per_row(SHOUT[texts.buf]),
        "n_lines": lines,
        "n_distinct": tk.distinct_per_row(h, row, n),
        "n_short": np.bincount(row[short], minlength=n),
        "n_lone": np.bincount(row[lone], minlength=n),
    }


NEVER = -np.inf
#: name -> (value of the features, good when at most, bad when at least); between the two a rule abstains.
RULES = {
    "symbols": (lambda f, w: f["n_symbols"] / w, 0.02, 0.20),
    "lone_symbols": (lambda f, w: f["n_lone"] / w, NEVER, 0.10),
    "letters": (lambda f, w: 1 - f["n_letters"] / np.maximum(f["word_chars"], 1), 0.08, 0.20),
    "duplicate_lines": (lambda f, w: f["n_dup_lines"] / np.maximum(f["n_lines"], 1), NEVER, 0.45),
    "repeated_words": (lambda f, w: f["n_repeat_words"] / w, 0.10, 0.45),
    "capitals": (lambda f, w: f["n_upper"] / np.maximum(f["n_letters"], 1), NEVER, 0.50),
    "shouting": (lambda f, w: f["n_shout"] / w, NEVER, 0.30),
    "vocabulary": (lambda f, w: -f["n_distinct"] / np.sqrt(w), NEVER, -2.0),
    "short_words": (lambda f, w: np.abs(f["n_short"] / w - 0.40), 0.15, 0.37),
}


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """Rows by rules: GOOD, ABSTAIN or BAD; all abstain on a text without words."""
    w = np.maximum(f["n_words"], 1)
    out = np.zeros((len(w), len(RULES)), np.uint8)
    for j, (value, good, bad) in enumerate(RULES.values()):
        x = value(f, w)
        out[:, j] = np.where(f["n_words"] == 0, ABSTAIN, np.where(x >= bad, BAD, np.where(x <= good, GOOD, ABSTAIN)))
    return out


def codes(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


@dataclass(frozen=True)
class VoteModel:
    """Class prior and, per class (bad, good) and rule, the chances of abstain, good and bad votes."""

    prior: float
    chance: np.ndarray  # 2 x rules x 3

    def posterior(self, v: np.ndarray) -> np.ndarray:
        rules = np.arange(v.shape[1])
        ratio = np.log(self.chance[1]) - np.log(self.chance[0])
        log = np.log(self.prior) - np.log1p(-self.prior) + ratio[rules, v].sum(1)
        return 1 / (1 + np.exp(-np.clip(log, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Per rule, the chance that a vote it casts is right."""
        right = self.prior * self.chance[1, :, GOOD] + (1 - self.prior) * self.chance[0, :, BAD]
        return right / (self.prior * self.chance[1, :, 1:].sum(1) + (1 - self.prior) * self.chance[0, :, 1:].sum(1))


#: Pseudo-counts of abstain, good and bad votes by bad and good documents.
PSEUDO = np.array([[2.0, 1.0, 3.0], [2.0, 3.0, 1.0]])


def fit(v: np.ndarray, counts: np.ndarray, iterations: int = 200) -> VoteModel:
    """Expectation-maximisation over distinct vote patterns, weighted by counts.

    It starts from the number of bad votes, which also settles which class is
    called good; pseudo-counts keep rules that never vote, or always agree,
    away from certainty, and are all there is for an empty table.
    """
    each = np.stack([v == k for k in range(3)], 2).astype(float) if len(v) else np.zeros((0, len(RULES), 3))
    p = np.array([0.95, 0.5, 0.05])[np.minimum(each[:, :, BAD].sum(1).astype(int), 2)]
    model = None
    for _ in range(iterations):
        share = np.stack([counts * (1 - p), counts * p])
        seen = np.einsum("cn,nrk->crk", share, each) + PSEUDO[:, None, :]
        model = VoteModel(float((share[1].sum() + 8) / (counts.sum() + 10)), seen / seen.sum(2, keepdims=True))
        new = model.posterior(v.astype(int))
        if not len(v) or np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def _base_failed(f: dict[str, np.ndarray], min_words: int) -> np.ndarray:
    return (f["n_words"] < min_words) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def fit_votes(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> VoteModel:
    """Fits the model on the vote patterns of all documents with enough words."""

    def count(batch: pa.RecordBatch):
        seen: dict[int, int] = {}
        for _, _, texts in tk.slices(batch.column(0)):
            f = features(texts)
            enough = f["n_words"] >= min_words
            for c, k in zip(*np.unique(codes(votes(f))[enough], return_counts=True), strict=True):
                seen[int(c)] = seen.get(int(c), 0) + int(k)
        return {"code": list(seen), "n": list(seen.values())}

    rows = tk.map_batches(small_batches(docs).select(F.col(f"`{text}`").cast("string").alias("text")), "code long, n long", count).groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()  # at most 3**rules rows
    v = np.array([[r.code // 3**j % 3 for j in range(len(RULES))] for r in rows], np.uint8).reshape(-1, len(RULES))
    return fit(v, np.array([r.n for r in rows], float))


def _judge(texts: tk.Texts, model: VoteModel, threshold: float, min_words: int):
    f = features(texts)
    v = votes(f)
    p, failed = model.posterior(v), _base_failed(f, min_words)
    return f, v, p, failed, ~failed & (p >= threshold)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document with base counts, verdict, posterior and votes (g, b or - per rule)."""
    model = fit_votes(docs, text, min_words)
    letters = np.frombuffer(b"-gb", np.uint8)

    def judge(batch: pa.RecordBatch):
        for i, j, texts in tk.slices(batch.column(1)):
            f, v, p, failed, kept = _judge(texts, model, threshold, min_words)
            yield {"doc_id": batch.column(0).slice(i, j - i), "base_failed": failed, "kept": kept, "posterior": p, "votes": [bytes(r).decode() for r in letters[v]]} | {k: f[k] for k in FEATURES[:5]}

    return tk.map_batches(id_and_text(docs, doc_id, text), SCORE_SCHEMA, judge)


def keep(docs: DataFrame, text: str = "text", threshold: float = 0.5, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that the verdict keeps, with all their columns."""
    model = fit_votes(docs, text, min_words)
    place = docs.columns.index(text)

    def filter_(batches):
        for batch in batches:
            for i, j, texts in tk.slices(batch.column(place).cast(pa.string())):
                yield batch.slice(i, j - i).filter(pa.array(_judge(texts, model, threshold, min_words)[4]))

    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots can't be sent
    return rows.mapInArrow(tk.released(filter_), rows.schema).toDF(*docs.columns)
