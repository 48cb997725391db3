"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a doubly linked list of its bytes (the last one with the
end-of-word mark).  A heap holds the ranks of adjacent pairs; the pair of lowest
rank, leftmost first, is merged again and again until none is left.  A word has
as many tokens as symbols at the start minus merges; identifiers never appear.

The vocabulary file supplies merges and special strings.  Texts are
cut at white space; equal pieces of a slice are counted once, and a bounded
cache keeps counts between slices, so a task's memory doesn't grow with the
number of words.

Edge cases: null and empty texts have 0 bytes and 0 tokens; special strings in
texts are one token each, as the library has it; repeated rows are counted one
by one and null ids pass through; a very long text is one slice, whole; other columns are
ignored, whatever their names; an empty table yields an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textkit as tk
from .common import id_and_text

CACHE_WORDS = 1_000_000
LIMIT = 2048
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: White space beyond ASCII also cuts words, which the pattern takes care of.


def _byte_names() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in names):
        names[b] = chr(256 + i)
    return names


class MergeTable:
    """Ranks of symbol pairs, symbols being small integers: 0-255 bytes,
    256-511 bytes with the end mark, then one for each merge result."""

    def __init__(self, merges: list, end: str, special: list[str]):
        names = _byte_names()
        symbols = {names[b]: b for b in range(256)} | {names[b] + end: 256 + b for b in range(256)}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = symbols.setdefault(a + b, len(symbols))
            self.pairs.setdefault((symbols[a], symbols[b]), (rank, made))
        self.special = special
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def merges(self, word: bytes) -> int:
        """How many merges the word goes through."""
        n = len(word)
        symbol = [*word[:-1], word[-1] + 256]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs, heap = self.pairs, []
        for i in range(n - 1):
            if (got := pairs.get((symbol[i], symbol[i + 1]))) is not None:
                heap.append((got[0], i, symbol[i], symbol[i + 1], got[1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged meanwhile
            done += 1
            symbol[i], symbol[j] = made, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (got := pairs.get((made, symbol[k]))) is not None:
                    heapq.heappush(heap, (got[0], i, made, symbol[k], got[1]))
            if (h := left[i]) >= 0 and (got := pairs.get((symbol[h], made))) is not None:
                heapq.heappush(heap, (got[0], h, symbol[h], made, got[1]))
        return done

    def count(self, text: str, cache: dict[str, int]) -> int:
        """Tokens of a text: special strings are one each, the rest goes word by word."""
        if self.special_pattern and (found := self.special_pattern.findall(text)):
            return len(found) + sum(self._count(x, cache) for x in self.special_pattern.split(text))
        return self._count(text, cache)

    def _count(self, text: str, cache: dict[str, int]) -> int:
        total = 0
        for word in PATTERN.findall(lower(unicodedata.normalize("NFC", text))):
            if (n := cache.get(word)) is None:
                raw = word.encode()
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                n = cache[word] = len(raw) - self.merges(raw)
            total += n
        return total


def lower(text: str) -> str:
    """Lower case character by character: no final sigma by context."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


@lru_cache(maxsize=2)
def load(path: str) -> MergeTable:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    return MergeTable(model["merges"], model.get("end_of_word_suffix") or "", [x["content"] for x in file["added_tokens"] if x["special"]])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    vocabulary is the path of a tokenizer file that is installed on every
    worker; it is opened there, not shipped."""
    state: dict = {}

    def count(batch: pa.RecordBatch):
        table = load(vocabulary)
        seen: dict[bytes, int] = state.setdefault("pieces", {})
        words: dict[str, int] = state.setdefault("words", {})
        for i, j, texts in tk.slices(batch.column(1)):
            starts, ends, bounds = texts.words(tk.SPACE)
            at, inverse = tk.kinds_of(texts.buf, starts, ends)
            raw, counts = texts.buf.tobytes(), np.zeros(len(at), np.int64)
            if len(seen) > CACHE_WORDS:
                seen.clear()
            for k, (s, e) in enumerate(zip(starts[at].tolist(), ends[at].tolist(), strict=True)):
                if (n := seen.get(key := raw[s:e])) is None:
                    n = seen[key] = table.count(key.decode(), words)
                counts[k] = n
            sums = np.concatenate([[0], np.cumsum(counts[inverse])])
            n_tokens = sums[bounds[1:]] - sums[bounds[:-1]]
            yield {"doc_id": batch.column(0).slice(i, j - i), "n_bytes": np.diff(texts.offsets), "n_tokens": n_tokens, "over_limit": n_tokens > limit}

    return tk.map_batches(id_and_text(docs, doc_id, text), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", count)
