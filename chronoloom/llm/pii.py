"""Personal data: exact base patterns, and a character-level BiLSTM-CRF that adds spans.

Base spans (email, ip, card, phone) follow fixed patterns with checks and always
stay.  The model is a bidirectional LSTM over characters with CRF transitions
between BIO labels, trained in numpy from labelled spans.  Its training set is
made by a seeded generator of ``TRAIN_SPANS`` labelled examples (written forms
that the patterns miss included) among words; no corpus text goes into it.

All four kinds need a digit or an @ sign, so the model reads the stretches around
those characters, wherever they are in the text.  A stretch is cut into
overlapping windows; each is decoded by itself (best path, and by the
forward-backward pass how probable its labels are), hundreds of windows at a
time.  What touches a window's cut edge is left to its neighbour, which holds it
whole.  Then all windows of a stretch are reconciled: of all their spans the
set without overlaps that has the largest sum of probabilities stays.  A span counts
when its mean probability reaches ``CONFIDENCE``, it holds enough digits or an @,
and it does not touch a base span.

Edge cases: null and empty texts have no spans; repeated rows are searched one by
one, null ids pass through; an empty table yields an empty result; other columns
are ignored.  A very long text is searched whole, in blocks of windows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .common import id_and_text

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order of start, then kind.

    Each pattern runs in time linear in the text: a run of digits or of
    address characters is entered at its first character only."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- the model

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STRIDE, REACH = 96, 48, 40
HIDDEN, EMBED = 24, 12
TRAIN_SPANS, EPOCHS, SEED = 3000, 6, 7
CONFIDENCE = 0.75
MIN_DIGITS = (0, 4, 13, 9)


def _classes() -> np.ndarray:
    """Code point (below 0x250; others share one) -> character class id."""
    out = np.zeros(0x250, np.int64)
    for c in range(0x250):
        x = chr(c)
        if c < 0x80 and not x.isalnum():
            out[c] = 2 + c
        elif "0" <= x <= "9":
            out[c] = 130
        elif c < 0x80:
            out[c] = 131 + (ord(x.lower()) - 97) + (26 if x.isupper() else 0)
        else:
            out[c] = 1
    kinds, dense = np.unique(out, return_inverse=True)
    return dense


_CLASS = _classes()
N_CLASSES = int(_CLASS.max()) + 2


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x250, _CLASS[np.minimum(points, 0x24F)], N_CLASSES - 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstmCrf:
    """Embedding, one LSTM each way, a linear layer and CRF transitions; trained by Adam."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": g(N_CLASSES, EMBED) * 3, "S": np.zeros((len(LABELS), len(LABELS)), np.float32), "O": g(2 * HIDDEN, len(LABELS)), "o": np.zeros(len(LABELS), np.float32)}
        for d in "fb":
            self.p |= {"W" + d: g(EMBED, 4 * HIDDEN), "U" + d: g(HIDDEN, 4 * HIDDEN), "b" + d: np.zeros(4 * HIDDEN, np.float32)}
            self.p["b" + d][HIDDEN : 2 * HIDDEN] = 1

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x: time x batch x embed -> hidden states, and what the backward pass needs."""
        n, batch, _ = x.shape
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        pre = x @ self.p["W" + d] + self.p["b" + d]
        out, saved = np.empty((n, batch, HIDDEN), np.float32), []
        for t in range(n):
            z = pre[t] + h @ self.p["U" + d]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            c_old, h_old = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                saved.append((i, f, o, g, c_old, tc, h_old))
        return out, saved

    def _lstm_back(self, x, d, saved, dout, grad):
        n = len(saved)
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        dx = np.empty_like(x)
        for t in range(n - 1, -1, -1):
            i, f, o, g, c_old, tc, h_old = saved[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c_old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            grad["W" + d] += x[t].T @ dz
            grad["U" + d] += h_old.T @ dz
            grad["b" + d] += dz.sum(0)
            dx[t] = dz @ self.p["W" + d].T
            dh, dc = dz @ self.p["U" + d].T, dc * f
        return dx

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """ids: batch x time -> batch x time x labels."""
        x = self.p["E"][ids.T]
        a, _ = self._lstm(x, "f", False)
        b, _ = self._lstm(x[::-1], "b", False)
        return (np.concatenate([a, b[::-1]], 2) @ self.p["O"] + self.p["o"]).transpose(1, 0, 2)

    def loss_and_grad(self, ids: np.ndarray, labels: np.ndarray):
        """Mean negative log-likelihood of the label paths, and its gradient."""
        p, n, batch = self.p, ids.shape[1], ids.shape[0]
        x = p["E"][ids.T]
        fwd, sf = self._lstm(x, "f", True)
        bwd, sb = self._lstm(x[::-1], "b", True)
        h = np.concatenate([fwd, bwd[::-1]], 2)
        e = h @ p["O"] + p["o"]
        y, rows = labels.T, np.arange(batch)
        alpha = [e[0]]
        for t in range(1, n):
            alpha.append(_logsumexp(alpha[-1][:, :, None] + p["S"], 1) + e[t])
        log_z = _logsumexp(alpha[-1], 1)
        beta = np.zeros_like(e[0])
        de, ds = np.empty_like(e), np.zeros_like(p["S"])
        for t in range(n - 1, -1, -1):
            de[t] = np.exp(alpha[t] + beta - log_z[:, None])
            if t:
                step = (e[t] + beta)[:, None, :] + p["S"]
                ds += np.exp(alpha[t - 1][:, :, None] + step - log_z[:, None, None]).sum(0)
                beta = _logsumexp(step, 2)
        score = e[0][rows, y[0]].copy()
        for t in range(n):
            de[t][rows, y[t]] -= 1
            if t:
                score += e[t][rows, y[t]] + p["S"][y[t - 1], y[t]]
                np.add.at(ds, (y[t - 1], y[t]), -1)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        de /= batch
        grad["S"] = ds / batch
        grad["O"] = np.einsum("tbh,tbl->hl", h, de)
        grad["o"] = de.sum((0, 1))
        dh = de @ p["O"].T
        dx = self._lstm_back(x, "f", sf, dh[:, :, :HIDDEN], grad)
        dx += self._lstm_back(x[::-1], "b", sb, dh[::-1, :, HIDDEN:], grad)[::-1]
        np.add.at(grad["E"], ids.T, dx)
        return float((log_z - score).mean()), grad

    def train(self, ids: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = SEED) -> list[float]:
        r, m, v, t, losses = np.random.default_rng(seed), {}, {}, 0, []
        for epoch in range(epochs):
            order, total = r.permutation(len(ids)), 0.0
            for k in range(0, len(ids), batch):
                own = order[k : k + batch]
                loss, grad = self.loss_and_grad(ids[own], labels[own])
                total += loss * len(own)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                t += 1
                step = rate * (1 - epoch / (epochs + 1))
                for name, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                    self.p[name] -= (step * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            losses.append(total / len(ids))
        return losses

    def decode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best label paths of a batch of emissions (batch x time x labels), and the
        probability of each of their labels among all paths."""
        batch, n, labels = e.shape
        rows, step = np.arange(batch), self.p["S"]
        score, back = e[:, 0], np.empty((n, batch, labels), np.int8)
        for t in range(1, n):
            each = score[:, :, None] + step
            back[t] = each.argmax(1)
            score = each.max(1) + e[:, t]
        path = np.empty((n, batch), np.int64)
        path[-1] = score.argmax(1)
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t][rows, path[t]]
        # Sums over paths, scaled at each step.
        move, seen = np.exp(step), np.exp(e - e.max(2, keepdims=True))
        forward = np.empty((n, batch, labels), np.float32)
        forward[0] = seen[:, 0]
        for t in range(1, n):
            x = (forward[t - 1] @ move) * seen[:, t]
            forward[t] = x / x.sum(1, keepdims=True)
        backward, sure = np.ones((batch, labels), np.float32), np.empty((n, batch), np.float32)
        for t in range(n - 1, -1, -1):
            x = forward[t] * backward
            sure[t] = x[rows, path[t]] / x.sum(1)
            x = (seen[:, t] * backward) @ move.T
            backward = x / x.sum(1, keepdims=True)
        return path.T, sure.T


def _logsumexp(x, axis):
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


# ------------------------------------------------------- labelled spans

def _luhn_number(r, n: int) -> str:
    body = "".join(map(str, r.integers(0, 10, n - 1)))
    body = str(r.integers(3, 7)) + body[1:]
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def _word(r) -> str:
    letters = "etaoinshrdlucmwfgypbvkéèüößñóí"
    w = "".join(letters[min(int(k), len(letters) - 1)] for k in r.exponential(7, r.integers(1, 9)))
    return w.capitalize() if r.random() < 0.15 else w


def example(r) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of words with labelled spans (start, kind, end) in it, or with look-alikes that are none."""
    text, spans = "", []
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    ascii_word = lambda: "".join(chr(97 + int(k)) for k in r.integers(0, 26, r.integers(2, 8)))
    for _ in range(r.integers(2, 7)):
        for _ in range(r.integers(1, 5)):
            text += _word(r) + ("", "", "", ",", ".", ":")[r.integers(0, 6)] + (" " if r.random() < 0.95 else "\n")
        kind, form = int(r.integers(0, 8)), int(r.integers(0, 5))
        if kind == 0:
            host = ascii_word() + ("", str(r.integers(0, 10)))[r.integers(0, 2)] + "." + (ascii_word() + "." if r.random() < 0.4 else "") + ("com", "org", "net", "de", "fr")[r.integers(0, 5)]
            name = ascii_word() + ("", "." + ascii_word(), digits(2), "." + digits(2))[r.integers(0, 4)]
            s = name + ("@", "@", "@", " @ ", "(@)")[form] + host
        elif kind == 1:
            parts = [str(x) for x in r.integers(0, 256, 4)]
            s = (".", ".", ".", " . ", "[.]")[form].join(parts)
        elif kind == 2:
            s = _luhn_number(r, (14, 15, 16, 16, 19)[r.integers(0, 5)])
            sep = ("", " ", "-", ".", "/")[form]
            s = sep.join(s[i : i + 4] for i in range(0, len(s), 4))
        elif kind == 3:
            a, b, c = digits(3), digits(3), digits(4)
            s = (f"+{r.integers(1, 99)} ({a}) {b}-{c}", f"+{r.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"00{r.integers(1, 99)} {a} {b} {c}", f"+{r.integers(1, 99)}/{a}/{b}{c}")[form]
        else:  # numbers that are nobody's
            s = (digits(r.integers(1, 9)), f"{digits(1)}.{digits(1)}", "".join("0123456789abcdef"[int(k)] for k in r.integers(0, 16, 40)), f"AK{''.join('ABCDEFGHJKLMNPQRSTUVWXYZ23456789'[int(k)] for k in r.integers(0, 32, 18))}", f"{digits(4)}-{digits(2)}-{digits(2)}")[form]
        if kind < 4:
            spans.append((len(text), kind, len(text) + len(s)))
        text += s + (" ", ", ", ". ", "\n")[r.integers(0, 4)]
    return text, spans


def labels_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for a, kind, b in spans:
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    return out


def training_set(n: int = TRAIN_SPANS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows of WINDOW characters and their labels, n of them."""
    r, ids, labels = np.random.default_rng(seed), [], []
    while len(ids) < n:
        text, spans = example(r)
        text = text.ljust(WINDOW + 1)
        i = int(r.integers(0, len(text) - WINDOW))
        ids.append(encode(text)[i : i + WINDOW])
        labels.append(labels_of(len(text), spans)[i : i + WINDOW])
    return np.array(ids), np.array(labels)


@lru_cache(maxsize=1)
def trained() -> BiLstmCrf:
    model = BiLstmCrf()
    model.train(*training_set())
    return model


# ------------------------------------------------------------ decoding

_TRIGGER = re.compile(r"[0-9@]")


def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges within REACH characters of a digit or @, merged where they meet."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_spans(path: np.ndarray, sure: np.ndarray, n: int, cut_before: bool, cut_after: bool) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, mean probability) in a decoded window of n characters, without
    those that touch an edge at which the text goes on."""
    out = []
    for i in np.flatnonzero(path[:n] % 2 == 1).tolist():
        end = i + 1
        while end < n and path[end] == path[i] + 1:
            end += 1
        if not (cut_before and i == 0) and not (cut_after and end == n):
            out.append((i, int(path[i] - 1) // 2, end, float(sure[i:end].mean())))
    return out


def reconciled(found: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int, float]]:
    """Of spans (start, kind, end) with weights, the set without overlaps of the largest sum."""
    rows = sorted((end, start, kind, w) for (start, kind, end), w in found.items())
    ends, best = [r[0] for r in rows], [0.0]
    for k, (_, start, _, w) in enumerate(rows):
        best.append(max(best[k], best[bisect_right(ends, start, 0, k)] + w))
    out, k = [], len(rows)
    while k:
        end, start, kind, w = rows[k - 1]
        before = bisect_right(ends, start, 0, k - 1)
        if best[k] == best[k - 1]:
            k -= 1
        else:
            out.append((start, kind, end, w))
            k = before
    return out[::-1]


def model_spans(model: BiLstmCrf, texts: list[str], block: int = 512) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, probability) that the model finds in each text."""
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    pad, windows, owner = int(_CLASS[32]), [], []
    found: dict[tuple[int, int], dict] = {}

    def run():
        for (k, a, b, at), path, sure in zip(owner, *model.decode(model.emissions(np.array(windows))), strict=True):
            own = found.setdefault((k, a), {})
            for start, kind, end, w in window_spans(path, sure, min(WINDOW, b - at), at > a, at + WINDOW < b):
                text = texts[k]
                while text[at + end - 1].isspace() and end > start + 1:
                    end -= 1
                key = (at + start, kind, at + end)
                own[key] = max(w, own.get(key, 0.0))
        windows.clear()
        owner.clear()

    for k, text in enumerate(texts):
        ids = encode(text)
        for a, b in stretches(text):
            for at in range(a, max(a + 1, b - STRIDE), STRIDE):
                own = ids[at : min(b, at + WINDOW)]
                windows.append(np.pad(own, (0, WINDOW - len(own)), constant_values=pad))
                owner.append((k, a, b, at))
                if len(windows) >= block:
                    run()
    if windows:
        run()
    for (k, _), own in sorted(found.items()):
        out[k] += reconciled(own)
    return out


def plausible(kind: int, text: str) -> bool:
    """What a decoded span must hold to count as its kind."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == 0:
        return "@" in text and "." in text.split("@")[-1]
    if kind == 1:
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(p and int(p[-4:]) <= 255 and len(p) <= 3 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and not text[0].isalpha() and not text[-1].isalpha()


def all_spans(model: BiLstmCrf, texts: list[str]) -> list[tuple[list, list]]:
    """Per text: base spans, and all spans (start, kind, end) in order."""
    out = []
    for text, added in zip(texts, model_spans(model, texts), strict=True):
        base = base_spans(text)
        taken = [(a, b) for a, _, b in base]
        more = [(a, k, b) for a, k, b, sure in added if sure >= CONFIDENCE and plausible(k, text[a:b]) and all(b <= x or a >= y for x, y in taken)]
        out.append((base, sorted(base + more)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: BiLstmCrf | None = None) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans, of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((model or trained()).p)  # some 30 kB
    held: dict = {}
    nothing = hashlib.sha256(b"").hexdigest()

    def find(batch: pa.RecordBatch):
        if "model" not in held:
            held["model"] = BiLstmCrf()
            held["model"].p = sent.value
        trigger = np.zeros(256, bool)
        trigger[[*range(0x30, 0x3A), 0x40]] = True
        for i, j, texts in tk.slices(batch.column(1)):
            n = j - i
            some = np.flatnonzero(texts.per_row(trigger[texts.buf]))
            own = batch.column(1).slice(i, n).take(pa.array(some)).to_pylist()
            counts, base, spans = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
            for r, (b, every) in zip(some.tolist(), all_spans(held["model"], own), strict=True):
                for _, k, _ in b:
                    counts[k, r] += 1
                base[r], spans[r] = hashlib.sha256(joined(b).encode()).hexdigest(), joined(every)
            yield {"doc_id": batch.column(0).slice(i, n), "base_sha256": base, "spans": spans} | {f"n_{k}": c for k, c in zip(KINDS, counts, strict=True)}

    return tk.map_batches(id_and_text(docs, doc_id, text), SCHEMA, find)
