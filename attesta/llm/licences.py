"""Licence scan by a trained paragraph classifier.

A softmax regression over the presence of word 1- to 3-grams tells the paragraphs of a document apart
into licence families, other licences ('unknown') and ordinary text ('none'). It is trained on the
paragraphs of public licences and on ordinary sentences (``notices``), varied by rule; nothing of the
corpus enters it. A temperature and a threshold are set on other variants, with licences and
sentences that the fit has not seen. A prediction under the threshold, or that no paragraph of its
family resembles, or one of another family resembles more, is 'unknown'. An SPDX identifier is exact.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm.common import WORD_BYTE, buffers, mix64, narrow, prefix_hashes, span_hashes, spans, steps
from attesta.llm.notices import NOTICES, OTHERS, OTHERS_HELD_OUT, PLAIN, PLAIN_HELD_OUT, SPDX

#: Share of a notice's word pairs that a paragraph must hold (or of its own that a notice must hold).
RESEMBLANCE = 0.5
#: Examples of a family, and of a sentence outside them, in training.
VARIANTS = 120
SEED = 7
#: Temperatures that are tried.
TEMPERATURES = np.geomspace(0.02, 50, 60)

FAMILIES = [*NOTICES]
CLASSES = [*NOTICES, "unknown", "none"]
_COMMON = "the of and in a to is are for on with by this that you may or it as at be".split()


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())


def pairs(text: str) -> set[tuple[str, str]]:
    w = words(text)
    return set(zip(w, w[1:])) or {(x, "") for x in w}


def spdx(text: str) -> str | None:
    """The family of the line's SPDX identifier (the first of an expression), 'unknown' for another, None without one."""
    m = re.search(r"SPDX-License-Identifier:\s*\(?\s*([A-Za-z0-9.+-]+)", text, re.IGNORECASE)
    if not m:
        return None
    name = m[1].lower()
    return next((f for start, f in sorted(SPDX.items(), key=lambda x: -len(x[0])) if name == start or name.startswith(start + "-")), "unknown")


def varied(text: str, rng: random.Random, filler: list[str]) -> str:
    """The notice, or a wrapped line of it, with words dropped, changed in case, led in or followed by others."""
    w = text.split()
    if len(w) > 14 and rng.random() < 0.5:
        at = rng.randrange(len(w) - 8)
        w = w[at : at + rng.randint(8, 14)]
    if len(w) > 5 and rng.random() < 0.5:
        w = [x for x in w if rng.random() > 0.08]
    if rng.random() < 0.25:
        w = f"Copyright (c) {rng.randint(1990, 2030)} {rng.choice(filler)}.".split() + w
    if rng.random() < 0.4:
        at = rng.randint(0, 12)
        w = [rng.choice(filler) for _ in range(at)] + w
    if rng.random() < 0.4:
        w = w + [rng.choice(filler) for _ in range(rng.randint(0, 12))]
    out = " ".join(w)
    return out.lower() if rng.random() < 0.2 else out.upper() if rng.random() < 0.1 else out


def grams(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the 1-, 2- and 3-grams of each row's words."""
    rows, hashes = [row], [word]
    h = word
    for n in (1, 2):
        if len(row) <= n:
            break
        h = mix64(h[:-1] + word[n:] * np.uint64(2 * n + 1))
        same = row[:-n] == row[n:]
        rows.append(row[:-n][same])
        hashes.append(h[same])
    return np.concatenate(rows), np.concatenate(hashes)


def units(array: pa.Array) -> tuple:
    """Per line with any word: row, number in the row, bytes; then (line, hash) of its word grams; then the bytes."""
    offsets, data = buffers(array)
    is_text = np.ones(256, bool)
    is_text[[10, 13]] = False
    row, start, end = spans(offsets, data, is_text)
    number = np.arange(len(row)) - np.searchsorted(row, row, side="left") if len(row) else row
    lowered = data.copy()
    upper = (data >= 65) & (data <= 90)
    lowered[upper] += 32
    _, s, e = spans(offsets, lowered, WORD_BYTE)
    line = np.searchsorted(start, s, side="right") - 1
    r, h = grams(line, span_hashes(prefix_hashes(lowered), s, e))
    return row, number, start, end, r, h, data


class Model:
    """Weights by gram and class, the temperature, the threshold, and the notices' word pairs."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        self.temperature, self.threshold = temperature, threshold
        self.bits = np.zeros(1 << 20, bool)
        self.bits[hashes >> np.uint64(44)] = True
        self.notices = {f: [pairs(t) for t in ts] for f, ts in NOTICES.items()}

    def logits(self, n: int, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows with any known gram, their logits)."""
        at = np.flatnonzero(self.bits[h >> np.uint64(44)])
        j = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        ok = self.hashes[j] == h[at]
        key = np.unique(row[at[ok]].astype(np.int64) * len(self.hashes) + j[ok])
        r, f = key // len(self.hashes), key % len(self.hashes)
        rows, i = np.unique(r, return_inverse=True)
        out = np.zeros((len(rows), len(CLASSES))) + self.bias
        np.add.at(out, i, self.weights[f])
        return rows, out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def resemblance(self, family: str, own: set) -> float:
        return max(len(own & n) / max(1, min(len(n), max(3, len(own)))) for n in self.notices[family])

    def family(self, p: np.ndarray, text: str) -> tuple[str, float, float]:
        """(class, probability, resemblance) of a paragraph that isn't plainly 'none'."""
        exact = spdx(text)
        if exact:
            return exact, 1.0, 1.0
        own, k = pairs(text), int(np.argmax(p[:-2]))
        alike = self.resemblance(FAMILIES[k], own)
        if p[k] >= self.threshold and alike >= RESEMBLANCE:
            other = max(self.resemblance(f, own) for f in FAMILIES if f != FAMILIES[k])
            if other <= alike or p[k] > 0.99:
                return FAMILIES[k], float(p[k]), alike
        return "unknown", float(1 - p[-1]), alike


def _summed(values: np.ndarray, heads: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]))
    if len(heads):
        out[at] = np.add.reduceat(values, heads, axis=0)
    return out


def _softmax_fit(row, feature, y, n, k, rounds=200, penalty=2e-4):
    """Nesterov's gradient steps over (row, feature) pairs sorted by row; every class weighs the same."""
    heads = np.flatnonzero(np.diff(row, prepend=-1))
    order = np.argsort(feature, kind="stable")
    by_feature, from_row = feature[order], row[order]
    tops = np.flatnonzero(np.diff(by_feature, prepend=-1))
    w, b = np.zeros((k, len(CLASSES))), np.zeros(len(CLASSES))
    v, c = w.copy(), b.copy()
    hot = np.eye(len(CLASSES))[y]
    share = (1 / np.maximum(1, np.bincount(y, minlength=len(CLASSES))))[y][:, None] / len(CLASSES)
    norm = np.bincount(row, minlength=n) + 1
    step = 1 / (0.5 * float((share[:, 0] * norm).sum()) + penalty)
    for t in range(rounds):
        z = _summed(v[feature], heads, row[heads], n) + c
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = share * (z / z.sum(axis=1, keepdims=True) - hot)
        gw = _summed(g[from_row], tops, by_feature[tops], k)
        w2, b2 = v - step * (gw + penalty * v), c - step * g.sum(axis=0)
        m = t / (t + 3)
        v, c = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, b


def _line_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    row, _, _, _, r, h, _ = units(pa.array([t.replace("\n", " ") for t in texts]))
    return row[r], h


def _scrambled(vocabulary: list[str], rng: random.Random, filler: list[str]) -> str:
    """Words of notices without their order, among others: ordinary text."""
    w = [rng.choice(vocabulary) if rng.random() < 0.4 else rng.choice(filler) for _ in range(rng.randint(4, 25))]
    return " ".join(w)


@functools.cache
def fit(variants: int = VARIANTS, seed: int = SEED) -> Model:
    """A model from the notices and ordinary sentences. The same input gives the same model."""
    rng = random.Random(seed)
    vocabulary = sorted({w for ts in [*NOTICES.values(), OTHERS] for t in ts for w in words(t)})
    filler = sorted({w for t in PLAIN for w in words(t)}) + ["".join(rng.choice("aeiou") if i % 2 else rng.choice("bdfgklmnprstv") for i in range(rng.randint(3, 9))) for _ in range(400)]

    def examples(n: int, others: list[str], plain: list[str]) -> tuple[list[str], np.ndarray]:
        texts, y = [], []
        for k, ts in enumerate([*NOTICES.values(), others]):
            for t in ts:
                for _ in range(max(6, n // len(ts)) if k < len(NOTICES) else n // 6):
                    texts.append(varied(t, rng, filler))
                    y.append(k)
        for t in plain:
            for _ in range(n // 6):
                texts.append(varied(t, rng, filler))
                y.append(len(CLASSES) - 1)
        for _ in range(4 * n):
            texts.append(_scrambled(vocabulary, rng, filler))
            y.append(len(CLASSES) - 1)
        return texts, np.array(y)

    texts, y = examples(variants, OTHERS, PLAIN)
    row, h = _line_grams(texts)
    _, own = _line_grams([t for ts in [*NOTICES.values(), OTHERS, PLAIN] for t in ts])
    keep = np.setdiff1d(own, _line_grams(_COMMON)[1])
    f = np.searchsorted(keep, h)
    ok = (f < len(keep)) & (keep[np.minimum(f, len(keep) - 1)] == h)
    key = np.unique(row[ok].astype(np.int64) * len(keep) + f[ok])
    w, b = _softmax_fit(key // len(keep), key % len(keep), y, len(texts), len(keep))
    model = Model(keep, w, b, 1.0, 0.5)

    texts, y = examples(variants // 3, OTHERS_HELD_OUT, PLAIN_HELD_OUT)
    row, h = _line_grams(texts)
    rows, z = model.logits(len(texts), row, h)
    logits = np.zeros((len(texts), len(CLASSES))) + b
    logits[rows] = z
    share = (1 / np.maximum(1, np.bincount(y, minlength=len(CLASSES))))[y]
    loss = []
    for model.temperature in TEMPERATURES:
        loss.append(-float((share * np.log(model.probabilities(logits)[np.arange(len(y)), y] + 1e-12)).sum()))
    model.temperature = float(TEMPERATURES[int(np.argmin(loss))])
    p = model.probabilities(logits)
    family, top = y < len(FAMILIES), p[:, :-2].max(axis=1)
    right = p[:, :-2].argmax(axis=1) == y
    grid = np.linspace(0.05, 0.95, 91)
    model.threshold = float(max(grid, key=lambda x: ((right & family & (top >= x)).sum() / max(1, family.sum()) + (top[~family] < x).mean(), -abs(x - 0.5))))
    return model


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row for each input row: key, family, probability, resemblance, line and n_notices.

    The family is that of the document's surest confirmed paragraph (the earlier one of equals);
    'unknown' if there are only other or unconfirmed licences; else 'none', with null figures, as for
    null and empty texts. Paragraphs are lines; a hard-wrapped notice is found by its lines. ``line``
    counts lines that hold anything, from 0. Repeated rows and null keys are kept. Whole texts are
    read. An empty table gives an empty one; other columns are not read. A key that is no whole
    number becomes null. The model is fitted on the driver, from texts of its own, and sent along.
    """
    if model is None:
        model = fit()
    schema = "k long, family string, probability double, resemblance double, line long, n_notices long"

    def run(batches):
        for batch in batches:
            for at, texts in steps(batch.column(1)):
                row, number, start, end, r, h, data = units(texts)
                rows, z = model.logits(len(row), r, h)
                p = model.probabilities(z) if len(rows) else z
                raw = data.tobytes()
                best: dict[int, tuple] = {}
                count: dict[int, int] = {}
                for i in np.flatnonzero(p[:, -1] < 0.5) if len(rows) else ():
                    u = int(rows[i])
                    name, prob, alike = model.family(p[i], raw[start[u] : end[u]].decode())
                    d = int(row[u])
                    count[d] = count.get(d, 0) + 1
                    rank = (name != "unknown", prob, -int(number[u]))
                    if d not in best or rank > best[d][0]:
                        best[d] = (rank, name, prob, alike, int(number[u]))
                found = [best.get(i) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([b[1] if b else "none" for b in found], pa.string()),
                        pa.array([b[2] if b else None for b in found], pa.float64()),
                        pa.array([b[3] if b else None for b in found], pa.float64()),
                        pa.array([b[4] if b else None for b in found], pa.int64()),
                        pa.array([count.get(i, 0) for i in range(len(texts))], pa.int64()),
                    ],
                    names=["k", "family", "probability", "resemblance", "line", "n_notices"],
                )

    return narrow(docs, key, text).mapInArrow(run, schema).withColumnRenamed("k", key)
