"""Toxicity behind obfuscation: a noisy channel is decoded, then the restored text is scored.

A character language model (trigrams, counted over every document) is the source; the channel writes
letters as look-alikes, puts separators between them, or repeats them. Each suspicious span becomes a
lattice of letters, and Viterbi search finds its likeliest reading. A logistic regression, fitted on a
bounded sample of labelled documents, scores the words of the restored text by words and beginnings
of words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import NOT_SPACE_BYTE, WORD_BYTE, buffers, hash_sample, mix64, narrow, prefix_hashes, quoted, span_hashes, spans, steps

#: Labelled documents that the classifier is fitted on, at most; chosen by a hash of their keys.
SAMPLE_DOCS = 20_000
#: A feature needs so many toxic documents of the sample, and such log odds; all that have them count.
LEAST_DOCS, LEAST_ODDS = 3, 1.5
#: Bytes of the beginnings that count as features.
BEGINNINGS = (4, 5, 6, 7)
#: A reading is taken if its mean log probability a letter isn't further below the corpus's mean.
SLACK = 2.5
SEED = 3
#: Lowest score of a toxic document.
THRESHOLD = 0.65

LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøùúûüýÿßœ"
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
SYMBOLS = 64
OTHER = 63
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "%": "o", "#": "h",
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
}
#: Look-alikes that are letters of another script: they count only beside a Latin letter.
FOREIGN = {c for c in LOOKS if c.isalpha()}
SEPARATORS = set(" .-_*~'`,/\\")
_LOOK_COST, _REPEAT_COST, _CUT_COST = math.log(0.3), math.log(0.4), math.log(0.9)


def _codes() -> np.ndarray:
    t = np.zeros(0x250, np.uint8)
    for i in range(0x250):
        c = chr(i).lower()
        t[i] = CODE.get(c, OTHER if c.isalpha() else 0)
    return t


_CODES = _codes()


def _counted(batches):
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for _, texts in steps(batch.column(0)):
            flat = np.frombuffer("\n".join(x or "" for x in texts.to_pylist()).encode("utf-32-le"), np.uint32)
            c = np.where(flat < 0x250, _CODES[np.minimum(flat, 0x24F)], OTHER).astype(np.int64)
            c = np.concatenate([[0, 0], c, [0]])
            p1 = c[1:-1]
            p2 = np.where(p1 == 0, 0, c[:-2])
            c = c[2:]
            seen = (c != 0) | (p1 != 0)
            total += np.bincount((p2 << 12 | p1 << 6 | c)[seen], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


class Letters:
    """Trigram log probabilities, backed off to bigrams and single letters; 0 is a word's edge."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1 + 1).sum()
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3)
        self.mean = float((c3 * self.log).sum() / max(1.0, c3.sum()))
        self.table = self.log.astype(np.float32)
        self.cache: dict[str, str | None] = {}


def letters(docs: DataFrame, text: str = "text") -> Letters:
    """The model over every document. The driver gets one row a trigram, at most 64 ** 3."""
    grams = docs.select(quoted(text).cast("string").alias("t")).mapInArrow(_counted, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in grams.collect():
        counts[r["gram"]] = r["n"]
    return Letters(counts)


def readings(c: str) -> list[tuple[str, float]]:
    """Letters that a written character may stand for, with the channel's log probability; '' drops it."""
    if c in CODE:
        return [(c, 0.0)]
    if c in FOREIGN:
        return [(LOOKS[c], _LOOK_COST), (c, 0.0)]
    if c in LOOKS:
        return [(x, _LOOK_COST - math.log(len(LOOKS[c]))) for x in LOOKS[c]]
    if c in SEPARATORS:
        return [("", _CUT_COST)]
    return [(c, 0.0)] if c.isalpha() else [("", _CUT_COST * 20)]


def decode(span: str, model: Letters, doubles: bool = True) -> tuple[str, float]:
    """The likeliest reading of a span, and its language-model log probability a letter.

    ``doubles``: a letter written twice may be one letter; one written more often always may.
    """
    log = model.table
    paths: dict[tuple[int, int], tuple[float, float, str]] = {(0, 0): (0.0, 0.0, "")}
    span = span.lower()
    for i, c in enumerate(span):
        often = doubles or span[max(0, i - 2) : i + 3].count(c * 3) > 0
        after: dict[tuple[int, int], tuple[float, float, str]] = {}
        for letter, cost in readings(c):
            code = CODE.get(letter, OTHER)
            for (a, b), (s, lm, word) in paths.items():
                if not letter:
                    steps_ = [((a, b), s + cost, lm, word)]
                else:
                    p = float(log[a, b, code])
                    steps_ = [((b, code), s + cost + p, lm + p, word + letter)]
                    if often and word and word[-1] == letter:  # a repetition
                        steps_.append(((a, b), s + cost + _REPEAT_COST, lm, word))
                for state, total, l2, w in steps_:
                    if state not in after or total > after[state][0]:
                        after[state] = (total, l2, w)
        paths = after
    best = max(((s + float(log[a, b, 0]), lm + float(log[a, b, 0]), w) for (a, b), (s, lm, w) in paths.items()), default=(0.0, 0.0, ""))
    return best[2], best[1] / (len(best[2]) + 1)


def restore(span: str, model: Letters) -> str | None:
    """The plausible readings that differ from what is written, with doubled letters as one and as two."""
    if span not in model.cache:
        if len(model.cache) >= MOST_CACHED:
            model.cache.clear()
        found = dict.fromkeys(w for w, mean in (decode(span, model), decode(span, model, False)) if len(w) > 2 and w != span.lower() and mean >= model.mean - SLACK)
        model.cache[span] = " ".join(found) or None
    return model.cache[span]


_IS_LETTER = WORD_BYTE.copy()
_IS_LETTER[48:58] = False
_IS_LOOK = np.zeros(256, bool)
_IS_LOOK[[ord(c) for c in LOOKS if ord(c) < 128]] = True
_IS_CUT = np.zeros(256, bool)
_IS_CUT[[ord(c) for c in SEPARATORS - {" "}]] = True
_IS_LATIN = _IS_LETTER.copy()
_IS_LATIN[128:] = False


def _two_bytes(chars) -> np.ndarray:
    t = np.zeros(1 << 16, bool)
    for c in chars:
        b = c.encode()
        if len(b) == 2:
            t[b[0] << 8 | b[1]] = True
    return t


_WIDE_LOOKS = _two_bytes(c for c in LOOKS if not c.isalpha())
_FOREIGN_LOOKS = _two_bytes(x for c in FOREIGN for x in (c, c.upper()) if len(x) == 1)
_LONG_LOOKS = [np.frombuffer(c.encode(), np.uint8) for c in LOOKS if len(c.encode()) > 2]
#: Readings that a worker keeps at hand.
MOST_CACHED = 1 << 18
_EDGE = ".,;:!?\"'`)]}>([{<*_~-|"


def suspicious(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(row, span) of what may be obfuscated: words with look-alikes or separators inside, Latin words with
    letters of another script, words that repeat a letter, and four or more single letters in a row, whatever blanks stand between them."""
    row, start, end = spans(offsets, data, NOT_SPACE_BYTE)
    if not len(row):
        return row, []
    wide, foreign = np.zeros(len(data), bool), np.zeros(len(data), bool)
    high = np.flatnonzero((data >= 0xC2) & (data < 0xF0))
    high = high[high + 1 < len(data)]
    code = data[high].astype(np.int64) << 8 | data[high + 1]
    wide[high], foreign[high] = _WIDE_LOOKS[code], _FOREIGN_LOOKS[code]
    for c in _LONG_LOOKS:
        at = high[(data[high] == c[0]) & (high + len(c) <= len(data))]
        for j in range(1, len(c)):
            at = at[data[at + j] == c[j]]
        wide[at] = True
    head = (data & 0xC0) != 0x80
    letter = np.concatenate([[0], np.cumsum(_IS_LETTER[data] & head & ~wide)])
    n = letter[end] - letter[start]
    odd = ~_IS_LETTER[data] & (_IS_LOOK[data] | _IS_CUT[data])
    inner = wide.copy()
    inner[:-1] |= odd[:-1] & (_IS_LETTER[data[1:]] | _IS_LOOK[data[1:]])
    double = np.zeros(len(data), bool)
    double[1:] = (data[1:] | 0x20 == data[:-1] | 0x20) & _IS_LETTER[data[1:]] & (data[1:] < 128)  # in either case
    double[start] = False  # what stands before is another row's or a blank
    two = np.zeros(len(data), bool)
    two[3:] = (data[3:] == data[1:-2]) & (data[2:-1] == data[:-3]) & (data[:-3] >= 0xC2) & (data[:-3] < 0xE0)  # letters of two bytes
    two[np.minimum(start + 1, len(data) - 1)] = False
    double |= two
    sums = np.concatenate([[0], np.cumsum(inner)])
    twos = np.concatenate([[0], np.cumsum(double)])
    latin = np.concatenate([[0], np.cumsum(_IS_LATIN[data])])
    mixed = np.concatenate([[0], np.cumsum(foreign)])
    pick = (n >= 1) & (sums[end] - sums[start] > 0) | (twos[end] - twos[start] > 0) | (latin[end] > latin[start]) & (mixed[end] > mixed[start])
    raw = data.tobytes()
    rows, found = [], []
    for r, s, e in zip(row[pick].tolist(), start[pick].tolist(), end[pick].tolist()):
        word = raw[s:e].decode().rstrip(_EDGE)
        while len(word) > 3 and word[-1] == word[-2] == word[-3] and not word[-1].isalpha():
            word = word.rstrip(word[-1])
        word = word.lstrip(_EDGE.replace("|", "").replace("!", ""))
        if len(word) > 2:
            rows.append(r)
            found.append(word)
    chars = np.concatenate([[0], np.cumsum(head)])
    single = (chars[end] - chars[start] == 1) & (_IS_LETTER[data[start]] | _IS_LOOK[data[start]])
    linked = single[1:] & single[:-1] & (row[1:] == row[:-1])
    first = np.flatnonzero(linked & ~np.concatenate([[False], linked[:-1]])) if len(linked) else []
    tail = np.flatnonzero(linked & ~np.concatenate([linked[1:], [False]])) + 1 if len(linked) else []
    for a, b in zip(first, tail):
        if b - a >= 3:
            rows.append(int(row[a]))
            found.append(" ".join(raw[start[a] : end[b]].decode().split()))
    return np.array(rows, np.int64), found


def word_features(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and of its beginnings."""
    offsets, data = buffers(pc.utf8_lower(array.cast(pa.large_string())))
    row, start, end = spans(offsets, data, WORD_BYTE)
    sums = prefix_hashes(data)
    rows, hashes = [row], [span_hashes(sums, start, end)]
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        rows.append(row[long])
        hashes.append(mix64(span_hashes(sums, start[long], start[long] + n) + np.uint64(1)))
    return np.concatenate(rows), np.concatenate(hashes)


def features(array: pa.Array, model: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the restored text's features, and how many spans of each row were restored."""
    offsets, data = buffers(array)
    row, found = suspicious(offsets, data)
    words: dict[int, list[str]] = {}
    for r, span in zip(row.tolist(), found):
        w = restore(span, model)
        if w:
            words.setdefault(r, []).append(w)
    rows, hashes = word_features(array)
    n = np.zeros(len(array), np.int64)
    if words:
        keys = list(words)
        r2, h2 = word_features(pa.array([" ".join(words[k]) for k in keys]))
        rows, hashes = np.concatenate([rows, np.array(keys)[r2]]), np.concatenate([hashes, h2])
        for k in keys:
            n[k] = len(words[k])
    return rows, hashes, n


class Weights:
    """Weights by feature hash, with a bitmap that rules most hashes out."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        self.bits = np.zeros(1 << 20, bool)
        self.bits[hashes >> np.uint64(44)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, feature) of the hashes that have a weight."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        j = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        ok = self.hashes[j] == hashes[at]
        return at[ok], j[ok]

    def counts(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, times) of features with a weight."""
        i, j = self.hits(hashes)
        pair, times = np.unique(rows[i] * max(1, len(self.hashes)) + j, return_counts=True)
        return pair // max(1, len(self.hashes)), pair % max(1, len(self.hashes)), times

    def score(self, n: int, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        r, f, times = self.counts(rows, hashes)
        z = np.bincount(r.astype(np.int64), self.weights[f.astype(np.int64)] * np.log1p(times), minlength=n) + self.bias
        return 1 / (1 + np.exp(-z))


def fitted(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, k: int, rounds: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """L2 logistic regression over sparse triples by Nesterov's gradient steps; the positive and the
    negative examples weigh the same. Nothing is drawn, so the fit repeats."""
    n = len(y)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(k)
    b = 0.0
    v, c = w.copy(), b
    norm = np.bincount(row, value**2, minlength=n) + 1
    step = 1 / (0.25 * float((share * norm).sum()) + penalty)
    for t in range(rounds):
        z = np.bincount(row, v[feature] * value, minlength=n) + c
        g = share * (1 / (1 + np.exp(-z)) - y)
        w2 = v - step * (np.bincount(feature, g[row] * value, minlength=k) + penalty * v)
        b2 = c - step * g.sum()
        m = t / (t + 3)
        v, c = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, b


def train(docs: DataFrame, labels: DataFrame, model: Letters, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> Weights:
    """Weights from at most ``sample`` labelled documents, so what is broadcast and gathered is bounded."""
    marked = labels.select(quoted(key).try_cast("long").alias("k"), (quoted("toxic").cast("double") > 0).cast("int").alias("y")).where("k is not null and y is not null")
    known = hash_sample(marked.groupBy("k").agg(F.max("y").alias("y")), "k", sample, SEED)
    rows = narrow(docs, key, text).where("t is not null").join(F.broadcast(known), "k").select("k", "t", "y")

    def distinct(batches):
        for batch in batches:
            for at, texts in steps(batch.column(1)):
                r, h, _ = features(texts, model)
                y = batch.column(2).slice(at, len(texts)).to_numpy().astype(np.uint64)
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(y[r[new]].astype(np.int32))], names=["h", "y"])

    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    a, b = F.sum("y"), F.sum(1 - F.col("y"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    best = (
        rows.mapInArrow(distinct, "h long, y int").groupBy("h").agg(a.alias("a"), b.alias("b"))
        .where(F.col("a") >= LEAST_DOCS).select("h", odds.alias("o"))
        .where(F.col("o") >= LEAST_ODDS)
    )
    hashes = np.sort(np.array([r["h"] for r in best.collect()], np.int64).view(np.uint64))  # as many as the sample gives
    empty = Weights(hashes, np.zeros(len(hashes)), 0.0)

    def counted(batches):
        for batch in batches:
            for at, texts in steps(batch.column(1)):
                r, h, _ = features(texts, model)
                i, f, times = empty.counts(r, h)
                y = batch.column(2).slice(at, len(texts)).to_pylist()
                by: list[list] = [[] for _ in y]
                for d, x, m in zip(i.tolist(), f.tolist(), times.tolist()):
                    by[int(d)].append((int(x), int(m)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y, pa.int32()), pa.array([[x for x, _ in d] for d in by], pa.list_(pa.int32())), pa.array([[m for _, m in d] for d in by], pa.list_(pa.int32()))], names=["y", "f", "m"]
                )

    got = rows.mapInArrow(counted, "y int, f array<int>, m array<int>").collect()  # at most ``sample`` short lists
    y = np.array([r["y"] for r in got], float)
    row = np.repeat(np.arange(len(got)), [len(r["f"]) for r in got]).astype(np.int64)
    feature = np.array([x for r in got for x in r["f"]], np.int64)
    value = np.log1p(np.array([x for r in got for x in r["m"]], float))
    if not toxic or not clean or not len(hashes):
        return Weights(hashes, np.zeros(len(hashes)), -20.0)
    w, bias = fitted(row, feature, value, y, len(hashes))
    return Weights(empty.hashes, w, bias)


def scored(docs: DataFrame, model: Letters, weights: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_restored) of each row. A null text scores null, an empty one as no sign of toxicity."""

    def run(batches):
        for batch in batches:
            for at, texts in steps(batch.column(1)):
                r, h, n = features(texts, model)
                null = texts.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(weights.score(len(texts), r, h), mask=null), pa.array(n, mask=null)], names=["k", "score", "n_restored"]
                )

    return narrow(docs, key, text).mapInArrow(run, "k long, score double, n_restored long").withColumnRenamed("k", key)


def toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(key, score, n_restored) of the documents that score ``threshold`` at least.

    A null text is never toxic; an empty one neither. Repeated rows are scored one by one and a null
    key is kept. Whole texts count, whatever their length. A label above 0 is toxic; of labels that
    repeat a key the greatest counts, null ones don't. Without documents, or without labels of both
    kinds, nothing is toxic. Other columns are not read.
    """
    model = letters(docs, text)
    weights = train(docs, labels, model, key, text, sample)
    return scored(docs, model, weights, key, text).where(F.col("score") >= threshold)
