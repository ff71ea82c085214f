"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The piece lattice of a text has an edge for every piece of a published vocabulary that matches
there, and byte edges for a character without a piece. Forward filtering sums the weights of all
paths to each position; backward sampling then draws one path from the end, each edge with exactly
its share. Draws depend on the row's key and the place in the text alone, so a row is segmented the
same way in any batch, on any machine.

No piece holds a blank after another character, nor a line end, so the lattice falls apart into runs
' *[^ ]+': the draw over the whole text is the product of independent draws over these. The sums are
taken once for each distinct run of a batch, all runs side by side.

The published model is a merge list without probabilities. A piece's weight follows Zipf's law in
its merge rank, p(r) = 1 / ((r + Q) H); nothing is trained. ``alpha`` smooths: weights are p ** alpha.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import mix64, narrow, quoted, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.5
SEED = 1
#: Zipf's offset, and what a byte edge has less than the rarest piece, in log weight a byte.
Q, BYTE_PENALTY = 2.7, 2.0
#: Characters that one vectorised step handles.
STEP_CHARS = 750_000
_SPACE, _MARK = 32, 0x2581
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces of a model file, as tables to look up and to decode with."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces, ids, raw = [], [], [b""] * n
        self.byte = np.full(256, -1, np.int32)
        for i in range(n):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                raw[i] = bytes([int(p[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append([_SPACE if c == "▁" else ord(c) for c in p])
                ids.append(i)
                raw[i] = p.replace("▁", " ").encode()
        rank = np.arange(len(ids), dtype=float)
        weight = 1 / (rank + Q)
        logs = np.log(weight / weight.sum())
        self.byte_log = float(logs.min() - BYTE_PENALTY)
        self.longest = max(map(len, pieces))
        self.size = n
        self.raw_length = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_length)])[:-1]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        #: by width, a table of all beginnings of pieces of that width; id -1 where it is no piece itself
        self.tables: dict[int, tuple] = {}
        found: dict[int, dict[int, tuple[int, float]]] = {w: {} for w in range(1, self.longest + 1)}
        width = np.array([len(p) for p in pieces])
        grid = np.zeros((len(pieces), self.longest), np.uint64)
        for j, p in enumerate(pieces):
            grid[j, : len(p)] = p
        h = np.zeros(len(pieces), np.uint64)
        spelled: dict[int, tuple] = {}
        for w in range(1, self.longest + 1):
            h = roll(h, grid[:, w - 1])
            for j in np.flatnonzero(width >= w):
                k = int(h[j])
                if spelled.setdefault(k, tuple(pieces[j][:w])) != tuple(pieces[j][:w]):
                    raise ValueError("two pieces share a hash")
                if width[j] == w:
                    found[w][k] = (ids[j], float(logs[j]))
                else:
                    found[w].setdefault(k, (-1, 0.0))
            self.tables[w] = table(found[w])


def roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of one more character; run over pieces and text alike."""
    h = (h ^ (c + np.uint64(0x51ED27))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def table(entries: dict[int, tuple[int, float]]) -> tuple:
    """An open-addressed hash table: keys, ids (-2: no entry) and log weights by slot."""
    bits = max(4, int(len(entries) * 4).bit_length())
    keys, at, value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32), np.zeros(1 << bits)
    mask = (1 << bits) - 1
    deepest = 0
    for k, (i, v) in entries.items():
        s, depth = k & mask, 0
        while at[s] != -2:
            s, depth = (s + 1) & mask, depth + 1
        keys[s], at[s], value[s] = k, i, v
        deepest = max(deepest, depth)
    return keys, at, value, mask, deepest


def find(t: tuple, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, -1 for a mere beginning or -2 for neither; log weight) of each hash."""
    keys, at, value, mask, deepest = t
    s = (h & np.uint64(mask)).astype(np.int64)
    ids = np.where(keys[s] == h, at[s], -2)
    rest = np.flatnonzero((ids == -2) & (at[s] != -2))
    for _ in range(deepest):
        if not len(rest):
            break
        s[rest] = (s[rest] + 1) & mask
        ids[rest] = np.where(keys[s[rest]] == h[rest], at[s[rest]], -2)
        rest = rest[(ids[rest] == -2) & (at[s[rest]] != -2)]
    return ids, value[s]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def run_starts(chars: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Where runs start: at a row's start, at a line end and after it, and at a blank after anything else."""
    n = len(chars)
    blank, line = chars == _SPACE, chars == 10
    head = np.zeros(n, bool)
    head[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
    head[row_start[row_start < n]] = True
    return np.flatnonzero(head)


class Lattice:
    """The shares, by width, of the edges that end after each character of distinct runs.

    Rows are in the order of places, then of runs by falling length, so that each forward step works
    on whole slices. Sums are kept in proportion to the latest one, so no run is too long for them.
    """

    def __init__(self, v: Vocabulary, flat: np.ndarray, start: np.ndarray, length: np.ndarray, alpha: float):
        n, runs = len(flat), len(start)
        order = np.argsort(-length, kind="stable")
        rank = np.empty(runs, np.int64)
        rank[order] = np.arange(runs)
        most = int(length.max())
        count = np.searchsorted(-length[order], -np.arange(1, most + 1), side="right")
        offset = np.concatenate([[0], np.cumsum(count)])
        position = np.arange(n) - np.repeat(start, length)
        left = np.repeat(length, length) - position
        #: where the edges that end after each character, numbered run by run, stand here
        self.at = at = offset[position] + np.repeat(rank, length)
        c = flat.astype(np.uint64)
        c[flat == _MARK] = np.uint64(1 << 40)  # a written mark isn't a blank; it goes by bytes
        wide = min(v.longest, most)
        weight = np.zeros((n, wide))
        self.piece = piece = np.full((n, wide), -1, np.int32)
        live, h = np.arange(n), np.zeros(n, np.uint64)
        for w in range(1, wide + 1):
            if w > 1:
                ok = left[live] >= w
                live, h = live[ok], h[ok]
            if not len(live):
                break
            h = roll(h, c[live + (w - 1)])
            i, value = find(v.tables[w], h)
            ok = i != -2
            live, h, i, value = live[ok], h[ok], i[ok], value[ok]
            hit = i >= 0
            e = at[live[hit] + (w - 1)]
            weight[e, w - 1] = np.exp(value[hit] * alpha)
            piece[e, w - 1] = i[hit]
        bare = np.flatnonzero(piece[at, 0] == -1)
        if len(bare):
            x = flat[bare]
            size = 1 + (x >= 0x80).astype(int) + (x >= 0x800) + (x >= 0x10000)
            weight[at[bare], 0] = np.exp(alpha * v.byte_log * size)
            piece[at[bare], 0] = -2  # bytes
        self.share = np.empty((n, wide), np.float32)
        before = np.zeros((runs, wide))
        before[:, 0] = 1.0
        for p in range(most):
            lo, hi = offset[p], offset[p + 1]
            before = before[: hi - lo]
            terms = weight[lo:hi] * before
            np.cumsum(terms, axis=1, out=terms)
            total = terms[:, -1:]
            self.share[lo:hi] = terms / total
            later = np.empty_like(before)
            later[:, 0] = 1.0
            later[:, 1:] = before[:, :-1] / total
            before = later

    def draw(self, e: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(width, piece) drawn of the edges in rows e, by u in [0, 1)."""
        share, wide = self.share[e], self.share.shape[1]
        w = np.minimum((share <= u[:, None].astype(np.float32)).sum(axis=1), wide - 1)
        piece = self.piece[e, w]
        for i in np.flatnonzero(piece == -1):  # u met the last share, but for rounding: take the last edge
            w[i] = np.flatnonzero(self.piece[e[i]] != -1)[-1]
            piece[i] = self.piece[e[i], w[i]]
        return w + 1, piece


def draws(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row's seed and place in its text."""
    return (mix64(seed + (place.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER) >> np.uint64(11)).astype(float) * 2.0**-53


def encode(v: Vocabulary, texts: list[str], seeds: np.ndarray, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by row, ids) of sampled segmentations. seeds: uint64 by row."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    row_end = np.cumsum(sizes)
    row_start = row_end - sizes
    n = len(flat)
    if not n:
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int32)
    start = run_starts(flat, row_start)
    length = np.diff(np.append(start, n))
    h = np.zeros(n, np.uint64)
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(length.max()), np.uint64(0xD6E8FEB86659FD93))]))
    place = np.arange(n) - np.repeat(start, length)
    h = mix64(flat.astype(np.uint64) + np.uint64(7)) * up[place]
    sums = np.add.reduceat(h, start) ^ mix64(length.astype(np.uint64))
    _, first, which = np.unique(sums, return_index=True, return_inverse=True)
    dl = length[first]
    ds = np.concatenate([[0], np.cumsum(dl)[:-1]])
    dflat = flat[np.repeat(start[first] - ds, dl) + np.arange(int(dl.sum()))]
    same = dflat[np.repeat(ds[which], length) + place] == flat
    if not same.all():
        raise ValueError("two runs share a hash")
    lattice = Lattice(v, dflat, ds, dl, alpha)
    row = np.searchsorted(row_end, start, side="right")
    seed = seeds[row]
    base = start - row_start[row]
    token = np.full(n, -1, np.int32)
    live, at = np.arange(len(start)), length.copy()
    while len(live):
        e = lattice.at[ds[which[live]] + at[live] - 1]
        w, piece = lattice.draw(e, draws(seed[live], base[live] + at[live]))
        at[live] -= w
        token[start[live] + at[live]] = piece
        live = live[at[live] > 0]
    place = np.flatnonzero(token != -1)
    ids = token[place]
    size = np.ones(len(ids), np.int64)
    raw = np.flatnonzero(ids == -2)
    x = flat[place[raw]].astype(np.int64)
    size[raw] = 1 + (x >= 0x80) + (x >= 0x800) + (x >= 0x10000)
    out = np.repeat(ids, size)
    if len(raw):
        to = np.cumsum(size)[raw] - size[raw]
        code = "".join(map(chr, x.tolist())).encode()
        own = np.repeat(to - (np.cumsum(size[raw]) - size[raw]), size[raw]) + np.arange(len(code))
        out[own] = v.byte[np.frombuffer(code, np.uint8)]
    ends = np.concatenate([[0], np.cumsum(size)])
    return ends[np.searchsorted(place, np.append(row_start, n))], out


def decode(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes that ids stand for; of byte ids themselves, of pieces with blanks for marks."""
    length = v.raw_length[ids]
    ends = np.cumsum(length)
    return v.raw[np.repeat(v.raw_start[ids] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _groups(texts: list[str]):
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STEP_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def row_seeds(keys: pa.Array, texts: list[str], seed: int) -> np.ndarray:
    """By key; by a hash of the text where the key is null."""
    k = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    for i in np.flatnonzero(keys.is_null().to_numpy(zero_copy_only=False)):
        k[i] = int.from_bytes(hashlib.blake2b(texts[i].encode(), digest_size=8).digest(), "little")
    return mix64(k * _MULTIPLIER + np.uint64(seed))


def _encoded(batches, path: str, alpha: float, seed: int):
    v = vocabulary(path)
    schema = pa.schema([("k", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("lossless", pa.bool_())])
    for batch in batches:
        all_texts = batch.column(1)
        for lo, hi in _groups([x or "" for x in all_texts.to_pylist()]):
            column = all_texts.slice(lo, hi - lo)
            texts = [x or "" for x in column.to_pylist()]
            keys = batch.column(0).slice(lo, hi - lo)
            offsets, ids = encode(v, texts, row_seeds(keys, texts, seed), alpha)
            back = decode(v, ids)
            width = np.concatenate([[0], np.cumsum(v.raw_length[ids])])[offsets]
            whole = "".join(texts).encode()
            sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            if len(back) == len(whole) and (np.diff(width) == sizes).all() and back.tobytes() == whole:
                same = np.ones(len(texts), bool)
            else:
                raw = back.tobytes()
                same = np.array([raw[width[i] : width[i + 1]] == t.encode() for i, t in enumerate(texts)], bool)
            null = column.is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null) if null.any() else None)
            yield pa.RecordBatch.from_arrays(
                [keys, lists, pa.array(np.diff(offsets), mask=null), pa.array(sizes, mask=null), pa.array(same, mask=null)], schema=schema
            )


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """key, ids, n_tokens, n_bytes and lossless (the ids decode to the very bytes) of each row.

    A null text has nulls, an empty one no ids. Rows with equal key and text have equal ids; one with
    a key that is null or no whole number is drawn by its text. Any characters survive, the mark U+2581 itself too. Whole texts
    are encoded. An empty table gives an empty one; other columns are not read.
    """
    out = narrow(docs, key, text).mapInArrow(lambda b: _encoded(b, model, alpha, seed), "k long, ids array<int>, n_tokens long, n_bytes long, lossless boolean")
    return out.withColumnRenamed("k", key)


def decoded(rows: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of their ids in column ``text``, or ``text_1`` and so on if that is taken in any
    case; null ids give null, no ids ''. An empty table gives an empty one."""

    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        v = vocabulary(model)
        out = []
        for x in lists:
            out.append(None if not x.is_valid else decode(v, np.asarray(x.values, np.int32)).tobytes().decode() if len(x.values) else "")
        return pa.array(out, pa.string())

    return rows.withColumn(unused(rows, text), of(quoted(ids)))
