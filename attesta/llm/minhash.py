"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

Each pair of neighbouring words is hashed once; the hash's top bits choose a bin, the rest compete
for its minimum. An empty bin takes the value of the bin that a fixed random sequence of its own
reaches first, so that two documents agree in a bin with the probability of their Jaccard
similarity, however short they are. Runs of bins make bands; documents that share a band's hash meet
in a bucket, where each is tied to the bucket's first document and to the first of those that share
the next band's hash too: at most two edges a member, whatever the bucket's size. Edges stand if the
signatures agree enough; documents that edges connect are one group.

First documents are grouped minima, combined before the shuffle, and joined back, so no task holds a
bucket or a group of exact copies: a large one is split by the skew join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from attesta.llm.common import checkpointed, forget, mix64, narrow, quoted, steps, unused, word_hashes

BINS = 128
BANDS = 32
SHINGLE_WORDS = 2
#: Lowest estimated Jaccard similarity of an edge.
SIMILARITY = 0.55
_SEQUENCE = 4096


def shingles(row: np.ndarray, words: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``width`` words of a row; a row with fewer has one, of all its words."""
    n = len(row)
    if not n:
        return row, words
    last = np.searchsorted(row, row, side="right")
    at = np.arange(n)
    first = np.searchsorted(row, row, side="left")
    heads = (at + width <= last) | (at == first)
    at = at[heads]
    last = last[heads]
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        inside = at + j < last
        w = words[np.minimum(at + j, n - 1)]
        h = np.where(inside, mix64(h + w * np.uint64(2 * j + 1)), h)
    return row[at], h


def _walk(bins: int) -> np.ndarray:
    """For each bin the bins it tries, in order: a fixed random sequence, then all in turn."""
    a = np.arange(_SEQUENCE, dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)[None, :]
    tried = (mix64(a + np.uint64(0xA5A5)) % np.uint64(bins)).astype(np.int64)
    rest = (np.arange(bins)[None, :] + np.arange(bins)[:, None]) % bins
    return np.vstack([tried, rest])


_walks: dict[int, np.ndarray] = {}


def signatures(array: pa.Array, bins: int = BINS, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(rows with any word, their densified minima as uint64[rows, bins])."""
    row, h = shingles(*word_hashes(array), width)
    rows, at = np.unique(row, return_inverse=True)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(rows) * bins, empty, np.uint64)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    place = at * bins + (h >> shift).astype(np.int64)
    np.minimum.at(out, place, h & ((np.uint64(1) << shift) - np.uint64(1)))
    out = out.reshape(-1, bins)
    walk = _walks.setdefault(bins, _walk(bins))
    was = out != empty
    i, j = np.nonzero(~was)
    for tried in walk:
        if not len(i):
            break
        to = tried[j]
        ok = was[i, to]
        out[i[ok], j[ok]] = out[i[ok], to[ok]]
        i, j = i[~ok], j[~ok]
    return rows, out


def _signed(batches, bins: int, bands: int, width: int):
    schema = pa.schema([("k", pa.int64()), ("same", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
    each = bins // bands
    mark = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) << np.uint64(40)
    for batch in batches:
        for at, texts in steps(batch.column(1)):
            rows, sig = signatures(texts, bins, width)
            if not len(rows):
                continue
            h = np.zeros((len(rows), bands), np.uint64) + mark
            for j in range(each):
                h = mix64(h + sig[:, j::each])
            same = np.zeros(len(rows), np.uint64)
            for b in range(bands):
                same = mix64(same + h[:, b])
            small = (mix64(sig) & np.uint64(255)).astype(np.uint8)
            n = len(rows)
            sigs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * bins).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(small))])
            lists = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * bands).astype(np.int32)), pa.array(h.reshape(-1).view(np.int64)))
            keys = batch.column(0).take(pa.array(rows + at))
            yield pa.RecordBatch.from_arrays([keys, pa.array(same.view(np.int64)), sigs, lists], schema=schema)


def signed(docs: DataFrame, key: str, text: str, bins: int = BINS, bands: int = BANDS, width: int = SHINGLE_WORDS) -> DataFrame:
    """(k, same, sig, bands) of each row with a key and a word; ``same`` is equal for equal signatures."""
    rows = narrow(docs, key, text).where("k is not null and t is not null")
    return rows.mapInArrow(lambda b: _signed(b, bins, bands, width), "k long, same long, sig binary, bands array<long>")


@F.arrow_udf(DoubleType())
def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Estimated Jaccard similarity of two signatures of one byte a bin, without the chance agreement."""

    def grid(x: pa.Array) -> np.ndarray:
        x = x.cast(pa.binary())
        offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
        return np.frombuffer(x.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(x), -1)

    if not len(a):
        return pa.array([], pa.float64())
    share = (grid(a) == grid(b)).mean(axis=1)
    return pa.array(np.maximum(0.0, (share - 1 / 256) / (1 - 1 / 256)))


def star_edges(signs: DataFrame) -> DataFrame:
    """Distinct candidate edges (a < b): to the least key of the bucket, and of those in it that share the next band."""
    n = F.size("bands")
    items = signs.select("k", "bands", F.posexplode("bands").alias("i", "h")).select("k", "h", F.element_at("bands", F.pmod(F.col("i") + 1, n) + 1).alias("next"))
    first = items.groupBy("h").agg(F.min("k").alias("o"), F.max("k").alias("last")).where("o <> last").select("h", "o")
    shared = items.join(first, "h")
    second = shared.groupBy("h", "next").agg(F.min("k").alias("p"), F.max("k").alias("last")).where("p <> last").select("h", "next", "p")
    pairs = shared.select("k", "o").unionByName(shared.join(second, ["h", "next"]).select("k", F.col("p").alias("o"))).where("o <> k")
    return pairs.select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(k, root) of every key that an edge (a, b) touches: root is the least key of its group.

    Alternates large-star and small-star steps until the edges are one star a group. Every step is
    a grouped minimum (combined before the shuffle) and a join; each round is checkpointed.
    """
    e = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        last, e = e, checkpointed(low.select(F.col("m").alias("a"), "b").unionByName(small).distinct())
        forget(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("b").alias("k"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("k"), F.col("a").alias("root")).distinct())
        state = now


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bins: int = BINS, bands: int = BANDS, width: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, kept key): each document that is an exact or near copy, and the least key of its group.

    A document whose text is null or has no word is in no group; one whose key is null or no whole
    number is left out.
    Rows that repeat a key are one document, a copy of all that any of its rows is a copy of. Whole
    texts count. An empty table gives an empty one. Other columns are not read.
    """
    rows = checkpointed(signed(docs, key, text, bins, bands, width))
    reps = rows.groupBy("same").agg(F.min(F.struct("k", "sig", "bands")).alias("m")).select("same", "m.*")
    reps = checkpointed(reps)
    equal = rows.select("k", "same").join(reps.select(F.col("k").alias("a"), "same"), "same").where("k <> a").select("a", F.col("k").alias("b"))
    sigs = reps.select("k", "sig")
    near = (
        star_edges(reps.select("k", "bands"))
        .join(sigs.select(F.col("k").alias("a"), F.col("sig").alias("x")), "a")
        .join(sigs.select(F.col("k").alias("b"), F.col("sig").alias("y")), "b")
        .where(agreement("x", "y") >= similarity)
        .select("a", "b")
    )
    groups = components(equal.unionByName(near))
    forget(rows)
    forget(reps)
    return groups.where("k <> root").select(F.col("k").alias(key), F.col("root").alias(f"kept_{key}"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows, with all their columns, less the copies that ``duplicates`` finds.

    Of rows that repeat a key, the one whose text sorts first stays; only if a key repeats, which a
    count of the keys tells, are rows grouped for that. Rows whose key is null or no whole number,
    or whose text is null or empty, stay. An empty table gives an empty one.
    """
    n = unused(docs, "n")
    own = quoted(key).try_cast("long")
    copies = duplicates(docs, key, text, **how).select(quoted(key).alias(n))
    rest = docs.join(copies, own == F.col(n), "left_anti")
    if docs.select(own.alias("k")).where("k is not null").groupBy("k").count().where("count > 1").limit(1).count():
        first = F.row_number().over(Window.partitionBy(own, F.when(own.isNull(), F.xxhash64(quoted(text).cast("string")))).orderBy(quoted(text)))
        rest = rest.withColumn(n, first).where((F.col(n) == 1) | own.isNull())
    return rest.select(*[quoted(c) for c in docs.columns])
