"""Line dedup by content-defined units of lines.

A unit is a line, with the blank lines after it; a long line is cut into pieces where a word's hash is
the least of its neighbourhood, so cuts depend on nearby words only and come back in step after an
insertion. The hash of every two adjacent units rolls over the text. Where such a pair occurs anywhere
before, byte for byte, both its units are marked; a stretch of marked units that holds enough words is
removed. The first occurrence of every unit, by key and place, stays. A document most of whose words go
because other documents have them is a copy with edits; what would be left are fragments, so it goes whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import NOT_SPACE_BYTE, buffers, narrow, prefix_hashes, quoted, span_hashes, spans, steps

#: A line is cut after a word whose hash is less than those of so many words on either side.
WINDOW = 3
#: A piece of a line ends after so many words at the latest.
MOST_WORDS = 32
#: A stretch of repeated units with fewer words in all stays: short lines and phrases recur in any prose.
LEAST_WORDS = 16
#: A document goes if more than this share of its words is removed as another document's.
MOST_COPIED = 0.5


def chunks(array: pa.Array, window: int = WINDOW, most: int = MOST_WORDS):
    """Per unit: row, number in its row, words, byte span, end without blanks, and a 64-bit hash; then the bytes."""
    offsets, data = buffers(array)
    sums = prefix_hashes(data) if len(data) else np.zeros(1, np.uint64)
    row, start, end = spans(offsets, data, NOT_SPACE_BYTE)
    n = len(row)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(n, bool)
    opens[1:] = (row[1:] != row[:-1]) | (feeds[start[1:]] != feeds[start[:-1]])
    line = np.cumsum(opens) - 1
    least = np.zeros(n, bool)
    if n > 2 * window:
        h, mid = span_hashes(sums, start, end), slice(window, n - window)
        least[mid] = line[: n - 2 * window] == line[2 * window :]
        for j in range(1, window + 1):
            least[mid] &= (h[mid] < h[window - j : n - window - j]) & (h[mid] < h[window + j : n - window + j])
    cut = opens.copy()
    cut[1:] |= least[:-1]
    first = np.flatnonzero(cut)
    end_of = np.append(first[1:], n)
    for j in np.flatnonzero(end_of - first > most):
        cut[first[j] : end_of[j] : most] = True
    first = np.flatnonzero(cut)
    # a line's first unit has the blanks before it, a row's first one all that stands before
    line_start = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    head = np.where(opens[first], np.maximum(line_start[feeds[start[first]]], offsets[row[first]]), start[first]) if n else first
    lead = np.ones(len(first), bool)
    lead[1:] = row[first[1:]] != row[first[:-1]]
    head[lead] = offsets[row[first[lead]]]
    words = np.diff(np.append(first, n))
    bare = end[np.append(first[1:], n) - 1] if n else first
    urow = row[first]
    blank = np.setdiff1d(np.flatnonzero(np.diff(offsets) > 0), urow)
    urow, head, bare = np.concatenate([urow, blank]), np.concatenate([head, offsets[blank]]), np.concatenate([bare, offsets[blank]])
    words = np.concatenate([words, np.zeros(len(blank), np.int64)])
    order = np.argsort(urow, kind="stable")
    urow, head, bare, words = urow[order], head[order], bare[order], words[order]
    stop = np.append(head[1:], len(data)) if len(head) else head
    number = np.arange(len(urow)) - np.searchsorted(urow, urow, side="left")
    return urow, number, words, head, stop, bare, span_hashes(sums, head, bare), data


def _hashed(batches, how: dict, bits: int):
    """The hash, of so many bits, of every two adjacent units, with the number of the first."""
    schema = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("i", pa.int32())])
    for batch in batches:
        for at, texts in steps(batch.column(1)):
            row, number, _, s, _, bare, _, data = chunks(texts, **how)
            two = np.flatnonzero(row[1:] == row[:-1])
            h = span_hashes(prefix_hashes(data), s[two], bare[two + 1]) if len(two) else np.empty(0, np.uint64)
            h = h >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row[two] + at)), pa.array(number[two].astype(np.int32))], schema=schema)


def _runs(batches):
    """Runs of repeated pairs whose first occurrences stand in a row too: their first unit and how many units."""
    for batch in batches:
        pairs = batch.column(1)
        flat = pairs.flatten()
        i, k0, i0 = (flat.field(j).to_numpy() for j in range(3))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(pairs.offsets)))
        new = np.ones(len(i), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (i[1:] != i[:-1] + 1) | (k0[1:] != k0[:-1]) | (i0[1:] != i0[:-1] + 1)
        at = np.flatnonzero(new)
        m = np.diff(np.append(at, len(i))) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[at])), pa.array(i[at]), pa.array(m.astype(np.int32)), pa.array(k0[at]), pa.array(i0[at])], names=["k", "i", "m", "k0", "i0"])


def _texts(batches, field: str, how: dict):
    """The bytes of the runs asked for."""
    schema = pa.schema([("k", pa.int64()), ("i", pa.int32()), ("m", pa.int32()), ("k0", pa.int64()), ("i0", pa.int32()), ("chunk", pa.binary())])
    for batch in batches:
        for at, texts in steps(batch.column(1).field(field).cast(pa.string())):
            row, _, _, s, _, bare, _, data = chunks(texts, **how)
            want = batch.column(2).slice(at, len(texts))
            flat = want.flatten()
            i, m, k0, i0 = (flat.field(j).to_numpy() for j in range(4))
            doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(want.offsets)))
            first = np.searchsorted(row, doc, side="left") + i
            ok = np.flatnonzero(first + m <= np.searchsorted(row, doc, side="right"))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc[ok] + at)), *(pa.array(x[ok]) for x in (i, m, k0, i0)), pa.array([raw[s[a] : bare[b]] for a, b in zip(first[ok], (first + m - 1)[ok])], pa.binary())], schema=schema
            )


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """(k, d): the key and the whole row, in one exchange that both joins to the text use."""
    return docs.where(quoted(key).try_cast("long").isNotNull()).select(quoted(key).try_cast("long").alias("k"), F.struct(*[quoted(c) for c in docs.columns]).alias("d")).repartition("k")


def repeated(docs: DataFrame, keyed: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64, **how) -> DataFrame:
    """(k, gone): each document with repeated units, as runs (first unit, units, whether they stand first in another document).

    Hashes alone find the pairs of units that occur more than once; only their bytes, each run of
    them once, are then sent to be compared with the first occurrence's.
    """
    rows = narrow(docs, key, text).where("k is not null and t is not null")
    same = Window.partitionBy("h").orderBy("k", "i")
    pairs = rows.mapInArrow(lambda b: _hashed(b, how, bits), "h long, k long, i int").select("k", "i", F.first("k").over(same).alias("k0"), F.first("i").over(same).alias("i0"))
    later = pairs.where("k != k0 or i != i0").groupBy("k").agg(F.array_sort(F.collect_set(F.struct("i", "k0", "i0"))).alias("pairs"))
    runs = later.mapInArrow(_runs, "k long, i int, m int, k0 long, i0 int")
    ask = F.explode(F.array(F.struct("k", "i", "m", "k0", "i0"), F.struct(F.col("k0").alias("k"), F.col("i0").alias("i"), "m", "k0", "i0")))
    asked = runs.select(ask.alias("a")).select("a.*").groupBy("k").agg(F.collect_set(F.struct("i", "m", "k0", "i0")).alias("wanted"))
    sent = keyed.join(asked, "k").select("k", "d", "wanted").mapInArrow(lambda b: _texts(b, text, how), "k long, i int, m int, k0 long, i0 int, chunk binary")
    lead = sent.where("k = k0 and i = i0").select("k0", "i0", "m", F.col("chunk").alias("c0"))
    gone = sent.where("k != k0 or i != i0").join(lead, ["k0", "i0", "m"]).where(F.col("chunk") == F.col("c0"))
    return gone.groupBy("k").agg(F.collect_set(F.struct("i", "m", (F.col("k") != F.col("k0")).alias("far"))).alias("gone"))


def without(text: pa.Array, gone: pa.Array, least: int = LEAST_WORDS, copied: float = MOST_COPIED, **how) -> pa.Array:
    """Each text without the runs of units listed, where they add up to stretches of ``least`` words; '' if more than the
    share ``copied`` of its words goes as another document's; null stays null."""
    out: list = []
    for at, texts in steps(text):
        lists = gone.slice(at, len(texts)).to_pylist()
        row, _, words, s, e, _, _, data = chunks(texts, **how)
        edges = np.searchsorted(row, np.arange(len(texts) + 1))
        raw = data.tobytes()
        for r, x in enumerate(texts):
            lo, hi = edges[r], edges[r + 1]
            drop, far = np.zeros(hi - lo + 2, bool), np.zeros(hi - lo + 2, bool)  # with a kept unit at either end
            for g in lists[r] or ():
                drop[g["i"] + 1 : g["i"] + g["m"] + 1] = True
                far[g["i"] + 1 : g["i"] + g["m"] + 1] |= g["far"]
            drop[-1] = False
            change = np.flatnonzero(np.diff(drop))
            held = np.concatenate([[0], np.cumsum(words[lo:hi])])
            for a, b in zip(change[::2], change[1::2]):
                if held[b] - held[a] < least:
                    drop[a + 1 : b + 1] = False
            if not drop.any():
                out.append(x.as_py())
                continue
            if words[lo:hi][(drop & far)[1:-1]].sum() > copied * words[lo:hi].sum():
                out.append("")
                continue
            kept: list[bytes] = []
            for u, off in zip(range(lo, hi), drop[1:-1].tolist()):
                part = raw[s[u] : e[u]]
                if not off:
                    kept.append(part)
                elif kept and not kept[-1].endswith(b"\n") and part.endswith(b"\n"):  # the rest of its line stays
                    kept[-1] = kept[-1].rstrip() + b"\n"
            rest = b"".join(kept).decode()
            out.append(rest.rstrip() if rest and not x.as_py()[-1].isspace() else rest)
    return pa.array(out, pa.string())


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = None, least: int = LEAST_WORDS, bits: int = 64, **how) -> DataFrame:
    """The rows, with all their columns, without stretches of ``least`` words and more whose units each occur before
    beside the same unit; emptied documents, and those more than half of which other documents have, go.

    ``n_chars`` names a column that is set to the new length where the text changes. Rows with a null
    text, or a key that is null or no whole number, stay as they are, and so do empty texts. Rows
    that repeat a key and text are one document; where texts differ, each loses the units removed
    from any of them. Whole texts count. An empty table gives an empty one. Hashes of ``bits`` bits
    only propose; what goes is equal byte for byte to what stays.
    """
    keyed = _keyed(docs, key)
    lists = repeated(docs, keyed, key, text, bits, **how)

    @F.arrow_udf("string")
    def rest(t: pa.Array, g: pa.Array) -> pa.Array:
        return without(t, g, least, **how)

    joined = keyed.join(lists, "k", "left").select("d", "gone")
    listed = F.col("gone").isNotNull()
    was = F.col("d").getField(text)
    joined = joined.withColumn("new", F.when(listed, rest(F.when(listed, was.cast("string")), F.col("gone"))).otherwise(was))
    changed = listed & ~F.col("new").eqNullSafe(was.cast("string"))
    joined = joined.where(~changed | (F.length(F.trim(F.col("new"))) > 0))
    columns = []
    for c in docs.columns:
        own = F.col("d").getField(c)
        if c == text:
            columns.append(F.col("new").alias(c))
        elif c == n_chars:
            columns.append(F.when(changed, F.length(F.col("new")).cast(docs.schema[c].dataType)).otherwise(own).alias(c))
        else:
            columns.append(own.alias(c))
    return joined.select(*columns).unionByName(docs.where(quoted(key).try_cast("long").isNull()))
