"""Helpers shared by the training-data operators.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step of a Python worker handles.
STEP_BYTES = 1_500_000


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def narrow(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key (as LONG ``k``) and the text (as STRING ``t``), so that other columns can't clash. A key that
    is no whole number, such as a word, counts as null."""
    return df.select(quoted(key).try_cast("long").alias("k"), quoted(text).cast("string").alias("t"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in which the session's checkpoints go: its ``spark.checkpoint.dir``.

    Where none is set, as in tests on one machine, a temporary one is made; on a cluster that is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="attesta-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder of the session."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a checkpointed frame that a later checkpoint has made needless."""
    jvm = df.sparkSession.sparkContext._jvm
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(rows: DataFrame, key: str, most: int, seed: int, n: int | None = None) -> DataFrame:
    """At most ``most`` rows, those whose keys hash lowest. A cut at four times their share of all rows
    comes first, so what is sorted, and sent to the driver, doesn't grow with the table."""
    h = F.xxhash64(key, F.lit(seed))
    n = rows.count() if n is None else n
    if n > 4 * most:
        rows = rows.where(F.pmod(h, F.lit(1 << 32)) < F.lit(int(4 * most / n * (1 << 32))))
    return rows.orderBy(h, key).limit(most)


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows``, its size known from a parameter or a count, allows."""
    return F.broadcast(df) if rows <= most else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- vectorised words of an Arrow string array

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_powers = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n and those of its inverse, modulo 2**64."""
    if _powers["n"] < n + 1:
        m = max(n + 1, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
        _powers["n"] = m
    return _powers["up"], _powers["down"]


def _word_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[128:] = True
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        t[ord(a) : ord(b) + 1] = True
    return t


WORD_BYTE = _word_table()
NOT_SPACE_BYTE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the UTF-8 bytes of a string array; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return offsets - first, data[first:last]


def steps(array: pa.Array, most: int = STEP_BYTES):
    """(first row, slice) of an array, each slice of about ``most`` bytes and of one row at least."""
    if not len(array):
        return
    offsets, _ = buffers(array)
    at = 0
    while at < len(array):
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(len(array), max(at + 1, end))
        yield at, array.slice(at, end - at)
        at = end


def spans(offsets: np.ndarray, data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each maximal run of member bytes; no run crosses a row's end."""
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e
    inside = member[data]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    rows = offsets[:-1]
    rows = rows[(rows < n) & (np.diff(offsets) > 0)]
    head[rows] = inside[rows]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    tail[ends] = inside[ends]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums P such that the hash of data[s:e] is (P[e] - P[s]) * down[s]."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _GOLD)


def word_hashes(array: pa.Array, member: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each lower-cased word, in order."""
    offsets, data = buffers(pc.utf8_lower(array.cast(pa.large_string())))
    row, start, end = spans(offsets, data, member)
    return row, span_hashes(prefix_hashes(data), start, end)
