"""Quality rules by compression bands.

zstandard's ratio (bytes before over bytes after) is taken over the whole document and over each
fixed chunk of it. Text that repeats itself compresses too well, random or encoded bytes hardly at
all. What is normal depends on the length, so every length class has its own limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import narrow, quoted, unused

#: (bytes from, lowest ratio, highest ratio). The class of a text is the last whose start it reaches.
BANDS = (
    (0, 0.0, 2.5),
    (256, 0.95, 2.8),
    (512, 1.05, 3.0),
    (1024, 1.15, 3.2),
    (2048, 1.2, 3.4),
    (4096, 1.3, 3.6),
    (16384, 1.35, 4.0),
    (65536, 1.4, 4.5),
    (262144, 1.4, 6.0),
)
CHUNK_BYTES = 4096
#: Largest share of a document's bytes that may lie in chunks outside their band.
CHUNK_SHARE = 0.34
LEVEL = 3

VERDICT = pa.struct(
    [
        ("n_bytes", pa.int64()),
        ("ratio", pa.float64()),
        ("lowest_chunk_ratio", pa.float64()),
        ("highest_chunk_ratio", pa.float64()),
        ("bad_chunk_share", pa.float64()),
        ("reason", pa.string()),
    ]
)
SCHEMA = "n_bytes long, ratio double, lowest_chunk_ratio double, highest_chunk_ratio double, bad_chunk_share double, reason string"


def limits(n: int, bands=BANDS) -> tuple[float, float]:
    """(lowest, highest) ratio for a text of n bytes."""
    low, high = bands[0][1:]
    for start, a, b in bands:
        if n >= start:
            low, high = a, b
    return low, high


def judge(data: bytes | None, compress, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE) -> tuple:
    """The verdict's fields for one text's UTF-8 bytes; the first rule that it breaks is the reason."""
    if data is None:
        return None, None, None, None, None, "null"
    n = len(data)
    if not data.strip():
        return n, None, None, None, None, "empty"
    ratio = n / len(compress(data))
    low, high = limits(n, bands)
    if n <= chunk_bytes:
        chunks = [(n, ratio)]
    else:
        parts = [data[i : i + chunk_bytes] for i in range(0, n, chunk_bytes)]
        chunks = [(len(p), len(p) / len(compress(p))) for p in parts]
    below = above = 0
    for size, r in chunks:
        a, b = limits(size, bands)
        below += size * (r < a)
        above += size * (r > b)
    ratios = [r for _, r in chunks]
    share = (below + above) / n
    if ratio > high:
        reason = "repetitive"
    elif ratio < low:
        reason = "incompressible"
    elif share > chunk_share:
        reason = "repetitive_chunks" if above >= below else "incompressible_chunks"
    else:
        reason = "ok"
    return n, ratio, min(ratios), max(ratios), share, reason


def verdict(text: Column, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE, level: int = LEVEL) -> Column:
    """A struct column with the verdict on each text."""

    @F.arrow_udf(SCHEMA)
    def of(texts: pa.Array) -> pa.Array:
        compress = zstandard.ZstdCompressor(level=level).compress
        rows = [judge(None if x is None else x, compress, bands, chunk_bytes, chunk_share) for x in texts.cast(pa.binary()).to_pylist()]
        columns = list(zip(*rows)) if rows else [[] for _ in VERDICT]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, VERDICT)], fields=list(VERDICT))

    return of(text.cast("string"))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row for each input row: its key, the ratios and ``reason`` ('ok' if it passes).

    A null text has reason 'null' and one that is empty or only white space 'empty', both without
    ratios. A null key stays null. Repeated rows are judged one by one. The whole text counts,
    however long. An empty table gives an empty one; other columns are not read.
    """
    v = narrow(docs, key, text).select(F.col("k").alias(key), verdict(F.col("t"), **limits).alias("v"))
    return v.select(key, "v.*")


def keep(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows that pass, with all their columns; null and blank texts go."""
    name = unused(docs, "reason")
    return docs.withColumn(name, verdict(quoted(text), **limits)["reason"]).where(F.col(name) == "ok").drop(name)
