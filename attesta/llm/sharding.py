"""Sharding by fixed virtual slots.

A record's key is hashed into one of a fixed number of slots, so its slot never changes. Bytes are
summed by slot, and a small versioned table maps slots to shards. Rebalancing writes a new version
that differs in the fewest slots it can; no record is hashed again.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import checkpoint_folder, narrow, small

SLOTS = 4096
SHARD_BYTES = 32 * 2**20
TOLERANCE = 0.1
#: Slots that a join may broadcast; the map has one row a slot, whatever the data.
MOST_BROADCAST = 1_000_000


def slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: of its key, or of its text where the key is null."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def slotted(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(k, slot, n_bytes) of each row; a null text has 0 bytes."""
    d = narrow(docs, key, text)
    return d.select("k", slot(F.col("k"), F.col("t"), slots).alias("slot"), F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("n_bytes"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and records of each slot that has any: combined before the shuffle, one row a slot after it."""
    return rows.groupBy("slot").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"))


def initial_map(slots: int, shards: int) -> list[int]:
    """Version 1: runs of neighbouring slots, as even as they go."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(assigned: list[int], sizes: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """An edited copy of a slot-to-shard list whose shards hold at most (1 + tolerance) x their share.

    While a shard is over that, its largest slot that the emptiest shard can take without becoming
    the fuller of the two moves there; a shard none of whose slots can move is left as it is (one
    slot may hold more than a shard's share). ``shards`` may be more than before (new ones start
    empty) or fewer (slots of removed shards move first). Ties go to the lower number.
    """
    out = list(assigned)
    load = [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for s, at in enumerate(out):
        if at < shards:
            load[at] += sizes[s]
            own[at].append(s)
        else:
            homeless.append(s)
    spare = [(b, i) for i, b in enumerate(load)]
    heapq.heapify(spare)
    for s in sorted(homeless, key=lambda s: (-sizes[s], s)):
        b, i = heapq.heappop(spare)
        out[s], load[i] = i, b + sizes[s]
        own[i].append(s)
        heapq.heappush(spare, (load[i], i))
    most = (1 + tolerance) * sum(sizes) / shards
    stuck: set[int] = set()
    while True:
        over = [i for i in range(shards) if load[i] > most and i not in stuck]
        if not over:
            return out
        full = max(over, key=lambda i: (load[i], -i))
        low = min(range(shards), key=lambda i: (load[i], i))
        fits = [s for s in own[full] if 0 < sizes[s] and load[low] + sizes[s] < load[full]]
        if not fits:
            stuck.add(full)
            continue
        s = max(fits, key=lambda s: (sizes[s], -s))
        own[full].remove(s)
        own[low].append(s)
        load[full] -= sizes[s]
        load[low] += sizes[s]
        out[s] = low


def write_map(spark: SparkSession, folder: str, version: int, assigned: list[int]) -> None:
    """Store one version; a version that exists is never overwritten."""
    rows = spark.createDataFrame([(s, i) for s, i in enumerate(assigned)], "slot int, shard int")
    rows.coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("slot int, shard int").parquet(f"{folder}/version={version}")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions stored under ``folder``, in order; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.removeprefix("version=").isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def rebalance(rows: DataFrame, folder: str, slots: int = SLOTS, shard_bytes: int = SHARD_BYTES, tolerance: float = TOLERANCE) -> int:
    """Edits the newest stored map for rows (slot, n_bytes) and stores it as the next version; returns that.

    Where no map is stored, version 1 is laid out evenly first. The number of shards follows the bytes
    and never falls while every shard of the newest map fits. If nothing is to move, nothing is
    written and the newest version is returned. What reaches the driver is one row a slot.
    """
    spark = rows.sparkSession
    sizes = [0] * slots
    for r in slot_bytes(rows).collect():  # at most one row a slot
        sizes[r["slot"]] = r["n_bytes"]
    shards = min(slots, max(1, -(-sum(sizes) // shard_bytes)))
    known = versions(spark, folder)
    if known:
        newest = known[-1]
        now = [r["shard"] for r in read_map(spark, folder, newest).orderBy("slot").collect()]
        if len(now) != slots:
            raise ValueError(f"the stored map has {len(now)} slots, not {slots}; the number of slots never changes")
        shards = max(shards, max(now) + 1)
    else:
        newest, now = 1, initial_map(slots, shards)
        write_map(spark, folder, 1, now)
    after = rebalanced(now, sizes, shards, tolerance)
    if after == now:
        return newest
    write_map(spark, folder, newest + 1, after)
    return newest + 1


def assign(rows: DataFrame, maps: DataFrame, slots: int = SLOTS) -> DataFrame:
    return rows.join(small(maps, slots, MOST_BROADCAST), "slot")


def shard(
    docs: DataFrame,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    slots: int = SLOTS,
    shard_bytes: int = SHARD_BYTES,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Each row's key, slot, shard of the first map and shard of the rebalanced one.

    ``first_shard`` is that of the map before this call's edit, ``shard`` that of the map after it. A
    map stored under ``folder`` (by default a new one in the session's shared folder) is edited, else
    version 1 is laid out evenly. The number of shards follows the bytes. A row whose key is null or
    no whole number goes by its text; repeated keys share a slot; a null text has no bytes; an empty
    table gives an empty one and a map of one shard. Other columns are not read.
    """
    spark = docs.sparkSession
    if folder is None:
        folder = f"{checkpoint_folder(spark)}/slot-maps/{uuid.uuid4().hex}"
    rows = slotted(docs, key, text, slots)
    known = versions(spark, folder)
    version = rebalance(rows, folder, slots, shard_bytes, tolerance)
    first = known[-1] if known else 1
    maps = read_map(spark, folder, version).join(read_map(spark, folder, first).withColumnRenamed("shard", "first_shard"), "slot")
    return assign(rows, maps, slots).select(F.col("k").alias(key), "slot", "n_bytes", "first_shard", "shard", F.lit(version).alias("map_version"))
