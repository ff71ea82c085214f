"""Mixing sources to target weights by Sainte-Lague apportionment.

Documents are hashed into shards. In each shard a source's documents, in a seeded order, are cut
into blocks of equal numbers of tokens. Seats, one a block, go to the sources with the highest
quotients weight / (2 k - 1), so each shard has whole quotas; a source that has run out gets no more.
Which of its blocks fill a source's quota is a seeded choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import checkpointed, quoted, unused

SEED = "mix-1"
BLOCK_TOKENS = 32_768
SHARD_TOKENS = 16_000_000
#: Share of a shard's blocks that are chosen.
KEEP = 0.75
NO_SOURCE = "(none)"
TOKEN = r"[^ \t\n\r]+"


def tokens(text: Column) -> Column:
    """Runs of anything but blanks, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def draw(*parts: Column | str) -> Column:
    """32 hexadecimal digits that depend on the parts."""
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def choose(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = SEED,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    keep: float = KEEP,
) -> DataFrame:
    """The chosen documents: key, source, n_tokens, shard, block and its source's quota there.

    ``weights``: of the sources; by default the square root of a source's tokens, which moves the
    mix half the way (on a log scale) to equal shares. A source without a weight, or with none above
    0, is never chosen. A document that begins in a block belongs to it whole, so blocks are equal
    within a document; one longer than a block makes a block alone.

    Rows that repeat a key are one document, with the greatest of their sources and token counts. A
    null source is '(none)'. Rows whose key is null or no whole number, or without a token, can't be chosen. An empty
    table gives an empty one. Ties of quotients go to the source that sorts first. Other columns are
    not read. The token counts, one narrow row a document, are checkpointed; the driver gets one row.
    """
    counts = (
        docs.select(quoted(key).try_cast("long").alias("k"), F.coalesce(quoted(source).cast("string"), F.lit(NO_SOURCE)).alias("s"), tokens(quoted(text).cast("string")).alias("n"))
        .where(F.col("k").isNotNull() & (F.col("n") > 0))
        .groupBy("k")
        .agg(F.max("s").alias("s"), F.max("n").alias("n"))
    )
    counts = checkpointed(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    h = draw(seed, F.col("k"))
    placed = counts.select("k", "s", "n", h.alias("h"), F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(shards)).alias("shard"))
    order = Window.partitionBy("shard", "s").orderBy("h", "k")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = placed.withColumn("cut", F.floor(F.coalesce(before, F.lit(0)) / F.lit(block_tokens)))
    blocks = cut.select("k", "s", "n", "shard", F.dense_rank().over(Window.partitionBy("shard", "s").orderBy("cut")).alias("block"))

    if weights is None:
        by_source = counts.groupBy("s").agg(F.sqrt(F.sum("n")).alias("w"))
    else:
        by_source = docs.sparkSession.createDataFrame([(a, float(b)) for a, b in weights.items()], "s string, w double")
    held = blocks.groupBy("shard", "s").agg(F.max("block").alias("held"))
    seats = (
        held.withColumn("seats", F.greatest(F.lit(1), F.floor(F.sum("held").over(Window.partitionBy("shard")) * F.lit(keep))))
        .join(by_source.where("w > 0"), "s")
        .select("shard", "s", "seats", "w", F.explode(F.sequence(F.lit(1), F.col("held"))).alias("i"))
        .withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc(F.col("w") / (2 * F.col("i") - 1)), "s")))
        .where("r <= seats")
    )
    quotas = seats.groupBy("shard", "s").agg(F.count("*").alias("quota"))
    chosen = (
        held.join(quotas, ["shard", "s"])
        .select("shard", "s", "quota", F.explode(F.sequence(F.lit(1), F.col("held"))).alias("block"))
        .withColumn("r", F.row_number().over(Window.partitionBy("shard", "s").orderBy(draw(seed, F.col("shard"), F.col("s"), F.col("block")), "block")))
        .where("r <= quota")
    )
    return blocks.join(chosen, ["shard", "s", "block"]).select(
        F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias("n_tokens"), F.col("shard").cast("long").alias("shard"), F.col("block").cast("long").alias("block"), F.col("quota").cast("long").alias("quota")
    )


def keep_chosen(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows, with all their columns, whose document is chosen."""
    n = unused(docs, "k")
    picked = choose(docs, key=key, **how).select(quoted(key).alias(n))
    return docs.join(picked, quoted(key).try_cast("long") == F.col(n), "left_semi").select(*[quoted(c) for c in docs.columns])


def sql(table: str = "documents", seed: str = SEED, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, keep: float = KEEP) -> str:
    """The same in DuckDB's SQL, with the default weights."""
    return f"""
WITH counts AS (
  SELECT doc_id AS k, max(coalesce(source, '{NO_SOURCE}')) AS s, max(len(regexp_extract_all(text, '{TOKEN}'))) AS n
  FROM {table} WHERE doc_id IS NOT NULL AND text IS NOT NULL AND regexp_matches(text, '{TOKEN}') GROUP BY doc_id),
shards AS (SELECT greatest(1, CAST(ceil(sum(n) / {shard_tokens}.0) AS BIGINT)) AS shards FROM counts),
placed AS (
  SELECT k, s, n, md5('{seed}|' || k) AS h, CAST('0x' || substr(md5('{seed}|' || k), 1, 8) AS BIGINT) % shards AS shard FROM counts, shards),
cut AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY shard, s ORDER BY h, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {block_tokens} AS cut FROM placed),
blocks AS (SELECT k, s, n, shard, dense_rank() OVER (PARTITION BY shard, s ORDER BY cut) AS block FROM cut),
weights AS (SELECT s, sqrt(sum(n)) AS w FROM counts GROUP BY s),
held AS (SELECT shard, s, max(block) AS held FROM blocks GROUP BY shard, s),
seated AS (SELECT *, greatest(1, floor(sum(held) OVER (PARTITION BY shard) * {keep})) AS seats FROM held),
quotients AS (
  SELECT shard, s, seats, row_number() OVER (PARTITION BY shard ORDER BY w / (2 * i - 1) DESC, s) AS r
  FROM (SELECT shard, seated.s, seats, w, unnest(range(1, held + 1)) AS i FROM seated JOIN weights USING (s))),
quotas AS (SELECT shard, s, count(*) AS quota FROM quotients WHERE r <= seats GROUP BY shard, s),
ranked AS (
  SELECT shard, s, quota, block, row_number() OVER (PARTITION BY shard, s ORDER BY md5('{seed}|' || shard || '|' || s || '|' || block), block) AS r
  FROM (SELECT shard, held.s, quota, unnest(range(1, held + 1)) AS block FROM held JOIN quotas USING (shard, s)))
SELECT k AS doc_id, s AS source, CAST(n AS BIGINT) AS n_tokens, CAST(shard AS BIGINT) AS shard, CAST(block AS BIGINT) AS block, CAST(quota AS BIGINT) AS quota
FROM blocks JOIN (SELECT * FROM ranked WHERE r <= quota) USING (shard, s, block)"""
