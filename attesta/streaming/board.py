"""Run rates and the citation board over a stream of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.functions import stats

RUN = "query_id string, page_url string, engine string, model_version string, run_idx int, cited boolean, position int, source_domains array<string>, ts timestamp, _seq long"


def read_runs(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of runs as they land."""
    return spark.readStream.schema(RUN).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def rates(stream: DataFrame) -> DataFrame:
    """Counts, rate and interval of each run group so far; for update or complete mode."""
    g = stream.groupBy("query_id", "page_url", "engine").agg(F.count("*").alias("k"), F.count_if("cited").alias("cited_count"), F.max_by("model_version", "_seq").alias("model_version"))
    ci = stats.wilson(F.col("cited_count"), F.col("k"))
    return g.withColumn("p_cited", stats.rate(F.col("cited_count"), F.col("k"))).withColumn("ci_low", ci["low"]).withColumn("ci_high", ci["high"])


def board(stream: DataFrame) -> DataFrame:
    """Cited, total and source domains of cited runs by engine so far."""
    first = F.posexplode_outer(F.when(F.col("cited"), F.col("source_domains"))).alias("i", "source")
    one = stream.select("engine", "cited", first)
    head = F.coalesce(F.col("i"), F.lit(0)) == 0  # a run counts once, each of its sources is a member
    return one.groupBy("engine").agg(F.count_if(head & F.col("cited")).alias("cited"), F.count_if(head).alias("total"), F.array_sort(F.collect_set("source")).alias("sources"))


def sides(stream: DataFrame, own: str, competitors: list[str]) -> DataFrame:
    """Cited and total by engine and side ('you' or a competitor's domain) so far; the sides merge by adding."""
    from attesta.functions import keys

    d = keys.normalize_domain(F.col("page_url"))
    side = F.when(d == keys.normalize_domain(F.lit(own)), "you").when(F.array_contains(F.array(*[F.lit(c) for c in competitors]).cast("array<string>"), d), d)
    return stream.withColumn("side", side).where("side is not null").groupBy("engine", "side").agg(F.count_if("cited").alias("cited"), F.count("*").alias("total"))


def iso_week(start) -> object:
    """'2025-W01' of the Monday that a week starts on: the year is its Thursday's."""
    return F.format_string("%d-W%02d", F.year(F.date_add(start.cast("date"), 3)), F.weekofyear(start))


def weekly(stream: DataFrame, late: str = "14 days") -> DataFrame:
    """Runs and cited runs of each engine by ISO week; weeks close when the watermark has passed them."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(week.alias("week"), "engine").agg(F.count("*").alias("n"), F.count_if("cited").alias("n_cited"))


def write(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now to Parquet, exactly once; the checkpoint lets a later call go on from here."""
    if mode == "append":
        return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
