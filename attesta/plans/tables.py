"""Citation records projected from the general tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from attesta.schemas import OFFPAGE_FIELDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as runs: ten queries, five engines, three pages."""
    e = table(spark, sf_dir, "events")
    q, page = F.col("user_id") % 10, F.floor(F.col("user_id") / 10) % 3
    d = e.select(
        F.concat(F.lit("q"), q.cast("string")).alias("query_id"), F.concat(F.lit("https://site"), page.cast("string"), F.lit(".com/p")).alias("page_url"),
        F.col("event_type").alias("engine"), F.concat(F.lit("m"), (F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int") % 3).cast("string")).alias("model_version"),
        (F.col("value") > F.when(q % 2 == 0, 300).otherwise(35)).alias("cited"), (F.col("event_id") % 3 == 0).alias("named"), (F.col("event_id") % 5 + 1).cast("int").alias("position"),
        F.array(F.concat(F.lit("src"), (F.col("event_id") % 7).cast("string"), F.lit(".com"))).alias("source_domains"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("_seq"), F.col("user_id"),
    )
    line = Window.partitionBy("query_id", "engine", "page_url").orderBy("ts", "_seq")
    d = d.withColumn("run_idx", (F.row_number().over(line) - 1).cast("int"))
    return d.withColumn("position", F.when(F.col("cited"), F.col("position"))).withColumn("appeared", F.col("cited") | F.col("named")).withColumn("window_tag", F.when(F.dayofmonth("ts") <= 15, "baseline").otherwise("post"))


RUNS = """raw_runs AS (
  SELECT 'q' || (user_id % 10) AS query_id, 'https://site' || ((user_id // 10) % 3) || '.com/p' AS page_url, event_type AS engine,
    'm' || (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) % 3) AS model_version,
    value > CASE WHEN user_id % 2 = 0 THEN 300 ELSE 35 END AS cited, event_id % 3 = 0 AS named, CAST(event_id % 5 + 1 AS INT) AS pos,
    'src' || (event_id % 7) || '.com' AS source_domain, ts, event_id AS _seq, user_id FROM events),
runs AS (
  SELECT *, CASE WHEN cited THEN pos END AS position, cited OR named AS appeared, CASE WHEN day(ts) <= 15 THEN 'baseline' ELSE 'post' END AS window_tag,
    row_number() OVER (PARTITION BY query_id, engine, page_url ORDER BY ts, _seq) - 1 AS run_idx FROM raw_runs)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as companies, some with gaps."""
    n = F.col("n_nationkey")
    some = lambda k, v: F.when(n % k != 0, v)
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("site"), n.cast("string"), F.lit(".com")).alias("domain"), F.col("n_name").alias("name"),
        F.struct(some(3, F.lit("small")).alias("size"), F.lit(None).cast("string").alias("funding_stage"), some(3, n / 10.0).alias("headcount_growth"), F.lit(None).cast("double").alias("hiring_velocity"), F.array().cast("array<string>").alias("tech_stack")).alias("firmographics"),
        F.struct(*[(some(4, (n * (i + 1) % 11).cast("double")) if i < 6 else F.lit(None).cast("double")).alias(f) for i, f in enumerate(OFFPAGE_FIELDS)]).alias("offpage"),
        F.struct(F.concat(F.lit("cat"), (n % 2).cast("string")).alias("category"), some(5, F.lit("icp")).alias("icp"), F.lit("").alias("positioning"), F.lit("x").alias("what_you_are")).alias("understanding"),
        F.array(F.lit("offpage_missing")).alias("coverage_flags"), n.cast("long").alias("_seq"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as pages with content features."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("HTTPS://www.site"), n.cast("string"), F.lit(".com/p/?utm_source=x")).alias("url"), F.concat(F.lit("www.site"), n.cast("string"), F.lit(".com")).alias("company_domain"),
        F.struct(
            (n % 2 == 0).alias("schema_markup"), (n % 3 == 0).alias("comparison_table"), (n * 37 % 500).cast("double").alias("word_count"), (n % 4).cast("double").alias("heading_structure"),
            (n % 9).cast("double").alias("freshness_days"), (n % 5 / 5.0).alias("query_term_coverage"), F.when(n % 6 != 0, n % 2 == 1).alias("direct_answer_first"),
            (n % 7).cast("double").alias("stats_density"), (n % 3).cast("double").alias("citation_density"), F.lit(1.0).alias("quote_density"), (n % 3 / 2.0).alias("listicle_vs_prose"),
        ).alias("content_features"),
        n.cast("long").alias("_seq"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rates of twenty-five pages, each tested with a few queries."""
    from attesta.operators.measure import aggregate_runs

    wide = runs(spark, sf_dir).withColumn("page_url", F.concat(F.lit("https://site"), (F.col("user_id") % 25).cast("string"), F.lit(".com/p")))
    g = aggregate_runs(wide)
    return g.withColumn("cited", F.col("cited_count") > 0).withColumn("appeared", F.col("k") > 2).withColumn("window_tag", F.lit("baseline"))


def wide_runs_sql() -> str:
    from attesta.functions.stats import sql_wilson

    low, high = sql_wilson("c", "k")
    return RUNS + f""",
wide AS (SELECT query_id, 'https://site' || (user_id % 25) || '.com/p' AS page_url, user_id % 25 AS n, engine, cited FROM runs),
counted AS (SELECT query_id, page_url, n, engine, CAST(count(*) AS DOUBLE) AS k, CAST(sum(CAST(cited AS INT)) AS DOUBLE) AS c FROM wide GROUP BY ALL),
measurements AS (SELECT *, c / k AS p_cited, {low} AS ci_low, {high} AS ci_high FROM counted)"""
