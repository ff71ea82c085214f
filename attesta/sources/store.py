"""The record store as Parquet tables partitioned by workspace: scans, appends and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import keys
from attesta.schemas import TABLES


def scan(spark: SparkSession, folder: str, table: str, workspace: str | None = None) -> DataFrame:
    """A table's rows, of one workspace if given: the filter prunes partitions."""
    df = spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}")
    return df if workspace is None else df.where(F.col("workspace_id") == workspace)


def lookup(df: DataFrame, column: str, value: str) -> DataFrame:
    """The first row of a key, in the order of ``_seq``."""
    return df.where(F.col(column) == value).orderBy("_seq").limit(1)


def append(df: DataFrame, folder: str, table: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy("workspace_id") if "workspace_id" in df.columns else writer).parquet(f"{folder}/{table}")


def latest(df: DataFrame, by: list[str], order: str = "_seq") -> DataFrame:
    """One row a key, each field as last given: later rows patch earlier ones, nulls patch nothing."""
    rest = [c for c in df.columns if c not in by]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    return df.groupBy(*by).agg(*last).select(*df.columns)


def upserted_companies(rows: DataFrame) -> DataFrame:
    """Companies by (workspace, registrable domain); rows without one go."""
    df = rows.withColumn("domain", keys.normalize_domain(F.col("domain"))).where("domain <> ''")
    return latest(df, ["workspace_id", "domain"])


def upserted_pages(rows: DataFrame) -> DataFrame:
    df = rows.withColumn("url", keys.normalize_url(F.col("url"))).withColumn("company_domain", keys.normalize_domain(F.col("company_domain"))).where("url <> ''")
    return latest(df, ["workspace_id", "url"])


def domains(urls: Column) -> Column:
    """Registrable domains of an array of URLs, without empty ones."""
    return F.filter(F.transform(urls, keys.normalize_domain), lambda d: d != "")


def measurements_to_store(rows: DataFrame) -> DataFrame:
    """Keys normalised on the way in; the raw URLs stay beside their domains."""
    return rows.withColumn("page_url", keys.normalize_url(F.col("page_url"))).withColumn("source_domains", domains(F.col("source_urls")))


def experiments_to_store(rows: DataFrame) -> DataFrame:
    pairs = F.transform("pairs", lambda p: F.struct(keys.normalize_url(p["treatment_page"]).alias("treatment_page"), keys.normalize_url(p["control_page"]).alias("control_page"), p["match_covars"].alias("match_covars")))
    return rows.withColumn("pairs", pairs)


def workspaces_to_store(rows: DataFrame) -> DataFrame:
    """Own domain normalised; competitors normalised, once each, without empty ones and oneself."""
    own = keys.normalize_domain(F.col("own_domain"))
    rivals = F.array_except(F.transform("competitor_domains", keys.normalize_domain), F.array(F.lit(""), own))  # once each
    return rows.withColumn("competitor_domains", rivals).withColumn("own_domain", own)


def owned(workspaces: DataFrame, owner: str | None) -> DataFrame:
    """All workspaces, or an authenticated owner's."""
    return workspaces if owner is None else workspaces.where(F.col("owner") == owner)


def first_seen(df: DataFrame, by: list[str] | list[Column], order: str = "_seq") -> DataFrame:
    """The first row of each key."""
    line = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_line", F.row_number().over(line)).where("_line = 1").drop("_line")


def summary(**tables: DataFrame) -> DataFrame:
    """(table, n_rows) of each table given."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
