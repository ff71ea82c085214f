"""Audited joins: what doesn't join is an output, never lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import keys


def one_per_key(df: DataFrame, key: str, which: str = "first", order: str = "_seq") -> DataFrame:
    """``df`` with one row a key, the first or the last in order, or all of them."""
    if which == "all":
        return df
    line = Window.partitionBy(key).orderBy(F.asc(order) if which == "first" else F.desc(order))
    return df.withColumn("_line", F.row_number().over(line)).where("_line = 1").drop("_line")


def pages_with_companies(pages: DataFrame, companies: DataFrame, on_duplicate: str = "first") -> DataFrame:
    """Every page with its company's columns (c_ before their names); null where there is none.

    pages: company_domain, url. companies: domain, _seq. Keys are registrable domains; an empty key joins nothing.
    """
    c = companies.withColumn("_d", keys.normalize_domain(F.col("domain"))).where("_d <> ''")
    c = one_per_key(c, "_d", on_duplicate)
    c = c.select("_d", *[F.col(x).alias(f"c_{x}") for x in companies.columns])
    return pages.withColumn("_d", keys.normalize_domain(F.col("company_domain"))).join(c, "_d", "left").drop("_d")


def join_report(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """(issue, key) rows: orphan pages, childless companies, each losing duplicate, companies without a key."""
    c = companies.withColumn("_d", keys.normalize_domain(F.col("domain")))
    p = pages.withColumn("_d", keys.normalize_domain(F.col("company_domain")))
    good = c.where("_d <> ''")
    homes = good.select("_d").distinct()
    orphans = p.join(homes, "_d", "left_anti").select(F.lit("orphan_page").alias("issue"), F.col("url").alias("key"))
    childless = homes.join(p.select("_d").distinct(), "_d", "left_anti").select(F.lit("childless_company").alias("issue"), F.col("_d").alias("key"))
    line = Window.partitionBy("_d").orderBy("_seq")
    twice = good.withColumn("_line", F.row_number().over(line)).where("_line > 1").select(F.lit("duplicate_domain").alias("issue"), F.col("_d").alias("key"))
    keyless = c.where("_d = ''").select(F.lit("unjoinable_company").alias("issue"), F.coalesce("domain", F.lit("")).alias("key"))
    return orphans.unionByName(childless).unionByName(twice).unionByName(keyless)


def feature_frame(pages: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with the features of their company, the last of equal keys; pages dropped for want of one)."""
    joined = pages_with_companies(pages, companies, "last")
    has = F.col("c_domain").isNotNull()
    return joined.where(has), joined.where(~has).select(*pages.columns)


def with_latest_lift(experiments: DataFrame, lifts: DataFrame) -> DataFrame:
    """Each experiment with its last lift result, or nulls."""
    cols = [c for c in lifts.columns if c not in ("experiment_id", "_seq")]
    last = lifts.groupBy("experiment_id").agg(F.max_by(F.struct(*cols), "_seq").alias("lift"))
    return experiments.join(last.withColumnRenamed("experiment_id", "id"), "id", "left")


def pool_for_query(pool: DataFrame, query_id: str) -> DataFrame:
    return pool.where(F.col("query_id") == query_id).orderBy("rank", "page_url")
