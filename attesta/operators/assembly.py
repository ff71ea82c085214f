"""Modelling rows: measurements rolled up by page, joined to pages and companies, labelled, grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import keys, stats
from attesta.operators.joins import one_per_key

_NUMERIC = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_features(df: DataFrame, column: str, prefix: str) -> Column:
    """A map of the finite numbers and flags among a struct's fields, one level of nesting included."""
    found: list[tuple[str, Column]] = []

    def walk(kind: T.StructType, path: str, depth: int) -> None:
        for f in kind.fields:
            at = f"{path}.`{f.name}`"
            if isinstance(f.dataType, _NUMERIC):
                found.append((prefix + f.name, F.col(at).cast("double")))
            elif isinstance(f.dataType, T.StructType) and depth < 1:
                walk(f.dataType, at, depth + 1)

    kind = df.schema[column].dataType
    if isinstance(kind, T.StructType):
        walk(kind, column, 0)
    if not found:
        return F.create_map().cast("map<string,double>")
    whole = F.create_map(*[x for name, value in found for x in (F.lit(name), value)])
    return F.map_filter(whole, lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def page_rollup(measurements: DataFrame, engine: str | None = None, window: str | None = None) -> DataFrame:
    """Mean rate (clamped) and width of the mean interval of each page of each engine over its queries.

    NaN counts as missing. A page without any finite rate is left out; without an interval its width is null.
    """
    m = measurements
    if engine is not None:
        m = m.where(F.col("engine") == engine)
    if window is not None:
        m = m.where(F.col("window_tag") == window)
    m = m.withColumn("_url", keys.normalize_url(F.col("page_url")))
    mean = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    g = m.groupBy("engine", "_url").agg(*[stats.finite(mean(c)).alias(n) for c, n in (("p_cited", "p"), ("ci_low", "lo"), ("ci_high", "hi"))]).where("p is not null")
    width = F.col("hi") - F.col("lo")
    return g.select("engine", "_url", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p"))).alias("p_cited"), F.when(width.isNotNull(), F.greatest(F.lit(0.0), width)).alias("ci_width"))


def assembled(measurements: DataFrame, pages: DataFrame, companies: DataFrame, engine: str | None = None, window: str | None = None, on_duplicate: str = "all") -> DataFrame:
    """page_url, company_domain, engine, p_cited, ci_width, features: pages measured, with a page record and a company.

    ``features``: what is numeric of the page's content and the company's firmographics and off-page
    record. With ``on_duplicate`` 'all', equal keys fan out.
    """
    p = one_per_key(pages.withColumn("_url", keys.normalize_url(F.col("url"))).where("_url <> ''"), "_url", on_duplicate)
    p = p.select("_url", keys.normalize_domain(F.col("company_domain")).alias("_d"), numeric_features(p, "content_features", "page__").alias("_pf"))
    c = one_per_key(companies.withColumn("_d", keys.normalize_domain(F.col("domain"))).where("_d <> ''"), "_d", on_duplicate)
    cf = F.map_concat(numeric_features(c, "firmographics", "company__"), numeric_features(c, "offpage", "company__"))
    stack = F.when(F.col("firmographics.tech_stack").isNotNull(), F.create_map(F.lit("company__tech_stack_count"), F.size("firmographics.tech_stack").cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    c = c.select("_d", F.map_concat(cf, stack).alias("_cf"), keys.trimmed(F.col("understanding.category")).alias("_category"))
    rows = page_rollup(measurements, engine, window).join(p, "_url").join(c, "_d")
    return rows.select(F.col("_url").alias("page_url"), F.col("_d").alias("company_domain"), "engine", "p_cited", "ci_width", F.map_concat("_pf", "_cf").alias("features"), F.col("_category").alias("category"))


def case_control_label(appeared: Column, cited: Column) -> Column:
    """winner if cited, loser if only seen, null (left out) if neither."""
    return F.when(F.coalesce(cited, F.lit(False)), "winner").when(F.coalesce(appeared, F.lit(False)), "loser")


def page_labels(measurements: DataFrame) -> DataFrame:
    """The label of each page and engine over all of its runs."""
    m = measurements.withColumn("page_url", keys.normalize_url(F.col("page_url")))
    g = m.groupBy("engine", "page_url").agg(F.bool_or(F.coalesce("appeared", F.lit(False))).alias("a"), F.bool_or(F.coalesce("cited", F.lit(False))).alias("c"))
    return g.select("engine", "page_url", case_control_label(F.col("a"), F.col("c")).alias("label")).where("label is not null")


def company_categories(companies: DataFrame) -> DataFrame:
    """The category of each domain, the last one given; blanks are passed over."""
    c = companies.select(keys.normalize_domain(F.col("domain")).alias("company_domain"), keys.trimmed(F.col("understanding.category")).alias("category"), "_seq").where("category <> '' and company_domain <> ''")
    return c.groupBy("company_domain").agg(F.max_by("category", "_seq").alias("category"))


def modeling_rows(measurements: DataFrame, pages: DataFrame, companies: DataFrame) -> DataFrame:
    """Assembled rows that have a label and a category, with the weight of their interval."""
    rows = assembled(measurements, pages, companies).drop("category")
    out = rows.join(page_labels(measurements), ["engine", "page_url"]).join(company_categories(companies), "company_domain")
    return out.withColumn("label_case_control", F.col("label")).withColumn("weight", stats.ci_weight(F.col("ci_width")))


def table_summary(rows: DataFrame) -> DataFrame:
    """By (category, engine): rows, and the effective N, which is distinct companies."""
    return rows.groupBy("category", "engine").agg(F.count("*").alias("n_rows"), F.count_distinct("company_domain").alias("n_companies"), F.count_if(F.col("label") == "winner").alias("n_winners"))


def feature_names(rows: DataFrame, by: list[str]) -> DataFrame:
    names = rows.select(*by, F.explode(F.map_keys("features")).alias("_f")).distinct()
    return names.groupBy(*by).agg(F.array_sort(F.collect_list("_f")).alias("features"))


def split_kinds(columns: list[str]) -> dict[str, list[str]]:
    """Column names by kind: features of pages and of companies."""
    return {kind: [c for c in columns if c.startswith(kind + "__")] for kind in ("page", "company")}


def inheritance_violations(rows: DataFrame) -> DataFrame:
    """(company_domain, feature, values) where pages of a company disagree on a company feature; null is a value too.

    rows: company_domain, features (map).
    """
    names = rows.select(F.explode(F.map_keys("features")).alias("feature")).where(F.startswith("feature", F.lit("company__"))).distinct()
    seen = rows.select("company_domain", F.explode(F.map_filter("features", lambda k, _: F.startswith(k, F.lit("company__")))).alias("feature", "value"))
    g = seen.groupBy("company_domain", "feature").agg(F.array_sort(F.collect_set("value")).alias("values"), F.count("*").alias("n"))
    pages = rows.groupBy("company_domain").agg(F.count("*").alias("pages"))
    j = g.join(pages, "company_domain").join(names, "feature", "left_semi")
    lacks = F.col("n") < F.col("pages")
    return j.where(F.size("values") + lacks.cast("int") > 1).select("company_domain", "feature", "values", lacks.alias("some_null"))


def written_back(jobs: DataFrame, fits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs as they stand after their results, fits to append): a job with a fit is done and holds it as JSON, others stay.

    jobs: id, status, result, ... fits: job_id, category, engine, coefficients and whatever else a fit has.
    """
    body = fits.groupBy("job_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*[c for c in fits.columns if c != "job_id"])))).alias("_r"))
    j = jobs.join(body.withColumnRenamed("job_id", "id"), "id", "left")
    done = F.col("_r").isNotNull()
    out = j.withColumns({"status": F.when(done, "done").otherwise(F.col("status")), "result": F.when(done, F.col("_r")).otherwise(F.col("result"))}).drop("_r")
    return out, fits.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi").drop("job_id")


def fit_requests(rows: DataFrame, customer: str, prior: str) -> DataFrame:
    """One request a (category, engine) as JSON, its rows nested; groups are never empty."""
    cells = F.sort_array(F.collect_list(F.struct("page_url", "company_domain", "p_cited", "ci_width", "label", F.to_json("features").alias("features"))))
    g = rows.groupBy("category", "engine").agg(cells.alias("rows"), F.count_distinct("company_domain").alias("n_companies"))
    return g.withColumn("request", F.to_json(F.struct(F.lit(customer).alias("customer_id"), "category", "engine", F.lit(prior).alias("prior_version"), "rows")))
