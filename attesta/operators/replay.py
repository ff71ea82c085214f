"""Sequential procedures replayed over recorded runs with window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import stats
from attesta.operators.measure import focused

FIRST, MOST, THRESHOLD = 3, 8, 0.5


def stop_runs(rows: DataFrame, first: int = FIRST, most: int = MOST, threshold: float = THRESHOLD, focus: list[str] | None = None) -> DataFrame:
    """stop_k of each (query, engine): the runs taken until no page's rate straddles the threshold.

    After each run from ``first`` on, the rate and interval of every page over the runs so far
    are taken; sampling stops at the first run without doubt, or at ``most``. With ``focus`` only
    pages of these domains raise doubt; an empty list means that none does.
    """
    w = Window.partitionBy("query_id", "engine", "page_url").orderBy("run_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, s = F.count("*").over(w), F.count_if("cited").over(w)
    p = rows.where(F.col("run_idx") < most).select("query_id", "engine", "page_url", "run_idx", n.alias("n"), s.alias("s"))
    ci = stats.wilson(F.col("s"), F.col("n"))
    doubt = (ci["low"] < threshold) & (ci["high"] > threshold)
    if focus is not None:
        doubt = doubt & focused(F.col("page_url"), focus)
    run = p.groupBy("query_id", "engine", "run_idx").agg(F.bool_or(doubt).alias("doubt"))
    done = F.when((F.col("run_idx") + 1 >= first) & ~F.col("doubt"), F.col("run_idx") + 1)
    return run.groupBy("query_id", "engine").agg(F.coalesce(F.min(done), F.max(F.col("run_idx") + 1)).cast("long").alias("stop_k"))


def replayed(rows: DataFrame, **how) -> DataFrame:
    """The rows that adaptive sampling would have taken."""
    return rows.join(stop_runs(rows, **how), ["query_id", "engine"]).where(F.col("run_idx") < F.col("stop_k"))


def numbered(rows: DataFrame, coarse: Column, order: list[str], name: str = "_seq") -> DataFrame:
    """Rows with their place from 1 in the whole order. ``coarse`` is what the order begins with, such as its day: rows are counted
    by it and numbered within it, so a task holds some of its values instead of everything.
    """
    r = rows.withColumn("_c", coarse)
    ahead = r.groupBy("_c").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = r.withColumn("_i", F.row_number().over(Window.partitionBy("_c").orderBy(*order)))
    j = within.join(ahead.withColumnRenamed("_c", "_d"), F.col("_c").eqNullSafe(F.col("_d")))
    return j.withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_c", "_d", "_i", "_before")


def budget_cut(queries: DataFrame, ceiling: int, actual: str = "actual", worst: str = "worst", order: str = "_seq") -> DataFrame:
    """``spent_before`` and ``done`` of each query in order: all until the first whose worst case no longer fits.

    Amounts are whole (cents, calls). The running sum is taken in two steps, sums by block and then
    within blocks, so no task holds the whole order.
    """
    block = F.floor(F.col(order) / 100_000)
    rows = queries.withColumn("_b", block)
    sums = rows.groupBy("_b").agg(F.sum(actual).alias("_s"))
    ahead = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.coalesce(F.sum(actual).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spent = rows.withColumn("_i", inside).join(ahead, "_b").withColumn("spent_before", (F.col("_before") + F.col("_i")).cast("long"))
    stop = spent.where(F.col("spent_before") + F.col(worst) > ceiling).agg(F.min(order).alias("_stop"))
    return spent.crossJoin(F.broadcast(stop)).withColumn("done", F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_b", "_i", "_before", "_stop")


def remaining(queries: DataFrame, checkpoint: DataFrame, key: str = "query_id") -> DataFrame:
    """Queries that a checkpoint doesn't list."""
    return queries.join(checkpoint.select(key).distinct(), key, "left_anti")


def worst_case_calls(engines: Column, most: int = MOST) -> Column:
    return F.size(engines) * most


def dispatched(queries: DataFrame, registry: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each query and target engine with its status: skipped (no adapter or key), failed, or ok.

    registry: engine, has_key. results: query_id, engine, error.
    """
    asked = queries.select("query_id", F.explode("target_engines").alias("engine")).join(registry, "engine", "left")
    got = asked.join(results.select("query_id", "engine", "error", F.lit(True).alias("_got")), ["query_id", "engine"], "left")
    status = (
        F.when(F.col("has_key").isNull(), "skipped_no_adapter").when(~F.col("has_key"), "skipped_no_key")
        .when(F.col("error").isNotNull(), "failed").when(F.col("_got"), "ok").otherwise("pending")
    )
    return got.select("query_id", "engine", status.alias("status"), "error")


def window_remeasured(rows: DataFrame, experiments: DataFrame, window: str, experiment: str) -> DataFrame:
    """One shared adaptive pass over an experiment's pages, tagged and split by arm."""
    from attesta.operators.measure import retagged, with_arm

    return with_arm(retagged(replayed(rows), window, experiment), experiments)


def cached(requests: DataFrame, cache: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Each request with ``hit``: a fresh entry of the same extractor has its reuse key, or the same was asked before.

    requests: _seq, reuse_key, extractor. cache: reuse_key, extractor, scraped_at (ms or null), page_url.
    """
    c = cache.where(valid_entry(F.col("scraped_at"), F.lit(now), days))
    best = c.groupBy("reuse_key", "extractor").agg(F.max_by("page_url", "scraped_at").alias("page_url"))
    line = F.row_number().over(Window.partitionBy("reuse_key", "extractor").orderBy("_seq"))
    r = requests.withColumn("_n", line).join(best, ["reuse_key", "extractor"], "left")
    return r.withColumn("hit", F.col("page_url").isNotNull() | (F.col("_n") > 1)).drop("_n")


def cache_counts(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def age_days(then: Column, now: Column) -> Column:
    """Days since; 0 for the future, null for unknown."""
    return F.greatest((now - then) / F.lit(86_400_000.0), F.lit(0.0))


def valid_entry(then: Column, now: Column, days: int = 30) -> Column:
    """Known age, and not above the limit."""
    return then.isNotNull() & (F.when(then >= now, F.lit(0.0)).otherwise((now - then) / F.lit(86_400_000.0)) <= days)
