"""Runs: rows from recorded results, rates by run group, noise and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import keys, stats

GROUP = ["query_id", "page_url", "engine"]


def engine_result(citations: Column, page_url: Column, text: Column) -> Column:
    """(cited, position, appeared) of a page in one answer: by domain; nothing for an empty domain."""
    d = keys.normalize_domain(page_url)
    first = F.get(F.filter(citations, lambda c: (c["domain"] == d) & (d != "")), 0)["rank"]
    cited = first.isNotNull()
    seen = cited | ((d != "") & F.contains(F.lower(F.coalesce(text, F.lit(""))), d))
    return F.struct(cited.alias("cited"), first.alias("position"), seen.alias("appeared"))


def labeled_rows(results: DataFrame, pool: DataFrame) -> DataFrame:
    """A row for each result and page of its query's pool; pages without a domain are passed over.

    results: query_id, engine, model_version, run_idx, citations, answer_text, ts, window_tag.
    pool: query_id, page_url.
    """
    ok = pool.where(keys.normalize_domain(F.col("page_url")) != "").select("query_id", "page_url")
    r = results.join(ok, "query_id").withColumn("r", engine_result(F.col("citations"), F.col("page_url"), F.col("answer_text")))
    return r.select(
        "query_id", "page_url", "engine", "model_version", "run_idx", "r.appeared", "r.cited", "r.position",
        F.transform("citations", lambda c: c["url"]).alias("source_urls"), "ts",
        F.coalesce("window_tag", F.lit("adhoc")).alias("window_tag"),
    )


def case_control(cited_domains: DataFrame, pool: DataFrame) -> DataFrame:
    """The pool with ``winner``: whether its domain is among the cited; empty domains are losers."""
    d = keys.normalize_domain(F.col("page_url"))
    won = cited_domains.select(keys.normalize_domain(F.col("domain")).alias("_d")).where("_d <> ''").distinct().withColumn("winner", F.lit(True))
    return pool.withColumn("_d", d).join(won, "_d", "left").withColumn("winner", F.coalesce("winner", F.lit(False))).drop("_d")


def citations_to_pages(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """Each citation (result_id, rank, domain) with its page of that domain, the one seen first."""
    p = pages.select(keys.normalize_domain(F.col("url")).alias("domain"), "url", "_seq").where("domain <> ''")
    first = p.groupBy("domain").agg(F.min_by("url", "_seq").alias("page_url"))
    return citations.join(first, "domain", "left")


def retagged(rows: DataFrame, window: str, experiment: str) -> DataFrame:
    return rows.withColumns({"window_tag": F.lit(window), "experiment_id": F.lit(experiment)})


def with_arm(rows: DataFrame, experiments: DataFrame) -> DataFrame:
    """``arm`` by exact page address: treatment before control, null outside the experiment."""
    e = experiments.select(F.col("id").alias("experiment_id"), F.explode("pairs").alias("p"))
    arms = e.select("experiment_id", F.explode(F.array(F.struct(F.col("p.treatment_page").alias("page_url"), F.lit(0).alias("o")), F.struct(F.col("p.control_page").alias("page_url"), F.lit(1).alias("o")))).alias("x"))
    one = arms.groupBy("experiment_id", "x.page_url").agg(F.min("x.o").alias("o")).select("experiment_id", "page_url", F.when(F.col("o") == 0, "treatment").otherwise("control").alias("arm"))
    return rows.join(one, ["experiment_id", "page_url"], "left")


def aggregate_runs(rows: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """k, cited_count, p_cited, its interval, position_weight and the latest model_version of each group.

    One shuffle; counts and maxima are combined before it.
    """
    hit = F.col("cited") & (F.col("position") > 0)
    g = rows.groupBy(*by).agg(
        F.count("*").alias("k"),
        F.count_if("cited").alias("cited_count"),
        F.sum(F.when(hit, 1 / F.col("position"))).alias("_w"),
        F.count_if(hit).alias("_n"),
        F.max_by("model_version", "_seq").alias("model_version"),
    )
    ci = stats.wilson(F.col("cited_count"), F.col("k"))
    return g.select(
        *by, "k", "cited_count", stats.rate(F.col("cited_count"), F.col("k")).alias("p_cited"), ci["low"].alias("ci_low"), ci["high"].alias("ci_high"),
        stats.rate(F.col("_w"), F.col("_n")).alias("position_weight"), "model_version",
    )


def focused(page_url: Column, focus: list[str]) -> Column:
    """Whether a page's domain is among those in focus; domains are compared by key, empty ones match nothing."""
    d = keys.normalize_domain(page_url)
    return (d != "") & F.array_contains(F.transform(F.array(*[F.lit(f) for f in focus]).cast("array<string>"), keys.normalize_domain), d)


def ambiguous(groups: DataFrame, by: list[str], threshold: float = 0.5, focus: list[str] | None = None) -> DataFrame:
    """Whether any group's interval straddles the threshold; of the focus domains only, if given."""
    inside = (F.col("ci_low") < threshold) & (F.col("ci_high") > threshold)
    if focus is not None:
        inside = inside & focused(F.col("page_url"), focus)
    return groups.groupBy(*by).agg(F.bool_or(inside).alias("ambiguous"))


def flip_rates(rows: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Noise of each run group: minority share, changes between neighbouring runs, entropy; 0 below two runs."""
    w = Window.partitionBy(*by).orderBy("run_idx", "_seq")
    changed = F.col("cited") != F.lag("cited").over(w)
    g = rows.withColumn("_x", changed).groupBy(*by).agg(F.count("*").alias("k"), F.count_if("cited").alias("cited_count"), F.count_if("_x").alias("transitions"))
    some = F.col("k") >= 2
    least = F.least(F.col("cited_count"), F.col("k") - F.col("cited_count"))
    return g.select(
        *by, "k", "cited_count",
        F.when(some, stats.rate(least, F.col("k"))).otherwise(0.0).alias("minority_fraction"),
        F.when(some, stats.rate(F.col("transitions"), F.col("k") - 1)).otherwise(0.0).alias("transition_rate"),
        F.when(some, stats.entropy(stats.rate(F.col("cited_count"), F.col("k")))).otherwise(0.0).alias("entropy_bits"),
        (some & (least > 0)).alias("flipped"),
    )


def flip_report(flips: DataFrame) -> DataFrame:
    """By engine: groups, too small groups, flipped ones, mean noise, and the unstable groups, worst first."""
    ok = F.col("k") >= 2
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))
    bad = F.when(F.col("flipped"), F.struct((-F.col("minority_fraction")).alias("m"), (-F.col("entropy_bits")).alias("e"), "query_id", "page_url"))  # one a flipped group, which the report lists
    g = flips.groupBy("engine").agg(
        F.count_if(ok).alias("n_groups"), F.count_if(~ok).alias("n_insufficient"), F.count_if("flipped").alias("n_flipped"),
        mean("minority_fraction").alias("mean_minority"), mean("transition_rate").alias("mean_transition"), mean("entropy_bits").alias("mean_entropy"),
        F.array_sort(F.collect_list(bad)).alias("u"),
    )
    return g.select(
        "engine", "n_groups", "n_insufficient", "n_flipped", stats.rate(F.col("n_flipped"), F.col("n_groups")).alias("flip_fraction"),
        "mean_minority", "mean_transition", "mean_entropy", F.transform("u", lambda x: F.concat_ws("|", x["query_id"], x["page_url"])).alias("unstable"),
    )


def drift(rows: DataFrame) -> DataFrame:
    """(query, engine) pairs that saw several model versions, in the order of first sight."""
    v = rows.where("model_version is not null").groupBy("query_id", "engine", "model_version").agg(F.min("_seq").alias("at"))
    g = v.groupBy("query_id", "engine").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model_version"))), lambda x: x["model_version"]).alias("versions"))
    return g.where(F.size("versions") > 1)


def engine_versions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("engine").agg(F.array_sort(F.collect_set("model_version")).alias("versions"))


def family_mismatch(rows: DataFrame, families: dict[str, str]) -> DataFrame:
    """Rows whose model version doesn't begin as their engine's models do: relabelled stand-ins."""
    start = F.create_map(*[x for k, v in families.items() for x in (F.lit(k), F.lit(v))])[F.col("engine")]
    return rows.where(start.isNotNull() & ~F.startswith(F.coalesce("model_version", F.lit("")), start))


def pool_composition(pool: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pages by company domain, shares, and who holds more than the threshold."""
    p = pool.withColumn("domain", keys.normalize_domain(F.col("page_url"))).where("domain <> ''").groupBy("domain").agg(F.count("*").alias("n"))
    whole = p.agg(F.sum("n").alias("total"))  # one row
    share = stats.rate(F.col("n"), F.col("total"))
    return p.crossJoin(F.broadcast(whole)).select("domain", "n", share.alias("share"), (share > threshold).alias("offender"))


def label_table(groups: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups with their pool page's company and a majority label, groups without one); the last of equal pages counts."""
    p = pool.groupBy("page_url").agg(F.max_by("company_domain", "_seq").alias("company_domain"))
    label = F.when(F.col("p_cited") >= 0.5, "winner").otherwise("loser")
    return groups.join(p, "page_url").withColumn("label_majority", label), groups.join(p, "page_url", "left_anti")


def realized_cost(calls: Column, per_call: float = 0.01, searches: int = 2) -> Column:
    return calls * F.lit(per_call * searches)


def adaptive_saving(calls: Column, units: Column, most: int = 8, per_call: float = 0.01, searches: int = 2) -> Column:
    """(fixed, realized, saved, saved_pct) of runs against always taking the most."""
    fixed, real = realized_cost(units * most, per_call, searches), realized_cost(calls, per_call, searches)
    return F.struct(fixed.alias("fixed_usd"), real.alias("realized_usd"), (fixed - real).alias("saved_usd"), (stats.rate(fixed - real, fixed) * 100).alias("saved_pct"))
