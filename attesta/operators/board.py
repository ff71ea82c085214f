"""Board roll-ups: who is cited where, what may be claimed, and how operations stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import keys, stats

CYCLE_BUDGET = 120.0
SLOT_MS = 14 * 86_400_000
TRANSITIONS = (("designing", "awaiting_publish"), ("awaiting_publish", "running"), ("awaiting_publish", "expired"), ("running", "complete"))
BADGES = ("Measured", "Hypothesis", "Causal (experiment)")


def citation_board(rows: DataFrame) -> DataFrame:
    """By engine: cited, total and the distinct domains of sources of cited rows."""
    g = rows.groupBy("engine").agg(F.count_if("cited").alias("cited"), F.count("*").alias("total"))
    return g.join(_sources(rows.where("cited")), "engine", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def _sources(rows: DataFrame) -> DataFrame:
    """(engine, sources): distinct before they are gathered, so an engine's list is as long as its domains are many."""
    return rows.select("engine", F.explode("source_domains").alias("_s")).distinct().groupBy("engine").agg(F.array_sort(F.collect_list("_s")).alias("sources"))


def head_to_head(rows: DataFrame, own: Column, competitors: Column) -> DataFrame:
    """By engine: one's own score, every competitor's, the most cited one (of equals the first seen), and all source domains.

    ``own`` and ``competitors``: a domain and an array of domains, columns of the rows or literals; ``own`` by its key.
    """
    own = keys.normalize_domain(own)
    d = rows.withColumn("_d", keys.normalize_domain(F.col("page_url"))).withColumn("_own", F.col("_d") == own).withColumn("_rival", F.array_contains(competitors, F.col("_d")) & (F.col("_d") != own))
    you = d.groupBy("engine").agg(
        F.count_if(F.col("_own") & F.col("cited")).alias("you_cited"), F.count_if("_own").alias("you_total"),
    ).join(_sources(rows), "engine", "left")
    rival = d.where("_rival").groupBy("engine", "_d").agg(F.count_if("cited").alias("c"), F.count("*").alias("t"), F.min("_seq").alias("s"))
    sides = F.array_sort(F.collect_list(F.struct(F.col("_d").alias("domain"), F.col("c").alias("cited"), F.col("t").alias("total"))))  # as many as there are competitors
    top = rival.groupBy("engine").agg(F.max(F.struct("c", (-F.col("s")).alias("o"), F.col("_d").alias("d"), "t")).alias("b"), sides.alias("competitors"))
    out = you.join(top, "engine", "left")
    r = out.select("engine", "you_cited", "you_total", F.col("b.d").alias("top_domain"), F.col("b.c").alias("top_cited"), F.col("b.t").alias("top_total"), "competitors", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
    return r.withColumn("headline", headline(F.col("you_cited"), F.col("you_total"), F.col("top_domain"), F.col("top_cited"), F.col("top_total")))


def headline(cited: Column, total: Column, rival: Column, rival_cited: Column, rival_total: Column) -> Column:
    me = F.concat(F.lit("you "), stats.score_text(cited, total))
    other = F.concat(F.lit(" · top competitor "), rival, F.lit(" "), rival_cited.cast("string"), F.lit("/"), rival_total.cast("string"))
    return F.when(rival.isNull(), me).otherwise(F.concat(me, other))


def claim_rung(workspaces: DataFrame, fits: DataFrame, lifts: DataFrame) -> DataFrame:
    """By workspace: 2 with any lift result, 1 with any fit, else 0, and its badge."""
    f = fits.select("workspace_id").distinct().withColumn("_f", F.lit(True))
    x = lifts.select("workspace_id").distinct().withColumn("_l", F.lit(True))
    rung = F.when(F.col("_l"), 2).when(F.col("_f"), 1).otherwise(0)
    return workspaces.select("workspace_id").join(f, "workspace_id", "left").join(x, "workspace_id", "left").select("workspace_id", rung.alias("rung"), badge(rung).alias("badge"))


def badge(rung: Column) -> Column:
    return F.get(F.array(*[F.lit(b) for b in BADGES]), rung)


def diagnosis(workspaces: DataFrame, fits: DataFrame, lifts: DataFrame) -> DataFrame:
    """The rung with the lift results that it licenses: withheld below 2."""
    r = claim_rung(workspaces, fits, lifts)
    all_lifts = lifts.groupBy("workspace_id").agg(F.array_sort(F.collect_list("experiment_id")).alias("lifts"))
    return r.join(all_lifts, "workspace_id", "left").withColumn("lifts", F.when(F.col("rung") == 2, F.col("lifts")).otherwise(F.array().cast("array<string>")))


def ops_totals(runs: DataFrame, budget: float = CYCLE_BUDGET) -> DataFrame:
    """One row: cycles, spend, calls, queries, mean spend, cycles over budget."""
    g = runs.agg(
        F.count("*").alias("cycles"), F.coalesce(F.sum("spend_usd"), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("calls_made"), F.lit(0)).alias("total_calls"),
        F.coalesce(F.sum("queries_issued"), F.lit(0)).alias("total_queries"), F.count_if(F.col("spend_usd") > budget).alias("over_budget_cycles"),
    )
    return g.select(
        "cycles", stats.half_up(F.col("_s"), 2).alias("total_spend"), "total_calls", "total_queries",
        stats.half_up(stats.rate(F.col("_s"), F.col("cycles")), 2).alias("avg_spend_per_cycle"), "over_budget_cycles", (F.col("over_budget_cycles") == 0).alias("within_budget"),
    )


def ops_errors(runs: DataFrame) -> DataFrame:
    """(engine, calls, errors, error_rate) over all cycles."""
    e = runs.select(F.explode("per_engine").alias("engine", "v")).groupBy("engine").agg(F.sum("v.calls").alias("calls"), F.sum("v.errors").alias("errors"))
    return e.withColumn("error_rate", stats.rate(F.col("errors"), F.col("calls")))


def budget_health(spend: Column, budget: float = CYCLE_BUDGET) -> Column:
    pct = spend / F.lit(budget) if budget else F.lit(0.0)
    return F.struct(stats.half_up(pct, 2).alias("pct"), F.when(pct >= 1, "over").when(pct >= 0.8, "warn").otherwise("ok").alias("status"))


def sweep_progress(done: Column, expected: Column) -> Column:
    total = F.greatest(F.coalesce(expected, done), done)
    return F.struct(done.alias("done"), total.alias("total"), stats.half_up(100 * stats.rate(done, total)).cast("int").alias("pct"))


def battlefield_progress(companies: DataFrame, target: int = 20) -> DataFrame:
    n = F.count_if(F.col("role").isin("battlefield", "competitor"))
    return companies.agg(n.alias("n")).select("n", (F.col("n") < target).alias("filling"), F.lit(target).alias("target"))


def card_state(u: Column) -> Column:
    """reading, partial or ready, and which of four fields are missing."""
    fields = ("category", "icp", "positioning", "what_you_are")
    has = {f: keys.trimmed(u[f]) != "" for f in fields}
    missing = F.filter(F.array(*[F.when(~has[f], F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    ready = has["category"] & has["icp"] & has["positioning"]
    status = F.when(F.size(missing) == len(fields), "reading").when(ready, "ready").otherwise("partial")
    return F.struct(status.alias("status"), missing.alias("missing"))


# --- lifecycle


def can_move(now: Column, to: Column, published: Column) -> Column:
    """Allowed steps of an experiment; running needs the publishing to have been recorded."""
    known = F.lit(False)
    for a, b in TRANSITIONS:
        known = known | ((now == a) & (to == b))
    return known & ((to != "running") | published.isNotNull())


def expired(status: Column, awaiting_since: Column, now: Column) -> Column:
    """Fourteen days of waiting, the last included."""
    return (status == "awaiting_publish") & F.coalesce(now - awaiting_since >= SLOT_MS, F.lit(False))


def expire_stale(experiments: DataFrame, now: int) -> DataFrame:
    return experiments.withColumn("status", F.when(expired(F.col("status"), F.col("awaiting_since"), F.lit(now)), "expired").otherwise(F.col("status")))


def with_baseline_tick(experiments: DataFrame, cycle: Column) -> DataFrame:
    """The monthly baseline: ``baseline_runs`` of experiments still designing or awaiting goes up once a cycle."""
    due = F.col("status").isin("designing", "awaiting_publish") & ~F.coalesce(F.col("last_baseline_cycle") == cycle, F.lit(False))
    return experiments.withColumns({"baseline_runs": F.coalesce("baseline_runs", F.lit(0)) + due.cast("int"), "last_baseline_cycle": F.when(due, cycle).otherwise(F.col("last_baseline_cycle"))})


def moved(experiments: DataFrame, events: DataFrame) -> DataFrame:
    """Experiments after one event each (id, to, ts): request, publish or complete; a step not allowed changes nothing."""
    e = experiments.join(events.select("id", "to", F.col("ts").alias("_ts")), "id", "left")
    publish = F.when((F.col("to") == "running") & F.col("publish_event_ts").isNull(), F.col("_ts")).otherwise(F.col("publish_event_ts"))
    ok = F.coalesce(can_move(F.col("status"), F.col("to"), publish), F.lit(False))
    return e.withColumns(
        {
            "awaiting_since": F.when(ok & (F.col("to") == "awaiting_publish"), F.col("_ts")).otherwise(F.col("awaiting_since")),
            "publish_event_ts": F.when(ok, publish).otherwise(F.col("publish_event_ts")),
            "status": F.when(ok, F.col("to")).otherwise(F.col("status")),
        }
    ).drop("to", "_ts")


def allowed_cadence(days: Column, engines: Column) -> Column:
    """Monthly or slower; never several engines within a week."""
    return (days >= 28) & ~((days <= 7) & (engines > 1))


def customer_view(experiments: DataFrame, lifts: DataFrame) -> DataFrame:
    """Experiments with treatment pages only, and the notice that is due, if any."""
    done = lifts.select(F.col("experiment_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    notice = F.when(F.col("status") == "awaiting_publish", "publish_pending").when((F.col("status") == "complete") & F.col("_done"), "result_ready")
    shown = F.transform("pairs", lambda p: F.struct(p["treatment_page"].alias("treatment_page")))
    return experiments.join(done, "id", "left").withColumn("pairs", shown).withColumn("nudge", notice).drop("_done")


def job_states(events: DataFrame) -> DataFrame:
    """The state of each analysis job: of its events (job_id, status, _seq) the last."""
    return events.groupBy("job_id").agg(F.max_by("status", "_seq").alias("status"), F.count("*").alias("n_events"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last record of each cycle."""
    line = Window.partitionBy("cycle").orderBy(F.desc("_seq"))
    return runs.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")
