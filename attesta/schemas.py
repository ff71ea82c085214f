"""Explicit schemas of the record tables, and checks that split a table into good rows and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENGINES = ("chatgpt", "perplexity", "gemini")
VERDICTS = ("worked", "no_effect", "inconclusive")
STATUSES = ("awaiting_publish", "complete", "designing", "expired", "running")

FIRMOGRAPHICS = "struct<size:string,funding_stage:string,headcount_growth:double,hiring_velocity:double,tech_stack:array<string>>"
OFFPAGE_FIELDS = tuple("backlink_density brand_search_volume entity_cooccurrence g2_presence reddit_presence review_site_presence thirdparty_mentions wikipedia_presence".split())
OFFPAGE = "struct<" + ",".join(f"{f}:double" for f in OFFPAGE_FIELDS) + ">"
UNDERSTANDING = "struct<category:string,icp:string,positioning:string,what_you_are:string>"
DETERMINISTIC = ("schema_markup", "comparison_table", "word_count", "heading_structure", "freshness_days", "query_term_coverage")
SUBJECTIVE = ("citation_density", "direct_answer_first", "listicle_vs_prose", "quote_density", "stats_density")
_BOOLEAN = {"schema_markup", "comparison_table", "direct_answer_first"}
CONTENT = "struct<" + ",".join(f"{f}:{'boolean' if f in _BOOLEAN else 'double'}" for f in DETERMINISTIC + SUBJECTIVE) + ">"
PAIR = "struct<treatment_page:string,control_page:string,match_covars:map<string,string>>"
COEFFICIENT = "struct<feature:string,posterior_median:double,ci_low:double,ci_high:double,noise_flag:boolean>"

TABLES = {
    "workspaces": "_id string, name string, vertical string, own_domain string, competitor_domains array<string>, query_pack_id string, owner string, _seq long",
    "companies": f"workspace_id string, domain string, name string, role string, firmographics {FIRMOGRAPHICS}, offpage {OFFPAGE}, understanding {UNDERSTANDING}, coverage_flags array<string>, source_versions map<string,string>, _seq long",
    "pages": f"workspace_id string, company_domain string, url string, role string, content_features {CONTENT}, extractor_version string, scraped_at long, cache_key string, _seq long",
    "queries": "id string, workspace_id string, customer_id string, vertical string, text string, seed_source string, target_engines array<string>, _seq long",
    "measurements": "id string, workspace_id string, query_id string, page_url string, engine string, model_version string, run_idx int, appeared boolean, cited boolean, position int, source_urls array<string>, source_domains array<string>, ts long, window_tag string, experiment_id string, p_cited double, ci_low double, ci_high double, position_weight double, _seq long",
    "model_fits": f"id string, workspace_id string, customer_id string, category string, engine string, coefficients array<{COEFFICIENT}>, prior_version string, top_hypotheses array<string>, n_companies int, n_rows int, _seq long",
    "experiments": f"id string, workspace_id string, customer_id string, pairs array<{PAIR}>, baseline_window string, post_window string, status string, awaiting_since long, publish_event_ts long, _seq long",
    "lift_results": "id string, workspace_id string, experiment_id string, estimate double, ci_low double, ci_high double, p_value double, verdict string, claim_rung int, computed_at long, _seq long",
    "interventions": "id string, feature_changed string, category string, engine string, measured_lift double, ci_low double, ci_high double, experiment_id string, recorded_at long, _seq long",
    "run_records": "id string, workspace_id string, cycle string, queries_issued int, calls_made int, spend_usd double, per_engine map<string,struct<calls:int,errors:int>>, ts long, _seq long",
    "analysis_jobs": "id string, workspace_id string, status string, request string, result string, _seq long",
}


def checks(table: str) -> dict[str, Column]:
    """What must hold of a row, by name of the rule; a null value breaks no range."""
    ok = {
        "measurements": {
            "has_keys": F.col("query_id").isNotNull() & F.col("page_url").isNotNull() & F.col("engine").isNotNull(),
            "p_in_range": F.col("p_cited").isNull() | F.col("p_cited").between(0, 1),
        },
        "model_fits": {"ci_ordered": F.forall(F.coalesce("coefficients", F.array().cast(f"array<{COEFFICIENT}>")), lambda c: c["ci_low"] <= c["ci_high"])},
        "lift_results": {"ci_ordered": F.col("ci_low") <= F.col("ci_high"), "verdict": F.col("verdict").isin(*VERDICTS)},
        "experiments": {"status": F.col("status").isin(*STATUSES)},
        "companies": {"has_domain": F.coalesce(F.col("domain"), F.lit("")) != ""},
        "pages": {"has_url": F.coalesce(F.col("url"), F.lit("")) != ""},
    }
    return ok.get(table, {})


def checked(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with ``violations``). No row is lost."""
    rules = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in checks(table).items()]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    marked = df.withColumn("violations", found)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)
