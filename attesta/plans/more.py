"""Further queries: the operators that ``catalog`` doesn't reach, each next to DuckDB's SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import html, keys, stats
from attesta.functions.register import register
from attesta.operators import assembly, audit, board, fit, joins, lift, matching, measure, replay, sourcing
from attesta.plans.catalog import _STOPS, _model_rows, _shops, _SHOPS, query, r6
from attesta.plans.tables import RUNS, companies, measurements, pages, runs, table, wide_runs_sql
from attesta.schemas import OFFPAGE_FIELDS
from attesta.sources import responses, store
from attesta.streaming import board as streams

# --- store


@query(f"SELECT page_id, {keys.sql_url('url')} AS page_url, list_filter([{keys.sql_domain('url')}, 'b.org'], lambda x: x <> '') AS source_domains, len([url, 'http://x.b.org/1', '']) AS n_urls FROM pages")
def stored_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"), F.array("url", F.lit("http://x.b.org/1"), F.lit("")).alias("source_urls"))
    return store.measurements_to_store(p).select("page_id", "page_url", "source_domains", F.size("source_urls").cast("long").alias("n_urls"))


@query("SELECT c_custkey, 'shop' || c_custkey || '.com' AS own_domain, ['a' || (c_custkey % 3) || '.org'] AS competitor_domains FROM customer")
def stored_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    own, rival = F.concat(F.lit("https://www.Shop"), k, F.lit(".com/")), F.concat(F.lit("a"), (F.col("c_custkey") % 3).cast("string"), F.lit(".org"))
    c = table(spark, sf_dir, "customer").select("c_custkey", own.alias("own_domain"), F.array(rival, F.concat(F.lit("http://www."), rival), F.lit(" "), own).alias("competitor_domains"))
    return store.workspaces_to_store(c)


@query("""SELECT 'exp' || s_suppkey AS id, 'https://t' || s_suppkey || '.com/a' AS treatment_page, 'https://c' || s_suppkey || '.com' AS control_page FROM supplier""")
def stored_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    pair = F.struct(F.concat(F.lit("http://WWW.t"), k, F.lit(".com/a/")).alias("treatment_page"), F.concat(F.lit("c"), k, F.lit(".com#x")).alias("control_page"), F.create_map(F.lit("a"), F.lit("b")).alias("match_covars"))
    e = table(spark, sf_dir, "supplier").select(F.concat(F.lit("exp"), k).alias("id"), F.array(pair).alias("pairs"))
    return store.experiments_to_store(e).select("id", F.col("pairs")[0]["treatment_page"].alias("treatment_page"), F.col("pairs")[0]["control_page"].alias("control_page"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey % 4 = 2 ORDER BY s_suppkey LIMIT 1")
def first_row_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (F.col("s_nationkey") % 4).cast("string").alias("key"), F.col("s_suppkey").alias("_seq"))
    return store.lookup(s, "key", "2").select("s_suppkey", "s_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def owned_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.owned(table(spark, sf_dir, "customer").withColumn("owner", F.col("c_mktsegment")), "BUILDING").select("c_custkey")


@query(f"""WITH p AS (SELECT *, {keys.sql_url('url')} AS key FROM pages)
SELECT key AS url, arg_max(page_id, page_id) AS page_id, arg_max(html, page_id) FILTER (page_id % 2 = 0) IS NOT NULL AS has_html FROM p WHERE key <> '' GROUP BY key""")
def upserted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.lit("w").alias("workspace_id"), "url", F.col("url").alias("company_domain"), "page_id", F.when(F.col("page_id") % 2 == 0, F.col("html")).alias("html"), F.col("page_id").alias("_seq"))
    return store.upserted_pages(p).select("url", "page_id", F.col("html").isNotNull().alias("has_html"))


# --- payloads


@query("""SELECT n_nationkey, 'd' || n_nationkey || '.com' AS domain, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0
UNION ALL SELECT n_nationkey, 'e.com', 'E' FROM nation WHERE n_nationkey % 5 IN (1, 3)""")
def vendor_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    one = F.struct(F.concat(F.lit("d"), n.cast("string"), F.lit(".com")).alias("domain"), F.col("n_name").alias("name"), F.lit("c").alias("category"))
    two = F.struct(F.lit("e.com").alias("domain"), F.lit("E").alias("name"), F.lit("c").alias("category"))
    raw = F.when(n % 5 == 0, "no list").when(n % 5 % 2 == 1, F.to_json(F.struct(F.array(one, two).alias("companies")))).otherwise(F.to_json(F.array(one)))
    good, _ = responses.vendor_companies(table(spark, sf_dir, "nation").withColumn("raw", raw), "raw")
    return good.select("n_nationkey", F.explode("companies").alias("c")).select("n_nationkey", "c.domain", "c.name")


@query("SELECT page_id, url FROM pages WHERE page_id % 15 < 10 AND page_id % 7 <> 0 AND page_id % 4 <> 1")
def scraped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(k.cast("string").alias("domain"), F.col("url").alias("link"), (k % 15).alias("position"), F.when(k % 7 == 0, "HTTP 500").alias("error"), F.when(k % 4 == 1, " \n").otherwise(F.col("html")).alias("markdown"))
    return responses.scraped_pages(p).select(F.col("domain").cast("long").alias("page_id"), "url")


_FORMS = """CASE doc_id % 8 WHEN 0 THEN '"listicle"' WHEN 1 THEN '0.5' WHEN 2 THEN '" Listicle "' WHEN 3 THEN '0.3' WHEN 4 THEN '"mixed"' ELSE '1' END"""


@query("""SELECT doc_id, doc_id % 2 = 0 AS direct, CAST(n_chars AS DOUBLE) AS stats_density, CASE doc_id % 8 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 4 THEN 0.5 ELSE 1.0 END AS form
FROM documents WHERE doc_id % 8 NOT IN (2, 3) AND doc_id % 11 <> 0""")
def judged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that a model judged, as recorded: wrong kinds of values are rejects."""
    flag = F.when(F.col("doc_id") % 11 == 0, '"true"').otherwise((F.col("doc_id") % 2 == 0).cast("string"))
    raw = F.concat(F.lit('Here: {"direct_answer_first": '), flag, F.lit(', "stats_density": "'), F.col("n_chars").cast("string"), F.lit('", "citation_density": 1, "quote_density": 0.25, "listicle_vs_prose": '), F.expr(_FORMS), F.lit("} ok"))
    good, _ = responses.subjective_features(table(spark, sf_dir, "documents").withColumn("raw", raw), "raw")
    s = F.col("subjective")
    return good.select("doc_id", s["direct_answer_first"].alias("direct"), s["stats_density"].alias("stats_density"), s["listicle_vs_prose"].alias("form"))


@query("""SELECT doc_id, source AS category, CASE WHEN lang = source THEN [source] ELSE ['one', 'what', source, lang] END AS card FROM documents WHERE doc_id % 3 <> 0 AND trim(coalesce(source, '')) <> '' AND trim(coalesce(lang, '')) <> ''""")
def company_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    body = F.struct(F.concat(F.lit(" "), "source").alias("category"), F.col("lang").alias("icp"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("p").alias("positioning"), F.lit("what").alias("what_you_are"), F.array(F.lit(" one "), F.lit("")).alias("card"))
    good, _ = responses.understanding(d.withColumn("raw", F.concat(F.lit("```json\n"), F.to_json(body))), "raw")
    return good.select("doc_id", "understanding.category", "card")


@query(f"""WITH d AS (SELECT doc_id, '2. ' || replace(text, chr(10), chr(10) || '3.5 inch ') AS raw FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, list_filter(list_transform(string_split(raw, chr(10)), lambda x: {keys.sql_trim("regexp_replace(x, '^[\\s>]*([-*•]|[0-9]+[.)])\\s+', '')")}), lambda x: x <> '') AS q FROM d)
SELECT doc_id, len(q) AS n, md5(array_to_string(q, '|')) AS queries FROM l""")
def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    q = responses.expanded_queries(F.concat(F.lit("2. "), F.replace("text", F.lit("\n"), F.lit("\n3.5 inch "))))
    d = d.select("doc_id", q.alias("q"))  # so that the texts are read once
    return d.select("doc_id", F.size("q").cast("long").alias("n"), F.md5(F.array_join("q", "|")).alias("queries"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE [p_brand, p_type] END AS stack, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey / 4.0 END AS growth,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS size FROM part""")
def firmographic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    f = sourcing.firmographics({
        "size": F.when(k % 2 == 0, F.concat(F.lit("  "), "p_brand")).otherwise(" "), "headcount_growth": F.when(k % 3 == 0, "n/a").otherwise((k / 4.0).cast("string")),
        "tech_text": F.when(k % 5 == 0, " , ,").otherwise(F.concat_ws(" , ", "p_brand", F.lit(""), "p_type")),
    })
    return table(spark, sf_dir, "part").select("p_partkey", f["tech_stack"].alias("stack"), f["headcount_growth"].alias("growth"), f["size"].alias("size"))


@query("""SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 2) AS again FROM orders""")
def retryable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, "HTTP 429 slow down").when(k == 1, "status 503").when(k == 2, "read ECONNRESET").when(k == 3, "HTTP 404")
    return table(spark, sf_dir, "orders").select("o_orderkey", responses.retryable(said).alias("again"))


# --- keys, dates, SQL functions


@query(f"""SELECT page_id, {keys.sql_domain('url')} || '|' || {keys.sql_fnv1a('substr(html, 1, 80)')} || '|' || {keys.sql_fnv1a("'a' || chr(10) || 'b'")} || '|v1' AS cache_key,
  {keys.sql_url('url')} || '|noqt|v1' AS reuse_key FROM pages""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, v = table(spark, sf_dir, "pages"), F.lit("v1")
    return p.select("page_id", keys.cache_key(F.col("url"), F.substring("html", 1, 80), F.array(F.lit("B"), F.lit(" a")), v).alias("cache_key"), keys.reuse_key(F.col("url"), F.array(F.lit(" ")), v).alias("reuse_key"))


@query(f"SELECT page_id, {keys.sql_domain('url')} AS domain, {keys.sql_url('url')} AS key, {keys.sql_fnv1a('url')} AS hash, {keys.sql_domain('url')} = 'site1.com' AS own FROM pages")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.expr("cite_domain(url)").alias("domain"), F.expr("cite_url(url)").alias("key"), F.expr("cite_fnv1a(url)").alias("hash"), keys.same_domain(F.col("url"), F.lit("http://site1.com/z")).alias("own"))


_JITTER = "((CAST('0x' || substr(sha256({x}), 1, 8) AS BIGINT) / 4294967295.0 - 0.5) * 0.1)"


@query(f"SELECT p_partkey, round({_JITTER.format(x='p_name')}, 6) AS jitter FROM part")
def jitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", r6("jitter", keys.jitter(F.col("p_name"))))


@query("SELECT o_orderkey, greatest(0, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS BIGINT)) AS days FROM orders")
def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_format(d, "EEE, dd MMM yyyy 00:00:00 'GMT'")).when(k == 1, F.date_format(d, "MMMM d, yyyy")).when(k == 2, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", html.freshness_days(said, F.lit("1998-01-01")).alias("days"))


# --- rows, joins, sets


@query(f"""WITH p AS (SELECT {keys.sql_domain('url')} AS domain, url, page_id FROM pages), f AS (SELECT domain, arg_min(url, page_id) AS page_url FROM p WHERE domain <> '' GROUP BY domain)
SELECT c.page_id AS result_id, c.domain, f.page_url FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'nowhere.org' ELSE domain END AS domain FROM p) c LEFT JOIN f USING (domain)""")
def citations_to_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    d = F.when(F.col("page_id") % 3 == 0, "nowhere.org").otherwise(keys.normalize_domain(F.col("url")))
    return measure.citations_to_pages(p.select(F.col("page_id").alias("result_id"), d.alias("domain")), p.select("url", F.col("page_id").alias("_seq"))).select("result_id", "domain", "page_url")


@query(_STOPS + """ SELECT r.engine, 'window' AS window_tag, CASE page_url WHEN 'https://site0.com/p' THEN 'treatment' WHEN 'https://site1.com/p' THEN 'control' END AS arm, count(*) AS n, count(*) FILTER (cited) AS n_cited
FROM runs r JOIN stops USING (query_id, engine) WHERE run_idx < stop_k GROUP BY ALL""")
def window_remeasured(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.array(F.struct(F.lit("https://site0.com/p").alias("treatment_page"), F.lit("https://site1.com/p").alias("control_page")))
    r = replay.window_remeasured(runs(spark, sf_dir), spark.range(1).select(F.lit("e").alias("id"), pair.alias("pairs")), "window", "e")
    return r.groupBy("engine", "window_tag", "arm").agg(F.count("*").alias("n"), F.count_if("cited").alias("n_cited"))


_FOCUSED = _STOPS.replace("SELECT query_id, engine, run_idx, CAST(count(*)", "SELECT query_id, engine, page_url, run_idx, CAST(count(*)").replace("bool_or(", "bool_or(page_url = 'https://site1.com/p' AND ")


@query(_FOCUSED + " SELECT query_id, engine, CAST(stop_k AS BIGINT) AS stop_k FROM stops")
def focused_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.stop_runs(runs(spark, sf_dir), focus=["https://www.Site1.com/", ""])


@query(f"WITH {wide_runs_sql()}, w AS (SELECT avg(ci_high) - avg(ci_low) AS w, page_url, engine FROM measurements GROUP BY ALL) SELECT engine, page_url, round(1 / (1 + w), 6) AS weight FROM w")
def interval_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.page_rollup(measurements(spark, sf_dir)).select("engine", F.col("_url").alias("page_url"), r6("weight", stats.ci_weight(F.col("ci_width"))))


_PAGE_FEATURES = {
    "schema_markup": "n % 2 = 0", "comparison_table": "n % 3 = 0", "word_count": "n * 37 % 500", "heading_structure": "n % 4", "freshness_days": "n % 9", "query_term_coverage": "n % 5 / 5.0",
    "direct_answer_first": "CASE WHEN n % 6 <> 0 THEN n % 2 = 1 END", "stats_density": "n % 7", "citation_density": "n % 3", "quote_density": "1", "listicle_vs_prose": "n % 3 / 2.0",
}


@query("WITH k AS (SELECT n_nationkey AS n FROM nation) SELECT * FROM (" + " UNION ALL ".join(f"SELECT n AS page, 'page__{f}' AS feature, CAST({x} AS DOUBLE) AS value FROM k" for f, x in _PAGE_FEATURES.items()) + ") WHERE value IS NOT NULL")
def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return p.select(F.col("_seq").cast("int").alias("page"), F.explode(assembly.numeric_features(p, "content_features", "page__")).alias("feature", "value"))


@query("SELECT c_custkey, CASE c_custkey WHEN 1 THEN 'customer' WHEN 2 THEN 'competitor' WHEN 3 THEN 'competitor' ELSE 'battlefield' END AS role FROM customer")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.concat(F.lit("https://www.shop"), F.col("c_custkey").cast("string"), F.lit(".com/x"))
    return table(spark, sf_dir, "customer").select("c_custkey", sourcing.role_for(d, "shop1.com", ["shop2.com", "shop3.com"]).alias("role"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'prose' ELSE 'listicle' END AS content, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'listicle' ELSE 'prose' END AS turned FROM nation")
def content_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey") % 4
    f = F.create_map(F.lit(matching.CONTENT_TYPE), F.when(n == 1, 0.25).when(n == 2, 0.5).when(n == 3, 1.0))
    return table(spark, sf_dir, "nation").select("n_nationkey", matching.content_type(f).alias("content"), matching.content_type(f, False).alias("turned"))


@query(f"WITH {wide_runs_sql()} SELECT page_url, list_sort(list(DISTINCT query_id)) AS queries, min(query_id) AS cluster FROM measurements GROUP BY page_url")
def topical_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.query_sets(measurements(spark, sf_dir))


@query(f"WITH {_SHOPS} SELECT 'kept' AS side, url FROM p WHERE d IN (SELECT d FROM c) UNION ALL SELECT 'dropped', url FROM p WHERE d NOT IN (SELECT d FROM c)")
def feature_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = joins.feature_frame(*_shops(spark, sf_dir))
    return kept.select(F.lit("kept").alias("side"), "url").unionByName(dropped.select(F.lit("dropped").alias("side"), "url"))


@query("SELECT doc_id AS rank, 'p' || doc_id AS page_url FROM documents WHERE source = 'src3'")
def pool_for_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("page_url"))
    return joins.pool_for_query(d, "src3").select("rank", "page_url")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def remaining_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.remaining(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(f"""WITH {RUNS}, g AS (SELECT query_id, page_url, engine, avg(CAST(cited AS INT)) AS p FROM runs GROUP BY ALL) SELECT query_id, page_url, engine FROM g WHERE page_url = 'https://site2.com/p'""")
def unmatched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = spark.createDataFrame([("https://site0.com/p", "c0", 1), ("https://site1.com/p", "c1", 2)], "page_url string, company_domain string, _seq long")
    return measure.label_table(measure.aggregate_runs(runs(spark, sf_dir)), pool)[1].select("query_id", "page_url", "engine")


@query(f"""WITH p AS (SELECT page_id, {keys.sql_url('url')} AS key, {keys.sql_domain('url')} AS domain, html FROM pages)
SELECT key AS url, arg_min(domain, page_id) AS company_domain, 'candidate' AS role, 'v2' AS extractor_version FROM p WHERE key <> '' AND {keys.sql_trim('html')} <> '' GROUP BY key""")
def enriched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", "html", F.array(F.lit("and")).alias("terms"), F.lit(None).cast("string").alias("role"), F.col("page_id").alias("_seq"))
    return sourcing.enriched_pages(p, "v2", F.lit("2026-01-01")).select("url", "company_domain", "role", "extractor_version")


_OFF = {f: f"(n * {i + 1} % 11)" if i < 6 else "NULL" for i, f in enumerate(OFFPAGE_FIELDS)}


@query("WITH k AS (SELECT n_nationkey AS n FROM nation) " + " UNION ALL ".join(f"SELECT 'site' || n || '.com' AS domain, '{f}' AS feature, CAST(CASE WHEN n % 4 <> 0 THEN {x} END AS DOUBLE) AS value FROM k" for f, x in _OFF.items()))
def offpage_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcing.feature_vector(companies(spark, sf_dir))


@query("""SELECT 'site' || n_nationkey || '.com' AS domain, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 1.0 END AS g2_presence, CASE WHEN n_nationkey % 3 = 0 THEN 1.0 END AS wikipedia_presence,
  CASE WHEN n_nationkey % 5 = 0 THEN 2.5 END AS reddit_presence FROM nation""")
def merged_offpage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    d = table(spark, sf_dir, "nation").select(F.concat(F.lit("site"), n.cast("string"), F.lit(".com")).alias("domain"), n)
    none = F.lit("n/a")
    vendor = d.where(n % 2 == 0).select("domain", none.alias("thirdparty_mentions"), n.cast("string").alias("g2_presence"), none.alias("review_site_presence"), F.lit("NaN").alias("backlink_density"))
    serp = d.where(n % 3 == 0).select("domain", F.lit("1").alias("wikipedia_presence"), none.alias("brand_search_volume"), F.lit("Infinity").alias("entity_cooccurrence"))
    reddit = d.where(n % 5 == 0).select("domain", F.lit("2.5").alias("reddit_presence"))
    m = sourcing.merged_offpage(d.select("domain"), vendor, serp, reddit)
    return m.select("domain", "offpage.g2_presence", "offpage.wikipedia_presence", "offpage.reddit_presence")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'other,offpage_missing' ELSE 'other' END AS flags, CASE WHEN n_nationkey % 3 = 0 THEN 'old' ELSE 'new' END AS stamp FROM nation""")
def flags_and_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    had = F.when(n % 4 < 2, F.array(F.lit("other"), F.lit("offpage_missing"))).otherwise(F.array(F.lit("other")))
    stamp = sourcing.stamped(F.create_map(F.lit("serp"), F.lit("old")), "serp", "new", n % 3 != 0)
    return table(spark, sf_dir, "nation").select(n, F.array_join(sourcing.toggled(had, "offpage_missing", n % 2 == 0), ",").alias("flags"), stamp["serp"].alias("stamp"))


@query("SELECT 'HTTPS://www.site' || n_nationkey || '.com/p/?utm_source=x' AS url, CASE WHEN n_nationkey % 6 = 0 THEN 0.5 ELSE 1.0 END AS coverage_score, CASE WHEN n_nationkey % 6 = 0 THEN 'subjective_features' ELSE '' END AS missing FROM nation")
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcing.coverage(pages(spark, sf_dir), "url", "page").select(F.col("key").alias("url"), "coverage_score", F.array_join("missing", ",").alias("missing"))


# --- agreement, progress, lifecycle


_JUDGED = {"citation_density": ("quality", "toxic"), "direct_answer_first": ("toxic", "toxic"), "listicle_vs_prose": ("doc_id % 3", "quality"), "quote_density": ("doc_id % 2", "doc_id % 3"), "stats_density": ("quality", "doc_id % 2")}


@query("WITH l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({p} AS DOUBLE) AS p, CAST({g} AS DOUBLE) AS g FROM labels WHERE doc_id % 10 <> 0" for f, (p, g) in _JUDGED.items()) + """),
c AS (SELECT feature, p, g, CAST(count(*) AS DOUBLE) AS n FROM l WHERE p IS NOT NULL AND g IS NOT NULL GROUP BY ALL), t AS (SELECT feature, sum(n) AS n, coalesce(sum(n) FILTER (p = g), 0) AS same, sum(n) FILTER (abs(p - g) <= 1) / sum(n) AS within FROM c GROUP BY feature),
a AS (SELECT feature, p AS v, sum(n) AS a FROM c GROUP BY ALL), b AS (SELECT feature, g AS v, sum(n) AS b FROM c GROUP BY ALL), e AS (SELECT feature, sum(a * b) AS ab FROM a JOIN b USING (feature, v) GROUP BY feature)
SELECT feature, CAST(n AS BIGINT) AS n, round((same / n - ab / n / n) / (1 - ab / n / n), 6) AS kappa, round(within, 6) AS within, (SELECT count(*) FROM labels) AS attempted, (SELECT count(*) FROM labels WHERE doc_id % 10 = 0) AS skipped FROM t JOIN e USING (feature)""")
def agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda j: F.struct(*[F.expr(pair[j]).cast("double").alias(f) for f, pair in _JUDGED.items()])
    items = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 10 != 0, side(0)).alias("predicted"), side(1).alias("gold"))
    return sourcing.agreement_report(items).select("feature", "n", r6("kappa"), r6("within"), "attempted", "skipped")


@query("""SELECT c_custkey, c_custkey % 9 AS done, greatest(c_custkey % 9, c_custkey % 7) AS total,
  CAST(CASE WHEN greatest(c_custkey % 9, c_custkey % 7) = 0 THEN 0 ELSE floor(100.0 * (c_custkey % 9) / greatest(c_custkey % 9, c_custkey % 7) + 0.5) END AS INT) AS pct FROM customer""")
def sweep_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = board.sweep_progress(F.col("c_custkey") % 9, F.col("c_custkey") % 7)
    return table(spark, sf_dir, "customer").select("c_custkey", p["done"].alias("done"), p["total"].alias("total"), p["pct"].alias("pct"))


@query("SELECT count(*) FILTER (n_nationkey % 3 > 0) AS n, count(*) FILTER (n_nationkey % 3 > 0) < 20 AS filling, CAST(20 AS INT) AS target FROM nation")
def battlefield_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey") % 3
    return board.battlefield_progress(table(spark, sf_dir, "nation").select(F.when(n == 0, "customer").when(n == 1, "competitor").otherwise("battlefield").alias("role")))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'reading' WHEN 1 THEN 'partial' ELSE 'ready' END AS status,
  CASE n_nationkey % 3 WHEN 0 THEN 'category,icp,positioning,what_you_are' WHEN 1 THEN 'icp,what_you_are' ELSE 'what_you_are' END AS missing FROM nation""")
def card_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey") % 3
    u = F.struct(F.when(n > 0, "c").alias("category"), F.when(n > 1, "i").otherwise(" ").alias("icp"), F.when(n > 0, "p").alias("positioning"), F.lit("").alias("what_you_are"))
    s = board.card_state(F.col("u"))
    return table(spark, sf_dir, "nation").withColumn("u", u).select("n_nationkey", s["status"].alias("status"), F.array_join(s["missing"], ",").alias("missing"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 4 WHEN 0 THEN 'awaiting_publish' WHEN 1 THEN 'running' WHEN 2 THEN 'complete' ELSE 'designing' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS awaiting_since, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey END AS publish_event_ts FROM orders""")
def moved_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    o = table(spark, sf_dir, "orders")
    state = lambda *x: F.when(k == 0, x[0]).when(k == 1, x[1]).when(k == 2, x[2]).otherwise(x[3])
    none = F.lit(None).cast("long")
    e = o.select(F.col("o_orderkey").cast("string").alias("id"), state("designing", "awaiting_publish", "running", "designing").alias("status"), none.alias("awaiting_since"), none.alias("publish_event_ts"))
    moves = o.select(F.col("o_orderkey").cast("string").alias("id"), state("awaiting_publish", "running", "complete", "complete").alias("to"), F.col("o_orderkey").alias("ts"))
    return board.moved(e, moves)


@query("SELECT n_nationkey, CAST(n_nationkey % 5 + CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 > 0 THEN 1 ELSE 0 END AS INT) AS baseline_runs FROM nation")
def baseline_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    e = table(spark, sf_dir, "nation").select(n, F.when(n % 2 == 0, "designing").otherwise("running").alias("status"), (n % 5).cast("int").alias("baseline_runs"), F.when(n % 3 == 0, "2026-01").alias("last_baseline_cycle"))
    return board.with_baseline_tick(e, F.lit("2026-01")).select("n_nationkey", "baseline_runs")


@query("SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max(event_type, event_id) AS status, count(*) AS n_events FROM events GROUP BY user_id")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.job_states(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.col("event_id").alias("_seq")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'done' ELSE 'queued' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS n_fits FROM customer")
def fits_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_custkey")
    jobs = c.select("id", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("result"))
    fits = c.where("c_custkey % 2 = 0").select(F.col("id").alias("job_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("engine"))
    out, _ = assembly.written_back(jobs, fits)
    return out.select("id", "status", F.coalesce(F.size(F.from_json("result", "array<struct<engine:string>>")), F.lit(0)).alias("n_fits"))


@query(f"""WITH {wide_runs_sql()}, l AS (SELECT engine, n, bool_or(k > 2) AS a, bool_or(c > 0) AS c FROM measurements GROUP BY ALL)
SELECT 'cat' || (n % 2) AS category, engine, count(*) AS n_companies, CAST(count(*) AS INT) AS n_rows FROM l WHERE a OR c GROUP BY ALL""")
def fit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = assembly.fit_requests(_model_rows(spark, sf_dir), "cust", "v1")
    return r.select("category", "engine", "n_companies", F.size(F.from_json(F.get_json_object("request", "$.rows"), "array<struct<page_url:string>>")).alias("n_rows"))


# --- fits


_NAMES = [f"page__{f}" for f in _PAGE_FEATURES] + ["company__headcount_growth", "company__tech_stack_count"] + [f"company__{f}" for f, x in _OFF.items() if x != "NULL"]
_CELLS = f"""WITH {wide_runs_sql()}, l AS (SELECT engine, n, bool_or(k > 2) AS a, bool_or(c > 0) AS c FROM measurements GROUP BY ALL),
cells AS (SELECT DISTINCT 'cat' || (n % 2) AS category, engine FROM l WHERE a OR c), names AS (SELECT unnest({_NAMES!r}) AS feature)"""


@query(_CELLS + " SELECT category, engine, list(feature ORDER BY feature) AS features FROM cells, names GROUP BY ALL")
def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.feature_names(_model_rows(spark, sf_dir), ["category", "engine"])


@query(_CELLS + f""", m AS (SELECT category, engine, feature, {_JITTER.format(x="engine || ':' || category || ':' || feature")} AS m FROM cells, names)
SELECT category, engine, feature, round(m, 6) AS posterior_median, round(m - abs(m) - 0.1, 6) AS ci_low, round(m + abs(m) + 0.1, 6) AS ci_high, true AS noise_flag FROM m""")
def dummy_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.dummy(_model_rows(spark, sf_dir)).select("category", "engine", "feature", r6("posterior_median"), r6("ci_low"), r6("ci_high"), "noise_flag")


_COEFFICIENTS = """WITH c AS (SELECT 'cat' || (s_nationkey % 2) AS category, 'e' || (s_nationkey % 3) AS engine, s_name AS feature, s_acctbal / 1000 AS m, s_acctbal / 1000 - 2 AS lo, s_acctbal / 1000 + 2 AS hi FROM supplier),
f AS (SELECT *, lo <= 0 AND hi >= 0 AS noise FROM c)"""


def _coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("s_acctbal") / 1000
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("cat"), (F.col("s_nationkey") % 2).cast("string")).alias("category"), F.concat(F.lit("e"), (F.col("s_nationkey") % 3).cast("string")).alias("engine"), F.col("s_name").alias("feature"), m.alias("posterior_median"), (m - 2).alias("ci_low"), (m + 2).alias("ci_high"))
    return s.withColumn("noise_flag", audit.crosses_zero(F.col("ci_low"), F.col("ci_high"))).withColumn("n_companies", F.lit(7))


@query(_COEFFICIENTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY category, engine ORDER BY least(abs(lo), abs(hi)) DESC, abs(m) DESC, feature) AS place FROM f WHERE NOT noise)
SELECT category, engine, feature, CAST(place AS INT) AS place FROM r WHERE place <= 3""")
def ranked_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.ranked(_coefficients(spark, sf_dir)).select("category", "engine", "feature", "place")


@query(_COEFFICIENTS + """ SELECT category, engine, feature, NOT noise AS survives, CAST(row_number() OVER (PARTITION BY category, engine, noise ORDER BY abs(m) DESC, feature) AS INT) AS place FROM f""")
def ranked_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.gaps(_coefficients(spark, sf_dir)).select("category", "engine", "feature", "survives", "place")


@query(_COEFFICIENTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY category, engine ORDER BY least(abs(lo), abs(hi)) DESC, abs(m) DESC, feature) AS place FROM f WHERE NOT noise),
t AS (SELECT category, engine, list('Pages with higher `' || feature || '` may be cited ' || CASE WHEN m >= 0 THEN 'more' ELSE 'less' END || ' often (hypothesis — test with an experiment)' ORDER BY place) AS top FROM r WHERE place <= 3 GROUP BY ALL)
SELECT f.category, f.engine, count(*) AS n_features_total, count(*) FILTER (noise) AS n_features_noise, count(*) FILTER (NOT noise) AS n_features_surviving, coalesce(any_value(top), []) AS top_hypotheses, CAST(1 AS INT) AS claim_rung
FROM f LEFT JOIN t USING (category, engine) GROUP BY ALL""")
def fit_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.payload(_coefficients(spark, sf_dir)).select("category", "engine", "n_features_total", "n_features_noise", "n_features_surviving", "top_hypotheses", "claim_rung")


@query("SELECT 'e' AS experiment_id, engine, count(*) AS n_complete_pairs FROM (SELECT l_linestatus AS engine, l_suppkey % 40 AS pair FROM lineitem WHERE l_quantity < 3 GROUP BY ALL HAVING count(DISTINCT (l_linenumber % 2) * 2 + CAST(l_returnflag = 'A' AS INT)) = 4) GROUP BY engine")
def complete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct((F.col("l_suppkey") % 40).alias("pair"), (F.col("l_linenumber") % 2).alias("side"))
    return lift.complete_pairs(table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.lit("e").alias("experiment_id"), F.col("l_linestatus").alias("engine"), F.array(place).alias("places"), (F.col("l_returnflag") == "A").cast("int").alias("post")))


@query(f"SELECT count(DISTINCT n_nationkey % 2) AS n_categories, count(*) AS n_companies, count(DISTINCT n_nationkey % 2) >= {fit.MIN_CATEGORIES} AND count(*) >= {fit.MIN_COMPANIES} AS ready FROM nation")
def pooled_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 2).alias("category"), F.col("n_name").alias("company_domain"))
    return fit.hierarchical_ready(n).select("n_categories", "n_companies", "ready")


# --- streams


def _streamed(spark: SparkSession, sf_dir: str, of) -> DataFrame:
    """The rows of a streaming aggregate over all that is there."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    page = F.concat(F.lit("https://site"), (F.floor(F.col("user_id") / 10) % 3).cast("string"), F.lit(".com/p"))
    s = s.select(F.concat(F.lit("q"), (F.col("user_id") % 10).cast("string")).alias("query_id"), page.alias("page_url"), F.col("event_type").alias("engine"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model_version"),
                 (F.col("value") > F.when(F.col("user_id") % 2 == 0, 300).otherwise(35)).alias("cited"), F.array(F.concat(F.lit("src"), (F.col("event_id") % 7).cast("string"), F.lit(".com"))).alias("source_domains"), F.col("event_id").alias("_seq"))
    name = f"streamed_{uuid.uuid4().hex}"
    of(s).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


_LOW, _HIGH = stats.sql_wilson("c", "k")


@query(f"""WITH {RUNS}, g AS (SELECT query_id, page_url, engine, CAST(count(*) AS DOUBLE) AS k, CAST(sum(CAST(cited AS INT)) AS DOUBLE) AS c, 'm' || (max(_seq) % 3) AS model_version FROM runs GROUP BY ALL)
SELECT query_id, page_url, engine, CAST(k AS BIGINT) AS k, CAST(c AS BIGINT) AS cited_count, model_version, round(c / k, 6) AS p_cited, round({_LOW}, 6) AS ci_low, round({_HIGH}, 6) AS ci_high FROM g""")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, streams.rates).select("query_id", "page_url", "engine", "k", "cited_count", "model_version", r6("p_cited"), r6("ci_low"), r6("ci_high"))


@query(f"WITH {RUNS} SELECT engine, count(*) FILTER (cited) AS cited, count(*) AS total, list_sort(list(DISTINCT source_domain) FILTER (cited)) AS sources FROM runs GROUP BY engine")
def stream_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, streams.board)


@query(f"""WITH {RUNS} SELECT engine, CASE page_url WHEN 'https://site0.com/p' THEN 'you' ELSE 'site1.com' END AS side, count(*) FILTER (cited) AS cited, count(*) AS total
FROM runs WHERE page_url IN ('https://site0.com/p', 'https://site1.com/p') GROUP BY ALL""")
def stream_head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: streams.sides(s, "www.site0.com", ["site1.com"]))
