"""Every query: a function of (spark, folder) and, where SQL can say it, DuckDB's SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import html, keys, stats
from attesta.operators import assembly, audit, board, fit, joins, lift, matching, measure, replay, sourcing
from attesta.plans import tables
from attesta.plans.tables import RUNS, companies, measurements, pages, runs, table
from attesta.sources import responses, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(name: str, c=None):
    return F.round(F.col(name) if c is None else c, 6).alias(name)


LOW, HIGH = stats.sql_wilson("c", "k")


# --- runs


@query(f"""WITH {RUNS}, g AS (
  SELECT query_id, page_url, engine, CAST(count(*) AS DOUBLE) AS k, CAST(sum(CAST(cited AS INT)) AS DOUBLE) AS c,
    avg(CASE WHEN cited AND position > 0 THEN 1.0 / position END) AS w, arg_max(model_version, _seq) AS model_version FROM runs GROUP BY ALL)
SELECT query_id, page_url, engine, CAST(k AS BIGINT) AS k, CAST(c AS BIGINT) AS cited_count, round(c / k, 6) AS p_cited, round({LOW}, 6) AS ci_low,
  round({HIGH}, 6) AS ci_high, round(coalesce(w, 0), 6) AS position_weight, model_version FROM g""")
def run_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = measure.aggregate_runs(runs(spark, sf_dir))
    return g.select("query_id", "page_url", "engine", "k", "cited_count", r6("p_cited"), r6("ci_low"), r6("ci_high"), r6("position_weight"), "model_version")


_FLIPS = f"""WITH {RUNS}, x AS (SELECT *, cited <> lag(cited) OVER (PARTITION BY query_id, page_url, engine ORDER BY run_idx, _seq) AS x FROM runs),
g AS (SELECT query_id, page_url, engine, CAST(count(*) AS DOUBLE) AS k, CAST(sum(CAST(cited AS INT)) AS DOUBLE) AS c, CAST(coalesce(sum(CAST(x AS INT)), 0) AS DOUBLE) AS t FROM x GROUP BY ALL),
f AS (SELECT query_id, page_url, engine, k, c, CASE WHEN k >= 2 THEN least(c, k - c) / k ELSE 0 END AS minority, CASE WHEN k >= 2 THEN t / (k - 1) ELSE 0 END AS transition,
  CASE WHEN k >= 2 AND c > 0 AND c < k THEN -(c / k * log2(c / k) + (1 - c / k) * log2(1 - c / k)) ELSE 0 END AS entropy, k >= 2 AND least(c, k - c) > 0 AS flipped FROM g)"""


@query(_FLIPS + """ SELECT query_id, page_url, engine, CAST(k AS BIGINT) AS k, CAST(c AS BIGINT) AS cited_count, round(minority, 6) AS minority_fraction,
  round(transition, 6) AS transition_rate, round(entropy, 6) AS entropy_bits, flipped FROM f""")
def flip_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = measure.flip_rates(runs(spark, sf_dir))
    return f.select("query_id", "page_url", "engine", "k", "cited_count", r6("minority_fraction"), r6("transition_rate"), r6("entropy_bits"), "flipped")


@query(_FLIPS + """ SELECT engine, count(*) FILTER (k >= 2) AS n_groups, count(*) FILTER (k < 2) AS n_insufficient, count(*) FILTER (flipped) AS n_flipped,
  round(count(*) FILTER (flipped) / count(*) FILTER (k >= 2), 6) AS flip_fraction, round(coalesce(avg(minority) FILTER (k >= 2), 0), 6) AS mean_minority,
  round(coalesce(avg(transition) FILTER (k >= 2), 0), 6) AS mean_transition, round(coalesce(avg(entropy) FILTER (k >= 2), 0), 6) AS mean_entropy,
  coalesce(array_to_string(list(query_id || '|' || page_url ORDER BY minority DESC, entropy DESC, query_id, page_url) FILTER (flipped), ','), '') AS unstable FROM f GROUP BY engine""")
def flip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = measure.flip_report(measure.flip_rates(runs(spark, sf_dir)))
    return f.select("engine", "n_groups", "n_insufficient", "n_flipped", r6("flip_fraction"), r6("mean_minority"), r6("mean_transition"), r6("mean_entropy"), F.array_join("unstable", ",").alias("unstable"))


@query(f"""WITH {RUNS}, v AS (SELECT query_id, engine, model_version, min(_seq) AS seen FROM runs GROUP BY ALL)
SELECT query_id, engine, string_agg(model_version, ',' ORDER BY seen, model_version) AS versions FROM v GROUP BY query_id, engine HAVING count(*) > 1""")
def model_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.drift(runs(spark, sf_dir)).withColumn("versions", F.array_join("versions", ","))


_STOPS = f"""WITH {RUNS}, p AS (
  SELECT query_id, engine, run_idx, CAST(count(*) OVER w AS DOUBLE) AS k, CAST(sum(CAST(cited AS INT)) OVER w AS DOUBLE) AS c FROM runs WHERE run_idx < 8
  WINDOW w AS (PARTITION BY query_id, engine, page_url ORDER BY run_idx ROWS UNBOUNDED PRECEDING)),
r AS (SELECT query_id, engine, run_idx, bool_or({LOW} < 0.5 AND {HIGH} > 0.5) AS doubt FROM p GROUP BY ALL),
stops AS (SELECT query_id, engine, coalesce(min(run_idx + 1) FILTER (run_idx + 1 >= 3 AND NOT doubt), max(run_idx + 1)) AS stop_k FROM r GROUP BY ALL)"""


@query(_STOPS + " SELECT query_id, engine, CAST(stop_k AS BIGINT) AS stop_k FROM stops")
def prefix_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.stop_runs(runs(spark, sf_dir))


@query(_STOPS + """ SELECT engine, CAST(sum(stop_k) AS BIGINT) AS calls, round(CAST(count(*) * 8 * 0.02 AS DOUBLE), 6) AS fixed_usd, round(CAST(sum(stop_k) * 0.02 AS DOUBLE), 6) AS realized_usd,
  round((count(*) * 8 - sum(stop_k)) / (count(*) * 8.0) * 100, 6) AS saved_pct FROM stops GROUP BY engine""")
def adaptive_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = replay.stop_runs(runs(spark, sf_dir)).groupBy("engine").agg(F.sum("stop_k").alias("calls"), F.count("*").alias("units"))
    x = measure.adaptive_saving(F.col("calls"), F.col("units"))
    return s.select("engine", "calls", r6("fixed_usd", x["fixed_usd"]), r6("realized_usd", x["realized_usd"]), r6("saved_pct", x["saved_pct"]))


@query(_STOPS + " SELECT query_id, engine, page_url, CAST(run_idx AS INT) AS run_idx, cited FROM runs JOIN stops USING (query_id, engine) WHERE run_idx < stop_k")
def replayed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replayed(runs(spark, sf_dir)).select("query_id", "engine", "page_url", "run_idx", "cited")


@query(f"""WITH {RUNS}, g AS (SELECT engine, page_url, CAST(count(*) AS DOUBLE) AS k, CAST(sum(CAST(cited AS INT)) AS DOUBLE) AS c FROM runs GROUP BY ALL)
SELECT engine, bool_or({LOW} < 0.5 AND {HIGH} > 0.5) AS ambiguous FROM g GROUP BY engine""")
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = measure.aggregate_runs(runs(spark, sf_dir), ["engine", "page_url"])
    return measure.ambiguous(g, ["engine"])


@query(f"""WITH {RUNS} SELECT engine, window_tag, count(*) AS n, count(*) FILTER (cited) AS n_cited, count(*) FILTER (page_url = 'https://site0.com/p') AS n_treatment,
  count(*) FILTER (page_url = 'https://site1.com/p') AS n_control FROM runs GROUP BY ALL""")
def experiment_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.array(F.struct(F.lit("https://site0.com/p").alias("treatment_page"), F.lit("https://site1.com/p").alias("control_page")))
    e = spark.range(1).select(F.lit("e").alias("id"), pair.alias("pairs"))
    r = measure.with_arm(runs(spark, sf_dir).withColumn("experiment_id", F.lit("e")), e)
    return r.groupBy("engine", "window_tag").agg(F.count("*").alias("n"), F.count_if("cited").alias("n_cited"), F.count_if(F.col("arm") == "treatment").alias("n_treatment"), F.count_if(F.col("arm") == "control").alias("n_control"))


# --- keys and pages


@query(f"SELECT page_id, {keys.sql_domain('url')} AS domain, {keys.sql_url('url')} AS key, {keys.sql_domain('url')} = url AS is_key FROM pages")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", keys.normalize_domain(u).alias("domain"), keys.normalize_url(u).alias("key"), keys.is_normalized_domain(u).alias("is_key"))


_NORMAL = "regexp_replace(lower(c_name || ' ' || c_mktsegment), '\\s+', ' ', 'g')"
_SLUG = f"regexp_replace(regexp_replace(substr(regexp_replace(regexp_replace({_NORMAL}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', ''), '^$', '')"


@query(f"""SELECT c_custkey, {keys.sql_fnv1a('c_name')} AS hash, 'q-' || {_SLUG} || '-' || {keys.sql_fnv1a(_NORMAL)} AS query_id,
  {keys.sql_fnv1a("least(lower(c_name), lower(c_mktsegment)) || chr(10) || greatest(lower(c_name), lower(c_mktsegment))")} AS terms_hash FROM customer""")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", keys.fnv1a(F.col("c_name")).alias("hash"), keys.query_id(F.concat_ws("  ", "c_name", "c_mktsegment")).alias("query_id"), keys.terms_hash(F.array("c_name", F.lit(" "), "c_mktsegment")).alias("terms_hash"))


@query(f"""WITH p AS (SELECT {keys.sql_domain('url')} AS domain, count(*) AS n FROM pages GROUP BY 1)
SELECT domain, n, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () > 0.5 AS offender FROM p WHERE domain <> ''""")
def pool_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = measure.pool_composition(table(spark, sf_dir, "pages").select(F.col("url").alias("page_url")))
    return p.select("domain", "n", r6("share"), "offender")


_STRIPPED = "regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g')"
for _tag in ("style", "noscript"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_STRIPPED = f"regexp_replace({_STRIPPED}, '<[^>]+>', ' ', 'g')"
for _name, _char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''")):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?i)&{_name};', '{_char}', 'g')"
_TEXT = f"trim(regexp_replace({_STRIPPED}, '{keys.SQL_BLANK}+', ' ', 'g'))"


@query(f"""SELECT page_id, md5({_TEXT}) AS text_md5, CAST(len(list_filter(string_split({_TEXT}, ' '), lambda x: x <> '')) AS BIGINT) AS words,
  CAST(len(regexp_extract_all(html, '(?i)<h[123]\\b')) AS BIGINT) AS headings, regexp_matches(html, '(?i)application/ld\\+json') AS schema_markup FROM pages""")
def html_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(html.to_text(h)).alias("text_md5"), html.features(h, F.lit("2026-01-01"), F.array())["word_count"].cast("long").alias("words"),
        html.heading_count(h).cast("long").alias("headings"), html.has_schema_markup(h).alias("schema_markup"),
    )


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 2 = 0 AS schema_markup, n_nationkey % 5 >= 3 AS comparison_table,
  CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey WHEN n_nationkey % 3 = 1 THEN n_nationkey + 1 ELSE 0 END AS BIGINT) AS freshness_days FROM nation""")
def html_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    day = lambda d: F.date_format(F.date_sub(F.lit("2026-01-31").cast("date"), d), "yyyy-MM-dd")
    cells = F.repeat(F.lit("<TH scope=col>h</th>"), (n % 5).cast("int"))
    body = F.concat(
        F.when(n % 2 == 0, F.lit('<script type="application/ld+json" id="x">{}</script>')).otherwise(""),
        F.when(n % 3 == 0, F.concat(F.lit('<meta property="article:modified_time" content="'), day(n), F.lit('">'))).when(n % 3 == 1, F.concat(F.lit("<time datetime='"), day(n + 1), F.lit("'>x</time>"))).otherwise(""),
        F.lit("<table><tr>"), cells, F.lit("</tr><tr><td>1</td></tr>\n<tr><td>2</td></tr></table>"),
    )
    p = table(spark, sf_dir, "nation").withColumn("html", body)
    f = html.features(F.col("html"), F.lit("2026-01-31"), F.array())
    return p.select(n.cast("long").alias("id"), f["schema_markup"].alias("schema_markup"), f["comparison_table"].alias("comparison_table"), f["freshness_days"].cast("long").alias("freshness_days"))


@query("""SELECT doc_id, round((CAST(contains(lower(text), 'the of') AS INT) + CAST(regexp_matches(lower(text), '(^|[^a-z0-9])and([^a-z0-9]|$)') AS INT)
  + CAST(regexp_matches(lower(text), '(^|[^a-z0-9])que([^a-z0-9]|$)') AS INT)) / 3.0, 6) AS coverage FROM documents""")
def query_term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(F.lit("The of"), F.lit("and"), F.lit(" AND "), F.lit("que"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", r6("coverage", html.term_coverage(F.col("text"), terms)))


@query("""SELECT s_suppkey, CAST(1 AS INT) AS rank, 'https://www.a' || s_suppkey || '.com/x' AS url, 'a' || s_suppkey || '.com' AS domain, 'one two' AS answer FROM supplier
UNION ALL SELECT s_suppkey, 2, 'https://b.co.uk/' || s_nationkey, 'b.co.uk', 'one two' FROM supplier""")
def response_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = lambda u: F.struct(F.lit("url_citation").alias("type"), u.alias("url"), F.lit("t").alias("title"))
    a = F.concat(F.lit("https://www.a"), F.col("s_suppkey").cast("string"), F.lit(".com/x"))
    b = F.concat(F.lit("https://b.co.uk/"), F.col("s_nationkey").cast("string"))
    part = lambda t, *m: F.struct(F.lit("output_text").alias("type"), F.lit(t).alias("text"), F.array(*m).alias("annotations"))
    raw = F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct(F.lit("message").alias("type"), F.array(part("one ", mark(a), mark(a)), part("two", mark(b), mark(a))).alias("content"))).alias("output")))
    s = table(spark, sf_dir, "supplier").withColumn("raw", raw)
    return s.select("s_suppkey", F.explode(responses.citations(F.col("raw"))).alias("c"), responses.answer_text(F.col("raw")).alias("answer")).select("s_suppkey", F.col("c.rank").alias("rank"), "c.url", "c.domain", "answer")


@query("""WITH c AS (SELECT s_suppkey AS q, (s_suppkey + 1) % 4 AS d FROM supplier)
SELECT 'q' || q AS query_id, 'https://site' || n || '.com/p' AS page_url, n = d AS cited, CASE WHEN n = d THEN 1 END AS position, n = d OR n = 3 AS appeared
FROM c, (SELECT unnest(range(0, 4)) AS n)""")
def labeled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ((F.col("s_suppkey") + 1) % 4).cast("string")
    cite = F.array(F.struct(F.lit(1).alias("rank"), F.concat(F.lit("https://blog.site"), d, F.lit(".com/z")).alias("url"), F.concat(F.lit("site"), d, F.lit(".com")).alias("domain")))
    results = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("query_id"), F.lit("chatgpt").alias("engine"), F.lit("m").alias("model_version"), F.lit(0).alias("run_idx"),
        cite.alias("citations"), F.lit("See SITE3.com").alias("answer_text"), F.lit(0).cast("long").alias("ts"), F.lit(None).cast("string").alias("window_tag"),
    )
    pool = results.select("query_id", F.explode(F.array(*[F.lit(f"https://site{i}.com/p") for i in range(4)], F.lit("  "))).alias("page_url"))
    return measure.labeled_rows(results, pool).select("query_id", "page_url", "cited", "position", "appeared")


@query("""SELECT 'https://site' || n_nationkey || '.com/p' AS page_url, n_nationkey % 3 = 0 AS winner FROM nation""")
def case_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    cited = n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("WWW.site"), F.col("n_nationkey").cast("string"), F.lit(".com")).alias("domain"))
    return measure.case_control(cited, n.select(F.concat(F.lit("https://site"), F.col("n_nationkey").cast("string"), F.lit(".com/p")).alias("page_url"))).select("page_url", "winner")


@query(f"""WITH {RUNS}, g AS (SELECT query_id, page_url, engine, avg(CAST(cited AS INT)) AS p FROM runs GROUP BY ALL)
SELECT query_id, engine, page_url, 'c' || regexp_extract(page_url, 'site([0-9])', 1) AS company_domain, CASE WHEN p >= 0.5 THEN 'winner' ELSE 'loser' END AS label_majority
FROM g WHERE page_url <> 'https://site2.com/p'""")
def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = spark.createDataFrame([("https://site0.com/p", "old", 0), ("https://site0.com/p", "c0", 1), ("https://site1.com/p", "c1", 2)], "page_url string, company_domain string, _seq long")
    good, _ = measure.label_table(measure.aggregate_runs(runs(spark, sf_dir)), pool)
    return good.select("query_id", "engine", "page_url", "company_domain", "label_majority")


# --- joins, dedupe, caps


def _shops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    key = lambda x: F.concat(F.lit("shop"), x.cast("string"), F.lit(".com"))
    own = c.select(key(F.col("c_custkey") - F.col("c_custkey") % 2).alias("domain"), F.col("c_name").alias("name"), F.col("c_custkey").alias("_seq"))
    p = table(spark, sf_dir, "orders").select(F.concat(F.lit("https://www."), key(F.col("o_custkey")), F.lit("/o")).alias("company_domain"), F.col("o_orderkey").cast("string").alias("url"))
    return p, own


_SHOPS = """c AS (SELECT c_custkey - c_custkey % 2 AS d, c_name, c_custkey FROM customer WHERE c_custkey % 3 <> 0), p AS (SELECT o_custkey AS d, CAST(o_orderkey AS VARCHAR) AS url FROM orders)"""


@query(f"""WITH {_SHOPS}
SELECT 'orphan_page' AS issue, url AS key FROM p WHERE d NOT IN (SELECT d FROM c)
UNION ALL SELECT 'childless_company', 'shop' || d || '.com' FROM (SELECT DISTINCT d FROM c) WHERE d NOT IN (SELECT d FROM p)
UNION ALL SELECT 'duplicate_domain', 'shop' || d || '.com' FROM (SELECT d, row_number() OVER (PARTITION BY d ORDER BY c_custkey) AS n FROM c) WHERE n > 1""")
def join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_report(*_shops(spark, sf_dir))


@query(f"""WITH {_SHOPS}, f AS (SELECT d, arg_min(c_name, c_custkey) AS first_name, arg_max(c_name, c_custkey) AS last_name FROM c GROUP BY d)
SELECT url, first_name, last_name FROM p LEFT JOIN f USING (d)""")
def audited_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _shops(spark, sf_dir)
    first = joins.pages_with_companies(p, c, "first").select("url", F.col("c_name").alias("first_name"))
    last = joins.pages_with_companies(p, c, "last").select("url", F.col("c_name").alias("last_name"))
    return first.join(last, "url")


@query("""WITH r AS (SELECT source, n_chars, doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents),
b AS (SELECT source AS query_id, 'https://d' || (n_chars % 50) || '.com' AS page_url, CAST(min(n_chars) AS DOUBLE) AS rank, min(doc_id) AS s FROM documents GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, s) AS place FROM b)
SELECT query_id, page_url, rank, CAST(place AS INT) AS place FROM l WHERE place <= 10""")
def topn_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.concat(F.lit("d"), (F.col("n_chars") % 50).cast("string"), F.lit(".com/")).alias("url"), F.col("n_chars").alias("rank"), F.col("doc_id").alias("_seq"))
    return sourcing.candidate_pool(d)


@query("SELECT p_name, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("_seq", F.col("p_partkey"))
    return store.first_seen(p, ["p_name"]).select("p_name", "p_partkey", "p_brand")


_SEEDS = """s AS (SELECT lower(p_name || ' ' || p_type || ' ' || (p_partkey % 40)) AS text, CASE p_partkey % 4 WHEN 0 THEN 'serp' WHEN 1 THEN 'reddit' ELSE 'llm_expand' END AS seed_source, p_partkey AS _seq FROM part),
one AS (SELECT text, arg_min(seed_source, (CASE WHEN seed_source = 'llm_expand' THEN 1 ELSE 0 END) * 1000000000 + _seq) AS seed_source, min((CASE WHEN seed_source = 'llm_expand' THEN 1 ELSE 0 END) * 1000000000 + _seq) % 1000000000 AS _seq FROM s GROUP BY text)"""


@query(f"""WITH {_SEEDS}, l AS (SELECT *, row_number() OVER (PARTITION BY seed_source = 'llm_expand' ORDER BY _seq) AS l FROM one)
SELECT text, seed_source, _seq FROM l WHERE seed_source <> 'llm_expand' OR l <= floor((SELECT count(*) FROM one WHERE seed_source <> 'llm_expand') * 0.6 / 0.4 + 1e-9)""")
def cap_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcing.generated_queries(_seeds(spark, sf_dir)).select(keys.normalize_text(F.col("text")).alias("text"), "seed_source", "_seq")


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat_ws("  ", "p_name", "p_type", (k % 40).cast("string")).alias("text"), F.when(k % 4 == 0, "serp").when(k % 4 == 1, "reddit").otherwise("llm_expand").alias("seed_source"), k.alias("_seq"), F.col("p_brand").alias("vertical")
    )


@query("""SELECT p_brand AS vertical, count(*) AS n, count(*) FILTER (p_partkey % 4 IN (0, 1)) AS n_real, count(*) FILTER (p_partkey % 4 IN (2, 3)) AS n_llm,
  round(count(*) FILTER (p_partkey % 4 IN (0, 1)) / count(*), 6) AS real_ratio, count(*) FILTER (p_partkey % 4 IN (2, 3)) / count(*) > 0.5 AS llm_too_high FROM part GROUP BY p_brand""")
def seed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sourcing.seed_ratio(_seeds(spark, sf_dir), ["vertical"])
    return s.select("vertical", "n", "n_real", "n_llm", r6("real_ratio"), "llm_too_high")


@query("""WITH u AS (
  SELECT n_nationkey % 10 AS d, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS name, CASE WHEN n_nationkey < 1 THEN 0 WHEN n_nationkey < 8 THEN 1 ELSE 2 END AS p, n_nationkey AS s FROM nation)
SELECT 'site' || d || '.com' AS domain, coalesce(arg_min(name, p * 1000 + s) FILTER (name IS NOT NULL), 'site' || d || '.com') AS name,
  CASE min(p) WHEN 0 THEN 'customer' WHEN 1 THEN 'competitor' ELSE 'battlefield' END AS role FROM u GROUP BY d""")
def company_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    d = table(spark, sf_dir, "nation").select(F.concat(F.lit("www.site"), (n % 10).cast("string"), F.lit(".com")).alias("domain"), F.when(n % 4 == 0, F.lit(None)).otherwise(F.col("n_name")).alias("name"), n.cast("long").alias("_seq"))
    out = sourcing.company_layer(d.where("_seq < 1"), d.where("_seq between 1 and 7"), d.where("_seq >= 8"))
    return out.select("domain", "name", "role")


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS s, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 100 AS actual, CAST(120 AS BIGINT) AS worst FROM orders),
b AS (SELECT *, coalesce(sum(actual) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM o),
c AS (SELECT min(s) AS stop FROM b WHERE spent + worst > 40000)
SELECT o_orderkey, CAST(spent AS BIGINT) AS spent_before, stop IS NULL OR s < stop AS done FROM b, c""")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = replay.numbered(table(spark, sf_dir, "orders"), F.to_date("o_orderdate"), ["o_orderdate", "o_orderkey"])
    o = o.select("o_orderkey", "_seq", (F.floor("o_totalprice").cast("long") % 100).alias("actual"), F.lit(120).cast("long").alias("worst"))
    return replay.budget_cut(o, 40_000).select("o_orderkey", "spent_before", "done")


@query("""SELECT event_type AS engine, count(*) AS asked, count(*) FILTER (event_type = 'error') AS skipped_no_adapter, count(*) FILTER (event_type = 'view') AS skipped_no_key,
  count(*) FILTER (event_type NOT IN ('error', 'view') AND user_id % 5 = 0) AS failed, count(*) FILTER (event_type NOT IN ('error', 'view') AND user_id % 5 <> 0) AS ok
FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY event_type""")
def dispatch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("engine")).distinct()
    q = e.groupBy("query_id").agg(F.collect_set("engine").alias("target_engines"))
    registry = e.select("engine").distinct().where("engine <> 'error'").withColumn("has_key", F.col("engine") != "view")
    results = e.withColumn("error", F.when(F.col("query_id") % 5 == 0, "HTTP 503"))
    d = replay.dispatched(q, registry, results)
    counts = {s: F.count_if(F.col("status") == s).alias(s) for s in ("skipped_no_adapter", "skipped_no_key", "failed", "ok")}
    return d.groupBy("engine").agg(F.count("*").alias("asked"), *counts.values())


@query("""WITH r AS (SELECT o_orderkey AS s, o_custkey % 50 AS k, o_orderkey FROM orders), c AS (SELECT k, k % 3 = 0 AS fresh FROM (SELECT unnest(range(0, 50)) AS k)),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) AS n FROM r)
SELECT count(*) FILTER (fresh OR n > 1) AS hits, count(*) FILTER (NOT (fresh OR n > 1)) AS misses FROM n JOIN c USING (k)""")
def page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 86_400_000
    req = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_seq"), (F.col("o_custkey") % 50).cast("string").alias("reuse_key"), F.lit("v1").alias("extractor"))
    k = F.col("id")
    cache = spark.range(50).select(
        k.cast("string").alias("reuse_key"), F.when(k % 3 == 1, "v0").otherwise("v1").alias("extractor"),
        F.when(k % 3 == 2, F.lit(60 * day)).otherwise(F.lit(100 * day - 30 * day)).alias("scraped_at"), F.lit("u").alias("page_url"),
    )
    return replay.cache_counts(replay.cached(req, cache, 100 * day))


# --- board


@query(f"""WITH {RUNS} SELECT engine, count(*) FILTER (cited) AS cited, count(*) AS total, array_to_string(list_sort(list(DISTINCT source_domain) FILTER (cited)), ',') AS sources FROM runs GROUP BY engine""")
def citation_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.citation_board(runs(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {RUNS}, s AS (SELECT engine, regexp_extract(page_url, 'site[0-9]', 0) || '.com' AS d, count(*) FILTER (cited) AS c, count(*) AS t, min(_seq) AS s FROM runs GROUP BY ALL),
top AS (SELECT engine, arg_max(d, c * 1000000000 - s) AS top_domain, arg_max(c, c * 1000000000 - s) AS top_cited, arg_max(t, c * 1000000000 - s) AS top_total FROM s WHERE d <> 'site0.com' GROUP BY engine)
SELECT engine, c AS you_cited, t AS you_total, top_domain, top_cited, top_total,
  (SELECT string_agg(d || ':' || c || '/' || t, ',' ORDER BY d) FROM s r WHERE r.engine = s.engine AND d <> 'site0.com') AS competitors,
  (SELECT string_agg(DISTINCT source_domain, ',' ORDER BY source_domain) FROM runs r WHERE r.engine = s.engine) AS sources, 'you ' || c || ' / ' || t || ' · top competitor ' || top_domain || ' ' || top_cited || '/' || top_total AS headline
FROM s JOIN top USING (engine) WHERE d = 'site0.com'""")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = board.head_to_head(runs(spark, sf_dir), F.lit("https://www.Site0.com/"), F.array(F.lit("site1.com"), F.lit("site2.com")))
    sides = F.transform("competitors", lambda s: F.concat(s["domain"], F.lit(":"), s["cited"].cast("string"), F.lit("/"), s["total"].cast("string")))
    return h.withColumn("competitors", F.array_join(sides, ",")).withColumn("sources", F.array_join("sources", ","))


@query("""SELECT 'w' || r_regionkey AS workspace_id, CAST(CASE WHEN r_regionkey = 0 THEN 2 WHEN r_regionkey IN (1, 2) THEN 1 ELSE 0 END AS INT) AS rung,
  CASE WHEN r_regionkey = 0 THEN 'Causal (experiment)' WHEN r_regionkey IN (1, 2) THEN 'Hypothesis' ELSE 'Measured' END AS badge, CAST(CASE WHEN r_regionkey = 0 THEN 1 ELSE 0 END AS INT) AS n_lifts FROM region""")
def claim_rung(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "region").select(F.concat(F.lit("w"), F.col("r_regionkey").cast("string")).alias("workspace_id"), "r_regionkey")
    d = board.diagnosis(w, w.where("r_regionkey < 3"), w.where("r_regionkey = 0").withColumn("experiment_id", F.lit("e")))
    return d.select("workspace_id", "rung", "badge", F.size("lifts").alias("n_lifts"))


@query("SELECT 'companies' AS table_name, count(*) AS n_rows FROM nation UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'measurements', count(*) FROM events")
def workspace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.summary(companies=table(spark, sf_dir, "nation"), pages=table(spark, sf_dir, "pages"), measurements=table(spark, sf_dir, "events"))


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as run records: a cycle a month, spend in hundred-thousandths of the price."""
    o = table(spark, sf_dir, "orders")
    calls = F.struct(F.count("*").cast("int").alias("calls"), F.count_if(F.col("o_orderstatus") == "F").cast("int").alias("errors"))
    e = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("cycle"), "o_orderpriority").agg(calls.alias("v"), F.sum(F.round("o_totalprice").cast("long")).alias("s"), F.count_distinct("o_custkey").alias("q"))
    return e.groupBy("cycle").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "v"))).alias("per_engine"), (F.sum("s") / 100_000.0).alias("spend_usd"), F.sum("v.calls").alias("calls_made"), F.sum("q").alias("queries_issued"))


_CYCLES = """e AS (SELECT strftime(o_orderdate, '%Y-%m') AS cycle, o_orderpriority AS engine, count(*) AS calls, count(*) FILTER (o_orderstatus = 'F') AS errors, sum(CAST(round(o_totalprice) AS BIGINT)) AS s, count(DISTINCT o_custkey) AS q FROM orders GROUP BY ALL),
c AS (SELECT cycle, CAST(sum(s) AS DOUBLE) / 100000.0 AS spend, sum(calls) AS calls, sum(q) AS q FROM e GROUP BY cycle)"""


@query(f"""WITH {_CYCLES} SELECT count(*) AS cycles, floor(sum(spend) * 100 + 0.5) / 100 AS total_spend, CAST(sum(calls) AS BIGINT) AS total_calls, CAST(sum(q) AS BIGINT) AS total_queries,
  floor(sum(spend) / count(*) * 100 + 0.5) / 100 AS avg_spend_per_cycle, count(*) FILTER (spend > 120) AS over_budget_cycles, count(*) FILTER (spend > 120) = 0 AS within_budget FROM c""")
def ops_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.ops_totals(_cycles(spark, sf_dir))


@query(f"WITH {_CYCLES} SELECT engine, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors, round(sum(errors) / sum(calls), 6) AS error_rate FROM e GROUP BY engine")
def ops_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.ops_errors(_cycles(spark, sf_dir)).select("engine", "calls", "errors", r6("error_rate"))


@query(f"""WITH {_CYCLES} SELECT cycle, floor(spend / 120 * 100 + 0.5) / 100 AS pct, CASE WHEN spend / 120 >= 1 THEN 'over' WHEN spend / 120 >= 0.8 THEN 'warn' ELSE 'ok' END AS status FROM c""")
def budget_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = board.budget_health(F.col("spend_usd"))
    return _cycles(spark, sf_dir).select("cycle", h["pct"].alias("pct"), h["status"].alias("status"))


@query(f"""WITH {RUNS}, g AS (SELECT engine, CAST(count(*) AS DOUBLE) AS k, CAST(sum(CAST(cited AS INT)) AS DOUBLE) AS c FROM runs GROUP BY engine)
SELECT engine, CAST(floor(c / k * 100 + 0.5) AS BIGINT) || '% (CI ' || CAST(floor({LOW} * 100 + 0.5) AS BIGINT) || '%–' || CAST(floor({HIGH} * 100 + 0.5) AS BIGINT) || '%)' AS label FROM g""")
def rate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = measure.aggregate_runs(runs(spark, sf_dir), ["engine"])
    text = stats.rate_with_interval(F.col("p_cited"), F.col("ci_low"), F.col("ci_high"))
    return g.select("engine", text.alias("label"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 AND date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') >= 14 THEN 'expired' WHEN o_orderkey % 3 = 0 THEN 'awaiting_publish' ELSE 'running' END AS status FROM orders""")
def expired_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "awaiting_publish").otherwise("running").alias("status"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("awaiting_since"))
    return board.expire_stale(e, 946_684_800_000).select("id", "status")


@query("""WITH x AS (SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS last_order, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey, last_order, CASE WHEN last_order IS NOT NULL THEN 'result_ready' END AS nudge FROM customer LEFT JOIN x ON c_custkey = o_custkey""")
def latest_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.array(F.struct(F.lit("t").alias("treatment_page"), F.lit("c").alias("control_page")))
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("complete").alias("status"), pair.alias("pairs"))
    lifts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("experiment_id"), F.col("o_orderkey").alias("lift_id"), F.col("o_orderkey").alias("_seq"))
    v = board.customer_view(e, lifts)
    return joins.with_latest_lift(v, lifts).select(F.col("id").alias("c_custkey"), F.col("lift.lift_id").alias("last_order"), "nudge")


@query("""SELECT 'site' || (s_suppkey % 20) || '.com' AS domain, arg_max(s_name, s_suppkey) AS name, arg_max(CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey END, s_suppkey) FILTER (s_nationkey % 2 = 0) AS nation FROM supplier GROUP BY ALL""")
def upserted_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(
        F.lit("w").alias("workspace_id"), F.concat(F.lit("https://www.Site"), (F.col("s_suppkey") % 20).cast("string"), F.lit(".com/about")).alias("domain"), F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")).alias("nation"), F.col("s_suppkey").alias("_seq"),
    )
    return store.upserted_companies(s).select("domain", "name", "nation")


# --- coverage and agreement


@query("""SELECT 'site' || n_nationkey || '.com' AS domain, round((CAST(n_nationkey % 3 <> 0 AS INT) + CAST(n_nationkey % 4 <> 0 AS INT) + 1) / 3.0, 6) AS coverage_score,
  (CAST(n_nationkey % 3 <> 0 AS INT) + CAST(n_nationkey % 4 <> 0 AS INT) + 1) / 3.0 < 0.5 AS low_coverage,
  CASE WHEN n_nationkey % 12 = 0 THEN 'firmographics_missing,offpage_missing' WHEN n_nationkey % 3 = 0 THEN 'firmographics_missing' WHEN n_nationkey % 4 = 0 THEN 'offpage_missing' ELSE '' END AS flags,
  CAST(CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 6 END AS INT) AS n_offpage FROM nation""")
def company_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = companies(spark, sf_dir)
    flags = sourcing.reconciled_flags(c).select("domain", F.array_join("coverage_flags", ",").alias("flags"))
    off = sourcing.offpage_coverage(c).select("domain", F.col("n_present").alias("n_offpage"))
    cov = sourcing.coverage(c, "domain", "company").select(F.col("key").alias("domain"), r6("coverage_score"), "low_coverage")
    return cov.join(flags, "domain").join(off, "domain")


@query("""WITH c AS (SELECT 'company' AS kind, 'site' || n_nationkey || '.com' AS key, list_filter([CASE WHEN n_nationkey % 3 = 0 THEN 'firmographics' END, CASE WHEN n_nationkey % 4 = 0 THEN 'offpage' END], lambda x: x IS NOT NULL) AS missing, 3 AS families FROM nation
UNION ALL SELECT 'page', 'HTTPS://www.site' || n_nationkey || '.com/p/?utm_source=x', list_filter([CASE WHEN n_nationkey % 6 = 0 THEN 'subjective_features' END], lambda x: x IS NOT NULL), 2 FROM nation),
r AS (SELECT *, 1 - len(missing) / families AS score FROM c)
SELECT count(*) AS n, count(*) FILTER (score < 0.5) AS n_low, count(*) = 2 * (SELECT count(*) FROM nation) AS passed FROM r""")
def coverage_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = companies(spark, sf_dir), pages(spark, sf_dir)
    return sourcing.coverage_passed(sourcing.coverage_sweep(c, p), c, p)


@query("""WITH c AS (SELECT quality AS p, toxic AS g, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n) FILTER (p = g) AS same FROM c),
a AS (SELECT p AS v, sum(n) AS a FROM c GROUP BY p), b AS (SELECT g AS v, sum(n) AS b FROM c GROUP BY g), e AS (SELECT sum(a * b) AS ab FROM a JOIN b USING (v))
SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS agreement, round((same / n - ab / n / n) / (1 - ab / n / n), 6) AS kappa FROM t, e""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels").select(F.col("quality").alias("predicted"), F.col("toxic").alias("gold"))
    return sourcing.kappa(x, []).select("n", r6("agreement"), r6("kappa"))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(CAST(abs(l_quantity - 25) <= 10 AS INT)), 6) AS within FROM lineitem GROUP BY l_returnflag""")
def tolerance_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("predicted"), F.lit(25.0).alias("gold"))
    return sourcing.within_tolerance(x, ["l_returnflag"], 10.0).select("l_returnflag", "n", r6("within"))


# --- modelling, design, lift


@query(f"""WITH {tables.wide_runs_sql()} SELECT engine, page_url, round(avg(p_cited), 6) AS p_cited, round(greatest(0, avg(ci_high) - avg(ci_low)), 6) AS ci_width FROM measurements GROUP BY ALL""")
def page_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.page_rollup(measurements(spark, sf_dir)).select("engine", F.col("_url").alias("page_url"), r6("p_cited"), r6("ci_width"))


@query(f"""WITH {tables.wide_runs_sql()}, l AS (SELECT engine, n, bool_or(k > 2) AS a, bool_or(c > 0) AS c FROM measurements GROUP BY ALL)
SELECT 'cat' || (n % 2) AS category, engine, count(*) AS n_rows, count(*) AS n_companies, count(*) FILTER (c) AS n_winners FROM l WHERE a OR c GROUP BY ALL""")
def modeling_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.table_summary(assembly.modeling_rows(measurements(spark, sf_dir), pages(spark, sf_dir), companies(spark, sf_dir)))


@query("""WITH v AS (SELECT l_suppkey, list_sort(list(DISTINCT CAST(l_linenumber AS DOUBLE))) AS a FROM lineitem WHERE l_suppkey % 7 = 0 GROUP BY l_suppkey)
SELECT 'c' || l_suppkey AS company_domain, 'company__line' AS feature, a AS "values", false AS some_null FROM v WHERE len(a) > 1""")
def feature_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey").cast("string")
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 7 = 0").select(F.concat(F.lit("c"), s).alias("company_domain"), F.create_map(F.lit("company__line"), F.col("l_linenumber").cast("double"), F.lit("company__id"), F.col("l_suppkey").cast("double"), F.lit("page__q"), F.col("l_quantity")).alias("features"))
    return assembly.inheritance_violations(rows)


@query("""SELECT a.s_nationkey % 5 AS engine, a.s_suppkey AS a, b.s_suppkey AS b, round(abs(a.p - b.p), 6) AS gap
FROM (SELECT *, (s_acctbal + 1000) / 12000 AS p FROM supplier) a JOIN (SELECT *, (s_acctbal + 1000) / 12000 AS p FROM supplier) b
ON a.s_nationkey % 5 = b.s_nationkey % 5 AND a.s_suppkey <> b.s_suppkey AND abs(a.p - b.p) <= 0.15 AND a.s_suppkey % 3 <> b.s_suppkey % 3""")
def tolerance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = matching.edges(_matchable(spark, sf_dir))
    return e.select(F.col("engine").cast("int").alias("engine"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), r6("gap"))


def _matchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (F.col("s_nationkey") % 5).cast("string").alias("engine"), k.cast("string").alias("page_url"), (k % 11).cast("string").alias("company_domain"), ((F.col("s_acctbal") + 1000) / 12000).alias("p_cited"),
        F.lit(None).cast("string").alias("content"), F.array((k % 3).cast("string")).alias("queries"), (k % 3).cast("string").alias("cluster"),
    )


@query()
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matched(_matchable(spark, sf_dir))


@query()
def experiment_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.designed(matching.matched(_matchable(spark, sf_dir), max_pairs=8), "exp", "cust", seed=7, target_feature="page__word_count")


@query("""WITH c AS (SELECT l_linestatus, avg(l_discount) FILTER (l_returnflag = 'A' AND l_linenumber <= 3) AS y10, avg(l_discount) FILTER (l_returnflag = 'A' AND l_linenumber > 3) AS y11,
  avg(l_discount) FILTER (l_returnflag <> 'A' AND l_linenumber <= 3) AS y00, avg(l_discount) FILTER (l_returnflag <> 'A' AND l_linenumber > 3) AS y01 FROM lineitem GROUP BY l_linestatus)
SELECT l_linestatus, round(y00, 6) AS y00, round(y01, 6) AS y01, round(y10, 6) AS y10, round(y11, 6) AS y11, round((y11 - y10) - (y01 - y00), 6) AS did FROM c""")
def simple_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "A").cast("int").alias("treatment"), (F.col("l_linenumber") > 3).cast("int").alias("post"), F.col("l_discount").alias("y"))
    d = lift.simple_did(p, ["l_linestatus"])
    return d.select("l_linestatus", *[r6(c) for c in ("y00", "y01", "y10", "y11", "did")])


@query("""SELECT CASE WHEN day(ts) <= 15 THEN 'baseline' ELSE 'post' END || ':' || strftime(ts, '%G-W%V') AS period, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT 'order:' || strftime(o_orderdate, '%G-W%V'), count(*) FROM orders GROUP BY 1""")
def iso_week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    e = runs(spark, sf_dir).groupBy(lift.period_key(F.col("window_tag"), none, F.col("ts")).alias("period")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").groupBy(lift.period_key(F.lit("order"), none, F.col("o_orderdate").cast("timestamp")).alias("period")).agg(F.count("*").alias("n"))
    return e.unionByName(o)


def _experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    covars = F.create_map(F.lit("target_feature"), F.lit("page__word_count"))
    url = lambda i: F.concat(F.lit("https://site"), F.lit(str(i)), F.lit(".com/p"))
    pairs = F.array(*[F.struct(url(2 * i).alias("treatment_page"), url(2 * i + 1).alias("control_page"), covars.alias("match_covars")) for i in range(12)])
    return spark.range(1).select(F.lit("exp").alias("id"), pairs.alias("pairs"))


def _lift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("page_url", F.concat(F.lit("https://site"), (F.col("user_id") % 25).cast("string"), F.lit(".com/p")))
    return r.select("page_url", "engine", "window_tag", F.lit(None).cast("double").alias("p_cited"), "cited", F.lit(None).cast("string").alias("period"), "ts")


@query()
def experiment_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.estimated(_experiments(spark, sf_dir), _lift_rows(spark, sf_dir))


@query()
def lift_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.interventions(experiment_lift(spark, sf_dir), _experiments(spark, sf_dir), "cat0", 0)


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.modeling_rows(measurements(spark, sf_dir), pages(spark, sf_dir), companies(spark, sf_dir))


@query()
def baseline_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.fitted(_model_rows(spark, sf_dir), "baseline")


@query()
def horseshoe_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.fitted(_model_rows(spark, sf_dir), "horseshoe")


@query()
def top_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.payload(baseline_fit(spark, sf_dir))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'rung' WHEN 2 THEN 'verdict' ELSE 'ci_order,inconclusive_as_worked' END AS violations FROM orders""")
def lift_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(k == 1, 1).otherwise(2).alias("claim_rung"), F.when(k == 2, "great").when(k == 3, "inconclusive").otherwise("worked").alias("verdict"),
        F.lit(0.1).alias("ci_low"), F.when(k == 3, 0.0).otherwise(0.2).alias("ci_high"), F.lit("worked").alias("claimed_verdict"),
    )
    return audit.audited_lifts(rows).select("id", F.array_join("violations", ",").alias("violations"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 4 WHEN 0 THEN 'model_fit' WHEN 1 THEN 'lift_result' WHEN 2 THEN 'intervention' ELSE 'unknown' END AS kind,
  CASE p_partkey % 4 WHEN 0 THEN 'rung_too_high,causal_field:claim_rung' WHEN 3 THEN 'no_shape' ELSE '' END AS violations FROM part""")
def ladder_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.lit(2).alias("claim_rung"), F.when(k == 0, F.array(F.lit("h"))).alias("top_hypotheses"), F.when(k == 1, 0.1).alias("estimate"),
        F.when(k == 1, "worked").alias("verdict"), F.when(k == 2, 0.1).alias("measured_lift"), F.when(k == 2, "e").alias("experiment_id"),
    )
    return audit.audited_ladder(rows).select("id", "kind", F.array_join("violations", ",").alias("violations"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 3 WHEN 0 THEN 'tier1_page_edit' WHEN 1 THEN 'tier3_partner_referral' ELSE 'tier2_playbook' END AS tier,
  CAST(CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 3 END AS INT) AS n_steps, CASE p_partkey % 3 WHEN 0 THEN 'page__stats_density' WHEN 1 THEN 'company__backlink_density' ELSE 'company__g2_presence' END AS feature FROM part""")
def delivery_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, "page__stats_density").when(k == 1, "company__backlink_density").otherwise("company__g2_presence")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), fit.sentence(name, F.lit(1.0)).alias("text"))
    return audit.deliveries(rows, "text").select("id", "tier", F.size("steps").alias("n_steps"), audit.feature_in(F.col("text")).alias("feature"))


@query("""WITH o AS (SELECT lower(p_name || ' ' || p_type || ' ' || (p_partkey % 40)) AS t, arg_min(p_partkey % 4, p_partkey) AS s FROM part WHERE p_brand = 'Brand#2' GROUP BY 1),
c AS (SELECT count(*) AS n_queries, count(*) FILTER (s < 2) AS n_real, (SELECT count(*) FROM part WHERE p_brand <> 'Brand#2') AS n_foreign, CAST(1 AS BIGINT) AS n_targets FROM o)
SELECT 'Brand#2' AS vertical, *, round(coalesce(n_real / nullif(n_queries, 0), 0), 6) AS real_ratio, array_to_string(list_filter([CASE WHEN n_foreign > 0 THEN 'foreign_vertical' END,
  CASE WHEN n_queries < 50 THEN 'too_few_queries' END, CASE WHEN coalesce(n_real / nullif(n_queries, 0), 0) < 0.4 THEN 'too_few_real' END], lambda x: x IS NOT NULL), ',') AS issues FROM c""")
def vertical_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([("Brand#2", "cms")], "vertical string, name string")
    return sourcing.vertical_pack(_seeds(spark, sf_dir), targets, "Brand#2").select(F.lit("Brand#2").alias("vertical"), "n_queries", "n_real", "n_foreign", "n_targets", r6("real_ratio"), F.array_join("issues", ",").alias("issues"))


@query("""SELECT event_type AS engine, strftime(ts, '%G-W%V') AS week, count(*) AS n FROM events GROUP BY ALL""")
def stream_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly roll-up run as a stream over the files that are there, into a table in memory (a row a week and engine)."""
    from attesta.streaming import board as streams

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    s = s.select(F.col("event_type").alias("engine"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 100).alias("cited"))
    name = f"weekly_{uuid.uuid4().hex}"
    streams.weekly(s).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("engine", streams.iso_week(F.col("week.start")).alias("week"), "n")


from attesta.plans import more  # noqa: E402, F401  (adds its queries to QUERIES and SQL)
