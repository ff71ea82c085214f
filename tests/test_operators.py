"""Operators on small tables with known answers."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attesta import schemas
from attesta.operators import assembly, audit, board, fit, joins, lift, matching, measure, replay, sourcing
from attesta.sources import responses, store
from attesta.streaming import board as streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def runs_of(spark, hits, query="q", engine="e", page="https://a.com/p", version="m1"):
    rows = [(query, page, engine, version, i, bool(c), 1 if c else None, i) for i, c in enumerate(hits)]
    return frame(spark, rows, "query_id string, page_url string, engine string, model_version string, run_idx int, cited boolean, position int, _seq long")


def test_aggregate_and_weights(spark):
    rows = [("q", "u", "e", "m1", 0, True, 1, 5), ("q", "u", "e", "m2", 1, True, 4, 9), ("q", "u", "e", "m3", 2, True, 0, 7), ("q", "u", "e", None, 3, False, None, 8)]
    r = measure.aggregate_runs(frame(spark, rows, "query_id string, page_url string, engine string, model_version string, run_idx int, cited boolean, position int, _seq long")).first()
    assert (r["k"], r["cited_count"], r["p_cited"], r["position_weight"], r["model_version"]) == (4, 3, 0.75, 0.625, "m2")


@pytest.mark.parametrize("hits,k", [([0] * 8, 4), ([1] * 8, 4), ([0, 1] * 4, 8), ([0, 0], 2), ([1, 0, 0, 0, 0, 0, 0, 0], 8)])
def test_adaptive_stops(spark, hits, k):
    assert replay.stop_runs(runs_of(spark, hits)).first()["stop_k"] == k
    assert replay.replayed(runs_of(spark, hits)).count() == k


def test_one_doubtful_page_keeps_its_unit_running(spark):
    both = runs_of(spark, [0] * 8).unionByName(runs_of(spark, [0, 1] * 4, page="https://b.com")).unionByName(runs_of(spark, [1] * 8, engine="f"))
    assert {(r["engine"], r["stop_k"]) for r in replay.stop_runs(both).collect()} == {("e", 8), ("f", 4)}


def test_flips_and_drift(spark):
    f = measure.flip_rates(runs_of(spark, [1, 0, 1, 1]).unionByName(runs_of(spark, [1], page="x")))
    r = {x["page_url"]: x for x in f.collect()}
    assert (r["https://a.com/p"]["minority_fraction"], r["https://a.com/p"]["transition_rate"], r["https://a.com/p"]["flipped"]) == (0.25, pytest.approx(2 / 3), True)
    assert r["x"]["minority_fraction"] == r["x"]["entropy_bits"] == 0 and not r["x"]["flipped"]
    rep = measure.flip_report(f).first()
    assert (rep["n_groups"], rep["n_insufficient"], rep["n_flipped"], rep["unstable"]) == (1, 1, 1, ["q|https://a.com/p"])
    two = runs_of(spark, [1], version="m2").withColumn("_seq", F.lit(1).cast("long")).unionByName(runs_of(spark, [1], version="m1").withColumn("_seq", F.lit(2).cast("long")))
    assert measure.drift(two).first()["versions"] == ["m2", "m1"]
    assert measure.drift(runs_of(spark, [1, 1])).count() == 0
    assert measure.family_mismatch(runs_of(spark, [1]), {"e": "gpt"}).count() == 1


def test_labelled_rows_and_retagging(spark):
    c = frame(spark, [("https://x.com/1", "x.com", 1), ("https://a.com", "a.com", 2)], "url string, domain string, rank int").agg(F.collect_list(F.struct("rank", "url", "domain")).alias("citations")).first()["citations"]
    res = frame(spark, [("q", "e", "m", 0, [tuple(x) for x in c], "about B.com", 1, None)], "query_id string, engine string, model_version string, run_idx int, citations array<struct<rank:int,url:string,domain:string>>, answer_text string, ts long, window_tag string")
    pool = frame(spark, [("q", "https://www.a.com/p"), ("q", "b.com"), ("q", "c.com"), ("q", "  "), ("other", "a.com")], "query_id string, page_url string")
    got = {r["page_url"]: (r["cited"], r["position"], r["appeared"], r["window_tag"]) for r in measure.labeled_rows(res, pool).collect()}
    assert got == {"https://www.a.com/p": (True, 2, True, "adhoc"), "b.com": (False, None, True, "adhoc"), "c.com": (False, None, False, "adhoc")}
    assert measure.retagged(pool, "post", "x").first()["experiment_id"] == "x"
    pages = frame(spark, [("https://blog.a.com", 2), ("a.com/first", 1)], "url string, _seq long")
    cites = frame(spark, [("a.com", 1), ("z.com", 2)], "domain string, rank int")
    assert {(r["domain"], r["page_url"]) for r in measure.citations_to_pages(cites, pages).collect()} == {("a.com", "a.com/first"), ("z.com", None)}


def part(text, *urls, kind="output_text", mark="url_citation"):
    return {"text": text, "type": kind, "annotations": [{"url": u, "type": mark if u != "n" else "other"} for u in urls]}


RAW = json.dumps({"output": [{"type": "web_search_call"}, {"content": [part("a ", "https://x.com/1", "n", "https://x.com/1", "https://www.y.co.uk/2"), part("no", kind="refusal"), part("b")], "type": "message"}], "model": "m"})


def test_responses(spark):
    df = frame(spark, [(1, RAW), (2, "{broken"), (3, None), (4, "{}")], "i int, raw string").select("i", responses.citations(F.col("raw")).alias("c"), responses.answer_text(F.col("raw")).alias("t")).orderBy("i").collect()
    assert [tuple(x) for x in df[0]["c"]] == [(1, "https://x.com/1", "x.com"), (2, "https://www.y.co.uk/2", "y.co.uk")] and df[0]["t"] == "a b"
    assert all(r["c"] == [] and r["t"] == "" for r in df[1:])
    ok, bad = responses.vendor_companies(frame(spark, [('[{"domain":"a.com"}]',), ('{"companies":[{"domain":"b.com"},{"domain":"c.com"}]}',), ("oops",)], "raw string"), "raw")
    assert sorted(len(r["companies"]) for r in ok.collect()) == [1, 2] and bad.count() == 1
    s = frame(spark, [('x {"direct_answer_first": true, "stats_density": "0.5", "citation_density": 1, "quote_density": 0, "listicle_vs_prose": "mixed"} y',), ('{"direct_answer_first": "maybe"}',), (None,)], "raw string")
    ok, bad = responses.subjective_features(s, "raw")
    assert ok.first()["subjective"].asDict() == dict(direct_answer_first=True, listicle_vs_prose=0.5, stats_density=0.5, quote_density=0.0, citation_density=1.0) and bad.count() == 2
    u = frame(spark, [('{"category":" c ","icp":"i","positioning":"p","what_you_are":"w","card":["one","one"]}',), ('{"category":"c"}',)], "raw string")
    ok, bad = responses.understanding(u, "raw")
    assert ok.first()["card"] == ["one", "one", "w", "c"] and bad.count() == 1
    q = frame(spark, [(1, '```json\n["a", " b "]\n```'), (2, "1. one\n- two\n\n* three"), (3, None)], "i int, raw string").select("i", responses.expanded_queries(F.col("raw")).alias("q")).orderBy("i").collect()
    assert [r["q"] for r in q] == [["a", " b "], ["one", "two", "three"], []]
    e = frame(spark, [("HTTP 429",), ("HTTP 503",), ("fetch FAILED",), ("ETIMEDOUT",), ("1500 ms",), (None,)], "m string").select(responses.retryable(F.col("m")).alias("r")).collect()
    assert [r["r"] for r in e] == [True, True, True, True, False, False] and responses.retry_delays() == [500, 1000, 2000]
    t = frame(spark, [(None, "a, b,,"), ([" "], None)], "l array<string>, s string").select(responses.tech_stack(F.col("l"), F.col("s")).alias("x")).collect()
    assert [r["x"] for r in t] == [["a", "b"], None]


def test_store_round_trip(spark, tmp_path):
    rows = frame(spark, [("w", "https://www.A.com", "old", None, 1), ("w", "a.com", None, "R", 2), ("w", "", "x", "y", 3), ("v", "a.com", "other", "R", 1)], "workspace_id string, domain string, name string, role string, _seq long")
    up = store.upserted_companies(rows)
    assert {(r["workspace_id"], r["domain"], r["name"], r["role"]) for r in up.collect()} == {("w", "a.com", "old", "R"), ("v", "a.com", "other", "R")}
    full = up
    for name in spark.createDataFrame([], schemas.TABLES["companies"]).columns:
        if name not in full.columns:
            full = full.withColumn(name, F.lit(None).cast(spark.createDataFrame([], schemas.TABLES["companies"]).schema[name].dataType))
    store.append(full, str(tmp_path), "companies")
    assert store.scan(spark, str(tmp_path), "companies", "w").count() == 1 and store.scan(spark, str(tmp_path), "companies").count() == 2
    assert store.lookup(store.scan(spark, str(tmp_path), "companies"), "domain", "a.com").count() == 1
    w = frame(spark, [("https://me.com", ["www.me.com", "A.com", "a.com", ""], "o")], "own_domain string, competitor_domains array<string>, owner string")
    assert tuple(store.workspaces_to_store(w).first())[:2] == ("me.com", ["a.com"]) and store.owned(w, "x").count() == 0 and store.owned(w, None).count() == 1
    m = frame(spark, [("http://www.a.com/x/", ["https://b.a.com/1", " "])], "page_url string, source_urls array<string>")
    assert store.measurements_to_store(m).first()["source_domains"] == ["a.com"]
    good, bad = schemas.checked(frame(spark, [(0.1, 0.2, "worked"), (0.3, 0.2, "won")], "ci_low double, ci_high double, verdict string"), "lift_results")
    assert good.count() == 1 and bad.first()["violations"] == ["ci_ordered", "verdict"]


def test_joins(spark):
    c = frame(spark, [("a.com", "first", 1), ("www.a.com", "second", 2), ("lone.com", "l", 3), ("", "none", 4)], "domain string, name string, _seq long")
    p = frame(spark, [("blog.a.com", "u1"), ("z.com", "u2"), (None, "u3")], "company_domain string, url string")
    for which, name in (("first", "first"), ("last", "second")):
        assert {(r["url"], r["c_name"]) for r in joins.pages_with_companies(p, c, which).collect()} == {("u1", name), ("u2", None), ("u3", None)}
    assert joins.pages_with_companies(p, c, "all").count() == 4
    assert {tuple(r) for r in joins.join_report(p, c).collect()} == {("orphan_page", "u2"), ("orphan_page", "u3"), ("childless_company", "lone.com"), ("duplicate_domain", "a.com"), ("unjoinable_company", "")}
    kept, dropped = joins.feature_frame(p, c)
    assert kept.count() == 1 and dropped.count() == 2
    assert joins.pool_for_query(frame(spark, [("q", 2, "b"), ("q", 1, "a"), ("r", 1, "c")], "query_id string, rank int, page_url string"), "q").count() == 2


def test_pool_ranks(spark):
    rows = [("q", "b.com", 3, 1), ("q", "a.com/", 2, 2), ("q", "https://a.com", 1, 3), ("r", "x.com", None, 1), ("r", "  ", 1, 2), ("r", "y.com", 1, 3)]
    got = {(r["query_id"], r["page_url"], r["rank"], r["place"]) for r in sourcing.candidate_pool(frame(spark, rows, "query_id string, url string, rank int, _seq long")).collect()}
    assert got == {("q", "https://a.com", 1.0, 1), ("q", "https://b.com", 3.0, 2), ("r", "https://x.com", 1.0, 1), ("r", "https://y.com", 3.0, 2)}


@pytest.mark.parametrize("ratio,n", [(0.4, 5), (1.0, 2), (0.0, 12)])
def test_written_queries_are_capped(spark, ratio, n):
    rows = [("Real one", "serp", 9), ("real two", "reddit", 8), ("REAL  one", "llm_expand", 1)] + [(f"w{i}", "llm_expand", i) for i in range(10)]
    assert sourcing.generated_queries(frame(spark, rows, "text string, seed_source string, _seq long"), ratio).count() == n


def test_company_layer_and_battlefield(spark):
    s = "domain string, name string, _seq long"
    out = sourcing.company_layer(frame(spark, [("me.com", "me.com", 1)], s), frame(spark, [("a.com", None, 1), ("me.com", "Me", 2)], s), frame(spark, [("www.a.com", "Aye", 1), ("b.com", "Bee", 2)], s))
    assert {(r["domain"], r["name"], r["role"]) for r in out.collect()} == {("me.com", "Me", "customer"), ("a.com", "Aye", "competitor"), ("b.com", "Bee", "battlefield")}
    assert [r["domain"] for r in sourcing.battlefield(frame(spark, [("seed.com", "", 1), ("x.com", "1", 2), ("www.x.com", "2", 3), ("", "", 4)], s), "Seed.com").collect()] == ["x.com"]
    r = frame(spark, [("me.com",), ("www.a.com",), ("q.com",)], "d string").select(sourcing.role_for(F.col("d"), "me.com", ["a.com"]).alias("r")).collect()
    assert [x["r"] for x in r] == ["customer", "competitor", "battlefield"]
    t = spark.range(1).select(sourcing.toggled(F.array(F.lit("a")), "b", F.lit(True)).alias("x"), sourcing.toggled(F.array(F.lit("a")), "a", F.lit(False)).alias("y"), sourcing.stamped(F.lit(None).cast("map<string,string>"), "s", "v", F.lit(True)).alias("z")).first()
    assert t["x"] == ["a", "b"] and t["y"] == [] and t["z"] == {"s": "v"}
    d = frame(spark, [("a.com",)], "domain string")
    v = frame(spark, [("a.com", "1", "NaN", "2", "x")], "domain string, thirdparty_mentions string, g2_presence string, review_site_presence string, backlink_density string")
    o = sourcing.merged_offpage(d, v, frame(spark, [], "domain string, wikipedia_presence double, brand_search_volume double, entity_cooccurrence double"), frame(spark, [("a.com", 0.0)], "domain string, reddit_presence double"))
    assert {k: v for k, v in o.first()["offpage"].asDict().items() if v is not None} == {"thirdparty_mentions": 1.0, "reddit_presence": 0.0, "review_site_presence": 2.0}
    assert sourcing.feature_vector(o).count() == 8


def test_agreement(spark):
    rows = [(i, (True, 1.0, 1.0, 1.0, 0.0), (i % 2 == 0, 1.0 + i, 1.0, 1.0, 0.0)) for i in range(4)] + [(9, None, (True, 1.0, 1.0, 1.0, 0.0))]
    kind = "struct<direct_answer_first:boolean,stats_density:double,citation_density:double,quote_density:double,listicle_vs_prose:double>"
    got = {r["feature"]: r for r in sourcing.agreement_report(frame(spark, rows, f"item_id int, predicted {kind}, gold {kind}")).collect()}
    assert len(got) == 5 and got["stats_density"]["within"] == 0.5 and got["citation_density"]["kappa"] == 1.0 and got["direct_answer_first"]["kappa"] == 0.0
    assert (got["stats_density"]["attempted"], got["stats_density"]["skipped"]) == (5, 1)


def test_pack_and_enrichment(spark):
    q = frame(spark, [("v", f"q {i}", "serp" if i % 2 else "llm_expand", i) for i in range(10)] + [("other", "z", "serp", 99)], "vertical string, text string, seed_source string, _seq long")
    r = sourcing.vertical_pack(q, frame(spark, [("x",)], "vertical string"), "v").first()
    assert r["n_queries"] == 10 and r["real_ratio"] == 0.5 and r["issues"] == ["foreign_vertical", "too_few_queries", "no_target"]
    raw = frame(spark, [("a.com/x", "<h1>t</h1> crm", None, ["crm"], 1), ("https://a.com/x/", "later", None, ["crm"], 2), ("b.com", " ", "r", [], 3)], "url string, html string, role string, terms array<string>, _seq long")
    p = sourcing.enriched_pages(raw, "v1", F.lit("2026-01-01")).collect()
    assert len(p) == 1 and p[0]["role"] == "candidate" and p[0]["content_features"]["query_term_coverage"] == 1.0 and p[0]["cache_key"].count("|") == 3


def test_budget_and_cache(spark):
    q = frame(spark, [(i, 6, 10) for i in range(6)], "_seq long, actual long, worst long")
    assert [(r["spent_before"], r["done"]) for r in replay.budget_cut(q, 28).orderBy("_seq").collect()] == [(0, True), (6, True), (12, True), (18, True), (24, False), (30, False)]
    assert replay.budget_cut(q, 1000).where("not done").count() == 0
    far = frame(spark, [(i, 1, 1) for i in range(99_990, 100_010)], "_seq long, actual long, worst long")
    assert [r["spent_before"] for r in replay.budget_cut(far, 10**6).orderBy("_seq").collect()] == list(range(20))
    assert replay.remaining(frame(spark, [("a",), ("b",)], "query_id string"), frame(spark, [("a",)], "query_id string")).count() == 1
    day = 86_400_000
    ages = frame(spark, [(0,), (70 * day,), (69 * day,), (200 * day,), (None,)], "t long").select(replay.valid_entry(F.col("t"), F.lit(100 * day)).alias("v")).collect()
    assert [r["v"] for r in ages] == [False, True, False, True, False]


def test_board(spark):
    rows = [("e", "a.com", True, ["s1.com"], 1), ("e", "b.com", True, ["s2.com"], 2), ("e", "c.com", True, ["s3.com"], 3), ("e", "a.com", False, ["s4.com"], 4)]
    d = frame(spark, rows, "engine string, page_url string, cited boolean, source_domains array<string>, _seq long")
    assert board.citation_board(d).first()["sources"] == ["s1.com", "s2.com", "s3.com"]
    h = board.head_to_head(d, F.lit("a.com"), F.array(F.lit("c.com"), F.lit("b.com"))).first()
    assert (h["you_cited"], h["you_total"], h["top_domain"], len(h["sources"])) == (1, 2, "b.com", 4) and h["headline"] == "you 1 / 2 · top competitor b.com 1/1"
    runs = frame(spark, [(100.005, 5, 2, {"e": (4, 1), "f": (0, 0)}), (130.0, 5, 2, {"e": (4, 1)})], "spend_usd double, calls_made int, queries_issued int, per_engine map<string,struct<calls:int,errors:int>>")
    t = board.ops_totals(runs).first()
    assert (t["cycles"], t["total_spend"], t["avg_spend_per_cycle"], t["over_budget_cycles"], t["within_budget"]) == (2, 230.01, 115.0, 1, False)
    assert {(r["engine"], r["error_rate"]) for r in board.ops_errors(runs).collect()} == {("e", 0.25), ("f", 0.0)}
    assert board.ops_totals(runs.limit(0)).first()["avg_spend_per_cycle"] == 0
    s = spark.range(1).select(board.sweep_progress(F.lit(3), F.lit(8)).alias("p"), board.card_state(F.struct(F.lit("c").alias("category"), F.lit(" ").alias("icp"), F.lit("p").alias("positioning"), F.lit(None).cast("string").alias("what_you_are"))).alias("c")).first()
    assert tuple(s["p"]) == (3, 8, 38) and s["c"]["status"] == "partial" and s["c"]["missing"] == ["icp", "what_you_are"]


def test_lifecycle(spark):
    e = frame(spark, [(i, st, None, None) for i, st in enumerate(["designing", "awaiting_publish", "awaiting_publish", "running", "complete"])], "id int, status string, awaiting_since long, publish_event_ts long")
    ev = frame(spark, [(0, "awaiting_publish", 5), (1, "running", 6), (2, "complete", 7), (3, "complete", 8), (4, "running", 9)], "id int, to string, ts long")
    got = [(r["status"], r["awaiting_since"], r["publish_event_ts"]) for r in board.moved(e, ev).orderBy("id").collect()]
    assert got == [("awaiting_publish", 5, None), ("running", None, 6), ("awaiting_publish", None, None), ("complete", None, None), ("complete", None, None)]
    c = spark.range(1).select(*[board.allowed_cadence(F.lit(d), F.lit(n)).alias(f"c{i}") for i, (d, n) in enumerate([(28, 3), (7, 2), (14, 1)])]).first()
    assert tuple(c) == (True, False, False)


def records(spark):
    comps = frame(spark, [("a.com", (None, 1.5, ["x", "y"]), (3.0, float("nan")), ("cat",), 1), ("b.com", (None, None, None), (None, 2.0), ("cat",), 2)], "domain string, firmographics struct<size:string,headcount_growth:double,tech_stack:array<string>>, offpage struct<g2_presence:double,backlink_density:double>, understanding struct<category:string>, _seq long")
    pages = frame(spark, [("https://a.com/1", "a.com", (True, 10.0), 1), ("b.com/1", "b.com", (False, None), 2), ("z.com", "z.com", (False, 1.0), 3)], "url string, company_domain string, content_features struct<schema_markup:boolean,word_count:double>, _seq long")
    m = frame(spark, [("q1", "a.com/1", "e", 0.2, 0.1, 0.4, True, True, "post"), ("q2", "a.com/1", "e", 0.6, 0.3, 0.8, False, True, "baseline"), ("q1", "b.com/1", "e", 0.0, 0.0, 0.5, False, True, "baseline"), ("q1", "z.com", "e", 1.0, 0.5, 1.0, True, True, "baseline"), ("q1", "b.com/1", "f", 0.0, 0.0, 0.5, False, False, "baseline")], "query_id string, page_url string, engine string, p_cited double, ci_low double, ci_high double, cited boolean, appeared boolean, window_tag string")
    return m, pages, comps


def test_assembly(spark):
    m, pages, comps = records(spark)
    rows = {(r["engine"], r["page_url"]): r for r in assembly.assembled(m, pages, comps).collect()}
    assert set(rows) == {("e", "https://a.com/1"), ("e", "https://b.com/1"), ("f", "https://b.com/1")}
    a = rows["e", "https://a.com/1"]
    assert a["p_cited"] == pytest.approx(0.4) and a["ci_width"] == pytest.approx(0.4)
    assert a["features"] == {"page__schema_markup": 1.0, "page__word_count": 10.0, "company__headcount_growth": 1.5, "company__g2_presence": 3.0, "company__tech_stack_count": 2.0}
    assert assembly.assembled(m, pages, comps, window="baseline").where("page_url like '%a.com%'").first()["p_cited"] == 0.6
    table = assembly.modeling_rows(m, pages, comps)
    assert {(r["page_url"], r["label"]) for r in table.collect()} == {("https://a.com/1", "winner"), ("https://b.com/1", "loser")}
    assert tuple(assembly.table_summary(table).first()) == ("cat", "e", 2, 2, 1)
    assert assembly.feature_names(table, ["engine"]).first()["features"] == sorted(["company__backlink_density", "company__g2_presence", "company__headcount_growth", "company__tech_stack_count", "page__schema_markup", "page__word_count"])
    assert assembly.inheritance_violations(table).count() == 0 and assembly.fit_requests(table, "c", "p").count() == 1
    twice = comps.unionByName(comps.where("domain = 'a.com'").withColumn("_seq", F.lit(9).cast("long")))
    assert assembly.assembled(m, pages, twice).count() == 4 and assembly.assembled(m, pages, twice, on_duplicate="last").count() == 3
    bad = frame(spark, [("a", {"company__x": 1.0}), ("a", {"page__y": 1.0})], "company_domain string, features map<string,double>")
    assert assembly.inheritance_violations(bad).first()["some_null"] is True


def test_matching(spark):
    rows = [("e", "a", "c1", 0.70, None, ["q1"]), ("e", "b", "c1", 0.70, None, ["q2"]), ("e", "c", "c2", 0.60, None, ["q2"]), ("e", "d", "c3", 0.10, "prose", ["q1"]), ("e", "f", "c4", 0.10, "listicle", ["q2"]), ("e", "g", "c5", 0.71, None, ["q1", "q2"])]
    p = frame(spark, rows, "engine string, page_url string, company_domain string, p_cited double, content string, queries array<string>").withColumn("cluster", F.array_min("queries"))
    got = [(r["treatment_page"], r["control_page"]) for r in matching.matched(p).collect()]
    assert got == [("a", "c")]
    e = matching.designed(matching.matched(p), "x", "cust", seed=3, target_feature="page__w").first()
    flip = int(np.random.default_rng(3).integers(0, 2))
    pair = e["pairs"][0]
    assert (pair["treatment_page"], pair["control_page"]) == (("a", "c") if flip == 0 else ("c", "a"))
    assert pair["match_covars"]["treatment_p_cited"] == ("0.7" if flip == 0 else "0.6") and pair["match_covars"]["target_feature"] == "page__w" and e["status"] == "designing"


def panel_of(spark, pairs, effect, seed=0):
    rng = np.random.default_rng(seed)
    m, ps = [], []
    for i in range(pairs):
        ps.append((f"t{i}", f"c{i}", {}))
        for page, t in ((f"t{i}", 1), (f"c{i}", 0)):
            for post in (0, 1):
                for w in (0, 1):
                    m.append((page, "e", "post" if post else "baseline", float(np.clip(0.3 + effect * t * post + rng.normal(0, 0.02), 0, 1)), None, f"w{w}", None))
    ms = frame(spark, m, "page_url string, engine string, window_tag string, p_cited double, cited boolean, period string, ts timestamp")
    return frame(spark, [("x", ps)], f"id string, pairs array<{schemas.PAIR}>"), ms


@pytest.mark.parametrize("pairs,effect,verdict", [(10, 0.2, "worked"), (10, 0.0, "no_effect"), (1, 0.2, "inconclusive")])
def test_lift(spark, pairs, effect, verdict):
    e, m = panel_of(spark, pairs, effect)
    r = lift.estimated(e, m).first()
    assert r["verdict"] == verdict and r["claim_rung"] == 2 and r["n_complete_pairs"] == pairs
    did = lift.simple_did(lift.panel(e, m), ["engine"]).first()["did"]
    assert r["estimate"] == pytest.approx(did, abs=1e-9)
    if pairs > 4:
        assert r["ci_low"] <= effect + 0.02 and r["ci_high"] >= effect - 0.02
    assert lift.estimated(e, m.where("window_tag = 'post'")).first()["verdict"] == "inconclusive"
    assert lift.unmeasured(e, lift.estimated(e, m.limit(0))).count() == 1


def test_baseline_and_horseshoe():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(80, 4))
    y = rng.uniform(size=80) < 1 / (1 + np.exp(-3.5 * x[:, 1]))
    pdf = pd.DataFrame({"category": "c", "engine": "e", "page_url": [f"p{i:03}" for i in range(80)], "company_domain": [f"d{i}" for i in range(80)], "p_cited": y.astype(float), "label": np.where(y, "winner", "loser"), "features": [{f"page__x{j}": float(v) for j, v in enumerate(row)} for row in x]})
    b = fit.baseline(pdf).set_index("feature")
    assert b.loc["page__x1", "posterior_median"] > 0 and not b.loc["page__x1", "noise_flag"] and b["cv_auc"].iloc[0] > 0.8
    h = fit.horseshoe(pdf, draws=200, tune=200, chains=1).set_index("feature")
    assert h.loc["page__x1", "posterior_median"] > 0 and not h.loc["page__x1", "noise_flag"] and h.drop("page__x1")["noise_flag"].all()
    assert fit.horseshoe(pdf, draws=50, tune=50, chains=1).equals(fit.horseshoe(pdf, draws=50, tune=50, chains=1))
    one = pdf[pdf["label"] == "winner"]
    assert fit.horseshoe(one)["noise_flag"].all() and fit.baseline(one.assign(p_cited=1.0))["noise_flag"].all()
    thin = pdf.head(8).assign(features=[{f"page__n{j}": float(v) for j, v in enumerate(rng.normal(size=12))} for _ in range(8)])
    t = fit.horseshoe(thin, draws=200, tune=200, chains=1)
    assert t["posterior_median"].abs().max() < 20 and t["noise_flag"].mean() >= 0.8


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y = (rng.uniform(size=60) < 0.5).astype(float)
    b, w = fit.logistic(x, y)
    p = 1 / (1 + np.exp(-(b + x @ w)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-6 and abs((p - y).sum()) < 1e-6


def test_hypotheses(spark):
    rows = [("c", "e", "page__a", 0.5, 0.1, 0.9, False, 9, 5), ("c", "e", "page__b", -2.0, -3.0, -1.0, False, 9, 5), ("c", "e", "page__c", 1.0, -1.0, 2.0, True, 9, 5), ("c", "e", "page__d", 1.0, -1.0, 2.0, False, 9, 5)]
    d = frame(spark, rows, "category string, engine string, feature string, posterior_median double, ci_low double, ci_high double, noise_flag boolean, n_rows long, n_companies long")
    p = fit.payload(d, 2).first()
    assert p["n_features_noise"] == 1 and len(p["top_hypotheses"]) == 2 and "less often" in " ".join(p["top_hypotheses"])
    assert [r["feature"] for r in fit.gaps(d).where("survives").orderBy("place").collect()] == ["page__b", "page__a"]
    checked = spark.createDataFrame([(t,) for t in p["top_hypotheses"]], "t string").select(audit.banned_word(F.col("t")).alias("b"), audit.overclaims(F.col("t")).alias("o")).collect()
    assert all(r["b"] is None and not r["o"] for r in checked)
    h = fit.hierarchical_ready(frame(spark, [("c", "d")], "category string, company_domain string")).first()
    assert not h["ready"] and len(h["reasons"]) == 2
    with pytest.raises(NotImplementedError):
        fit.fit_hierarchical(d)
    assert fit.dummy(frame(spark, [("c", "e", {"page__a": 1.0})], "category string, engine string, features map<string,double>")).first()["noise_flag"]


def test_audits(spark):
    kind = f"id int, coefficients array<{schemas.COEFFICIENT}>, top_hypotheses array<string>, verdict string, claim_rung int"
    fits = frame(spark, [(1, [("f", 1.0, 0.0, 1.0, True)], ["may be"], None, 1), (2, [("f", 1.0, 0.0, 1.0, None)], ["It DRIVES x"], "worked", 2)], kind)
    got = {r["id"]: r["violations"] for r in audit.audited_fits(fits).collect()}
    assert got == {1: [], 2: ["no_noise_flag:f", "banned_word:drives", "causal_field:verdict", "causal_field:claim_rung"]}
    lifts = frame(spark, [(1, 2, "worked", 0.1, 0.2), (2, 2, "inconclusive", 0.0, 0.2)], "id int, claim_rung int, verdict string, ci_low double, ci_high double")
    claims = frame(spark, [(1, "worked"), (2, "worked"), (3, None)], "id int, claimed_verdict string")
    out = audit.unbacked_claims(claims, lifts, "id")
    assert {r["id"]: r["violations"] for r in out.collect()} == {1: [], 2: ["unbacked_claim"], 3: []}
    with pytest.raises(Exception, match="claim without experiment"):
        audit.strictly(out).collect()
    ok = spark.range(1).select(audit.claim(F.lit(1), F.lit(False), F.lit(False)).alias("a"), audit.claim(F.lit(2), F.lit(True), F.lit(True)).alias("b")).first()
    assert tuple(ok["a"]) == (0, "Measured") and ok["b"]["rung"] == 2
    with pytest.raises(Exception, match="needs a lift result"):
        spark.range(1).select(audit.claim(F.lit(2), F.lit(True), F.lit(False)).alias("a")).collect()
    with pytest.raises(Exception, match="unknown feature namespace"):
        frame(spark, [("x",)], "f string").select(audit.delivery_tier(F.col("f"))).collect()
    d = audit.deliveries(frame(spark, [("more `page__w` please",)], "t string"), "t")
    assert audit.page_assets(d, ["q"], lambda p: "text", lambda a: {"status": "published"})[0]["publish"]["status"] == "published"


def test_streams(spark, tmp_path):
    rows = runs_of(spark, [1, 0, 1, 1]).withColumn("source_domains", F.array(F.lit("s.com"))).withColumn("ts", F.timestamp_seconds(F.col("_seq") * 864_000 + 1_704_067_200))
    rows.select(*[c.split()[0] for c in streams.RUN.split(", ")]).write.parquet(str(tmp_path / "in"))
    s = streams.read_runs(spark, str(tmp_path / "in"))
    streams.write(streams.rates(s), str(tmp_path / "out"), str(tmp_path / "cp"), "complete").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["p_cited"] == 0.75
    streams.write(streams.board(s), str(tmp_path / "b"), str(tmp_path / "cb"), "complete").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "b")).first()["sources"] == ["s.com"]
    streams.write(streams.weekly(s, "1 day"), str(tmp_path / "w"), str(tmp_path / "cw")).awaitTermination()
    weeks = spark.read.parquet(str(tmp_path / "w"))
    assert all(r["week"]["start"].weekday() == 0 for r in weeks.collect())


def test_json_records_and_enrichment(spark, tmp_path):
    from attesta.sources.fixtures import read_json

    (tmp_path / "c.json").write_text('[{"domain":"a.com","coverage_flags":{},"offpage":{"g2_presence":true},"firmographics":{"tech_stack":["x"],"headcount_growth":"0.5"}},{"domain":"b.com","coverage_flags":["f"],"_seq":3}]')
    c = {r["domain"]: r for r in read_json(spark, str(tmp_path / "c.json"), "companies").collect()}
    assert c["a.com"]["coverage_flags"] == [] and c["a.com"]["offpage"]["g2_presence"] == 1.0 and c["a.com"]["firmographics"]["tech_stack"] == ["x"] and c["a.com"]["firmographics"]["headcount_growth"] == 0.5
    assert c["b.com"]["coverage_flags"] == ["f"] and c["b.com"]["_seq"] == 3 and c["b.com"]["offpage"] is None
    (tmp_path / "p.json").write_text('{"url":"u","scraped_at":"2024-01-01T00:00:00Z","content_features":{"schema_markup":1,"word_count":7}}')
    p = read_json(spark, str(tmp_path / "p.json"), "pages").first()
    assert p["scraped_at"] == 1_704_067_200_000 and p["content_features"]["schema_markup"] is True and p["content_features"]["word_count"] == 7.0
    (tmp_path / "m.json").write_text('{"query_id":"q","P_cited":0.5,"ts":5}')
    m = read_json(spark, str(tmp_path / "m.json"), "measurements").first()
    assert m["p_cited"] == 0.5 and m["ts"] == 5
    df = read_json(spark, str(tmp_path / "c.json"), "companies")
    raw = frame(spark, [("b.com", " 11-50 ", "x", "a, b")], "domain string, s string, g string, t string")
    values = raw.select("domain", sourcing.firmographics({"size": F.col("s"), "headcount_growth": F.col("g"), "tech_text": F.col("t")}).alias("value"))
    out = {r["domain"]: r for r in sourcing.enriched_companies(df.withColumn("coverage_flags", F.array(F.lit("firmographics_missing"))), "firmographics", values, "v2").collect()}
    assert tuple(out["b.com"]["firmographics"]) == ("11-50", None, None, None, ["a", "b"]) and out["b.com"]["coverage_flags"] == [] and out["b.com"]["source_versions"] == {"firmographics": "v2"}
    s = spark.range(1).select(*[sourcing.extractor_stamp("v1", F.lit(a), F.lit(b)).alias(f"x{i}") for i, (a, b) in enumerate([(False, False), (True, True), (True, False)])]).first()
    assert tuple(s) == ("v1", "v1+subj", "v1+subj-err")


def test_a_page_without_a_finite_rate_is_left_out(spark):
    rows = [("e", "a.com/1", None, 0.1, 0.3), ("e", "a.com/1", float("nan"), 0.1, 0.3), ("e", "b.com/1", 0.4, 0.1, 0.5), ("e", "b.com/1", float("nan"), None, None), ("e", "c.com", 1.5, None, None), ("e", "d.com", 0.5, -0.5, 1.5)]
    df = frame(spark, rows, "engine string, page_url string, p_cited double, ci_low double, ci_high double").withColumn("window_tag", F.lit("w"))
    got = {r["_url"]: (r["p_cited"], r["ci_width"]) for r in assembly.page_rollup(df).collect()}
    assert got == {"https://b.com/1": (0.4, 0.4), "https://c.com": (1.0, None), "https://d.com": (0.5, 2.0)}


def test_expansion_keeps_numbers_that_belong_to_the_query(spark):
    raw = "3.5 inch screens\n2.0 update tips\n-5 degrees\n> 1) cheap crm\n• best crm\n 12. list"
    got = frame(spark, [(raw,), ('[1, "a", null, " "]',), ('```json\n["x"]\n```',), ("[broken",)], "raw string").select(responses.expanded_queries(F.col("raw")).alias("q")).collect()
    assert [r["q"] for r in got] == [["3.5 inch screens", "2.0 update tips", "-5 degrees", "cheap crm", "best crm", "list"], ["a"], ["x"], ["[broken"]]


def test_judged_features_of_the_wrong_kind_are_rejects(spark):
    j = lambda flag, form, n="1": f'{{"direct_answer_first": {flag}, "stats_density": {n}, "citation_density": 1, "quote_density": "2", "listicle_vs_prose": {form}}}'
    rows = [(1, j("true", '"mixed"')), (2, j('"true"', '"mixed"')), (3, j("false", "0.3")), (4, j("false", '" Listicle "')), (5, j("false", "0")), (6, j("true", "1", '"x"')), (7, j("true", '"0.5"')), (8, j("true", "null")), (9, j("true", "0.5", "true"))]
    good, bad = responses.subjective_features(frame(spark, rows, "i int, raw string"), "raw")
    assert {r["i"]: r["subjective"]["listicle_vs_prose"] for r in good.collect()} == {1: 0.5, 5: 0.0} and bad.count() == 7


def test_focus_is_by_domain_key(spark):
    g = frame(spark, [("e", "https://acme.com/x", 0.2, 0.8), ("e", "https://b.com/x", 0.9, 1.0)], "engine string, page_url string, ci_low double, ci_high double")
    of = lambda focus: measure.ambiguous(g, ["engine"], focus=focus).first()["ambiguous"]
    assert of(None) and of(["http://www.Acme.com/"]) and not of(["b.com"]) and not of([]) and not of(["", " "])


def test_weeks_across_the_turn_of_a_year(spark):
    from attesta.streaming import board as streams

    got = frame(spark, [("2024-12-30",), ("2026-12-28",), ("2027-01-04",)], "d string").select(streams.iso_week(F.col("d").cast("timestamp")).alias("w")).collect()
    assert [r["w"] for r in got] == ["2025-W01", "2026-W53", "2027-W01"]


def test_greedy_pairs_against_a_plain_version(spark):
    import random

    rng = random.Random(4)
    pages = [(e, f"p{i:02d}", f"c{i % 7}", round(rng.random(), 2), rng.choice([None, "prose", "listicle"]), [f"q{i % 4}"], f"q{i % 4}") for e in ("a", "b") for i in range(40)]
    df = frame(spark, pages, "engine string, page_url string, company_domain string, p_cited double, content string, queries array<string>, cluster string")
    got = {(r["engine"], r["treatment_page"], r["control_page"]) for r in matching.matched(df).collect()}
    want = set()
    for e in ("a", "b"):
        own, used = sorted(p for p in pages if p[0] == e), set()
        for a in own:
            fits = [(a[2] == b[2], abs(a[3] - b[3]), b[1]) for b in own if b[1] != a[1] and b[1] not in used and abs(a[3] - b[3]) <= 0.15 and (a[4] is None or b[4] is None or a[4] == b[4]) and not set(a[5]) & set(b[5])]
            if a[1] not in used and fits:
                used |= {a[1], min(fits)[2]}
                want.add((e, a[1], min(fits)[2]))
    assert got == want and len(got) > 10


def test_pairing_never_lists_the_edges(spark, monkeypatch):
    """Thousands of pages of one rate: their edges are millions, and the pairs are found without them."""
    monkeypatch.setattr(matching, "edges", lambda *a, **k: pytest.fail("edges were listed"))
    pages = frame(spark, [("e", f"p{i:05d}", f"c{i % 2}", 0.5, None, [f"q{i % 2}"], f"q{i % 2}") for i in range(6000)], "engine string, page_url string, company_domain string, p_cited double, content string, queries array<string>, cluster string")
    got = [(r["treatment_page"], r["control_page"]) for r in matching.matched(pages).orderBy("pair").collect()]
    assert got == [(f"p{i:05d}", f"p{i + 1:05d}") for i in range(0, 6000, 2)]
    assert len(matching.designed(matching.matched(pages, max_pairs=8), "x", "cust").first()["pairs"]) == 8


def test_pairing_of_odd_pages_against_a_plain_version():
    import random

    from attesta.operators.matching import _pair_up

    def unfit(a, b):  # as arrays_overlap, where null may be any query
        return bool(a and b and (a & b or None in a or None in b))

    rng = random.Random(5)
    for _ in range(300):
        n, q, digits = rng.randint(1, 100), rng.choice([1, 2, 30]), rng.choice([1, 2, 17])
        companies = [None, "a", "b"][: rng.randint(1, 3)]
        own = [(f"p{i:03d}", rng.choice(companies), round(rng.random(), digits), rng.choice([None, None, "prose", "listicle"]), frozenset(rng.sample([None, *(f"q{j}" for j in range(q))], rng.randint(0, min(q, 2))))) for i in range(n)]
        used, want = set(), []
        for a in own:
            fits = [(2 if a[1] is None or b[1] is None else int(a[1] == b[1]), abs(a[2] - b[2]), b[0]) for b in own if b[0] != a[0] and b[0] not in used and abs(a[2] - b[2]) <= 0.15 and (a[3] is None or b[3] is None or a[3] == b[3]) and not unfit(a[4], b[4])]
            if a[0] not in used and fits:
                used |= {a[0], min(fits)[2]}
                want.append((a[0], min(fits)[2], min(fits)[1]))
        rng.shuffle(own)
        assert _pair_up(own, 0.15, None) == want and _pair_up(own, 0.15, 2) == want[:2]


def test_edges_of_a_common_rate_are_spread_over_tasks(spark):
    """All pages at one rate or near it: the pairs are found by many tasks, and all of them."""
    pages = frame(spark, [("e", f"p{i}", "c", 0.5 if i < 2400 else 0.5 + (i - 2400) / 1000, None, [f"q{i % 2}"], "q") for i in range(2700)], "engine string, page_url string, company_domain string, p_cited double, content string, queries array<string>, cluster string")
    e = matching.edges(pages)
    rates = [0.5 if i < 2400 else 0.5 + (i - 2400) / 1000 for i in range(2700)]
    x = np.array(rates)
    own = np.arange(2700) % 2
    assert e.count() == int(((np.abs(x[:, None] - x[None, :]) <= 0.15) & (own[:, None] != own[None, :])).sum())
    shares = sorted((r["count"] for r in e.groupBy(F.spark_partition_id()).count().collect()), reverse=True)
    assert len(shares) > 1 and shares[0] < 0.75 * sum(shares)
    assert "Broadcast" not in e._jdf.queryExecution().toString()


def test_expansion_of_odd_texts_agrees_with_the_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["", " ", "\n", "- \n\n", "\x85", "a \x85", " ```\nb", "x\r```\ry\r\n", "\x0b", "1. \x0bz \x0b", "﻿ q　", "> 2) b\n", '["x"]', "```\n```", None]
    frame(spark, list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["expanded_queries"]).fetchall())
    got = entry.queries()["expanded_queries"](spark, str(tmp_path)).select("doc_id", "n", "queries").collect()
    assert sorted(map(tuple, got)) == want and len(want) == 14
    assert frame(spark, [("2. ",)], "raw string").select(responses.expanded_queries(F.col("raw")).alias("q")).first()["q"] == []


def test_lift_is_fitted_from_cells_as_from_rows(spark):
    rng = np.random.default_rng(2)
    pages = [f"{s}{i}" for i in range(5) for s in "tc"]
    rows = [(p, "e", "post" if w > 1 else "baseline", None, bool(rng.random() < 0.3 + 0.2 * (p[0] == "t" and w > 1)), f"w{w}", None) for p in pages for w in range(4) for _ in range(int(rng.integers(50, 100)))]
    m = frame(spark, rows, "page_url string, engine string, window_tag string, p_cited double, cited boolean, period string, ts timestamp")
    e = frame(spark, [("x", [(f"t{i}", f"c{i}", {}) for i in range(5)])], f"id string, pairs array<{schemas.PAIR}>")
    df = lift.estimated(e, m)
    r = df.first()
    y = np.array([float(x[4]) for x in rows])
    page, week = np.array([pages.index(x[0]) for x in rows]), np.array([int(x[5][1]) for x in rows])
    x = np.column_stack([np.ones(len(y)), page[:, None] == np.arange(1, 10), week[:, None] == np.arange(1, 4), [v[0][0] == "t" and v[2] == "post" for v in rows]]).astype(float)
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    scores = np.array([(x * (y - x @ beta)[:, None])[page == p].sum(axis=0) for p in range(10)])
    v = 10 / 9 * (len(y) - 1) / (len(y) - np.linalg.matrix_rank(x)) * inverse @ scores.T @ scores @ inverse
    half = 1.6448536269514722 * np.sqrt(v[-1, -1])
    assert (r["estimate"], r["ci_low"], r["ci_high"]) == pytest.approx((beta[-1], beta[-1] - half, beta[-1] + half), abs=1e-9) and r["n_rows"] == len(rows)
    plan = df._jdf.queryExecution().optimizedPlan().toString()  # Python gets sums, not rows
    assert "sum(y" in plan[plan.index("FlatMapGroups") :] and lift.cells(lift.panel(e, m)).count() == 40


def test_the_budget_is_numbered_by_parts(spark):
    import datetime
    import re

    import __spark_entry__ as entry

    start = datetime.datetime(2024, 1, 1)
    rows = [(k, None if k % 9 == 0 else start + datetime.timedelta(hours=k * 7 % 100)) for k in range(500)]
    d = frame(spark, rows, "k long, t timestamp")
    got = [r["k"] for r in replay.numbered(d, F.to_date("t"), ["t", "k"]).orderBy("_seq").collect()]
    assert got == [k for k, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or start, r[0]))]
    assert [r["_seq"] for r in replay.numbered(d, F.to_date("t"), ["t", "k"]).orderBy("_seq").collect()] == list(range(1, 501))
    plan = entry.queries()["budget_cut"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    firsts = re.findall(r"row_number\(\) windowspecdefinition\((\S+)( ASC)?", plan)
    assert firsts and not any(asc for _, asc in firsts)  # a partition, not an order, comes first
