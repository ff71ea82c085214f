"""Keys, HTML features, statistics."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import html, keys, stats
from attesta.functions.register import register

DOMAINS = {
    "blog.eng.acme.com": "acme.com", "shop.acme.com.au": "acme.com.au", "https://user:pw@acme.com:8443/x?y#z": "acme.com", "acme.com.": "acme.com", "   ": "", "": "", None: "",
    "//WWW.Acme.co.uk/a": "acme.co.uk", "192.168.1.1": "192.168.1.1", "localhost": "localhost", " acme.com　": "acme.com", "a@b@acme.com": "acme.com", "com.au": "com.au",
}
URLS = {
    "http://www.Acme.com/": "https://acme.com", "HTTPS://Acme.com/Path/To//": "https://acme.com/Path/To", "acme.com/a?b=2&a=1#frag": "https://acme.com/a?a=1&b=2", "acme.com?UTM_Source=x&gclid=1&q=&": "https://acme.com?q=",
    "blog.acme.com/x#y?z": "https://blog.acme.com/x", "": "", None: "", "  ": "", "https://acme.com:80/a?c": "https://acme.com/a?c", "www.www.acme.com": "https://www.acme.com", "acme.com/?_ga=1": "https://acme.com",
}


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_domains_and_urls(spark):
    assert column(spark, DOMAINS, keys.normalize_domain) == [*DOMAINS.values()]
    assert column(spark, URLS, keys.normalize_url) == [*URLS.values()]
    for f, table in ((keys.normalize_domain, DOMAINS), (keys.normalize_url, URLS)):
        once = [v for v in table.values() if not v.startswith("https://www")]
        assert column(spark, once, f) == once


def fnv(s):
    h = 2166136261
    units = s.encode("utf-16-le")
    for a, b in zip(units[::2], units[1::2]):
        h = ((h ^ (a | b << 8)) * 16777619) & 0xFFFFFFFF
    return f"{h:08x}"


def test_hashes(spark):
    texts = ["", "abc", "é中", "😀 non-basic 𝒳", "x" * 300]
    assert column(spark, texts, keys.fnv1a) == [fnv(t) for t in texts]
    assert column(spark, ["  Best   CRM, for you!  "], keys.query_id) == ["q-best-crm-for-you-" + fnv("best crm, for you!")]
    assert column(spark, ["!!!", "a" * 39 + " bc"], keys.query_id) == ["q-" + fnv("!!!"), "q-" + "a" * 39 + "-" + fnv("a" * 39 + " bc")]
    assert column(spark, [["b", " A ", ""], ["a", "b"], [], None, ["a", "a"]], keys.terms_hash, "array<string>") == [fnv("a\nb"), fnv("a\nb"), "noqt", "noqt", fnv("a\na")]


def test_registered_functions_agree(spark):
    assert len(register(spark)) == 7
    for d, want in DOMAINS.items():
        if d and " " not in d:
            assert spark.sql("select cite_domain(:d) x", args={"d": d}).first()["x"] == want
    assert spark.sql("select cite_fnv1a('abc') x").first()["x"] == fnv("abc")
    assert abs(spark.sql("select cite_wilson_low(5, 10) x").first()["x"] - 0.2366) < 1e-3


def test_html_to_text(spark):
    cases = {
        "<p>a&amp;lt;b</p><script>x</script >": "a<b", "<SCRIPT>a</SCRIPT>b<style>c</style><noscript>d</noscript> e": "b e", "x&nbsp;&quot;y&quot;&#39;": "x \"y\"'", None: "", "&nbsp;": "",
    }
    assert column(spark, cases, html.to_text)[1:] == [*cases.values()][1:]
    assert column(spark, ["<b>one two</b> three", "", "a  b c", None], html.word_count) == [3, 0, 3, 0]


def test_tables_and_marks(spark):
    row = "<tr><td>1</td></tr>"
    good = f"<table><tr><th>a<th>b<TH>c</tr>{row}{row}</table>"
    cases = [good, good.replace("<th>b", ""), good.replace(row + row, row), "<table>" + row * 3 + "</table>", "<table><thead></thead></table>" + good, None]
    assert column(spark, cases, html.has_comparison_table) == [True, False, False, False, True, False]
    marks = ['<script type="application/ld+json">', "<div itemscope itemtype='https://schema.org/Thing'>", "<div itemscope>", "<div itemtype='schema.org'>"]
    assert column(spark, marks, html.has_schema_markup) == [True, True, False, False]
    meta = '<meta name="date" content="2024-01-01"><time datetime="2023-01-01"><meta property="og:updated_time" content=" "><meta property="article:published_time" content=" 2025-05-05 ">'
    assert column(spark, [meta, "<time datetime='2023-01-01'>", "<p>"], html.last_modified) == ["2025-05-05", "2023-01-01", None]
    now = F.lit("2024-01-31T12:00:00Z")
    assert column(spark, ["2024-01-01", "2024-01-31T11:00:00Z", "2030-01-01", "never", None], lambda c: html.freshness_days(c, now)) == [30, 0, 0, 0, 0]


def test_term_coverage(spark):
    terms = F.array(*[F.lit(t) for t in ("CRM", "crm ", "best tool", "c++", "")])
    assert column(spark, ["a crm.", "acrm best tool", "C++ crm best  tool", None], lambda c: html.term_coverage(c, terms)) == pytest.approx([1 / 3, 1 / 3, 2 / 3, 0])
    assert column(spark, ["x"], lambda c: html.term_coverage(c, F.array().cast("array<string>"))) == [0.0]


WILSON = {(5, 10): (0.237, 0.763), (0, 3): (0, 0.561), (0, 8): (0, 0.324), (3, 3): (0.438, 1), (0, 0): (0, 1), (9, 4): (0.510, 1), (-1, 4): (0, 0.490)}


def test_wilson(spark):
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(WILSON)], "i int, s long, n long")
    got = [tuple(r["x"]) for r in df.select("i", stats.wilson(F.col("s"), F.col("n")).alias("x")).orderBy("i").collect()]
    for a, b in zip(got, WILSON.values()):
        assert a == pytest.approx(b, abs=1e-3)
    grid = spark.range(21).select(F.col("id").alias("n")).crossJoin(spark.range(21).select(F.col("id").alias("s"))).select(stats.wilson(F.col("s"), F.col("n")).alias("x"))
    assert grid.where("not (0 <= x.low and x.low <= x.high and x.high <= 1)").count() == 0


def test_small_statistics(spark):
    assert column(spark, [0.5, 0.0, 1.0], stats.entropy, "double") == [1.0, 0.0, 0.0]
    assert column(spark, [2.5, -2.5, 0.125], stats.half_up, "double") == [3.0, -2.0, 0.0]
    assert column(spark, [None, 0.0, -1.0, 1.0], stats.ci_weight, "double") == [1, 1, 1, 0.5]
    assert column(spark, ["1.5", "x", "NaN", "Infinity", None], stats.finite) == [1.5, None, None, None, None]
    assert column(spark, [0.333, None], lambda c: stats.rate_with_interval(c, F.lit(0.12), F.lit(0.61)), "double") == ["33% (CI 12%–61%)", "—"]
    assert all(abs(x) <= 0.05 for x in column(spark, ["a", "b", None], keys.jitter))


def test_sql_functions_agree_on_blanks_astral_letters_and_addresses(spark):
    register(spark)
    rows = [("\u00a0 https://www.Acme.com/a/?utm_source=x&b=2&a=1#f \ufeff",), ("😀 é x",), ("HTTP://x.co.uk:80/",), ("",), (None,), ("//y.org/p//?gclid=1",)]
    df = spark.createDataFrame(rows, "x string")
    df.createOrReplaceTempView("given")
    u = F.col("x")
    want = df.select(keys.normalize_domain(u), keys.normalize_url(u), keys.fnv1a(u)).collect()
    got = spark.sql("select cite_domain(x), cite_url(x), cite_fnv1a(x) from given").collect()
    assert list(map(tuple, got)) == list(map(tuple, want))
    one = spark.sql("select cite_flip_rate(array(true, false, false, true)) a, cite_flip_rate(array(true)) b, cite_flip_rate(cast(array() as array<boolean>)) c").first()
    assert (round(one["a"], 6), one["b"], one["c"]) == (0.666667, 0.0, 0.0)


def test_written_dates_are_read(spark):
    from attesta.functions import html

    texts = ["Wed, 21 Oct 2015 07:28:00 GMT", "October 21, 2015", "Oct 21, 2015", "21 October 2015", "2015-10-21T09:28:00+02:00", "2015/10/21", "someday", None]
    got = spark.createDataFrame([(t,) for t in texts], "m string").select(html.freshness_days(F.col("m"), F.lit("2015-10-31T08:00:00Z")).alias("d")).collect()
    assert [r["d"] for r in got] == [10] * 6 + [0, 0]


def test_a_given_text_wins_over_the_page(spark):
    from attesta.functions import html

    f = html.features(F.lit("<p>one two</p><h1>x</h1>"), F.lit("2026-01-01"), F.array(F.lit("red")), text=F.col("t"))
    got = spark.createDataFrame([("red green blue blue",), (None,)], "t string").select(f.alias("f")).collect()
    assert [(r["f"]["word_count"], r["f"]["query_term_coverage"], r["f"]["heading_structure"]) for r in got] == [(4.0, 1.0, 1.0), (3.0, 0.0, 1.0)]


def test_words_of_odd_blanks_and_of_long_runs(spark):
    import random
    import re

    from attesta.functions import html
    from attesta.functions.keys import BLANK

    rng = random.Random(3)
    parts = ["a", "é", "\U0001f600", "<b>", "&lt;i&gt;", "&nbsp;", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", " ", "　", "﻿", "​"]
    texts = ["", " ", "　", " " * 200_000 + "x", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    blank = re.compile(BLANK.replace("\\s", " \\t\\n\\x0b\\f\\r"))

    def text(t):
        t = re.sub("<[^>]+>", " ", t)
        for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">")):
            t = t.replace(name, char)
        return " ".join(x for x in blank.split(t) if x)

    def words(t):
        return len(text(t).split(" ")) if text(t) else 0

    got = {r["i"]: (r["x"], r["n"]) for r in df.select("i", html.to_text(df["t"]).alias("x"), html.word_count(html.to_text(df["t"])).alias("n")).collect()}
    assert got == {i: (text(t), words(text(t))) for i, t in enumerate(texts)}
    assert "lambda" not in df.select(html.word_count(df["t"]))._jdf.queryExecution().optimizedPlan().toString()  # lambdas read their text anew


def test_domains_are_read_once_and_as_by_labels(spark):
    import random

    from attesta.functions import keys
    from attesta.sources import store

    rng = random.Random(8)
    parts = ["a", "b", "co", "uk", "com", "au", "12", "", "www", "é", "x\ny", "org"]
    hosts = [".".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(1500)] + ["1.2.3.4", "1", "1.2.3.x", "co.uk", "x.co.uk"]

    def plain(h):
        labels = h.split(".")
        if len(labels) < 3 or all(x.isascii() and x.isdigit() for x in labels):
            return h
        return ".".join(labels[-3 if ".".join(labels[-2:]) in keys.SUFFIXES else -2 :])

    df = spark.createDataFrame(list(enumerate(hosts)), "i int, h string")
    assert {r["i"]: r["d"] for r in df.select("i", keys.registrable(df["h"]).alias("d")).collect()} == {i: plain(h) for i, h in enumerate(hosts)}
    w = spark.createDataFrame([("http://www.me.com", ["b.org", "x.a.co.uk", "B.org", "", None, "me.com/x"]), ("a.com", None)], "own_domain string, competitor_domains array<string>")
    got = store.workspaces_to_store(w)
    assert {r["own_domain"]: r["competitor_domains"] for r in got.collect()} == {"me.com": ["b.org", "a.co.uk"], "a.com": None}
    plan = got.select("competitor_domains")._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("\n")].count("lambda x") <= 2 and plan[: plan.index("\n")].count("own_domain#") == 1
