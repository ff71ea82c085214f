"""Nearest neighbours and quoted threads: against brute force, and on awkward rows."""

import numpy as np
import re

from attesta.llm import ann, quotes


def test_walks_find_what_lies_within_the_ratio():
    rng = np.random.default_rng(0)
    for n, width in ((5, 3), (40, 8), (1500, 16)):
        c = rng.normal(size=(n, width)).astype(np.float32)
        q = rng.normal(size=(300, width)).astype(np.float32)
        graph, held = ann.Graph(c), np.full(n, 3)
        d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(-1))
        assert (graph.nearest(q) == d.argmin(axis=1)).mean() > 0.97
        row, node, far = graph.within(q, 1.2, held, 1)
        got = set(zip(row.tolist(), node.tolist()))
        want = set(zip(*(x.tolist() for x in np.nonzero(d <= 1.2 * d.min(axis=1, keepdims=True)))))
        assert len(got & want) >= 0.97 * len(want) and np.allclose(far, d[row, node] / d.min(axis=1)[row], atol=1e-3)
        row, node, _ = graph.within(c, 1.2, held, 3 * min(n, 30))  # at a centroid no ratio reaches another one
        assert (np.bincount(row) >= min(n, 30)).all()


def test_walks_cross_to_parts_without_links():
    c = np.concatenate([np.arange(40)[:, None] * 0.2 + [[0.0, 0.0]], np.arange(40)[:, None] * 0.2 + [[90.0, 90.0]]]).astype(np.float32)
    graph = ann.Graph(c, degree=4)
    assert (graph.nearest(c) == np.arange(80)).mean() > 0.95
    row, _, _ = graph.within(c, 1.1, np.ones(80, int), 80)
    assert (np.bincount(row) == 80).all()


def test_region_scan_against_brute_force(monkeypatch):
    monkeypatch.setattr(ann, "SCAN", 64)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, size=(300, 4)).astype(np.float32)  # many ties
    slots = rng.integers(0, 9, size=300)
    twice = rng.choice(300, 80)  # some stand in two lists
    region = ann.Region(np.concatenate([slots, (slots[twice] + 1) % 9]), np.concatenate([np.arange(300), twice]), np.vstack([x, x[twice]]), 5)
    visits = rng.random((300, 9)) < 0.6
    row, d, o = region.best(np.arange(300), x, visits)
    lists = [set(np.flatnonzero(slots == j)) | {int(t) for t in twice if (slots[t] + 1) % 9 == j} for j in range(9)]
    for i in range(300):
        there = set().union(*[lists[j] for j in np.flatnonzero(visits[i])]) - {i}
        want = sorted((float(np.sqrt(((x[i].astype(float) - x[m]) ** 2).sum())), int(m)) for m in there)[:5]
        assert list(zip(d[row == i].tolist(), o[row == i].tolist())) == want


def test_regions_hold_no_more_than_asked():
    rng = np.random.default_rng(2)
    c, sizes = rng.normal(size=(50, 6)).astype(np.float32), rng.integers(1, 30, 50)
    sizes[7] = 500
    first, parts, place, n = ann.regions(c, sizes, 100)
    assert parts[7] == 5 and (np.delete(parts, 7) == 1).all()
    own = [np.flatnonzero((first <= r) & (r < first + parts)) for r in range(n)]
    assert all(len(o) and (sizes[o] / parts[o]).sum() <= 100 and sorted(place[o]) == list(range(len(o))) for o in own)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24)) * 2
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = ann.nearest(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbour_vec_id"], r["distance"])
    assert len(rows) == 30_000
    x = x.astype(np.float64)
    d = (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len({n for n, _ in got[i].values()} & set(want[i])) / 10 for i in range(3000)]) >= 0.9
    assert all(abs(dist - np.sqrt(d[i, n])) < 1e-4 for i in range(50) for n, dist in got[i].values())


def test_recall_on_the_small_tables(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        own = sorted((r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect())
        ids, x = np.array([k for k, _ in own]), np.array([v for _, v in own], float)
        d = (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T
        np.fill_diagonal(d, np.inf)
        want = ids[np.argsort(d, axis=1)[:, :10]]
        got = {}
        for r in ann.nearest(df).collect():
            got.setdefault(r["vec_id"], set()).add(r["neighbour_vec_id"])
        recall = np.mean([len(got[k] & set(w)) / 10 for k, w in zip(ids, want)])
        assert recall >= 0.95


def test_vectors_of_awkward_rows(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "b"), (4, None, "c"), (5, [], "c"), (6, [1.0], "c"), (7, [float("nan"), 1.0], "c"), (None, [1.0, 1.0], "c"), (8, [1.0, None], "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string")
    got = {(r["vec_id"], r["neighbour_vec_id"], r["rank"]) for r in ann.nearest(df).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)}
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id = 1")).count() == 0


def test_lists_over_several_regions_give_the_same(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(200, 8)), np.zeros((150, 8))]).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    small, large = ({tuple(r) for r in ann.nearest(df, region_bytes=b, k=4).collect()} for b in (1000, 1 << 20))
    assert small == large and len(small) == 1400


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "vec_id long, embedding array<float>")
    rows = ann.nearest(df, k=3).collect()
    assert len(rows) == 1200 and all(r["distance"] == 0 for r in rows)
    assert {r["neighbour_vec_id"] for r in rows if r["vec_id"] > 3} == {0, 1, 2}


MAIL = [
    (1, 0, "user", "The build is broken since Monday, can anybody look at it?\nIt fails in the linker."),
    (1, 1, "user", "On Tuesday Ann wrote:\n> The build is broken since Monday, can anybody look at it?\n> It fails in the linker.\nI will look into it today."),
    (1, 2, "user", ">> The build is broken since Monday, can anybody look at it?\n>> It fails in the linker.\n> I will look into it today.\nThanks a lot for your quick help!"),
    (1, 3, "user", "> it FAILS in the  linker.\nThat is an old bug of the linker, see the tracker."),
    (2, 0, "user", "> That is an old bug of the linker, see the tracker.\nIs it fixed in the next release?"),
    (2, 1, "user", "No idea."),
    (3, 0, "user", "> Words that nobody here has ever written before.\nStrange."),
]


def plain(messages):
    """Parents by searching every message for every quotation."""
    norm = lambda s: re.sub(r"[^\w]+", " ", s.lower()).strip()
    own, quoted, order = {}, {}, sorted(messages)
    for c, t, _, text in messages:
        level = lambda line: len(re.sub("[^>]", "", re.match(r"[ \t>]*", line)[0])) if re.match(r"[ \t]*>", line) else 0
        lines = [(level(x), re.sub(r"^([ \t]*>)+[ \t]?", "", x)) for x in text.split("\n")]
        own[c, t] = norm("\n".join(x for n, x in lines if not n and not x.endswith("wrote:")))
        quoted[c, t] = [(n, norm(x)) for n, x in lines if n]
    out = {}
    for c, t, *_ in order:
        found = [(-n, c2 == c, len(q), (t2 if c2 == c else -t2), (c2, t2)) for n, q in quoted[c, t] for c2, t2 in own if q in own[c2, t2] and ((c2 == c and t2 < t) or c2 < c)]
        out[c, t] = max(found)[-1] if found else (c, t - 1) if t else None
    return out


def test_threads_against_a_plain_version(spark):
    rows = quotes.threads(spark.createDataFrame(MAIL, "conv_id long, turn long, role string, text string")).collect()
    got = {(r["conv_id"], r["turn"]): (r["parent_conv_id"], r["parent_turn"]) if r["parent_conv_id"] is not None else None for r in rows}
    assert got == plain(MAIL)
    by = {(r["conv_id"], r["turn"]): r for r in rows}
    assert by[1, 1]["body"] == "I will look into it today." and by[1, 2]["depth"] == 2 and by[2, 0]["thread"] == "1" and by[3, 0]["link"] == "root"
    assert by[2, 0]["link"] == "quote" and by[2, 1]["link"] == "turn" and by[1, 3]["parent_turn"] == 0
    place = {(r["thread"], (r["conv_id"], r["turn"])): r["position"] for r in rows}
    for r in rows:
        if r["parent_conv_id"] is not None:
            assert place[r["thread"], (r["parent_conv_id"], r["parent_turn"])] < r["position"]


def test_long_chains_and_awkward_messages(spark):
    rows = [(9, i, "user", f"message {i}") for i in range(70)] + [(None, 1, "u", "x"), (None, 1, "u", "x"), (5, None, None, None), (5, 1, "u", ""), (5, 1, "u", ""), (6, 0, "u", ">" * 30 + " deep"), (7, 0, "u", "line\n" * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as body", "'y' as c", "'z' as pos")
    got = quotes.threads(df).collect()
    assert len(got) == len(rows)
    assert {r["depth"] for r in got if r["conv_id"] == 9} == set(range(70))
    assert sorted(r["position"] for r in got if r["conv_id"] == 5) == [1, 2, 3]
    assert quotes.threads(df.limit(0)).count() == 0


def test_threads_are_what_sql_says(spark):
    import duckdb
    import pandas as pd

    rows = MAIL + [(4, None, None, None), (4, 2, "u", ""), (4, 2, "u", ""), (None, 1, "u", "On Monday Bob wrote:\n> No idea.\nx"), (5, 0, "u", "> a\n\n> b\n\nA b"), (5, 1, "u", ">> a\n> A b\ntext"), (6, 0, "u", "No idea.\r\n\r\nSecond paragraph here.")]
    rows += [(7, 0, "u", "> Second paragraph here.\nyes"), (7, 1, "u", "> yes\n> more\n> No idea.\nok")]
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    r = con.execute(quotes.sql())
    names = [c[0] for c in r.description]
    want = sorted(map(repr, r.fetchall()))
    df = quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(x[n] for n in names)) for x in df.collect()) == want


def test_quotations_of_the_table_are_linked_as_sql_says(spark):
    import duckdb

    from attesta.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    r = con.execute(queries.oracle_sql()["quoted_conversations"])
    names = [c[0] for c in r.description]
    df = queries.quoted_conversations(spark, folder)
    got = df.collect()
    assert sorted(repr(tuple(x[n] for n in names)) for x in got) == sorted(map(repr, r.fetchall()))
    links = [x["link"] for x in got]
    assert links.count("quote") > 0.5 * len(links)
    said = {(x["conv_id"], x["turn"]): x["text"] for x in spark.read.parquet(f"{folder}/conversations.parquet").collect()}
    assert all(x["body"] == (said[x["conv_id"], x["turn"]] or "").strip() for x in got)
