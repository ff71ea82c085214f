"""Near copies, line chunks, mixing, sharding: against brute force, and on awkward rows."""

import math
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from attesta.llm import common, linededup, minhash, mixing, sharding


def pairs_of(text, width=2):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_shingles_and_signatures_match_sets():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    a = [" ".join(rng.choice(words, 120)) for _ in range(40)]
    b = []
    for t in a:
        w = t.split()
        for i in rng.choice(len(w), 8, replace=False):
            w[i] = "edited"
        b.append(" ".join(w))
    rows, sig = minhash.signatures(pa.array([*a, *b, "", None, "one"]))
    assert rows.tolist() == [*range(80), 82]
    est = (sig[:40] == sig[40:80]).mean(axis=1)
    true = np.array([len(pairs_of(x) & pairs_of(y)) / len(pairs_of(x) | pairs_of(y)) for x, y in zip(a, b)])
    assert np.abs(est - true).mean() < 0.05
    assert len(set(sig[80].tolist())) == 1  # one shingle fills every bin


def test_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(900)]
    docs, n = [], 0
    for g in range(30):
        base = list(rng.choice(words, rng.integers(30, 200)))
        for c in range(int(rng.integers(1, 7))):
            w = list(base)
            for i in rng.choice(len(w), int(len(w) * 0.06) if c else 0, replace=False):
                w[i] = f"e{rng.integers(9999)}"
            docs.append((n, " ".join(w)))
            n += 1
    docs += [(n + i, docs[0][1]) for i in range(50)]
    got = {r["doc_id"]: r["kept_doc_id"] for r in minhash.duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    root = lambda k: got.get(k, k)
    sets = {k: pairs_of(t) for k, t in docs}
    want = hit = wrong = 0
    for i, (a, _) in enumerate(docs):
        for b, _ in docs[i + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            want += j >= 0.65
            hit += j >= 0.65 and root(a) == root(b)
            wrong += j < 0.2 and root(a) == root(b)
    assert want > 1000 and hit / want >= 0.97 and wrong == 0


def test_components_are_those_of_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["k"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_of_awkward_rows(spark, odd):
    assert [(r["doc_id"], r["kept_doc_id"]) for r in minhash.duplicates(odd).collect()] == [(7, 1)]
    kept = minhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "8", "None", "None"])
    assert minhash.keep_first(odd.limit(0)).count() == 0


def test_names_with_dots_and_keys_of_text(spark):
    rows = [("1", "a b c d e f g"), ("2", "a b c d e f g"), ("x", "a b c d e f g"), ("y", "h i j k l m n")]
    df = spark.createDataFrame(rows, ["doc.id", "the text"]).selectExpr("*", "1 as n", "2 as k", "3 as same")
    kept = minhash.keep_first(df, "doc.id", "the text")
    assert kept.columns == df.columns and {r[0] for r in kept.collect()} == {"1", "x", "y"}
    assert linededup.dedup(df, "doc.id", "the text").count() == 4
    assert mixing.keep_chosen(df.withColumn("s.c", df["n"]), "doc.id", text="the text", source="s.c", keep=1.0).count() == 2
    assert sharding.shard(df, key="doc.id", text="the text", slots=8).count() == 4


def test_spent_checkpoints_are_deleted(spark):
    import glob

    df = common.checkpointed(spark.range(5).toDF("k"))
    there = lambda: set(glob.glob(spark.sparkContext.getCheckpointDir().replace("file:", "") + "/rdd-*"))
    before = there()
    again = common.checkpointed(df.selectExpr("k + 1 as k"))
    common.forget(df)
    assert len(there() & before) == len(before) - 1 and again.count() == 5
    common.forget(spark.range(3))


def plain_dedup(docs, least=linededup.LEAST_WORDS):
    """Pairs of adjacent units, in key order, marked by their bytes where they stand before; long stretches go."""
    first, out = {}, {}
    for k, t in sorted(docs):
        _, _, words, s, e, bare, _, data = linededup.chunks(pa.array([t]))
        raw, n = data.tobytes(), len(s)
        marked, far = [False] * n, [False] * n
        for i in range(n - 1):
            pair = raw[s[i] : bare[i + 1]]
            if first.setdefault(pair, (k, i)) != (k, i):
                marked[i] = marked[i + 1] = True
                if first[pair][0] != k:
                    far[i] = far[i + 1] = True
        i = 0
        while i < n:
            j = i
            while j < n and marked[j] == marked[i]:
                j += 1
            if marked[i] and sum(words[i:j]) < least:
                marked[i:j] = [False] * (j - i)
            i = j
        if sum(w for w, m, f in zip(words, marked, far) if m and f) > linededup.MOST_COPIED * sum(words):
            continue
        rest = b""
        for i in range(n):
            part = raw[s[i] : e[i]]
            if not marked[i]:
                rest += part
            elif rest and not rest.endswith(b"\n") and part.endswith(b"\n"):
                rest = rest.rstrip() + b"\n"
        r = rest.decode()
        r = r.rstrip() if any(marked) and r and not t[-1].isspace() else r
        if not any(marked) or r.strip():
            out[k] = r
    return out


def test_line_dedup_of_the_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = plain_dedup(docs)
    assert {r["doc_id"]: r["text"] for r in linededup.dedup(df).collect()} == want
    assert sum(want.get(k) != t for k, t in docs) > 5


def test_copies_with_edits_go_whole_and_repetitive_documents_stay(spark):
    rng = np.random.default_rng(12)
    lines = [" ".join(f"w{rng.integers(0, 10**9)}" for _ in range(20)) for _ in range(12)]
    edited = [*lines[:5], "an edited line of its own", *lines[6:]]
    inner = ["own one " * 10, *lines[:0], *["spam and ham and eggs and so on and on " * 2] * 9]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(edited)), (3, "\n".join(inner))], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(df).collect()}
    assert set(got) == {1, 3} and got[1] == "\n".join(lines) and 0 < len(got[3]) < len("\n".join(inner))


def test_short_repeats_stay_and_long_documents_are_quick():
    import time

    line = [f"{i} a line of text {i % 977}" for i in range(160_000)]
    gone = [{"i": int(i), "m": 3, "far": False} for i in range(0, 150_000, 5)]
    began = time.process_time()
    rest = linededup.without(pa.array(["\n".join(line)]), pa.array([gone]))[0].as_py().split("\n")
    assert time.process_time() - began < 8 and len(rest) == 160_000 - 90_000
    assert linededup.without(pa.array(["a b\nc d\ne f"]), pa.array([[{"i": 0, "m": 2, "far": True}]]))[0].as_py() == "a b\nc d\ne f"


def test_line_dedup_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    block = [f"shared line number {i}" for i in range(40)]
    docs = []
    for k in range(60):
        lines = [f"own line {k} {i}" for i in range(int(rng.integers(0, 12)))]
        if k % 3 == 0:
            at = int(rng.integers(0, len(lines) + 1))
            lines[at:at] = block
        docs.append((k, "\n".join(lines) + ("\n" if k % 4 == 0 else "")))
    df = spark.createDataFrame([(k, t, len(t)) for k, t in docs], "doc_id long, text string, n_chars long")
    got = linededup.dedup(df, n_chars="n_chars").collect()
    assert {r["doc_id"]: r["text"] for r in got} == plain_dedup(docs)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum("shared line number 20" in r["text"] for r in got) == 1


def test_boundaries_survive_an_insertion():
    lines = [f"line {i}" for i in range(200)]
    cut = lambda ls: {hash(c) for c in _chunks("\n".join(ls))}
    a, b = cut(lines), cut(["a new first line", *lines])
    assert len(a & b) / len(a) > 0.9


def _chunks(text):
    _, _, _, s, _, bare, _, data = linededup.chunks(pa.array([text]))
    return [data.tobytes()[a:z] for a, z in zip(s, bare)]


def test_shared_passages_in_other_documents_go(spark):
    """A shared paragraph of one line, a passage within a line, and a few short lines, each in otherwise other text."""
    rng = np.random.default_rng(6)
    own = lambda n: " ".join(f"w{rng.integers(0, 10**9)}" for _ in range(n))
    line, inner, short = own(60), own(60), "\n".join(own(5) for _ in range(10))
    texts = []
    for shared in (line, inner, short):
        for _ in range(2):
            texts.append(f"{own(40)} {shared} {own(40)}" if shared is inner else f"{own(40)}\n{own(7)}\n{shared}\n{own(7)}\n{own(30)}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(df).collect()}
    for first, shared in ((0, line), (2, inner), (4, short)):
        assert got[first] == texts[first]
        left = set(got[first + 1].split())
        rest = set(texts[first + 1].split()) - set(shared.split())
        assert rest <= left and len(left & set(shared.split())) <= (0 if shared is not inner else 25)


def test_equal_hashes_with_other_bytes_are_kept(spark):
    """The bytes decide: with hashes of few bits, where nearly all collide, nothing but true copies goes."""
    docs = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (3, "e\nf\ng\nh"), (4, "\n".join(f"line {i}" for i in range(50)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for bits in (1, 3):
        got = {r["doc_id"]: r["text"] for r in linededup.dedup(df, least=1, bits=bits).collect()}
        assert got[1] == docs[0][1] and got[3] == docs[2][1] and got[4] == docs[3][1]
        assert set(got.get(2, "").split()) <= set("abcd")
    assert 2 not in {r["doc_id"] for r in linededup.dedup(df, least=1).collect()}


def test_line_dedup_of_awkward_rows(spark, odd):
    out = linededup.dedup(odd, n_chars="n_chars")
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} >= {None, 1, 2, 3, 5, 6}
    assert linededup.dedup(odd.limit(0)).count() == 0


def test_sainte_lague_gives_the_textbook_seats(spark):
    """One shard, blocks of one document: seats by highest quotients with what each source holds as a cap."""
    sizes = {"a": 50, "b": 30, "c": 15, "d": 2}
    rows = [(i * 100 + j, " ".join(["w"] * 10), s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 1.0, "b": 1.0, "c": 2.0, "d": 4.0}
    got = mixing.choose(df, weights, block_tokens=10, keep=0.4).collect()
    seats = defaultdict(int)
    for _ in range(math.floor(97 * 0.4)):
        s = max((s for s in sizes if seats[s] < sizes[s]), key=lambda s: (weights[s] / (2 * seats[s] + 1), [-ord(c) for c in s]))
        seats[s] += 1
    assert {r["source"]: r["quota"] for r in got} == dict(seats)
    assert all(sum(r["source"] == s for r in got) == n for s, n in seats.items())


def test_mixing_is_what_sql_says(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["tok"] * int(rng.integers(1, 300))), f"s{int(rng.integers(0, 30) ** 0.5)}") for i in range(800)]
    rows += [(None, "a b", "s1"), (900, None, "s1"), (901, "x y z", None), (1, "tok", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    small = {"block_tokens": 500, "shard_tokens": 40_000}
    r = con.execute(mixing.sql(**small))
    names = [c[0] for c in r.description]
    want = sorted(tuple(x) for x in r.fetchall())
    got = sorted(tuple(x[n] for n in names) for x in mixing.choose(df, **small).collect())
    assert got == want and len(got) > 300


def test_mixing_of_awkward_rows(spark, odd):
    kept = mixing.keep_chosen(odd, keep=1.0)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 5, 6, 7, 8}
    assert mixing.choose(odd.limit(0)).count() == 0


def test_rebalancing_moves_little_and_balances():
    rng = np.random.default_rng(7)
    sizes = rng.pareto(1.5, 4096).astype(int) * 10 + 5
    first = sharding.initial_map(4096, 16)
    out = sharding.rebalanced(first, sizes.tolist(), 16)
    load = np.bincount(out, sizes, 16)
    assert load.max() <= 1.1 * sizes.sum() / 16 + sizes.max()
    assert sum(a != b for a, b in zip(first, out)) < 1200
    assert sharding.rebalanced(out, sizes.tolist(), 16) == out
    grown = sharding.rebalanced(out, sizes.tolist(), 20)
    assert np.bincount(grown, sizes, 20).max() <= 1.1 * sizes.sum() / 20 + sizes.max()
    fewer = sharding.rebalanced(out, sizes.tolist(), 12)
    assert max(fewer) == 11
    assert sharding.rebalanced([0, 0, 0], [0, 0, 0], 2) == [0, 0, 0]


def test_slots_are_stable_and_maps_are_versioned(spark, odd, tmp_path):
    import hashlib

    got = sharding.shard(odd, folder=str(tmp_path / "m"), shard_bytes=50_000).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is not None:
            assert r["slot"] == int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % 4096
    last = sharding.versions(spark, str(tmp_path / "m"))[-1]
    v2 = {r["slot"]: r["shard"] for r in sharding.read_map(spark, str(tmp_path / "m"), last).collect()}
    assert len(v2) == 4096 and all(v2[r["slot"]] == r["shard"] for r in got)
    import pytest

    with pytest.raises(Exception, match="exists"):
        sharding.write_map(spark, str(tmp_path / "m"), last, [0])
    assert sharding.shard(odd.limit(0), folder=str(tmp_path / "e")).count() == 0


def test_a_stored_map_is_edited(spark, tmp_path):
    folder = str(tmp_path / "edited")
    frame = lambda n: spark.createDataFrame([(k, "x" * (n if k % 7 == 0 else 50)) for k in range(300)], "doc_id long, text string")
    maps = lambda: {v: [r["shard"] for r in sharding.read_map(spark, folder, v).orderBy("slot").collect()] for v in sharding.versions(spark, folder)}
    sharding.shard(frame(50), folder, slots=64, shard_bytes=3000).collect()
    before = maps()
    again = sharding.shard(frame(50), folder, slots=64, shard_bytes=3000).collect()
    assert maps() == before  # nothing to move, nothing written
    assert {(r["map_version"], r["first_shard"] == r["shard"]) for r in again} == {(max(before), True)}
    rows = sharding.shard(frame(900), folder, slots=64, shard_bytes=3000).collect()
    after = maps()
    last = max(before)
    assert {v: after[v] for v in before} == before and sorted(after) == [*sorted(before), last + 1]
    sizes = [0] * 64
    for r in rows:
        sizes[r["slot"]] += r["n_bytes"]
        assert r["first_shard"] == after[last][r["slot"]] and r["shard"] == after[last + 1][r["slot"]] and r["map_version"] == last + 1
    assert after[last + 1] == naive_rebalance(after[last], sizes, max(-(-sum(sizes) // 3000), max(after[last]) + 1))
    import pytest

    with pytest.raises(ValueError, match="slots"):
        sharding.shard(frame(50), folder, slots=32)


def naive_rebalance(assigned, sizes, shards, tolerance=0.1):
    """The same rule, looking at everything again for every move."""
    out, stuck = list(assigned), set()
    while True:
        load = [sum(b for b, i in zip(sizes, out) if i == s) for s in range(shards)]
        over = [s for s in range(shards) if load[s] > (1 + tolerance) * sum(sizes) / shards and s not in stuck]
        if not over:
            return out
        full = sorted(over, key=lambda s: (-load[s], s))[0]
        low = sorted(range(shards), key=lambda s: (load[s], s))[0]
        fits = [k for k, i in enumerate(out) if i == full and sizes[k] > 0 and load[low] + sizes[k] < load[full]]
        if fits:
            out[sorted(fits, key=lambda k: (-sizes[k], k))[0]] = low
        else:
            stuck.add(full)


def test_shards_against_brute_force(spark, tmp_path):
    import hashlib

    rng = np.random.default_rng(9)
    docs = [(int(k), "x" * int(n)) for k, n in zip(rng.permutation(400), rng.pareto(1.2, 400) * 50)]
    got = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), folder=str(tmp_path / "s"), slots=64, shard_bytes=4000).collect()
    slot = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 64
    sizes = [0] * 64
    for k, t in docs:
        sizes[slot(k)] += len(t)
    shards = min(64, -(-sum(sizes) // 4000))
    first = [s * shards // 64 for s in range(64)]
    want = naive_rebalance(first, sizes, shards)
    assert {(r["doc_id"], r["slot"], r["first_shard"], r["shard"], r["n_bytes"]) for r in got} == {(k, slot(k), first[slot(k)], want[slot(k)], len(t)) for k, t in docs}
