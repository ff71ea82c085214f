"""Quality, SentencePiece, toxicity, licences: against plain versions, and on awkward rows."""

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import common, licences, pieces, quality, toxicity


def test_quality_matches_a_plain_version(spark, odd):
    got = {(r["doc_id"], r["n_bytes"]): r for r in quality.score(odd).collect()}
    assert len(quality.score(odd).collect()) == odd.count()
    c = zstandard.ZstdCompressor(level=3)
    text = next(r["text"] for r in odd.collect() if r["doc_id"] == 5).encode()
    r = got[(5, len(text))]
    parts = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    assert r["ratio"] == len(text) / len(c.compress(text))
    assert r["highest_chunk_ratio"] == max(len(p) / len(c.compress(p)) for p in parts)
    assert {(x["doc_id"], x["reason"]) for x in quality.score(odd).collect()} >= {(2, "empty"), (3, "null"), (4, "empty"), (1, "ok"), (None, "ok"), (None, "null")}


def test_every_field_of_the_verdict_against_a_plain_version(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(2000)]
    texts = []
    for i in range(120):
        parts = [" ".join(rng.choice(words, rng.integers(1, 900))), str(rng.choice(words)) * int(rng.integers(0, 900)), rng.bytes(int(rng.integers(0, 3000))).hex() * (i % 3 == 0), "ü€😀" * int(rng.integers(0, 400))]
        texts.append("\n".join(parts[j] for j in rng.permutation(4)[: int(rng.integers(1, 5))]))
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    size = lambda b: len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(b))
    seen = Counter()
    for r in got:
        data = texts[r["doc_id"]].encode()
        if not data.strip():
            assert r["reason"] == "empty"
            continue
        band = lambda n: [b for b in quality.BANDS if b[0] <= n][-1][1:]
        ratio = len(data) / size(data)
        chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 4096 else [data]
        ratios = [len(c) / size(c) for c in chunks]
        low = sum(len(c) for c, x in zip(chunks, ratios) if x < band(len(c))[0])
        high = sum(len(c) for c, x in zip(chunks, ratios) if x > band(len(c))[1])
        bad = (low + high) / len(data) > quality.CHUNK_SHARE
        reason = "repetitive" if ratio > band(len(data))[1] else "incompressible" if ratio < band(len(data))[0] else ("repetitive_chunks" if high >= low else "incompressible_chunks") if bad else "ok"
        assert tuple(r)[1:] == (len(data), ratio, min(ratios), max(ratios), (low + high) / len(data), reason)
        seen[reason] += 1
    assert len(seen) >= 3


def test_quality_rejects_both_ends_and_keeps_prose():
    c = zstandard.ZstdCompressor(level=3).compress
    rng = np.random.default_rng(0)
    assert quality.judge(b"buy now! " * 400, c)[-1] == "repetitive"
    assert quality.judge(rng.bytes(5000), c)[-1] == "incompressible"
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words, 4000)).encode()
    assert quality.judge(prose, c)[-1] == "ok"
    assert quality.judge(prose[:12000] + b"spam ham " * 1000, c)[-1].startswith("repetitive")
    assert quality.limits(0) == quality.BANDS[0][1:] and quality.limits(10**9) == quality.BANDS[-1][1:]


def test_quality_keep_has_the_same_columns(spark, odd):
    kept = quality.keep(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 6, 7, 8]  # the long one counts up
    assert quality.keep(odd.limit(0)).count() == 0 and quality.score(odd.limit(0)).count() == 0


V = pieces.vocabulary(pieces.MODEL)


def segmentations(text: str) -> dict[tuple, float]:
    """Every path of the lattice with its probability, by enumeration."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    known = {sp.id_to_piece(i).replace("▁", " "): i for i in range(259, sp.get_piece_size())}
    w = 1 / (np.arange(len(known)) + pieces.Q)
    logs = np.log(w / w.sum())

    def walk(s):
        if not s:
            yield (), 0.0
            return
        for n in range(1, len(s) + 1):
            i = known.get(s[:n])
            if i is not None:
                for rest, p in walk(s[n:]):
                    yield (i, *rest), p + 0.5 * logs[i - 259]

    found = {k: math.exp(p) for k, p in walk(text)}
    return {k: p / sum(found.values()) for k, p in found.items()}


@pytest.mark.parametrize("text", [" there", "in the", "aaaa"])
def test_sampled_paths_have_their_probabilities(text):
    want, n = segmentations(text), 20_000
    offsets, ids = pieces.encode(V, [text] * n, common.mix64(np.arange(n, dtype=np.uint64)))
    got = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(offsets))
    assert set(got) <= set(want)
    assert max(abs(got[k] / n - p) for k, p in want.items()) < 0.015


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6), st.integers(0, 2**63))
def test_decoding_is_lossless_and_draws_ignore_the_batch(texts, seed):
    seeds = common.mix64(np.arange(len(texts), dtype=np.uint64) + np.uint64(seed))
    offsets, ids = pieces.encode(V, texts, seeds)
    parts = [ids[a:b] for a, b in itertools.pairwise(offsets)]
    assert [pieces.decode(V, p).tobytes().decode() for p in parts] == texts
    for t, s, p in zip(texts, seeds, parts):
        assert pieces.encode(V, [t], np.array([s]))[1].tolist() == p.tolist()


def test_long_runs_without_blanks_and_marks():
    for t in ("x" * 5000, "▁▁ a▁b", " " * 40, "\n\n", "\u0000", "é" * 700):
        assert pieces.decode(V, pieces.encode(V, [t], np.array([1], np.uint64))[1]).tobytes().decode() == t


def test_encoded_rows(spark, odd):
    rows = pieces.encoded(odd)
    got = rows.collect()
    assert len(got) == odd.count() and all(r["lossless"] in (True, None) for r in got)
    ones = [r["ids"] for r in got if r["doc_id"] == 1]
    assert ones[0] == ones[1] != next(r["ids"] for r in got if r["doc_id"] == 7)
    assert next(r for r in got if r["doc_id"] == 3)["ids"] is None and next(r for r in got if r["doc_id"] == 2)["ids"] == []
    texts = {(r["doc_id"], r["text"]) for r in pieces.decoded(rows).collect()}
    assert texts == {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert pieces.encoded(odd.limit(0)).count() == 0


WORDS = "moron idiot stupid trash loser clown the and with river house garden people worthless pathetic disgusting scum".split()


def letters_of(texts):
    counts = np.zeros(64**3, np.int64)
    out = list(toxicity._counted([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]))
    counts[out[0].column(0).to_numpy()] = out[0].column(1).to_numpy()
    return toxicity.Letters(counts)


def test_rows_without_a_key_and_columns_of_other_case(spark):
    rows = [(None, "stop here and wait for the others to come"), (None, "wait here and stop for the others to come"), (1, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = pieces.row_seeds(pa.array([None, None], pa.int64()), ["stop here", "here stop"], 1)
    assert a != b and pieces.row_seeds(pa.array([None], pa.int64()), ["stop here"], 1)[0] == a
    coded = pieces.encoded(df).selectExpr("*", "'mine' as Text")
    back = pieces.decoded(coded)
    assert back.columns == [*coded.columns, "text_1"] and {r["Text"] for r in back.collect()} == {"mine"}
    assert sorted(r["text_1"] for r in back.collect()) == sorted(t for _, t in rows)


def test_letter_counts_match_a_plain_count():
    texts = ["Abc a1b", "", None, "é x"]
    want = Counter()
    for t in texts:
        for word in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split():
            codes = [0, 0, *[toxicity.CODE[c] for c in word], 0]
            want.update((a << 12 | b << 6 | c) for a, b, c in zip(codes, codes[1:], codes[2:]))
    batch = list(toxicity._counted([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]))[0]
    assert dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) == dict(want)


def test_viterbi_finds_the_best_of_all_readings():
    model = letters_of([" ".join(WORDS) * 20])

    def score(word):
        codes = [0, 0, *[toxicity.CODE[c] for c in word], 0]
        return sum(float(model.table[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:]))

    for span in ("m0r0n", "1d10t", "5tup1d", "tr@5h"):
        choices = itertools.product(*[toxicity.readings(c) for c in span])
        best = max((sum(p for _, p in c) + score("".join(x for x, _ in c)), "".join(x for x, _ in c)) for c in choices)
        assert toxicity.decode(span, model)[0] == best[1]


@pytest.mark.parametrize("span,word", [("m0r0n", "moron"), ("i d i o t", "idiot"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("$cum", "scum"), ("w0rthl3ss", "worthless")])
def test_obfuscations_are_restored(span, word):
    assert word in (toxicity.restore(span, letters_of([" ".join(WORDS) * 20])) or "").split()


def test_suspicious_spans():
    offsets, data = common.buffers(pa.array(["a m0r0n here", "i d i o t", "fine words only", "sooo bad", None, "$$$ &&& 12 34"]))
    row, found = toxicity.suspicious(offsets, data)
    assert sorted(zip(row.tolist(), found)) == [(0, "m0r0n"), (1, "i d i o t"), (3, "sooo")]


@pytest.mark.parametrize("text,word", [("stuupid", "stupid"), ("morron", "moron"), ("loOser", "loser"), ("i/d/i/o/t", "idiot"), ("s,t,u,p,i,d", "stupid"), ("t'r`a\\s/h", "trash"), ("los€r", "loser"), ("c£own", "clown"), ("¡diot", "idiot"), ("i  d \t i   o t", "idiot"), ("mоrоn", "moron"), ("ΙDIΟT", "idiot"), ("ѕtuріd", "stupid")])
def test_every_form_of_the_channel_reaches_the_decoder(text, word):
    model = letters_of([" ".join(WORDS) * 20])
    _, found = toxicity.suspicious(*common.buffers(pa.array([f"the river {text} and the garden"])))
    assert any(word in (toxicity.restore(f, model) or "").split() for f in found)


def test_toxic_documents_are_found_held_out(spark):
    rng = np.random.default_rng(1)
    plain = [w for w in WORDS if w in "the and with river house garden people".split()]
    bad = ["moron", "idiot", "stupid", "trash"]
    leet = str.maketrans("oiets", "01375")
    docs, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 60))
        if i % 5 == 0:
            for w in rng.choice(bad, 3):
                words.insert(int(rng.integers(0, 60)), w.translate(leet) if i % 10 == 0 and i >= 300 else str(w))
        docs.append((i, " ".join(words)))
        if i < 300:
            labels.append((i, int(i % 5 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"] for r in toxicity.toxic(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got == {i for i in range(600) if i % 5 == 0}


def test_scores_against_a_plain_version(spark):
    """Every word of the text, and of what was restored, and its beginnings, weighed one by one."""
    import re

    model = letters_of([" ".join(WORDS) * 20])
    rng = np.random.default_rng(3)
    bad = ["m0r0n", "i d i o t", "stuuupid", "tr@sh", "los€r", "mоron"]
    texts = [" ".join(w for _ in range(30) for w in ([str(rng.choice(bad))] if rng.random() < 0.1 else [str(rng.choice(WORDS))])) for _ in range(60)] + ["", None]
    names = sorted({w[:n] + "*" * (n < len(w)) for w in WORDS for n in (4, 5, 6, 7, 99) if n >= 99 or n < len(w)})
    number = {}
    for name in names:
        h = toxicity.word_features(pa.array([name.rstrip("*") + ("x" * 9 if name.endswith("*") else "")]))[1]
        number[name] = h[0] if not name.endswith("*") else h[1 + toxicity.BEGINNINGS.index(len(name) - 1)]
    value = dict(zip(names, rng.normal(size=len(names))))
    weights = toxicity.Weights(np.array([number[n] for n in names], np.uint64), np.array([value[n] for n in names]), -0.5)
    got = toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, weights).collect()
    for r in got:
        text = texts[r["doc_id"]]
        if text is None:
            assert r["score"] is None and r["n_restored"] is None
            continue
        spans = re.findall(r"(?:\b\w )+\w\b|\S+", text)
        restored = [x for x in (toxicity.restore(s, model) for s in spans if not s.isascii() or not s.isalpha() or re.search(r"(.)\1", s)) if x]
        words = re.findall(r"\w+", text.replace("€", "e" if False else "€").lower().replace("@", " ")) + [w for x in restored for w in x.split()]
        count = Counter(x for w in words for x in [w, *(w[:n] + "*" for n in toxicity.BEGINNINGS if len(w) > n)])
        z = sum(value[n] * math.log1p(count[n]) for n in names if n in count) - 0.5
        assert r["n_restored"] == len(restored) and abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_labels_of_other_values_and_repeated_ones(spark):
    docs = spark.createDataFrame([(i, "moron idiot stupid" if i % 2 else "river house garden") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(str(i), 3.0 * (i % 2)) for i in range(20)] + [("1", 0.0), ("2", -1.0), ("word", 1.0)], "doc_id string, toxic double")
    assert {r["doc_id"] for r in toxicity.toxic(docs, labels).collect()} == set(range(1, 40, 2))


def test_toxicity_of_awkward_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.toxic(odd, labels).count() == 0
    assert toxicity.toxic(odd.limit(0), labels.limit(0)).count() == 0
    model = toxicity.letters(odd)
    got = toxicity.scored(odd, model, toxicity.Weights(np.empty(0, np.uint64), np.empty(0), -5.0)).collect()
    assert len(got) == odd.count() and all((r["score"] is None) == (r["doc_id"] in (3,) or r["n_restored"] is None) for r in got)


@pytest.fixture(scope="module")
def model():
    return licences.fit()


def judged(model, text):
    row, h = licences._line_grams([text])
    rows, z = model.logits(1, row, h)
    p = model.probabilities(z)
    return model.family(p[0], text)[0] if len(rows) and p[0, -1] < 0.5 else "none"


@pytest.mark.parametrize("family,text", [
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    ("bsd", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("public_domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("mit", "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mit", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"),
    ("apache", "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("apache", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("gpl", "The licenses for most software are designed to take away your freedom to share and change it."),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-only"), ("lgpl", "# SPDX-License-Identifier: LGPL-3.0-or-later"), ("agpl", "// SPDX-License-Identifier: (AGPL-3.0-only OR MIT)"),
    ("unknown", "SPDX-License-Identifier: Zlib"), ("bsd", "SPDX-License-Identifier: BSD-3-Clause"), ("unknown", "SPDX-License-Identifier: MITNFA"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc_by_sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("unknown", "Licensed under the Unicorn Licence, version 3."), ("unknown", "This code is released under the terms of the Ruby License."),
    ("none", "All rights of passage were reserved"), ("none", "He lost his driving license in May."), ("none", "The source of the software was released by the public foundation last year."),
    ("proprietary", "Copyright 2019 Acme Inc. All Rights Reserved."),
])
def test_lines_of_real_licences(model, family, text):
    assert judged(model, text) == family


def test_the_fit_is_inside_its_grids(model):
    assert licences.TEMPERATURES[0] < model.temperature < licences.TEMPERATURES[-1] and 0.05 < model.threshold < 0.95


def test_families_are_told_apart_held_out(model):
    """Hard-wrapped licences with words lost; licences and sentences that no fit has seen."""
    import random
    import textwrap

    rng = random.Random(99)
    right = total = 0
    for family, notices in licences.NOTICES.items():
        for _ in range(12):
            some = rng.sample(notices, min(3, len(notices)))
            text = "\n".join(line for t in some for line in textwrap.wrap(" ".join(w for w in t.split() if rng.random() > 0.03), rng.randint(60, 100)))
            got = Counter(x for x in (judged(model, line) for line in text.split("\n")) if x not in ("none", "unknown"))
            right += bool(got) and got.most_common(1)[0][0] == family
            total += 1
    assert right / total > 0.9, right / total
    unseen = ["Released under the Do What You Want Public Licence.", "You may use this library under the Python Software Foundation License version 2.", "Distributed under the Microsoft Public License (Ms-PL).", "Licensed under the NASA Open Source Agreement 1.3.", "This corpus is released under the Linguistic Data Consortium User Agreement licence."]
    assert sum(judged(model, t) in ("unknown", "none") for t in unseen) == len(unseen)
    plain = ["The meeting was held under the general terms of the treaty.", "She sold a copy of the book for a fee and granted him the rest.", "Damages were awarded, including the loss of profits.", "The files may be found in the office of the secretary."]
    assert sum(judged(model, t) == "none" for t in plain) >= 3


def test_logits_against_a_plain_sum(model):
    weight = dict(zip(model.hashes.tolist(), model.weights))
    for text in ("Released under the MIT License and the GNU GPL.", "the software, the software, the software is provided", "river license"):
        w = licences.words(text)
        grams = {tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        known = [weight[h] for g in grams if (h := int(licences._line_grams([" ".join(g)])[1][-1])) in weight]
        row, h = licences._line_grams([text])
        assert np.allclose(model.logits(1, row, h)[1][0], model.bias + np.sum(known, axis=0))


def test_scan_against_a_plain_version(spark, model):
    notices = [t for ts in licences.NOTICES.values() for t in ts]
    rng = np.random.default_rng(2)
    rows = [(i, "\n".join(str(rng.choice(["x y", "", "The river runs.", *notices[:: 7]])) for _ in range(int(rng.integers(1, 6))))) for i in range(80)]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    for k, text in rows:
        lines = [t for t in text.split("\n") if t]
        found = [(judged(model, t), i) for i, t in enumerate(lines)]
        found = [x for x in found if x[0] != "none"]
        assert got[k]["n_notices"] == len(found)
        assert got[k]["family"] in {f for f, _ in found if f != "unknown"} or got[k]["family"] == ("unknown" if found else "none")


def test_plain_and_other_licences(spark, model):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "He lost his driving license in May."), (3, "Licensed under the Unicorn Licence, version 3."), (4, None), (5, ""), (None, "All rights reserved.")]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    assert got[1]["family"] == "mit" and got[1]["line"] == 1 and got[2]["family"] == "none" and got[3]["family"] == "unknown"
    assert got[4]["family"] == got[5]["family"] == "none" and got[None]["family"] == "proprietary"


def test_licences_of_awkward_rows(spark, odd):
    got = licences.scan(odd).collect()
    assert len(got) == odd.count() and all(r["family"] == "none" and r["line"] is None and r["n_notices"] == 0 for r in got)
    assert licences.scan(odd.limit(0)).count() == 0
