"""The pipeline's stages, one after another, on rows with planted cases."""

import numpy as np

import corpus_pipeline
from attesta.llm import queries


def test_stages_keep_clean_documents_and_drop_planted_ones(spark):
    rng = np.random.default_rng(8)
    part = lambda: "".join(rng.choice(list("bdfgklmnprst"), 1)) + "".join(rng.choice(list("aeiou"), 1))
    words = ["".join(part() for _ in range(rng.integers(1, 5))) for _ in range(1500)]
    prose = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, "\n".join(prose(30) for _ in range(5)), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[0][1], "s0") for i in range(3)]  # exact copies
    edited = rows[1][1].split(" ")
    edited[::12] = [f"x{i}" for i in range(len(edited[::12]))]  # too often for the line stage
    rows += [(200, " ".join(edited), "s1"), (300, "spam " * 900, "s1"), (301, None, "s1"), (302, "", None)]
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept, df = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
        df = spark.createDataFrame(df.collect(), df.schema)
        kept[name] = {r["doc_id"] for r in df.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == docs.columns
    clean = set(range(2, 60))
    assert kept["quality_rules"] == {k for k, _, _ in rows} - {300, 301, 302}
    assert clean <= kept["line_dedup"] and not {100, 101, 102} & kept["line_dedup"]
    assert clean <= kept["near_dedup"] and len(kept["near_dedup"] & {1, 200}) == 1
    assert kept["sentence_pieces"] == kept["mix_sources"] <= kept["near_dedup"]
    assert all(r["lossless"] for r in df.collect())


def test_stages_take_awkward_rows(spark, odd):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, no rows at all."""
    df, kept = odd, {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
        kept[name] = sorted(str(r["doc_id"]) for r in df.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == odd.columns
    assert kept["quality_rules"] == ["1", "1", "6", "7", "8", "None"] and kept["line_dedup"] == ["1", "1", "6", "7", "8", "None"]
    assert kept["near_dedup"] == ["1", "6", "8", "None"] and set(kept["mix_sources"]) <= {"1", "6", "8"} and kept["sentence_pieces"] == kept["mix_sources"]
    empty = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names if n.startswith("op")] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "sentence_pieces"]
