from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm.mixing import mix, shortfalls, word_count

from .test_mixing import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
def margins():
    return {"source": F.col("source"), "lang": F.col("lang")}



def frame_of(spark, data):
    return spark.createDataFrame([(*r, len(r[1])) for r in data], SCHEMA)


def many():
    """4,000 documents of many words."""
    return [(10_000 * turn + number, text * 20, lang, source) for turn in range(10) for number, text, lang, source in rows()]


def test_a_rare_document_hardly_moves_the_kept_share(spark):
    kept = []
    for extra in ([], [(999_999, "word " * 50, "xx", "rare")]):
        frame = frame_of(spark, many() + extra)
        got = corpus_pipeline.mixing_stage(spark, frame, "")
        kept.append(got.where("doc_id < 999999").count() / 4000)
    assert kept[1] == pytest.approx(kept[0], abs=0.01)


def test_expected_total_and_shortfalls(spark):
    frame = frame_of(spark, [*many(), (999_999, "word " * 50, None, "rare")])
    words = word_count(F.col("text"))
    mixed = mix(frame, margins(), words, rounds=8, share=0.65).withColumn("words", words).toPandas()
    assert mixed.probability.between(0, 1).all() and mixed[mixed.source == "rare"].probability.iloc[0] == 1
    expected = (mixed.words * mixed.probability).sum()
    assert expected / mixed.words.sum() == pytest.approx(0.65, abs=0.005)
    lacking = shortfalls(frame, margins(), words, 0.65, rounds=8).toPandas()
    for name in margins():
        own = lacking[lacking.margin == name]
        assert own.wanted.sum() == pytest.approx(0.65 * mixed.words.sum())
        assert own.expected.sum() == pytest.approx(expected)
        assert (own.shortfall == own.wanted - own.expected).all()
    rare = lacking[lacking.value == "rare"].iloc[0]
    assert rare.expected == rare.own == 50 and rare.shortfall > 0
    others = lacking[(lacking.margin == "source") & (lacking.value != "rare")]
    assert (others.shortfall.abs() <= 0.02 * others.wanted).all()


def test_given_targets_with_share(spark):
    frame = frame_of(spark, many())
    targets = {k: spark.createDataFrame(v, "value string, share double") for k, v in {"source": [("big", 2.0), ("mid", 1.0)], "lang": [("en", 1.0), (None, 1.0)]}.items()}
    got = mix(frame, margins(), word_count(F.col("text")), targets, rounds=8, share=0.01).toPandas()
    assert (got[~got.source.isin(["big", "mid"])].probability == 0).all()
    words = got.text.str.split().str.len()
    assert (words * got.probability).sum() / words.sum() == pytest.approx(0.01, rel=1e-3)
