from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ridgeline.llm.common import materialize
from ridgeline.llm.queries import MIX_SHARE, MIX_TEMPER, TOPIC_MARKS, TOPIC_SIZES, llm_oracles, llm_queries
from verification.compare import connect, mismatch

from .test_lines import expected as expected_lines
from .test_mixing import plain_rake
from .test_shingles import kept_by_brute_force

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), "test-stage")
        out.append(docs)
    return [frame.toPandas() for frame in out]


def test_order_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for frame in stages[:-1]:
        assert sorted(frame.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        assert frame.doc_id.is_unique


def test_quality_stage_rejects_junk_only(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    kept = labels.doc_id.isin(stages[1].doc_id)
    assert (kept == (labels.quality == 1)).mean() >= 0.95
    assert kept[labels.quality == 1].mean() >= 0.98
    same = stages[0].set_index("doc_id").loc[stages[1].doc_id]
    assert (same.text.values == stages[1].text.values).all()


def test_line_stage(stages):
    got = sorted(stages[2][["doc_id", "text"]].itertuples(index=False, name=None), key=str)
    assert got == sorted([r[:2] for r in expected_lines(list(stages[1][["doc_id", "text"]].itertuples(index=False, name=None)))], key=str)
    assert (stages[2].n_chars == stages[2].text.str.len()).all()


def test_near_copy_stage(stages):
    """One text of each chain of five-word Jaccard similarities of 0.8 or more, found by comparing all pairs."""
    rows = list(stages[2][["doc_id", "text"]].itertuples(index=False, name=None))
    assert sorted(stages[3].doc_id) == kept_by_brute_force(rows)


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, hashed int, label int, chance double, dim0 string"


def written(spark, folder, rows, labels):
    """A folder with documents, whose extra columns have names that stages use, and labels."""
    spark.createDataFrame([(*r, "k", 1, 2, 0.5, "d") for r in rows], ODD).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows_through_all_stages(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rows = [(i, " ".join(words[(i * k) % 12] + str(i * k % 97) for k in range(1, 60)), "en", "web", 300) for i in range(1, 60)]
    rows += [rows[0], rows[0], (70, None, None, None, None), (71, None, "en", "web", 0), (72, "", "en", "web", 0), (73, " \n ", "fr", None, -3)]
    rows += [(None, "a text without an id", "en", "web", 20), (74, "z" * 300_000, "en", "long", 300_000), (75, "word " * 60_000, "en", "long", 300_000)]
    folder = written(spark, tmp_path / "odd", rows, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), "odd-stage")
        assert sorted(docs.columns) == sorted(corpus_pipeline.DOCUMENT)
        kept.append([r.doc_id for r in docs.collect()])
    assert sorted(kept[0], key=str) == sorted((r[0] for r in rows), key=str) == sorted(kept[1], key=str)  # no labels, no lines in three documents
    # of the texts without words 70 stays; repeated rows of an id stay together
    assert sorted(kept[2], key=str) == sorted((r[0] for r in rows if r[0] not in (71, 72, 73)), key=str)
    assert set(kept[3]) <= set(kept[2]) and 70 in kept[3] and kept[3].count(1) in (0, 3)
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted(kept[3], key=str) and all(r.round_trip for r in out)


def test_empty_tables_through_all_stages(spark, tmp_path):
    out = corpus_pipeline.run(spark, written(spark, tmp_path / "none", [], []))
    assert out.count() == 0 and "ids" in out.columns


def test_mixing_stage_equals_plain_raking(spark, stages):
    """The probabilities of the stage, from loops over the cells, decide who stays."""
    docs = stages[3]
    topic = [
        next((name for name, mark in TOPIC_MARKS if mark in t), next((name for name, size in TOPIC_SIZES if len(t) < size), "long")) for t in docs.text
    ]
    keys = list(zip(docs.source, docs.lang, topic))
    cells = {}
    for k, text in zip(keys, docs.text):
        cells[k] = cells.get(k, 0.0) + len(re.findall(r"[^\x09-\x0D\x20]+", text))
    targets = []
    for place in range(3):
        own = {}
        for k, v in cells.items():
            own[k[place]] = own.get(k[place], 0.0) + v
        targets.append({k: v**MIX_TEMPER for k, v in own.items() if v > 0})
    raked = plain_rake(cells, targets, corpus_pipeline.MIX_MOST_ROUNDS, MIX_SHARE)
    draw = [int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 16**13 for i in docs.doc_id]
    chance = [raked[k] / cells[k] if cells[k] else 1.0 for k in keys]
    sure = [(i, d < c) for i, d, c in zip(docs.doc_id, draw, chance) if abs(d - c) > 0.01]  # the rounds end at a movement of 0.001
    assert len(sure) > 0.9 * len(docs)
    kept = set(stages[4].doc_id)
    assert all((i in kept) == stays for i, stays in sure)


def test_mixing_and_token_stages(stages):
    assert set(stages[4].doc_id) <= set(stages[3].doc_id) and 0 < len(stages[4])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = stages[4].set_index("doc_id").text
    assert sorted(stages[5].doc_id) == sorted(stages[4].doc_id) and stages[5].round_trip.all()
    for row in stages[5].itertuples():
        assert list(row.ids) == library.encode(text[row.doc_id], add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_queries_equal_sql(spark, name):
    assert mismatch(llm_queries()[name](spark, FOLDER).toPandas(), connect(FOLDER).execute(llm_oracles()[name]).df()) is None


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in llm_queries()) == list(range(1, 14))


def test_token_queries_equal_the_library(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().sort_values("doc_id")
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = llm_queries()["op2_token_counts"](spark, FOLDER).toPandas().sort_values("doc_id")
    assert got.n_tokens.tolist() == [len(words.encode(t, add_special_tokens=False).ids) for t in docs.text]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = llm_queries()["op4_bpe_round_trip"](spark, FOLDER).toPandas().sort_values("doc_id")
    digest = [hashlib.sha256(np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for t in docs.text]
    assert got.ids_sha256.tolist() == digest
    assert got.decoded_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in docs.text]
