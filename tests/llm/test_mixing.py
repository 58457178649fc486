from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.llm.mixing import mix, rake, tempered_targets, word_count
from ridgeline.llm.queries import MIX_ROUNDS, MIX_SHARE, MIX_TEMPER, MIXING, mixing_dims, mixing_sql

from .comparing import assert_same_rows

SCHEMA = "doc_id long, text string, lang string, source string, chance string, dim0 int"


def rows():
    out = []
    for i in range(400):
        source = ["big", "big", "big", "mid", None, "small"][i % 6] if i % 37 else "tiny"
        text = "w " * (i % 90 + 1) + (" | " if i % 11 == 0 else "") + ("%%%" if i % 29 == 0 else "")
        out.append((i, text, ["en", "fr", None][i % 7 % 3], source))
    return out


def test_odd_rows_equal_sql(spark):
    data = [*rows(), (500, "", "xx", "empty"), (501, None, "en", "big"), (502, "y " * 30_000, "de", "long"), (502, "y " * 30_000, "de", "long")]
    frame = spark.createDataFrame([(*r, "c", 1) for r in data], SCHEMA)
    dims = mixing_dims()
    mixed = mix(frame, dims, word_count(F.col("text")), temper=MIX_TEMPER, rounds=MIX_ROUNDS, share=MIX_SHARE)
    assert mixed.columns == [*frame.columns, "probability", "sampled"]
    got = mixed.select("doc_id", "source", "lang", dims["topic"].alias("topic"), F.round("probability", 9).alias("probability"), "sampled")
    documents = pd.DataFrame(data, columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    assert_same_rows(got, duckdb.sql(f"{mixing_sql()} {MIXING}"))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    nameless = mix(frame.withColumn("doc_id", F.lit(None).cast("long")), dims, word_count(F.col("text")))
    assert nameless.where("sampled is null").count() == 0
    assert mix(frame.limit(0), dims, word_count(F.col("text"))).count() == 0


def test_margins_meet_given_targets(spark):
    frame = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    wanted = {"source": [("big", 0.4), ("mid", 0.3), (None, 0.1), ("small", 0.2), ("nowhere", 5.0)], "lang": [("en", 1.0), ("fr", 2.0), (None, 1.0)]}
    targets = {k: spark.createDataFrame(v, "value string, share double") for k, v in wanted.items()}
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    mixed = mix(frame, dims, word_count(F.col("text")), targets, rounds=30).toPandas()
    mixed["tokens"] = mixed.text.str.split().str.len() * mixed.probability
    assert (mixed[mixed.source == "tiny"].probability == 0).all()  # no target
    for name, pairs in wanted.items():
        pairs = [(v, s) for v, s in pairs if v != "nowhere"]
        for value, share in pairs:
            own = mixed[name].isna() if value is None else mixed[name] == value
            assert mixed[own].tokens.sum() / mixed.tokens.sum() == pytest.approx(share / sum(s for _, s in pairs), abs=1e-6)
    assert mixed.sampled.mean() == pytest.approx(mixed.probability.mean(), abs=0.08)


def plain_rake(cells, targets, rounds, share=None):
    """Raking by loops; ``cells`` maps a tuple of values to its tokens."""
    total = sum(cells.values()) * (1.0 if share is None else share)
    weight = {k: v * (1.0 if share is None else share) for k, v in cells.items()}
    for _ in range(rounds):
        for place, wanted in enumerate(targets):
            present = {k[place] for k, v in cells.items() if v > 0}
            all_wanted = sum(v for k, v in wanted.items() if k in present)
            sums = {}
            for k, v in weight.items():
                sums[k[place]] = sums.get(k[place], 0.0) + v
            for k in weight:
                aim = wanted.get(k[place], 0.0) / all_wanted * total if k[place] in present else 0.0
                weight[k] *= aim / sums[k[place]] if sums[k[place]] else 0.0
                if share is not None:
                    weight[k] = min(weight[k], cells[k])
    return weight


@pytest.mark.parametrize("share", [None, 0.3, 0.9])
def test_equal_to_plain_raking(spark, share):
    frame = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    wanted = {"source": {"big": 0.4, "mid": 0.3, None: 0.1, "small": 0.2}, "lang": {"en": 1.0, "fr": 2.0, None: 1.0}}
    # every value named twice, with two parts of its weight
    targets = {k: spark.createDataFrame([(v, s * part) for v, s in own.items() for part in (0.25, 0.75)], "value string, share double") for k, own in wanted.items()}
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    got = mix(frame, dims, word_count(F.col("text")), targets, rounds=7, share=share)
    assert got.count() == frame.count()
    cells = {}
    for _, text, lang, source in rows():
        cells[source, lang] = cells.get((source, lang), 0) + len(text.split())
    raked = plain_rake(cells, [wanted["source"], wanted["lang"]], 7, share)
    most = max(raked[k] / cells[k] for k in cells) if share is None else 1.0
    for row in got.collect():
        assert row.probability == pytest.approx(raked[row.source, row.lang] / cells[row.source, row.lang] / most, abs=1e-9)


def test_rounds_end_when_nothing_moves(spark):
    cells = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 1.0), ("b", "x", 2.0), ("b", None, 9.0)], "dim0 string, dim1 string, own double")
    targets = {d: tempered_targets(cells, d, 0.5) for d in ("dim0", "dim1")}
    raked, moved = rake(cells, ["dim0", "dim1"], targets, 200, tolerance=1e-4)
    assert 0 < moved <= 1e-4
    for dim in ("dim0", "dim1"):
        rows_ = raked.groupBy(dim).agg(F.sum("own").alias("own"), F.sum("weight").alias("weight")).collect()
        roots = sum(r.own**0.5 for r in rows_)
        assert all(r.weight == pytest.approx(17 * r.own**0.5 / roots, rel=1e-2) for r in rows_)
    assert rake(cells, ["dim0", "dim1"], targets, 1, tolerance=0.0)[1] > 1e-3


@pytest.mark.parametrize("weight", [None, -1.0])
def test_refused_targets(spark, weight):
    frame = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    targets = {"lang": spark.createDataFrame([("en", weight), ("fr", 1.0)], "value string, share double")}
    with pytest.raises(Exception, match="null or negative"):
        mix(frame, {"lang": F.col("lang")}, word_count(F.col("text")), targets).collect()
