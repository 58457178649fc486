from __future__ import annotations

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from ridgeline.llm.quality import QualityModel, co_train, fit_logistic, meta_view, newton, pseudo_sums, score, text_view, train

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = train(docs, labels.where(~held))
    test = score(docs, model).join(labels.where(held), "doc_id")
    right = test.select(F.avg((F.col("accepted") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right >= 0.95
    lost = test.where("quality = 1").select(F.avg((~F.col("accepted")).cast("int"))).first()[0]
    assert lost <= 0.02


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 2000)
    views = [truth[:, None] * 3.0 + rng.normal(size=(2000, k)) for k in (4, 3)]
    others = [x[40:] for x in views]
    seen = []

    def pool(teachers, weights):
        seen.append(pseudo_sums(others, teachers, weights, 0.9))
        return seen[-1]

    model = co_train(views[0][:40], views[1][:40], truth[:40], pool, rounds=4, steps=2, ridge=0.1, trust=1.0)
    assert len(seen) == 8 and min(model.pseudo_labels) > 500
    assert ((model.scores(*views)[2] >= 0.5) == truth).mean() > 0.97


def plain_train(features, known, rounds, steps, sure, ridge, trust):
    """The rounds on all documents at once, from plain weighted sums."""
    label = np.array([known.get(r.doc, -1) for r in features])
    order = sorted(np.flatnonzero(label >= 0), key=lambda i: (features[i].hash, features[i].doc))
    views = [np.array([getattr(r, c) for r in features], np.float64) for c in ("text", "meta")]
    y = label[order]
    held = np.zeros(len(y), bool)
    for value in (0, 1):
        held[np.flatnonzero(y == value)[1::4]] = True
    fit = np.array(order)[~held]
    ones = [np.hstack([x, np.ones((len(x), 1))]) for x in views]
    w = [fit_logistic(x[fit], label[fit].astype(float), ridge) for x in views]
    for _ in range(rounds):
        sureness = [1 / (1 + np.exp(-np.clip(x @ v, -35, 35))) for x, v in zip(ones, w)]
        for _ in range(steps):
            new = []
            for i in range(2):
                p = sureness[1 - i]
                weight, target = np.zeros(len(label)), np.zeros(len(label))
                weight[fit], target[fit] = 1, label[fit]
                for value, chance in ((1, p), (0, 1 - p)):
                    own = (label < 0) & (chance >= sure)
                    weight[own], target[own] = min(1, trust * (label[fit] == value).sum() / max(own.sum(), 1)), value
                q = 1 / (1 + np.exp(-np.clip(ones[i] @ w[i], -35, 35)))
                slope = ones[i].T @ (weight * (q - target))
                curve = (ones[i] * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ ones[i]
                new.append(newton(w[i], slope, curve, ridge))
            w = new
    return w


def test_rounds_use_every_document(spark):
    """Equal to a plain version on all documents at once; documents of a rare source change the fit."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("rare", F.col("doc_id") % 97 == 0)
    docs = docs.withColumn("source", F.when(F.col("rare"), "rare").otherwise(F.col("source"))).drop("rare")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    options = {"rounds": 2, "steps": 2, "sure": 0.9, "ridge": 0.05, "trust": 1.0}
    model = train(docs, labels, **options)
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("doc_id").alias("hash"), "text", "source", "lang", "n_chars").collect()
    made = [Row(doc=r.doc, hash=r.hash, text=text_view(r.text).astype(np.float32), meta=meta_view(r.source, r.lang, r.n_chars).astype(np.float32)) for r in rows]
    known = {r.doc_id: r.quality for r in labels.collect()}
    text, meta = plain_train(made, known, **options)
    assert np.abs(model.text - text).max() < 1e-6 and np.abs(model.meta - meta).max() < 1e-6
    assert min(model.pseudo_labels) > 0
    rare = [i for i, r in enumerate(rows) if r.source == "rare" and r.doc not in known]
    sums = pseudo_sums([np.array([getattr(made[i], c) for i in rare], float) for c in ("text", "meta")], [text, meta], [text, meta], 0.9)
    assert rare and sum(s.rows for s in sums.values()) > 0  # a rare source gets pseudo-labels


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, c0 int"
    rows = [(i, ("good text here " * 5, "XX!! YY!! ")[i % 2], "en", "s", 50, "q", 1) for i in range(60)]
    rows += [(None, None, None, None, None, None, None), (61, "", "en", "s", 0, "q", 1), (62, "z" * 100_000, "en", "s", -5, "q", 1), rows[0]]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, 1 - i % 2, 9) for i in range(30)] + [(0, 0, 1), (0, 1, 1), (None, 1, 1), (31, None, 1)], "doc_id long, quality int, score int")
    model = train(docs, labels)
    out = score(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "c0", "text_score", "meta_score", "score", "accepted"]
    got = {r.doc_id: r.accepted for r in out.collect()}
    assert all(got[i] == (i % 2 == 0) for i in range(60)) and len(out.collect()) == len(rows)
    kept = score(docs, model, filtering=True)
    assert kept.schema == docs.schema and kept.count() == sum(r.accepted for r in out.collect())
    assert score(docs.limit(0), model).count() == 0
    for none, prior in ((labels.limit(0), 1.0), (labels.where("quality = 0 and doc_id > 0"), 0.0)):
        model = train(docs, none)
        assert isinstance(model, QualityModel) and model.prior == prior and score(docs, model).where(F.col("score") != prior).count() == 0
