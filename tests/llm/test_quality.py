"""The rule ensemble: held-out accuracy, compiled rules against plain ones, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from lapwing.llm import quality
from lapwing.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scored = quality.op13_quality(spark, SF)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == table(spark, SF, "documents").count()
    rows = scored.join(table(spark, SF, "labels"), "doc_id").where("held_out and quality is not null").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert len(good) > 600 and all(r.predicted == 1 for r in good)
    assert len(bad) > 100 and sum(r.predicted for r in bad) <= 3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in scored.select("held_out").distinct().collect()} == {True, False}


def test_compiled_rules_score_as_plain_ones(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").limit(200)
    model = quality.fit(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels"))
    assert 3 <= len(model.rules) < 80 and len(model.told()) == len(model.rules)
    for r in quality.score(docs, model).collect():
        x = quality.statistics(r.text.encode())[None, :]
        z = model.bias + sum(w * quality.holds([rule], x)[0, 0] for rule, w in model.rules)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.3)


def test_odd_rows(spark):
    rows = [(1, "Some words here.", "a", 0.5, 7), (1, "Some words here.", "a", 0.5, 7), (None, None, None, None, None), (2, "", "b", 0.1, 1), (3, "!! " * 200000, "b", 0.1, 1), (4, "\n\n", None, 1.0, 2), (5, "日本語", "c", 0.0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text string, score double, predicted int")
    model = quality.fit(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels"))
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert got[0] == got[1] and got[2].score == got[3].score and got[0]["__text"] == "a"
    assert quality.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert {r.predicted for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {1}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert [r.h for r in docs.select(quality.held_out().alias("h")).collect()] == [zlib.crc32(str(r[0]).encode()) % 5 == 0 if r[0] is not None else False for r in rows]


def test_only_ids_not_held_out_are_learnt_from(spark):
    labels, docs = table(spark, "/root/testdata/sf0.01", "labels"), table(spark, "/root/testdata/sf0.01", "documents")
    kept = labels.where(~quality.held_out())
    flipped = labels.where(quality.held_out()).withColumn("quality", 1 - F.col("quality"))
    a, b = quality.fit(docs, labels), quality.fit(docs, kept.unionByName(flipped))
    assert a.rules == b.rules and a.bias == b.bias
