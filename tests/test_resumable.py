"""Parts that survive a stop, and artifacts of every kind of model."""

import pytest
from pyspark.sql import functions as F

from citeweave.operators import artifacts, attention, boosting, models
from citeweave.sources import resumable


def test_a_stopped_job_goes_on(spark, tmp_path):
    files = {}
    for k in range(5):
        spark.range(k * 10).write.parquet(f"file://{tmp_path}/in/{k}")
        files[f"part {k}"] = [f"file://{tmp_path}/in/{k}"]
    made = []

    def make(key, inputs, stop=None):
        if key == stop:
            raise RuntimeError("stopped")
        made.append(key)
        return spark.read.parquet(*inputs).withColumn("part", F.lit(key))

    out = f"file://{tmp_path}/out"
    with pytest.raises(RuntimeError):
        resumable.write_parts(spark, out, files, lambda k, f: make(k, f, "part 2"))
    assert made == ["part 0", "part 1"]
    with pytest.raises(ValueError, match="part 2"):
        resumable.merge_parts(spark, out, files, f"file://{tmp_path}/table")
    # as if a run had ended between a part's move and its record, and another in the middle of a write
    name = resumable.Ledger(spark, out).digest("part 3", files["part 3"])
    spark.range(3).write.parquet(f"{out}/parts/{name}")
    spark.range(3).write.parquet(f"{out}/aside/half")
    state = resumable.write_parts(spark, out, files, make)
    assert list(state.values()) == ["kept", "kept", "written", "written", "written"] and made == [f"part {k}" for k in range(5)]
    for _ in range(2):
        got = resumable.merge_parts(spark, out, files, f"file://{tmp_path}/table")
        assert {r.part: r.n for r in got.groupBy("part").agg(F.count("*").alias("n")).collect()} == {f"part {k}": k * 10 for k in range(1, 5)}
    assert set(resumable.write_parts(spark, out, files, make).values()) == {"kept"}
    spark.range(7).write.mode("overwrite").parquet(f"file://{tmp_path}/in/1")
    assert list(resumable.write_parts(spark, out, files, make).values()) == ["kept", "written", "kept", "kept", "kept"]
    assert resumable.merge_parts(spark, out, files, f"file://{tmp_path}/table").count() == 97
    assert set(resumable.write_parts(spark, out, files, make, version="2").values()) == {"written"}


def test_merge_of_odd_parts(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    assert resumable.merge_parts(spark, out, {}, f"file://{tmp_path}/t", "id long").count() == 0
    with pytest.raises(ValueError):
        resumable.merge_parts(spark, out, {}, f"file://{tmp_path}/t")
    parts = {"a": [], "b": []}
    resumable.write_parts(spark, out, parts, lambda k, _: spark.range(2).select(F.col("id").alias(k)))
    with pytest.raises(ValueError, match="differ"):
        resumable.merge_parts(spark, out, parts, f"file://{tmp_path}/t")


def test_artifacts_of_all_kinds_predict_alike(spark, tmp_path):
    rows = spark.range(120).select("id", ((F.col("id") % 7) / 7).alias("a"), ((F.col("id") % 5) / 5).alias("b")).withColumn("is_reference_valid", (F.col("a") + F.col("b") > 0.8).cast("int"))
    names, path = ["a", "b"], f"file://{tmp_path}/models"
    fitted = [
        models.BoostedTrees("gbt", names, maxIter=2).train(rows), models.Forest("forest", names, numTrees=2).train(rows), models.Logistic("logistic", names, maxIter=5).train(rows),
        models.Perceptron("perceptron", names, hidden=(3,), maxIter=5).train(rows), boosting.LeafwiseBoosting("leafwise", names, key="id", rounds=2, bins=8).train(rows),
        attention.Attention("attention_pairs", names, width=4, heads=2, layers=1, batch=100).train(rows, rounds=1),
    ]
    for model in fitted:
        at = artifacts.save(model, path, model.evaluate(rows), [({"depth": 2}, 0.5)], note="first")
        again = artifacts.latest(spark, path, model.name)
        got, want = ([r.probability for r in m.predict(rows).orderBy("id").collect()] for m in (again, model))
        assert type(again) is type(model) and got == want
        assert artifacts.table(spark, at, "metrics").first() == model.evaluate(rows).first()
        assert artifacts.table(spark, at, "tuning").first().score == 0.5 and artifacts.manifest(spark, at)["about"] == {"note": "first"}
    assert len(artifacts.finished(spark, path)) == 6 and artifacts.latest(spark, path, "attention") is None
    models.Logistic("logistic", names, maxIter=1).train(rows).save(path)  # without a manifest: unfinished
    assert artifacts.latest(spark, path, "logistic").params["maxIter"] == 5
    bare = artifacts.save(fitted[2], path)
    assert artifacts.table(spark, bare, "metrics") is None and artifacts.finished(spark, f"{path}/none") == []
    with pytest.raises(ValueError):
        artifacts.save(object(), path)
