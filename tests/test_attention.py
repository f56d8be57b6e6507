"""Attention over tokens: gradients against differences, learning, missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import attention


@pytest.mark.parametrize("shared", [True, False])
def test_gradients_match_differences(shared):
    rng = np.random.default_rng(1)
    p = attention.start(3, 4, 8, 2, 6, shared, 5)
    x, y = rng.normal(size=(7, 3, 4)), np.array([0, 1, 1, 0, 1, 0, 0.0])
    _, g = attention.gradients(p, 2, x, y, 1.7)
    for k in p:
        for at in rng.choice(p[k].size, min(4, p[k].size), replace=False):
            losses = []
            for e in (1e-6, -1e-6):
                q = {n: v.copy() for n, v in p.items()}
                q[k].flat[at] += e
                losses.append(attention.gradients(q, 2, x, y, 1.7)[0])
            assert abs((losses[0] - losses[1]) / 2e-6 - g[k].flat[at]) < 1e-6, k


def test_pairs_are_told_by_their_product(spark):
    """A linear model can't tell whether two vectors agree; attention over the two tokens can."""
    rng = np.random.default_rng(2)
    a, b = rng.choice([-1.0, 1.0], 1200), rng.choice([-1.0, 1.0], 1200)
    rows = [(i, [float(s), 0.1, 0.0], [float(t), -0.1, 0.0], int(s == t), "kept") for i, (s, t) in enumerate(zip(a, b))]
    rows = spark.createDataFrame(rows, "id int, article array<double>, ref array<double>, is_reference_valid int, x string").repartition(2, "id")
    model = attention.Attention("pairs", ["article", "ref"], size=3, width=16, heads=2, layers=1, rate=5e-3, batch=32).train(rows, rows, rounds=6)
    out = model.predict(rows)
    assert out.where("prediction = is_reference_valid").count() > 1100 and set(rows.columns) | {"probability", "prediction"} == set(out.columns)
    odd = spark.createDataFrame([(1, None, [1.0, None, 0.0]), (2, None, None)], "id int, article array<double>, ref array<double>")
    assert all(0 <= r.probability <= 1 for r in model.predict(odd).collect()) and model.predict(odd.limit(0)).count() == 0
    with pytest.raises(Exception, match="length 3"):
        model.predict(odd.withColumn("ref", F.array(F.lit(1.0)))).collect()


def test_features_as_tokens(spark):
    rows = spark.range(600).select("id", ((F.col("id") % 7) / 3.5 - 1).alias("a"), ((F.col("id") % 5) / 2.5 - 1).alias("b")).withColumn("is_reference_valid", F.when(F.col("id") > 5, (F.col("a") > F.col("b")).cast("int")))
    model = attention.Attention("tokens", ["a", "b"], width=8, heads=2, layers=1, rate=1e-2, batch=32).train(rows, rounds=4)
    assert model.predict(rows).where("prediction = is_reference_valid").count() > 520
    before = model.params
    assert model.train(rows.limit(0), rounds=1).params is before


def test_synchronous_steps_beat_a_linear_model_and_ignore_partitions(spark, tmp_path):
    """A planted interaction of two features: the sign of their product."""
    from citeweave.operators import models

    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    rows = spark.createDataFrame([(i, *map(float, r), int(r[0] * r[1] > 0)) for i, r in enumerate(x)], "id int, a double, b double, c double, is_reference_valid int")
    train, held = rows.where("id < 700"), rows.where("id >= 700")
    make = lambda: attention.Attention("tokens", ["a", "b", "c"], width=16, heads=2, layers=1, rate=1e-2, batch=100)
    one, two = (make().train(train.repartition(n), rounds=2) for n in (1, 5))
    assert max(np.abs(one.params[k] - two.params[k]).max() for k in one.params) < 1e-9 and one.step == 14
    model = make().train(train, rounds=12)
    linear = models.Logistic("linear", ["a", "b", "c"], maxIter=50).train(train)
    share = lambda m: m.predict(held).where("prediction = is_reference_valid").count() / 200
    assert share(model) > 0.85 > 0.65 > share(linear)
    model.save_into(f"file://{tmp_path}/m")
    again = make().load_from(f"file://{tmp_path}/m")
    assert all(np.array_equal(model.params[k], again.params[k]) for k in model.params) and again.step == model.step
    with pytest.raises(ValueError):
        attention.Attention("other", ["a"], width=8, heads=2).load_from(f"file://{tmp_path}/m")


def test_a_round_is_one_stage_and_steps_as_jobs_agree(spark, monkeypatch):
    """a step was a job; the jobs of training don't grow with its steps, and the weights stay the same."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(*map(float, r), int(r[0] > 0)) for r in rng.normal(size=(640, 2))], "a double, b double, is_reference_valid int").repartition(3)
    make = lambda: attention.Attention("tokens", ["a", "b"], width=8, heads=2, layers=2, batch=32)
    jobs, models = [], []
    for slots in (None, 0):  # 0: as with dynamic allocation
        if slots is not None:
            monkeypatch.setattr(attention, "_slots", lambda _: slots)
        spark.sparkContext.setJobGroup(f"attention {slots}", "")
        models.append(make().train(rows, rounds=2))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"attention {slots}")))
    spark.sparkContext._jsc.clearJobGroup()
    one, two = models
    assert jobs[0] < 20 and jobs[1] >= 40 and one.step == two.step == 40
    for a, b in ((one.params, two.params), *zip(one.moments, two.moments)):
        assert max(np.abs(a[k] - b[k]).max() for k in a) < 1e-9


def test_a_failing_task_ends_the_round(spark):
    rows = spark.range(400).select(F.when(F.col("id") == 7, F.array(F.lit(1.0))).otherwise(F.array(F.col("id") / 400, F.lit(0.5))).alias("v"), (F.col("id") % 2).cast("int").alias("is_reference_valid"))
    with pytest.raises(Exception, match="length 2"):
        attention.Attention("vectors", ["v"], size=2, width=8, heads=2, layers=1, batch=100).train(rows, rounds=1)


def test_the_last_layer_asks_for_the_class_token_only():
    run = attention._Pass(attention.start(64, 1, 16, 2, 32, False, 1), 2)
    asked, attend = [], run.attend
    run.attend = lambda x, i, n: asked.append(n) or attend(x, i, n)
    run.odds(np.zeros((2, 64, 1)))
    assert asked == [65, 1]
