import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecheck.operators import autoencoder as ae
from tablecheck.operators.model import init_weights, load_model, loss_and_gradient, save_model, unpack
from tablecheck.operators.pca import train_pca
from tablecheck.operators.quantile import approx_percentile
from tablecheck.operators.scale import numeric_columns, scale_clip, scaler_stats


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=3000)
    rows = [(i, float(x), float(2 * x + rng.normal() * 0.05), "t") for i, x in enumerate(a)]
    rows[2995:] = [(i, 3.0, -30.0, "t") for i in range(2995, 3000)]
    return spark.createDataFrame(rows, "i long, x double, y double, s string").repartition(6).cache()


def test_gradient_matches_finite_differences():
    w = init_weights(3, 4, 1).astype(np.float64)
    x = np.random.default_rng(0).random((5, 3))
    g = np.empty_like(w)
    loss_and_gradient(unpack(w, 3, 4), x, unpack(g, 3, 4))
    scratch = np.empty_like(w)
    for i in range(0, len(w), 97):
        step = np.zeros_like(w)
        step[i] = 1e-6
        up = loss_and_gradient(unpack(w + step, 3, 4), x, unpack(scratch, 3, 4))
        down = loss_and_gradient(unpack(w - step, 3, 4), x, unpack(scratch, 3, 4))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-7)


def test_numeric_columns_and_scaling(spark):
    df = spark.createDataFrame([(1, 2.0, "a", 5), (3, None, "b", 5)], "i int, x double, s string, c long")
    assert numeric_columns(df) == ["i", "x", "c"]
    with pytest.raises(ValueError):
        numeric_columns(df.select("s"))
    stats = scaler_stats(df, ["i", "x", "c"]).collect()
    assert [(r["mean"], r["std"]) for r in stats] == [(2.0, 1.0), (2.0, 1.0), (5.0, 1.0)]
    assert sorted(map(tuple, scale_clip(df, stats).collect())) == [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]
    assert sorted(map(tuple, scale_clip(df, stats, None, ["s"]).collect())) == [("a", -1.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0)]


def test_pca_flags_the_planted_points(spark, points):
    model = train_pca(points, 1, ["x", "y"])
    z = np.array(points.orderBy("i").select("x", "y").collect(), dtype=float)
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    expected = np.mean((z - np.outer(z @ vt[0], vt[0])) ** 2, axis=1)
    scored = ae.reconstruction_error(points, model)
    got = np.array([r["reconstruction_error"] for r in scored.orderBy("i").collect()])
    np.testing.assert_allclose(got, expected, rtol=1e-6, atol=1e-12)
    assert model.threshold == pytest.approx(np.percentile(expected, 95), rel=1e-6)
    worst = ae.classify(scored, model.threshold).where("severity = 'critical'").select("i")
    assert {r["i"] for r in worst.collect()} >= set(range(2995, 3000))
    assert scored.columns == [*points.columns, "reconstruction_error"]


def test_autoencoder_learns_and_survives_saving(spark, points, tmp_path):
    model = ae.train_autoencoder(points, order=["i"], columns=["x", "y"], epochs=8, learning_rate=0.003, seed=1)
    again = ae.train_autoencoder(points, order=["i"], columns=["x", "y"], epochs=1, learning_rate=0.003, seed=1)
    assert model.validation_loss < again.validation_loss and model.training_samples == 2400
    assert (model.encoding_dim, model.percentile, model.feature_names) == (16, 95.0, ["x", "y"])
    first = ae.reconstruction_error(points.where("i < 2400"), model)
    above = first.where(F.col("reconstruction_error") > model.threshold).count()
    assert 0.04 * 2400 <= above <= 0.06 * 2400
    save_model(spark, model, str(tmp_path / "m"))
    loaded = load_model(spark, str(tmp_path / "m"))
    assert loaded == model
    a = {r["i"]: r["reconstruction_error"] for r in ae.reconstruction_error(points, model).collect()}
    b = {r["i"]: r["reconstruction_error"] for r in ae.reconstruction_error(points, loaded).collect()}
    assert a == b


def test_early_stop_and_hash_split(spark, points):
    model = ae.train_autoencoder(points, split_on=["i"], columns=["x", "y"], epochs=30, patience=1, learning_rate=0.5)
    assert model.epochs_trained < 30
    first, rest = ae.split_by_hash(points, ["i"])
    assert first.count() + rest.count() == 3000 and 2200 < first.count() < 2600
    for bad in ({}, {"order": ["i"], "split_on": ["i"]}):
        with pytest.raises(ValueError):
            ae.train_autoencoder(points, columns=["x", "y"], **bad)


def test_averaging_tree_equals_flat_average(spark, points, monkeypatch):
    z = scale_clip(points, scaler_stats(points, ["x", "y"]).collect()).repartition(7).cache()
    w = init_weights(2, 16, 1)
    state = np.concatenate([w, w * 0, w * 0])
    rows, loss, flat = ae._epoch(z, state, 0, (2, 16), 0.001, 32, 1)
    monkeypatch.setattr(ae, "FAN_IN", 2)
    rows2, loss2, tree = ae._epoch(z, state, 0, (2, 16), 0.001, 32, 1)
    assert rows == rows2 == 3000 and loss == pytest.approx(loss2, rel=1e-6)
    np.testing.assert_allclose(flat, tree, atol=1e-6)


def test_summary_of_severities(spark):
    df = spark.createDataFrame([(0.4,), (0.6,), (9.0,), (None,)], "reconstruction_error double")
    one = ae.anomaly_summary(ae.classify(df, 0.5), 0.5).first()
    assert (one["total_records"], one["anomaly_count"], one["anomaly_percentage"]) == (4, 2, 50.0)
    assert one["severity_counts"] == {"normal": 2, "low": 1, "critical": 1}
    none = ae.anomaly_summary(ae.classify(df.where("false"), 0.5), 0.5).first()
    assert (none["total_records"], none["anomaly_percentage"], none["severity_counts"]) == (0, 0.0, {})


def test_approximate_percentile_is_close(spark, points):
    exact = np.percentile([r["x"] for r in points.select("x").collect()], 95)
    assert approx_percentile(points, "x").first()["threshold"] == pytest.approx(exact, abs=0.05)


def test_scorable(spark):
    asked = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "c")], "scoring_id string, model_id string")
    models = spark.createDataFrame([("a", "completed"), ("b", "failed")], "model_id string, status string")
    ok, bad = ae.scorable(asked, models)
    assert [r["scoring_id"] for r in ok.collect()] == ["s1"]
    assert {r["scoring_id"]: r["reason"] for r in bad.collect()} == {"s2": "model not ready", "s3": "model not found"}


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    """Splits that hold no rows, or an ordered split, left training to few tasks."""
    sizes, fit = [], ae._fit

    def seen(train, *args):
        sizes.append(train.groupBy(F.spark_partition_id()).count().toPandas()["count"].tolist())
        return fit(train, *args)

    monkeypatch.setattr(ae, "_fit", seen)
    rows = spark.range(0, 4000, 1, 16).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    rows = rows.where("id < 1000")  # 12 of 16 partitions are empty
    model = ae.train_autoencoder(rows, order=["id"], columns=["x", "y"], epochs=1)
    assert model.training_samples == 800
    assert len(sizes[0]) == spark.sparkContext.defaultParallelism and max(sizes[0]) <= 2 * min(sizes[0])
