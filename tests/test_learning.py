import datetime as dt
import math
import random
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest

from faultline import fixed_values as fixed
from faultline.operators.evaluation import eval_roc_auc
from faultline.operators.sampling import downsample_negatives, temporal_split
from faultline.operators.sorting import topk_features
from faultline.plans import learning
from faultline.sinks.models import read_model, sink_model

START = dt.datetime(2024, 1, 1)
COLUMNS = (
    "host string, feature_window_start timestamp, num_logs bigint, num_errors bigint, "
    "avg_severity double, max_severity int, label_feature_window int, "
    "target_window_start timestamp, label_next_hour int, error_ratio double, "
    "year string, month string"
)


@pytest.fixture(scope="module")
def features(spark):
    """Hosts with more errors are likelier to fail in the next hour."""
    rng, rows = random.Random(3), []
    for hour in range(120):
        for host in range(10):
            if rng.random() < 0.2:
                continue
            logs, errors = rng.randint(1, 60), rng.choice([0, 0, 0, 1, 3, 9])
            label = int(rng.random() < 1 / (1 + math.exp(3 - errors)))
            at = START + dt.timedelta(hours=hour)
            rows.append(
                (f"h{host}", at, logs, errors, rng.random() * 7, rng.randint(0, 7), int(errors > 0),
                 at, label, errors / logs, "2024", "01")
            )
    return spark.createDataFrame(rows, COLUMNS).repartition(4).cache()


def test_prepare(features):
    rows = learning.ml_prepare(features, keep_host=False)
    assert not {"host", *fixed.LEAK_COLUMNS} & set(rows.columns)
    assert set(fixed.MODEL_FEATURES) < set(rows.columns)
    mean = np.mean([r.num_logs for r in features.collect()])
    row = rows.first()
    assert row.log_intensity == pytest.approx(row.num_logs / (mean + 1e-6))
    early = features.where("feature_window_start < '2024-01-02'")
    mean = np.mean([r.num_logs for r in early.collect()])
    row = learning.ml_prepare(features, fit_on=early).first()
    assert row.log_intensity == pytest.approx(row.num_logs / (mean + 1e-6))


@pytest.mark.parametrize("share", [0.8, 0.37, 0.0, 1.0])
def test_split_is_exact(features, share):
    rows = temporal_split(features, share).collect()
    order = sorted(rows, key=lambda r: (r.feature_window_start, r.host))
    limit = int(len(order) * share)
    assert [r.split for r in order] == ["train"] * limit + ["test"] * (len(order) - limit)


@pytest.mark.parametrize("fraction", [0.05, 0.5, 0.0, 1.0])
def test_downsample_is_exact_and_repeatable(features, fraction):
    rows = downsample_negatives(features, fraction).collect()
    negatives = features.where("label_next_hour = 0").count()
    taken = int(Decimal(negatives * fraction).quantize(Decimal(1), ROUND_HALF_EVEN))
    assert sum(r.label_next_hour == 0 for r in rows) == taken
    assert sum(r.label_next_hour for r in rows) == features.where("label_next_hour = 1").count()
    again = downsample_negatives(features.repartition(7), fraction).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}
    if fraction == 0.05:
        other = downsample_negatives(features, fraction, seed=7).collect()
        assert {tuple(r) for r in other} != {tuple(r) for r in rows}


def test_scale_uses_train_rows_only(features):
    rows = learning.ml_prepare(features)
    train = rows.where("feature_window_start < '2024-01-04'")
    scaled = learning.standard_scale(train, train, ["num_logs", "error_ratio"]).collect()
    values = np.array([[r.num_logs, r.error_ratio] for r in scaled])
    assert np.allclose(values.mean(axis=0), 0) and np.allclose(values.std(axis=0), 1)
    test = learning.standard_scale(rows.subtract(train), train, ["num_logs"]).collect()
    assert abs(np.mean([r.num_logs for r in test])) > 1e-9


def test_constant_column_is_only_shifted(spark):
    rows = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.x for r in learning.standard_scale(rows, rows, ["x"]).collect()] == [0.0, 0.0]


@pytest.fixture(scope="module")
def tables(features):
    return learning.training_tables(features, negative_fraction=0.5)


def newton(matrix, labels, strength=1.0, steps=60):
    """Minimum of strength * summed log loss + half the squared weights, intercept free."""
    x = np.hstack([np.ones((len(matrix), 1)), matrix])
    penalty = np.diag([0.0] + [1.0] * matrix.shape[1])
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ weights))
        gradient = strength * x.T @ (p - labels) + penalty @ weights
        hessian = strength * (x.T * (p * (1 - p))) @ x + penalty
        weights -= np.linalg.solve(hessian, gradient)
    return weights


def test_logistic_regression_finds_the_minimum(tables):
    train, _ = tables
    model = learning.train_lr(train)
    rows = train.select(*fixed.MODEL_FEATURES, "label_next_hour").toPandas()
    matrix = rows[list(fixed.MODEL_FEATURES)].to_numpy(float)
    spread = matrix.std(axis=0, ddof=0)
    scaled = (matrix - matrix.mean(axis=0)) / np.where(spread == 0, 1, spread)
    expected = newton(scaled, rows["label_next_hour"].to_numpy(float))
    found = model.stages[-1]
    assert np.allclose(found.coefficients.toArray(), expected[1:], atol=1e-3)
    assert found.intercept == pytest.approx(expected[0], abs=1e-3)

    weights = learning.lr_coefficients(model, train)
    rows = weights.collect()
    assert [r.weight for r in rows] == sorted((r.weight for r in rows), reverse=True)
    assert topk_features(weights, 2).collect() == rows[:2]
    assert topk_features(weights, 2, largest=False).collect() == rows[:-3:-1]


@pytest.mark.parametrize("kind", ["lr", "gbt"])
def test_models_predict_and_reload(spark, tables, tmp_path, kind):
    train, test = tables
    model = learning.train_lr(train) if kind == "lr" else learning.train_gbt(train, rounds=5)
    scores = learning.score_model(model, test)
    assert scores.count() == test.count()
    assert scores.where("score < 0 or score > 1 or score is null").isEmpty()
    assert eval_roc_auc(scores).first()[0] > 0.65
    sink_model(model, str(tmp_path / "model"))
    again = learning.score_model(read_model(str(tmp_path / "model")), test)
    assert scores.exceptAll(again).isEmpty()
    if kind == "gbt":
        rows = learning.feature_importance(model, train).collect()
        assert sum(r.weight for r in rows) == pytest.approx(1) and len(rows) == 10
        assert rows[0].feature in ("num_errors", "error_ratio")


def test_class_weights_balance_and_count(spark):
    rows = spark.createDataFrame([(1,)] * 2 + [(0,)] * 6, "label_next_hour int")
    weighed = learning.class_weights(rows)
    totals = {r[0]: r[1] for r in weighed.groupBy("label_next_hour").sum("class_weight").collect()}
    assert totals == {1: 6.0, 0: 6.0}
    one_class = learning.class_weights(rows.where("label_next_hour = 0"))
    assert {r.class_weight for r in one_class.collect()} == {1.0}


def test_weights_move_the_scores(tables):
    train, test = tables
    plain = learning.score_model(learning.train_lr(train), test)
    weighed = learning.train_lr(learning.class_weights(train), weight="class_weight")
    mean = [s.agg({"score": "avg"}).first()[0] for s in (plain, learning.score_model(weighed, test))]
    positives = train.where("label_next_hour = 1").count()
    if positives * 2 < train.count():
        assert mean[1] > mean[0]
