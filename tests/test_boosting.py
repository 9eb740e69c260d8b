"""Boosting with columns drawn per tree, and importance by exchanged values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators.evaluation import eval_roc_auc, roc_areas
from faultline.plans import boosting, learning
from faultline.sinks.models import read_model, sink_model

NAMES = ["strong", "weak", "noise", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(7), []
    for i in range(1500):
        strong, weak, noise = rng.randrange(12), rng.randrange(8), rng.randrange(20)
        chance = 1 / (1 + math.exp(-(0.7 * strong - 4 + 0.25 * weak)))
        out.append((f"h{i}", float(strong), float(weak), float(noise), 1.0, int(rng.random() < chance)))
    columns = "host string, " + ", ".join(f"{n} double" for n in NAMES) + ", label_next_hour int"
    return spark.createDataFrame(out, columns).repartition(3).cache()


def loss(model, rows):
    return boosting.log_loss(model, rows).first()[0]


def best_stump(x, labels, columns):
    """One Newton step of depth one by trying every split."""
    step, curve = (labels - 0.5) / 0.25, np.full(len(labels), 0.25)
    best = None
    for column in columns:
        values = np.unique(x[:, column])
        for low, high in zip(values, values[1:]):
            left = x[:, column] <= (low + high) / 2
            gain = sum((step * curve)[part].sum() ** 2 / curve[part].sum() for part in (left, ~left))
            if best is None or gain > best[0] + 1e-9:
                best = (gain, left)
    out = np.zeros(len(labels))
    for part in (best[1], ~best[1]):
        out[part] = (step * curve)[part].sum() / curve[part].sum()
    return out


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_one_round_is_a_newton_step(rows, seed):
    table = rows.select(*NAMES, "label_next_hour")
    model = boosting.train_boosted(table, NAMES, rounds=1, depth=1, rate=0.3, sample=1.0, column_sample=0.5, seed=seed)
    drawn = boosting.drawn_columns(seed, 0, len(NAMES), 0.5)
    assert len(drawn) == 2
    data = table.toPandas()
    x, labels = data[NAMES].to_numpy(float), data["label_next_hour"].to_numpy(float)
    expected = 1 / (1 + np.exp(-0.3 * best_stump(x, labels, drawn)))
    found = model.transform(table).toPandas()
    scores = np.array([p[1] for p in found["probability"]])
    order = lambda frame, values: sorted(zip(*[frame[n] for n in NAMES], values))
    assert np.allclose(order(found, scores), order(data, expected))


def test_loss_falls_and_the_model_reloads(rows, tmp_path):
    model = boosting.train_boosted(rows, NAMES, rounds=24, depth=3, rate=0.3, store_every=5)
    losses = [loss(boosting.first_rounds(model, n), rows) for n in (1, 6, 24)]
    assert losses[0] > losses[1] + 0.01 > losses[2] + 0.01 and losses[0] < math.log(2)
    scores = learning.score_model(model, rows)
    plain = learning.train_gbt(rows, NAMES, rounds=24, depth=3, rate=0.3)
    areas = [eval_roc_auc(learning.score_model(m, rows)).first()[0] for m in (model, plain)]
    assert areas[0] > areas[1] - 0.01
    sink_model(model, str(tmp_path / "model"))
    again = learning.score_model(read_model(str(tmp_path / "model")), rows)
    assert scores.exceptAll(again).isEmpty()
    weights = {r.feature: r.weight for r in learning.feature_importance(model, rows, NAMES).collect()}
    assert sum(weights.values()) == pytest.approx(1) and weights["flat"] == 0
    assert max(weights, key=weights.get) == "strong"
    used = [{node for node in range(len(NAMES)) if f"feature {node} " in tree.toDebugString} for tree in model.stages[-1].trees]
    assert all(u <= set(boosting.drawn_columns(42, i, len(NAMES), 0.8)) for i, u in enumerate(used))


def test_runs_draw_the_same_rows_and_columns(rows):
    one = boosting.train_boosted(rows, NAMES, rounds=3, depth=2)
    two = boosting.train_boosted(rows.repartition(7), NAMES, rounds=3, depth=2)
    splits = [
        [[line for line in t.toDebugString.split("\n") if "feature" in line and "If" in line] for t in model.stages[-1].trees]
        for model in (one, two)
    ]
    assert splits[0] == splits[1] and all(splits[0])
    scores = [np.sort([r.score for r in learning.score_model(m, rows).collect()]) for m in (one, two)]
    assert np.allclose(*scores, atol=1e-9)


def area(pairs):
    """Share of (positive, negative) pairs in order."""
    positive, negative = ([s for l, s in pairs if l == k] for k in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in positive for n in negative) / (len(positive) * len(negative))


@pytest.fixture(scope="module")
def linear(rows):
    return learning.train_lr(rows, NAMES)


def test_exchanged_values_are_a_permutation(rows):
    table = learning.exchanged(rows, NAMES, group_rows=100).cache()
    assert {r.feature: r["count"] for r in table.groupBy("feature").count().collect()} == dict.fromkeys(["", *NAMES], 1500)
    plain = table.where("feature = ''")
    for name in NAMES:
        variant = table.where(F.col("feature") == name)
        others = ["label", *[n for n in NAMES if n != name]]
        for columns in (others, [name]):
            a, b = (sorted(map(tuple, t.select(columns).collect())) for t in (plain, variant))
            assert a == b
    moved = sorted(map(tuple, table.where("feature = 'strong'").select("label", *NAMES).collect()))
    assert moved != sorted(map(tuple, plain.select("label", *NAMES).collect()))
    again = learning.exchanged(rows.repartition(5), NAMES, group_rows=100)
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))
    table.unpersist()


def test_importance_equals_a_loop_and_finds_the_planted_column(rows, linear):
    found = learning.permutation_importance(linear, rows, NAMES)
    weights = {r.feature: r.weight for r in found.collect()}
    assert [r.feature for r in found.collect()][0] == "strong"
    assert abs(weights["noise"]) < 0.01 and weights["flat"] == 0 and weights["strong"] > 0.2 > weights["weak"] > 0.01
    scored = linear.transform(learning.exchanged(rows, NAMES)).select("feature", "label", "probability").collect()
    by_feature = {}
    for row in scored:
        by_feature.setdefault(row.feature, []).append((row.label, row.probability[1]))
    for name in NAMES:
        assert weights[name] == pytest.approx(area(by_feature[""]) - area(by_feature[name]))


def test_importance_of_trees_and_of_few_rows(rows):
    model = boosting.train_boosted(rows, NAMES, rounds=5, depth=2)
    assert learning.permutation_importance(model, rows, NAMES).first().feature == "strong"
    few = rows.limit(2)
    assert learning.exchanged(few, NAMES).count() == 10
    assert learning.exchanged(rows.limit(0), NAMES).isEmpty()


def test_areas_by_group(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randrange(2), rng.randrange(30) / 30) for _ in range(400)] + [("c", 1, 0.5)]
    table = spark.createDataFrame(rows, "feature string, label int, score double")
    found = {r.feature: r.roc_auc for r in roc_areas(table, "feature").collect()}
    for name in "ab":
        assert found[name] == pytest.approx(area([(l, s) for f, l, s in rows if f == name]))
    assert found["c"] is None
