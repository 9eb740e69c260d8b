import random

import numpy as np
import pytest

from faultline.operators import evaluation as ev


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double").repartition(3)


def naive_curve(rows):
    points, positives = [], sum(label for label, _ in rows)
    for score in sorted({score for _, score in rows}, reverse=True):
        tp = sum(label for label, s in rows if s >= score)
        fp = sum(1 - label for label, s in rows if s >= score)
        points.append((score, tp, fp, positives, len(rows) - positives))
    return points


def random_rows(seed, digits, count=400):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.3), round(rng.random() ** 3, digits)) for _ in range(count)]


ROWS = {
    "many ties": random_rows(1, 1),
    "few ties": random_rows(2, 6),
    "one score": [(1, 0.5)] * 3 + [(0, 0.5)] * 5,
    "limits": [(1, 0.0), (0, 0.0), (1, 1.0), (0, 1.0), (1, 0.05), (0, 0.1), (1, 0.2)],
}


@pytest.mark.parametrize("name", ROWS)
def test_areas_and_curves(spark, name):
    rows = ROWS[name]
    table, points = scored(spark, rows), naive_curve(rows)
    pairs = [
        (p > n) + (p == n) / 2
        for label_p, p in rows if label_p
        for label_n, n in rows if not label_n
    ]
    assert ev.eval_roc_auc(table).first()[0] == pytest.approx(np.mean(pairs))
    area, recall = 0.0, 0.0
    for _, tp, fp, p, _ in points:
        area += (tp / p - recall) * tp / (tp + fp)
        recall = tp / p
    assert ev.eval_average_precision(table).first()[0] == pytest.approx(area)

    roc = {r.threshold: (r.fpr, r.tpr) for r in ev.eval_roc_curve(table).collect()}
    expected = {s: (fp / n, tp / p) for s, tp, fp, p, n in points}
    assert roc == {**expected, None: (0.0, 0.0)}
    pr = {r.threshold: (r.recall, r.precision) for r in ev.eval_pr_curve(table).collect()}
    expected = {s: (tp / p, tp / (tp + fp)) for s, tp, fp, p, _ in points}
    assert pr == {**expected, None: (0.0, 1.0)}


@pytest.mark.parametrize("name", ROWS)
def test_threshold_curve(spark, name):
    rows = ROWS[name] + [(i % 2, i * 0.01) for i in range(101)] + [(1, i / 100) for i in range(101)]
    curve = ev.eval_threshold_curve(scored(spark, rows)).collect()
    assert len(curve) == 101
    positives = sum(label for label, _ in rows)
    for place, row in enumerate(sorted(curve)):
        threshold = np.linspace(0, 1, 101)[place]
        tp = sum(label for label, s in rows if s >= threshold)
        fp = sum(1 - label for label, s in rows if s >= threshold)
        assert row.threshold == threshold
        assert row.precision == pytest.approx(tp / (tp + fp + 1e-6))
        assert row.recall == pytest.approx(tp / (positives + 1e-6))


def test_report_compares_strictly(spark):
    rows = ROWS["limits"]
    lines = {
        (r.threshold, r["class"]): r
        for r in ev.eval_classification_report(scored(spark, rows)).collect()
    }
    for threshold in (0.05, 0.1, 0.2):
        for value in (0, 1):
            guess = [int(s > threshold) == value for _, s in rows]
            hit = sum(g and label == value for g, (label, _) in zip(guess, rows))
            support = sum(label == value for label, _ in rows)
            line = lines[threshold, str(value)]
            assert line.precision == pytest.approx(hit / max(sum(guess), 1))
            assert line.recall == pytest.approx(hit / support) and line.support == support
            assert line.f1_score == pytest.approx(2 * hit / (sum(guess) + support))
        mean = (lines[threshold, "0"].recall + lines[threshold, "1"].recall) / 2
        assert lines[threshold, "macro avg"].recall == pytest.approx(mean)
        right = sum(int(s > threshold) == label for label, s in rows) / len(rows)
        assert lines[threshold, "accuracy"].f1_score == pytest.approx(right)
        assert lines[threshold, "weighted avg"].recall == pytest.approx(right)


def test_one_class_only(spark):
    negatives = scored(spark, [(0, 0.1), (0, 0.9)])
    assert ev.eval_roc_auc(negatives).first()[0] is None
    assert ev.eval_average_precision(negatives).first()[0] == 0.0
    report = ev.eval_classification_report(negatives).where("class = '1'").collect()
    assert {(r.precision, r.recall, r.f1_score, r.support) for r in report} == {(0, 0, 0, 0)}
