"""One job from feature files to a model and the tables by which it is judged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.operators import evaluation
from faultline.operators.aggregates import agg_class_stats
from faultline.operators.sampling import LABEL
from faultline.plans import learning
from faultline.plans.boosting import log_loss, train_boosted
from faultline.sinks.models import sink_model
from faultline.sinks.tables import written_table

#: How each kind of model is trained; rounds are for trees only.
KINDS = ("lr", "gbt", "boosted")


def fitted(kind: str, train: DataFrame, rounds: int, weight: str | None) -> PipelineModel:
    if kind == "lr":
        return learning.train_lr(train, weight=weight)
    return {"gbt": learning.train_gbt, "boosted": train_boosted}[kind](train, rounds=rounds, weight=weight)


def train_and_report(
    features: DataFrame,
    kind: str = "boosted",
    train_fraction: float = fixed.TRAIN_FRACTION,
    negative_fraction: float = fixed.NEGATIVE_FRACTION,
    rounds: int = 300,
    balanced: bool = False,
    thresholds: Sequence[float] = fixed.REPORT_THRESHOLDS,
    seed: int = fixed.SEED,
) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """A model of the first rows in time, and reports over the rest, which it has not seen.

    Reports: ``classes`` (rows and positives of both parts, and of train after sampling), ``areas``,
    ``report`` at the given thresholds, ``roc_curve``, ``pr_curve``, ``threshold_curve``,
    ``importance`` (what the model itself says), ``permutation`` (area that each column is
    worth on the test rows). Scores are stored, so the model scores the test rows once for
    the reports.
    """
    train, test = learning.training_tables(features, train_fraction, negative_fraction, seed)
    model_rows = learning.class_weights(train) if balanced else train
    model = fitted(kind, model_rows, rounds, "class_weight" if balanced else None)
    scored = written_table(learning.score_model(model, test), "scores")
    parts = [("sampled", train), ("test", test)]
    classes = [agg_class_stats(rows.withColumn("part", F.lit(name)), "part", LABEL) for name, rows in parts]
    areas = [
        evaluation.eval_roc_auc(scored).select(F.lit("roc_auc").alias("measure"), F.col("roc_auc").alias("value")),
        evaluation.eval_average_precision(scored).select(F.lit("average_precision"), "average_precision"),
        log_loss(model, test).select(F.lit("log_loss"), "log_loss"),
    ]
    said = learning.lr_coefficients if kind == "lr" else learning.feature_importance
    return model, {
        "classes": classes[0].unionByName(classes[1]),
        "areas": areas[0].union(areas[1]).union(areas[2]),
        "report": evaluation.eval_classification_report(scored, thresholds),
        "roc_curve": evaluation.eval_roc_curve(scored),
        "pr_curve": evaluation.eval_pr_curve(scored),
        "threshold_curve": evaluation.eval_threshold_curve(scored),
        "importance": said(model, train),
        "permutation": learning.permutation_importance(model, test, seed=seed),
    }


def sink_training(model: PipelineModel, reports: dict[str, DataFrame], path: str) -> None:
    """The model below ``path``/model, each report as Parquet below its name."""
    sink_model(model, f"{path}/model")
    for name, table in reports.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
