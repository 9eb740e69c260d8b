"""Scores of a binary classifier: curves, areas and reports.

Input is a table of ``label`` (0 or 1) and ``score``. Everything starts from counts per
distinct score, so ties count once and rows with equal scores are combined before a
shuffle. Running sums over scores are taken in two levels, inside ranges of scores and
across them; range limits follow the distribution of the scores, so that ranges stay even
when most scores lie close together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.operators.ordering import running_over_chunks
from faultline.sinks.tables import written_table

LEAST_RANGES = 256


def score_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("score").agg(
        F.sum(F.col("label").cast("bigint")).alias("positives"),
        F.sum(1 - F.col("label").cast("bigint")).alias("negatives"),
    )


def score_ranges(counts: DataFrame, wanted: int) -> DataFrame:
    """Adds ``_range``, which grows with the score and cuts the rows into even parts."""
    ranges = QuantileDiscretizer(
        numBuckets=wanted, inputCol="score", outputCol="_range", relativeError=0.1 / wanted
    )
    return ranges.fit(counts).transform(counts)


def ranked_scores(scored: DataFrame) -> DataFrame:
    """Distinct scores with running counts of the rows that score at least as high.

    Adds tp and fp (this score and higher), tp_before and fp_before (higher only) and the
    class totals. The counts are stored first, so a model scores its rows only once.
    """
    counts = written_table(score_counts(scored), "score-counts")
    totals = counts.agg(
        F.struct(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    ).scalar()
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    running = running_over_chunks(
        score_ranges(counts, max(LEAST_RANGES, 2 * tasks)).withColumn("_key", -F.col("score")),
        keys=[],
        order=["_key"],
        chunk=-F.col("_range"),
        amounts=["positives", "negatives"],
    )
    return running.select(
        "score",
        "positives",
        "negatives",
        F.col("positives_before").alias("tp_before"),
        F.col("negatives_before").alias("fp_before"),
        (F.col("positives_before") + F.col("positives")).alias("tp"),
        (F.col("negatives_before") + F.col("negatives")).alias("fp"),
        totals.getField("p").alias("all_positives"),
        totals.getField("n").alias("all_negatives"),
    )


def eval_roc_auc(scored: DataFrame) -> DataFrame:
    """Chance that a positive scores above a negative, ties half; NULL with one class only."""
    ranked = ranked_scores(scored)
    above = F.col("tp_before") + F.col("positives") / 2
    pairs = F.max("all_positives").cast("double") * F.max("all_negatives")
    return ranked.agg(
        F.try_divide(F.sum(F.col("negatives") * above), pairs).alias("roc_auc")
    )


def roc_areas(scored: DataFrame, by: str) -> DataFrame:
    """The area of every group of rows, such as one for each variant of a feature."""
    counts = written_table(
        scored.groupBy(by, "score").agg(
            F.sum(F.col("label").cast("bigint")).alias("positives"),
            F.sum(1 - F.col("label").cast("bigint")).alias("negatives"),
        ),
        "score-counts",
    )
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    running = running_over_chunks(
        score_ranges(counts, max(LEAST_RANGES, 2 * tasks)).withColumn("_key", -F.col("score")),
        keys=[by],
        order=["_key"],
        chunk=-F.col("_range"),
        amounts=["positives"],
    )
    above = F.col("positives_before") + F.col("positives") / 2
    pairs = F.sum("positives").cast("double") * F.sum("negatives")
    return running.groupBy(by).agg(
        F.try_divide(F.sum(F.col("negatives") * above), pairs).alias("roc_auc")
    )


def eval_average_precision(scored: DataFrame) -> DataFrame:
    """Sum over scores of precision times the recall gained there; 0 without positives."""
    gained = F.try_divide(F.col("positives"), F.col("all_positives"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    total = F.coalesce(F.sum(gained * precision), F.lit(0.0))
    return ranked_scores(scored).agg(total.alias("average_precision"))


def eval_roc_curve(scored: DataFrame) -> DataFrame:
    """(fpr, tpr) per distinct score, after the point (0, 0) whose threshold is NULL."""
    points = ranked_scores(scored).select(
        F.col("score").alias("threshold"),
        F.try_divide("fp", "all_negatives").alias("fpr"),
        F.try_divide("tp", "all_positives").alias("tpr"),
    )
    return points.unionByName(end_point(points, fpr=0.0, tpr=0.0))


def eval_pr_curve(scored: DataFrame) -> DataFrame:
    """(recall, precision) per distinct score, and the end point (0, 1)."""
    points = ranked_scores(scored).select(
        F.col("score").alias("threshold"),
        F.try_divide("tp", "all_positives").alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )
    return points.unionByName(end_point(points, recall=0.0, precision=1.0))


def end_point(points: DataFrame, **values: float) -> DataFrame:
    named = [F.lit(value).alias(name) for name, value in values.items()]
    no_threshold = F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold")
    return points.sparkSession.range(1).select(no_threshold, *named)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def eval_classification_report(
    scored: DataFrame, thresholds: Sequence[float] = fixed.REPORT_THRESHOLDS
) -> DataFrame:
    """Precision, recall, F1 and support per threshold and class, and their means.

    A score above the threshold counts as class 1. A ratio without a denominator is 0.
    """
    label, score = F.col("label"), F.col("score")
    positive, negative = label == 1, label == 0
    counts = scored.agg(
        F.count_if(positive).alias("p"),
        F.count_if(negative).alias("n"),
        *[
            F.count_if(condition & (score > threshold)).alias(f"{name}_{index}")
            for index, threshold in enumerate(thresholds)
            for name, condition in (("tp", positive), ("fp", negative))
        ],
    )
    confusion = [
        F.struct(
            F.lit(threshold).alias("threshold"),
            F.col(f"tp_{index}").alias("tp"),
            F.col(f"fp_{index}").alias("fp"),
        )
        for index, threshold in enumerate(thresholds)
    ]
    table = counts.select("p", "n", F.inline(F.array(*confusion)))

    tp, fp, p, n = (F.col(name) for name in ("tp", "fp", "p", "n"))
    fn, tn, total = p - tp, n - fp, p + n
    one = (ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, p), ratio_or_zero(2 * tp, p + tp + fp))
    zero = (ratio_or_zero(tn, tn + fn), ratio_or_zero(tn, n), ratio_or_zero(2 * tn, n + tn + fn))
    missing = F.lit(None).cast("double")
    rows = [
        ("0", zero, n),
        ("1", one, p),
        ("accuracy", (missing, missing, ratio_or_zero(tp + tn, total)), total),
        ("macro avg", [(a + b) / 2 for a, b in zip(zero, one)], total),
        ("weighted avg", [ratio_or_zero(a * n + b * p, total) for a, b in zip(zero, one)], total),
    ]
    lines = [
        F.struct(
            F.lit(name).alias("class"),
            *[
                value.alias(measure)
                for measure, value in zip(("precision", "recall", "f1_score"), values)
            ],
            support.alias("support"),
        )
        for name, values, support in rows
    ]
    return table.select("threshold", F.inline(F.array(*lines)))


def eval_threshold_curve(
    scored: DataFrame, points: int = fixed.CURVE_THRESHOLDS
) -> DataFrame:
    """Precision and recall at evenly spaced thresholds from 0 to 1.

    Here a score equal to the threshold counts as class 1. Each row is counted once, at
    the last threshold it reaches, and the counts are then summed from the top.
    """
    step = F.lit(1.0 / (points - 1))
    score, top = F.col("score"), points - 1
    guess = F.floor(score * top)
    reached = (
        guess
        + F.when(score >= (guess + 1) * step, 1).otherwise(0)
        - F.when(score < guess * step, 1).otherwise(0)
    )
    # Scores below 0 reach no threshold, but their positives count in the total.
    counts = scored.groupBy(
        F.greatest(F.least(F.coalesce(reached, F.lit(-1)), F.lit(top)), F.lit(-1)).alias("id")
    ).agg(
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"),
    )
    zero = F.lit(0).cast("bigint")
    empty = scored.sparkSession.range(points).select(
        "id", zero.alias("positives"), zero.alias("negatives")
    )
    per_point = counts.unionByName(empty).groupBy("id").agg(
        F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives")
    )
    from_top = Window.orderBy(F.desc("id"))
    curve = per_point.select(
        "id",
        F.sum("positives").over(from_top).alias("tp"),
        F.sum("negatives").over(from_top).alias("fp"),
        F.sum("positives").over(Window.partitionBy()).alias("p"),
    ).where("id >= 0")
    tp, smoothing = F.col("tp"), F.lit(fixed.SMOOTHING)
    return curve.select(
        (F.col("id") * step).alias("threshold"),
        (tp / (tp + F.col("fp") + smoothing)).alias("precision"),
        (tp / (F.col("p") + smoothing)).alias("recall"),
    )
