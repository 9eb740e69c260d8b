"""Boosted trees that draw their columns once for each tree.

Spark's own boosting draws columns anew at every node and fits plain gradients. Here every round
draws columns and rows for its whole tree and takes a Newton step on the log loss: a
regression tree on gradient over curvature, weighted by the curvature, splits where the loss
falls most to second order, and the mean in a leaf is the step itself. Rounds are Spark ML
regression trees over stored rows, and the result is an ordinary Spark ML model.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.operators.sampling import LABEL
from faultline.plans.learning import assembler, score_model
from faultline.sinks.tables import written_table

#: Curvature of a row at least, so that steps stay finite.
LEAST_CURVATURE = 1e-6


def drawn_columns(seed: int, number: int, count: int, share: float) -> list[int]:
    """The columns of a round's tree: the same in every run."""
    return sorted(random.Random(f"{seed}/{number}").sample(range(count), max(1, round(count * share))))


def train_boosted(
    train: DataFrame,
    columns: Sequence[str] = fixed.MODEL_FEATURES,
    rounds: int = 300,
    depth: int = 6,
    rate: float = 0.1,
    sample: float = 0.8,
    column_sample: float = 0.8,
    seed: int = fixed.SEED,
    weight: str | None = None,
    store_every: int = 10,
) -> PipelineModel:
    """Boosted trees with log loss; rows and columns are sampled for each tree.

    Rows are drawn by a hash of seed, round and row, so a lost task draws the same ones. Rows with
    their sums so far are stored every ``store_every`` rounds: the lineage stays short, and a
    lost executor costs that many rounds at most.
    """
    assemble = assembler(columns, "features", "keep")
    rows = assemble.transform(
        train.select(
            *columns,
            F.col(LABEL).cast("double").alias("label"),
            (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
            F.xxhash64(*train.columns).alias("row"),
        )
    ).select("features", "label", "weight", "row", F.lit(0.0).alias("margin"))
    rows = written_table(rows, "boosting-rows")
    trees = []
    for number in range(rounds):
        chance = 1 / (1 + F.exp(-F.col("margin")))
        curve = F.greatest(chance * (1 - chance), F.lit(LEAST_CURVATURE))
        drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(number), "row"), F.lit(10_000)) < round(10_000 * sample))
        steps = drawn.select(
            "features", ((F.col("label") - chance) / curve).alias("step"), (curve * F.col("weight")).alias("curve")
        )
        kept = drawn_columns(seed, number, len(columns), column_sample)
        mask = Vectors.dense([float(i in kept) for i in range(len(columns))])
        masked = ElementwiseProduct(inputCol="features", outputCol="drawn", scalingVec=mask).transform(steps)
        tree = DecisionTreeRegressor(
            featuresCol="drawn", labelCol="step", weightCol="curve", maxDepth=depth, seed=seed + number
        ).fit(masked)
        # A tree only asks for its drawn columns, so it reads the whole vector from here on.
        tree = tree.setFeaturesCol("features").setPredictionCol("grown")
        trees.append(tree)
        rows = tree.transform(rows).withColumn("margin", F.col("margin") + rate * F.col("grown")).drop("grown")
        if (number + 1) % store_every == 0 and number + 1 < rounds:
            rows = written_table(rows, "boosting-rows")
    # The sum of steps is the log odds; Spark's model takes twice its own sum for that.
    return PipelineModel(stages=[assemble, classifier(trees, [rate / 2] * rounds, len(columns))])


def classifier(trees: Sequence, weights: Sequence[float], columns: int) -> GBTClassificationModel:
    """A Spark model of given trees."""
    context = SparkContext.getOrCreate()
    java, gateway = context._jvm.org.apache.spark.ml, context._gateway
    array = gateway.new_array(java.regression.DecisionTreeRegressionModel, len(trees))
    factors = gateway.new_array(context._jvm.double, len(trees))
    for i, (tree, factor) in enumerate(zip(trees, weights, strict=True)):
        array[i], factors[i] = tree._java_obj, float(factor)
    name = java.util.Identifiable.randomUID("boosted")
    model = GBTClassificationModel(java.classification.GBTClassificationModel(name, array, factors, columns, 2))
    model._resetUid(name)
    return model


def first_rounds(model: PipelineModel, rounds: int) -> PipelineModel:
    """The model as it was after some rounds, of this module's or of Spark's own boosting."""
    boosted = model.stages[-1]
    part = classifier(boosted.trees[:rounds], boosted.treeWeights[:rounds], boosted.numFeatures)
    return PipelineModel(stages=[*model.stages[:-1], part])


def log_loss(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Mean log loss of the scores; scores of 0 and 1 count as nearly so."""
    scored = score_model(model, rows)
    score = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("score")))
    loss = -F.when(F.col("label") == 1, F.log(score)).otherwise(F.log(1 - score))
    return scored.agg(F.avg(loss).alias("log_loss"))
