"""Failure predictors, trained and applied with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.functions.calendars import time_features
from faultline.operators.columns import drop_if_present, log_intensity
from faultline.operators.evaluation import roc_areas
from faultline.operators.sampling import LABEL, downsample_negatives, temporal_split
from faultline.session import require_utc, shared_folder
from faultline.sinks.tables import written_table


def ml_prepare(
    features: DataFrame, fit_on: DataFrame | None = None, keep_host: bool = True
) -> DataFrame:
    """Feature rows to model rows: no columns that tell the label, plus time and intensity.

    ``fit_on`` limits the mean log count to, say, train rows. The host is needed to split
    and sample; models do not use it.
    """
    require_utc(features.sparkSession)
    rows = drop_if_present(features, *fixed.LEAK_COLUMNS)
    rows = rows.select("*", *time_features(F.col("feature_window_start")))
    rows = log_intensity(rows, fit_on)
    return rows if keep_host else drop_if_present(rows, "host")


def training_tables(
    features: DataFrame,
    train_fraction: float = fixed.TRAIN_FRACTION,
    negative_fraction: float = fixed.NEGATIVE_FRACTION,
    seed: int = fixed.SEED,
) -> tuple[DataFrame, DataFrame]:
    """Train rows with few negatives, and all test rows, both stored.

    Training reads its rows many times, so they are written once and read back.
    """
    rows = written_table(temporal_split(ml_prepare(features), train_fraction), "split-rows")
    train = downsample_negatives(rows.where("split = 'train'"), negative_fraction, seed)
    return written_table(train, "train-rows"), rows.where("split = 'test'")


def standard_scale(
    rows: DataFrame, fit_on: DataFrame, columns: Sequence[str] = fixed.MODEL_FEATURES
) -> DataFrame:
    """Columns as (value - mean) / deviation of the rows in ``fit_on``.

    Population deviation; a constant column is only shifted. Fitting is one aggregation,
    and one row of its results goes to the driver.
    """
    fitted = fit_on.agg(
        *[F.avg(name).alias(f"mean_{name}") for name in columns],
        *[F.stddev_pop(name).alias(f"deviation_{name}") for name in columns],
    ).first()
    scaled = {}
    for name in columns:
        mean, deviation = fitted[f"mean_{name}"], fitted[f"deviation_{name}"]
        scaled[name] = (F.col(name) - F.lit(mean)) / F.lit(deviation or 1.0)
    return rows.withColumns(scaled)


def assembler(columns: Sequence[str], output: str, invalid: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid=invalid)


def class_weights(train: DataFrame, column: str = "class_weight") -> DataFrame:
    """Train rows with a weight: negatives per positive for positives, 1 for negatives.

    Both classes then weigh the same. With one class only, all weights are 1.
    """
    counts = train.agg(
        F.count_if(F.col(LABEL) == 0).alias("n"), F.count_if(F.col(LABEL) == 1).alias("p")
    ).first()
    ratio = counts["n"] / counts["p"] if counts["n"] and counts["p"] else 1.0
    return train.withColumn(column, F.when(F.col(LABEL) == 1, ratio).otherwise(1.0))


def train_lr(
    train: DataFrame,
    columns: Sequence[str] = fixed.MODEL_FEATURES,
    max_iter: int = 1000,
    inverse_regularization: float = 1.0,
    weight: str | None = None,
) -> PipelineModel:
    """Logistic regression on columns scaled as by ``standard_scale``; the scaling is part of
    the model.

    The penalty is that of a loss summed over rows, hence the row count. ``weight`` names a
    column of row weights, as ``class_weights`` adds one.
    """
    total = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    rows, mass = train.agg(F.count(F.lit(1)), total).first()
    # The scaler divides by the sample deviation; this turns it into the population's.
    to_population = (rows / (rows - 1)) ** 0.5 if rows > 1 else 1.0
    return Pipeline(
        stages=[
            assembler(columns, "raw_features", "error"),
            StandardScaler(
                inputCol="raw_features", outputCol="sample_scaled", withMean=True, withStd=True
            ),
            ElementwiseProduct(
                inputCol="sample_scaled",
                outputCol="features",
                scalingVec=Vectors.dense([to_population] * len(columns)),
            ),
            LogisticRegression(
                featuresCol="features",
                labelCol=LABEL,
                maxIter=max_iter,
                elasticNetParam=0.0,
                regParam=1.0 / (inverse_regularization * (mass or 1.0)),
                standardization=False,
                **({"weightCol": weight} if weight else {}),
            ),
        ]
    ).fit(train)


def train_gbt(
    train: DataFrame,
    columns: Sequence[str] = fixed.MODEL_FEATURES,
    rounds: int = 300,
    depth: int = 6,
    rate: float = 0.1,
    sample: float = 0.8,
    seed: int = fixed.SEED,
    weight: str | None = None,
) -> PipelineModel:
    """Boosted trees with log loss and row and column sampling.

    Rounds build on each other; every tenth is checkpointed in the shared folder, so that
    the lineage stays short and a lost executor costs ten rounds at most.
    """
    context = train.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(train.sparkSession, "boosting"))
    return Pipeline(
        stages=[
            assembler(columns, "features", "keep"),
            GBTClassifier(
                featuresCol="features",
                labelCol=LABEL,
                maxIter=rounds,
                maxDepth=depth,
                stepSize=rate,
                subsamplingRate=sample,
                featureSubsetStrategy=str(sample),
                cacheNodeIds=True,
                checkpointInterval=10,
                seed=seed,
                **({"weightCol": weight} if weight else {}),
            ),
        ]
    ).fit(train)


def score_model(model: Model, rows: DataFrame) -> DataFrame:
    """Rows with ``label`` and ``score``, the probability of class 1."""
    scored = model.transform(rows)
    return scored.select(
        *[name for name in ("host", "feature_window_start") if name in rows.columns],
        F.col(LABEL).alias("label"),
        vector_to_array("probability").getItem(1).alias("score"),
    )


def _weights(rows: DataFrame, columns: Sequence[str], values: Sequence[float]) -> DataFrame:
    pairs = [(name, float(value)) for name, value in zip(columns, values)]
    return rows.sparkSession.createDataFrame(pairs, "feature string, weight double")


def feature_importance(
    model: PipelineModel, rows: DataFrame, columns: Sequence[str] = fixed.MODEL_FEATURES
) -> DataFrame:
    """Importance per column (share of impurity gained), largest first."""
    values = model.stages[-1].featureImportances.toArray()
    return _weights(rows, columns, values).orderBy(F.desc("weight"), "feature")


def exchanged(
    rows: DataFrame, columns: Sequence[str], seed: int = fixed.SEED, group_rows: int = 256
) -> DataFrame:
    """Rows (feature, label, columns): all rows once for each column, with its values exchanged.

    Rows are dealt by a seeded hash to groups of about ``group_rows`` and stand in each in hash
    order, in a circle; column number j takes its value from the row j + 1 places on. Nothing
    is sorted beyond a group, and every run exchanges the same values. The rows as they are have
    the feature ''.
    """
    total = rows.count()
    kept = [F.col(name) for name in columns]
    place = F.xxhash64(F.lit(seed), *kept, *[name for name in ("host", "feature_window_start") if name in rows.columns])
    row = F.struct(place.alias("place"), F.col(LABEL).cast("int").alias("label"), *kept)
    groups = rows.select(
        F.pmod(place, F.lit(max(1, total // group_rows))).alias("group"), row.alias("row")
    ).groupBy("group").agg(F.sort_array(F.collect_list("row")).alias("circle"))
    size = F.size("circle")

    def variants(own: Column, i: Column) -> Column:
        def other(number: int) -> Column:
            shift = 1 + F.pmod(F.lit(number), F.greatest(size - 1, F.lit(1)))
            return F.get("circle", F.pmod(i + shift, size))

        plain = {name: own[name].alias(name) for name in columns}
        made = [F.struct(F.lit("").alias("feature"), own["label"].alias("label"), *plain.values())]
        for number, name in enumerate(columns):
            values = {**plain, name: other(number)[name].alias(name)}
            made.append(F.struct(F.lit(name).alias("feature"), own["label"].alias("label"), *values.values()))
        return F.array(*made)

    return groups.select(F.inline(F.flatten(F.transform("circle", variants))))


def permutation_importance(
    model: Model,
    rows: DataFrame,
    columns: Sequence[str] = fixed.MODEL_FEATURES,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Area under the ROC curve that is lost when a column's values are exchanged between rows.

    Works for any model that gives a probability. Columns that the model does not use lose
    nothing. All variants are scored in one pass.
    """
    scored = model.transform(exchanged(rows, columns, seed)).select(
        "feature", "label", vector_to_array("probability").getItem(1).alias("score")
    )
    areas = written_table(roc_areas(scored, "feature"), "areas")
    whole = areas.where("feature = ''").select("roc_auc").scalar()
    return areas.where("feature != ''").select(
        "feature", (whole - F.col("roc_auc")).alias("weight")
    ).orderBy(F.desc("weight"), "feature")


def lr_coefficients(
    model: PipelineModel, rows: DataFrame, columns: Sequence[str] = fixed.MODEL_FEATURES
) -> DataFrame:
    """Coefficient per scaled column, largest first."""
    values = model.stages[-1].coefficients.toArray()
    return _weights(rows, columns, values).orderBy(F.desc("weight"), "feature")
