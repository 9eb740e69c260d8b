"""Model rows, models and their evaluation."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import tables as t
from checks.columns import TIME_FEATURES_SQL
from checks.jobs import FEATURES_SQL
from checks.registry import query
from faultline import fixed_values as fixed
from faultline.operators import aggregates, evaluation, sampling, sets, sorting
from faultline.operators.filters import filter_class
from faultline.plans import boosting, learning
from faultline.session import shared_folder
from faultline.sinks import models
from faultline.sinks.models import read_model

CTES = {
    "flagged": t.FLAGGED_SQL,
    "features": FEATURES_SQL.format(window=3600),
    "prepared": (
        "select host, feature_window_start, num_logs, num_errors, avg_severity, max_severity, "
        "label_next_hour, error_ratio, '2024' as year, '01' as month, "
        + TIME_FEATURES_SQL.format("feature_window_start")
        + ", num_logs / (avg(num_logs) over () + 1e-6) as log_intensity from features"
    ),
    "split": (
        "select *, case when row_number() over (order by feature_window_start, host) <= "
        "floor((select count(*) from prepared) * 0.8::double) then 'train' else 'test' end "
        "as split from prepared"
    ),
    "hashed": (
        "select *, md5('42|' || epoch(feature_window_start)::bigint || '|' || host) as h "
        "from split where split = 'train' and label_next_hour = 0"
    ),
    "sampled": (
        "select * from split where split = 'train' and label_next_hour = 1 union all "
        "select * exclude (h, r) from (select *, row_number() over (order by h) as r from hashed) "
        "where r <= round_even((select count(*) from hashed) * 0.05::double, 0)"
    ),
}


def ml_sql(select: str) -> str:
    return t.with_logs(select, **CTES)


def features(spark, sf_dir):
    return t.read_features(spark, t.january_features(spark, sf_dir))


def split(spark, sf_dir):
    return sampling.temporal_split(learning.ml_prepare(features(spark, sf_dir)))


def train_rows(spark, sf_dir):
    return split(spark, sf_dir).where("split = 'train'")


@query(
    ml_sql(
        "select * exclude (host, log_intensity), round(log_intensity, 6) as log_intensity "
        "from prepared"
    )
)
def ml_prepare(spark, sf_dir):
    return learning.ml_prepare(features(spark, sf_dir), keep_host=False)


@query(ml_sql("select host, feature_window_start, label_next_hour, split from split"))
def temporal_split(spark, sf_dir):
    return split(spark, sf_dir).select("host", "feature_window_start", "label_next_hour", "split")


@query(ml_sql("select host, feature_window_start, num_logs, label_next_hour from sampled"))
def downsample_negatives(spark, sf_dir):
    train, _ = learning.training_tables(features(spark, sf_dir))
    return train.select("host", "feature_window_start", "num_logs", "label_next_hour")


@query(
    ml_sql(
        "select host, feature_window_start, label_next_hour from split where split = 'train'"
    )
)
def concat_classes(spark, sf_dir):
    rows = train_rows(spark, sf_dir).select("host", "feature_window_start", "label_next_hour")
    classes = [filter_class(rows, "label_next_hour", value) for value in (1, 0)]
    return sets.concat_classes(*classes).orderBy("mix_order").drop("mix_order")


@query(
    ml_sql(
        "select split, count(*) as rows, sum(label_next_hour)::bigint as positives, "
        "(count(*) - sum(label_next_hour))::bigint as negatives, "
        "round(avg(label_next_hour), 6) as positive_rate, "
        "round((count(*) - sum(label_next_hour)) / sum(label_next_hour), 6) as "
        "negatives_per_positive from split group by split"
    )
)
def agg_class_stats(spark, sf_dir):
    return aggregates.agg_class_stats(split(spark, sf_dir), "split")


@query(
    ml_sql(
        "select 'sampled' as split, count(*) as rows, sum(label_next_hour)::bigint as positives, "
        "(count(*) - sum(label_next_hour))::bigint as negatives, "
        "round(avg(label_next_hour), 6) as positive_rate, "
        "round((count(*) - sum(label_next_hour)) / sum(label_next_hour), 6) as "
        "negatives_per_positive from sampled"
    )
)
def agg_class_stats_sampled(spark, sf_dir):
    """The classes that a model is trained on, after sampling."""
    train, _ = learning.training_tables(features(spark, sf_dir))
    return aggregates.agg_class_stats(train.withColumn("split", F.lit("sampled")), "split")


@query(
    ml_sql(
        "select host, feature_window_start, "
        + ", ".join(
            f"round(({name} - (select avg({name}) from split where split = 'train')) / "
            f"(select stddev_pop({name}) from split where split = 'train'), 4) as {name}"
            for name in fixed.MODEL_FEATURES
        )
        + " from split"
    )
)
def standard_scale(spark, sf_dir):
    rows = split(spark, sf_dir)
    scaled = learning.standard_scale(rows, rows.where("split = 'train'"))
    columns = [F.round(name, 4).alias(name) for name in fixed.MODEL_FEATURES]
    return scaled.select("host", "feature_window_start", *columns)


# --- Models: the SQL form states what a right model must satisfy --------------------
@t.once
def lr_model(spark, sf_dir, path):
    models.sink_model(learning.train_lr(learning.training_tables(features(spark, sf_dir))[0]), path)


@t.once
def gbt_model(spark, sf_dir, path):
    models.sink_model(learning.train_gbt(learning.training_tables(features(spark, sf_dir))[0]), path)


def scaled_for(model, rows):
    """The columns that the regression sees, as x0, x1 and so on, and its linear value."""
    *_, regression = model.stages
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    values = vector_to_array("features")
    parts = [values.getItem(i) for i in range(len(fixed.MODEL_FEATURES))]
    linear = F.lit(float(regression.intercept))
    for part, coefficient in zip(parts, regression.coefficients.toArray()):
        linear = linear + part * float(coefficient)
    named = {f"x{i}": part for i, part in enumerate(parts)}
    return rows.withColumns({**named, "linear": linear})


def mean_gradient(spark, sf_dir, model):
    """Slope of the penalised loss per row at the fitted weights: one row, intercept last."""
    train, _ = learning.training_tables(features(spark, sf_dir))
    rows = scaled_for(model, train)
    wrong = 1 / (1 + F.exp(-F.col("linear"))) - F.col("label_next_hour")
    slopes = [
        ((F.sum(wrong * F.col(f"x{i}")) + float(w)) / F.count(F.lit(1))).alias(name)
        for i, (name, w) in enumerate(
            zip(fixed.MODEL_FEATURES, model.stages[-1].coefficients.toArray())
        )
    ]
    return rows.agg(*slopes, F.avg(wrong).alias("intercept"))


@query(
    ml_sql(
        "select host, feature_window_start, label_next_hour as label, 0.0::double as steepest "
        "from split where split = 'test'"
    )
)
def train_lr(spark, sf_dir):
    """At the minimum of the loss every slope is 0, which no other weights reach."""
    _, test = learning.training_tables(features(spark, sf_dir))
    model = read_model(lr_model(spark, sf_dir))
    slopes = mean_gradient(spark, sf_dir, model)
    steepest = slopes.select(F.round(F.greatest(*[F.abs(c) for c in slopes.columns]), 3)).scalar()
    scores = learning.score_model(model, test)
    return scores.select("host", "feature_window_start", "label", steepest.alias("steepest"))


BOOSTED_SQL = ml_sql(
    "select host, feature_window_start, label_next_hour as label, true as in_range, "
    "true as above_constant, true as rounds_help from split where split = 'test'"
)


def boosted(model, train, test):
    """Scores, whether the model ranks train rows better than a constant, and whether the rounds after
    the first took away a good part of its loss, which a model of one round cannot do."""
    area = evaluation.eval_roc_auc(learning.score_model(model, train)).scalar()
    losses = [boosting.log_loss(m, train).scalar() for m in (model, boosting.first_rounds(model, 1))]
    return learning.score_model(model, test).select(
        "host", "feature_window_start", "label",
        F.col("score").between(0, 1).alias("in_range"),
        (area > 0.5).alias("above_constant"),
        (losses[0] < 0.8 * losses[1]).alias("rounds_help"),
    )


@query(BOOSTED_SQL)
def train_gbt(spark, sf_dir):
    """All rounds."""
    train, test = learning.training_tables(features(spark, sf_dir))
    return boosted(read_model(gbt_model(spark, sf_dir)), train, test)


@query(BOOSTED_SQL)
def train_boosted(spark, sf_dir):
    """Thirty rounds of trees that draw their columns once."""
    train, test = learning.training_tables(features(spark, sf_dir))
    return boosted(boosting.train_boosted(train, rounds=30), train, test)


@query(
    ml_sql(
        "select host, feature_window_start, label_next_hour as label, true as is_sigmoid "
        "from split where split = 'test'"
    )
)
def score_model(spark, sf_dir):
    _, test = learning.training_tables(features(spark, sf_dir))
    model = read_model(lr_model(spark, sf_dir))
    expected = scaled_for(model, test).select(
        "host", "feature_window_start", (1 / (1 + F.exp(-F.col("linear")))).alias("expected")
    )
    keys = ["host", "feature_window_start"]
    close = F.abs(F.col("score") - F.col("expected")) < 1e-9
    scores = learning.score_model(model, test).join(expected, keys)
    return scores.select(*keys, "label", close.alias("is_sigmoid"))


FEATURE_LIST = ", ".join(f"'{name}'" for name in fixed.MODEL_FEATURES)


@query(
    f"select unnest([{FEATURE_LIST}]) as feature, true as is_share, 1.0::double as total, "
    "true as several"
)
def feature_importance(spark, sf_dir):
    """Shares that sum to 1, of at least three columns: one split has one column only."""
    train, _ = learning.training_tables(features(spark, sf_dir))
    weights = learning.feature_importance(read_model(gbt_model(spark, sf_dir)), train)
    whole = Window.partitionBy()
    return weights.select(
        "feature",
        F.col("weight").between(0, 1).alias("is_share"),
        F.round(F.sum("weight").over(whole), 6).alias("total"),
        (F.count_if(F.col("weight") > 0).over(whole) >= 3).alias("several"),
    )


@query(
    ml_sql(
        "select f.feature, count(*) as rows, sum(label_next_hour)::bigint as positives, "
        "round(sum(case f.feature "
        + " ".join(f"when '{name}' then {name}::double" for name in fixed.MODEL_FEATURES)
        + " end), 4) as total, true as is_right from split, "
        f"(select unnest([{FEATURE_LIST}]) as feature) f where split = 'test' group by f.feature"
    )
)
def permutation_importance(spark, sf_dir):
    """Each column's values are exchanged, none is lost, and the loss is that of areas by pairs."""
    _, test = learning.training_tables(features(spark, sf_dir))
    model = read_model(lr_model(spark, sf_dir))
    variants = learning.exchanged(test, fixed.MODEL_FEATURES)
    value = F.coalesce(*[F.when(F.col("feature") == name, F.col(name).cast("double")) for name in fixed.MODEL_FEATURES])
    totals = variants.where("feature != ''").groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("label").cast("bigint")).alias("positives"),
        F.round(F.sum(value), 4).alias("total"),
    )
    scores = model.transform(variants).select(
        "feature", "label", vector_to_array("probability").getItem(1).alias("score")
    )
    # Mann-Whitney: mean rank of positives among all rows, ties in the middle.
    by_score = Window.partitionBy("feature").orderBy("score")
    tied = Window.partitionBy("feature", "score")
    ranked = scores.withColumn("mid", F.rank().over(by_score) + (F.count(F.lit(1)).over(tied) - 1) / 2)
    p, n = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    areas = ranked.groupBy("feature").agg(
        ((F.sum(F.when(F.col("label") == 1, F.col("mid"))) - p * (p + 1) / 2) / (p * n)).alias("area")
    )
    plain = areas.where("feature = ''").select("area").scalar()
    found = learning.permutation_importance(model, test).join(areas, "feature").join(totals, "feature")
    right = F.abs(F.col("weight") - (plain - F.col("area"))) < 1e-9
    return found.select("feature", "rows", "positives", "total", F.coalesce(right, F.col("weight").isNull()).alias("is_right"))


@query(f"select unnest([{FEATURE_LIST}]) as feature, 0.0::double as slope")
def lr_coefficients(spark, sf_dir):
    """Each coefficient is right if the loss is flat along it."""
    train, _ = learning.training_tables(features(spark, sf_dir))
    model = read_model(lr_model(spark, sf_dir))
    slopes = mean_gradient(spark, sf_dir, model).drop("intercept")
    slopes = slopes.unpivot([], list(slopes.columns), "feature", "slope")
    found = learning.lr_coefficients(model, train).join(slopes, "feature")
    return found.select("feature", F.abs(F.round("slope", 3)).alias("slope"))


@query(
    "with weights as (select user_id::varchar as feature, round(sum(value), 6) as weight "
    "from events group by 1), ranked as (select *, "
    "row_number() over (order by weight desc, feature) as top, "
    "row_number() over (order by weight, feature) as bottom from weights) "
    "select feature, weight, 'top' as \"end\" from ranked where top <= 10 union all "
    "select feature, weight, 'bottom' from ranked where bottom <= 10"
)
def topk_features(spark, sf_dir):
    events = t.read(spark, sf_dir, "events")
    weights = events.groupBy(F.col("user_id").cast("string").alias("feature")).agg(
        F.round(F.sum("value"), 6).alias("weight")
    )
    top = sorting.topk_features(weights, 10).withColumn("end", F.lit("top"))
    bottom = sorting.topk_features(weights, 10, largest=False).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)


@query(
    ml_sql(
        "select host, feature_window_start, label_next_hour as label from split "
        "where split = 'test'"
    )
)
def sink_model(spark, sf_dir):
    """Saved and read back, a model scores every row as before."""
    _, test = learning.training_tables(features(spark, sf_dir))
    model = read_model(lr_model(spark, sf_dir))
    path = shared_folder(spark, "model")
    models.sink_model(model, path)
    keys = ["host", "feature_window_start", "label"]
    before = learning.score_model(model, test)
    again = learning.score_model(read_model(path), test)
    return before.join(again, [*keys, "score"]).select(*keys)


@query(
    ml_sql(
        "select 'train' as part, count(*) as rows, sum(label_next_hour)::bigint as positives, "
        "round(max(case when label_next_hour = 1 then (select count(*) - sum(label_next_hour) "
        "from sampled) / (select sum(label_next_hour) from sampled) else 1.0 end), 6) as heaviest "
        "from sampled"
    )
)
def class_weights(spark, sf_dir):
    """Classes of the sampled train rows and the weight of a positive one."""
    train, _ = learning.training_tables(features(spark, sf_dir))
    return learning.class_weights(train).agg(
        F.lit("train").alias("part"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("label_next_hour").cast("bigint")).alias("positives"),
        F.max("class_weight").alias("heaviest"),
    )


# --- Evaluation -------------------------------------------------------------------
EVAL_CTES = (
    f"with scored as ({t.SCORED_SQL}), counts as (select score, sum(label) as pos, "
    "count(*) - sum(label) as neg from scored group by score), ranked as (select score, pos, neg, "
    "sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, "
    "sum(pos) over () as p, sum(neg) over () as n from counts) "
)


@query(
    EVAL_CTES + "select round(sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n)), 6) as roc_auc "
    "from ranked"
)
def eval_roc_auc(spark, sf_dir):
    return evaluation.eval_roc_auc(t.scored(spark, sf_dir))


@query(
    EVAL_CTES + "select round(sum(pos / p * (tp / (tp + fp))), 6) as average_precision from ranked"
)
def eval_average_precision(spark, sf_dir):
    return evaluation.eval_average_precision(t.scored(spark, sf_dir))


@query(
    EVAL_CTES + "select score as threshold, round(fp / n, 6) as fpr, round(tp / p, 6) as tpr from "
    "ranked union all select null, 0.0, 0.0"
)
def eval_roc_curve(spark, sf_dir):
    return evaluation.eval_roc_curve(t.scored(spark, sf_dir))


@query(
    EVAL_CTES + "select score as threshold, round(tp / p, 6) as recall, round(tp / (tp + fp), 6) as "
    "precision from ranked union all select null, 0.0, 1.0"
)
def eval_pr_curve(spark, sf_dir):
    return evaluation.eval_pr_curve(t.scored(spark, sf_dir))


REPORT_SQL = (
    f"with scored as ({t.SCORED_SQL}), predicted as (select label, threshold, "
    "(score > threshold)::int as guess from scored, (select unnest([0.05::double, 0.1::double, "
    "0.2::double]) as threshold)), classes as (select threshold, class, "
    "sum((label = class and guess = class)::int) as hit, sum((guess = class)::int) as guessed, "
    "sum((label = class)::int) as support, count(*) as total from predicted, "
    "(select unnest([0, 1]) as class) group by threshold, class), measures as (select *, "
    "case when guessed = 0 then 0 else hit / guessed end as pr, "
    "case when support = 0 then 0 else hit / support end as re, "
    "case when guessed + support = 0 then 0 else 2 * hit / (guessed + support) end as f1 "
    "from classes) select threshold, class::varchar as class, round(pr, 6) as precision, "
    "round(re, 6) as recall, round(f1, 6) as f1_score, support::bigint as support from measures "
    "union all select threshold, 'accuracy', null, null, round(sum(hit) / max(total), 6), "
    "max(total) from measures group by threshold "
    "union all select threshold, 'macro avg', round(avg(pr), 6), round(avg(re), 6), "
    "round(avg(f1), 6), max(total) from measures group by threshold "
    "union all select threshold, 'weighted avg', round(sum(pr * support) / max(total), 6), "
    "round(sum(re * support) / max(total), 6), round(sum(f1 * support) / max(total), 6), "
    "max(total) from measures group by threshold"
)


@query(REPORT_SQL)
def eval_classification_report(spark, sf_dir):
    return evaluation.eval_classification_report(t.scored(spark, sf_dir))


@query(
    f"with scored as ({t.SCORED_SQL}), limits as (select k::double * 0.01::double as threshold "
    "from range(101) r(k)), counts as (select threshold, "
    "sum((score >= threshold and label = 1)::int) as tp, "
    "sum((score >= threshold and label = 0)::int) as fp, sum(label) as p from scored, limits "
    "group by threshold) select round(threshold, 6) as threshold, "
    "round(tp / (tp + fp + 1e-6), 6) as precision, "
    "round(tp / (p + 1e-6), 6) as recall from counts"
)
def eval_threshold_curve(spark, sf_dir):
    return evaluation.eval_threshold_curve(t.scored(spark, sf_dir))
