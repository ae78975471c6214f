"""Route-level risk models: out-of-fold scores, importances and agreement.

The label is a threshold on the scenario score, so the models check the scoring, they do not
forecast. Logistic models of all folds are fitted together by Newton steps: one pass over the rows
gives every fold's gradient and second derivatives as plain sums, and the driver solves one small
system for each fold. Forests are trained by Spark ML, one for each of few folds. Both are scored by
column arithmetic, so no plan that a caller runs holds a model's function.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseline.config import SCENARIO
from pulseline.functions import columns as C
from pulseline.functions.joins import with_scalars
from pulseline.operators.scenario import FLAGS
from pulseline.session import scratch_path, stored

# Model features in their published order.
FEATURES = (
    "reliability_score", "bunching_rate_pct", "severe_bunching_rate_pct", "peak_bunching_share_pct",
    "total_bunching_events", "severe_events", "intervention_priority_score", "worst_segment_events",
    "bc_place_exposure", "downtown_exposure", "fan_festival_exposure", "skytrain_connector_exposure",
    "pm_peak_vulnerability", "existing_reliability_weakness", "route_type_encoded",
)
assert set(FLAGS) <= set(FEATURES)


#: The fold that no row belongs to: its model is fitted on all rows.
ALL = "all rows"
#: Newton steps at most, and the change of a coefficient below which a fold is done.
PASSES, SETTLED = 25, 1e-9
TREES, DEPTH = 300, 4


def ml_feature_table(stress: DataFrame, threshold: float = SCENARIO.high_risk) -> DataFrame:
    """Fifteen numeric features, the class as its place in alphabetical order, and the label."""
    kinds = stress.agg(F.array_sort(F.collect_set("route_type")).alias("kinds"))
    coded = with_scalars(stress, kinds).withColumn(
        "route_type_encoded",
        F.coalesce(F.array_position("kinds", F.col("route_type")) - 1, F.size("kinds").cast("long")).cast("double"),
    )
    numeric = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES]
    return coded.select(
        "route_short_name", "route_type", "fifa_stress_score", "fifa_risk_band", *numeric,
        (F.col("fifa_stress_score") >= threshold).cast("int").alias("fifa_high_risk"),
    )


def prepared(features: DataFrame, folds: int | None = 5) -> DataFrame:
    """Stored: standardised features behind a leading 1 (`z`), the label and a fold for each route.

    Mean and population deviation are those of all rows, as published; a feature without spread
    becomes 0. Folds are a fixed hash of the route; None makes every route its own fold
    (leave-one-out). The table has one row per route of a network.
    """
    moments = [f(c).alias(f"{n}_{c}") for c in FEATURES for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    spread = with_scalars(features, features.agg(*moments))
    z = [
        F.when(F.col(f"sd_{c}") > 0, (F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}")).otherwise(F.lit(0.0)) for c in FEATURES
    ]
    return stored(spread.select(
        *features.columns, F.array(F.lit(1.0), *z).alias("z"),
        F.col("fifa_high_risk").cast("double").alias("label"),
        (F.col("route_short_name") if folds is None
         else (F.conv(F.substring(F.md5("route_short_name"), 1, 8), 16, 10).cast("long") % folds).cast("string")).alias("fold"),
        F.lit("leave one out" if folds is None else "hash folds").alias("fold_kind"),
    ), "risk-features")


def _literal(rows: list[dict] | dict, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _derivatives() -> Column:
    """The loss of a row, its gradient and the upper half of its second derivatives as one list, from
    the columns z, label, w (weight) and p (probability)."""
    return F.expr("""concat(
        array(-w * ln(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END, 1e-300))),
        transform(z, v -> w * (p - label) * v),
        flatten(transform(z, (v, j) -> transform(slice(z, j + 1, size(z)), u -> w * p * (1 - p) * v * u))))""")


def class_counts(table: DataFrame) -> tuple[dict[str, Counter], Counter]:
    """Rows of each class by fold, and in all."""
    by_fold: dict[str, Counter] = {}
    for r in table.groupBy("fold", "label").count().collect():
        by_fold.setdefault(r["fold"], Counter())[r["label"]] += r["count"]
    return by_fold, sum(by_fold.values(), Counter())


def fit_folds(table: DataFrame, penalty: float = 1.0) -> dict[str, list[float]]:
    """Coefficients (intercept first) of a logistic model for each fold, fitted on all other rows,
    and of one for ALL. Classes have balanced weights within the fitted rows; half the penalty times
    the squared coefficients, without the intercept, is added to the loss.

    All folds share each pass, so the passes do not grow with the folds: there are at most PASSES
    of them. The driver holds one gradient and one matrix for each fold. A fold whose other rows
    have one class only gets an intercept of plus or minus infinity, which predicts that class.
    """
    by_fold, total = class_counts(table)
    names, weights, models = [], [], {}
    for name in [*by_fold, ALL]:
        rest = total - by_fold.get(name, Counter())
        n = sum(rest.values())
        if rest[0.0] and rest[1.0]:
            names.append(name)
            weights.append([n / (2 * rest[c]) for c in (0.0, 1.0)])
        elif n:
            models[name] = [math.inf if rest[1.0] else -math.inf] + [0.0] * len(FEATURES)
    width = 1 + len(FEATURES)
    upper, ridge = np.triu_indices(width), np.diag([0.0] + [penalty] * len(FEATURES))
    beta = np.zeros((len(names), width))
    before, last = beta, np.full(len(names), np.inf)
    for _ in range(PASSES if names else 0):
        own = [{"k": k, "name": f, "w": w, "b": b} for k, (f, w, b) in enumerate(zip(names, weights, beta.tolist(), strict=True))]
        every = table.select("z", "label", "fold", F.explode(_literal(
            own, "array<struct<k: int, name: string, w: array<double>, b: array<double>>>")).alias("m"))
        rows = every.filter("NOT fold <=> m.name").select(
            "z", "label", F.col("m.k").alias("k"), F.expr("m.w[CAST(label AS INT)]").alias("w"),
            probability("z", "m.b").alias("p"))
        sums = np.zeros((len(names), 1 + width + len(upper[0])))
        for r in rows.select("k", F.posexplode(_derivatives()).alias("j", "v")).groupBy("k", "j").agg(F.sum("v").alias("v")).collect():
            sums[r["k"], r["j"]] = r["v"]
        loss, g, h = sums[:, 0], sums[:, 1:1 + width], np.zeros((len(names), width, width))
        h[:, *upper] = sums[:, 1 + width:]
        loss += (beta**2 @ np.diag(ridge)) / 2
        h += np.triu(h, 1).transpose(0, 2, 1) + ridge
        g += beta @ ridge
        worse = loss > last + 1e-9 * np.abs(last)
        step = np.where(worse[:, None], (beta - before) / 2, np.linalg.solve(h, g[..., None])[..., 0])
        before, last = np.where(worse[:, None], before, beta), np.where(worse, last, loss)
        beta = beta - step
        if np.abs(step).max() < SETTLED:
            break
    return models | dict(zip(names, beta.tolist(), strict=True))


def probability(z: str, b: str) -> Column:
    return F.expr(f"1 / (1 + exp(-aggregate(zip_with({z}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)))")


def logit_scores(table: DataFrame, models: dict[str, list[float]], fold: Column | None = None) -> DataFrame:
    """Add probability and prediction by the model of each row's fold (or of `fold`); null without one.

    The models go into the plan as one literal map, 16 numbers for each fold.
    """
    finite = {f: [max(-1e6, min(1e6, x)) for x in b] for f, b in models.items()}
    chosen = F.try_element_at(_literal(finite, "map<string, array<double>>"), fold if fold is not None else F.col("fold"))
    scored = table.withColumn("_b", chosen).withColumn("probability", probability("z", "_b"))
    return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("double")).drop("_b")


def logit_out_of_fold(table: DataFrame) -> DataFrame:
    """Probability and prediction for every route by the model that did not see its fold.

    Without two rows of each class there is no cross-validation and no prediction.
    """
    _, total = class_counts(table)
    enough = min(total[0.0], total[1.0]) >= 2
    return logit_scores(table, fit_folds(table) if enough else {})


def logit_coefficients(table: DataFrame) -> DataFrame:
    """The coefficient of each standardised feature in the model of all rows, and the intercept."""
    b = fit_folds(table.withColumn("fold", F.lit("").cast("string")))[ALL]
    rows = [("intercept", b[0]), *zip(FEATURES, b[1:], strict=True)]
    return table.sparkSession.createDataFrame([(f, float(x)) for f, x in rows], "feature string, coefficient double")


def logit_agreement(table: DataFrame) -> DataFrame:
    """Full-fit logistic probability beside the rule label."""
    models = fit_folds(table.withColumn("fold", F.lit("").cast("string")))
    return _agreement(logit_scores(table, models, F.lit(ALL)), "logit")


def forest(trees: int = TREES) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=DEPTH, seed=42)


def forest_regressor(trees: int = TREES) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="x", labelCol="fifa_stress_score", numTrees=trees, maxDepth=DEPTH, seed=42)


def assembled(table: DataFrame) -> DataFrame:
    """Stored: the table with Spark ML's feature vector and balanced class weights."""
    sizes = table.agg(F.count(F.lit(1)).alias("n"), F.sum("fifa_high_risk").alias("pos"))
    weight = F.when(F.col("fifa_high_risk") == 1, C.ratio("n", F.col("pos") * 2)).otherwise(
        C.ratio("n", (F.col("n") - F.col("pos")) * 2)
    )
    ready = with_scalars(table, sizes).withColumn("weight", F.coalesce(weight, F.lit(1.0))).drop("n", "pos")
    return stored(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(ready), "risk-vectors")


def tree_tables(model, spark: SparkSession) -> list[dict]:
    """The trees of a fitted forest as complete binary trees of DEPTH levels: the feature and
    threshold of each inner node, and the value of each leaf (the share of class 1, or the mean).

    Node k has the children 2 k + 1 and 2 k + 2; a branch that ends early is continued with nodes
    that send every row to the left. The nodes are read from the saved model, at most 31 a tree.
    """
    path = scratch_path(spark, "forest")
    model.write().save(path)
    trees: dict[int, dict] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for _, nodes in sorted(trees.items()):
        f, t, leaf = [0] * (2**DEPTH - 1), [1e300] * (2**DEPTH - 1), [0.0] * 2**DEPTH
        open_ = [(0, 0)]
        while open_:
            k, node = open_.pop()
            own, stats = nodes[node], nodes[node]["impurityStats"]
            if k >= len(f):
                leaf[k - len(f)] = stats[1] / sum(stats) if isinstance(model, RandomForestClassificationModel) else own["prediction"]
            elif own["leftChild"] >= 0:
                f[k], t[k] = own["split"]["featureIndex"], own["split"]["leftCategoriesOrThreshold"][0]
                open_ += [(2 * k + 1, own["leftChild"]), (2 * k + 2, own["rightChild"])]
            else:
                open_.append((2 * k + 1, node))
        out.append({"f": f, "t": t, "leaf": leaf})
    return out


def forest_scores(table: DataFrame, model, into: str) -> DataFrame:
    """Add a fitted forest's value (probability of class 1, or the estimate) to rows with FEATURES:
    every tree is walked down by place arithmetic in its literal table."""
    trees = _literal(tree_tables(model, table.sparkSession), "array<struct<f: array<int>, t: array<double>, leaf: array<double>>>")
    levels = ", ".join(map(str, range(DEPTH)))
    leaf = f"aggregate(array({levels}), 0, (k, _) -> 2 * k + 1 + CAST(r.x[t.f[k]] > t.t[k] AS INT)) - {2**DEPTH - 1}"
    mean = f"aggregate(r.trees, 0D, (s, t) -> s + t.leaf[{leaf}] / size(r.trees))"
    row = f"struct(array({', '.join(FEATURES)}) AS x, _trees AS trees)"
    return table.withColumn("_trees", trees).withColumn(into, F.expr(f"transform(array({row}), r -> {mean})[0]")).drop("_trees")


def forest_out_of_fold(table: DataFrame, estimator: RandomForestClassifier | RandomForestRegressor) -> DataFrame:
    """Predictions for every route by a forest that did not see its fold.

    One forest is grown for each of the few hash folds; forests have no sums to share. Classifiers
    need two rows of each class; without them there is no cross-validation and no prediction.
    """
    by_fold, total = class_counts(table)
    classifies = isinstance(estimator, RandomForestClassifier)
    if classifies and min(total[0.0], total[1.0]) < 2:
        return table.withColumn("prediction", F.lit(None).cast("double"))
    vectors, parts = assembled(table), []
    for k in sorted(by_fold):
        left = total - by_fold[k]
        own = table.filter(F.col("fold") == k)
        if classifies and len(+left) < 2:
            parts.append(own.withColumn("prediction", F.lit(next(iter(+left), 0.0))))
            continue
        value = forest_scores(own, estimator.fit(vectors.filter(F.col("fold") != k)), "prediction")
        parts.append(value.withColumn("prediction", (F.col("prediction") > 0.5).cast("double")) if classifies else value)
    return reduce(lambda a, b: a.unionByName(b), parts)


def classification_scores(predicted: DataFrame, model: str) -> DataFrame:
    hit = (F.col("prediction") == F.col("label")).cast("int")
    return predicted.agg(
        F.lit(model).alias("model"), F.lit("classify high-risk").alias("task"), F.first("fold_kind").alias("cv"),
        C.rnd(F.avg(hit), 3).alias("score"), F.count(F.lit(1)).alias("routes"),
    )


def class_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, from out-of-fold predictions."""
    pairs = predicted.where(F.col("prediction").isNotNull()).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    none, hit = F.lit(0).cast("long"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), none.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), none.alias("support"), F.col("n").alias("predicted"), none.alias("hits")),
    ))
    counts = pairs.select(sides.alias("s")).select("s.*").groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )
    return counts.select(
        "class", "support", C.rnd(C.ratio("hits", "predicted"), 3).alias("precision"), C.rnd(C.ratio("hits", "support"), 3).alias("recall"),
        C.rnd(C.ratio(F.col("hits") * 2, F.col("support") + F.col("predicted")), 3).alias("f1"),
    )


def regression_scores(predicted: DataFrame) -> DataFrame:
    """R squared and mean absolute error of out-of-fold predictions."""
    y, e = F.col("fifa_stress_score"), F.col("fifa_stress_score") - F.col("prediction")
    return predicted.agg(
        F.lit("RandomForestRegressor").alias("model"), F.lit("estimate stress score").alias("task"),
        F.first("fold_kind").alias("cv"), C.rnd(1 - F.sum(e * e) / (F.var_pop(y) * F.count(y)), 3).alias("score"),
        F.count(F.lit(1)).alias("routes"), C.rnd(F.avg(F.abs(e)), 3).alias("mae"),
    )


def feature_importance(table: DataFrame, trees: int = TREES) -> DataFrame:
    """Forest importance (size) beside the standardised logistic coefficient (direction)."""
    imp = forest(trees).fit(assembled(table)).featureImportances.toArray()
    known = table.sparkSession.createDataFrame(
        [(f, float(i)) for f, i in zip(FEATURES, imp, strict=True)], "feature string, rf_importance double")
    return known.join(logit_coefficients(table), "feature").select(
        "feature", "rf_importance", F.col("coefficient").alias("logit_coef")).orderBy(F.desc("rf_importance"), "feature")


def _agreement(scored: DataFrame, model: str) -> DataFrame:
    pred = (F.col("probability") > 0.5).cast("int")
    return scored.select(
        "route_short_name", "route_type", "fifa_stress_score", "fifa_risk_band", "fifa_high_risk",
        C.rnd(F.col("probability"), 3).alias(f"{model}_prob_high"), pred.alias(f"{model}_pred_high"),
        F.when(pred == F.col("fifa_high_risk"), "agree").otherwise("DISAGREE").alias("agreement"),
    )


def model_agreement(table: DataFrame, trees: int = TREES) -> DataFrame:
    """Full-fit forest probability beside the rule label."""
    return _agreement(forest_scores(table, forest(trees).fit(assembled(table)), "probability"), "rf")


def model_summary(table: DataFrame, trees: int = TREES) -> DataFrame:
    """One row per model with its out-of-fold score."""
    a = classification_scores(logit_out_of_fold(table), "LogisticRegression")
    b = classification_scores(forest_out_of_fold(table, forest(trees)), "RandomForestClassifier")
    c = regression_scores(forest_out_of_fold(table, forest_regressor(trees))).drop("mae")
    return a.unionByName(b).unionByName(c)
