"""Regression of sequence productivity with MLlib."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorframe.functions.scalar import count_from_log10, fill_numeric, log10_count
from tremorframe.operators.forest import ForestModel, fit_forest, load_forest
from tremorframe.operators.ranks import numbered
from tremorframe.session import scratch_path, stage_table

# The columns the models are defined on.
REGRESSION_COLUMNS = [
    "mainshock_mag", "mainshock_depth", "mainshock_lat", "mainshock_lon",
    "mag_mean", "mag_std", "mag_max", "mag_min", "mag_median", "mag_range", "mag_diff_main_max",
    "depth_mean", "depth_std", "depth_max",
    "dist_mean", "dist_std", "dist_max", "dist_median", "spatial_spread",
    "time_span_hours", "time_mean_hours", "count_24h", "count_72h", "ratio_24h",
    "mc", "b_value",
]
VECTOR_COLUMNS = [
    "mainshock_mag", "mainshock_depth",
    "mag_mean", "mag_std", "mag_max", "mag_min", "mag_median", "mag_range", "mag_diff_main_max",
    "depth_mean", "depth_std", "depth_max",
    "dist_mean", "dist_std", "dist_max", "dist_median", "spatial_spread",
    "time_span_hours", "time_mean_hours", "count_24h", "count_72h", "ratio_24h",
    "b_value", "mc", "n_mag_ge_4", "n_mag_ge_5", "n_mag_ge_6",
]
TARGET = "aftershock_count"
MODELS = ("Ridge", "Lasso", "RandomForest", "GradientBoosting")
LINEAR = ("Ridge", "Lasso")
# Settings the models are defined by.
RIDGE_ALPHA, LASSO_ALPHA = 1.0, 0.1
# Below this deviation, against that of all rows, a column counts as constant.
CONSTANT = 1e-5
_MEMORY = 256


def training_rows(features: DataFrame, cols: list[str] = REGRESSION_COLUMNS) -> DataFrame:
    """Complete rows with ``label`` = log10 of the aftershock count."""
    rows = features.select("eq_id", TARGET, *[F.col(c).cast("double").alias(c) for c in cols])
    return rows.na.drop(subset=[*cols, TARGET]).filter(F.col(TARGET) > 0).withColumn(
        "label", log10_count(F.col(TARGET))
    )


def estimator(model: str, n: int, label_std: float):
    """The regressor for ``n`` training rows with the given label deviation.

    The linear models use the normal equations: one pass over the data however
    many rows. MLlib scales features by population deviation there, and divides
    the L2 weight by the label deviation, which ``regParam`` undoes. All numbers
    here are fixed values of the models. The trees take neither ``n`` nor the
    deviation.
    """
    if model == "Ridge":
        return LinearRegression(
            solver="normal", elasticNetParam=0.0, regParam=RIDGE_ALPHA * label_std / n, standardization=True
        )
    if model == "Lasso":
        return LinearRegression(
            solver="normal", elasticNetParam=1.0, regParam=LASSO_ALPHA, maxIter=5000, tol=1e-10, standardization=True
        )
    if model == "RandomForest":
        return RandomForestRegressor(
            numTrees=200, featureSubsetStrategy="sqrt", minInstancesPerNode=2, maxDepth=30,
            maxMemoryInMB=_MEMORY, seed=42,
        )
    if model == "GradientBoosting":
        return GBTRegressor(
            maxIter=100, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, maxMemoryInMB=_MEMORY, seed=42
        )
    raise ValueError(f"model must be one of {MODELS}")


def with_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Add ``fold``, a share of the ids by their MD5 sum, which any engine can state."""
    share = F.conv(F.substring(F.md5(F.col("eq_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("fold", F.pmod(share, F.lit(folds)).cast("int"))


def _fit(
    train: DataFrame, model: str, cols: list[str], n: int = 0, label_std: float = 0.0
) -> PipelineModel | ForestModel:
    if model == "RandomForest":
        return fit_forest(train, list(cols), estimator(model, n, label_std))
    vector = VectorAssembler(inputCols=list(cols), outputCol="features")
    return Pipeline(stages=[vector, estimator(model, n, label_std)]).fit(train)


def solve(sums: np.ndarray, model: str, start: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Weights of the columns and the intercept from a matrix of sums, and whether they are optimal.

    ``sums`` adds up the outer products of ``(columns, label, 1)``. Columns are
    scaled by the mean and deviation of the rows in the sums, as a model fitted
    on those rows alone would do.
    """
    k, n = len(sums) - 2, sums[-1, -1]
    mean, label = sums[:k, -1] / n, sums[k, -1] / n
    spread = np.sqrt(np.maximum(np.diag(sums)[:k] / n - mean**2, 0))
    scale = np.where(spread > CONSTANT, spread, np.inf)
    inner = (sums[:k, :k] / n - np.outer(mean, mean)) / np.outer(scale, scale)
    toward = (sums[:k, k] / n - mean * label) / scale
    if model == "Ridge":
        w = np.linalg.solve(inner + RIDGE_ALPHA / n * np.eye(k), toward)
        good = bool(np.abs(inner @ w + RIDGE_ALPHA / n * w - toward).max(initial=0) < 1e-6)
    else:
        w, varies = np.zeros(k), np.isfinite(scale)
        if start is not None:
            w[varies] = start[:k][varies] * scale[varies]
        size = np.diag(inner)
        for _ in range(20_000):
            before = w.copy()
            for j in np.flatnonzero(size > 0):
                rho = toward[j] - inner[j] @ w + size[j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - LASSO_ALPHA, 0.0) / size[j]
            if np.abs(w - before).max(initial=0) < 1e-12:
                break
        slope = toward - inner @ w
        good = bool(np.where(w != 0, np.abs(slope - LASSO_ALPHA * np.sign(w)), np.abs(slope) - LASSO_ALPHA).max(initial=0) < 1e-6)
    weights = np.where(np.isfinite(scale), w / scale, 0.0)
    return np.append(weights, label - weights @ mean), good


def cross_predict_linear(rows: DataFrame, model: str, folds: int | str, cols: list[str]) -> DataFrame:
    """``eq_id, model, y, y_hat, optimal`` without a fit per fold.

    One pass adds up the normal equations, by fold; a fold is left out by
    subtracting its sums. Leaving one out subtracts a row's own products inside
    its task, so any number of rows takes two passes.
    """
    first = rows.agg(
        F.count("*").alias("n"), F.avg("label").alias("label"),
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
    ).first()
    mean = np.array([first[f"m_{c}"] or 0.0 for c in cols])
    spread = np.array([first[f"s_{c}"] or 0.0 for c in cols])
    scale = np.where(spread > CONSTANT * np.maximum(np.abs(mean), 1e-12), spread, np.inf)
    label, k = first["label"] or 0.0, len(cols)
    one_out = folds == "loo"

    def vectors(part: pd.DataFrame) -> np.ndarray:
        """Columns near mean 0 and deviation 1, so that subtracting sums loses no digits."""
        z = (part[cols].to_numpy(float) - mean) / scale
        return np.column_stack([z, part["label"].to_numpy(float) - label, np.ones(len(part))])

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            v = vectors(part)
            for fold in part["fold"].unique():
                mine = v[(part["fold"] == fold).to_numpy()]
                yield pd.DataFrame({"fold": [fold], "sums": [(mine.T @ mine).ravel()]})

    numbered = rows.withColumn("fold", F.lit(0)) if one_out else rows
    per_cell = (
        numbered.select("fold", "label", *cols)
        .mapInPandas(add_up, "fold int, sums array<double>")
        .select("fold", F.posexplode("sums").alias("cell", "value"))
        .groupBy("fold", "cell")
        .agg(F.sum("value").alias("value"))
        .collect()  # one matrix per fold
    )
    sums = {f: np.zeros((k + 2) ** 2) for f in {r["fold"] for r in per_cell}}
    for r in per_cell:
        sums[r["fold"]][r["cell"]] = r["value"]
    sums = {f: s.reshape(k + 2, k + 2) for f, s in sums.items()}
    if first["n"] < 2 or not one_out and len(sums) < 2:
        raise ValueError("too few complete rows for more than one fold")
    total = sum(sums.values())
    start, _ = solve(total, model)
    of_fold = {} if one_out else {f: solve(total - s, model, start) for f, s in sums.items()}

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            v = vectors(part)
            fits = [
                solve(total - np.outer(x, x), model, start) if one_out else of_fold[f]
                for x, f in zip(v, part["fold"])
            ]
            guess = [x[:k] @ w[:k] + w[k] + label for x, (w, _) in zip(v, fits)]
            yield pd.DataFrame(
                {"eq_id": part["eq_id"], "model": model, "y": part["label"], "y_hat": guess, "optimal": [g for _, g in fits]}
            )

    kind = rows.schema["eq_id"].dataType.simpleString()
    return numbered.select("eq_id", "label", "fold", *cols).mapInPandas(
        predict, f"eq_id {kind}, model string, y double, y_hat double, optimal boolean"
    )


def cross_predict(
    features: DataFrame,
    model: str,
    folds: int | str = 5,
    cols: list[str] = REGRESSION_COLUMNS,
    parallelism: int = 4,
) -> DataFrame:
    """``eq_id, model, y, y_hat``: each row predicted by a model that has not seen its fold.

    ``folds='loo'`` leaves one row out. The linear models then take two passes;
    the trees fit a model per row, which is what leaving one out means for them. The
    rows are written out once: every fit reads them from there, and appends its
    predictions to one table. A linear fit that did not converge is an error.
    """
    rows = training_rows(features, cols)
    if folds != "loo":
        rows = stage_table(with_folds(rows, int(folds)), "folds")
    elif model in LINEAR:
        rows = stage_table(rows, "folds")
    else:
        rows = stage_table(rows, "rows")
        rows = stage_table(rows.join(numbered(rows, "eq_id", "fold"), "eq_id"), "folds")
    if model in LINEAR:
        stopped = F.raise_error(F.concat(F.lit(f"{model} without an optimum for "), F.col("eq_id").cast("string")))
        fitted = cross_predict_linear(rows, model, folds, cols)
        sure = F.when(F.col("optimal"), F.col("y_hat")).otherwise(stopped.cast("double"))
        return fitted.withColumn("y_hat", sure).drop("optimal")
    return cross_predict_trees(rows, model, cols, parallelism)


def cross_predict_trees(rows: DataFrame, model: str, cols: list[str], parallelism: int = 4) -> DataFrame:
    """A fit per ``fold`` of the rows; each writes its predictions to a folder of one table."""
    first, last, n = rows.agg(F.min("fold"), F.max("fold"), F.countDistinct("fold")).first()
    if n < 2:
        raise ValueError("too few complete rows for more than one fold")
    spark = rows.sparkSession
    path = scratch_path(spark, "predictions")

    def held_out(fold: int) -> None:
        fitted = _fit(rows.filter(F.col("fold") != fold), model, cols)
        predicted = fitted.transform(rows.filter(F.col("fold") == fold)).select(
            "eq_id", F.lit(model).alias("model"), F.col("label").alias("y"), F.col("prediction").alias("y_hat")
        )
        predicted.write.mode("overwrite").parquet(f"{path}/fold={fold}")

    with ThreadPoolExecutor(parallelism) as pool:
        for _ in pool.map(inheritable_thread_target(spark)(held_out), range(first, last + 1)):
            pass
    kind = rows.schema["eq_id"].dataType.simpleString()
    table = spark.read.schema(f"eq_id {kind}, model string, y double, y_hat double, fold bigint").parquet(path)
    return table.drop("fold")


def regression_metrics(pred: DataFrame) -> DataFrame:
    """Errors per model in counts and in log10 of counts."""
    both = pred.select(
        "model",
        F.col("y").alias("lt"), F.col("y_hat").alias("lp"),
        count_from_log10(F.col("y")).alias("ct"), count_from_log10(F.col("y_hat")).alias("cp"),
    )

    def three(truth: str, guess: str, digits: int, names: tuple[str, str, str]):
        err = F.col(guess) - F.col(truth)
        sse = F.avg(err * err)
        return [
            F.round(F.avg(F.abs(err)), digits).alias(names[0]),
            F.round(F.sqrt(sse), digits).alias(names[1]),
            F.round(F.lit(1.0) - F.try_divide(sse, F.var_pop(truth)), 4).alias(names[2]),
        ]

    return both.groupBy("model").agg(
        *three("ct", "cp", 1, ("MAE", "RMSE", "R2")),
        *three("lt", "lp", 4, ("logMAE", "logRMSE", "logR2")),
    )


def pick_best(metrics: DataFrame) -> DataFrame:
    """The model with the smallest error in log space."""
    return metrics.orderBy("logMAE", "model").limit(1)


def fit_full(features: DataFrame, model: str, cols: list[str] = REGRESSION_COLUMNS) -> PipelineModel | ForestModel:
    """Fit on all complete rows; the model carries the feature list."""
    rows = stage_table(training_rows(features, cols), "training")
    size = rows.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("sd")).first()
    return _fit(rows, model, cols, size["n"], size["sd"])


def save_model(model: PipelineModel | ForestModel, path: str) -> str:
    if isinstance(model, ForestModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel | ForestModel:
    return load_forest(SparkSession.active(), path) or PipelineModel.load(path)


def importances(model: PipelineModel | ForestModel, top: int = 15) -> DataFrame:
    """``feature, importance`` of a tree model, most important first."""
    if isinstance(model, ForestModel):
        names, weights = model.cols, model.importances()
    else:
        vector, fitted = model.stages
        names, weights = vector.getInputCols(), fitted.featureImportances.toArray()
    pairs = [(name, float(w)) for name, w in zip(names, weights)]
    return (
        SparkSession.active()
        .createDataFrame(pairs, "feature string, importance double")
        .orderBy(F.col("importance").desc(), "feature")
        .limit(top)
    )


def feature_vectors(features: DataFrame, cols: list[str] = VECTOR_COLUMNS) -> tuple[DataFrame, PipelineModel]:
    """Add ``raw_features`` and the standardised ``features``; also the fitted pipeline.

    The filled rows are written out once, for the fit and for the result.
    """
    filled = stage_table(fill_numeric(features, cols), "filled")
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]
    fitted = Pipeline(stages=stages).fit(filled)
    return fitted.transform(filled), fitted
