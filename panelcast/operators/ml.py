"""Boosted-tree regression on the lag frame with Spark ML.

Training, scoring, cross-validation and feature selection all run as Spark
ML jobs on executors. Only model metadata (one importance per feature) comes
back to the driver, to build the importance table and the slicer indices.

Settings of the source's trainers are kept as named defaults: the first fit
(27 trees, depth 10, rate 0.18), the refit on selected features (29 trees,
depth 10, rate 0.13), the CV grid (depth {5, 6} x rate {0.1, 0.4}, 3 folds)
and the selector (top 70 % of features, or score > 0.01). Spark's
``GBTRegressor`` is not the same booster (no L2 leaf penalty, different
early-stopping rule), so predictions are comparable in kind, not in value.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasOutputCol
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
                             MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.split import mark_split
from panelcast.session import scratch_path

# Trainer settings of the source scripts.
FIRST_FIT = {"maxIter": 27, "maxDepth": 10, "stepSize": 0.18}
REFIT = {"maxIter": 29, "maxDepth": 10, "stepSize": 0.13}
CV_DEPTHS = (5, 6)
CV_STEPS = (0.1, 0.4)
CV_FOLDS = 3
PATIENCE = 5
# The source names no number of rounds for its cross-validation.
CV_ROUNDS = 10
SELECT_FRACTION = 0.7
SELECT_TOP_N = 20
SELECT_THRESHOLD = 0.01
NON_FEATURES = ("Y", "code", "dt")

SELECTOR_TYPES = ("numTopFeatures", "threshold")


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = NON_FEATURES) -> list[str]:
    """Every column except the label and the keys, in frame order."""
    return [c for c in df.columns if c not in exclude]


def assembler(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def gbt(max_iter: int = FIRST_FIT["maxIter"], max_depth: int = FIRST_FIT["maxDepth"],
        step_size: float = FIRST_FIT["stepSize"], features_col: str = "features",
        label_col: str = "Y", prediction_col: str = "prediction", seed: int = 42,
        validation_col: str | None = None, validation_tol: float = 0.01,
        max_bins: int = 32) -> GBTRegressor:
    """Squared-loss boosted trees; ``validation_col`` turns on early stopping."""
    extra = {"validationIndicatorCol": validation_col,
             "validationTol": validation_tol} if validation_col else {}
    return GBTRegressor(featuresCol=features_col, labelCol=label_col,
                        predictionCol=prediction_col, lossType="squared",
                        maxIter=max_iter, maxDepth=max_depth, stepSize=step_size,
                        seed=seed, maxBins=max_bins, **extra)


def mark_validation_tail(train: DataFrame, fraction: float = 0.8,
                         out: str = "is_validation") -> DataFrame:
    """Flag the latest dates of the training rows as the early-stopping set.

    Uses the same date rule as the train/test split, inside the training
    data, so the test rows never steer training.
    """
    marked = mark_split(train, fraction, out="_fit")
    return marked.withColumn(out, ~F.col("_fit")).drop("_fit")


def mark_time_folds(df: DataFrame, folds: int = CV_FOLDS, dt: str = "dt",
                    out: str = "fold") -> DataFrame:
    """Fold index by contiguous date ranges (``0 .. folds-1``), for ``foldCol``.

    The date span is split into ``folds`` equal ranges; the bounds are a
    one-row aggregate read as scalar subqueries (no collect, no join).
    """
    b = df.agg(F.min(dt).alias("lo"), F.max(dt).alias("hi"))
    lo = b.select("lo").scalar()
    span = b.select(F.datediff("hi", "lo") + 1).scalar()
    idx = F.floor(F.datediff(F.col(dt), lo) * F.lit(folds) / span).cast(T.IntegerType())
    return df.withColumn(out, idx)


def fit_pipeline(train: DataFrame, features: list[str], estimator,
                 features_col: str = "features") -> PipelineModel:
    return Pipeline(stages=[assembler(features, features_col), estimator]).fit(train)


def round_errors(booster, sets: dict[str, DataFrame]) -> dict[str, list[float]]:
    """RMSE after every round on each named (assembled) frame."""
    return {name: [float(e) ** 0.5 for e in booster.evaluateEachIteration(df, "squared")]
            for name, df in sets.items()}


def best_round(errors: list[float], patience: int = PATIENCE) -> int:
    """Rounds to keep: the best one before ``patience`` rounds without a better one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_rounds(booster, df: DataFrame, rounds: int, out: str = "prediction") -> DataFrame:
    """Predictions of the first ``rounds`` trees of a fitted booster."""
    kept = df.columns
    total = F.lit(0.0)
    for i in range(rounds):
        tree = booster.trees[i].setFeaturesCol(booster.getFeaturesCol()).setPredictionCol(f"_tree{i}")
        df = tree.transform(df)
        total = total + F.lit(float(booster.treeWeights[i])) * F.col(f"_tree{i}")
    return df.select(*kept, total.alias(out))


def fit_with_patience(train: DataFrame, features: list[str], est: GBTRegressor,
                      sets: dict[str, DataFrame], watch: str, patience: int = PATIENCE):
    """Fit, evaluate every round on each set, and stop by the set ``watch``.

    Returns ``(pipeline_model, rounds, history)``; ``history`` has one row
    ``(round, set, rmse)`` per evaluated round and set. Score with
    :func:`first_rounds` on the booster to use the kept rounds only.
    """
    model = fit_pipeline(train, features, est, est.getFeaturesCol())
    first = model.stages[0]
    errors = round_errors(model.stages[-1], {n: first.transform(df) for n, df in sets.items()})
    rows = [(i + 1, name, e) for name, es in errors.items() for i, e in enumerate(es)]
    history = train.sparkSession.createDataFrame(rows, "round int, set string, rmse double")
    return model, best_round(errors[watch], patience), history


def importance_table(spark: SparkSession, importances, dataset: DataFrame,
                     features_col: str = "features") -> DataFrame:
    """``(idx, name, score)`` for every feature, highest score first.

    Names come from the vector column's ML attribute metadata (all attribute
    groups); scores from the model's importance vector.
    """
    rows = [(int(a["idx"]), str(a.get("name", f"f{a['idx']}")), float(importances[int(a["idx"])]))
            for a in _attrs(dataset, features_col)]
    rows.sort(key=lambda r: (-r[2], r[0]))
    schema = T.StructType([T.StructField("idx", T.IntegerType(), False),
                           T.StructField("name", T.StringType(), False),
                           T.StructField("score", T.DoubleType(), False)])
    return spark.createDataFrame(rows, schema)


def _attrs(dataset: DataFrame, features_col: str) -> list[dict]:
    meta = dataset.schema[features_col].metadata.get("ml_attr", {})
    groups = meta.get("attrs", {})
    out: list[dict] = []
    for group in groups.values():
        out.extend(group)
    return sorted(out, key=lambda a: a["idx"])


def _ranked(importances, dataset: DataFrame, features_col: str) -> list[tuple[int, float]]:
    pairs = [(int(a["idx"]), float(importances[int(a["idx"])]))
             for a in _attrs(dataset, features_col)]
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


def select_top(ranked: list[tuple[int, float]], n: int) -> list[int]:
    return [i for i, _ in ranked[:n]]


def select_threshold(ranked: list[tuple[int, float]], threshold: float) -> list[int]:
    return [i for i, s in ranked if s > threshold]


def select_split_on(ranked: list[tuple[int, float]], top_fraction: float | None = None) -> list[int]:
    """Features used by at least one split; optionally only the top share of them."""
    used = [i for i, s in ranked if s > 0]
    if top_fraction is not None:
        used = used[:int(len(used) * top_fraction)]
    return used


class _SelectorWriter(MLWriter):
    """Saves the selector's own parameters and, in a folder of its own, its estimator."""

    def __init__(self, instance: FeatureImpSelector):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        own = {p.name: v for p, v in self.instance._paramMap.items() if p.name != "estimator"}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, paramMap=own,
                                         extraMetadata={"hasEstimator": self.instance.isSet("estimator")})
        if self.instance.isSet("estimator"):
            self.instance.getEstimator().write().save(f"{path}/estimator")


class _SelectorReader(MLReader):
    def load(self, path: str) -> FeatureImpSelector:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession, f"{__name__}.FeatureImpSelector")
        selector = FeatureImpSelector()
        selector._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(selector, metadata)
        if metadata["hasEstimator"]:
            selector.setEstimator(DefaultParamsReader.loadParamsInstance(f"{path}/estimator", self.sparkSession))
        return selector


class FeatureImpSelector(Estimator, HasOutputCol, MLReadable, MLWritable):
    """Fits a tree estimator and keeps the features it found most important.

    ``selectorType="numTopFeatures"`` keeps the ``numTopFeatures`` highest
    scores; ``"threshold"`` keeps scores strictly above ``threshold``. The
    fitted result is a ``VectorSlicer`` over the estimator's features column
    with the indices in descending-score order.
    """

    estimator = Param(Params._dummy(), "estimator", "tree estimator exposing featureImportances")
    selectorType = Param(Params._dummy(), "selectorType",
                         "numTopFeatures (default) or threshold",
                         typeConverter=TypeConverters.toString)
    numTopFeatures = Param(Params._dummy(), "numTopFeatures",
                           "number of features to keep, by descending importance",
                           typeConverter=TypeConverters.toInt)
    threshold = Param(Params._dummy(), "threshold",
                      "keep features whose importance is strictly above this",
                      typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, estimator=None, selectorType="numTopFeatures",
                 numTopFeatures=SELECT_TOP_N, threshold=SELECT_THRESHOLD,
                 outputCol="features"):
        super().__init__()
        self._setDefault(selectorType="numTopFeatures", numTopFeatures=SELECT_TOP_N,
                         threshold=SELECT_THRESHOLD, outputCol="features")
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, estimator=None, selectorType="numTopFeatures",
                  numTopFeatures=SELECT_TOP_N, threshold=SELECT_THRESHOLD,
                  outputCol="features"):
        return self._set(**self._input_kwargs)

    def setEstimator(self, value):
        return self._set(estimator=value)

    def getEstimator(self):
        return self.getOrDefault(self.estimator)

    def setSelectorType(self, value):
        return self._set(selectorType=value)

    def getSelectorType(self):
        return self.getOrDefault(self.selectorType)

    def setNumTopFeatures(self, value):
        return self._set(numTopFeatures=value)

    def getNumTopFeatures(self):
        return self.getOrDefault(self.numTopFeatures)

    def setThreshold(self, value):
        return self._set(threshold=value)

    def getThreshold(self):
        return self.getOrDefault(self.threshold)

    def copy(self, extra=None):
        """A copy whose estimator is a copy too, with the parameters of ``extra`` that are its own."""
        new = super().copy(extra)
        return new.setEstimator(self.getEstimator().copy(extra)) if self.isSet("estimator") else new

    def write(self) -> MLWriter:
        return _SelectorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SelectorReader()

    def _fit(self, dataset: DataFrame) -> VectorSlicer:
        est = self.getEstimator()
        kind = self.getSelectorType()
        if kind not in SELECTOR_TYPES:
            raise NameError(f"unknown selector type {kind!r}; choose one of {', '.join(SELECTOR_TYPES)}")
        model = est.fit(dataset)
        ranked = _ranked(model.featureImportances, dataset, est.getFeaturesCol())
        if kind == "numTopFeatures":
            idx = select_top(ranked, self.getNumTopFeatures())
        else:
            idx = select_threshold(ranked, self.getThreshold())
        return VectorSlicer(inputCol=est.getFeaturesCol(), outputCol=self.getOutputCol(),
                            indices=idx)


def selection_pipeline(features: list[str], selector_est: GBTRegressor,
                       final_est: GBTRegressor, selector_type: str = "numTopFeatures",
                       num_top: int | None = None,
                       threshold: float = SELECT_THRESHOLD) -> Pipeline:
    """``[assembler, selector, regressor on the selected subset]``."""
    n = num_top if num_top is not None else int(len(features) * SELECT_FRACTION)
    sel = FeatureImpSelector(estimator=selector_est, selectorType=selector_type,
                             numTopFeatures=n, threshold=threshold,
                             outputCol=final_est.getFeaturesCol())
    return Pipeline(stages=[assembler(features, selector_est.getFeaturesCol()), sel, final_est])


def cross_validator(features: list[str], estimator: GBTRegressor,
                    depths=CV_DEPTHS, steps=CV_STEPS, folds: int = CV_FOLDS,
                    parallelism: int = 2, seed: int = 42,
                    fold_col: str | None = None) -> CrossValidator:
    """3-fold CV over depth x rate, RMSE, best model refit on all training rows.

    ``fold_col`` gives user-defined folds (e.g. by date) instead of random rows.
    """
    pipe = Pipeline(stages=[assembler(features, estimator.getFeaturesCol()), estimator])
    grid = (ParamGridBuilder().addGrid(estimator.maxDepth, list(depths))
            .addGrid(estimator.stepSize, list(steps)).build())
    ev = RegressionEvaluator(labelCol=estimator.getLabelCol(),
                             predictionCol=estimator.getPredictionCol(), metricName="rmse")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev,
                        numFolds=folds, parallelism=parallelism, seed=seed)
    if fold_col:
        cv.setFoldCol(fold_col)
    return cv


#: Fold errors that one aggregate can give, by the evaluator's metric.
FOLD_ERRORS = {
    "rmse": lambda e: F.sqrt(F.avg(e * e)),
    "mse": lambda e: F.avg(e * e),
    "mae": lambda e: F.avg(F.abs(e)),
}


def cross_validate_in_one_pass(cv: CrossValidator, dataset: DataFrame) -> CrossValidatorModel:
    """``cv.fit(dataset)`` with all models of all folds evaluated by one job.

    The rows are written once, by fold (the folds that ``cv`` would draw). After
    the fits, one job reads every row once, scores it with the models that did
    not see its fold, a column per parameter set, and one aggregate grouped by
    fold gives all errors; ``cv`` itself runs a job per fold and parameter set.
    The estimator is a pipeline whose last stage predicts and whose other
    stages do not depend on the parameters or on the rows fitted.
    """
    metric = cv.getEvaluator().getMetricName()
    if metric not in FOLD_ERRORS:
        raise ValueError(f"cannot aggregate {metric!r}; choose one of {', '.join(FOLD_ERRORS)}")
    folds, grid, fold_col = cv.getNumFolds(), cv.getEstimatorParamMaps(), cv.getFoldCol()
    fold = F.col(fold_col) if fold_col else F.floor(F.rand(cv.getSeed()) / F.lit(1.0 / folds))
    out = F.raise_error(F.concat(F.lit(f"not a fold below {folds}: "), F.coalesce(fold.cast("string"), F.lit("null"))))
    path = scratch_path(dataset.sparkSession, "cv-rows")
    dataset.withColumn("_fold", F.when((fold >= 0) & (fold < folds), fold).otherwise(out.cast("int")).cast("int")
                       ).write.partitionBy("_fold").parquet(path)
    rows = dataset.sparkSession.read.parquet(path)
    label = cv.getEvaluator().getLabelCol()
    fitted = []  # by fold, one model per parameter set
    with ThreadPool(max(1, cv.getParallelism())) as pool:
        for k in range(folds):
            train = rows.where(F.col("_fold") != k).drop("_fold")
            one = cv.getEstimator().fitMultiple(train, grid)
            fitted.append([m for _, m in sorted(pool.map(lambda _: next(one), grid), key=lambda x: x[0])])
    scored = None
    for k, models in enumerate(fitted):
        part = PipelineModel(models[0].stages[:-1]).transform(rows.where(F.col("_fold") == k))
        for i, model in enumerate(models):
            part = model.stages[-1].copy().setPredictionCol(f"_p{i}").transform(part)
        part = part.select("_fold", *[(F.col(f"_p{i}") - F.col(label)).alias(f"_e{i}") for i in range(len(grid))])
        scored = part if scored is None else scored.unionByName(part)
    errors = scored.groupBy("_fold").agg(*[FOLD_ERRORS[metric](F.col(f"_e{i}")).alias(f"m{i}") for i in range(len(grid))])
    by_fold = {r["_fold"]: [r[f"m{i}"] for i in range(len(grid))] for r in errors.collect()}  # one row per fold
    if len(by_fold) < folds:
        raise ValueError(f"only the folds {sorted(by_fold)} of {folds} have rows")
    average = [sum(by_fold[k][i] for k in range(folds)) / folds for i in range(len(grid))]
    best = min(range(len(grid)), key=average.__getitem__)
    model = cv.getEstimator().fit(rows.drop("_fold"), grid[best])
    return cv._copyValues(CrossValidatorModel(model, average))


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_cv_model(path: str) -> CrossValidatorModel:
    return CrossValidatorModel.load(path)


def load_pipeline_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
