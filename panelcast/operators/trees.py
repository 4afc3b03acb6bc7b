"""Fitted trees as tables, and boosters put together from trees.

The library's importances are normalised tree by tree, so they do not rank
features by total gain. A saved model is a table of tree nodes; a split's
gain is the impurity it takes away per row, so rows times gain is the squared
error that the split removes, and its sum per feature is the total gain.
"""

from __future__ import annotations

import uuid

from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import scratch_path

LEAF = -1


def tree_nodes(model) -> DataFrame:
    """One row per node of a tree or booster: tree, node, n_rows, impurity, prediction,
    gain, feature, threshold, left, right (of leaves, the last five are null)."""
    path = scratch_path(_session(), "tree-nodes")
    model.write().save(path)
    saved = _session().read.parquet(f"{path}/data")
    if "treeID" not in saved.columns:
        saved = saved.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    inner = F.col("nodeData.leftChild") != LEAF

    def of_split(c: str, name: str):
        return F.when(inner, F.col(c)).alias(name)

    return saved.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.col("nodeData.rawCount").alias("n_rows"),
        F.col("nodeData.impurity").alias("impurity"), F.col("nodeData.prediction").alias("prediction"),
        of_split("nodeData.gain", "gain"), of_split("nodeData.split.featureIndex", "feature"),
        F.when(inner, F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        of_split("nodeData.leftChild", "left"), of_split("nodeData.rightChild", "right"))


def _session() -> SparkSession:
    return SparkSession.active()


def total_gain(nodes: DataFrame) -> DataFrame:
    """(idx, n_splits, total_gain) of the features that split a node."""
    return (nodes.where("feature is not null").groupBy(F.col("feature").alias("idx"))
            .agg(F.count(F.lit(1)).alias("n_splits"), F.sum(F.col("n_rows") * F.col("gain")).alias("total_gain")))


def gain_table(model, names: list[str]) -> DataFrame:
    """(idx, name, n_splits, total_gain) of every feature, 0 for those without a split."""
    features = _session().createDataFrame(list(enumerate(names)), "idx int, name string")
    return (features.join(total_gain(tree_nodes(model)), "idx", "left")
            .select("idx", "name", F.coalesce("n_splits", F.lit(0).cast("long")).alias("n_splits"),
                    F.coalesce("total_gain", F.lit(0.0)).alias("total_gain")))


def ranked_by_gain(model) -> list[tuple[int, float]]:
    """(feature, total gain) of the features that split, highest first; one row per feature comes back."""
    return sorted(((r.idx, r.total_gain) for r in total_gain(tree_nodes(model)).collect()), key=lambda p: (-p[1], p[0]))


def booster_of(trees: list[DecisionTreeRegressionModel], weights: list[float], features_col: str = "features",
               prediction_col: str = "prediction") -> GBTRegressionModel:
    """The library's booster made of fitted trees; it scores, saves and loads like a fitted one."""
    sc = _session().sparkContext
    package = sc._jvm.org.apache.spark.ml.regression
    java_trees = sc._gateway.new_array(package.DecisionTreeRegressionModel, len(trees))
    java_weights = sc._gateway.new_array(sc._jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        java_trees[i], java_weights[i] = tree._java_obj, float(weight)
    model = GBTRegressionModel(package.GBTRegressionModel(f"gbtr_{uuid.uuid4().hex[:12]}", java_trees, java_weights))
    return model.setFeaturesCol(features_col).setPredictionCol(prediction_col)
