"""Training, scoring and description of the boosted-tree load model on the log scale."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import partial

from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattfleet.functions.quantiles import median_of
from wattfleet.operators import boosting
from wattfleet.operators.trees import Forest, boosted_nodes, collect_forest
from wattfleet.schema import MODEL_FEATURES, TARGET_LOG, require_columns
from wattfleet.session import materialize, scratch_path
from wattfleet.sources import slices

DEFAULT_AREA = 10000.0      # fixed value: floor area when no row knows one
MISSING = -1.0e6            # stands for a missing feature, below every real value
_NODE = ("struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,"
         "split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def temporal_split(df: DataFrame, split_time, meter: int | None = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): before the time, and on or after it; electricity unless told otherwise."""
    rows = df if meter is None else df.where(F.col("meter") == int(meter))
    at = F.lit(str(split_time)).cast("timestamp_ntz")
    return slices.before(rows, at), slices.between(rows, first=at)


def prepare_features(df: DataFrame) -> DataFrame:
    """Check the contract and fill a missing floor area with the table's median."""
    require_columns(df.columns, MODEL_FEATURES, "feature table")
    fill = F.coalesce(median_of(df, "square_feet"), F.lit(DEFAULT_AREA))
    return df.withColumn("square_feet", F.coalesce(F.col("square_feet").cast("double"), fill))


def tree_inputs(df: DataFrame) -> dict[str, Column]:
    """The features as doubles for the trees; a missing value gets its own place far left of all others."""
    return {f"__in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in MODEL_FEATURES}


def _assembled(df: DataFrame) -> DataFrame:
    ready = prepare_features(df)
    named = tree_inputs(ready)
    check_contract([c.removeprefix("__in_") for c in named])
    vector = VectorAssembler(inputCols=list(named), outputCol="features")
    return vector.transform(ready.withColumns(named)).drop(*named)


def check_contract(names: list[str]) -> None:
    if list(names) != list(MODEL_FEATURES):
        raise ValueError("the model's features differ from the contract in names or order")


def train_gbt(
    train: DataFrame, validation: DataFrame | None = None, max_iter: int = 500, step_size: float = 0.05,
    max_depth: int = 6, min_rows: int = 20, sampling: float = 0.8, seed: int = 42, max_bins: int = 64,
    patience: int = 30, first_rounds: int = 128,
) -> GBTRegressionModel:
    """Fit boosted trees on the log target, one round after the other (``boosting``).

    With a validation table the number of trees is the one before ``patience`` rounds without a lower
    hold-out error. ``first_rounds`` has no effect on the model: no round is fitted twice any more.
    """
    rows = train.select(*MODEL_FEATURES, TARGET_LOG, F.lit(False).alias("__held"))
    if validation is not None:
        rows = rows.unionByName(validation.select(*MODEL_FEATURES, TARGET_LOG, F.lit(True).alias("__held")))
    ready = prepare_features(rows.where(F.col(TARGET_LOG).isNotNull()))
    named = tree_inputs(ready)
    check_contract([c.removeprefix("__in_") for c in named])
    ready = materialize(ready.select(*[c.alias(n) for n, c in named.items()], TARGET_LOG, "__held"), "boosting-rows")
    learner = GBTRegressor(
        featuresCol="features", labelCol=TARGET_LOG, predictionCol="predicted_log", maxIter=max_iter,
        stepSize=step_size, maxDepth=max_depth, minInstancesPerNode=min_rows, subsamplingRate=sampling,
        featureSubsetStrategy=str(sampling), seed=seed, maxBins=max_bins)
    settings = boosting.Settings(max_iter, step_size, max_depth, min_rows, sampling, seed, max_bins)
    held = None if validation is None else ready.where("__held")
    trees, cuts = boosting.fit(
        ready.where(~F.col("__held")), list(named), TARGET_LOG, held, settings, partial(best_prefix, patience=patience))
    return spark_model(train.sparkSession, learner, trees, cuts)


def spark_model(spark: SparkSession, learner: GBTRegressor, trees: list[boosting.Tree], cuts: list) -> GBTRegressionModel:
    """Trees as Spark ML's model: written in the form it stores models in, and loaded."""
    path = scratch_path(spark, "boosted-trees")
    learner.save(f"{path}/learner")
    about = json.loads(spark.read.text(f"{path}/learner/metadata").first()[0])
    about |= {"class": "org.apache.spark.ml.regression.GBTRegressionModel", "numFeatures": len(cuts), "numTrees": len(trees)}
    own = {k: about["paramMap"][k] for k in ("featuresCol", "labelCol", "maxBins", "maxDepth", "minInstancesPerNode", "seed")}
    tree = lambda i: json.dumps({
        k: about[k] for k in ("timestamp", "sparkVersion")} | {
        "class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "uid": f"{about['uid']}_{i}", "paramMap": own, "defaultParamMap": {}})
    store = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write
    store([(json.dumps(about),)], "value string").text(f"{path}/model/metadata")
    store([(i, tree(i), t.weight) for i, t in enumerate(trees)], "_1 int, _2 string, _3 double").parquet(f"{path}/model/treesMetadata")
    store(list(boosting.node_rows(trees, cuts)), f"treeID int, nodeData {_NODE}").parquet(f"{path}/model/data")
    return load_model(f"{path}/model")


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first ``n`` trees: each tree was fitted to what the earlier ones left over, so none changes."""
    whole = model._java_obj
    if n >= len(whole.trees()):
        return model
    context = SparkContext.getOrCreate()
    gateway, jvm = context._gateway, context._jvm
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = whole.trees()[i], whole.treeWeights()[i]
    part = jvm.org.apache.spark.ml.regression.GBTRegressionModel(whole.uid(), trees, weights, whole.numFeatures())
    return GBTRegressionModel._from_java(part.copy(whole.extractParamMap()))


def best_prefix(errors: list[float], patience: int) -> tuple[int, bool]:
    """(trees with the lowest error before ``patience`` rounds without a lower one, whether these rounds passed)."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def predict(df: DataFrame, model: GBTRegressionModel) -> DataFrame:
    """Add predicted_log and predicted_kwh (never negative) to rows with the 22 features."""
    out = model.setPredictionCol("predicted_log").transform(_assembled(df))
    return out.drop("features").withColumn(
        "predicted_kwh", F.greatest(F.expm1("predicted_log"), F.lit(0.0)))


def save_model(model: GBTRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> GBTRegressionModel:
    model = GBTRegressionModel.load(path)
    if model.numFeatures != len(MODEL_FEATURES):
        raise ValueError(f"the model takes {model.numFeatures} features, the contract has {len(MODEL_FEATURES)}")
    return model


@dataclass
class TreeModel:
    """A fitted model with its node table on shared storage and as arrays for the tasks."""

    model: GBTRegressionModel
    path: str
    forest: Forest

    def nodes(self, spark: SparkSession) -> DataFrame:
        return boosted_nodes(spark, self.path)


def with_nodes(spark: SparkSession, model: GBTRegressionModel, path: str | None = None) -> TreeModel:
    path = path or scratch_path(spark, "load-model")
    save_model(model, path)
    return TreeModel(model, path, collect_forest(boosted_nodes(spark, path)))


def feature_importance(nodes: DataFrame, kind: str = "gain", top: int | None = None, lowest: bool = False) -> DataFrame:
    """Total gain or number of splits per feature over all trees, largest first.

    ``top`` keeps that many; ``lowest`` keeps the smallest ones instead.
    """
    if kind not in ("gain", "split"):
        raise ValueError("kind is 'gain' or 'split'")
    spark = nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(MODEL_FEATURES)), "feature_index int, feature string")
    value = F.sum("gain") if kind == "gain" else F.count(F.lit(1)).cast("double")
    used = nodes.where("left >= 0").groupBy(F.col("feature").alias("feature_index")).agg(value.alias("importance"))
    out = names.join(used, "feature_index", "left").select(
        "feature", F.coalesce("importance", F.lit(0.0)).alias("importance"), F.lit(kind).alias("importance_type"))
    if top and lowest:
        out = out.orderBy(F.asc("importance"), F.desc("feature")).limit(top)
    out = out.orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top and not lowest else out


def described(nodes: DataFrame, kind: str, features: list[str]) -> DataFrame:
    """One row about a stored node table: kind, size and features, of which some split a node."""
    inner = F.col("left") >= 0
    return nodes.agg(
        F.lit(kind).alias("model_type"), F.countDistinct("tree_id").cast("int").alias("num_trees"),
        F.count(F.lit(1)).alias("num_nodes"), F.lit(len(features)).alias("num_features"),
        F.countDistinct(F.when(inner, F.col("feature"))).cast("int").alias("used_features"),
        F.array(*map(F.lit, features)).alias("features"))


def model_metadata(spark: SparkSession, fitted: TreeModel) -> DataFrame:
    """What the stored model is, read from its node table."""
    about = described(fitted.nodes(spark), type(fitted.model).__name__, list(MODEL_FEATURES))
    return about.withColumn("target_scale", F.lit("log1p(meter_reading)"))
