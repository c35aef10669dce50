"""Boosted trees over the features: points of players and winners of matches, their metrics, and walk-forward testing."""

from __future__ import annotations

import datetime
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.operators.features import FEATURES
from crease.session import kept

#: What stands for a missing feature: below all values, so that trees can split it off.
MISSING = -1000.0
OUTCOME = ["toss_first_team", "toss_bat", "batting_1", "bowling_1", "batting_2", "bowling_2"]
#: The league and season that no model ever sees.
HOLDOUT = ("ipl", "2024")


def numbers(rows: DataFrame, features: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in features]
    return rows.select(*rest, *(F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(c) for c in features))


def split(rows: DataFrame, cutoff: str, holdout: tuple[str, str] = HOLDOUT) -> tuple[DataFrame, DataFrame]:
    """Rows to train on (before `cutoff`) and to validate on, both without the held-out league and season."""
    rows = rows.filter(~F.coalesce((F.col("league_id") == holdout[0]) & (F.col("season") == holdout[1]), F.lit(False)))
    return rows.filter(F.col("match_date") < F.lit(cutoff).cast("date")), rows.filter(F.col("match_date") >= F.lit(cutoff).cast("date"))


#: Rows of a part that trees are grown on. A tree is a handful of short jobs over all parts: many small or empty ones cost more than the rows in them.
PART_ROWS = 50_000


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """A matrix of about `n` rows in even parts, in an order that hangs on its keys alone: trees are grown on samples drawn by part and place."""
    return rows.repartition(max(1, math.ceil(n / PART_ROWS)), "match_id", "player_id").sortWithinPartitions("match_id", "player_id")


def gathered(rows: DataFrame) -> DataFrame:
    """`kept`, its parts put together, without a shuffle, to no more than the rows need."""
    rows = kept(rows)
    return rows.coalesce(max(1, math.ceil(rows.count() / PART_ROWS)))


#: Rounds without a better error on the held-out rows after which boosting of points and of outcomes ends.
PATIENCE, OUTCOME_PATIENCE = 30, 20


def best_prefix(errors: list[float], patience: int) -> tuple[int, bool]:
    """How many trees had the least error before `patience` rounds brought none less, and whether those rounds have passed."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def _cut(model: GBTRegressionModel | GBTClassificationModel, n: int) -> GBTRegressionModel | GBTClassificationModel:
    """The model of the first `n` trees."""
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for k in range(n):
        trees[k], weights[k] = java.trees()[k], java.treeWeights()[k]
    package = gateway.jvm.org.apache.spark.ml
    made = (package.classification.GBTClassificationModel if isinstance(model, GBTClassificationModel) else package.regression.GBTRegressionModel)(model.uid, trees, weights)
    return type(model)(made)


def _boosted(estimator: GBTRegressor | GBTClassifier, train: DataFrame, validation: DataFrame, features: list[str], trees: int, patience: int) -> PipelineModel:
    """The trees up to the least error on the validation rows (the training rows if there are none), at most `trees`.

    The error is measured after each tree. Ensembles of twice as many trees are grown until `patience` rounds bring no
    gain, so no more than thrice the trees needed are grown in all; the same seed grows the same first trees.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    rows, held = (gathered(assembler.transform(numbers(x, features)).select("features", F.col("target").cast("double").alias("target"))) for x in (train, validation))
    held = rows if held.isEmpty() else held
    n = min(trees, 2 * patience)
    while True:
        model = estimator.copy({estimator.maxIter: n}).fit(rows)
        errors = model.evaluateEachIteration(held, "squared") if isinstance(model, GBTRegressionModel) else model.evaluateEachIteration(held)
        best, over = best_prefix(list(errors), patience)
        if over or n >= trees:
            return PipelineModel([assembler, _cut(model, best)])
        n = min(trees, 2 * n)


def grown(model: PipelineModel) -> int:
    """How many trees the model has."""
    return model.stages[-1].getNumTrees


def fit_points(train: DataFrame, validation: DataFrame, features: list[str] = FEATURES, trees: int = 500, patience: int = PATIENCE) -> PipelineModel:
    """Regressor of points, boosted until `patience` trees bring no better error on the validation rows (training rows if there are none); it keeps the best first trees."""
    model = GBTRegressor(featuresCol="features", labelCol="target", predictionCol="prediction", stepSize=0.05, maxDepth=6, minInstancesPerNode=3, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
    return _boosted(model, train, validation, features, trees, patience)


def fit_outcome(train: DataFrame, validation: DataFrame, trees: int = 200, patience: int = OUTCOME_PATIENCE) -> PipelineModel:
    """Classifier of whether the first team wins; boosting ends as that of points does."""
    model = GBTClassifier(featuresCol="features", labelCol="target", predictionCol="prediction", stepSize=0.05, maxDepth=4, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
    return _boosted(model, train, validation, OUTCOME, trees, patience)


def accuracy(predicted: DataFrame) -> DataFrame:
    """One row: n, and the share (four digits) of rows whose `predicted` is the `target`; null where there are none."""
    return predicted.agg(F.count("*").alias("n"), F.bround(F.count_if(F.col("predicted") == F.col("target")) / F.nullif(F.count("*"), F.lit(0)), 4).alias("accuracy"))


def predict(model: PipelineModel, rows: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """`match_id, player_id, predicted_points` (two digits) and the player's rank within the match."""
    out = model.transform(numbers(rows, features)).select("match_id", "player_id", F.bround("prediction", 2).alias("predicted_points"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("predicted_points"), "player_id")).cast("long"))


def predict_upcoming(model: PipelineModel, matrix: DataFrame, version: str, features: list[str] = FEATURES) -> DataFrame:
    """Predicted points (two digits) of the players of matches to come, and their rank in the match; the key of what is stored is (player_id, upcoming_id, model_version)."""
    out = model.transform(numbers(matrix, features)).select("upcoming_id", "player_id", "team", "credits", F.bround("prediction", 2).alias("predicted_points"), F.lit(version).alias("model_version"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("upcoming_id").orderBy(F.desc("predicted_points"), "player_id")).cast("long"))


def metrics(scored: DataFrame) -> DataFrame:
    """One row of n, rmse, spearman (average ranks), top_11_overlap and verdict of (match_id, player_id, target, prediction).

    Ranks come from the counts of each distinct value, so no task holds all rows. Null metrics where there is nothing to compare.
    """

    def ranks(c: str) -> DataFrame:
        # A window over all distinct values would sit in one task: ranges of values are counted first, then numbered on their own.
        counts = scored.groupBy(c).count()
        parts = counts.repartitionByRange(F.col(c)).withColumn("part", F.spark_partition_id())
        parts = kept(parts)
        before = parts.groupBy("part").agg(F.sum("count").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        upto = F.sum("count").over(Window.partitionBy("part").orderBy(c))
        return parts.join(F.broadcast(before.select("part", "base")), "part").select(c, (F.col("base") + upto - (F.col("count") - 1) / 2).alias(f"rank_{c}"))

    w = Window.partitionBy("match_id")
    top = lambda c: F.row_number().over(w.orderBy(F.desc(c), "player_id")) <= 11
    overlap = (
        scored.select("match_id", top("target").alias("a"), top("prediction").alias("b"), F.count("*").over(w).alias("n"))
        .filter("n >= 11").groupBy("match_id").agg((F.count_if(F.col("a") & F.col("b")) / 11).alias("x")).agg(F.avg("x").alias("top_11_overlap"))
    )
    ranked = scored.join(ranks("target"), "target").join(ranks("prediction"), "prediction")
    out = ranked.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("target") - F.col("prediction"), 2))).alias("rmse"), F.corr("rank_target", "rank_prediction").alias("spearman")).crossJoin(F.broadcast(overlap))
    return out.withColumn("verdict", F.when(F.col("spearman") >= 0.4, "good").when(F.col("spearman") >= 0.3, "acceptable").otherwise("poor"))


def score(model: PipelineModel, rows: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    return model.transform(numbers(rows, features)).select("match_id", "player_id", F.col("target").cast("double").alias("target"), "prediction")


def windows(rows: DataFrame, step: int = 30, days: int = 90, least_train: int = 1000, least_validation: int = 50) -> list[datetime.date]:
    """First days of the walk-forward windows that have enough rows before them and in their `days`, `step` days apart from the rows' first day on.

    Rows are counted by day first, so what is looked at on the driver is a row a day.
    """
    per = {r["match_date"]: r["n"] for r in rows.groupBy("match_date").agg(F.count(F.lit(1)).alias("n")).filter("match_date is not null").collect()}
    out, cursor = [], min(per, default=None)
    while per and (cursor := cursor + datetime.timedelta(step)) <= max(per):
        end = cursor + datetime.timedelta(days)
        if sum(n for d, n in per.items() if d < cursor) >= least_train and sum(n for d, n in per.items() if cursor <= d < end) >= least_validation:
            out.append(cursor)
    return out


def backtest(rows: DataFrame, folder: str, step: int = 30, days: int = 90, trees: int = 200, patience: int = PATIENCE, least_train: int = 1000, least_validation: int = 50, features: list[str] = FEATURES, at_once: int = 4) -> DataFrame:
    """A row for each of `windows`: cursor_date, n_train, trees kept, and the metrics of a model trained before the day on the `days` from it on.

    The rows are written once and windows are fitted side by side, `at_once` of them, each a distributed fit. Each
    window's row is written to `folder` when it is done, so a run that was cut off goes on where it ended when given the
    same rows and folder.
    """
    spark = rows.sparkSession
    rows = kept(rows)

    def one(cursor: datetime.date) -> str:
        path = f"{folder.rstrip('/')}/cursor={cursor}"
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            day, until = F.lit(cursor), F.lit(cursor + datetime.timedelta(days))
            train, val = rows.filter(F.col("match_date") < day), rows.filter((F.col("match_date") >= day) & (F.col("match_date") < until))
            model = fit_points(train, val, features, trees, patience)
            measured = metrics(kept(score(model, val, features))).select(F.lit(cursor).alias("cursor_date"), F.lit(train.count()).alias("n_train"), F.lit(grown(model)).alias("trees"), "*")
            measured.write.mode("overwrite").parquet(path)
        return path

    with ThreadPoolExecutor(at_once) as pool:
        paths = list(pool.map(inheritable_thread_target(spark)(one), windows(rows, step, days, least_train, least_validation)))
    schema = "cursor_date date, n_train int, trees int, n bigint, rmse double, spearman double, top_11_overlap double, verdict string"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def save(model: PipelineModel, folder: str, version: str) -> str:
    """Write the model under its version; returns the path."""
    model.write().overwrite().save(path := f"{folder.rstrip('/')}/player_points_{version}")
    return path


def load(folder: str, version: str) -> PipelineModel:
    return PipelineModel.load(f"{folder.rstrip('/')}/player_points_{version}")


def newest(spark: SparkSession, folder: str) -> str:
    """The version of the last model, by name, that `save` wrote to the folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/player_points_*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise FileNotFoundError(f"no model in {folder}")
    return max(f.getPath().getName() for f in found).removeprefix("player_points_")


def importance(spark: SparkSession, model: PipelineModel, features: list[str] = FEATURES) -> DataFrame:
    """Share of each feature in the trees' gains: a handful of rows."""
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray())], "feature string, importance double")
