"""Training and scoring of pair classifiers with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import FEATURES


def classifier(kind: str, **settings):
    """lr, rf or gbt with the settings that the published runs used, where Spark has
    them; settings overrides them. Trees grow by level here, so a leaf limit has no counterpart."""
    shared = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if kind == "lr":
        return LogisticRegression(**shared | {"maxIter": 1000, "regParam": 1e-4} | settings)
    if kind == "rf":
        return RandomForestClassifier(**shared | {"numTrees": 100, "maxDepth": 10, "seed": 42} | settings)
    champion = {"maxIter": 300, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20, "seed": 42}
    return GBTClassifier(**shared | champion | settings)


def train(features: DataFrame, kind: str, names: list[str] = FEATURES, balanced: bool = False, **settings) -> PipelineModel:
    """A model from rows with features and label; balanced weighs classes by their inverse share.

    The model is without the summary of its training, which holds the session: tasks
    that score would be sent it, and can't be once an Observation has been made in it."""
    d = features if "weight" in features.columns else features.withColumn("weight", F.lit(1.0))
    if balanced:
        n, pos = d.agg(F.count(F.lit(1)), F.sum("label")).first()
        d = d.withColumn("weight", F.when(F.col("label") == 1, n / (2.0 * max(1, pos or 0))).otherwise(n / (2.0 * max(1, n - (pos or 0)))))
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), classifier(kind, **settings)]).fit(d)
    if getattr(model.stages[-1], "hasSummary", False):
        model.stages[-1]._java_obj.setSummary(features.sparkSession._jvm.scala.Option.empty())
    return model


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    return model.transform(features).select("s1_id", "cand_id", F.round(vector_to_array("probability")[1], 6).alias("score"))


def importance(model: PipelineModel, names: list[str] = FEATURES) -> DataFrame:
    m = model.stages[-1]
    values = m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray())
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, importance double")


def hard_negatives(labelled: DataFrame, least: float = 0.3, n: int = 5) -> DataFrame:
    """The n most similar non-matches of each entity, by name_lev."""
    r = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("name_lev"), "cand_id"))
    return labelled.where((F.col("label") == 0) & (F.col("name_lev") >= least)).withColumn("r", r).where(F.col("r") <= n).drop("r")


def reweighted(features: DataFrame, scores: DataFrame, threshold: float = 0.5, weight: float = 5.0) -> DataFrame:
    """features with weight: non-matches that a model scores highly count more."""
    d = features.join(scores, ["s1_id", "cand_id"], "left")
    return d.withColumn("weight", F.when((F.col("label") == 0) & (F.col("score") >= threshold), F.lit(weight)).otherwise(F.lit(1.0))).drop("score")


# Strategies of hard-negative mining: queries without matches only, least out-of-fold score, weight (None: duplicated).
MINING = {
    "none": None,
    "singleton_30_w3": (True, 0.3, 3.0),
    "singleton_50_w5": (True, 0.5, 5.0),
    "all_50_w2": (False, 0.5, 2.0),
    "all_50_w3": (False, 0.5, 3.0),
    "singleton_30_twice": (True, 0.3, None),
    "all_50_twice": (False, 0.5, None),
}


def mined(features: DataFrame, scores: DataFrame, strategy: str) -> DataFrame:
    """features with weight by a strategy of MINING, from out-of-fold scores (s1_id, cand_id, score)."""
    rule = MINING[strategy]
    d = features.withColumn("weight", F.lit(1.0))
    if rule is None:
        return d
    alone, least, weight = rule
    d = d.join(scores.select("s1_id", "cand_id", "score"), ["s1_id", "cand_id"], "left")
    hard = (F.col("label") == 0) & (F.coalesce("score", F.lit(0.0)) >= least)
    if alone:
        matched = features.where("label = 1").select("s1_id").distinct().withColumn("m", F.lit(True))
        d = d.join(matched, "s1_id", "left")
        hard = hard & F.col("m").isNull()
    if weight is None:
        copies = F.when(hard, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return d.withColumn("copy", F.explode(copies)).drop("copy", "score", "m")
    return d.withColumn("weight", F.when(hard, F.lit(weight)).otherwise(F.lit(1.0))).drop("score", "m")


def out_of_fold(features: DataFrame, folds: DataFrame, kind: str = "lr", names: list[str] = FEATURES, k: int = 5) -> DataFrame:
    """Scores of every pair by a model that has not seen its entity."""
    d = features.join(folds.select(F.col("entity_id").alias("s1_id"), "fold"), "s1_id")
    out = None
    for i in range(k):
        s = score(train(d.where(F.col("fold") != i), kind, names), d.where(F.col("fold") == i))
        out = s if out is None else out.unionByName(s)
    return out


def compare(train_on: DataFrame, judge_on: DataFrame, truth: DataFrame, entities: DataFrame, kinds=("lr", "rf", "gbt"), names: list[str] = FEATURES, settings: dict | None = None) -> DataFrame:
    """(model, tau, precision, recall, f05): for every kind of model its best threshold on held-out pairs."""
    from .evaluation import best_threshold, tune

    out = None
    for kind in kinds:
        s = score(train(train_on, kind, names, **(settings or {}).get(kind, {})), judge_on)
        best = best_threshold(tune(s, truth, entities)).withColumn("model", F.lit(kind))
        out = best if out is None else out.unionByName(best)
    return out.select("model", "tau", "precision", "recall", "f05")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
