"""Page types: a random forest over signal vectors, with a confidence below which a page has no type."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CONFIDENCE, UNCATEGORIZED


def training_rows(seeds: DataFrame, vectors: DataFrame) -> DataFrame:
    """``id, vec, type, weight``: pages with one label only, classes balanced by weight."""
    single = seeds.distinct().groupBy("id").agg(F.count("*").alias("n"), F.min("type").alias("type")).where("n = 1").drop("n")
    rows = vectors.select("id", "vec").join(single, "id")
    per_class = rows.groupBy("type").agg(F.count("*").alias("n_class"))
    totals = per_class.agg(F.sum("n_class").alias("n"), F.count("*").alias("k"))
    weights = per_class.join(F.broadcast(totals)).select("type", (F.col("n") / (F.col("k") * F.col("n_class"))).alias("weight"))  # one row
    return rows.join(weights, "type")


def fit_types(rows: DataFrame, trees: int = 300, seed: int = 42) -> PipelineModel:
    ready = rows.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))
    labels = StringIndexer(inputCol="type", outputCol="label", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(numTrees=trees, weightCol="weight", seed=seed)
    names = labels.fit(ready)
    return PipelineModel([names, forest.fit(names.transform(ready)), IndexToString(inputCol="prediction", outputCol="best", labels=names.labels)])


def assign_types(vectors: DataFrame, model: PipelineModel, threshold: float = CONFIDENCE) -> DataFrame:
    """``id, page_type, confidence``."""
    ready = vectors.withColumn("features", array_to_vector(F.col("vec").cast("array<double>"))).withColumn("type", F.lit(model.stages[0].labels[0]))
    scored = model.transform(ready).withColumn("confidence", F.array_max(vector_to_array("probability")))
    return scored.select("id", F.when(F.col("confidence") >= threshold, F.col("best")).otherwise(UNCATEGORIZED).alias("page_type"), "confidence")


def cross_validate(rows: DataFrame, folds: int = 5, trees: int = 50) -> DataFrame:
    """``type, page_type, n`` of predictions on held-out folds, stratified by class."""
    dealt = rows.withColumn("fold", (F.row_number().over(W.partitionBy("type").orderBy(F.xxhash64("id"), "id")) % folds)).cache()
    parts = []
    for k in range(folds):
        model = fit_types(dealt.where(F.col("fold") != k), trees)
        held = dealt.where(F.col("fold") == k)
        parts.append(assign_types(held, model, 0.0).join(held.select("id", "type"), "id").select("type", "page_type"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("type", "page_type").agg(F.count("*").alias("n"))


def class_features(rows: DataFrame, importances: list[float], top: int = 5) -> DataFrame:
    """Per class the fields whose mean, relative to the corpus and times importance, is largest."""
    each = rows.select("type", F.posexplode("vec").alias("pos", "value"))
    means = each.groupBy("type", "pos").agg(F.avg("value").alias("mean")).join(each.groupBy("pos").agg(F.avg("value").alias("all")), "pos")
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in importances)), F.col("pos") + 1)
    scored = means.withColumn("score", F.coalesce(F.try_divide("mean", "all"), F.lit(0.0)) * weight)
    return scored.withColumn("n", F.row_number().over(W.partitionBy("type").orderBy(F.desc("score"), "pos"))).where(F.col("n") <= top).drop("n")


def cluster_pages(vectors: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """``id, cluster, x, y``: bisecting k-means on unit vectors, and their first two principal components."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA, Normalizer

    ready = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("raw"))
    steps = Pipeline(stages=[Normalizer(inputCol="raw", outputCol="features"), BisectingKMeans(k=k, seed=seed, predictionCol="cluster"), PCA(k=2, inputCol="features", outputCol="plane")])
    out = steps.fit(ready).transform(ready).withColumn("p", vector_to_array("plane"))
    return out.select("id", "cluster", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
