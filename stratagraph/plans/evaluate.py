"""How good embeddings are: label prediction and clustering."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import uniform
from ..storage import cut


def split(rows: DataFrame, run: int, test_share: float, seed: int = 123) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows by a hash of the node and the run."""
    draw = uniform(seed, F.lit(run), F.col("node_id"))
    return rows.filter(draw >= test_share), rows.filter(draw < test_share)


def top_labels(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, label) of scores (id, label, score): each row's k best labels, k (id, k) being its number of true ones; ties to the
    smaller label."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), "label")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked.join(wanted, "id").filter(F.col("rank") <= F.col("k")).select("id", "label")


def f1_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row (micro, macro, weighted, samples) from pairs (id, label)."""
    both = truth.select("id", "label", F.lit(1).alias("t"), F.lit(0).alias("p")).union(predicted.select("id", "label", F.lit(0), F.lit(1)))
    cells = both.groupBy("id", "label").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    counts = [F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn")]
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    by_label = cells.groupBy("label").agg(*counts).withColumn("f1", f1)
    labels = by_label.agg((2.0 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))).alias("micro"), F.avg("f1").alias("macro"), (F.sum(F.col("f1") * (F.col("tp") + F.col("fn"))) / F.sum(F.col("tp") + F.col("fn"))).alias("weighted"))
    by_row = cells.groupBy("id").agg(*counts).withColumn("f1", f1).agg(F.avg("f1").alias("samples"))
    return labels.crossJoin(by_row)  # one row each


def multilabel(embeddings: DataFrame, truth: DataFrame, config: Config) -> DataFrame:
    """Mean F1 over hash splits: one logistic regression for each label, then as many best labels as a row has true ones.

    embeddings (node_id, vec), truth (node_id, y array<int> of 0 and 1)."""
    rows = cut(embeddings.join(truth, "node_id").select("node_id", array_to_vector("vec").alias("features"), "y"), "labelled")
    n_labels = rows.agg(F.max(F.size("y"))).first()[0] or 0
    out = None
    for run in range(config.runs):
        train, test = split(rows, run, config.test_share, config.seed)
        scores = None
        for j in range(n_labels):
            own = train.select("features", F.get("y", F.lit(j)).cast("double").alias("label"))
            kinds = {r.label for r in own.select("label").distinct().collect()}
            if kinds == {0.0, 1.0}:
                model = LogisticRegression(maxIter=50).fit(own)
                found = model.transform(test.select("node_id", "features")).select(F.col("node_id").alias("id"), F.lit(j).alias("label"), vector_to_array("probability")[1].alias("score"))
            else:
                found = test.select(F.col("node_id").alias("id"), F.lit(j).alias("label"), F.lit(1.0 if 1.0 in kinds else 0.0).alias("score"))
            scores = found if scores is None else scores.union(found)
        true = test.select(F.col("node_id").alias("id"), F.posexplode("y").alias("label", "on")).filter("on = 1").select("id", "label")
        wanted = true.groupBy("id").agg(F.count("*").alias("k"))
        result = f1_scores(true, top_labels(scores, wanted)).withColumn("run", F.lit(run))
        out = result if out is None else out.union(result)
    return out.agg(*[F.avg(c).alias(c) for c in ("micro", "macro", "weighted", "samples")])


def one_class(embeddings: DataFrame, truth: DataFrame, config: Config) -> DataFrame:
    """Mean (accuracy, f1, weighted precision and recall) of a multinomial model of the first largest label of each row."""
    label = F.array_position("y", F.array_max("y")) - 1
    rows = cut(embeddings.join(truth, "node_id").select("node_id", array_to_vector("vec").alias("features"), label.cast("double").alias("label")), "labelled")
    names = {"accuracy": "accuracy", "f1": "f1", "precision": "weightedPrecision", "recall": "weightedRecall"}
    found = []
    for run in range(config.runs):
        train, test = split(rows, run, config.test_share, config.seed)
        predicted = LogisticRegression(maxIter=50, family="multinomial").fit(train).transform(test)
        found.append(tuple(float(MulticlassClassificationEvaluator(metricName=m).evaluate(predicted)) for m in names.values()))
    spark = embeddings.sparkSession
    return spark.createDataFrame(found, [*names]).agg(*[F.avg(c).alias(c) for c in names])


def agreement(pairs: DataFrame) -> DataFrame:
    """One row (ari, fms): adjusted Rand index and Fowlkes-Mallows score of (truth, predicted), from the contingency table."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cells = pairs.groupBy("truth", "predicted").agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("total"))
    a = cells.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("a"))
    b = cells.groupBy("predicted").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("b"))
    row = both.crossJoin(a).crossJoin(b)  # one row each
    expected = F.col("a") * F.col("b") / two("total")
    ari = F.when((F.col("a") + F.col("b")) / 2 == expected, 1.0).otherwise((F.col("s") - expected) / ((F.col("a") + F.col("b")) / 2 - expected))
    return row.select(ari.alias("ari"), F.when(F.col("a") * F.col("b") > 0, F.col("s") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0).alias("fms"))


def clustering(embeddings: DataFrame, truth: DataFrame, k: int, seed: int = 123) -> DataFrame:
    """(ari, fms) of k-means clusters against labels (node_id, label)."""
    rows = cut(embeddings.select("node_id", array_to_vector("vec").alias("features")), "clustered")
    found = KMeans(k=k, seed=seed).fit(rows).transform(rows).select("node_id", F.col("prediction").alias("predicted"))
    return agreement(found.join(truth, "node_id").select(F.col("label").alias("truth"), "predicted"))


def summary(config: Config, metrics: DataFrame, level: int, seconds: float) -> DataFrame:
    """One row: what was run, its scores to three places, and its time."""
    scores = [F.format_string("%.3f", c).alias(c) for c in metrics.columns]
    return metrics.select(F.lit(config.data).alias("data"), F.lit(config.base).alias("base"), F.lit(config.refine).alias("refine"), F.lit(level).alias("level"), *scores, F.lit(round(seconds, 3)).alias("seconds"))
