"""Deciding on candidate pairs: rules, labels, and a trained classifier with a tuned threshold."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweld.functions.similarity import FEATURES_B
from sparkweld.operators.score import Trees

NAME, VERY_STRONG, ADDRESS, WITH_POSTAL = 88, 95, 70, 85
NEGATIVES, HOLD_OUT = 25, 0.15
#: Rows of a task in training: at least ``FEW``, as a level of a tree is a job of its own, and no more than ``MANY`` by mere number of cores.
FEW, MANY = 20_000, 250_000
#: Thresholds that tuning tries: 0.05 to 0.97, and 0.20 to 0.94, in steps of 0.02.
GRID_FINE = tuple(round(0.05 + 0.02 * i, 2) for i in range(47))
GRID_COARSE = tuple(round(0.20 + 0.02 * i, 2) for i in range(38))


def rule(name: Column, address: Column, postal: Column) -> Column:
    """RULE-1 over the best name and address similarity and the postal flag."""
    return (name >= VERY_STRONG) | ((name >= NAME) & (address >= ADDRESS)) | ((name >= WITH_POSTAL) & (postal == 1))


def rule_matches(pairs: DataFrame) -> DataFrame:
    """Pairs with features that RULE-1 accepts."""
    best = lambda w: F.greatest(*(F.col(f"{w}_{s}") for s in ("lev", "tok", "char")))
    return pairs.where(rule(best("name"), best("address"), F.col("postal_match")))


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """JN-3: ``label`` 1 where the pair is true."""
    true = truth.select("s1_id", "ref_id").distinct().withColumn("label", F.lit(1))
    return pairs.join(true, ["s1_id", "ref_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def cap_negatives(pairs: DataFrame, n: int = NEGATIVES) -> DataFrame:
    """TOP-5: all positives and the first ``n`` others of each S1 record in candidate order (``pass_no, ord, ref_id``)."""
    w = Window.partitionBy("s1_id", "label").orderBy("pass_no", "ord", "ref_id")
    return pairs.withColumn("_n", F.row_number().over(w)).where((F.col("label") == 1) | (F.col("_n") <= n)).drop("_n")


def held_out(id_col: str = "s1_id", fraction: float = HOLD_OUT, seed: int = 42) -> Column:
    """ML-5: splits by S1 record, so that no record's pairs are on both sides."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10_000)) < int(fraction * 10_000)


def sample(df: DataFrame, n: int, id_col: str = "entity_id", seed: int = 42) -> DataFrame:
    """SMP-1: the ``n`` rows with the least hash of id and seed; the same rows on every run."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def first_records(s1: DataFrame, n: int) -> DataFrame:
    """LIM-1: the first ``n`` records by their order; of the leading rows of each task only, so none takes all."""
    return s1.orderBy("ord", "entity_id").limit(n)


def train(pairs: DataFrame, columns: tuple[str, ...] = FEATURES_B, trees: int = 40, depth: int = 5, step: float = 0.1, seed: int = 42, refit_on: DataFrame | None = None):
    """ML-1, ML-2: gradient-boosted trees over feature columns; positives weigh as much as negatives in total.

    ``refit_on``: fit on these pairs instead, once the threshold is tuned, with the same settings.
    """
    pairs = pairs if refit_on is None else refit_on
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    n = pairs.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    weight = (n.n - (n.p or 0)) / max(1, n.p or 0)
    parts = max(1, -(-n.n // MANY), min(pairs.sparkSession.sparkContext.defaultParallelism, -(-n.n // FEW)))
    rows = pairs.select("label", *columns).withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0)).repartition(parts)
    stages = [VectorAssembler(inputCols=list(columns), outputCol="features"), GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def probability(model, pairs: DataFrame) -> DataFrame:
    """ML-3: pairs with ``probability`` of a match."""
    from pyspark.ml.functions import vector_to_array

    drop = ("features", "rawPrediction", "prediction", "_v")
    return model.transform(pairs).withColumnRenamed("probability", "_v").withColumn("probability", vector_to_array("_v")[1]).drop(*drop)


def trees(model) -> Trees:
    """The trees of ``train`` for work in blocks."""
    columns, boosted = model.stages[0].getInputCols(), model.stages[-1]

    def nodes(tree) -> list[tuple]:
        out = []

        def add(node) -> int:
            at = len(out)
            out.append(())
            if node.subtreeDepth() == 0:
                out[at] = (-1, 0.0, at, at, node.prediction())
            else:
                split = node.split()
                out[at] = (split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild()), node.prediction())
            return at

        add(tree._call_java("rootNode"))
        return out

    return Trees(tuple(columns), [nodes(t) for t in boosted.trees], list(boosted.treeWeights))


def threshold_curve(scored: DataFrame, truth: DataFrame, ids: DataFrame, grid: tuple[float, ...] = GRID_FINE, score: str = "probability") -> DataFrame:
    """ML-4: macro F0.5 of ``scored(s1_id, ref_id, <score>, label)`` at each threshold over all ``ids(s1_id)``.

    Pairs are counted by the number of thresholds that they reach, and only these counts, at most one a threshold and S1
    record, are added up for the lower ones: no pair is repeated.
    """
    grid = tuple(sorted(grid))
    expected = ids.select("s1_id").distinct().join(truth.groupBy("s1_id").agg(F.countDistinct("ref_id").alias("t")), "s1_id", "left").select("s1_id", F.coalesce("t", F.lit(0)).alias("t"))
    steps = F.array(*(F.lit(float(g)) for g in grid))
    reached = F.size(F.filter(steps, lambda g: g <= F.col(score)))
    counts = scored.select("s1_id", "label", reached.alias("reached")).where("reached > 0").groupBy("s1_id", "reached").agg(F.count("*").alias("p"), F.sum("label").alias("tp"))
    counts = counts.select("s1_id", "p", "tp", F.explode(F.sequence(F.lit(1), F.col("reached"))).alias("at")).groupBy("s1_id", "at").agg(F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    every = expected.select("s1_id", "t", F.posexplode(steps).alias("at", "threshold")).withColumn("at", F.col("at") + 1).join(counts, ["s1_id", "at"], "left")
    p, tp, t = F.coalesce("p", F.lit(0)), F.coalesce("tp", F.lit(0)), F.col("t")
    low = 1.25 * tp + 0.25 * (t - tp) + (p - tp)
    f = F.when(low == 0, 1.0).otherwise(1.25 * tp / F.when(low == 0, 1.0).otherwise(low))
    return every.groupBy("threshold").agg(F.avg(f).alias("macro_f05"))


def curve(reached: DataFrame, grid: tuple[float, ...] = GRID_FINE) -> DataFrame:
    """ML-4 of ``reached(s1_id, t, p, tp)``, a row an S1 record with its pairs by threshold: as ``threshold_curve``."""
    steps = F.array(*(F.struct(F.lit(float(g)).alias("threshold"), F.col("p")[i].alias("p"), F.col("tp")[i].alias("tp")) for i, g in enumerate(sorted(grid))))
    x = reached.select("t", F.explode(steps).alias("x")).select("t", "x.*")
    low = 1.25 * F.col("tp") + 0.25 * (F.col("t") - F.col("tp")) + (F.col("p") - F.col("tp"))
    f = F.when(low == 0, 1.0).otherwise(1.25 * F.col("tp") / F.when(low == 0, 1.0).otherwise(low))
    return x.groupBy("threshold").agg(F.avg(f).alias("macro_f05"))


def best_threshold(curve: DataFrame) -> tuple[float, float]:
    """The first threshold with the greatest score; one row reaches the driver."""
    r = curve.orderBy(F.desc("macro_f05"), "threshold").first()
    return r.threshold, r.macro_f05


def save_model(model, threshold: float, path: str) -> None:
    """SNK-8."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(json.dumps({"threshold": threshold}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/threshold")


def load_model(spark, path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/threshold").first().value)["threshold"]
