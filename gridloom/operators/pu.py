"""Learning from positive and unlabelled rows: a classifier of labelled against not, corrected by its rate on held-out positives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class PuModel:
    """g, the labelling model; c, its mean on held-out positives; prior, the share of positives; f, the refitted model."""

    g: PipelineModel
    c: float
    prior: float
    f: PipelineModel

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        return self.f.transform(rows).withColumn("probability_positive", vector_to_array("probability")[1]).drop("raw", "probability", "prediction", "assembled", "scaled")


def _model(features: list[str], label: str, weight: str | None = None) -> Pipeline:
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, rawPredictionCol="raw", regParam=1e-4, maxIter=50)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="assembled"), StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True), lr])


def fit(rows: DataFrame, features: list[str], label: str = "s", hold_out: float = 0.2, seed: int = 7) -> PuModel:
    """rows: features and s, 1 where labelled positive, 0 where unlabelled. A keyed hash holds out positives."""
    share = F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(10_000)) / 10_000
    rows = rows.withColumn("_held", (F.col(label) == 1) & (share < hold_out)).withColumn("_s", F.col(label).cast("double"))
    g = _model(features, "_s").fit(rows.where("NOT _held"))
    score = lambda df: g.transform(df).withColumn("_g", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), vector_to_array("probability")[1]))).drop("raw", "probability", "prediction", "assembled", "scaled")
    scored = score(rows)
    stats = scored.agg(F.avg(F.when(F.col("_held"), F.col("_g"))).alias("c"), F.avg("_g").alias("m")).first()
    c = min(1.0, max(1e-6, stats["c"] or 1.0))
    prior = min(1.0, stats["m"] / c)
    # an unlabelled row counts as positive with weight w and as negative with 1 - w
    w = F.least(F.lit(1.0), (1 - c) / c * F.col("_g") / (1 - F.col("_g")))
    weights = F.when(F.col("_s") == 1, F.array(F.struct(F.lit(1.0).alias("y"), F.lit(1.0).alias("w")))).otherwise(F.array(F.struct(F.lit(1.0).alias("y"), w.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - w).alias("w"))))
    long = scored.select(*features, F.explode(weights).alias("e")).select(*features, F.col("e.y").alias("_y"), F.col("e.w").alias("_w")).where("_w > 0")
    return PuModel(g, c, prior, _model(features, "_y", "_w").fit(long))
