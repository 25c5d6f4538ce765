"""Boosted trees with Platt calibration, by Spark's own learners."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import analytics as A


@dataclass
class Boosted:
    """A fitted pair: trees that give a margin, and a logistic curve from margins to probabilities."""

    features: list[str]
    trees: GBTClassificationModel
    curve: LogisticRegressionModel

    def score(self, df: DataFrame) -> DataFrame:
        """df with `risk`, the calibrated probability; missing features count as 0, no row is left out."""
        margin = F.element_at(_array("rawPrediction"), 2)
        raw = self.trees.transform(_vectors(df, self.features)).withColumn("_m", margin)
        z = F.lit(float(self.curve.coefficients[0])) * F.col("_m") + F.lit(float(self.curve.intercept))
        return raw.select(*df.columns, (1 / (1 + F.exp(-z))).alias("risk"))

    def save(self, path: str) -> None:
        """Both models under one shared folder."""
        PipelineModel([self.trees, self.curve]).write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, features: list[str]) -> Boosted:
        trees, curve = PipelineModel.load(path).stages
        return cls(features, trees, curve)


def _array(c: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(c))


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    filled = df.withColumns({f"_f{i}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate(features)})
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_x").transform(filled)


def fit(train: DataFrame, held: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 4, seed: int = 42) -> Boosted:
    """Trees from `train`, rows weighted so that both classes count the same, then the curve from `held`.  Trees see binned features only."""
    share = train.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    if not share or share == 1.0:
        raise ValueError("training rows hold one class only")
    weight = F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    x = _vectors(train, features).withColumns({"_w": weight, "_y": F.col(label).cast("double")})
    trees = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=depth, seed=seed).fit(x)
    margins = trees.transform(_vectors(held, features)).select(F.col(label).cast("double").alias("_y"), F.element_at(_array("rawPrediction"), 2).alias("_m"))
    return Boosted(features, trees, LogisticRegression(featuresCol="_c", labelCol="_y").fit(VectorAssembler(inputCols=["_m"], outputCol="_c").transform(margins)))


def evaluate(scored: DataFrame, label: str, score: str = "risk") -> DataFrame:
    """One row: area under the ROC curve, average precision, Brier score, the best threshold with its sensitivity and specificity."""
    best = A.youden(scored, label, score)
    brier = scored.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))
    one = A.auc(scored, label, score).crossJoin(A.pr_auc(scored, label, score)).crossJoin(brier).crossJoin(best)  # one row each
    y, p = F.col(label), F.col(score) >= F.col("threshold")
    at = scored.crossJoin(F.broadcast(best.select("threshold"))).agg((F.count_if(p & (y == 1)) / F.count_if(y == 1)).alias("sensitivity"), (F.count_if(~p & (y == 0)) / F.count_if(y == 0)).alias("specificity"))
    return one.crossJoin(at)
