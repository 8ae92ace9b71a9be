"""Calibrated confidence: features of an answer, and models of whether it is right, by Spark's own ML stages."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.text import col, folded
from labelloom.operators.sides import stored

# What the closed fields count.
CONFIDENCE = {"high": 1.0, "medium": 0.5, "low": 0.0}
EVIDENCE = {"strong": 1.0, "moderate": 0.67, "weak": 0.33, "conflicting": 0.0}
FEATURES = ("f_confidence", "f_score", "f_retrieval", "f_evidence", "f_size", "f_mapped", "f_contradictions", "f_novel")


def _coded(c: str | Column, table: dict[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(folded(c) == k, v) if out is None else out.when(folded(c) == k, v)
    return out.otherwise(default)


def features(confidence: str, score: str, retrieval: str, evidence: str, n_cells: str, known_id: str, contradictions: str, novel: str) -> dict[str, Column]:
    """The eight features, each between 0 and 1."""
    zero = lambda c: F.coalesce(col(c).cast("double"), F.lit(0.0))
    size = F.log1p(F.least(zero(n_cells), F.lit(10_000.0))) / F.log1p(F.lit(10_000.0))
    values = (
        _coded(confidence, CONFIDENCE, 0.0), zero(score), zero(retrieval), _coded(evidence, EVIDENCE, 0.33), size,
        F.coalesce(col(known_id), F.lit("")).startswith("CL:").cast("double"), F.least(F.coalesce(F.size(contradictions), F.lit(0)), F.lit(10)) / 10.0, F.coalesce(col(novel), F.lit(False)).cast("double"),
    )
    return dict(zip(FEATURES, values, strict=True))


def isotonic_fit(rows: DataFrame, score: str, right: str, most: int = 1_024) -> DataFrame:
    """score and p: the rising step function nearest to whether rows are right (true, false; nulls count for nothing), at each score.

    By the min-max formula: p at a score is the greatest, over stretches that begin at or below it, of the least mean over
    their ends at or above it. Scores are counted first, and means come from running sums, so the plan has a row for each
    pair of scores; of more than `most` distinct scores, neighbours are put together: about `most` parts of equal
    size, each with its mean score.
    """
    known = rows.select(F.col(score).cast("double").alias("score"), F.col(right).cast("double").alias("y")).where("score is not null and y is not null")
    counted = stored(known.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "scores")
    if counted.count() > most:
        cuts = counted.agg(F.array_distinct(F.percentile_approx("score", F.array(*(F.lit(k / most) for k in range(1, most))), F.lit(10 * most))).alias("cuts"))
        part = counted.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("score"))))  # one row
        counted = stored(part.groupBy("part").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"), F.sum("n").alias("n"), F.sum("s").alias("s")).drop("part"), "scores")
    upto = Window.partitionBy(F.lit(0)).orderBy("score")  # `most` rows
    sums = counted.select("score", "n", "s", F.sum("n").over(upto).alias("_n"), F.sum("s").over(upto).alias("_s"))
    begins = sums.select(F.col("score").alias("a"), (F.col("_n") - F.col("n")).alias("_n0"), (F.col("_s") - F.col("s")).alias("_s0"))
    pairs = sums.join(F.broadcast(begins), F.col("a") <= F.col("score")).select("a", "score", ((F.col("_s") - F.col("_s0")) / (F.col("_n") - F.col("_n0"))).alias("mean"))
    least = F.min("mean").over(Window.partitionBy("a").orderBy(F.desc("score")))
    return pairs.select("score", least.alias("least")).groupBy("score").agg(F.max("least").alias("p"))


def interpolated(rows: DataFrame, fit: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    """rows with the fitted chance of their score, between two known scores on the line between them, rounded; null without a fit.

    fit is one array in one row: a score's place in it is found by counting the smaller ones.
    """
    table = fit.agg(F.array_sort(F.collect_list(F.struct("score", "p"))).alias("_fit"))
    met, s = rows.crossJoin(F.broadcast(table)), F.coalesce(F.col(score).cast("double"), F.lit(0.0))  # one row
    low = lambda t: F.element_at(F.filter(t, lambda x: x["score"] <= s), -1)
    met = met.withColumn("_low", F.when(F.exists("_fit", lambda x: x["score"] <= s), low("_fit"))).withColumn("_high", F.get(F.filter("_fit", lambda x: x["score"] >= s), F.lit(0)))
    share = F.try_divide(s - F.col("_low.score"), F.col("_high.score") - F.col("_low.score"))
    p = F.coalesce(F.col("_low.p") + (F.col("_high.p") - F.col("_low.p")) * F.coalesce(share, F.lit(0.0)), F.col("_low.p"), F.col("_high.p"))
    return met.withColumn(name, F.round(p, 4)).select(*rows.columns, name)


class Calibrator:
    """The chance that an answer is right: logistic over the scaled features with balanced classes, or isotonic over the score."""

    def __init__(self, method: str = "logistic", columns: tuple[str, ...] = FEATURES, score: str = "f_score") -> None:
        if method not in ("logistic", "isotonic"):
            raise ValueError(f"no such method: {method}")
        self.method, self.columns, self.score, self.model = method, columns, score, None

    def fit(self, rows: DataFrame, right: str) -> Calibrator:
        rows = rows.withColumn("label", F.col(right).cast("double")).where("label is not null")
        if self.method == "isotonic":
            self.model = Pipeline(stages=[IsotonicRegression(featuresCol=self.score, labelCol="label", predictionCol="p")]).fit(rows)
            return self
        n, ones = rows.agg(F.count("*"), F.sum("label")).first()
        weight = F.when(F.col("label") == 1, n / (2 * max(ones or 0, 1))).otherwise(n / (2 * max(n - (ones or 0), 1)))
        stages = [
            VectorAssembler(inputCols=list(self.columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True),
            LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=1.0 / max(n, 1), maxIter=200, probabilityCol="prob"),
        ]
        self.model = Pipeline(stages=stages).fit(rows.withColumn("w", weight))
        return self

    def calibrated(self, rows: DataFrame, name: str = "calibrated") -> DataFrame:
        """rows with the chance, rounded and between 0 and 1; the raw score while there is no model."""
        if self.model is None:
            return rows.withColumn(name, F.col(self.score))
        out = self.model.transform(rows)
        p = F.col("p") if self.method == "isotonic" else vector_to_array("prob")[1]
        return out.withColumn(name, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), 4)).select(*rows.columns, name)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> Calibrator:
        self.model = PipelineModel.load(path)
        return self
