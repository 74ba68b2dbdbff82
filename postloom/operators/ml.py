"""Models on Spark ML and on aggregated sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pattern_model(rows: DataFrame, patterns: list[str], text: str, label: str, regularisation: float = 0.01):
    """Class-balanced logistic regression on pattern hits; the fitted pipeline, or the share of label 1 where labels are of one kind (None: no labels)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    featured = pattern_features(rows.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), patterns, text)
    share = featured.agg(F.avg(label).alias("p")).first().p
    if share is None or share in (0.0, 1.0):
        return share
    weighted = featured.withColumn("_w", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    stages = [VectorAssembler(inputCols=[f"_p{i}" for i in range(len(patterns))], outputCol="features"), LogisticRegression(labelCol=label, weightCol="_w", regParam=regularisation, maxIter=100, tol=1e-9)]
    return Pipeline(stages=stages).fit(weighted)


def pattern_scores(rows: DataFrame, model, patterns: list[str], text: str) -> DataFrame:
    """The rows with the model's probability of label 1 as ``score``; a null text hits no pattern."""
    from pyspark.ml.functions import vector_to_array

    if model is None or isinstance(model, float):
        return rows.withColumn("score", F.lit(model).cast("double"))
    return model.transform(pattern_features(rows, patterns, text)).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def pattern_features(rows: DataFrame, patterns: list[str], text: str) -> DataFrame:
    return rows.withColumns({f"_p{i}": F.coalesce(F.col(text).rlike(p), F.lit(False)).cast("double") for i, p in enumerate(patterns)})


def least_squares(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, R2 and RMSE of a line, from sums."""
    fit = rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("syy"), F.regr_count(y, x).alias("n"))
    return fit.select("slope", "intercept", "r2", F.sqrt(F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(0.0)) / F.col("n")).alias("rmse"))


def score_batches(rows: DataFrame, key: str, text: str, load: Callable[[], Callable[[pd.Series], pd.DataFrame]], classes: list[str]) -> DataFrame:
    """key and a score for each class from a model that each task loads once and applies to batches of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            scores = model(frame[text].fillna(""))
            yield pd.concat([frame[[key]].reset_index(drop=True), scores[classes].reset_index(drop=True)], axis=1)

    kinds = dict(rows.dtypes)
    return rows.select(key, text).mapInPandas(run, ", ".join([f"{key} {kinds[key]}", *(f"{c} double" for c in classes)]))


def train_classifier(rows: DataFrame, text: str, label: str, key: str, *, features: int = 1 << 14, strengths: tuple[float, ...] = (0.3, 0.1, 0.03, 0.01), patience: int = 1):
    """A text classifier on hashed words; regularisation is loosened until the area under the ROC curve on a held-out fifth stops growing.

    Returns the best model and its area. The fifth is drawn by a hash of the key.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    fold = F.pmod(F.xxhash64(key), F.lit(5))
    known = rows.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    training, held = known.filter(fold != 0), known.filter(fold == 0)
    best, area, worse = None, 0.0, 0
    for strength in strengths:
        model = Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="_t", pattern=r"\s+"), HashingTF(inputCol="_t", outputCol="features", numFeatures=features, binary=True), LogisticRegression(labelCol=label, regParam=strength, maxIter=20)]).fit(training)
        now = BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(held))
        if best is None or now > area:
            best, area, worse = model, now, 0
        elif (worse := worse + 1) > patience:
            break
    return best, area
