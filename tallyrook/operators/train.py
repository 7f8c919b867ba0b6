"""A classifier of built-in estimators, the substitute for a fine-tuned network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.operators.prep import class_weights, kept, released

SOURCE = "ml-substitute"


def fit(train: DataFrame, column: str = "func_before", label: str = "vul", features: int = 1 << 14, iterations: int = 20) -> PipelineModel:
    """The texts are split and counted once; the two fits read the counts."""
    weighted = train.join(F.broadcast(class_weights(train, label)), label)  # two rows
    tokens = RegexTokenizer(inputCol=column, outputCol="words", pattern=r"\W+")
    hashed = HashingTF(inputCol="words", outputCol="counts", numFeatures=features)
    counts = kept(hashed.transform(tokens.transform(weighted)).select(label, "weight", "counts"), "word-counts")
    idf = IDF(inputCol="counts", outputCol="features", minDocFreq=2).fit(counts)
    model = LogisticRegression(labelCol=label, weightCol="weight", maxIter=iterations, regParam=0.01).fit(idf.transform(counts))
    released(counts)
    return PipelineModel([tokens, hashed, idf, model])


def save_if_better(model: PipelineModel, path: str, f1: float, best: float) -> float:
    """Writes the model if f1 is strictly larger; the best so far."""
    if f1 > best:
        model.write().overwrite().save(path)
        return f1
    return best


def scorer(model: PipelineModel, column: str = "func_before", key: str = "code_id", code: str = "code") -> Callable[[DataFrame], DataFrame]:
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df.select(key, F.col(code).alias(column)))
        p = vector_to_array("probability")[1]
        return out.select(key, (p > 0.5).cast("int").alias("label"), p.alias("probability"), F.lit(SOURCE).alias("model_source"))

    return score
