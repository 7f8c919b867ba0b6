"""Layer 3: probabilities from logits, and where the logits come from.

A scorer maps (code_id, code) to (code_id, label, probability, model_source).
`table_scorer` joins logits made elsewhere; `onnx_scorer` runs a model file in
Arrow batches; `ml_scorer` applies a fitted pipeline of built-in estimators, a
substitute for a fine-tuned network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrook.operators.prep import numbered, seeded

MAX_LENGTH = 512


def probability(l0: Column, l1: Column) -> Column:
    """Class-1 share of the softmax of two logits, shifted by the larger."""
    m = F.greatest(l0, l1)
    return F.exp(l1 - m) / (F.exp(l0 - m) + F.exp(l1 - m))


def label(l0: Column, l1: Column) -> Column:
    """The larger logit's index; the first at a tie."""
    return (l1 > l0).cast("int")


def padded(ids: Column, pad_id: int, length: int = MAX_LENGTH) -> tuple[Column, Column]:
    """Ids cut or padded to `length`, and the attention mask."""
    cut = F.slice(ids, 1, length)
    n = F.size(cut)
    return F.concat(cut, F.array_repeat(F.lit(pad_id), F.lit(length) - n)), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def from_logits(logits: DataFrame, source: str, key: str = "code_id") -> DataFrame:
    l0, l1 = F.col("logit0").cast("double"), F.col("logit1").cast("double")
    return logits.select(key, label(l0, l1).alias("label"), probability(l0, l1).alias("probability"), F.lit(source).alias("model_source"))


def table_scorer(logits: DataFrame, source: str = "table", key: str = "code_id") -> Callable[[DataFrame], DataFrame]:
    return lambda code: from_logits(code.select(key).join(logits, key), source, key)


@lru_cache(maxsize=2)
def _encoder(tokenizer: str):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer)
    encoder.enable_truncation(MAX_LENGTH)
    return encoder


@lru_cache(maxsize=2)
def _session(model: str, tokenizer: str):
    """One session and one tokenizer per worker process."""
    import onnxruntime

    return onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"]), _encoder(tokenizer)


def encoded(df: DataFrame, tokenizer: str, column: str = "func_before", label: str = "vul", pad_id: int = 1) -> DataFrame:
    """`df` with input_ids and attention_mask, cut or padded to MAX_LENGTH, and
    labels; a null text is empty."""

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([e.ids for e in _encoder(tokenizer).encode_batch(texts.fillna("").tolist())])

    made = F.pandas_udf(ids, "array<int>").asNondeterministic()
    rows = df.withColumn("__ids", made(F.col(column)))
    cut, mask = padded(F.col("__ids"), pad_id)
    return rows.withColumns({"input_ids": cut, "attention_mask": mask, "labels": F.col(label).cast("long")}).drop("__ids")


def batches(df: DataFrame, key: str, size: int = 16, seed: int = 42) -> DataFrame:
    """`df` with batch: shuffled rows, numbered over all, `size` in each batch
    but the last."""
    rows = numbered(df.withColumn("__all", F.lit(0)), "__all", seeded(seed, F.col(key)))
    return rows.withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("__all", "rank")


def onnx_scorer(model: str, tokenizer: str, pad_id: int = 1, key: str = "code_id", column: str = "code") -> Callable[[DataFrame], DataFrame]:
    """Scores with onnxruntime on the CPU: inputs input_ids and attention_mask,
    output logits; batches are padded to their longest row.  Missing files are
    an error, never random scores."""
    for path in (model, tokenizer):
        if not Path(path).is_file():
            raise FileNotFoundError(f"the scorer needs {path}")

    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        session, encoder = _session(model, tokenizer)
        for texts in batches:
            rows = [e.ids for e in encoder.encode_batch(texts.fillna("").tolist())]
            width = max((len(r) for r in rows), default=1)
            ids = np.array([r + [pad_id] * (width - len(r)) for r in rows], np.int64)
            mask = np.array([[1] * len(r) + [0] * (width - len(r)) for r in rows], np.int64)
            out = session.run(["logits"], {"input_ids": ids, "attention_mask": mask})[0]
            yield pd.DataFrame({"logit0": out[:, 0].astype(float), "logit1": out[:, 1].astype(float)})

    score = F.pandas_udf(logits, "logit0 double, logit1 double")
    return lambda code: from_logits(code.select(key, score(column).alias("l")).select(key, "l.*"), f"onnx:{Path(model).name}", key)


def resolve(onnx: str, checkpoint: str, tokenizer: str) -> Callable[[DataFrame], DataFrame]:
    """The model file if it is there, else the pipeline saved in `checkpoint`;
    neither is an error, never a model without training."""
    if Path(onnx).is_file():
        return onnx_scorer(onnx, tokenizer)
    if not Path(checkpoint, "metadata").is_dir():
        raise FileNotFoundError(f"neither {onnx} nor a model in {checkpoint}")
    from pyspark.ml import PipelineModel

    from tallyrook.operators import train

    return train.scorer(PipelineModel.load(checkpoint))
