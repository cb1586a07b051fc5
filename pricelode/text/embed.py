"""Unit vectors for texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384


def fit_tfidf(texts: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> PipelineModel:
    """Hashed TF-IDF; fitting is one pass that keeps ``dimensions`` counters."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ]).fit(texts)


def tfidf_embed(texts: DataFrame, model: PipelineModel) -> DataFrame:
    """``texts`` with ``embedding``, an array of floats of length one (zeros for a text without words)."""
    return model.transform(texts).withColumn("embedding", vector_to_array("_unit", "float32")) \
        .drop("_words", "_tf", "_idf", "_unit")


def model_embed(
    texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", batch: int = 64,
) -> DataFrame:
    """Embeddings from any encoder; ``load`` runs once per task and returns the encoder."""
    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for part in parts:
            vectors = [
                v for i in range(0, len(part), batch)
                for v in np.asarray(encoder(part.iloc[i:i + batch].tolist()), dtype=np.float32)
            ]
            norms = [float(np.linalg.norm(v)) or 1.0 for v in vectors]
            yield pd.Series([v / n for v, n in zip(vectors, norms)], index=part.index)

    return texts.withColumn("embedding", encode(F.col(text)))
