"""Numeric and categorical columns as one feature vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    FeatureHasher,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import DataFrame

def fit_tabular(
    df: DataFrame,
    num: Sequence[str],
    cat: Sequence[str],
    hashed: Sequence[str] = (),
    hashed_dims: int = 1 << 12,
) -> PipelineModel:
    """Pipeline that adds ``features``: scaled numbers, then one-hot categories in order of
    frequency, then the columns named in ``hashed``, hashed together into ``hashed_dims``.

    The encoding is the caller's choice and never the data's: the same call gives the same
    kind of features at any size. One-hot columns bring their categories to the driver, so
    name a column with very many of them in ``hashed`` and not in ``cat``.
    """
    small, large = list(cat), list(hashed)
    stages, parts = [], []
    if num:
        stages += [
            VectorAssembler(inputCols=list(num), outputCol="_num", handleInvalid="keep"),
            StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True),
        ]
        parts.append("_scaled")
    if small:
        stages += [
            StringIndexer(
                inputCols=small, outputCols=[f"_i_{c}" for c in small], handleInvalid="keep"
            ),
            OneHotEncoder(
                inputCols=[f"_i_{c}" for c in small],
                outputCols=[f"_h_{c}" for c in small],
                dropLast=True,
            ),
        ]
        parts += [f"_h_{c}" for c in small]
    if large:
        stages.append(
            FeatureHasher(
                inputCols=large, outputCol="_hashed", numFeatures=hashed_dims, categoricalCols=large
            )
        )
        parts.append("_hashed")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df)


def tabular_vector(
    df: DataFrame, num: Sequence[str], cat: Sequence[str], hashed: Sequence[str] = ()
) -> DataFrame:
    """Fit on ``df`` and add ``features`` to it."""
    made = fit_tabular(df, num, cat, hashed).transform(df)
    return made.select(*df.columns, "features")
