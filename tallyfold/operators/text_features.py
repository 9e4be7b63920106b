"""Features of scripts and other text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import BASE64_LIKE, SYMBOL, TOKEN, URL, tokens, view_starts, view_text


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add length, token, symbol, URL and base64-like counts and the symbol ratio.
    Row by row, without a shuffle."""
    t = F.col(text)
    length = F.length(t).cast("bigint")

    def count(pattern: str):
        return F.regexp_count(t, F.lit(pattern)).cast("bigint")

    return df.select(
        "*",
        length.alias("n_length"),
        count(TOKEN).alias("n_tokens"),
        count(SYMBOL).alias("n_symbols"),
        count(URL).alias("n_urls"),
        count(BASE64_LIKE).alias("n_base64"),
    ).withColumn("symbol_ratio", F.try_divide(F.col("n_symbols"), F.col("n_length")))


def char_entropy(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, n_chars, n_distinct, entropy) in bits per character.

    Each text is counted where it is read, without a row per character and without a
    shuffle. A null or empty text has no row.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column(1):
                codes = np.frombuffer(t.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
                n = np.unique(codes, return_counts=True)[1]
                made.append((len(codes), len(n), float(np.log2(len(codes)) - (n * np.log2(n)).sum() / len(codes))))
            n_chars, n_distinct, entropy = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: batch.column(0),
                    "n_chars": pa.array(n_chars, pa.int64()),
                    "n_distinct": pa.array(n_distinct, pa.int64()),
                    "entropy": pa.array(entropy, pa.float64()),
                }
            )

    rows = df.filter(F.length(text) > 0).select(id_col, text)
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, n_chars bigint, n_distinct bigint, entropy double"
    )


def hashed_tokens(
    df: DataFrame, text: str = "text", dims: int = 1 << 18, name: str = "features"
) -> DataFrame:
    """Add a sparse vector of token counts. Hashing needs no vocabulary, so nothing
    is collected however many tokens there are."""
    hasher = HashingTF(inputCol="_tokens", outputCol=name, numFeatures=dims)
    return hasher.transform(df.withColumn("_tokens", tokens(F.col(text)))).drop("_tokens")


def windows(
    df: DataFrame, keep: Sequence[str], text: str = "text", n: int = 3
) -> DataFrame:
    """(keep.., view, view_text): n half-length windows with even starts. Each text
    gives n views, equal ones when it is short."""
    spans = df.select(
        *keep,
        F.col(text),
        F.posexplode(view_starts(F.length(text), n)).alias("view", "_start"),
    )
    return spans.select(
        *keep, "view", view_text(F.col(text), F.col("_start")).alias("view_text")
    )
