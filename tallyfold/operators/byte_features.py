"""Features of binary files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 256
BLOCK = 1 << 20


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits per byte of histograms along the last axis."""
    total = counts.sum(axis=-1, keepdims=True)
    share = counts / np.maximum(total, 1)
    return -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=-1)


def _describe(content: bytes) -> tuple:
    """(histogram, entropy, highest and mean window entropy), block by block so that
    the working memory does not grow with the file. The last window may be short."""
    hist = np.zeros(256, dtype="int64")
    top, total, n = 0.0, 0.0, 0
    for lo in range(0, len(content), BLOCK):
        data = np.frombuffer(content[lo : lo + BLOCK], dtype="uint8").astype("int64")
        parts = -(-len(data) // WINDOW)
        which = np.arange(len(data)) // WINDOW
        cells = np.bincount(which * 256 + data, minlength=parts * 256)
        cells = cells.reshape(parts, 256)
        hist += cells.sum(axis=0)
        found = _entropy(cells.astype("float64"))
        top, total, n = max(top, float(found.max())), total + float(found.sum()), n + parts
    return hist, float(_entropy(hist.astype("float64"))), top, total / max(n, 1)


def byte_features(files: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, size, sha256, histogram, entropy, max_window_entropy, mean_window_entropy).

    Size and hash are made in the JVM, histograms with numpy, one file at a time.
    """
    kind = dict(files.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [_describe(c) for c in batch["content"]]
            out = batch.drop(columns="content")
            names = ["histogram", "entropy", "max_window_entropy", "mean_window_entropy"]
            for i, name in enumerate(names):
                out[name] = [m[i] for m in made]
            yield out

    hashed = files.filter(F.col("content").isNotNull()).select(
        id_col,
        F.octet_length("content").cast("bigint").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        "content",
    )
    return hashed.mapInPandas(
        run,
        f"`{id_col}` {kind}, size bigint, sha256 string, histogram array<bigint>, "
        "entropy double, max_window_entropy double, mean_window_entropy double",
    )
