"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HELD_OUT = 2
FOLDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(key: Column) -> Column:
    """True for the rows whose crc32(key as text) mod 4 is 2; false for a null key."""
    rest = F.crc32(key.cast("string").cast("binary")) % FOLDS
    return F.coalesce(rest == HELD_OUT, F.lit(False))


def hash_share(key: Column, seed: str) -> Column:
    """A fixed number in [0, 1) for each key; null for a null key."""
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return F.when(key.isNotNull(), h)


def sample_by_class(rows: DataFrame, key: str, label: str, limit: int, seed: str) -> DataFrame:
    """About ``limit`` rows of each label (all, if it has fewer), chosen by a hash of the key.

    The labels must be few: their counts are brought together.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return (
        rows.join(F.broadcast(counts), label)
        .filter(hash_share(F.col(key), seed) * F.col("_n") < F.lit(limit))
        .drop("_n")
    )


def map_texts(
    df: DataFrame,
    text: str,
    schema: str,
    batch_of: Callable[[list[str | None]], dict[str, pa.Array]],
    piece_bytes: int = 4 << 20,
) -> DataFrame:
    """Replace the text column by what ``batch_of`` makes of lists of texts.

    Columns of the same names, in any case, are replaced as well: those of the operator count.
    ``batch_of`` returns the new columns, named in ``schema``. It gets texts of about
    ``piece_bytes`` at a time, so a batch of long texts doesn't add up in memory.
    """
    made_here = {name.lower() for name in StructType.fromDDL(schema).names}
    keep = [c for c in df.columns if c != text and c.lower() not in made_here]
    kept = df.select(*keep).schema
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            start = size = 0
            for i in range(batch.num_rows):
                size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
                if size < piece_bytes and i + 1 < batch.num_rows:
                    continue
                piece = batch.slice(start, i + 1 - start)
                made = batch_of(texts.slice(start, i + 1 - start).to_pylist())
                start, size = i + 1, 0
                columns = {c: piece.column(piece.schema.get_field_index(c)) for c in keep}
                yield pa.RecordBatch.from_pydict(columns | made)

    return df.select(*keep, text).mapInArrow(run, out)
