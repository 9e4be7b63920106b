"""The shared folder in which intermediate tables are written."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names, or else below the
    warehouse. Never a folder of one machine's own: executors must see it as well.

    All paths of a session lie in one folder, ``<base>/tallyfold/<application id>``, which
    can be deleted once the session has ended.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tallyfold/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    It is computed once, a lost executor does not bring its lineage back, and
    Catalyst knows the size of what it reads.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: dict[str, pa.DataType]) -> DataFrame:
    """A grid or list from the driver as a local relation, without Python tasks."""
    columns = list(zip(*rows)) or [()] * len(schema)
    data = {n: pa.array(c, t) for (n, t), c in zip(schema.items(), columns)}
    return spark.createDataFrame(pa.table(data))
