"""Version names as sortable values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: vA.B with an optional suffix.
VERSION = r"^v([0-9]+)\.([0-9]+)(?:_(.+))?$"


def version_key(version: Column) -> Column:
    """(major, minor, suffix): numbers compare as numbers, a suffix sorts after the
    bare version, ``original`` before every number. Null for any other name."""
    major = F.regexp_extract(version, VERSION, 1).try_cast("int")
    minor = F.regexp_extract(version, VERSION, 2).try_cast("int")
    suffix = F.regexp_extract(version, VERSION, 3)
    return F.when(
        version == "original",
        F.struct(
            F.lit(-1).alias("major"), F.lit(0).alias("minor"), F.lit("").alias("suffix")
        ),
    ).when(
        major.isNotNull(),
        F.struct(major.alias("major"), minor.alias("minor"), suffix.alias("suffix")),
    )
