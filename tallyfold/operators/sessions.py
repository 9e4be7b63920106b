"""Sessions of a log, and how surprising their order of events is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.skew import lookup_join, previous_values, running_sums

#: State before a session's first event.
START = "^"


def with_sessions(
    df: DataFrame, entity: str, kind: str, gap: str, ts: str = "ts", id_col: str = "event_id", parts: int | None = None
) -> DataFrame:
    """(entity, id, ts, kind, before, session): events of an entity, numbered by session from
    1 on. A session ends where the next event comes more than ``gap`` later. ``before`` is the
    kind of the event before in the session, START for the first; a null kind is one of its
    own (''). Events without entity or time are left out. No task holds an entity's events.
    """
    rows = df.select(
        entity, id_col, ts, F.coalesce(F.col(kind).cast("string"), F.lit("")).alias(kind)
    ).filter(F.col(entity).isNotNull() & F.col(ts).isNotNull())
    seen = previous_values(rows, [entity], [ts, id_col], {"_ts": ts, "_kind": kind}, parts)
    starts = F.col("_ts").isNull() | (F.col(ts) > F.col("_ts") + F.expr(f"interval {gap}"))
    marked = seen.withColumn("_starts", starts.cast("bigint"))
    numbered = running_sums(marked, [entity], [ts, id_col], {"session": F.col("_starts")}, parts)
    before = F.when(F.col("_starts") == 1, F.lit(START)).otherwise(F.col("_kind"))
    return numbered.select(entity, id_col, ts, kind, before.alias("before"), "session")


def session_surprise(
    df: DataFrame, entity: str, kind: str, gap: str, ts: str = "ts", id_col: str = "event_id", parts: int | None = None
) -> DataFrame:
    """(entity, session, started, ended, n_events, surprise): mean of -ln P(kind | kind before)
    over a session's events, by the transitions of all sessions, each counted once more."""
    events = with_sessions(df, entity, kind, gap, ts, id_col, parts)
    pairs = events.groupBy("before", kind).agg(F.count(F.lit(1)).alias("n"))
    out_of = pairs.groupBy("before").agg(F.sum("n").alias("total"))
    kinds = events.agg(F.countDistinct(kind)).first()[0]
    model = pairs.join(out_of, "before").select(
        "before",
        kind,
        F.col("n").alias("n_rows"),
        (-F.log((F.col("n") + 1) / (F.col("total") + kinds))).alias("_bits"),
    )
    scored = lookup_join(events, model, ["before", kind], [id_col])
    return scored.groupBy(entity, "session").agg(
        F.min(ts).alias("started"),
        F.max(ts).alias("ended"),
        F.count(F.lit(1)).alias("n_events"),
        F.avg("_bits").alias("surprise"),
    )
