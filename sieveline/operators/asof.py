"""As-of joins, and element ids that are valid only in the generation that issued them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .usage import micros

#: Seconds of a piece of a key's time line.
PIECE_SECONDS = 3600


def as_of(rows: DataFrame, states: DataFrame, by: list[str], at: str, state_at: str, carry: list[str], *, strict: bool = False, piece_seconds: float = PIECE_SECONDS) -> DataFrame:
    """``rows`` with ``carry`` of the last row of ``states`` of the same key (``by``) whose
    ``state_at`` is at or before ``at`` (``strict``: before it); null where there is none.

    Both sides are cut into pieces of ``piece_seconds`` of their key, so that a key with
    most rows is spread over its pieces.  A piece gets the last state before it as a row of
    its own; these are found on one row for each piece alone.  Of several states at one
    time the greatest counts (by ``carry``).  Rows with a null key or time find none."""
    piece = lambda x: F.floor(x / F.lit(int(piece_seconds * 1_000_000))).cast("long")
    rank = 1 if strict else -1
    # one lineage for each side: rows travel as they are, states as what is carried
    left = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], micros(rows, at).alias("_us"), F.lit(0).alias("_rank"), F.lit(None).cast(_struct(states, carry)).alias("_state"), F.struct("*").alias("_row"))
    right = states.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], micros(states, state_at).alias("_us"), F.lit(rank).alias("_rank"), F.struct(*carry).alias("_state"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    right = right.where(F.col("_us").isNotNull())
    keys = [f"_k{i}" for i in range(len(by))]
    told = right.withColumn("_piece", piece(F.col("_us"))).groupBy(*keys, "_piece").agg(F.max(F.struct("_us", "_state")).alias("_last"))
    asked = left.where(F.col("_us").isNotNull()).select(*keys, piece(F.col("_us")).alias("_piece")).distinct().withColumn("_last", F.lit(None).cast(told.schema["_last"].dataType))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_piece").rangeBetween(Window.unboundedPreceding, -1))
    brought = told.unionByName(asked).withColumn("_before", before).where("_last is null and _before is not null")
    first = brought.select(*keys, "_piece", F.lit(None).cast("long").alias("_us"), F.lit(-2).alias("_rank"), F.col("_before._state").alias("_state"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    pieces = left.unionByName(right).withColumn("_piece", piece(F.col("_us"))).unionByName(first)
    last = F.last("_state", ignorenulls=True).over(Window.partitionBy(*keys, "_piece").orderBy(F.col("_us").asc_nulls_first(), "_rank", "_state").rowsBetween(Window.unboundedPreceding, 0))
    known = F.col("_us").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = pieces.withColumn("_found", F.when(known, last)).where("_row is not null")
    return out.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in carry])


def _struct(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType


def generations(captures: DataFrame, run: str, at: str) -> DataFrame:
    """(run, at, generation): the captures of a run, counted from 1 in the order of time; captures
    at one time are one."""
    from .vault_store import numbered

    return numbered(captures.select(run, at).distinct(), [run], [at]).withColumnRenamed("number", "generation")


def valid_actions(actions: DataFrame, captures: DataFrame, issued: DataFrame, run: str, at: str, generation: str, element: str) -> DataFrame:
    """``actions`` with ``live_generation`` and ``verdict``: ``ok``; ``stale`` where the generation that
    issued the id is no longer the live one, as the page was read again since; ``unknown``
    where the live generation issued no such id.  A stale id is never mapped to what
    bears its number now.  An action that names no generation is held to the live one.

    ``captures`` (run, at, generation) says when each was read, ``issued`` (run, generation,
    element id) what it showed."""
    live = captures.select(F.col(run), F.col(at).alias("_read"), F.col(generation).alias("live_generation"))
    told = as_of(actions, live, [run], at, "_read", ["live_generation"])
    shown = issued.select(F.col(run).alias("_run"), F.col(generation).alias("_generation"), F.col(element).alias("_element")).distinct().withColumn("_shown", F.lit(True))
    same = (F.col(run) == F.col("_run")) & (F.col("live_generation") == F.col("_generation")) & (F.col(element) == F.col("_element"))
    joined = told.join(shown, same, "left")
    stale = F.col(generation).isNotNull() & ~F.col(generation).eqNullSafe(F.col("live_generation"))
    verdict = F.when(stale, "stale").when(F.col("_shown"), "ok").otherwise("unknown")
    return joined.withColumn("verdict", verdict).drop("_run", "_generation", "_element", "_shown")
