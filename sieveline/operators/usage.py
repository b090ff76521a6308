"""Ordered operators over events and conversations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import stored

GAP_SECONDS = 1800


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970; of timestamps without a zone by their wall clock."""
    if df.schema[ts].dataType.simpleString() == "timestamp":
        return F.unix_micros(ts)
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000
    return day + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, us, is_task) with ``_begins`` (30 minutes or more after the row before it) and
    ``_piece``, the time of the last such row.

    Rows are ranged by key and time, so that a key with most rows is cut into ranges; a
    range learns from one row for each range where the one before it ended."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # written, so that a range keeps its rows when a task runs again
    ranged = stored(rows.repartitionByRange(parts, *keys, "us").withColumn("_range", F.spark_partition_id()), "visits")
    within = Window.partitionBy("_range", *keys).orderBy("us", F.col("is_task").desc())
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def with_earlier(df: DataFrame, of: DataFrame, value: str, name: str) -> DataFrame:
        """``df`` with the greatest ``value`` of the key's earlier ranges."""
        side = of.groupBy("_range", *keys).agg(F.max(value).alias("_v")).select("_range", *keys, F.max("_v").over(earlier).alias(name))
        side = side.toDF("_r", *[f"_k{i}" for i in range(len(keys))], name)
        same = F.col("_range") == F.col("_r")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return df.join(side, same, "left").drop("_r", *[f"_k{i}" for i in range(len(keys))])

    before = with_earlier(ranged, ranged, "us", "_end")
    last = F.coalesce(F.lag("us").over(within), F.col("_end"))
    begun = before.withColumn("_begins", last.isNull() | (F.col("us") - last >= GAP_SECONDS * 1_000_000)).drop("_end")
    begun = begun.withColumn("_at", F.when(F.col("_begins"), F.col("us")))
    told = with_earlier(begun, begun, "_at", "_open")
    piece = F.coalesce(F.max("_at").over(within.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    return told.withColumn("_piece", piece).drop("_at", "_open", "_range")


def _counted(us: np.ndarray, task: np.ndarray, first: np.ndarray, group: np.ndarray, last: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(counted visits, last counted use) of each group of rows in order; ``last`` is that of
    the first group so far.  A round counts one visit in each group."""
    n, gap = int(group[-1]) + 1, GAP_SECONDS * 1_000_000
    none = np.iinfo(np.int64).min // 4
    # the last task before each row, in its group; times grow by group when shifted
    base = np.int64(us.max() - us.min() + 2 * gap + 1)
    place = (us - us.min()) + group * base
    tasks = np.where(task, place, -1)
    latest = np.maximum.accumulate(tasks)
    latest = np.where(latest >= group * base, latest, none)
    visits, until = np.zeros(n, np.int64), np.full(n, none)
    if last is not None:
        until[0] = last - us.min()
    # a key's first visit counts whatever came before it
    can = ~task & ((place - latest >= gap) | first)
    at, of, free = place[can], group[can], first[can]
    while len(at):
        ok = (at - until[of] >= gap) | free
        at, of, free = at[ok], of[ok], free[ok]
        head = np.append(True, of[1:] != of[:-1])[: len(of)]
        visits[of[head]] += 1
        until[of[head]] = at[head]
        at, of, free = at[~head], of[~head], np.zeros(int((~head).sum()), bool)
    np.maximum.at(until, group[task], place[task])
    return visits, np.where(until == none, none, until - np.arange(n) * base + us.min())


def counted_visits(events: DataFrame, keys: list[str], ts: str, is_task: Column) -> DataFrame:
    """Per key: visits, tasks and the time of the last counted use (microseconds).

    A visit counts 30 minutes or more after the last counted use, and as a key's first; a
    task always counts.  Behind a gap of 30 minutes the next use counts whatever came
    before, so a key is cut there, its pieces are counted apart, and sums remain: a key
    with most events is spread over its pieces.  A task streams pieces; a batch of rows is
    counted by array operations.  Rows with a null time are left out."""
    rows = events.where(F.col(ts).isNotNull()).select(*keys, micros(events, ts).alias("us"), F.coalesce(is_task, F.lit(False)).alias("is_task"))
    cut = _pieces(rows, keys)
    firsts = rows.where(~F.col("is_task")).groupBy(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)]).agg(F.min("us").alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_f{i}"))
    marked = cut.join(firsts, same, "left").withColumn("_first", ~F.col("is_task") & F.coalesce(F.col("us") == F.col("_first"), F.lit(False))).drop(*[f"_f{i}" for i in range(len(keys))])
    ordered = marked.repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", "us", F.col("is_task").desc()).select(*keys, "us", "is_task", "_first", "_begins")
    # of rows at one moment the first alone begins a piece, as no gap lies before the others
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", visits bigint, tasks bigint, last_us bigint"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            us, task, first, begins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("us", "is_task", "_first", "_begins"))
            if told:  # a key's first visit was counted in the batch before
                run = np.cumsum(begins) == 0
                first = first & ~run
            if begins[0]:
                last = None
            group = np.cumsum(begins) - int(begins[0])
            # of several first visits at one moment one counts
            first = first & ~np.append(False, first[:-1] & ~begins[1:])
            visits, until = _counted(us, task, first, group, last)
            tasks = np.bincount(group, task, len(visits)).astype(np.int64)
            at = np.append(0, np.flatnonzero(begins[1:]) + 1)
            open_rows = np.flatnonzero(group == group[-1])
            last = int(until[-1]) if until[-1] > np.iinfo(np.int64).min // 8 else None
            told = bool(first[open_rows].any()) or (told and len(visits) == 1 and not begins[0])
            keys_out = [batch.column(k).take(pa.array(at)) for k in keys]
            counted = pa.array(until, mask=until < np.iinfo(np.int64).min // 8)
            yield pa.RecordBatch.from_arrays([*keys_out, pa.array(visits), pa.array(tasks), counted], names=[*keys, "visits", "tasks", "last_us"])

    pieces = ordered.mapInArrow(fold, schema)
    return pieces.groupBy(*keys).agg(F.sum("visits").alias("visits"), F.sum("tasks").alias("tasks"), F.max("last_us").alias("last_us"))


def preferred(counts: DataFrame, category: str, host: str, k: int = 3) -> DataFrame:
    """Per category the ``k`` hosts with the highest 3 * tasks + visits; ties to the later use, then the smaller host."""
    scored = counts.withColumn("score", 3 * F.col("tasks") + F.col("visits"))
    place = F.row_number().over(Window.partitionBy(category).orderBy(F.desc("score"), F.desc("last_us"), host))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def scroll_budget(events: DataFrame, run: str, order: list[str], effect: Column, limit: int = 8) -> DataFrame:
    """Scrolls since the last act of a run, and whether they exceed ``limit``.  ``effect``
    is scroll, look (neutral) or act (resets)."""
    running = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    acts = events.withColumn("_effect", effect).withColumn("_act", F.sum(F.when(F.col("_effect") == "act", 1).otherwise(0)).over(running))
    since = Window.partitionBy(run, "_act").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("_effect") == "scroll", 1).otherwise(0)).over(since)
    return acts.withColumn("scrolls", n.cast("long")).withColumn("over_budget", F.col("scrolls") > limit).drop("_effect", "_act")


def keep_newest_page(turns: DataFrame, conversation: str, turn: str, has_page: Column, text_col: str, note: str) -> DataFrame:
    """Page blocks older than the newest one of their conversation become ``note``."""
    rows = turns.withColumn("_page", F.coalesce(has_page, F.lit(False)))
    newest = F.max(F.when(F.col("_page"), F.col(turn))).over(Window.partitionBy(conversation))
    return rows.withColumn(text_col, F.when(F.col("_page") & (F.col(turn) < newest), F.lit(note)).otherwise(F.col(text_col))).drop("_page")


def assemble_calls(deltas: DataFrame, run: str, index: str, order: str) -> DataFrame:
    """Streamed fragments of calls: the last id and name that are not empty, arguments in order of arrival."""
    some = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(order)))
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce("arguments", F.lit("")).alias("part"))))
    joined = F.array_join(F.transform(parts, lambda x: x["part"]), "")
    return deltas.groupBy(run, index).agg(some("id").alias("id"), some("name").alias("name"), joined.alias("arguments"))
