"""Runs of actions: signatures, the repeat guard, issued ids, calls and results, the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..functions.text import tokens_in

#: Actions that only look, those that are no repeats, and limits; fixed values.
LOOKING = "read_page find_text wait list_tabs ask_user".split()
READING = "read_page find_text".split()
RECENT, REPEATS, RECORDS, IMAGE_BYTES = 24, 3, 24, 3_000_000
#: Turns of a history that are kept and shown, and characters of each; fixed values.
HISTORY_KEPT, HISTORY_SHOWN, HISTORY_CHARS = 6, 4, 600


def scroll_effect(name: Column) -> Column:
    """scroll spends the budget, look leaves it, act refills it."""
    return F.when(name == "scroll", "scroll").when(name.isin(LOOKING), "look").otherwise("act")


def parse_arguments(raw: Column) -> Column:
    """The arguments of a call as a map of JSON values; an empty map for what is no JSON object."""
    return F.coalesce(F.from_json(raw, MapType(StringType(), StringType()), {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def action_signature(name: Column, arguments: Column, url: Column) -> Column:
    """What makes two actions the same: name, arguments (a map) in the order of their
    names without the stated reason, and the page."""
    rest = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(arguments, lambda k, v: k != "reason"))))
    return F.concat(name, F.lit(" "), F.to_json(rest, {"ignoreNullFields": "false"}), F.lit(" @ "), url)


def repeat_guard(actions: DataFrame, run: str, order: list[str], name: Column, signature: Column, page_changed: Column) -> DataFrame:
    """``actions`` with repeats and stopped: how often this action is among the last 24
    counted ones since the page last changed, and whether that is too often.  Reading
    and searching do not count.  ``page_changed`` says of an action that the page
    differed after it."""
    counted = ~name.isin(READING)
    before = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = actions.withColumn("_counted", counted).withColumn("_sign", signature).withColumn("_epoch", F.coalesce(F.sum(F.when(page_changed, 1).otherwise(0)).over(before), F.lit(0)))
    rows = rows.withColumn("_nth", F.sum(F.when(F.col("_counted"), 1).otherwise(0)).over(Window.partitionBy(run, "_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    # of one signature the counted ones whose number lies within the last 24
    same = Window.partitionBy(run, "_epoch", "_counted", "_sign").orderBy("_nth").rangeBetween(-(RECENT - 1), 0)
    repeats = F.when(F.col("_counted"), F.count(F.lit(1)).over(same)).otherwise(0)
    return rows.withColumn("repeats", repeats.cast("long")).withColumn("stopped", F.col("repeats") > REPEATS).drop("_counted", "_sign", "_epoch", "_nth")


def issued_only(actions: DataFrame, issued: DataFrame, key: list[str]) -> DataFrame:
    """Actions on elements that were shown under that key (run, generation, element id);
    stale ids are refused, never mapped anew."""
    return actions.join(issued.select(*key).distinct(), key, "left_semi")


def with_results(calls: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Each call with its result; a call without one has nulls."""
    return calls.join(results, key, "left")


def fold_events(events: DataFrame, key: list[str], order: str, kind: str, text: str) -> DataFrame:
    """A stream of entries, appended texts and replacements as one text for each key:
    the last entry or replacement and what was appended after it."""
    start = F.max(F.when(F.col(kind).isin("entry", "replace"), F.col(order))).over(Window.partitionBy(*key))
    live = events.withColumn("_start", start).where(F.col("_start").isNull() | (F.col(order) >= F.col("_start")))
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("_t"))))
    return live.groupBy(*key).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), "").alias(text))


def recent_history(turns: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """The last six turns of a session; ``shown`` marks the last four, cut to 600 characters."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    rows = turns.withColumn("_back", back).where(F.col("_back") <= HISTORY_KEPT)
    return rows.withColumn(text, F.left(text, F.lit(HISTORY_CHARS))).withColumn("shown", F.col("_back") <= HISTORY_SHOWN).drop("_back")


def settled_at(changes: DataFrame, key: list[str], ts: str, *, quiet: float = 0.12, grace: float = 0.25, ceiling: float = 3.0) -> DataFrame:
    """(key, settled): when a page counts as settled, in seconds.  ``changes`` has seconds
    since the action; a null one stands for an action without changes.  Settled is
    the first moment with ``quiet`` seconds of silence behind it, after ``grace``
    seconds if nothing ever changed, and after ``ceiling`` at the latest."""
    rows = changes.where(F.col(ts).isNull() | (F.col(ts) <= ceiling))
    order = Window.partitionBy(*key).orderBy(ts)
    gap = F.coalesce(F.lead(ts).over(order), F.lit(float("inf"))) - F.col(ts)
    early = F.first(ts, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > grace
    ends = rows.withColumn("_end", F.when(F.col(ts).isNotNull() & (gap >= quiet), F.col(ts) + quiet)).withColumn("_none", early)
    first = ends.groupBy(*key).agg(F.min("_end").alias("_end"), F.max("_none").alias("_none"))
    settled = F.when(F.coalesce(F.col("_none"), F.lit(True)), F.lit(grace)).otherwise(F.least(F.coalesce("_end", F.lit(ceiling)), F.lit(ceiling)))
    return changes.select(*key).distinct().join(first.select(*key, settled.alias("settled")), key, "left").na.fill({"settled": ceiling})


def wire_records(sent: DataFrame, log: str, order: str) -> DataFrame:
    """The log's last 24 records: what was sent (an array ``messages`` of structs role,
    text), the tokens in it, its characters; images over 3 MB keep their size alone."""
    whole = F.array_join(F.transform("messages", lambda m: m["text"]), "\n")
    chars = F.aggregate("messages", F.lit(0), lambda n, m: n + F.length(m["text"])) + F.coalesce("system_chars", F.lit(0))
    back = F.row_number().over(Window.partitionBy(log).orderBy(F.desc(order)))
    rows = sent.withColumn("_back", back).where(F.col("_back") <= RECORDS).withColumn("tokens", tokens_in(whole)).withColumn("total_chars", chars.cast("long"))
    if "image" in sent.columns:
        rows = rows.withColumn("image_bytes", F.octet_length("image")).withColumn("image", F.when(F.octet_length("image") <= IMAGE_BYTES, F.col("image")))
    return rows.drop("_back")


def wire_export(records: DataFrame) -> DataFrame:
    """One JSON text a record, without image bytes."""
    return records.drop("image").select(F.to_json(F.struct(*[c for c in records.columns if c != "image"])).alias("json"))


def leak_totals(records: DataFrame, log: str, leaked: str = "leaked") -> DataFrame:
    """Per log: records, characters sent, values leaked."""
    return records.groupBy(log).agg(F.count(F.lit(1)).alias("records"), F.sum("total_chars").alias("chars"), F.sum(F.size(leaked)).cast("long").alias("leaks"))
