"""Regex spans with offsets, and the greedy choice among overlapping ones; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, spaced

SPAN = "array<struct<start:int,end:int,value:string>>"
_W = "[A-Za-z0-9_]"
#: An ASCII word border; the engine's own ``\b`` looks at all letters.
BORDER = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def ascii_borders(pattern: str) -> str:
    """A rule's pattern for the engine: ASCII word borders, all white space."""
    return spaced(pattern.replace(r"\b", BORDER))


def spans(text: Column, pattern: str | Column) -> Column:
    """All matches as array<struct<start, end, value>>; offsets count code points from 0.
    A pattern that is a column is taken as it is.

    The matches are marked in one pass and the marked text is split, so the cost
    is that of one replacement whatever the number of matches."""
    clean = F.translate(text, "\x01\x02", "  ")
    if isinstance(pattern, str):
        return _between_marks(F.regexp_replace(clean, f"({ascii_borders(pattern)})", "\x01$1\x02"))
    return _between_marks(F.regexp_replace(clean, F.concat(F.lit("("), pattern, F.lit(")")), F.lit("\x01$1\x02")))


def group_spans(text: Column, before: str, group: str, after: str) -> Column:
    """The same for what stands between ``before`` and ``after``; none of the patterns captures."""
    clean = F.translate(text, "\x01\x02", "  ")
    return _between_marks(F.regexp_replace(clean, f"({ascii_borders(before)})({ascii_borders(group)}){ascii_borders(after)}", "$1\x01$2\x02"))


def _between_marks(marked: Column) -> Column:
    def step(acc: Column, part: Column) -> Column:
        value = F.substring_index(part, "\x02", 1)
        one = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(value)).alias("end"), value.alias("value"))
        return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def told(parts: Column) -> Column:
        start = F.struct(F.length(parts[0]).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda acc: acc["out"])

    # split once, as each name of the parts would mark the text anew
    return let(F.split(marked, "\x01"), told)


def settle_spans(found: Column, claimed: Column | None = None) -> Column:
    """Of an array of structs (..., start, end, ...) the greedy choice in the order of
    the structs, dropping what overlaps a chosen or claimed one."""
    if claimed is not None:
        found = F.filter(found, lambda x: ~F.coalesce(F.exists(claimed, lambda a: (x["start"] < a["end"]) & (x["end"] > a["start"])), F.lit(False)))
    empty = F.filter(found, lambda x: F.lit(False))
    clash = lambda acc, x: F.exists(acc, lambda a: (x["start"] < a["end"]) & (x["end"] > a["start"]))
    return F.aggregate(F.array_sort(found), empty, lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
