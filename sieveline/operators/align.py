"""Requests and addresses in which known values become tokens, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import NEVER_ALIGNED, among
from ..functions.text import TOKEN, encode_component, is_address, let, spaced, strip

#: Legal forms that a request leaves out; a fixed value.
LEGAL_FORM = spaced(r"(?i)\s+(?:Pvt\.?\s*Ltd\.?|Private\s+Limited|Public\s+Limited|Limited|Ltd\.?|LLP|LLC|Inc\.?|Incorporated|Corp\.?|Corporation|PLC|GmbH)\.?$")


def alignable(value: Column) -> Column:
    """Whether a value is worth replacing: three characters, and no common word."""
    bare = F.regexp_replace(F.lower(strip(value)), r"[^\p{L}]", "")
    return (F.length(strip(value)) >= 3) & (strip(value).rlike(spaced(r"\s")) | ~among(bare, NEVER_ALIGNED))


def _alias(value: Column) -> Column:
    """A value without its legal form."""
    return strip(F.regexp_replace(value, LEGAL_FORM, ""))


def align_text(text: Column, known: Column) -> Column:
    """``text`` with the values of ``known`` (array of structs value, token) replaced by
    their tokens, whatever their case, the longest first; a firm also without its
    legal form.  No letter may touch a value on either side."""
    alias = lambda k: _alias(k["value"])
    short = F.filter(F.transform(known, lambda k: F.struct(alias(k).alias("value"), k["token"].alias("token"), (alias(k) != k["value"]).alias("new"))), lambda k: k["new"] & (F.length(k["value"]) >= 3))
    every = F.concat(F.transform(known, lambda k: F.struct(k["value"].alias("value"), k["token"].alias("token"))), F.transform(short, lambda k: F.struct(k["value"].alias("value"), k["token"].alias("token"))))
    order = F.array_sort(F.transform(F.filter(every, lambda k: alignable(k["value"])), lambda k: F.struct((-F.length(k["value"])).alias("n"), k["value"].alias("value"), k["token"].alias("token"))))
    pattern = lambda k: F.concat(F.lit(r"(?iu)(?<!\p{L})\Q"), k["value"], F.lit(r"\E(?!\p{L})"))
    return F.coalesce(F.aggregate(order, text, lambda out, k: F.regexp_replace(out, pattern(k), F.replace(k["token"], F.lit("$"), F.lit("\\$")))), text)


#: What a character is in a shape: a letter inside a run of letters, the first of a run, a digit, another.
_INNER, _FIRST, _DIGIT, _OTHER = "\x01\x02\x03\x04"


def _shape(text: Column) -> Column:
    """What each character of a text is, as a text of the same length."""
    out = F.regexp_replace(F.translate(text, "\x01\x02\x03\x04", "    "), r"(?<=\p{L})\p{L}", _INNER)
    for pattern, mark in ((r"\p{L}", _FIRST), ("[0-9]", _DIGIT), (f"[^{_INNER}{_FIRST}{_DIGIT}]", _OTHER)):
        out = F.regexp_replace(out, pattern, mark)
    return out


def _stretch_kind(form: Column) -> Column:
    """struct<first, last, n>: with what a value begins and ends, and its length."""
    shape = _shape(form)
    return F.struct(F.left(shape, F.lit(1)).alias("first"), F.translate(F.right(shape, F.lit(1)), _INNER, _FIRST).alias("last"), F.length(form).alias("n"))


def _stretches(text: Column, kinds: Column) -> Column:
    """The distinct stretches of a lower-cased text that are of one of ``kinds`` and neither
    begin nor end inside a run of letters; null without text.  Made for requests that a
    person types: the work is that of the text's length times the kinds."""
    at = lambda s, i: F.substring(s, i, F.lit(1))

    def found(x: Column) -> Column:
        fits = lambda i, k: (at(x["shape"], i) == k["first"]) & (F.translate(at(x["shape"], i + k["n"] - 1), _INNER, _FIRST) == k["last"]) & (at(x["shape"], i + k["n"]) != _INNER)
        starts = F.filter(F.sequence(F.lit(1), F.length(x["shape"])), lambda i: at(x["shape"], i) != _INNER)
        every = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(kinds, lambda k: fits(i, k)), lambda k: F.substring(x["text"], i, k["n"]))))
        return F.when(x["shape"] != "", F.array_distinct(every))

    return let(F.struct(F.lower(text).alias("text"), _shape(F.lower(text)).alias("shape")), found)


def align_requests(requests: DataFrame, vault: DataFrame, session: str, text_col: str) -> DataFrame:
    """``requests`` aligned with the values of their session that they hold.

    A value, or a firm without its legal form, meets the requests of its session that
    hold it as a stretch between letters: a join by session and stretch, so that
    neither side of a session is paired with all of the other."""
    values = vault.where("value is not null").select(F.col(session).alias("_of"), "value", "token")
    forms = values.select("*", F.explode(F.array_distinct(F.array(F.lower("value"), F.lower(_alias(F.col("value")))))).alias("_form")).where(F.length("_form") >= 3)
    kinds = forms.agg(F.collect_set(_stretch_kind(F.col("_form"))).alias("_kinds"))
    rows = requests.select(F.struct("*").alias("_r"), F.col(session).alias("_s"), F.col(text_col).alias("_t"), F.monotonically_increasing_id().alias("_row")).crossJoin(F.broadcast(kinds))
    # one entry of each request carries its row, under a key of its own, so that rows without values are spread too
    own = F.array(F.struct(F.xxhash64("_row").alias("key"), F.lit(True).alias("own")))
    sought = F.transform(F.coalesce(_stretches(F.col("_t"), F.col("_kinds")), F.array().cast("array<string>")), lambda x: F.struct(F.xxhash64(x).alias("key"), F.lit(False).alias("own")))
    each = rows.select("_row", "_s", "_r", F.explode(F.concat(own, sought)).alias("_x")).select("_row", "_s", F.when(F.col("_x.own"), F.col("_r")).alias("_r"), F.col("_x.key").alias("_key"), F.col("_x.own").alias("_own"))
    known = forms.select("_of", F.xxhash64("_form").alias("_key"), F.struct("value", "token").alias("_known"))
    met = each.join(known.withColumnRenamed("_key", "_form"), (F.col("_s") == F.col("_of")) & (F.col("_key") == F.col("_form")), "left").where("_own or _known is not null")
    joined = met.groupBy("_row").agg(F.first("_r", ignorenulls=True).alias("_r"), F.collect_set(F.when(~F.col("_own"), F.col("_known"))).alias("_known"))
    return joined.select("_r.*", "_known").withColumn(text_col, F.when(F.size("_known") == 0, F.col(text_col)).otherwise(align_text(F.col(text_col), F.col("_known")))).drop("_known")


def resolve_url(url: Column, values: Column) -> Column:
    """A URL with its tokens replaced from ``values`` (a map): percent-encoded behind the
    host of an address, as they are elsewhere and in words to search for.  Tokens
    without a value stay."""
    parts = F.split(F.regexp_replace(F.translate(url, "\x01", " "), f"({TOKEN})", "\x01$1\x01"), "\x01")
    value = lambda p: F.try_element_at(values, p)
    plain = F.array_join(F.transform(parts, lambda p: F.coalesce(value(p), p)), "")
    start = F.struct(F.lit("").alias("raw"), F.lit("").alias("out"))
    # behind the host as soon as the raw URL so far has a path, a query or a fragment
    behind = lambda raw: F.regexp_replace(raw, r"^(?i:[a-z][a-z0-9+.-]*://)", "").rlike("[/?#]")

    def step(acc: Column, p: Column) -> Column:
        put = F.when(value(p).isNotNull(), F.when(behind(acc["raw"]), encode_component(value(p))).otherwise(value(p))).otherwise(p)
        return F.struct(F.concat(acc["raw"], p).alias("raw"), F.concat(acc["out"], put).alias("out"))

    address = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(is_address(F.regexp_replace(url, TOKEN, "x")), address).otherwise(plain)
