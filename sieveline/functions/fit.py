"""Values rewritten in the format of a form field, or null where that is a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, spaced, strip

#: Names of months and what may stand between the parts of a date; fixed values.
_FULL = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_GAP = r"[\s\-/.,]*"


def _part(text: Column, pattern: str, group: int) -> Column:
    pattern = spaced(pattern)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _month(word: Column) -> Column:
    """Number of a month by its name or an abbreviation of three letters or more."""
    w = F.regexp_replace(F.lower(word), r"\.$", "")
    out = F.lit(None).cast("string")
    for i, full in enumerate(_FULL, 1):
        out = F.when((F.length(w) >= 3) & F.lit(full).startswith(w), F.lit(f"{i:02d}")).otherwise(out)
    return F.when(w == "sept", F.lit("09")).otherwise(out)


def _real(year: Column, month: Column, day: Column) -> Column:
    """``YYYY-MM-DD`` if that day exists, from the year 1000 on."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    ok = year.isNotNull() & month.isNotNull() & day.isNotNull() & (year >= "1000")
    return F.when(ok, F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"))


def iso_date(raw: Column) -> Column:
    """``YYYY-MM-DD``; null where day and month could be exchanged, for years of two digits, and for days that do not exist."""
    t = strip(raw)
    ymd, dmy = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
    worded, leading = rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?{_GAP}([a-z]+\.?){_GAP}(\d{{4}})$", rf"(?i)^([a-z]+\.?){_GAP}(\d{{1,2}})(?:st|nd|rd|th)?{_GAP}(\d{{4}})$"
    a, b, y = (_part(t, dmy, i) for i in (1, 2, 3))
    x, z = a.cast("int"), b.cast("int")
    numeric = F.when((x == z) | ((x > 12) & (z <= 12)), _real(y, b, a)).when((z > 12) & (x <= 12), _real(y, a, b))
    return F.coalesce(
        _real(*(_part(t, ymd, i) for i in (1, 2, 3))), numeric, _real(_part(t, worded, 3), _month(_part(t, worded, 2)), _part(t, worded, 1)), _real(_part(t, leading, 3), _month(_part(t, leading, 1)), _part(t, leading, 2))
    )


def iso_time(raw: Column) -> Column:
    """``HH:MM`` or ``HH:MM:SS`` of a time in 12 or 24 hours."""
    t = strip(raw)
    twelve, day = r"(?i)^(\d{1,2})(?:[:.](\d{2}))?(?::(\d{2}))?\s*([ap])\.?\s*m\.?$", r"^(\d{1,2})[:.](\d{2})(?::(\d{2}))?$"
    h12, h24 = _part(t, twelve, 1).cast("int"), _part(t, day, 1).cast("int")
    pm = F.when(F.lower(_part(t, twelve, 4)) == "p", 12).otherwise(0)
    hour = F.coalesce(F.when(h12.between(1, 12), h12 % 12 + pm), F.when(h24 <= 23, h24))
    minute = F.coalesce(F.when(h12.isNotNull(), F.coalesce(F.nullif(_part(t, twelve, 2), F.lit("")), F.lit("00"))), _part(t, day, 2))
    second = F.coalesce(F.nullif(_part(t, twelve, 3), F.lit("")), F.nullif(_part(t, day, 3), F.lit("")))
    ok = (minute <= "59") & F.coalesce(second <= "59", F.lit(True))
    return F.when(ok & hour.isNotNull(), F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), minute, second))


def iso_month(raw: Column) -> Column:
    """``YYYY-MM``."""
    t = strip(raw)
    first, last, worded = r"^(\d{4})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{4})$", rf"(?i)^([a-z]+\.?){_GAP}(\d{{4}})$"

    def ok(year: Column, month: Column) -> Column:
        return F.when((year >= "1000") & month.cast("int").between(1, 12), F.concat_ws("-", year, F.lpad(month, 2, "0")))

    return F.coalesce(ok(_part(t, first, 1), _part(t, first, 2)), ok(_part(t, last, 2), _part(t, last, 1)), ok(_part(t, worded, 2), _month(_part(t, worded, 1))))


def iso_datetime(raw: Column) -> Column:
    """``YYYY-MM-DDTHH:MM`` of a date followed by a time."""
    t = strip(raw)
    pair = r"(?i)^(.*?)[\sT,]+(\d{1,2}(?:[:.]\d{2}){0,2}\s*(?:[ap]\.?\s*m\.?)?)$"
    date, time = iso_date(_part(t, pair, 1)), iso_time(_part(t, pair, 2))
    ready = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?$"
    return F.when(t.rlike(ready), t).otherwise(F.when(date.isNotNull() & time.isNotNull(), F.concat_ws("T", date, time)))


#: Currencies before and after an amount, groups of digits, and a plain number; fixed values.
_BEFORE, _AFTER, _SIGNS = r"rs\.?|inr|usd|eur|gbp", r"rs\.?|inr", r"₹$€£\s_"
_GROUPED = r"^[-+]?\d{1,3}(,\d{2,3})*,\d{3}(\.\d+)?$"
_PLAIN = r"(?i)^[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?$"


def plain_number(raw: Column) -> Column:
    """Digits without currency and group separators; null where a comma may be a decimal one."""
    amount = spaced(rf"(?i)^(?:{_BEFORE})?([{_SIGNS}0-9.,+e-]*?)(?:{_AFTER})?$")
    bare = F.regexp_replace(F.when(strip(raw).rlike(amount), F.regexp_extract(strip(raw), amount, 1)), spaced(f"[{_SIGNS}]"), "")
    digits = F.replace(bare, F.lit(","), F.lit(""))
    return F.when((~bare.contains(",") | bare.rlike(_GROUPED)) & digits.rlike(_PLAIN), digits)


def fit_to_field(text: Column, kind: Column, max_length: Column, label: Column, input_mode: Column | None = None) -> Column:
    """struct<ok, value, note, reason>: the text in the field's format and within its
    limit (negative or null: none).  ``note`` says what was changed, ``reason`` why a
    text does not fit; then ``ok`` is false and the value null.  Blank texts pass
    through; a phone loses separators, then a country code of up to three digits."""
    mode, k = F.coalesce(input_mode if input_mode is not None else F.lit(""), F.lit("")), F.lower(kind)
    limit, blank = F.when(max_length >= 0, max_length), strip(text) == ""
    phone = (k == "tel") | (mode == "tel") | F.coalesce(label, F.lit("")).rlike(r"(?i)phone|mobile|\btel\b|contact\s*n|whatsapp")
    wanted = F.when(k.isin("number", "range"), "a plain number").when(k == "time", "a time of day").when(k == "month", "a month and a year").when(k == "datetime-local", "a day and a time").otherwise("a day, month and year without doubt")
    formatted = (
        F.when(blank, text).when(k == "date", iso_date(text)).when(k == "time", iso_time(text)).when(k == "month", iso_month(text))
        .when(k == "datetime-local", iso_datetime(text)).when(k.isin("number", "range"), plain_number(text)).otherwise(text)
    )

    def fitted(f: Column) -> Column:
        bare = F.regexp_replace(f, spaced(r"[\s\-().]"), "")
        phone_like = (k == "tel") | mode.isin("tel", "numeric") | f.rlike(spaced(r"^\+?[\d\s\-().]+$"))
        digits = F.regexp_replace(bare, r"^\+|^00", "")
        trimmed = F.when(phone & bare.rlike(r"^(\+|0)") & digits.rlike(r"^\d+$") & (F.length(digits) - limit).between(1, 3), F.right(digits, limit))
        how = F.when(limit.isNull() | (F.length(f) <= limit), "kept").when(phone_like & (F.length(bare) <= limit), "bare").when(trimmed.isNotNull(), "trimmed").otherwise("long")
        return F.struct(f.alias("f"), how.alias("how"), F.when(how == "kept", f).when(how == "bare", bare).otherwise(trimmed).alias("value"))

    def told(x: Column) -> Column:
        note = F.when(blank, F.lit(None)).when(x["how"] == "bare", "separators removed to fit the field").when(x["how"] == "trimmed", "country code removed to fit the field").when(x["value"] != text, F.concat(F.lit("written as "), x["value"]))
        long = F.concat(F.lit("the field takes "), limit.cast("string"), F.lit(" characters at most, the text has "), F.length(x["f"]).cast("string"))
        reason = F.when(x["value"].isNull() & text.isNotNull(), F.when(x["f"].isNull(), F.concat(F.lit("the field takes "), wanted)).otherwise(long))
        return F.struct(x["value"].isNotNull().alias("ok"), x["value"].alias("value"), note.cast("string").alias("note"), reason.alias("reason"))

    return let(let(formatted, fitted), told)
