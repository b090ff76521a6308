"""Names of persons and firms, and postal addresses, in texts and captures.

A candidate is what a pattern or a known name proposes.  Of candidates that
overlap the longest wins, then the surer one, then the earlier rule; what an
earlier detector claimed stays with it.  Everything is one projection over rows
of texts; the names a capture declares reach its rows as an array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.text import SPACE, let, strip
from .rules import RANK
from .spans import ascii_borders, group_spans, settle_spans, spans

CLAIMS = "array<struct<start:int,end:int>>"
NAMES = "array<struct<name:string,kind:string>>"


@dataclass(frozen=True)
class Entity:
    """``before`` introduces the phrase and is not part of it; ``lead`` is cut from its
    front; ``check`` takes the phrase, the text and the phrase's start."""

    number: int
    kind: Callable[[Column], Column] | str
    confidence: str
    before: str
    phrase: str
    after: str
    gate: str
    check: Callable[[Column, Column, Column], Column]
    lead: str | None = None


def _either_case(words: list[str]) -> str:
    """Words whose first letter may be a capital or not."""
    return "|".join(f"[{w[0].upper()}{w[0].lower()}]{w[1:]}" for w in words)


# Patterns of names, house numbers and streets, labels of addresses and the words near them; fixed values.
_TITLES = "|".join(dict.fromkeys([*N.HONORIFICS, *(h.upper() for h in N.HONORIFICS)]))
_HOUSE = r"\d+(?:st|nd|rd|th)?[A-Za-z]?(?:[/-][\dA-Za-z]+)*"
_SEGMENT = rf"(?:[A-Z][A-Za-z'’.-]+\s+){{0,4}}(?:{_either_case(N.STREET_TYPES)})\b(?:[\s-]+(?:\d{{1,3}}[A-Za-z]?|[A-Z]))?"
_HOUSE_LABEL = _either_case([r"No\.?", "Flat", "Plot", "Door", r"H\.?\s?No\.?", "Shop", "Unit"])
_STREET = rf"\b(?:(?:{_HOUSE_LABEL})\s*)?{_HOUSE},?\s+(?:{_HOUSE},?\s+)?{_SEGMENT}(?:,\s*{_SEGMENT})*(?![\p{{L}}\d])"
_NAMED_STREET = rf"(?<![\p{{L}}\d])(?:[A-Z][A-Za-z'’.-]+\s+){{1,3}}(?:{_either_case(N.STRONG_STREETS)})\b(?![\p{{L}}\d])"
_ADDRESS_LABEL = "Residential address|Permanent address|Correspondence address|Communication address|Present address|Billing address|Shipping address|Delivery address|Address|Addr"
_NEAR_ADDRESS = r"\b(address|located|near|opp|opposite|behind|next to|pincode|pin|landmark|branch office|regd\.? office|registered office)\b"
_BEFORE_PIN = r"\b(pin|pincode|pin\s*code|postal\s*code|zip)\s*(no\.?)?\s*[:.#-]?\s*$"
_BIRTH = r"DOB|D\.O\.B|Date of Birth|Year of Birth|YOB|Birth"
_PLACES = "|".join(N.PLACES)
_UPPER = r"\p{Lu}"


def _around(text: Column, start: Column, before: int, length: Column) -> Column:
    """``text`` from ``before`` characters before ``start`` to ``length`` after it, lower case."""
    return F.lower(F.substring(text, F.greatest(F.lit(1), start - (before - 1)), F.least(start, F.lit(before)) + length))


def _street_nearby(phrase: Column, text: Column, start: Column) -> Column:
    return _around(text, start, 80, F.length(phrase) + 80).rlike(ascii_borders(rf"\b[1-9]\d{{5}}\b|{_PLACES}|{_NEAR_ADDRESS}"))


def _pin_nearby(phrase: Column, text: Column, start: Column) -> Column:
    near = _around(text, start, 70, F.lit(70)).rlike(ascii_borders(rf"{_PLACES}|\baddress\b"))
    return near | _around(text, start, 24, F.lit(0)).rlike(ascii_borders(_BEFORE_PIN))


def _person_or_org(phrase: Column) -> Column:
    return F.when(N.has_org_word(phrase), "org_name").otherwise("person_name")


_HON = N.leading(N.HONORIFICS)
_evidence = lambda p, t, s: N.plausible_with_evidence(p)
_two_words = lambda p: p.rlike(f"[{SPACE}]")
#: In the order in which they propose; 1 is kept for declared names, 2 for cells under a header.
ENTITIES = [
    Entity(3, "person_name", "high", rf"\b(?:{_TITLES})\.?\s+", N.PROPER, "", _TITLES, _evidence, _HON),
    Entity(4, _person_or_org, "high", rf"(?<!\p{{L}})(?i:{N.NAME_CUES})(?!\p{{L}})(?:\s*[:：,-]\s*|\s+)", N.PROPER, "", _UPPER, _evidence, _HON),
    Entity(5, "person_name", "high", r"(?:^|\n)[^\S\n]*", N.PROPER, rf"(?=[^\S\n]*\n[^\S\n]*(?i:{_BIRTH}))", "(?i:birth|yob|dob|d\\.o)", lambda p, t, s: _two_words(strip(p)) & N.plausible_with_evidence(p), _HON),
    Entity(6, "org_name", "high", r"\b", rf"{N.PROPER}\s+(?:{N.ORG_SUFFIXES})", r"(?!\p{L})", _UPPER, lambda p, t, s: _two_words(p), N.leading([*N.NOT_NAMES, *N.CONNECTORS])),
    Entity(8, "postal_address", "high", "", _STREET, "", r"\d", lambda p, t, s: (F.length(p) >= 6) & N.has_address_word(p)),
    Entity(9, "postal_address", "high", rf"(?<!\p{{L}})(?i:{_ADDRESS_LABEL})\s*[:：-]?\s*", r"[^@]{8,220}?[1-9]\d{5}", r"(?!\d)", "(?i:addr)", lambda p, t, s: p.rlike(r"[,\n]") & p.rlike(r"\p{L}{3,}")),
    Entity(10, "postal_address", "medium", "", _NAMED_STREET, "", _either_case(N.STRONG_STREETS), _street_nearby),
    Entity(11, "pincode", "high", "", r"\b[1-9]\d{5}\b", "", r"\d{6}", _pin_nearby),
]
#: Capitalised words with no other reason, where the caller asks for them.
BARE = Entity(12, "person_name", "low", "", r"\p{Lu}\p{Ll}{2,}(?:\s+\p{Lu}\p{Ll}{2,}){1,3}", "", r"\p{Lu}\p{Ll}{2}", lambda p, t, s: N.plausible_name(p))


def _item(x: Column, number: int, kind: Column, confidence: str) -> Column:
    return F.struct(
        (x["start"] - x["end"]).alias("shortness"), F.lit(RANK[confidence]).alias("rank"), F.lit(number).alias("rule"), x["start"].alias("start"), x["end"].alias("end"),
        kind.alias("kind"), F.lit(confidence).alias("confidence"), x["value"].alias("value"),
    )


def _proposed(text: Column, rule: Entity) -> Column:
    found = group_spans(text, rule.before, rule.phrase, rule.after) if rule.before or rule.after else spans(text, rule.phrase)

    def cut(x: Column) -> Column:
        whole = N.trim_phrase(x["value"]) if rule.number != 11 else x["value"]
        rest = F.regexp_replace(whole, rule.lead, "") if rule.lead else whole
        start = x["start"] + F.length(whole) - F.length(rest)
        return F.struct(start.alias("start"), (start + F.length(rest)).alias("end"), rest.alias("value"))

    phrases = F.filter(F.transform(found, cut), lambda x: (x["value"] != "") & rule.check(x["value"], text, x["start"]))
    kind = (lambda x: rule.kind(x["value"])) if callable(rule.kind) else (lambda x: F.lit(rule.kind))
    return F.when(text.rlike(ascii_borders(rule.gate)), F.transform(phrases, lambda x: _item(x, rule.number, kind(x), rule.confidence)))


def _occurrences(text: Column, names: Column) -> Column:
    """Declared names in the text, and persons' names together with a capitalised word beside them."""

    def of(n: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<!\p{L})\Q"), n["name"], F.lit(r"\E(?!\p{L})"))

        def both(x: Column) -> Column:
            before = F.regexp_extract(F.substring(text, F.lit(1), x["start"]), rf"(\p{{Lu}}\p{{Ll}}+)[{SPACE}]$", 1)
            after = F.regexp_extract(F.substring(text, x["end"] + 1, F.length(text)), rf"^[{SPACE}](\p{{Lu}}\p{{Ll}}+)", 1)
            grow = lambda w: F.when((w != "") & N.plausible_name(w), F.length(w) + 1).otherwise(0)
            start, end = x["start"] - grow(before), x["end"] + grow(after)
            wide = F.struct(start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("value"))
            wider = let(wide, lambda w: F.when((n["kind"] == "person_name") & (F.length(w["value"]) > F.length(x["value"])) & N.plausible_name(w["value"]), _item(w, 1, F.lit("person_name"), "high")))
            return F.array_compact(F.array(_item(x, 1, n["kind"], "certain"), wider))

        return F.flatten(F.transform(spans(text, pattern), both))

    return F.flatten(F.transform(F.filter(names, lambda n: F.contains(text, n["name"])), of))


@lru_cache(maxsize=64)
def _array(rule: Entity, gateway: int) -> Column:
    """``_proposed`` of the column t; made once for each JVM."""
    return F.coalesce(_proposed(F.col("t"), rule), F.array())


def entity_findings(rows: DataFrame, key: list[str], text_col: str = "text", *, aggressive: bool = False) -> DataFrame:
    """One row per finding: the key, kind, confidence, rule, start, end, value.

    ``rows`` may further have ``claimed`` (spans that are taken), ``names`` (names the
    capture declares, with their kinds), ``whole`` (the text is an address) and
    ``cell`` (whether one word is enough, where a name header points at the text).
    Null texts have no findings."""
    have = set(rows.columns)
    opt = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    slim = rows.where(F.col(text_col).isNotNull()).select(*key, F.translate(text_col, "\x01\x02", "  ").alias("t"), opt("claimed", CLAIMS), opt("names", NAMES), opt("whole", "boolean"), opt("cell", "boolean"))
    t, empty = F.col("t"), F.array()
    arrays = [_array(r, id(SparkContext._gateway)) for r in (*ENTITIES, *([BARE] if aggressive else []))]
    if "names" in have:
        arrays.append(F.coalesce(_occurrences(t, F.col("names")), empty))
    if "whole" in have:
        everything = F.struct(F.lit(0).alias("start"), F.length(t).alias("end"), t.alias("value"))
        arrays.append(F.when(F.col("whole"), F.array(_item(everything, 7, F.lit("postal_address"), "certain"))).otherwise(empty))
    if "cell" in have:
        start = F.length(t) - F.length(F.regexp_replace(t, f"^[{SPACE}]+", ""))
        value = F.struct(start.alias("start"), (start + F.length(strip(t))).alias("end"), strip(t).alias("value"))
        arrays.append(F.when(F.col("cell").isNotNull() & N.looks_like_name_cell(t, F.col("cell")), F.array(_item(value, 2, _person_or_org(strip(t)), "high"))).otherwise(empty))
    found = slim.select(*key, "claimed", F.concat(*arrays).alias("f"))
    each = found.select(*key, F.explode_outer(settle_spans(F.col("f"), F.col("claimed") if "claimed" in have else None)).alias("x")).where("x is not null")
    return each.select(*key, "x.kind", "x.confidence", "x.rule", "x.start", "x.end", "x.value")


#: Attributes whose address marks an element as a person, and those that name them; fixed values.
IDENTITY, NAMING = ("email", "data-email", "data-hovercard-id"), ("name", "title", "aria-label", "data-name")
DECLARING = ("data-name", "data-user-name", "data-sender")
_FORM_TAGS = "input select textarea form button meta param".split()
_ROBOT = r"^(no-?reply|do-?not-?reply|notifications?|notify|info|support|hello|team|mail|alerts?)$"


def declared_names(nodes: DataFrame, prior: DataFrame | None = None, capture: str = "capture_id") -> DataFrame:
    """(capture, names): the names that a capture's markup declares; with ``prior``
    findings (capture, tier, kind, value, node_id) those of form fields, and names
    spelt in addresses.  Where one name is declared twice the later kind holds."""
    attr = lambda k: F.nullif(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    mail = F.coalesce(*[F.when(attr(a).rlike(rf"^[^@{SPACE}]+@[^@{SPACE}]+\.[A-Za-z]{{2,}}$"), attr(a)) for a in IDENTITY])
    local, domain = F.lower(F.element_at(F.split(mail, "@"), 1)), F.regexp_replace(F.lower(F.element_at(F.split(mail, "@"), 2)), "[^a-z]", "")

    def kind_of(value: Column) -> Column:
        bare = F.regexp_replace(F.lower(value), "[^a-z]", "")
        return F.when(local.rlike(_ROBOT) | ((F.length(bare) > 2) & F.contains(domain, bare)), "org_name").otherwise("person_name")

    def say(value: Column, kind: Column, when: Column) -> Column:
        return F.when(when, F.struct(value.alias("name"), kind.alias("kind")))

    person, has = F.lit("person_name"), mail.isNotNull()
    prop, owner, rel = (F.lower(F.coalesce(attr(a), F.lit(""))) for a in ("itemprop", "itemtype", "rel"))
    text, value, label = (F.nullif(F.col(c), F.lit("")) for c in ("text", "value", "label"))
    said = [say(v, kind_of(v), has) for v in (*(attr(a) for a in NAMING), text)]
    said.append(say(attr("name"), person, ~has & ~F.col("tag").isin(_FORM_TAGS)))
    said += [say(attr(a), person, F.lit(True)) for a in DECLARING]
    said.append(say(F.coalesce(text, value, label), F.when(F.contains(owner, F.lit("organization")), "org_name").otherwise(person), prop.isin("name", "givenname", "familyname")))
    said.append(say(F.coalesce(text, label), person, (prop == "author") | (rel == "author")))
    said.append(say(attr("content"), person, (F.col("tag") == "meta") & (F.lower(attr("name")) == "author")))
    rows = nodes.select(capture, F.struct(F.lit(0).alias("a"), F.col("node_id").cast("long").alias("b")).alias("seq"), F.posexplode(F.array(*said)).alias("pos", "n"))
    rows = rows.select(capture, "seq", "pos", "n.name", "n.kind")
    if prior is not None:
        fields = prior.where("tier = 1 and kind in ('person_name', 'org_name')").select(capture, F.struct(F.lit(1).alias("a"), F.col("node_id").cast("long").alias("b")).alias("seq"), F.lit(0).alias("pos"), F.col("value").alias("name"), "kind")
        parts = F.filter(F.split(F.element_at(F.split("value", "@"), 1), "[._-]+"), lambda p: p.rlike("^[A-Za-z]{3,}$"))
        titled = F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, F.lit(2), F.length(p)))))
        spelt = F.when(F.size(titled) >= 2, F.array(F.array_join(titled, " "), F.element_at(titled, -1)))
        mails = prior.where("kind = 'email'").select(capture, F.struct(F.lit(2).alias("a"), F.col("node_id").cast("long").alias("b")).alias("seq"), F.posexplode(spelt).alias("pos", "name")).withColumn("kind", person)
        rows = rows.unionByName(fields).unionByName(mails)
    name = N.trim_phrase(strip(F.col("name")))
    kept = rows.withColumn("name", name).where(F.length("name").between(3, 60) & F.col("name").rlike("[A-Za-z]") & N.plausible_with_evidence(F.col("name")))
    one = kept.groupBy(capture, "name").agg(F.max_by("kind", F.struct("seq", "pos")).alias("kind"))
    return one.groupBy(capture).agg(F.array_sort(F.collect_list(F.struct("name", "kind"))).cast(NAMES).alias("names"))


#: What stands in a column but is the page's own; a fixed value.
NOT_CELLS = "label button heading th columnheader option textbox select".split()


def name_cells(nodes: DataFrame, capture: str = "capture_id") -> DataFrame:
    """(capture, node_id, cell) of texts that a name header points at: the nearest one
    beside it, and those below until a gap of three rows or three that are no names.
    ``nodes`` has bbox (x, y, w, h); pairs are made of headers alone, within a capture."""
    said = strip(F.coalesce("text", "label"))
    heads = nodes.where(F.length(said).between(1, 30) & N.is_name_header(said) & (F.col("bbox.w") > 0) & (F.col("bbox.h") > 0))
    heads = heads.select(capture, F.col("node_id").alias("head"), F.col("bbox").alias("l"), N.takes_single_word(said).alias("cell"), said.rlike(rf":[{SPACE}]*$").alias("ends"))
    cells = nodes.where((F.coalesce("text", F.lit("")) != "") & ~F.col("role").isin(NOT_CELLS) & ~F.col("tag").isin(NOT_CELLS)).select(capture, "node_id", "text", F.col("bbox").alias("b"))
    pairs = heads.join(cells, capture).where("head <> node_id")
    right = F.col("l.x") + F.col("l.w")
    level = F.abs(F.col("b.y") + F.col("b.h") / 2 - F.col("l.y") - F.col("l.h") / 2) < F.greatest("l.h", "b.h") * 0.6
    beside = pairs.where((F.col("b.x") >= right - 2) & (F.col("b.x") - right < 400) & level)
    nearest = F.row_number().over(Window.partitionBy(capture, "head").orderBy("b.x", "node_id"))
    beside = beside.withColumn("n", nearest).where("n = 1").select(capture, "node_id", "cell")
    centre = F.col("b.x") + F.col("b.w") / 2
    column = (F.abs(F.col("b.x") - F.col("l.x")) <= F.greatest(F.lit(12.0), "l.h")) | ((centre >= F.col("l.x")) & (centre <= right))
    below = pairs.where(~F.col("ends") & (F.col("b.y") > F.col("l.y") + F.col("l.h") * 0.5) & column)
    below = below.withColumn("ok", N.looks_like_name_cell(F.col("text"), F.col("cell")))
    lists = below.groupBy(capture, "head", "cell").agg(F.first("l").alias("l"), F.array_sort(F.collect_list(F.struct(F.col("b.y").alias("y"), "node_id", F.col("b.h").alias("h"), "ok"))).alias("c"))
    start = F.struct((F.col("l.y") + F.col("l.h")).cast("double").alias("bottom"), F.lit(0).alias("misses"), F.lit(False).alias("over"), F.array().cast("array<long>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        over = acc["over"] | (x["y"] - acc["bottom"] > F.greatest(F.col("l.h"), x["h"]) * 3)
        misses = F.when(x["ok"], F.lit(0)).otherwise(acc["misses"] + 1)
        ids = F.when(x["ok"], F.concat(acc["ids"], F.array(x["node_id"].cast("long")))).otherwise(acc["ids"])
        went = F.struct(F.greatest(acc["bottom"], (x["y"] + x["h"]).cast("double")).alias("bottom"), misses.alias("misses"), (misses >= 3).alias("over"), ids.alias("ids"))
        return F.when(over, F.struct(acc["bottom"].alias("bottom"), acc["misses"].alias("misses"), F.lit(True).alias("over"), acc["ids"].alias("ids"))).otherwise(went)

    under = lists.select(capture, F.explode(F.aggregate("c", start, step, lambda acc: acc["ids"])).alias("node_id"), "cell")
    return beside.withColumn("node_id", F.col("node_id").cast("long")).unionByName(under).groupBy(capture, "node_id").agg(F.max("cell").alias("cell"))
