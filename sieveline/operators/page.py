"""Pages as a planner sees them: states, lines under a budget, search, profile, shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .spans import ascii_borders

#: Lines of a page, characters of a label, depth of the indent, hits of a search; fixed values.
MOST_LINES, LABEL, DEPTH, HITS, SHOWN = 400, 160, 8, 12, 90


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def quoted(text: Column) -> Column:
    """As a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def state_words() -> Column:
    """array<string>: what an element's attributes say of its state."""
    checked = F.coalesce(F.try_element_at("attrs", F.lit("checked")), F.try_element_at("attrs", F.lit("aria-checked")))
    on = lambda *names: F.array_contains(F.array(*[_attr(n) for n in names]), "true")
    two = lambda name, yes, no: F.when(_attr(name) == "true", yes).when(_attr(name) == "false", no)
    words = [
        F.when(checked == "true", "checked").when(checked == "false", "unchecked").when(checked == "mixed", "partly-checked"), F.when(on("aria-selected"), "selected"),
        two("aria-pressed", "pressed", "not-pressed"), two("aria-expanded", "expanded", "collapsed"), F.when(on("disabled", "aria-disabled"), "disabled"),
        F.when(on("readonly", "aria-readonly"), "readonly"), F.when(on("required", "aria-required"), "required"), F.when(~_attr("aria-invalid").isin("", "false"), "invalid"),
        F.when(on("focused"), "focused"),
    ]
    return F.array_compact(F.array(*words))


def in_dialog(nodes: DataFrame, capture: str = "capture_id") -> DataFrame:
    """``nodes`` with in_dialog: whether an open dialog is the node or above it.

    Ids are in document order, so a node's subtree is a range: from its id to the
    next id of the same or a lower depth.  Pairs are made of dialogs alone, within a
    capture."""
    opens = F.col("visible") & ((F.col("role") == "dialog") | (_attr("aria-modal") == "true"))
    ends = nodes.withColumn("_opens", opens).where("_opens").select(capture, F.col("node_id").alias("_top"), F.col("depth").alias("_depth"))
    after = nodes.select(capture, F.col("node_id").alias("_next"), F.col("depth").alias("_d"))
    ranges = ends.join(after, capture, "left").groupBy(capture, "_top", "_depth").agg(F.min(F.when((F.col("_next") > F.col("_top")) & (F.col("_d") <= F.col("_depth")), F.col("_next"))).alias("_end"))
    reach = ranges.groupBy(capture).agg(F.collect_list(F.struct("_top", "_end")).alias("_ranges"))
    inside = F.exists("_ranges", lambda r: (F.col("node_id") >= r["_top"]) & (r["_end"].isNull() | (F.col("node_id") < r["_end"])))
    return nodes.join(reach, capture, "left").withColumn("in_dialog", F.coalesce(inside, F.lit(False))).drop("_ranges")


def page_lines(nodes: DataFrame, capture: str = "capture_id", most: int = MOST_LINES) -> DataFrame:
    """One row of each element worth a line: capture, node_id, rank (0 in an open
    dialog, 1 on screen, 2 off screen), shown, line.  The ``most`` best by rank and
    place are shown."""
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("text"), F.lit(""))
    value = F.coalesce(F.col("value"), F.lit(""))
    hints = F.concat(
        F.array_compact(F.array(*[F.when(_attr(a) != "", F.concat(F.lit(f"{shown}="), _attr(a))) for a, shown in (("type", "type"), ("autocomplete", "autocomplete"), ("hrefHost", "href"))])),
        state_words(), F.when(F.col("visible"), F.array().cast("array<string>")).otherwise(F.array(F.lit("offscreen"))),
    )
    head = F.concat(F.repeat(F.lit("  "), F.least(F.col("depth"), F.lit(DEPTH))), F.lit("["), F.col("node_id").cast("string"), F.lit("] "), F.col("role"))
    line = F.concat_ws(
        " ", head, F.when(label != "", quoted(F.left(label, F.lit(LABEL)))), F.when(value != "", F.concat(F.lit("= "), quoted(F.left(value, F.lit(LABEL))))),
        F.when(F.size(hints) > 0, F.concat(F.lit("("), F.array_join(hints, " "), F.lit(")"))),
    )
    worth = (label != "") | (value != "") | ~F.col("role").isin("generic", "document")
    rank = F.when(F.col("in_dialog"), 0).when(F.col("visible"), 1).otherwise(2)
    rows = in_dialog(nodes, capture).where(worth).select(capture, "node_id", rank.alias("rank"), line.alias("line"))
    place = F.row_number().over(Window.partitionBy(capture).orderBy("rank", "node_id"))
    return rows.withColumn("shown", place <= most)


def render_pages(nodes: DataFrame, heads: DataFrame, capture: str = "capture_id", most: int = MOST_LINES) -> DataFrame:
    """(capture, page): the text of each page.  ``heads`` has capture, url, title, scroll_y,
    page_height and optionally content_scroll_y and content_height.  A page's text holds
    ``most`` lines at most; the counts of what did not fit close it."""
    rows = page_lines(nodes, capture, most)
    dropped = lambda r: F.count_if(~F.col("shown") & (F.col("rank") == r))
    body = rows.groupBy(capture).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("node_id", "line")))), lambda x: x["line"]), "\n").alias("_lines"),
        dropped(0).alias("_dialog"), dropped(1).alias("_screen"), dropped(2).alias("_off"),
    )
    opens = in_dialog(nodes, capture).groupBy(capture).agg(F.max("in_dialog").alias("_open"))
    joined = heads.join(body, capture, "left").join(opens, capture, "left")
    inner = F.col("content_height") if "content_height" in heads.columns else F.lit(None).cast("int")
    at = F.coalesce(F.col("content_scroll_y"), F.col("scroll_y")) if "content_scroll_y" in heads.columns else F.col("scroll_y")
    more = lambda c, text: F.when(F.col(c) > 0, F.concat(F.lit("… "), F.col(c).cast("string"), F.lit(text)))
    scroll = F.concat(F.lit("Scroll: "), at.cast("string"), F.lit(" of "), F.coalesce(inner, F.col("page_height")).cast("string"), F.when(inner.isNotNull(), " (this page scrolls an inner panel)").otherwise(""))
    page = F.concat_ws(
        "\n", F.concat(F.lit("URL: "), F.col("url")), F.concat(F.lit("Title: "), F.col("title")), scroll,
        F.when(F.col("_open"), "A dialog is open and is listed first below. Work inside it; the page behind it is not interactive."), F.lit("Elements:"), F.nullif(F.col("_lines"), F.lit("")),
        more("_screen", " more element(s) on screen did not fit"), more("_off", " more element(s) are on the page but off screen; scroll to bring them into view"),
        more("_dialog", " element(s) inside the open dialog did not fit"),
    )
    return joined.select(capture, page.alias("page"))


#: Fields in which a search looks, in order; a fixed value.
SEARCHED = ["label", "value", "text", "attr:placeholder", "attr:aria-label", "attr:title"]


def find_text(nodes: DataFrame, phrase: Column, capture: str = "capture_id", most: int = HITS) -> DataFrame:
    """(capture, node_id, field, hit): the first ``most`` nodes of a capture whose fields
    hold the phrase, whatever its case, each with its first such field."""
    needle = F.lower(strip(phrase))
    value = lambda f: F.coalesce(_attr(f[5:]) if f.startswith("attr:") else F.col(f), F.lit(""))
    fields = F.array(*[F.struct(F.lit(f.removeprefix("attr:")).alias("field"), value(f).alias("hit")) for f in SEARCHED])
    found = F.try_element_at(F.filter(fields, lambda x: F.contains(F.lower(x["hit"]), needle)), F.lit(1))
    rows = nodes.withColumn("_x", F.when(needle != "", found)).where("_x is not null")
    place = F.row_number().over(Window.partitionBy(capture).orderBy("node_id"))
    shown = F.when(F.length("_x.hit") > SHOWN, F.concat(F.left("_x.hit", F.lit(SHOWN)), F.lit("…"))).otherwise(F.col("_x.hit"))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).select(capture, "node_id", F.col("_x.field").alias("field"), shown.alias("hit"))


# What tells a search box, a payment field, a price and a basket; fixed values.
_SEARCH_NAMES, _PAYMENT = r"(?i)^(q|query|search|s|keyword|k)$", r"(?i)card.?number|cvv|cvc|upi"
_PRICE, _BASKET = r"(?:₹|Rs\.?|INR|\$|€|£)\s?\d[\d,]*(?:\.\d{2})?", r"\b(add to (?:cart|bag|basket)|your (?:cart|bag|basket)|proceed to (?:checkout|buy))\b"
MOST_PRICES, LONG_PARAGRAPH, PARAGRAPHS, TABLE_ROWS = 50, 80, 5, 3


def page_profiles(nodes: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Ten facts of each page: search, fields, login, payment, article, tables, prices,
    video, cart, pdf.  Without layout every node counts as visible; ``pdf`` is told by
    a column ``url``, if there is one.  Prices count up to 50."""
    kind, words = F.lower(_attr("type")), F.concat_ws(" ", _attr("aria-label"), F.col("label"), _attr("placeholder"))
    box = F.col("tag").isin("input", "textarea", "select") & ~((F.col("tag") == "input") & kind.isin("hidden", "submit", "button", "image", "reset"))
    search = box & ((kind == "search") | (F.col("role") == "searchbox") | _attr("name").rlike(_SEARCH_NAMES) | words.rlike("(?i)search"))
    plain = box & ~search & ~kind.isin("checkbox", "radio")
    pays = box & (_attr("autocomplete").rlike("cc-number|cc-csc|cc-exp") | F.concat_ws(" ", _attr("name"), words).rlike(_PAYMENT))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows_of = nodes.where("tag = 'tr' or role = 'row'").groupBy(capture, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_rows")) if "parent_id" in nodes.columns else None
    table = F.col("tag").isin("table", "tbody") | F.col("role").isin("grid", "table")
    joined = nodes.join(rows_of, [capture, "node_id"], "left") if rows_of is not None else nodes.withColumn("_rows", F.lit(0))
    long = (F.col("tag") == "p") & (F.length(strip(text)) > LONG_PARAGRAPH)
    out = joined.groupBy(capture).agg(
        F.max(search).alias("search"), F.count_if(plain).alias("fields"), F.max(box & (kind == "password")).alias("login"), F.max(pays).alias("payment"),
        (F.max(F.col("tag") == "article") | (F.count_if(long) >= PARAGRAPHS)).alias("article"), F.count_if(table & (F.coalesce("_rows", F.lit(0)) >= TABLE_ROWS)).alias("tables"),
        F.least(F.lit(MOST_PRICES).cast("long"), F.sum(F.regexp_count(text, F.lit(ascii_borders(_PRICE))))).alias("prices"), F.max(F.col("tag") == "video").alias("video"),
        F.max(text.rlike(f"(?i){ascii_borders(_BASKET)}")).alias("cart"),
        (F.max(F.lower("url").rlike(r"\.pdf($|\?)")) if "url" in nodes.columns else F.lit(False)).alias("pdf"),
    )
    return out


def page_shapes(nodes: DataFrame, capture: str = "capture_id") -> DataFrame:
    """(capture, shape): a digest of ids, tags, roles and numbers of children in document
    order.  Two captures of one URL, scroll place and viewport with equal shapes are
    consistent: texts may differ, no element has moved."""
    children = nodes.where("parent_id is not null").groupBy(capture, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_n"))
    rows = nodes.join(children, [capture, "node_id"], "left")
    each = F.struct("node_id", F.concat_ws(":", F.col("node_id").cast("string"), "tag", "role", F.coalesce("_n", F.lit(0)).cast("string")).alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["s"]), "|")
    return rows.groupBy(capture).agg(F.sha2(whole, 256).alias("shape"))


def consistent(before: DataFrame, after: DataFrame, capture: str = "capture_id") -> DataFrame:
    """(capture, consistent) of two states of captures, each with url, scroll_x, scroll_y,
    width, height and shape; a capture that is missing on one side is not consistent."""
    same = ["url", "scroll_x", "scroll_y", "width", "height", "shape"]
    state = lambda df: df.select(capture, F.struct(*same).alias("s"))
    both = state(before).withColumnRenamed("s", "a").join(state(after).withColumnRenamed("s", "b"), capture, "full")
    return both.select(capture, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("consistent"))


def all_text(nodes: DataFrame, capture: str = "capture_id") -> DataFrame:
    """(capture, text): texts and values in document order, one a line."""
    each = F.struct("node_id", F.concat_ws("\n", F.nullif("text", F.lit("")), F.nullif("value", F.lit(""))).alias("t"))
    parts = F.filter(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), lambda t: t != "")
    return nodes.groupBy(capture).agg(F.array_join(parts, "\n").alias("text"))


__all__ = ["all_text", "consistent", "find_text", "in_dialog", "page_lines", "page_profiles", "page_shapes", "render_pages", "state_words"]
