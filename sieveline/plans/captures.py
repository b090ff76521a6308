"""Queries over captures, runs, logs and preferences, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import burn_box, project, unproject
from ..functions.checks import verhoeff_check_digit
from ..functions.text import tokens_in
from ..operators.actions import fold_events, leak_totals, parse_arguments, recent_history, repeat_guard, scroll_effect, settled_at, wire_records
from ..operators.align import align_requests
from ..operators.capture import detect, detection_stats, field_rows, suppress_covered, text_nodes
from ..operators.entities import name_cells
from ..operators.ocr import approximate_matches, distinct_boxes, flatten_blocks, in_tree, joined_lines, known_values, segments
from ..operators.page import consistent, find_text, in_dialog, page_lines, page_profiles, page_shapes, state_words
from ..operators.preferences import category_scores, preferred_sites
from ..operators.sanitize import burn_report, residual, sanitize_texts
from ..operators.usage import counted_visits
from ..operators.vault import rewrite_texts
from ..sources.html import html_nodes
from . import session

_table = session._table


def _user_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the nodes of a page of each user, in the order of their ids: a signup
    opens a dialog that holds what follows until the next node of its depth."""
    e, kind = _table(spark, sf_dir, "events"), F.col("event_type")
    role = F.when(kind == "signup", "dialog").when(kind == "error", "generic").when(kind == "click", "button").otherwise("textbox")
    attrs = F.create_map(F.lit("placeholder"), F.col("props"), F.lit("checked"), F.when(kind == "click", F.when(F.col("value") > 50, "true").otherwise("false")).otherwise(""), F.lit("required"), (F.col("event_id") % 3 == 0).cast("string"))
    return e.select(
        F.col("user_id").alias("capture_id"), F.col("event_id").alias("node_id"), F.lit("div").alias("tag"), role.alias("role"), F.when(kind != "error", F.concat(kind, F.lit(" "), F.col("event_id").cast("string"))).otherwise("").alias("label"),
        F.lit(None).cast("string").alias("text"), F.when(kind == "view", F.col("event_id").cast("string")).alias("value"), attrs.alias("attrs"), (F.when(kind == "signup", 1).otherwise(F.col("event_id") % 3 + 1)).cast("int").alias("depth"),
        (F.col("event_id") % 4 != 0).alias("visible"),
    )


def dialog_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_dialog(_user_nodes(spark, sf_dir)).select("capture_id", "node_id", "in_dialog")


def budgeted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best lines of each page, in document order."""
    return page_lines(_user_nodes(spark, sf_dir), most=25).where("shown").select("capture_id", "node_id", "rank", "line")


def element_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_nodes(spark, sf_dir).select("node_id", F.array_join(state_words(), " ").alias("states"))


def text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve nodes of each page that hold a phrase, and in which field."""
    return find_text(_user_nodes(spark, sf_dir), F.lit("1"))


def scanned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_rows(_user_nodes(spark, sf_dir)).select("node_id", "field", "ord", "text")


def guarded_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeat guard over events: errors only read, a purchase changes the page."""
    kind = F.col("event_type")
    name = F.when(kind == "error", "read_page").otherwise(kind)
    out = repeat_guard(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], name, kind, kind == "purchase")
    return out.select("event_id", "repeats", "stopped", scroll_effect(F.when(kind == "view", "scroll").otherwise(name)).alias("effect"))


def event_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of calls, read leniently: every seventh is broken, every eleventh no object."""
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("{oops")).when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.col("props"))
    return _table(spark, sf_dir, "events").select("event_id", F.try_element_at(parse_arguments(raw), F.lit("k")).alias("k"))


def folded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as one text: a signup enters, a purchase replaces, all else appends."""
    e = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "entry").when(F.col("event_type") == "purchase", "replace").otherwise("append")
    return fold_events(e.select("user_id", "event_id", kind.alias("kind"), F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("text")), ["user_id"], "event_id", "kind", "text")


def quiet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the changes of a page settle; lines of an order stand for changes."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") / 16).alias("s"))
    return settled_at(li, ["l_orderkey"], "s").select("l_orderkey", "settled")


def sent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a log: its last records, their tokens and characters."""
    c = _table(spark, sf_dir, "conversations")
    text = F.concat(F.col("text"), F.lit(" <NAME_"), F.col("turn").cast("string"), F.lit("> <EMAIL_1>"))
    sent = c.select("conv_id", "turn", F.array(F.struct("role", text.alias("text"))).alias("messages"), F.lit(10).alias("system_chars"))
    return wire_records(sent, "conv_id", "turn").select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"), "total_chars")


def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", F.length("text").cast("long").alias("total_chars"), F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("leaked"))
    return leak_totals(rows, "conv_id")


def kept_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_history(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "text", "shown")


def _site_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf_dir, "events").withColumn("host", F.concat(F.lit("h"), (F.col("event_id") % 5).cast("string"))).withColumnRenamed("event_type", "category")
    counts = counted_visits(e, ["user_id", "category", "host"], "ts", F.lit(True))
    pins = e.where("event_id % 40 = 0").select("user_id", "category", F.lit("h9").alias("host")).distinct()
    return counts, pins


def kind_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_scores(*_site_counts(spark, sf_dir), "user_id")


def usual_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferred_sites(*_site_counts(spark, sf_dir), "user_id").select("user_id", "category", "place", "host", "pinned", "tasks")


def aligned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that name a customer and a nation, in which both become tokens."""
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("ship to "), F.lower("n_name"), F.lit(" for "), F.col("c_name"), F.lit(", xNATION_1y"))
    vault = n.select(F.col("n_nationkey").alias("session"), F.col("n_name").alias("value"), F.concat(F.lit("<ORG_"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("token"))
    people = c.select(F.col("c_nationkey").alias("session"), F.col("c_name").alias("value"), F.concat(F.lit("<NAME_"), F.col("c_custkey").cast("string"), F.lit(">")).alias("token"))
    return align_requests(rows.select("c_custkey", F.col("c_nationkey").alias("session"), text.alias("text")), vault.unionByName(people), "session", "text").select("c_custkey", "text")


def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check digit of each order's number, found by trying: just one fits."""
    from ..functions.checks import verhoeff

    key = F.lpad(F.col("o_orderkey").cast("string"), 11, "0")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", key.alias("k")).withColumn("d", verhoeff_check_digit(F.col("k")))
    fits = sum((verhoeff(F.concat(F.col("k"), F.lit(str(i)))).cast("int") for i in range(10)), F.lit(0))
    return rows.select("o_orderkey", verhoeff(F.concat("k", "d")).alias("valid"), fits.alias("fits"))


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def burnt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of order lines, in a picture of 600 x 400 pixels at twice the size."""
    li = _table(spark, sf_dir, "lineitem")
    box = _box(F.col("l_partkey") % 500 - 100, F.col("l_suppkey") * 7 % 300 - 50, F.col("l_linenumber") * 10 - 10, F.col("l_quantity"))
    view = F.struct(F.lit(0.0).alias("scroll_x"), F.lit(20.0).alias("scroll_y"))
    shot = F.struct(F.lit(0.0).alias("origin_x"), F.lit(10.0).alias("origin_y"), F.lit(2.0).alias("scale"))
    back = unproject(project(box, view, shot), view, shot)
    return li.select("l_orderkey", "l_linenumber", burn_box(box, view, shot, F.lit(600), F.lit(400)).alias("b"), (back == box).alias("same")).select("l_orderkey", "l_linenumber", "b.*", "same")


def burnt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was burned, by order."""
    return burn_report(burnt_boxes(spark, sf_dir), "l_orderkey")


def rewritten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tokens for addresses, numbered by first appearance, where there are any."""
    docs, found, vault = session._vault_parts(spark, sf_dir)
    safe = rewrite_texts(docs, found, vault, ["doc_id"], "doc_id", "text")
    return safe.join(found.select("doc_id").distinct(), "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size(tokens_in(F.col("text"))).alias("n_tokens"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as lines of blocks of ten, with zeros read as O."""
    s = _table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("from "), F.translate("s_name", "0", "O"), F.lit(" to us"))
    return s.select(F.lit(1).alias("capture_id"), F.floor(F.col("s_suppkey") / 10).alias("block_id"), (F.col("s_suppkey") % 10).alias("line_no"), text.alias("text"), "s_name")


def misread_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers' names, known from elsewhere, in the lines of all suppliers with misread
    digits.  A line ends with its name, as a word behind it could stand for digits."""
    lines = _lines(spark, sf_dir).withColumn("text", F.concat(F.lit("from "), F.translate("s_name", "0", "O")))
    known = known_values(lines.select("capture_id", F.col("s_name").alias("value"), F.lit("org_name").alias("kind"), (F.col("block_id") * 10 + F.col("line_no")).alias("seq")))
    return approximate_matches(lines, known).select("block_id", "line_no", "start", "end", "value", "kind")


def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined to blocks, and characters 3 to 40 of each block in its lines."""
    rows = joined_lines(_lines(spark, sf_dir)).withColumn("s", F.explode(segments(F.col("starts"), F.lit(3), F.lit(40))))
    return rows.select("block_id", F.length("text").alias("n"), "s.line_no", "s.start", "s.end")


def lines_in_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the page holds already: whole fields, or parts of twelve characters and more."""
    lines = _table(spark, sf_dir, "part").select(F.lit(1).alias("capture_id"), "p_partkey", F.upper("p_name").alias("text"))
    nodes = _table(spark, sf_dir, "part").where("p_partkey < 20").select(F.lit(1).alias("capture_id"), F.concat(F.lit("the "), F.col("p_name")).alias("text"), F.lit("cold widget").alias("label"), F.lit(None).cast("string").alias("value"))
    return in_tree(lines, nodes).select("p_partkey", "in_tree")


def distinct_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of one value at nearly one place count once; order lines stand for them."""
    li = _table(spark, sf_dir, "lineitem")
    box = F.struct(*[(F.col("l_quantity") * i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    rows = li.select(F.lit(1).alias("capture_id"), F.col("l_partkey").alias("block_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("value"), F.col("l_orderkey").alias("line_no"), F.col("l_linenumber").alias("start"), box.alias("box"))
    return distinct_boxes(rows).groupBy("block_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def flat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recogniser's tree of blocks, paragraphs, lines and words, made of order lines: a word is doubtful under 5."""
    li = _table(spark, sf_dir, "lineitem")
    box = F.struct(F.col("l_linenumber").alias("x0"), F.lit(0).cast("long").alias("y0"), (F.col("l_linenumber") + 5).alias("x1"), F.lit(9).cast("long").alias("y1"))
    word = F.struct(F.col("l_linenumber").alias("o"), F.col("l_partkey").alias("p"), F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("text"), F.col("l_quantity").alias("confidence"), box.alias("bbox"))
    tree = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(word)).alias("words"))
    blocks = F.array(F.struct(F.array(F.struct(F.array(F.struct("words")).alias("lines"))).alias("paragraphs")))
    out = tree.select("l_orderkey", F.explode(flatten_blocks(blocks)).alias("l"))
    return out.select("l_orderkey", F.length("l.text").alias("n"), F.size("l.words").alias("words"), "l.x0", "l.x1")


def column_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells under a header of names: order lines as a column of cells, 20 pixels each; a
    status O is no name, three in a row end the column."""
    li = _table(spark, sf_dir, "lineitem")
    n = F.row_number().over(session_window("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    box = lambda y: F.struct(F.lit(0.0).alias("x"), y.cast("double").alias("y"), F.lit(80.0).alias("w"), F.lit(18.0).alias("h"))
    empty = [F.lit("").alias("label")]
    cells = li.select(F.col("l_orderkey").alias("capture_id"), n.alias("node_id"), F.lit("td").alias("tag"), F.lit("cell").alias("role"), F.when(F.col("l_linestatus") == "O", "Order 1").otherwise("Vikram Seth").alias("text"), *empty, box(n * 20).alias("bbox"))
    heads = li.select(F.col("l_orderkey").alias("capture_id")).distinct().select("capture_id", F.lit(0).alias("node_id"), F.lit("th").alias("tag"), F.lit("columnheader").alias("role"), F.lit("Customer").alias("text"), *empty, box(F.lit(0)).alias("bbox"))
    return name_cells(cells.unionByName(heads)).select("capture_id", "node_id")


def session_window(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return page_profiles(html_nodes(pages, "page_id", "html"), "page_id").select("page_id", "search", "fields", "login", "article", "video", "cart", "pdf")


def unmoved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages captured twice: with other digits in their texts, and every second with one more heading."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    later = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", ">([^<]*)[0-9]([^<]*)<", ">$1 7 $2<")).otherwise(F.replace("html", F.lit("</body>"), F.lit("<h1>more</h1></body>")))

    def state(df: DataFrame) -> DataFrame:
        same = [F.lit(0).alias(c) for c in ("scroll_x", "scroll_y", "width", "height")]
        return df.select("page_id", "url", *same).join(page_shapes(html_nodes(df, "page_id", "html"), "page_id"), "page_id", "left")

    return consistent(state(pages), state(pages.withColumn("html", later)), "page_id")


def safe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages with addresses and names put in, made safe: nothing is left to find."""
    b = _table(spark, sf_dir, "benchmark")
    text = F.concat(F.lit("Dear Rahul Verma,\nmail a"), F.col("item_id").cast("string"), F.lit("@x.example.com or call +91 98765 43210 from 10.0.0.1. Password: Tiger@2024!\n"), F.lower("text"))
    out = sanitize_texts(b.select("item_id", text.alias("text")), "item_id", "text")
    left = residual(out["nodes"]).select(F.col("capture_id").alias("item_id"), F.lit(1).alias("one"))
    told = out["report"].select(F.col("capture_id").alias("item_id"), "spans_replaced", "spans_skipped")
    first = out["texts"].select("item_id", F.element_at(F.split("text", "\n"), 2).alias("line"))
    return first.join(told, "item_id").join(left.groupBy("item_id").agg(F.sum("one").alias("left")), "item_id", "left").select("item_id", "line", "spans_replaced", "spans_skipped", F.coalesce("left", F.lit(0)).cast("int").alias("left"))


def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of detection over benchmark passages with a known value each."""
    b = _table(spark, sf_dir, "benchmark")
    put = F.when(F.col("item_id") % 3 == 0, "mail a@x.example.com").when(F.col("item_id") % 3 == 1, "card 4111 1111 1111 1112").otherwise("Dear Rahul Verma")
    nodes = text_nodes(b.select("item_id", F.concat(put, F.lit("\n"), F.lower("text")).alias("text")), "item_id", "text")
    stats = detection_stats(nodes, detect(nodes)).select(F.col("capture_id").alias("item_id"), "nodes_scanned", "chars_scanned", "tier_1", "tier_2", "tier_3", "checksum_rejected")
    return stats.select("item_id", "nodes_scanned", "chars_scanned", "tier_1", "tier_2", "tier_3", (F.col("checksum_rejected") > 0).alias("rejected"))


def uncovered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which findings stay beside those of form fields; order lines stand for findings."""
    li = _table(spark, sf_dir, "lineitem")
    tier = F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") < 5, 2).otherwise(3)
    sure = F.when(F.col("l_quantity") > 25, "certain").otherwise("high")
    found = li.select(F.col("l_orderkey").alias("capture_id"), (F.col("l_partkey") % 2).alias("node_id"), F.lit("text").alias("field"), tier.alias("tier"), sure.alias("confidence"), "l_linenumber", "l_suppkey")
    return suppress_covered(found).select("capture_id", "node_id", "tier", "confidence", "l_linenumber", "l_suppkey")


QUERIES = {
    f.__name__: f
    for f in (
        dialog_nodes, budgeted_lines, element_states, text_hits, scanned_fields, guarded_actions, event_arguments, folded_events, quiet_pages, sent_records, log_totals, kept_history, kind_scores, usual_sites,
        aligned_orders, check_digits, burnt_boxes, burnt_pages, rewritten_documents, misread_suppliers, block_texts, lines_in_tree, distinct_reads, flat_lines, column_cells, page_facts, unmoved_pages, safe_documents, detection_counts, uncovered_findings,
    )
}

_NODES = """n AS (SELECT user_id AS capture_id, event_id AS node_id, event_type AS k, CASE WHEN event_type = 'signup' THEN 1 ELSE event_id % 3 + 1 END AS depth, event_id % 4 <> 0 AS visible, value AS v, props FROM events)"""
_DIALOG = """d AS (SELECT a.capture_id, a.node_id AS top, min(CASE WHEN b.node_id > a.node_id AND b.depth <= a.depth THEN b.node_id END) AS stop FROM n a JOIN n b USING (capture_id) WHERE a.k = 'signup' AND a.visible GROUP BY ALL),
    i AS (SELECT n.*, EXISTS (SELECT 1 FROM d WHERE d.capture_id = n.capture_id AND n.node_id >= top AND (stop IS NULL OR n.node_id < stop)) AS in_dialog FROM n)"""
_STATES = "concat_ws(' ', CASE WHEN k = 'click' THEN CASE WHEN v > 50 THEN 'checked' ELSE 'unchecked' END END, CASE WHEN node_id % 3 = 0 THEN 'required' END)"
_SITES = """u AS (SELECT user_id, event_type AS category, 'h' || (event_id % 5) AS host, count(*) AS tasks, max(ts) AS last FROM events GROUP BY ALL),
    p AS (SELECT DISTINCT user_id, event_type AS category FROM events WHERE event_id % 40 = 0)"""
_BURNT = """WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 500 - 100)::DOUBLE AS x, (l_suppkey * 7 % 300 - 50)::DOUBLE AS y, (l_linenumber * 10 - 10)::DOUBLE AS w, l_quantity AS h FROM lineitem),
        p AS (SELECT *, floor(2 * x) - 3 AS l, floor(2 * (y + 10)) - 3 AS t, ceil(2 * w) + 6 AS pw, ceil(2 * h) + 6 AS ph FROM b),
        c AS (SELECT *, greatest(0, l) AS x0, greatest(0, t) AS y0, least(600, l + pw) AS x1, least(400, t + ph) AS y1 FROM p),
        f AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN 'skipped' WHEN x1 <= x0 OR y1 <= y0 THEN 'outside' ELSE 'burned' END AS fate FROM c)
        SELECT l_orderkey, l_linenumber, fate, CASE WHEN fate = 'burned' THEN x0::BIGINT END AS x, CASE WHEN fate = 'burned' THEN y0::BIGINT END AS y, CASE WHEN fate = 'burned' THEN (x1 - x0)::BIGINT END AS w,
        CASE WHEN fate = 'burned' THEN (y1 - y0)::BIGINT END AS h, true AS same FROM f"""
ORACLE_SQL = {
    "dialog_nodes": f"WITH {_NODES}, {_DIALOG} SELECT capture_id, node_id, in_dialog FROM i",
    "budgeted_lines": f"""WITH {_NODES}, {_DIALOG},
        l AS (SELECT capture_id, node_id, CAST(CASE WHEN in_dialog THEN 0 WHEN visible THEN 1 ELSE 2 END AS INTEGER) AS rank, CASE k WHEN 'signup' THEN 'dialog' WHEN 'click' THEN 'button' ELSE 'textbox' END AS role, k, v, depth, visible,
            concat_ws(' ', nullif({_STATES}, ''), CASE WHEN NOT visible THEN 'offscreen' END) AS hints FROM i WHERE k <> 'error'),
        r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY rank, node_id) AS place FROM l)
        SELECT capture_id, node_id, rank, repeat('  ', depth) || '[' || node_id || '] ' || role || ' "' || k || ' ' || node_id || '"' || CASE WHEN k = 'view' THEN ' = "' || node_id || '"' ELSE '' END || CASE WHEN hints <> '' THEN ' (' || hints || ')' ELSE '' END AS line
        FROM r WHERE place <= 25""",
    "element_states": f"WITH {_NODES} SELECT node_id, {_STATES} AS states FROM n",
    "text_hits": f"""WITH {_NODES}, h AS (SELECT capture_id, node_id, CASE WHEN k <> 'error' AND contains(k || ' ' || node_id, '1') THEN 'label' WHEN contains(props, '1') THEN 'placeholder' END AS field, CASE WHEN k <> 'error' AND contains(k || ' ' || node_id, '1') THEN k || ' ' || node_id ELSE props END AS hit FROM n),
        r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY node_id) AS place FROM h WHERE field IS NOT NULL) SELECT capture_id, node_id, field, hit FROM r WHERE place <= 12""",
    "scanned_fields": f"""WITH {_NODES} SELECT node_id, 'label' AS field, CAST(2 AS INTEGER) AS ord, k || ' ' || node_id AS text FROM n WHERE k <> 'error' UNION ALL SELECT node_id, 'value', 1, CAST(node_id AS VARCHAR) FROM n WHERE k = 'view'
        UNION ALL SELECT node_id, 'attr:placeholder', 5, props FROM n""",
    "guarded_actions": """WITH e AS (SELECT *, event_type <> 'error' AS counted, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM events),
        c AS (SELECT event_id, list(event_type) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS l, event_type FROM e WHERE counted),
        r AS (SELECT event_id, CAST(len(list_filter(l, lambda x: x = event_type)) AS BIGINT) AS repeats FROM c)
        SELECT e.event_id, coalesce(repeats, 0) AS repeats, coalesce(repeats, 0) > 3 AS stopped, CASE event_type WHEN 'view' THEN 'scroll' WHEN 'error' THEN 'look' ELSE 'act' END AS effect FROM e LEFT JOIN r USING (event_id)""",
    "event_arguments": "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE regexp_extract(props, '[0-9]+') END AS k FROM events",
    "folded_events": """WITH s AS (SELECT *, max(CASE WHEN event_type IN ('signup', 'purchase') THEN event_id END) OVER (PARTITION BY user_id) AS start FROM events)
        SELECT user_id, string_agg(event_id || ';', '' ORDER BY event_id) AS text FROM s WHERE start IS NULL OR event_id >= start GROUP BY user_id""",
    "quiet_pages": """WITH a AS (SELECT l_orderkey, l_quantity / 16 AS s FROM lineitem), g AS (SELECT *, lead(s) OVER (PARTITION BY l_orderkey ORDER BY s) AS nxt, min(s) OVER (PARTITION BY l_orderkey) AS first FROM a WHERE s <= 3),
        f AS (SELECT l_orderkey, CASE WHEN min(first) > 0.25 THEN 0.25 ELSE least(coalesce(min(CASE WHEN coalesce(nxt, 1e9) - s >= 0.12 THEN s + 0.12 END), 3.0), 3.0) END AS t FROM g GROUP BY l_orderkey)
        SELECT l_orderkey, CAST(coalesce(t, 3.0) AS DOUBLE) AS settled FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN f USING (l_orderkey)""",
    "sent_records": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
        SELECT conv_id, turn, '<EMAIL_1> <NAME_' || turn || '>' AS tokens, CAST(length(text || ' <NAME_' || turn || '> <EMAIL_1>') + 10 AS BIGINT) AS total_chars FROM r WHERE back <= 24""",
    "log_totals": "SELECT conv_id, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS leaks FROM conversations GROUP BY conv_id",
    "kept_history": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, turn, left(text, 600) AS text, back <= 4 AS shown FROM r WHERE back <= 6",
    "kind_scores": f"WITH {_SITES}, c AS (SELECT user_id, category, sum(3 * tasks) AS s FROM u GROUP BY ALL) SELECT user_id, category, CAST(s + CASE WHEN p.user_id IS NULL THEN 0 ELSE 1000 END AS BIGINT) AS score FROM c LEFT JOIN p USING (user_id, category)",
    "usual_sites": f"""WITH {_SITES}, a AS (SELECT user_id, category, host, false AS pinned, CAST(tasks AS BIGINT) AS tasks, last FROM u UNION ALL SELECT user_id, category, 'h9', true, 0, NULL FROM p),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, category ORDER BY pinned DESC, tasks DESC, last DESC, host) AS INTEGER) AS place FROM a) SELECT user_id, category, place, host, pinned, tasks FROM r WHERE place <= 3""",
    "aligned_orders": "SELECT c_custkey, 'ship to <ORG_' || c_nationkey || '> for <NAME_' || c_custkey || '>, xNATION_1y' AS text FROM customer",
    "check_digits": "SELECT o_orderkey, true AS valid, CAST(1 AS INTEGER) AS fits FROM orders",
    "burnt_boxes": _BURNT,
    "burnt_pages": f"""SELECT l_orderkey, count(*) FILTER (fate = 'burned') AS regions_burned, count(*) FILTER (fate = 'outside') AS regions_outside, count(*) FILTER (fate = 'skipped') AS regions_skipped,
        CAST(coalesce(sum(w * h), 0) AS BIGINT) AS pixels_burned FROM ({_BURNT}) GROUP BY l_orderkey""",
    # longer values first, so that none is replaced inside another
    "rewritten_documents": f"""WITH v AS ({session.ORACLE_SQL["vault_tokens"]}),
        l AS (SELECT doc_id, list({{'value': value, 'token': token}} ORDER BY length(value) DESC) AS pairs, CAST(count(*) AS INTEGER) AS n_tokens FROM v GROUP BY doc_id)
        SELECT doc_id, sha256(list_reduce(list_prepend({{'value': text, 'token': ''}}, pairs), lambda acc, p: {{'value': replace(acc.value, p.value, p.token), 'token': ''}}).value) AS text_sha256, n_tokens FROM documents JOIN l USING (doc_id)""",
    "misread_suppliers": """SELECT a.s_suppkey // 10 AS block_id, a.s_suppkey % 10 AS line_no, CAST(5 AS INTEGER) AS start, CAST(23 AS INTEGER) AS "end", b.s_name AS value, 'org_name' AS kind
        FROM supplier a JOIN supplier b ON levenshtein(a.s_name, b.s_name) <= 2""",
    "block_texts": """WITH l AS (SELECT s_suppkey // 10 AS block_id, s_suppkey % 10 AS line_no, length('from ' || s_name || ' to us') AS n FROM supplier),
        p AS (SELECT *, sum(n + 1) OVER (PARTITION BY block_id ORDER BY line_no) - n - 1 AS pos, sum(n) OVER (PARTITION BY block_id) + count(*) OVER (PARTITION BY block_id) - 1 AS total FROM l)
        SELECT block_id, CAST(total AS INTEGER) AS n, line_no, CAST(greatest(3, pos) - pos AS INTEGER) AS start, CAST(least(40, pos + n) - pos AS INTEGER) AS "end" FROM p WHERE pos < 40 AND pos + n > 3""",
    "lines_in_tree": """SELECT p_partkey, lower(p_name) = 'cold widget' OR EXISTS (SELECT 1 FROM part q WHERE q.p_partkey < 20 AND lower(p.p_name) = lower('the ' || q.p_name)) OR (length(p_name) >= 12 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey < 20 AND contains(lower('the ' || q.p_name), lower(p.p_name)))) AS in_tree FROM part p""",
    "distinct_reads": "SELECT block_id, kind, value, count(*) AS n FROM (SELECT DISTINCT l_partkey AS block_id, l_returnflag AS kind, l_linestatus AS value, round(l_quantity / 3) AS b, round(l_quantity * 2 / 3) AS c, round(l_quantity * 3 / 3) AS d FROM lineitem) GROUP BY ALL",
    "flat_lines": """SELECT l_orderkey, CAST(sum(length(CAST(l_partkey AS VARCHAR)) + 1) - 1 AS INTEGER) AS n, CAST(count(*) AS INTEGER) AS words, min(l_linenumber) AS x0, max(l_linenumber) + 5 AS x1 FROM lineitem WHERE l_quantity >= 5 GROUP BY l_orderkey""",
    "column_cells": """WITH c AS (SELECT l_orderkey AS capture_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS node_id, l_linestatus <> 'O' AS ok FROM lineitem),
        m AS (SELECT *, min(CASE WHEN three THEN node_id END) OVER (PARTITION BY capture_id) AS stop FROM (SELECT *, NOT ok AND NOT lag(ok, 1, true) OVER w AND NOT lag(ok, 2, true) OVER w AS three FROM c WINDOW w AS (PARTITION BY capture_id ORDER BY node_id)))
        SELECT capture_id, node_id FROM m WHERE ok AND (stop IS NULL OR node_id < stop)""",
    "page_facts": """SELECT page_id, false AS search, CAST(0 AS BIGINT) AS fields, false AS login, contains(html, '<article') OR len(list_filter(regexp_extract_all(html, '<p[^>]*>([^<]*)', 1), lambda x: length(trim(x)) > 80)) >= 5 AS article, false AS video, false AS cart, false AS pdf FROM pages""",
    "unmoved_pages": "SELECT page_id, page_id % 2 = 0 OR NOT contains(html, '</body>') AS consistent FROM pages",
    "safe_documents": "SELECT item_id, 'mail <EMAIL_1> or call <PHONE_1> from <IP_1>. Password: <SECRET_1>' AS line, CAST(5 AS BIGINT) AS spans_replaced, CAST(0 AS BIGINT) AS spans_skipped, CAST(0 AS INTEGER) AS \"left\" FROM benchmark",
    "detection_counts": """SELECT item_id, CAST(1 AS BIGINT) AS nodes_scanned, CAST(length(text) + 1 + CASE item_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 24 ELSE 16 END AS BIGINT) AS chars_scanned, CAST(0 AS BIGINT) AS tier_1,
        CAST(CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS tier_2, CAST(CASE WHEN item_id % 3 = 2 THEN 1 ELSE 0 END AS BIGINT) AS tier_3, item_id % 3 = 1 AS rejected FROM benchmark""",
    "uncovered_findings": """WITH f AS (SELECT l_orderkey AS capture_id, l_partkey % 2 AS node_id, CAST(CASE WHEN l_linenumber = 1 THEN 1 WHEN l_linenumber < 5 THEN 2 ELSE 3 END AS INTEGER) AS tier, CASE WHEN l_quantity > 25 THEN 'certain' ELSE 'high' END AS confidence, l_linenumber, l_suppkey FROM lineitem),
        s AS (SELECT DISTINCT capture_id, node_id FROM f WHERE tier = 1 AND confidence = 'certain')
        SELECT f.* FROM f LEFT JOIN s USING (capture_id, node_id) WHERE tier <> 2 OR confidence = 'certain' OR s.capture_id IS NULL""",
}
