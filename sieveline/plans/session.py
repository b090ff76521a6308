"""Queries on vaults, pages, usage and form values, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fit import iso_date, iso_time, plain_number
from ..functions.text import SEARCH, collapse, fold, normalise_url
from ..operators.asof import as_of, generations, valid_actions
from ..operators.rules import RULES, scan_text
from ..operators.usage import counted_visits, keep_newest_page, preferred, scroll_budget
from ..operators.vault import mint_tokens, restore_texts, rewrite_texts
from ..operators.vault_store import VaultTable
from ..sources.capture_files import captured_nodes, read_captures
from ..sources.html import html_nodes
from ..store import shared_folder, stored

BY_NUMBER = {r.number: r for r in RULES}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vault_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_text(docs, "doc_id", "text", [BY_NUMBER[9], BY_NUMBER[29]])
    return docs, found, mint_tokens(found, "doc_id", ["start"])


def vault_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vault of each document, as a table for checking; a sink takes ``vault_view``."""
    return _vault_parts(spark, sf_dir)[2].drop("fingerprint")


def vault_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts rewritten with tokens, joined to their labels and restored behind that join;
    each comes back whole and beside its own labels."""
    docs, found, vault = _vault_parts(spark, sf_dir)
    safe = rewrite_texts(docs, found, vault, ["doc_id"], "doc_id", "text")
    told = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    back = restore_texts(safe.join(told, "doc_id", "left"), vault, "doc_id", "text")
    return back.select("doc_id", "quality", F.sha2("text", 256).alias("text_sha256"), F.size("unknown").alias("n_unknown"))


def minted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of short documents, then those of the others, minted into one vault whose
    sessions are languages; then both batches once more.  Tokens of the vault, with what
    the replay gave."""
    docs = _table(spark, sf_dir, "documents")
    found = stored(scan_text(docs.select("doc_id", "text"), "doc_id", "text", [BY_NUMBER[9], BY_NUMBER[29]]).join(docs.select("doc_id", "lang", "n_chars"), "doc_id"), "found")
    batches = [found.where("n_chars < 1500"), found.where("n_chars is null or n_chars >= 1500")]
    vault = VaultTable(spark, f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}")
    first = [vault.mint(b, "lang", ["doc_id", "start"]) for b in batches]
    again = [vault.tokens_for(b, "lang", ["doc_id", "start"]) for b in batches]
    one = first[0].unionByName(first[1]).distinct()
    two = again[0].unionByName(again[1]).distinct().withColumnRenamed("token", "replayed")
    return one.join(two, one["session"].eqNullSafe(two["session"]) & (one["kind"] == two["kind"]) & (one["value"] == two["value"])).select(one["session"], one["kind"], one["value"], "token", "replayed")


def judged_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks on elements that a user's page showed: views read the page anew, and a click names
    the generation that was live 20 hours before, as one made from an old reading would; every
    generation shows seven elements."""
    events = _table(spark, sf_dir, "events")
    reads = generations(events.where("event_type = 'view'"), "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts", (F.col("event_id") % 9).alias("element"), (F.col("ts") - F.expr("interval 20 hours")).alias("read_at"))
    old = as_of(clicks, reads.select("user_id", F.col("ts").alias("at"), "generation"), ["user_id"], "read_at", "at", ["generation"])
    issued = reads.select("user_id", "generation", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("element"))
    told = valid_actions(old, reads, issued, "user_id", "ts", "generation", "element")
    return told.select("event_id", "generation", "live_generation", "verdict")


def labelled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that report a value after its label, over texts made from orders."""
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("Your OTP for login is "), F.lpad(key, 6, "0"), F.lit(". Customer ID: C"), F.lpad(key, 7, "0"), F.lit("\nVALID THRU 0"), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("/29\nPassword: Ab@"),
        F.lpad(key, 6, "x"), F.lit("\nDOB: "), F.date_format("o_orderdate", "dd/MM/yyyy"),
    )
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return scan_text(rows, "o_orderkey", "text", [BY_NUMBER[i] for i in (23, 24, 26, 27, 28, 30)]).select("o_orderkey", "kind", "value")


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_nodes(_table(spark, sf_dir, "pages"), "page_id", "html").where("role = 'heading'").select("page_id", "tag", "text")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = html_nodes(_table(spark, sf_dir, "pages"), "page_id", "html").where("role = 'link'")
    return nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that come as files of lines; lines of pages with an odd number of
    characters broke off half way.  The row without a page counts those."""
    line = F.to_json(F.struct(F.col("page_id").alias("capture_id"), "url", "html"))
    sent = _table(spark, sf_dir, "pages").select(F.when(F.length("html") % 2 == 1, F.left(line, (F.length(line) / 2).cast("int"))).otherwise(line).alias("value"))
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    sent.write.text(folder)
    records = read_captures(spark, folder, "pages")
    links = captured_nodes(records).where("role = 'link'").groupBy(F.col("capture_id").alias("page_id")).agg(F.count(F.lit(1)).alias("links"))
    return links.unionByName(records.agg(F.lit(None).cast("long").alias("page_id"), F.count("malformed").alias("links")))


def visit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").where("event_type <> 'purchase'")
    return counted_visits(events, ["user_id"], "ts", F.lit(False)).select("user_id", "visits", "last_us")


def preferred_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = counted_visits(_table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", F.lit(True))
    return preferred(counts, "user_id", "event_type").select("user_id", "event_type", "score", "place")


def scroll_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    effect = F.when(F.col("event_type") == "purchase", "act").when(F.col("event_type") == "error", "look").otherwise("scroll")
    return scroll_budget(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], effect).select("event_id", "scrolls", "over_budget")


def newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_newest_page(_table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant", "text", "(older page)")


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in five ways (null where day and month could be exchanged), times and amounts, read back."""
    way = F.col("o_orderkey") % 5
    d = lambda f: F.date_format("o_orderdate", f)
    text = F.when(way == 0, d("yyyy/M/d")).when(way == 1, d("dd/MM/yyyy")).when(way == 2, d("MM-dd-yyyy")).when(way == 3, F.concat(d("d"), F.lit("th "), d("MMMM, yyyy"))).otherwise(d("MMM d yyyy"))
    time = F.concat((F.col("o_orderkey") % 12 + 1).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"), F.lit(" p.m."))
    number = F.concat(F.lit("Rs. "), F.format_number(F.floor("o_totalprice"), 0))
    return _table(spark, sf_dir, "orders").select("o_orderkey", iso_date(text).alias("day"), iso_time(time).alias("time"), plain_number(number).alias("number"))


def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", normalise_url(F.col("text")).alias("url"))


def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", fold(F.col("text")).alias("folded"), collapse(F.col("text"), 40).alias("short"))


def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by kind, by confidence and in all, in one pass over them."""
    found = scan_text(_table(spark, sf_dir, "documents"), "doc_id", "text", [BY_NUMBER[9], BY_NUMBER[29]])
    sets = found.groupingSets([["kind"], ["confidence"], []], "kind", "confidence")
    return sets.agg(F.count(F.lit(1)).alias("n"))


_EMAIL, _IP = (BY_NUMBER[i].pattern for i in (9, 29))

QUERIES = {
    f.__name__: f
    for f in (
        vault_tokens, vault_round_trip, minted_batches, judged_clicks, captured_pages, labelled_values, page_headings, page_links, visit_counts, preferred_events, scroll_counts, newest_page, field_values,
        search_urls, folded_texts, findings_summary,
    )
}

ORACLE_SQL = {
    "vault_tokens": f"""WITH e AS (SELECT doc_id, 'email' AS kind, 'EMAIL' AS p, unnest(list_distinct(l)) AS value, l FROM (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS l FROM documents)
            UNION ALL SELECT doc_id, 'ip_address', 'IP', unnest(list_distinct(l)), l FROM (SELECT doc_id, regexp_extract_all(text, '{_IP}') AS l FROM documents))
        SELECT doc_id, kind, value, '<' || p || '_' || row_number() OVER (PARTITION BY doc_id, p ORDER BY list_position(l, value)) || '>' AS token FROM e""",
    "vault_round_trip": """SELECT doc_id, quality, sha256(text) AS text_sha256, CAST(0 AS INTEGER) AS n_unknown
        FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)""",
    "minted_batches": f"""WITH e AS (SELECT *, list_position(l, value) AS place FROM (SELECT doc_id, lang, n_chars, 'email' AS kind, 'EMAIL' AS p, unnest(list_distinct(l)) AS value, l FROM (SELECT *, regexp_extract_all(text, '{_EMAIL}') AS l FROM documents)
            UNION ALL SELECT doc_id, lang, n_chars, 'ip_address', 'IP', unnest(list_distinct(l)), l FROM (SELECT *, regexp_extract_all(text, '{_IP}') AS l FROM documents))),
        v AS (SELECT lang, kind, p, value, min(row(CASE WHEN n_chars < 1500 THEN 1 ELSE 2 END, doc_id, place)) AS first FROM e GROUP BY ALL),
        t AS (SELECT *, '<' || p || '_' || row_number() OVER (PARTITION BY lang, p ORDER BY first) || '>' AS token FROM v)
        SELECT lang AS session, kind, value, token, token AS replayed FROM t""",
    "judged_clicks": """WITH g AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view')),
        c AS (SELECT event_id, event_id % 9 AS element, (SELECT max(n) FROM g WHERE g.user_id = e.user_id AND g.ts <= e.ts - INTERVAL 20 HOUR) AS generation,
            (SELECT max(n) FROM g WHERE g.user_id = e.user_id AND g.ts <= e.ts) AS live_generation FROM events e WHERE event_type = 'click')
        SELECT event_id, generation, live_generation, CASE WHEN generation IS NOT NULL AND generation IS DISTINCT FROM live_generation THEN 'stale' WHEN live_generation IS NOT NULL AND element <= 6 THEN 'ok' ELSE 'unknown' END AS verdict FROM c""",
    "labelled_values": """WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderdate FROM orders)
        SELECT o_orderkey, 'otp' AS kind, lpad(k, 6, '0') AS value FROM o UNION ALL SELECT o_orderkey, 'identity_field', 'C' || lpad(k, 7, '0') FROM o
        UNION ALL SELECT o_orderkey, 'payment_field', '0' || (o_orderkey % 9 + 1) || '/29' FROM o UNION ALL SELECT o_orderkey, 'secret', 'Ab@' || lpad(k, 6, 'x') FROM o
        UNION ALL SELECT o_orderkey, 'date_of_birth', strftime(o_orderdate, '%d/%m/%Y') FROM o""",
    "page_headings": r"""SELECT page_id, substr(h, 2, 2) AS tag, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>[^<]*</h')) || '>' AS h FROM pages)""",
    "page_links": "SELECT page_id, n AS links FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '<a href')) AS BIGINT) AS n FROM pages) WHERE n > 0",
    "captured_pages": """SELECT page_id, n AS links FROM (SELECT page_id, html, CAST(len(regexp_extract_all(html, '<a href')) AS BIGINT) AS n FROM pages) WHERE n > 0 AND length(html) % 2 = 0
        UNION ALL SELECT NULL, count(*) FILTER (length(html) % 2 = 1) FROM pages""",
    "visit_counts": """SELECT user_id, CAST(len(c) AS BIGINT) AS visits, c[-1] AS last_us FROM (SELECT user_id,
        list_reduce(list_transform(list(epoch_us(ts) ORDER BY ts), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 1800000000 THEN list_concat(a, x) ELSE a END) AS c
        FROM events WHERE event_type <> 'purchase' GROUP BY user_id)""",
    "preferred_events": """SELECT user_id, event_type, score, place FROM (SELECT user_id, event_type, CAST(3 * count(*) AS BIGINT) AS score,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, max(ts) DESC, event_type) AS INTEGER) AS place FROM events GROUP BY user_id, event_type) WHERE place <= 3""",
    "scroll_counts": """WITH a AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
        s AS (SELECT event_id, CAST(sum(CASE WHEN event_type IN ('purchase', 'error') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scrolls FROM a)
        SELECT event_id, scrolls, scrolls > 8 AS over_budget FROM s""",
    "newest_page": """SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn < max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) THEN '(older page)' ELSE text END AS text FROM conversations""",
    "field_values": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2) AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
        lpad(CAST((o_orderkey % 12 + 1) % 12 + 12 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS time, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS number FROM orders""",
    "search_urls": f"""SELECT item_id, CASE WHEN regexp_matches(t, '(?i)^https?://') THEN t ELSE '{SEARCH}' || replace(replace(replace(replace(replace(url_encode(t), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') END AS url
        FROM (SELECT item_id, trim(text) AS t FROM benchmark)""",
    "folded_texts": r"""SELECT item_id, trim(regexp_replace(lower(text), '[^\pL\pN]+', ' ', 'g')) AS folded,
        CASE WHEN len(c) > 40 THEN left(c, 40) || '…' ELSE c END AS short FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM benchmark)""",
    "findings_summary": f"""WITH f AS (SELECT 'email' AS kind, 'certain' AS confidence, unnest(regexp_extract_all(text, '{_EMAIL}')) FROM documents
            UNION ALL SELECT 'ip_address', 'high', unnest(regexp_extract_all(text, '{_IP}')) FROM documents)
        SELECT kind, confidence, count(*) AS n FROM f GROUP BY GROUPING SETS ((kind), (confidence), ())""",
}
