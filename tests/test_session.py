import pytest
from pyspark.sql import functions as F

from sieveline.functions.fit import fit_to_field, iso_date, iso_datetime, iso_month, iso_time, plain_number
from sieveline.functions.text import escape_tokens, mask_short, normalise_url, preview, tokens_in
from sieveline.operators.fields import field_findings
from sieveline.operators.rules import scan_text
from sieveline.operators.usage import assemble_calls, counted_visits, keep_newest_page, preferred
from sieveline.operators.vault import mint_tokens, restore_texts, rewrite_texts, vault_view
from sieveline.sources.html import html_nodes, page_nodes
from sieveline.streaming.visits import visit_stream


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first())


LABELLED = [
    ("Your OTP for login is 482913. Do not share it.", "otp", "482913"), ("482913 is your verification code", "otp", "482913"), ("Order 482913 shipped", None, None),
    ("Password: Tiger@2024!", "secret", "Tiger@2024!"), ("API key:\nPassword:", None, None), ("Customer ID 84720193", "identity_field", "84720193"), ("Customer ID pending", None, None),
    ("VALID THRU 08/29", "payment_field", "08/29"), ("DOB: 14 August 1991 x", "date_of_birth", "14 August 1991"), ("born on 14/08/1991", "date_of_birth", "14/08/1991"), ("on 14/08/1991", None, None),
    ("write priya [at] example [dot] in", "email", "priya [at] example [dot] in"), ("ravi at mail dot com", "email", "ravi at mail dot com"), ("look at the dot com bubble", None, None),
    ("J8369854<4IND9001014F2601012<<<<<<<<<<<<<<04", "passport", "J8369854<4IND9001014F2601012<<<<<<<<<<<<<<04"), ("otp otp code 4444 and 4444", "otp", "4444"),
]


def test_labelled_rules(spark):
    texts = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LABELLED)], "id int, text string")
    rows = scan_text(texts.coalesce(1), "id", "text").collect()
    assert sorted((r.id, r.kind, r.value) for r in rows) == [(i, k, v) for i, (_, k, v) in enumerate(LABELLED) if k]
    assert all(LABELLED[r.id][0][r.start : r.end] == r.value for r in rows)


@pytest.mark.parametrize("fn, text, value", [
    (iso_date, "2024-2-9", "2024-02-09"), (iso_date, "2023-02-29", None), (iso_date, "23/09/2026", "2026-09-23"), (iso_date, "09/23/2026", "2026-09-23"), (iso_date, "05/05/2026", "2026-05-05"),
    (iso_date, "05/06/2026", None), (iso_date, "23/09/26", None), (iso_date, "23rd September, 2026", "2026-09-23"), (iso_date, "Sep 23 2026", "2026-09-23"), (iso_date, "1 Sept. 2026", "2026-09-01"), (iso_date, "1 marzipan 2026", None),
    (iso_time, "3:30 pm", "15:30"), (iso_time, "12 am", "00:00"), (iso_time, "15.30", "15:30"), (iso_time, "24:00", None), (iso_time, "13 pm", None), (iso_time, "1:02:03 p.m.", "13:02:03"),
    (iso_month, "9/2026", "2026-09"), (iso_month, "Sept 2026", "2026-09"), (iso_month, "13/2026", None), (iso_datetime, "23 Sep 2026, 3:30 pm", "2026-09-23T15:30"), (iso_datetime, "2026-09-23T15:30", "2026-09-23T15:30"),
    (plain_number, "Rs. 1,20,000.50", "1,20,000.50".replace(",", "")), (plain_number, "12,5", None), (plain_number, "₹ 12,000", "12000"), (plain_number, "twelve", None), (iso_date, None, None), (plain_number, "", None), (iso_date, "\t2024-02-09 \n", "2024-02-09"), (iso_date, "23\u00a0Sep\u00a02026", "2026-09-23"), (plain_number, "\u00a0-12.5 inr", "-12.5"), (plain_number, "1e3", "1e3"),
])
def test_field_formats(spark, fn, text, value):
    assert one(spark, fn(F.lit(text).cast("string"))) == [value]


@pytest.mark.parametrize("text, kind, limit, label, value", [
    ("98765 43210", "tel", 10, None, "9876543210"), ("+91 98765 43210", "text", 10, "Mobile", "9876543210"), ("+91 98765 43210", "text", 10, "Code", None), ("a long name", "text", 5, None, None), ("  ", "date", None, None, "  "), ("1,000", "number", None, None, "1000"), ("x", "date", -1, None, None),
])
def test_fit_to_field(spark, text, kind, limit, label, value):
    got = one(spark, fit_to_field(F.lit(text), F.lit(kind), F.lit(limit).cast("int"), F.lit(label).cast("string")))[0]
    assert (got.ok, got.value) == (value is not None, value) and (got.reason is None) == got.ok
    assert (got.note is None) == (not got.ok or got.value == text)


def test_text_functions(spark):
    urls = [normalise_url(F.lit(x)) for x in ("localhost:3000", "node.js tutorial", "Example.in/a?b", "http://x", "10.0.0.1")]
    assert one(spark, *urls) == ["http://localhost:3000", "https://www.google.com/search?q=node.js%20tutorial", "https://Example.in/a?b", "http://x", "http://10.0.0.1"]
    assert one(spark, preview(F.lit("ab")), preview(F.lit("abcd")), preview(F.lit("abcdefgh")), mask_short(F.lit("abcdef"))) == ["••", "a•••", "ab••••gh", "ab••ef"]
    assert one(spark, escape_tokens(F.lit("a <EMAIL_1> <b>")), tokens_in(F.lit("<B_2> <A_1> <B_2> <x_1>"))) == ["a ‹EMAIL_1› <b>", ["<A_1>", "<B_2>"]]


def test_vault(spark):
    texts = [(1, 0, "to a@x.in and b@x.in, <EMAIL_9>"), (1, 1, "b@x.in again; Password: Tiger@2024! c@x.in"), (2, 0, "b@x.in"), (2, 1, None), (3, 0, "")]
    df = spark.createDataFrame(texts, "conv int, turn int, text string").withColumn("key", F.concat_ws("-", "conv", "turn"))
    found = scan_text(df, "key", "text").join(df.select("key", "conv", "turn"), "key")
    vault = mint_tokens(found, "conv", ["turn", "start"]).cache()
    tokens = {(r.conv, r.value): r.token for r in vault.collect()}
    assert tokens == {(1, "a@x.in"): "<EMAIL_1>", (1, "b@x.in"): "<EMAIL_2>", (1, "c@x.in"): "<EMAIL_3>", (1, None): "<SECRET_1>", (2, "b@x.in"): "<EMAIL_1>"}
    seals = found.select("conv", "turn", "start", F.lit("credential_field").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("sealed"))
    both = found.select("conv", "turn", "start", "kind", "value", F.lit(False).alias("sealed")).unionByName(seals.where("conv = 2"))
    assert {r.token for r in mint_tokens(both, "conv", ["turn", "start"]).where("conv = 2").collect()} == {"<EMAIL_1>", "<SECRET_1>"}
    with pytest.raises(Exception, match="no token for kind"):
        mint_tokens(found.withColumn("kind", F.lit("shoe_size")), "conv", ["turn", "start"]).collect()
    assert {r.preview for r in vault_view(vault).collect()} == {None, "a•••••", "b•••••", "c•••••"}
    safe = rewrite_texts(df, found, vault, ["key"], "conv", "text")
    got = {r.key: r.text for r in safe.collect()}
    assert got == {"1-0": "to <EMAIL_1> and <EMAIL_2>, ‹EMAIL_9›", "1-1": "<EMAIL_2> again; Password: <SECRET_1> <EMAIL_3>", "2-0": "<EMAIL_1>", "2-1": None, "3-0": ""}
    typed = spark.createDataFrame([(1, "<EMAIL_2> <SECRET_1> <EMAIL_7>"), (2, "<EMAIL_1>"), (9, "<EMAIL_1> x"), (2, None)], "conv int, text string")
    back = sorted([(r.conv, r.text, r.sealed, r.unknown) for r in restore_texts(typed, vault, "conv", "text").collect()], key=repr)
    assert back == sorted([(1, "b@x.in <SECRET_1> <EMAIL_7>", ["<SECRET_1>"], ["<EMAIL_7>"]), (2, "b@x.in", [], []), (9, "<EMAIL_1> x", [], ["<EMAIL_1>"]), (2, None, None, None)], key=repr)


def test_fields(spark):
    nodes = [
        (1, "input", "textbox", "", "Asha Rao", {"autocomplete": "shipping name"}), (2, "input", "password", "Secret", None, {"type": "password", "filled": "true"}),
        (3, "input", "textbox", "PIN Code", "560025", {}), (4, "input", "textbox", "MPIN", "1234", {}), (5, "input", "textbox", "Display name", "you", {}),
        (6, "input", "textbox", "Colour", "red", {}), (7, "div", "generic", "password", None, {}), (8, "input", "textbox", "E-mail", None, {"type": "email"}),
    ]
    df = spark.createDataFrame(nodes, "node_id int, tag string, role string, label string, value string, attrs map<string,string>")
    got = {r.node_id: (r.kind, r.confidence, r.value, r.action, r.field) for r in field_findings(df, ["you"]).collect()}
    assert got == {
        1: ("person_name", "certain", "Asha Rao", "replace-field", "value"), 2: ("credential_field", "certain", None, "seal-field", "value"), 3: ("pincode", "high", "560025", "replace-field", "value"),
        4: ("credential_field", "high", None, "seal-field", "value"), 5: ("person_name", "medium", None, "seal-field", "value"), 8: ("email", "certain", None, "none", "label"),
    }


def test_pages(spark):
    html = "<html><head><title>t</title></head><body><div><div><p>one<p>two</div></div><form><label for=q>Find</label><input id=q value=x><input type=password value=z></form><div style='display: none'><h1>no</h1></div></body></html>"
    rows = page_nodes(html)
    assert [(r[3], r[5], r[6], r[7]) for r in rows if r[3] in ("p", "input")] == [("p", "", "one", None), ("p", "", "two", None), ("input", "Find", None, "x"), ("input", "", None, None)]
    assert [r[0] for r in rows] == list(range(len(rows))) and rows[-1][8] == {"type": "password", "filled": "true"}
    assert page_nodes(None) == page_nodes("") == []
    assert len(page_nodes("<div>" * 5000 + "x")) == 1
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert html_nodes(df, "page_id", "html").where("tag = 'form'").select("page_id", "parent_id").collect() == [(1, rows[[r[3] for r in rows].index("form")][1])]


def _fold(events):
    """Brute force of the rule of visits."""
    out = {}
    for user, us, task in sorted(events, key=lambda e: (e[1], not e[2])):
        v, t, last = out.get(user, (0, 0, 0))
        if task:
            out[user] = v, t + 1, us
        elif v == 0 or us - last >= 1_800_000_000:
            out[user] = v + 1, t, us
        else:
            out[user] = v, t, last
    return {k: v for k, v in out.items()}


def test_visits_batch_and_stream(spark, tmp_path):
    minute = 60_000_000
    events = [(u, (i * 7 + u * 3) * minute, (i + u) % 11 == 0) for u in range(4) for i in range(60)] + [(9, minute, False), (9, minute, False)]
    df = spark.createDataFrame(events, "u int, us long, task boolean").select("u", F.timestamp_micros("us").alias("ts"), "task")
    want = _fold(events)
    assert {r.u: (r.visits, r.tasks, r.last_us) for r in counted_visits(df, ["u"], "ts", F.col("task")).collect()} == want
    for part, rows in enumerate((df.where(F.unix_micros("ts") < 200 * minute), df.where(F.unix_micros("ts") >= 200 * minute))):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = visit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "u", "ts", "task").writeStream.outputMode("update")
        seen = {}
        query = query.foreachBatch(lambda b, i: seen.update({r.u: (r.visits, r.tasks, r.last_us) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        if part == 0:
            first = dict(seen)
    assert {**first, **seen} == want
    assert counted_visits(df.limit(0), ["u"], "ts", F.col("task")).count() == 0


def test_history_and_calls(spark):
    turns = spark.createDataFrame([(1, 0, "P", True), (1, 1, "x", False), (1, 2, "Q", True), (2, 0, "P", True)], "c int, t int, text string, page boolean")
    got = {(r.c, r.t): r.text for r in keep_newest_page(turns, "c", "t", F.col("page"), "text", "-").collect()}
    assert got == {(1, 0): "-", (1, 1): "x", (1, 2): "Q", (2, 0): "P"}
    parts = spark.createDataFrame([(1, 0, 2, "", "", ":1}"), (1, 0, 1, "a", "go", '{"x"'), (1, 1, 3, "b", None, None)], "r int, i int, o int, id string, name string, arguments string")
    assert {(r.r, r.i): (r.id, r.name, r.arguments) for r in assemble_calls(parts, "r", "i", "o").collect()} == {(1, 0): ("a", "go", '{"x":1}'), (1, 1): ("b", None, "")}
    counts = spark.createDataFrame([(1, h, v, t, 0) for h, v, t in (("a", 5, 0), ("b", 0, 2), ("c", 5, 0), ("d", 1, 0))], "k int, h string, visits long, tasks long, last_us long")
    assert [r.h for r in preferred(counts, "k", "h").orderBy("place").collect()] == ["b", "a", "c"]
