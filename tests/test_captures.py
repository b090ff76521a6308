"""Detection, sanitising, rendering and reading over small captures."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline import sql
from sieveline.functions.boxes import burn_box
from sieveline.functions.fuzzy import approximate_spans, corrected_identifiers, fit_slots, original_place, repair_labels, slack
from sieveline.operators.actions import action_signature, issued_only, wire_export, wire_records, with_results
from sieveline.operators.align import align_requests, align_text
from sieveline.operators.capture import detect, detection_stats, ranked, text_nodes
from sieveline.operators.entities import entity_findings
from sieveline.operators.ocr import box_of, card_holders, column_names, ocr_findings, ocr_regions
from sieveline.operators.page import all_text, page_profiles, render_pages
from sieveline.operators.preferences import load_preferences, preference_hints, save_preferences, suggestions
from sieveline.operators.sanitize import origin, residual, sanitize, sanitize_texts, titles
from sieveline.sources.html import page_nodes
from sieveline.streaming.scan import scan_stream

NODE = "capture_id long, node_id int, tag string, role string, label string, text string, value string, attrs map<string,string>, bbox struct<x:int,y:int,w:int,h:int>"
NODES = [
    (1, 0, "body", "document", "Account of Asha Rao", None, None, {}, (0, 0, 100, 100)), (1, 1, "input", "textbox", "Email", None, "asha.rao@mail.example.com", {"autocomplete": "email"}, (0, 0, 100, 20)),
    (1, 2, "input", "password", "Password", None, None, {"type": "password", "filled": "true"}, (0, 0, 100, 20)),
    (1, 3, "p", "paragraph", "", "Dear Asha Rao, your card 4111 1111 1111 1111 and mail asha.rao@mail.example.com. Otp code 4821", None, {}, (0, 0, 100, 20)),
    (1, 4, "img", "image", "profile photo", None, None, {}, (0, 0, 80, 80)), (1, 5, "span", "generic", "", "Rao", None, {"email": "asha.rao@mail.example.com", "name": "Asha Rao"}, (0, 0, 9, 9)),
    (1, 6, "th", "columnheader", "", "Customer", None, {}, (200, 0, 50, 20)), (1, 7, "td", "cell", "", "Vikram Seth", None, {}, (200, 30, 50, 20)), (1, 8, "td", "cell", "", "Nina Paul", None, {}, (200, 60, 50, 20)),
    (1, 9, "iframe", "frame", "", None, None, {}, (0, 0, 300, 300)), (2, 0, "p", "paragraph", "", None, None, {}, (0, 0, 9, 9)), (1, 10, "address", "address", "", "12 Rose Lane, Pune", None, {}, (0, 0, 9, 9)),
]


@pytest.fixture(scope="module")
def safe(spark):
    nodes = spark.createDataFrame(NODES, NODE)
    return {"before": nodes, **sanitize(nodes)}


def test_detect_over_a_capture(safe):
    found = {(r.node_id, r.field, r.kind, r.value, r.action) for r in safe["findings"].collect()}
    mail = "asha.rao@mail.example.com"
    assert found == {
        (0, "label", "person_name", "Asha Rao", "replace-span"), (1, "value", "email", mail, "replace-field"), (1, "value", "email", mail, "replace-span"), (2, "value", "credential_field", None, "seal-field"),
        (3, "text", "person_name", "Asha Rao", "replace-span"), (3, "text", "payment_card", "4111 1111 1111 1111", "replace-span"), (3, "text", "email", mail, "replace-span"), (3, "text", "otp", "4821", "replace-span"),
        (4, None, "face_or_photo", None, "burn-region"), (5, "attr:email", "email", mail, "replace-span"), (5, "attr:name", "person_name", "Asha Rao", "replace-span"), (5, "text", "person_name", "Rao", "replace-span"),
        (7, "text", "person_name", "Vikram Seth", "replace-span"), (8, "text", "person_name", "Nina Paul", "replace-span"), (9, None, "unverified_region", None, "burn-region"), (10, "text", "postal_address", "12 Rose Lane, Pune", "replace-span"),
    }
    first = ranked(safe["findings"]).first()
    assert first.confidence == "certain" and first.tier == 1


def test_sanitize_leaves_nothing(spark, safe):
    rows = {(r.capture_id, r.node_id): r for r in safe["nodes"].collect()}
    assert rows[1, 0].label == "Account of <NAME_1>" and rows[1, 1].value == "<EMAIL_1>" and rows[1, 2].value == "<SECRET_1>" and rows[2, 0].text is None
    assert rows[1, 3].text == "Dear <NAME_1>, your card <CARD_1> and mail <EMAIL_1>. Otp code <OTP_1>" and rows[1, 5].attrs == {"email": "<EMAIL_1>", "name": "<NAME_1>"}
    (report,) = safe["report"].collect()
    assert (report.spans_replaced, report.spans_skipped, report.fields_replaced, report.fields_sealed) == (11, 0, 1, 1)
    assert {r.value for r in safe["vault"].where("kind in ('otp', 'credential_field')").collect()} == {None}
    assert residual(safe["nodes"]).count() == 0
    assert {r.capture_id: r.title for r in titles(safe["nodes"]).collect()} == {1: "Account of <NAME_1>", 2: ""}
    (stats,) = detection_stats(safe["before"], safe["findings"]).where("capture_id = 1").collect()
    assert (stats.nodes_scanned, stats.tier_1, stats.tier_2, stats.tier_3, stats.pixel_shape) == (11, 2, 5, 9, 2) and stats.checksum_rejected > 0


def test_texts_without_anything(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "plain words"), (5, "<NAME_1> said")], "id int, text string")
    out = sanitize_texts(df, "id", "text")
    assert {r.id: r.text for r in out["texts"].collect()} == {1: None, 2: "", 3: " \n", 4: "plain words", 5: "‹NAME_1› said"}
    assert out["vault"].count() == 0 and detect(text_nodes(df.limit(0), "id", "text")).count() == 0
    assert spark.range(1).select(origin(F.lit("https://u@x.in:80/a?b=1")), origin(F.lit("no url"))).first()[:] == ("https://u@x.in:80", None)


def test_bare_capitals_on_request(spark):
    df = spark.createDataFrame([(1, "then Vikram Seth came to New Delhi")], "id int, text string")
    assert entity_findings(df, ["id"]).count() == 0
    assert [(r.value, r.confidence) for r in entity_findings(df, ["id"], aggressive=True).collect()] == [("Vikram Seth", "low")]


def test_render(spark):
    nodes = [(1, i, -1 if i == 0 else 0, 0 if i == 0 else 1, "div", "generic" if i == 0 else "button", f'b "{i}"' if i else "", None, None, {}, i % 2 == 0) for i in range(6)]
    nodes += [(1, 6, 0, 1, "div", "dialog", "Ask", None, None, {}, True), (1, 7, 6, 2, "input", "textbox", "Name", None, "Asha", {"type": "text", "required": "true"}, False)]
    df = spark.createDataFrame(nodes, "capture_id long, node_id int, parent_id int, depth int, tag string, role string, label string, text string, value string, attrs map<string,string>, visible boolean")
    heads = spark.createDataFrame([(1, "https://x.in", "T", 5, 100), (2, "https://y.in", "U", 0, 0)], "capture_id long, url string, title string, scroll_y int, page_height int")
    pages = {r.capture_id: r.page for r in render_pages(df, heads, most=3).collect()}
    assert pages[1].split("\n") == [
        "URL: https://x.in", "Title: T", "Scroll: 5 of 100", "A dialog is open and is listed first below. Work inside it; the page behind it is not interactive.", "Elements:", '  [2] button "b \\"2\\""',
        '  [6] dialog "Ask"', '    [7] textbox "Name" = "Asha" (type=text required offscreen)', "… 1 more element(s) on screen did not fit", "… 3 more element(s) are on the page but off screen; scroll to bring them into view",
    ]
    assert pages[2] == "URL: https://y.in\nTitle: U\nScroll: 0 of 0\nElements:"
    assert all_text(df).first().text == "Asha"


def test_profile(spark):
    rows = [(1, 0, None, "article", "generic", "", None, {}), (1, 1, 0, "input", "password", "", None, {"type": "password"}), (1, 2, 0, "input", "textbox", "", None, {"name": "q"}), (1, 3, 0, "input", "textbox", "", None, {"autocomplete": "cc-number"})]
    rows += [(1, 4, 0, "p", "p", "", "Add to cart for Rs. 1,200.50 or $5", {}), (1, 5, 0, "table", "table", "", None, {})] + [(1, 6 + i, 5, "tr", "row", "", None, {}) for i in range(3)]
    df = spark.createDataFrame(rows, "capture_id long, node_id int, parent_id int, tag string, role string, label string, text string, attrs map<string,string>").withColumn("url", F.lit("https://x.in/a.pdf?x"))
    assert page_profiles(df).first().asDict() == {"capture_id": 1, "search": True, "fields": 2, "login": True, "payment": True, "article": True, "tables": 1, "prices": 2, "video": False, "cart": True, "pdf": True}


def test_offers_and_hints(spark):
    page = "page int, categories array<string>, pdf boolean, cart boolean, prices long, tables long, fields long, login boolean, payment boolean, article boolean, video boolean, search boolean"
    df = spark.createDataFrame([(1, ["flights", "hotels"], True, *[False] * 1, 9, 0, 0, False, False, True, False, True), (2, [], False, False, 0, 0, 4, False, False, True, False, True)], page)
    got = {}
    for r in suggestions(df, "page").collect():
        got.setdefault(r.page, []).append((r.place, r.label))
    assert sorted(got[1]) == [(1, "Find the cheapest flight"), (2, "Compare flights on this page"), (3, "Find a well-rated hotel"), (4, "Compare the hotels on this page")]
    assert [x for _, x in sorted(got[2])] == ["Help me fill this form", "Summarise this page", "Explain this simply", "Search this site"]
    sites = spark.createDataFrame([(1, "flights", 1, "a.in", False, 3, 1), (1, "flights", 2, "b.in", False, 2, 0), (1, "food", 1, "c.in", True, 0, 0)], "user int, category string, place int, host string, pinned boolean, visits int, tasks int")
    tasks = spark.createDataFrame([(1, "book a flight ticket, any airline"), (1, "order pizza"), (1, "flight on b.com please"), (1, "sing"), (2, "order pizza")], "user int, task string")
    hints = {(r.user, r.task): r.hint for r in preference_hints(tasks, sites, "user", "task").collect()}
    assert hints[1, "book a flight ticket, any airline"].endswith("a.in (the user has used it for 1 earlier task). Go there to do this task unless the task names another site; if it cannot, they also use b.in.")
    assert "c.in (the user chose it" in hints[1, "order pizza"] and {hints[1, "flight on b.com please"], hints[1, "sing"], hints[2, "order pizza"]} == {None}


def test_runs_and_logs(spark):
    a = spark.createDataFrame([("click", {"reason": "x", "b": "1", "a": None}), ("click", {"a": None, "b": "1"})], "name string, args map<string,string>")
    assert {r[0] for r in a.select(action_signature(F.col("name"), F.col("args"), F.lit("u"))).collect()} == {'click {"a":null,"b":"1"} @ u'}
    acts = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 1, 9)], "run int, generation int, id int")
    assert issued_only(acts, spark.createDataFrame([(1, 2, 5), (1, 2, 5)], "run int, generation int, id int"), ["run", "generation", "id"]).collect() == [(1, 2, 5)]
    calls = with_results(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "done")], "id string, result string"), ["id"])
    assert {r.id: r.result for r in calls.collect()} == {"a": "done", "b": None}
    sent = spark.createDataFrame([(1, i, [("user", "x <A_1>")], 1, bytearray(4_000_000 if i == 29 else 3)) for i in range(30)], "log int, turn int, messages array<struct<role:string,text:string>>, system_chars int, image binary")
    rows = wire_records(sent.coalesce(1), "log", "turn")
    assert sorted(r.turn for r in rows.collect()) == list(range(6, 30)) and rows.where("image is null").select("turn", "image_bytes").collect() == [(29, 4_000_000)]
    assert "image\"" not in wire_export(rows.where("turn = 29")).first().json


def brute_best(hay, needle):
    """Least edits of ``needle`` to any part of ``hay``."""
    row = list(range(len(needle) + 1))
    best = row[-1]
    for c in hay:
        new = [0]
        for i, d in enumerate(needle, 1):
            new.append(min(row[i - 1] + (c != d), row[i] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_approximate_search_is_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        value = "".join(rng.choice("abcdefghjk mnpqr") for _ in range(rng.randint(4, 24))).strip()
        damaged = list(value)
        for _ in range(rng.randint(0, 3)):
            damaged[rng.randrange(len(damaged))] = rng.choice("xyvw")
        text = f"{rng.choice(['', 'to '])}{''.join(damaged)}{rng.choice(['', ' now', 'Z'])}"
        needle, hay = value.replace(" ", ""), "".join(c for c in text.lower() if c.isalnum()).replace("z", "2")
        found = approximate_spans(text, value)
        if found:
            assert brute_best(hay, needle) <= slack(len(needle)) and len(needle) >= 4
        if len(needle) >= 4 and not text.endswith("Z") and brute_best(hay, needle) == 0:
            assert found
    assert approximate_spans("mail Asha Ra0 now", "Asha Rao") == [(5, 13)] and approximate_spans("xAsha Rao", "Asha Rao") == [] and approximate_spans("", "Asha Rao") == [] and approximate_spans("abc", "abc") == []
    assert approximate_spans("Sharna Traders and Sharma Trader5", "Sharma Traders") == [(0, 14), (19, 33)]


def test_repaired_text_leads_back(spark):
    t = "Sumame: RAO, Given Narnes Asha"
    row = spark.createDataFrame([(t,)], "t string").select(repair_labels(F.col("t")).alias("r")).first().r
    assert row.text == "Surname: RAO, Given Names Asha"
    places = [row.text.index("RAO"), row.text.index("Asha")]
    back = spark.createDataFrame([(row.pieces, p) for p in places], "p array<struct<start:int,end:int,at:int,to:int>>, n int").select(original_place(F.col("p"), F.col("n"))).collect()
    assert [r[0] for r in back] == [t.index("RAO"), t.index("Asha")]


def test_reading_pictures(spark):
    def line(capture, block, no, text):
        words, x = [], 0
        for w in text.split(" "):
            words.append((w, x, 20 * no, x + 10 * len(w), 20 * no + 15))
            x += 10 * len(w) + 10
        return (capture, block, no, text, words)

    rows = [line(1, 1, 0, "Name: VIKRAM SETH"), line(1, 1, 1, "Card 41l1 1111 1111 1I11"), line(1, 1, 2, "paid by Vikran Seth today"), line(1, 2, 0, "mail a@x.example.com"), line(1, 2, 1, "nothing"), line(2, 1, 0, "Asha Ra0")]
    lines = spark.createDataFrame(rows, "capture_id int, block_id int, line_no int, text string, words array<struct<text:string,x0:int,y0:int,x1:int,y1:int>>")
    tree = spark.createDataFrame([(2, "person_name", "Asha Rao")], "capture_id int, kind string, value string")
    got = {(r.capture_id, r.block_id, r.line_no): (r.kind, r.value, r.source, r.box.x0, r.box.x1) for r in ocr_findings(lines, tree).collect()}
    assert got == {
        (1, 1, 0): ("person_name", "VIKRAM SETH", "detected", 60, 170), (1, 1, 1): ("payment_card", "4111111111111111", "corrected", 50, 240), (1, 1, 2): ("person_name", "VIKRAM SETH", "known value", 80, 190),
        (1, 2, 0): ("email", "a@x.example.com", "detected", 50, 200), (2, 1, 0): ("person_name", "Asha Rao", "known value", 0, 80),
    }
    nothing = lines.where("line_no = 0").select(box_of(F.col("words"), F.lit(900), F.lit(901))).first()
    assert nothing[0] is None and ocr_findings(lines.limit(0)).count() == 0


def test_columns_and_card_holders(spark):
    word = lambda t, x, y: (t, x, y, x + 10 * len(t), y + 10)
    rows = [(0, [word("Customer", 0, 0), word("Due", 300, 0)]), (1, [word("Vikram", 0, 20), word("Seth", 70, 20), word("12", 300, 20)]), (2, [word("Nina", 2, 40), word("Paul", 50, 40)]), (3, [word("total", 0, 60)]), (4, [word("Late", 0, 200), word("Comer", 50, 200)])]
    lines = spark.createDataFrame([(1, 1, n, " ".join(w[0] for w in ws), ws) for n, ws in rows], "capture_id int, block_id int, line_no int, text string, words array<struct<text:string,x0:int,y0:int,x1:int,y1:int>>")
    assert {(r.line_no, r.start, r.end, r.value) for r in column_names(lines).collect()} == {(1, 0, 11, "Vikram Seth"), (2, 0, 9, "Nina Paul")}
    card = spark.createDataFrame([(1, 1, 0, "VALID THRU"), (1, 1, 1, " ASHA RAO"), (1, 2, 0, "NINA PAUL")], "capture_id int, block_id int, line_no int, text string")
    found = spark.createDataFrame([(1, 1, "payment_card"), (1, 2, "email")], "capture_id int, block_id int, kind string")
    assert [(r.line_no, r.start, r.end, r.value) for r in card_holders(card, found).collect()] == [(1, 1, 9, "ASHA RAO")]


def test_scan_of_a_stream(spark, tmp_path):
    texts = spark.createDataFrame([(1, "mail a@x.in"), (2, "nothing"), (3, "from 10.0.0.1")], "id int, text string")
    texts.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = scan_stream(spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in")), "id", "text").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {(r.id, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "email"), (3, "ip_address")}


def test_policy_and_preferences(spark, safe, tmp_path):
    kept = sanitize(safe["before"], safe["findings"], burn_unverified=False)["findings"].where("kind = 'unverified_region'").collect()
    assert [r.action for r in kept] == ["none"]
    counts = spark.createDataFrame([(1, "food", "a.in", 2)], "user int, category string, host string, visits int")
    save_preferences(counts, str(tmp_path / "p"))
    assert load_preferences(spark, str(tmp_path / "p")).collect() == counts.collect()


def test_regions(spark):
    nodes = [(1, i, "img", {}, (0, 0, 50 + i, 50), True) for i in range(4)] + [(1, 9, "canvas", {}, (0, 0, 90, 90), True), (1, 10, "img", {}, (0, 0, 20, 20), True), (1, 11, "img", {}, (0, 0, 99, 99), True)]
    df = spark.createDataFrame(nodes, "capture_id int, node_id int, tag string, attrs map<string,string>, bbox struct<x:int,y:int,w:int,h:int>, visible boolean")
    found = spark.createDataFrame([(1, 9, "pixel", "burn-region", "scanned_document", "low"), (1, 11, "pixel", "burn-region", "face_or_photo", "high")], "capture_id int, node_id int, shape string, action string, kind string, confidence string")
    assert {(r.node_id, r.releasable, r.read) for r in ocr_regions(df, found, most=3).collect()} == {(9, True, True), (3, False, True), (2, False, True), (1, False, False), (0, False, False)}


def test_burns(spark):
    view, shot = F.struct(F.lit(0).alias("scroll_x"), F.lit(0).alias("scroll_y")), F.struct(F.lit(0).alias("origin_x"), F.lit(0).alias("origin_y"), F.lit(1.0).alias("scale"))
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(c) for x, c in zip(v, "xywh", strict=True)])
    fates = [burn_box(box(*v), view, shot, F.lit(100), F.lit(100)) for v in ((10, 10, 5, 5), (0, 0, 0, 5), (200, 0, 5, 5), (-50, 95, 60, 60))]
    got = [tuple(x) for x in spark.range(1).select(*fates).first()]
    assert got == [("burned", 7, 7, 11, 11), ("skipped", None, None, None, None), ("outside", None, None, None, None), ("burned", 0, 92, 13, 8)]


def test_sql_functions(spark):
    assert "is_aadhaar" in sql.register(spark)
    row = spark.sql("select is_aadhaar('3456 7890 1238') a, mask_value('a@x.in') b, iso_date('23 Sep 2026') c, is_iban('GB82 WEST 1234 5698 7654 32') d, tokens_in('<A_1> x') e").first()
    assert tuple(row) == (True, "a•@x.in", "2026-09-23", True, ["<A_1>"])


def test_labels_and_states_of_pages():
    html = "<label>State <select name=s><option>x</select></label><span id=l>Your <b>name</b></span><input aria-labelledby='l zz'><div style='visibility: hidden'>no<a href=https://x.in/p>yes</a></div><input type=checkbox checked required><iframe src='https://f.in/a?b'></iframe>"
    rows = {(r[3], r[4]): r for r in page_nodes(html)}
    assert rows["select", "select"][5] == "State" and rows["input", "textbox"][5] == "Your name" and rows["a", "link"][6] == "yes" and ("div", "div") not in rows
    assert rows["input", "checkbox"][8] == {"type": "checkbox", "checked": "true", "required": "true"} and rows["iframe", "frame"][8] == {"frameHost": "f.in"}


def test_requests_meet_values_by_what_they_hold(spark):
    """As with all values of the session at hand, but no join pairs a session with all its values."""
    texts = ["mail Asha Rao today", "ASHA RAO and asha", "ask sharma traders!", "Ashalata", "", None, "flat 12b, 12b street", "12asha rao", "ÉCOLE école", "😀😀 party", "a.b+c", "in\nIndia x", "Иван иванов"]
    known = [("Sharma Traders Pvt. Ltd.", "<ORG_1>"), ("Asha Rao", "<NAME_1>"), ("Asha", "<NAME_2>"), ("the", "<NAME_3>"), ("12b", "<ID_1>"), ("École", "<ORG_2>"), ("😀😀 party", "<ORG_3>"), ("A.B+C", "<$1>"), ("ИВАН", "<NAME_4>"), ("x", "<X_1>"), ("x 12", "<ID_2>"), (None, "<N_1>"), ("", "<N_2>")]
    requests = spark.createDataFrame([(s, i, t) for s in (1, 2, 3, None) for i, t in enumerate(texts)], "session int, i int, text string")
    vault = spark.createDataFrame([(s, v, t) for s in (1, 2, None) for v, t in known if s == 1 or "a" in (v or "")], "session int, value string, token string")
    df = align_requests(requests, vault, "session", "text")
    assert df.columns == requests.columns
    per = vault.where("value is not null").groupBy("session").agg(F.collect_list(F.struct("value", "token")).alias("k"))
    whole = requests.join(per, "session", "left").select("session", "i", F.when(F.col("k").isNull(), F.col("text")).otherwise(align_text(F.col("text"), F.col("k"))).alias("text"))
    assert sorted(map(repr, df.collect())) == sorted(map(repr, whole.collect()))
    got = {(r.session, r.i): r.text for r in df.collect()}
    assert got[1, 2] == "ask <ORG_1>!" and got[1, 8] == "<ORG_2> <ORG_2>" and got[1, 10] == "<$1>" and got[3, 0] == texts[0]
    assert align_requests(requests, vault.where("false"), "session", "text").exceptAll(requests).isEmpty()
    # by session alone a join would pair all requests with all values, and then look into each text
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x or "Join Inner" in x]
    assert any("_key" in x for x in joins) and not any("Contains" in x for x in joins)


@pytest.mark.parametrize("raw, slots, value, corrections", [
    ("345678901238", "D" * 12, "345678901238", 0), ("3456789OlZ3B", "D" * 12, "345678901238", 4), ("3456789O123x", "D" * 12, None, None), ("34567890123", "D" * 12, None, None), ("abcpei234f", "LLLLLDDDDL", "ABCPE1234F", 1), ("A8CP31Z34|", "LLLLLDDDDL", "ABCPE1234I", 4),
    ("27AAACR5O55K1z7", "DDLLLLLDDDDLXZX", "27AAACR5055K1Z7", 1), ("27AAACR5055K122", "DDLLLLLDDDDLXZX", "27AAACR5055K1Z2", 1), ("SB1N0OO1Z34", "LLLL0BBBBBB", "SBIN0001234", 4), ("SBINO0ab12e", "LLLL0BBBBBB", "SBIN00AB12E", 1), ("SBIN100123é", "LLLL0BBBBBB", None, None), (None, "LLLL0BBBBBB", None, None),
])
def test_fit_slots(spark, raw, slots, value, corrections):
    got = spark.range(1).select(fit_slots(F.lit(raw).cast("string"), slots).alias("x")).first().x
    assert (got and (got.value, got.corrections)) == (None if value is None else (value, corrections))


def test_corrected_identifiers_compute_once(spark):
    """The words of a line are split and each value is fitted once, not once a run, a slot and a use."""
    known = F.array(F.struct(F.lit("ABCPE1234F").alias("value"), F.lit("pan").alias("kind")))
    lines = ["PAN ABCPE I234F and 3456 789O 1238", "ab cd ef gh", "", None, "due 1,23,456,789,012 ok"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("i", corrected_identifiers(F.col("t"), known).alias("x"))
    got = {r.i: [(x.start, x.end, x.kind, x.value, x.corrections, x.proven) for x in r.x or []] for r in df.collect()}
    assert got == {0: [(4, 15, "pan", "ABCPE1234F", 1, True), (20, 34, "aadhaar", "345678901238", 1, True)], 1: [], 2: [], 3: [], 4: []}
    assert df._jdf.queryExecution().analyzed().toString().count("translate(t#") == 1
