"""As-of joins, generations and the gram index against plain versions."""

import datetime as dt
import random

import pytest

from sieveline.functions.fuzzy import approximate_spans
from sieveline.operators.asof import as_of, valid_actions
from sieveline.operators.ocr import approximate_candidates, approximate_matches

BEGIN = dt.datetime(2026, 1, 1)


def at(hours):
    return None if hours is None else BEGIN + dt.timedelta(hours=hours)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_is_the_last_state_before(spark, strict):
    rng = random.Random(2)
    when = lambda: rng.choice([None, *(rng.randrange(40) / 2 for _ in range(30))])
    key = lambda: rng.choice(["hot"] * 6 + ["a", None])
    rows = [(i, key(), when()) for i in range(300)]
    states = [(key(), when(), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    left = spark.createDataFrame([(i, k, at(h)) for i, k, h in rows], "id int, k string, t timestamp")
    right = spark.createDataFrame([(k, at(h), v) for k, h, v in states], "k string, s timestamp, v int")
    got = {r.id: r.v for r in as_of(left, right, ["k"], "t", "s", ["v"], strict=strict).collect()}
    want = {}
    for i, k, h in rows:
        before = [(x, -1 if v is None else v, v) for kk, x, v in states if None not in (k, h, x) and kk == k and (x < h or x == h and not strict)]
        want[i] = max(before)[2] if before else None
    assert got == want
    assert as_of(left, right.limit(0), ["k"], "t", "s", ["v"]).where("v is not null").count() == 0 and as_of(left.limit(0), right, ["k"], "t", "s", ["v"]).count() == 0


def test_stale_ids_are_refused_and_never_mapped(spark):
    captures = spark.createDataFrame([("r", at(0), 1), ("r", at(2), 2)], "run string, ts timestamp, generation int")
    issued = spark.createDataFrame([("r", 1, 7), ("r", 2, 7), ("r", 2, 8)], "run string, generation int, element int")
    rows = [(0, "r", at(1), 1, 7), (1, "r", at(3), 1, 7), (2, "r", at(3), 2, 8), (3, "r", at(3), 2, 9), (4, "r", at(3), None, 8), (5, "r", at(1), None, 8), (6, "x", at(1), 1, 7), (7, "x", at(1), None, 7)]
    actions = spark.createDataFrame(rows, "id int, run string, ts timestamp, generation int, element int")
    got = [r.verdict for r in valid_actions(actions, captures, issued, "run", "ts", "generation", "element").orderBy("id").collect()]
    assert got == ["ok", "stale", "ok", "unknown", "ok", "unknown", "stale", "unknown"]


def test_gram_index_loses_no_match_and_pairs_few(spark):
    rng = random.Random(4)
    letters = "abcdefghij0O1lS5 "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip() or "abcd"
    values = sorted({(c, word(rng.randrange(4, 22))) for c in (1, 2) for _ in range(25)} | {(1, "00000000"), (1, "aaaaaaaaaaaaaaaa")})

    def spoilt(v):
        v = list(v)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(v))
            v[i : i + 1] = rng.choice([[], [rng.choice(letters)], [v[i], rng.choice(letters)]])
            v = v or ["a"]
        return "".join(v)

    lines = [(c, 0, i, f"{word(9)} {spoilt(v)} {word(5)}") for i, (c, v) in enumerate(values * 3)] + [(1, 0, 900, "O0O0000O"), (1, 0, 901, None), (2, 0, 902, ""), (None, 0, 903, "abcdefgh")]
    left = spark.createDataFrame(lines, "capture_id int, block_id int, line_no int, text string")
    known = spark.createDataFrame([(c, v, "k") for c, v in values] + [(None, "abcdefgh", "k")], "capture_id int, value string, kind string")
    got = sorted((r.line_no, r.start, r.end, r.value) for r in approximate_matches(left, known).where("capture_id is not null").collect())
    want = sorted((n, a, b, v) for c, _, n, t in lines for k, v in values if k == c for a, b in approximate_spans(t or "", v))
    assert got == want and len(want) > 100
    assert approximate_candidates(left, known).count() < len(lines) * len(values) / 2 / 2


def test_values_that_begin_alike_pair_what_is_near_alone(spark):
    import time

    value = lambda i: f"Supplier#{i:09d}"
    left = spark.createDataFrame([(1, 0, i, "from " + value(i).replace("0", "O")) for i in range(700)], "capture_id int, block_id int, line_no int, text string")
    known = spark.createDataFrame([(1, value(i), "k") for i in range(0, 70_000, 100)], "capture_id int, value string, kind string")
    near = lambda a, b: any(len(set(x)) > 0 for x in approximate_spans("from " + value(a), value(b)))
    begun = time.time()
    found = {(r.line_no, int(r.value[9:])) for r in approximate_matches(left, known).collect()}
    assert time.time() - begun < 30  # one pair at a time: minutes
    assert approximate_candidates(left, known).count() <= 1.1 * len(found) < 700 * 700 / 4
    assert all(((a, b) in found) == near(a, b) for a in range(0, 700, 97) for b in range(0, 70_000, 1700))


def test_letters_whose_lower_case_is_longer_keep_their_places(spark):
    left = spark.createDataFrame([(1, 0, 0, "\u0130\u0130 Kavya Iyer Rao")], "capture_id int, block_id int, line_no int, text string")
    known = spark.createDataFrame([(1, "Kavya Iyer Rao", "k")], "capture_id int, value string, kind string")
    assert [(r.start, r.end) for r in approximate_matches(left, known).collect()] == [(3, 17)]


def test_visits_of_a_hot_key_are_those_of_a_plain_fold(spark):
    from pyspark.sql import functions as F

    from sieveline.operators.usage import counted_visits

    rng = random.Random(8)
    rows, old = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, n, step in (("hot", 1500, 40), ("busy", 300, 3), ("rare", 40, 90), (None, 60, 25), ("tasks", 30, 10)):
        now = 0.0
        for _ in range(n):
            now += rng.choice([0, 0, rng.uniform(0, step), 30 if rng.random() < 0.1 else 1])
            rows.append((key, BEGIN + dt.timedelta(seconds=round(now * 60)), key == "tasks" or rng.random() < 0.15))
    rows += [("first", BEGIN, True), ("first", BEGIN + dt.timedelta(minutes=5), False), ("first", BEGIN + dt.timedelta(minutes=6), False), ("x", None, False)]
    rng.shuffle(rows)
    want = {}
    for key, at, task in sorted((r for r in rows if r[1]), key=lambda r: (str(r[0]), r[1], not r[2])):
        visits, tasks, last = want.get(key, (0, 0, None))
        us = int((at - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        if task:
            want[key] = (visits, tasks + 1, us)
        elif visits == 0 or us - last >= 1_800_000_000:
            want[key] = (visits + 1, tasks, us)
    df = spark.createDataFrame(rows, "k string, ts timestamp, task boolean").repartition(5)
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {r.k: (r.visits, r.tasks, r.last_us) for r in counted_visits(df, ["k"], "ts", F.col("task")).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        assert got == want
