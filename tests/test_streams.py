"""Streams with state give what the batch operators give, rows shuffled and repeated."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators.actions import fold_events, settled_at
from sieveline.operators.vault import mint_tokens
from sieveline.streaming.sessions import STORE, fold_stream, settled_stream, vault_stream


@pytest.fixture
def state_on_disk(spark):
    wanted = STORE | {"spark.sql.shuffle.partitions": "3"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, folder, parts, ddl, build, mode):
    """The rows of a stream over micro-batches of the given rows, in order."""
    out = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(ddl).parquet(f"{folder}/in"))
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination(300)
    return out


def test_fold(spark, tmp_path, state_on_disk):
    rng = random.Random(3)
    kinds = ["entry", "append", "append", "append", "replace"]
    rows = [(rng.choice(["hot", "hot", "a", "b"]), f"e{rng.randrange(4)}", i, rng.choice(kinds), rng.choice([None, f"t{i} "])) for i in range(160)]
    ddl = "s string, e string, o long, kind string, text string"
    live = [r for r in rows if r[0] != "b" or r[2] > 90]
    rows.append(("b", None, 90, "end", None))
    seen = [*rows, *rng.sample(rows, 60)]
    rng.shuffle(seen)
    parts = [seen[:70], seen[70:150], seen[150:]]
    got = {}
    for r in run(spark, tmp_path, parts, ddl, lambda df: fold_stream(df, "s", "e", "o", "kind", "text"), "update"):
        got[r.session, r.entry] = r.text
    want = {(r.s, r.e): r.text for r in fold_events(spark.createDataFrame(live, ddl), ["s", "e"], "o", "kind", "text").collect()}
    # what ended has no text that counts any more
    assert {k: v for k, v in got.items() if k in want} == want and {k[0] for k in got.keys() - want.keys()} <= {"b"}


def test_vault_goes_on_and_ends(spark, tmp_path, state_on_disk):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "x"]), t, rng.choice(["email", "pan", "otp"]), f"v{rng.randrange(12)}", False) for t in range(120)]
    ddl = "s string, t long, kind string, value string, ends boolean"
    parts = [rows[:60] + rows[:20], rows[40:], [("hot", 500, None, None, True)], [("hot", 501, "pan", "new", False), ("x", 501, "pan", "new", False)]]
    out = run(spark, tmp_path, parts, ddl, lambda df: vault_stream(df, "s", ["t"], F.col("ends")), "update")
    told = lambda rs: {(r.session, r.kind, r.value, r.fingerprint, r.token) for r in rs}
    want = {(r.s, r.kind, r.value, r.fingerprint, r.token) for r in mint_tokens(spark.createDataFrame(rows, ddl).drop("ends"), "s", ["t"]).collect()}
    new = {x for x in told(out) if x[2] == "new"}
    assert told(out) - new == want
    assert {x[0]: x[-1] for x in new}["hot"] == "<PAN_1>" and {x[0]: x[-1] for x in new}["x"] != "<PAN_1>"


def test_settled_pages(spark, tmp_path, state_on_disk):
    rng = random.Random(7)
    begin = dt.datetime(2026, 1, 1)
    cases = {"none": [], "late": [0.3], "one": [0.1], "busy": [i * 0.1 for i in range(40)], "gap": [0.05, 0.1, 0.3, 0.35], "edge": [0.25, 0.37, 0.5]}
    cases |= {f"r{i}": sorted(rng.uniform(0, 4) for _ in range(rng.randrange(30))) for i in range(12)}
    rows, plain = [], []
    for i, (k, xs) in enumerate(cases.items()):
        at = begin + dt.timedelta(seconds=i * 0.01)
        rows += [(k, at, at + dt.timedelta(microseconds=round(x * 1e6))) for x in xs] + [(k, at, None)]
        plain += [(k, round(x * 1e6) / 1e6) for x in xs] + [(k, None)]
    rng.shuffle(rows)
    ddl = "k string, begun timestamp, at timestamp"
    cut = len(rows) // 2
    much = begin + dt.timedelta(hours=1)
    parts = [rows[:cut], rows[cut:] + rows[:20], [("last", much, None)], [("last", much, much + dt.timedelta(hours=1))]]
    got = {r.key: r.settled for r in run(spark, tmp_path, parts, ddl, lambda df: settled_stream(df, "k", "begun", "at", "1 minute"), "append")}
    want = {r.k: r.settled for r in settled_at(spark.createDataFrame(plain, "k string, s double"), ["k"], "s").collect()}
    assert {k: round(v, 6) for k, v in got.items() if k != "last"} == {k: round(v, 6) for k, v in want.items()}
