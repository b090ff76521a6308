"""A vault over several batches, and texts restored behind joins."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators.vault import mint_tokens, restore_texts
from sieveline.operators.vault_store import ConflictError, VaultTable, numbered

DDL = "session string, capture int, start int, kind string, value string, sealed boolean"
ORDER = ["capture", "start"]


def findings(seed, captures, n=150):
    rng = random.Random(seed)
    kinds = ["email", "pan", "otp", "credential_field", "secret"]
    rows = []
    for i in range(n):
        kind, sealed = rng.choice(kinds), rng.random() < 0.2
        session = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        rows.append((session, rng.choice(captures), i, kind, None if sealed else f"v{rng.randrange(25)}", sealed))
    return [*rows, ("a", captures[0], n, "email", None, False)]


def told(df):
    return sorted(((r.session, r.kind, r.value, r.fingerprint, r.token) for r in df.collect()), key=repr)


def test_batches_and_their_replay_equal_one_batch(spark, tmp_path):
    one, two = findings(1, [1, 2]), findings(2, [3, 4])
    first, second, both = (spark.createDataFrame(x, DDL) for x in (one, two, one + two))
    vault = VaultTable(spark, f"file://{tmp_path}/vault", buckets=3)
    before = told(vault.mint(first, "session", ORDER))
    after = told(vault.mint(second, "session", ORDER))
    want = told(mint_tokens(both, "session", ORDER))
    assert told(vault.read()) == want and {*before, *after} == {*want}
    # in any order, once more, and from another handle on the same files
    again = VaultTable(spark, f"file://{tmp_path}/vault")
    assert told(again.mint(first, "session", ORDER)) == before and told(again.tokens_for(second, "session", ORDER)) == after
    assert told(again.read()) == want and len(set(x[0::4] for x in want)) == len(want)
    with pytest.raises(Exception, match="out of step"):
        again.tokens_for(spark.createDataFrame([("a", 9, 9, "email", "new", False)], DDL), "session", ORDER).collect()
    with pytest.raises(ValueError, match="buckets"):
        VaultTable(spark, f"file://{tmp_path}/vault", buckets=4)


def test_an_append_counts_wholly_or_not_at_all(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("s", 1, 0, "email", "a", False)], DDL)
    more = spark.createDataFrame([("s", 2, 0, "email", "b", False), ("s", 2, 1, "email", "a", False)], DDL)
    vault = VaultTable(spark, f"file://{tmp_path}/v", buckets=2)
    with monkeypatch.context() as m:
        m.setattr(VaultTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            vault.mint(rows, "session", ORDER)
    assert vault.read().count() == 0
    # a writer that claimed a number and died is passed over; one that comes second fails
    vault._fs().create(vault._path("claims/0000000001"), False).close()
    assert [x[-1] for x in told(vault.mint(rows, "session", ORDER))] == ["<EMAIL_1>"]
    stale = vault._state()
    monkeypatch.setattr(VaultTable, "_state", lambda self: (stale[0], 2))
    with pytest.raises(ConflictError):
        vault.mint(more, "session", ORDER)
    monkeypatch.undo()
    assert [x[2::2] for x in told(vault.mint(more, "session", ORDER))] == [("a", "<EMAIL_1>"), ("b", "<EMAIL_2>")]


def test_an_ended_session_starts_anew(spark, tmp_path):
    vault = VaultTable(spark, f"file://{tmp_path}/v", buckets=2)
    vault.mint(spark.createDataFrame([("s", 1, 0, "email", "a", False), ("t", 1, 1, "email", "b", False)], DDL), "session", ORDER)
    vault.end(spark.createDataFrame([("s",)], "session string"), "session")
    assert [x[0] for x in told(vault.read())] == ["t"]
    assert [x[-1] for x in told(vault.mint(spark.createDataFrame([("s", 2, 0, "email", "c", False)], DDL), "session", ORDER))] == ["<EMAIL_1>"]
    assert sorted(x[2] for x in told(vault.read())) == ["b", "c"]
    assert vault.mint(spark.createDataFrame([], DDL), "session", ORDER).count() == 0


def test_numbers_of_a_hot_group_are_gapless(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 5 else "cold", random.Random(i).random()) for i in range(3000)]
    got = numbered(spark.createDataFrame(rows, "g string, x double"), ["g"], ["x"]).collect()
    for g in ("hot", "cold", None):
        mine = sorted((r.x, r.number) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1)) and mine


def test_restored_texts_stay_beside_their_own_columns(spark):
    """20,000 rows behind a shuffle, with a wide column: each comes back with its own address."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("16", "1m", "-1"), strict=True):
            spark.conf.set(k, v)
        ids = spark.range(20_000)
        vault = ids.select(F.col("id").alias("s"), F.lit("<EMAIL_1>").alias("token"), F.concat("id", F.lit("@x.in")).alias("value"))
        wide = ids.select(F.col("id").alias("s"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("wide"))
        texts = ids.select(F.col("id").alias("s"), F.lit("to <EMAIL_1>, \x01 and <PAN_2>").alias("text")).join(wide, "s")
        back = restore_texts(texts, vault, "s", "text")
        right = back.where(F.col("text") == F.concat(F.lit("to "), "s", F.lit("@x.in, \x01 and <PAN_2>"))).where(F.col("wide") == F.repeat(F.sha2(F.col("s").cast("string"), 256), 8)).where(F.size("unknown") == 1)
        assert back.count() == right.count() == 20_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
