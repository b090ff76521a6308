"""A vault that outlives a batch: numbering goes on where the last batch ended.

``VaultTable`` keeps, under a path, what ``vault.mint_tokens`` makes of one batch:
a token for each value of a kind in a session.  The rows are one table, bucketed by
session, kind and value, so that a new batch finds its known values by an anti-join
that moves the batch alone, and a session with a third of all values is spread over
all buckets.  New values are numbered from their session's counter on.

Appends are atomic.  Rows carry the attempt that wrote them, and count only once a
commit names that attempt; commits are numbered, and creating the file of a number
that exists fails.  So an append that breaks off leaves nothing visible, and of two
that started from the same state one fails (``ConflictError``) and is to be minted
anew.

A replay of a batch, before or after others, finds each of its requests in the vault
and gives the same tokens; ``tokens_for`` is that without minting.  A sealing without
a text is known by its place, so the columns of ``order`` must tell places of
different batches apart, by a capture's id, say.  ``end`` drops sessions: their
tokens become unknown, and their numbers start at 1 again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import stored
from .vault import fingerprint, is_sealed, prefix_of

ROWS = "session string, kind string, ident string, value string, fingerprint string, prefix string, number long, token string, attempt string"


class ConflictError(RuntimeError):
    """Another writer committed first; mint anew."""


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``number``: their place, from 1, among those of equal ``by`` in ``order``.

    Rows are ranged by both, so a group that holds most rows is cut into ranges: each
    range numbers its own rows, and gets the counts of those before it.  (``by`` and
    ``order`` together should tell rows apart; equal ones get any order.)"""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *[F.col(c).alias(n) for c, n in zip(order, names, strict=True)])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # written, so that a range keeps its rows when a task runs again
    ranged = stored(keyed.repartitionByRange(parts, *by, *names).withColumn("_range", F.spark_partition_id()), "ranged")
    own = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*names))
    counts = ranged.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    joined = ranged.withColumn("_own", own).join(offsets, same)
    return joined.withColumn("number", F.col("_own") + F.col("_before")).drop("_range", "_r", "_own", "_before", *names, *[f"_b{i}" for i in range(len(by))])


def requests(found: DataFrame, session: str, order: list[str]) -> DataFrame:
    """(session, kind, ident, value, fingerprint, prefix, first): what ``found`` asks tokens
    for, each once, at its first place.  ``ident`` tells a value, the fingerprint of a
    sealed one, and the place of a sealing without a text apart."""
    place = F.to_json(F.struct(*order))
    bare = F.coalesce(F.col("sealed"), F.lit(False)) if "sealed" in found.columns else F.lit(False)
    prefix = F.coalesce(prefix_of(F.col("kind")), F.raise_error(F.concat(F.lit("no token for kind "), F.col("kind"))))
    secret = is_sealed(F.col("kind"))
    mark = F.when(bare, place).when(secret, fingerprint(F.col("value")))
    value = F.when(~bare & ~secret, F.col("value"))
    ident = F.coalesce(F.concat(F.when(bare, F.lit("place ")).otherwise(F.lit("print ")), mark), F.concat(F.lit("value "), value))
    asked = found.where(bare | F.col("value").isNotNull()).select(F.col(session).cast("string").alias("session"), "kind", ident.alias("ident"), value.alias("value"), mark.alias("fingerprint"), prefix.alias("prefix"), F.struct(*order).alias("first"))
    return asked.groupBy("session", "kind", "ident", "value", "fingerprint", "prefix").agg(F.min("first").alias("first"))


class VaultTable:
    """The vault under ``path``; an existing one keeps its number of buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), f"vault_{uuid.uuid4().hex}"
        had = [x for x in self._list("") if x.startswith("buckets-")]
        if had and buckets and had[0] != f"buckets-{buckets}":
            raise ValueError(f"the vault at {path} has {had[0][8:]} buckets, not {buckets}")
        self.buckets = int(had[0][8:]) if had else buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        if not had:
            self._fs().mkdirs(self._path(f"buckets-{self.buckets}"))
        spark.sql(
            f"CREATE TABLE {self.name} ({ROWS}) USING parquet OPTIONS (path '{self.path}/rows') "
            f"CLUSTERED BY (session, kind, ident) SORTED BY (session, kind, ident) INTO {self.buckets} BUCKETS"
        )

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _commits(self) -> list[tuple[int, str]]:
        """(number, attempt) of each commit; as many as batches, two words each."""
        return [(int(n), attempt) for n, attempt in (x.split("-", 1) for x in self._list("commits") if not x.startswith("."))]

    def _commit(self, number: int, attempt: str) -> None:
        """Make an attempt count.  The claim on the number is a file that only one can create."""
        try:
            self._fs().create(self._path(f"claims/{number:010d}"), False).close()
        except Exception as e:
            raise ConflictError(f"commit {number} of {self.path} was made by another writer") from e
        self._fs().create(self._path(f"commits/{number:010d}-{attempt}"), False).close()

    def _state(self) -> tuple[DataFrame, int]:
        """All committed rows that no end of their session hides, and the next commit's number.

        A claim whose writer died before its commit is passed over."""
        commits = self._commits()
        following = max([n for n, _ in commits] + [int(x) for x in self._list("claims") if not x.startswith(".")], default=0) + 1
        table = self.spark.table(self.name)
        if not commits:
            return table.where("false").drop("attempt"), following
        made = self.spark.createDataFrame(commits, "at long, made string")
        rows = table.join(F.broadcast(made), F.col("attempt") == F.col("made")).drop("attempt", "made")
        ends = rows.where("kind is null").groupBy(F.col("session").alias("_ended")).agg(F.max("at").alias("_at"))
        live = rows.where("kind is not null").join(ends, F.col("session").eqNullSafe(F.col("_ended")), "left").where("_at is null or at > _at")
        return live.drop("at", "_ended", "_at"), following

    def _append(self, rows: DataFrame, following: int) -> None:
        attempt = uuid.uuid4().hex
        shaped = rows.withColumn("attempt", F.lit(attempt)).select(*[x.split()[0] for x in ROWS.split(", ")])
        dealt = shaped.repartition(self.buckets, "session", "kind", "ident")
        dealt.write.mode("append").format("parquet").option("path", f"{self.path}/rows").bucketBy(self.buckets, "session", "kind", "ident").sortBy("session", "kind", "ident").saveAsTable(self.name)
        self._commit(following, attempt)

    def read(self) -> DataFrame:
        """(session, kind, value, fingerprint, token) of all that count, as ``mint_tokens`` gives them."""
        return self._state()[0].select("session", "kind", "value", "fingerprint", "token")

    def mint(self, found: DataFrame, session: str, order: list[str]) -> DataFrame:
        """(session, kind, value, fingerprint, token) for each request of ``found``; new ones
        are numbered in ``order`` behind their session's numbers and appended."""
        state, following = self._state()
        asked = stored(requests(found, session, order), "asked")
        key = ["session", "kind", "ident"]
        same = lambda a, b: a["session"].eqNullSafe(b["session"]) & (a["kind"] == b["kind"]) & (a["ident"] == b["ident"])
        known = state.select(*key)
        new = asked.join(known, same(asked, known), "left_anti")
        counters = state.groupBy(F.col("session").alias("_s"), F.col("prefix").alias("_p")).agg(F.max("number").alias("_from"))
        placed = numbered(new, ["session", "prefix"], ["first", "kind", "ident"])
        placed = placed.join(counters, F.col("session").eqNullSafe(F.col("_s")) & (F.col("prefix") == F.col("_p")), "left")
        placed = placed.withColumn("number", F.col("number") + F.coalesce("_from", F.lit(0))).drop("_s", "_p", "_from", "first")
        placed = stored(placed.withColumn("token", F.concat(F.lit("<"), "prefix", F.lit("_"), F.col("number").cast("string"), F.lit(">"))), "minted")
        if not placed.isEmpty():
            self._append(placed, following)
        return self._tokens(asked, same)

    def tokens_for(self, found: DataFrame, session: str, order: list[str]) -> DataFrame:
        """The same for requests that were minted before; one that was not is an error."""
        asked = requests(found, session, order)
        same = lambda a, b: a["session"].eqNullSafe(b["session"]) & (a["kind"] == b["kind"]) & (a["ident"] == b["ident"])
        told = self._tokens(asked, same)
        missing = F.raise_error(F.concat(F.lit("out of step: no token was minted for a "), F.col("kind")))
        return told.withColumn("token", F.coalesce("token", missing))

    def _tokens(self, asked: DataFrame, same) -> DataFrame:
        known = self._state()[0].select("session", "kind", "ident", "token")
        return asked.join(known, same(asked, known), "left").select(asked["session"], asked["kind"], "value", "fingerprint", "token")

    def end(self, sessions: DataFrame, session: str) -> None:
        """Drop the mappings of the given sessions, so far as they are made by now."""
        ended = sessions.select(F.col(session).cast("string").alias("session")).distinct()
        empty = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in ROWS.split(", ")[1:-1]]
        self._append(ended.select("session", *empty), self._state()[1])

    def close(self) -> None:
        """Forget the table in this session's catalog; the vault stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
