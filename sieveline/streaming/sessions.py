"""Streams with state: folded transcripts, vaults of sessions, settled pages.

The state lives in the state store (``STORE`` names the provider that keeps it on
disk), one key at a time, so a task holds the rows of a micro-batch's key as an
iterator and of its state only what a row touches.  All three give what the batch
operators give (``actions.fold_events``, ``vault.mint_tokens``, ``actions.settled_at``)
when rows come shuffled over micro-batches and more than once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.vault import fingerprint, is_sealed, prefix_of
from ..operators.usage import micros

#: What these operators need; set it for the session.  Checksum files are written by a
#: pool of few threads, in which many state stores that commit at once wait for each other.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


def _mode(ttl_ms: int | None) -> str:
    """State that expires goes by the clock; such a query has a next micro-batch at any
    time, so it runs until it is stopped, whatever its trigger."""
    return "ProcessingTime" if ttl_ms else "None"


class _Fold(StatefulProcessor):
    """Per session: the live pieces of each entry, by their order."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.ttl_ms
        # one piece a row, so that an appended word does not write the text anew
        self.pieces = handle.getMapState("pieces", "entry string, ord long", "text string", ttl)
        self.orders = handle.getMapState("orders", "entry string", "orders array<long>", ttl)
        self.starts = handle.getMapState("starts", "entry string", "ord long", ttl)
        self.ended = handle.getValueState("ended", "ord long", ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        touched, ends = {}, self.ended.get()[0] if self.ended.exists() else None
        for batch in rows:
            for entry, order, kind, text in zip(batch["entry"], batch["ord"], batch["kind"], batch["text"], strict=True):
                order = int(order)
                if kind == "end":
                    ends = order if ends is None else max(ends, order)
                else:
                    touched.setdefault(entry, {})[order] = (kind in ("entry", "replace"), text or "")
        if ends is not None:
            if not self.ended.exists() or self.ended.get()[0] < ends:
                self._drop(ends)
            self.ended.update((ends,))
        out = []
        for entry, new in touched.items():
            new = {o: x for o, x in new.items() if ends is None or o > ends}
            if new:
                out.append((key[0], entry, self._folded(entry, new)))
        yield pd.DataFrame(out, columns=["session", "entry", "text"])

    def _folded(self, entry: str, new: dict) -> str:
        at = (entry,)
        start = self.starts.getValue(at)[0] if self.starts.containsKey(at) else None
        start = max([o for o, (begins, _) in new.items() if begins] + ([start] if start is not None else []), default=None)
        have = list(self.orders.getValue(at)[0]) if self.orders.containsKey(at) else []
        if start is not None:
            self.starts.updateValue(at, (start,))
            for o in have:
                if o < start:
                    self.pieces.removeKey((entry, o))
        live = sorted({o for o in (*have, *new) if start is None or o >= start})
        for o in live:
            if o in new:
                self.pieces.updateValue((entry, o), (new[o][1],))
        self.orders.updateValue(at, (live,))
        return "".join(new[o][1] if o in new else self.pieces.getValue((entry, o))[0] for o in live)

    def _drop(self, ends: int) -> None:
        """All that a session said up to its end goes; what was said since stays."""
        for at, orders in list(self.orders.iterator()):
            entry, stay = at[0], [o for o in orders[0] if o > ends]
            for o in orders[0]:
                if o <= ends:
                    self.pieces.removeKey((entry, o))
            if self.starts.containsKey((entry,)) and self.starts.getValue((entry,))[0] <= ends:
                self.starts.removeKey((entry,))
            if stay:
                self.orders.updateValue((entry,), (stay,))
            else:
                self.orders.removeKey((entry,))

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, session: str, entry: str, order: str, kind: str, text: str, ttl_ms: int | None = None) -> DataFrame:
    """(session, entry, text): whenever an entry's text changes, the whole of it; update mode.

    ``kind`` is entry, replace, append or end.  An end drops all that its session said
    before it in ``order``, whenever that arrives, and the state with it; with ``ttl_ms``
    so does that much silence."""
    rows = events.select(F.col(session).cast("string").alias("session"), F.col(entry).cast("string").alias("entry"), F.col(order).cast("long").alias("ord"), F.col(kind).alias("kind"), F.col(text).alias("text"))
    return rows.groupBy("session").transformWithStateInPandas(_Fold(ttl_ms), "session string, entry string, text string", "Update", _mode(ttl_ms))


class _Mint(StatefulProcessor):
    """Per session: the token of each value, and the last number of each prefix."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "kind string, ident string", "token string", self.ttl_ms)
        self.numbers = handle.getMapState("numbers", "prefix string", "number long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked: dict = {}
        ended = False
        for batch in rows:
            ended |= bool(batch["ends"].any())
            for r in batch[~batch["ends"]].itertuples(index=False):
                place = tuple(json.loads(r.place).values())
                old = asked.get((r.kind, r.ident))
                if old is None or place < old[0]:
                    asked[r.kind, r.ident] = (place, r.prefix, r.value, r.fingerprint)
        out = []
        for (kind, ident), (_, prefix, value, mark) in sorted(asked.items(), key=lambda x: (x[1][0], x[0])):
            at = (kind, ident)
            if self.tokens.containsKey(at):
                token = self.tokens.getValue(at)[0]
            else:
                number = (self.numbers.getValue((prefix,))[0] if self.numbers.containsKey((prefix,)) else 0) + 1
                token = f"<{prefix}_{number}>"
                self.numbers.updateValue((prefix,), (number,))
                self.tokens.updateValue(at, (token,))
            out.append((key[0], kind, value, mark, token))
        if ended:
            self.tokens.clear()
            self.numbers.clear()
        yield pd.DataFrame(out, columns=["session", "kind", "value", "fingerprint", "token"])

    def close(self) -> None:
        pass


def vault_stream(found: DataFrame, session: str, order: list[str], ends: Column | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(session, kind, value, fingerprint, token) for the findings of each micro-batch; update mode.

    Numbers go on from micro-batch to micro-batch; within one they follow ``order``.  A
    row for which ``ends`` is true ends its session behind its micro-batch: the
    mappings go, and numbers start again; with ``ttl_ms`` so does that much silence."""
    over = F.coalesce(ends, F.lit(False)) if ends is not None else F.lit(False)
    secret = is_sealed(F.col("kind"))
    mark = F.when(secret, fingerprint(F.col("value")))
    value = F.when(~secret, F.col("value"))
    prefix = F.when(~over, F.coalesce(prefix_of(F.col("kind")), F.raise_error(F.concat(F.lit("no token for kind "), F.col("kind")))))
    rows = found.where(over | F.col("value").isNotNull()).select(
        F.col(session).cast("string").alias("session"), "kind", F.coalesce(F.concat(F.lit("print "), mark), F.concat(F.lit("value "), value)).alias("ident"), value.alias("value"), mark.alias("fingerprint"),
        prefix.alias("prefix"), F.to_json(F.struct(*order)).alias("place"), over.alias("ends"),
    )
    return rows.groupBy("session").transformWithStateInPandas(_Mint(ttl_ms), "session string, kind string, value string, fingerprint string, token string", "Update", _mode(ttl_ms))


class _Settle(StatefulProcessor):
    """Per action: the changes after it, as microseconds, until it counts as settled."""

    def __init__(self, quiet: int, grace: int, ceiling: int):
        self.quiet, self.grace, self.ceiling = quiet, grace, ceiling

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getMapState("changes", "us long", "seen boolean")
        self.begun = handle.getValueState("begun", "us long, told boolean")

    def _settled(self, begun: int) -> int:
        """The first moment with silence behind it, by the changes known so far."""
        at = sorted(k[0] for k in self.changes.keys())
        if not at or at[0] > begun + self.grace:
            return begun + self.grace
        for us, following in zip(at, [*at[1:], None], strict=True):
            if following is None or following - us >= self.quiet:
                return min(us + self.quiet, begun + self.ceiling)
        return begun + self.ceiling

    def _wait(self, begun: int) -> None:
        """One timer: at the settled moment, or where it was told at the ceiling, to forget."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        told = self.begun.get()[1]
        us = begun + self.ceiling if told else self._settled(begun)
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        begun, told = (self.begun.get() if self.begun.exists() else (None, False))
        for batch in rows:
            for start, us in zip(batch["begun"], batch["us"], strict=True):
                begun = int(start) if begun is None else begun
                if not told and not pd.isna(us) and begun <= us <= begun + self.ceiling:
                    self.changes.updateValue((int(us),), (True,))
        self.begun.update((begun, told))
        self._wait(begun)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begun, told = self.begun.get()
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        if told:
            self.begun.clear()
            return
        # the watermark is past this moment, so no change before it is still to come
        settled = (self._settled(begun) - begun) / 1e6
        self.changes.clear()
        self.begun.update((begun, True))
        self.handle.registerTimer(-(-(begun + self.ceiling) // 1000) + 1)
        yield pd.DataFrame({"key": [key[0]], "settled": [settled]})

    def close(self) -> None:
        pass


def settled_stream(changes: DataFrame, key: str, begun: str, at: str, delay: str = "10 seconds", *, quiet: float = 0.12, grace: float = 0.25, ceiling: float = 3.0) -> DataFrame:
    """(key, settled): once the watermark passes the moment at which an action counts as settled, that moment
    in seconds after it; append mode.  ``begun`` is the action's time, ``at`` the time of a
    change after it (null: the row says of the action alone).  Rows later than ``delay`` are left out."""
    moment = F.coalesce(at, begun)
    rows = changes.withColumn("_at", moment).withWatermark("_at", delay)
    slim = rows.select(F.col(key).cast("string").alias("key"), micros(changes, begun).alias("begun"), micros(changes, at).alias("us"), "_at")
    us = [round(x * 1_000_000) for x in (quiet, grace, ceiling)]
    return slim.groupBy("key").transformWithStateInPandas(_Settle(*us), "key string, settled double", "Append", "EventTime")
