"""Vector bin packing of token sequences.

Documents are tokenised (byte-level BPE, then an end id) and cut into pieces.
Full-length pieces become sequences of their own.  The rest pieces are packed
under simultaneous limits on tokens, segments and loss-bearing tokens by the
dot-product heuristic: into the open sequence goes the fitting piece whose
demand vector has the largest dot product with the room left.  A sequence in
which nothing fits any more is filled by cutting a piece.  One that another
limit keeps from being full ends at a power of two, which needs no padding, and
gives back what lies behind; what remains of a task is cut into powers of two.  Each task packs its own
input, so that nothing is shuffled, and a retried task gives the same rows.

Tokens of a word do not depend on its neighbours: a space starts a new
pre-token unless it stands in a run of white space.  So each task keeps a
bounded table word -> ids and looks words up; runs of white space are encoded
separately.

Defined edge cases: a null text is empty and gives its end id alone; ids may be
null or repeat; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words kept in a task's table before it starts anew.
TABLE_WORDS = 1_000_000
#: Rest pieces that wait in a task's pool.
POOL = 2048
END_ID = 1
SPECIAL = "<|endoftext|>"
#: The pre-token pattern of byte_bpe_50k without its look-ahead; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
# Unicode White_Space, as the pattern's \s; Python's own \s has U+001C..U+001F too.
_WS = r"[\t-\r \x85\xa0  -     　]"
_RUNS = re.compile(f"({_WS}{{2,}})")


class WordEncoder:
    """text -> ids as little-endian unsigned 32-bit bytes, as the tokenizers library encodes."""

    def __init__(self, ranks_path: str, special_id: int = 50256, table_words: int = TABLE_WORDS):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._special = np.uint32(special_id).tobytes()
        self._most = table_words
        encode = self.encode_raw

        class Table(dict):
            def __missing__(self, word):
                self[word] = ids = encode(" " + word)
                return ids

        self._table = Table()

    def encode_raw(self, text: str) -> bytes:
        return np.array(self._plain.encode_ordinary(text), np.uint32).tobytes()

    def _spaced(self, text: str) -> bytes:
        """Any text without special tokens."""
        parts = _RUNS.split(text)
        if len(parts) == 1:
            return self._words(text)
        out = []
        for i in range(0, len(parts), 2):
            run = parts[i + 1] if i + 1 < len(parts) else ""
            # of a white-space run before a word, the last character is apart
            if run and i + 2 < len(parts) and parts[i + 2]:
                out.append(self._words(parts[i]))
                out.append(self.encode_raw(run[:-1]))
                parts[i + 2] = run[-1] + parts[i + 2]
            else:
                out += [self._words(parts[i]), self.encode_raw(run) if run else b""]
        return b"".join(out)

    def _words(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if len(self._table) > self._most:
            self._table.clear()
        head = self.encode_raw(first) if first else b""
        return head + b"".join(map(self._table.__getitem__, rest)) if rest else head

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL not in text:
            return self._spaced(text)
        return self._special.join(self._spaced(x) if x else b"" for x in text.split(SPECIAL))


class VectorPacker:
    """Places pieces (key, start, length, loss) into sequences; yields placements.

    ``limits``: most tokens, segments and loss-bearing tokens of a sequence."""

    def __init__(self, limits: tuple[int, int, int], emit: Callable[[object, int, int, int, int], None], pool: int = POOL):
        self.limits, self.emit, self.most = np.array(limits, np.float64), emit, pool
        self.items: list[tuple[object, int, int, int]] = []
        self.demand = np.zeros((pool, 3))
        self.sequence = 0

    def add(self, key: object, start: int, length: int, loss: int) -> None:
        """A piece of any length; ``loss`` of its last tokens bear loss."""
        tokens, segments, most_loss = (int(x) for x in self.limits)
        while length >= tokens or loss > most_loss:
            # full sequences need no search
            cut = min(tokens, length)
            lossy = max(0, min(cut, cut - (length - loss)))
            if lossy > most_loss:
                cut = cut - (lossy - most_loss)
                cut = 1 << (cut.bit_length() - 1)
                lossy = max(0, cut - (length - loss))
            self.emit(key, start, cut, self.sequence, 0)
            self.sequence += 1
            start, length, loss = start + cut, length - cut, loss - lossy
        if length:
            self.demand[len(self.items)] = (length, 1, loss)
            self.items.append((key, start, length, loss))
            if len(self.items) == self.most:
                while len(self.items) > self.most // 2:
                    self._fill()

    def _take(self, i: int) -> tuple[object, int, int, int]:
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.demand[i] = self.demand[len(self.items)]
        return item

    def _fill(self, cut: bool = True) -> None:
        """One sequence from the pool."""
        room, offset, placed = self.limits.copy(), 0, []
        while self.items and room[0] > 0 and room[1] > 0:
            demand = self.demand[: len(self.items)]
            fits = (demand <= room).all(axis=1)
            if fits.any():
                score = (demand / self.limits) @ (room / self.limits)
                key, start, length, loss = self._take(int(np.argmax(np.where(fits, score, -1))))
            elif cut and room[2] > 0:
                i = int(np.argmin(demand[:, 0]))
                key, start, whole, all_loss = self._take(i)
                length = int(min(room[0], whole))
                loss = max(0, length - (whole - all_loss))
                if loss > room[2]:
                    length, loss = int(length - (loss - room[2])), int(room[2])
                if length < whole:
                    self.demand[len(self.items)] = (whole - length, 1, all_loss - loss)
                    self.items.append((key, start + length, whole - length, all_loss - loss))
                if length <= 0:
                    break
            else:
                break
            placed.append((key, start, length, loss))
            offset += length
            room -= (length, 1, loss)
        if offset and room[0] > 0:
            offset = self._trim(placed, offset)
        at = 0
        for key, start, length, _ in placed:
            self.emit(key, start, length, self.sequence, at)
            at += length
        self.sequence += 1

    def _trim(self, placed: list, total: int) -> int:
        """Give back what ``placed`` holds behind the largest power of two."""
        keep = 1 << (total.bit_length() - 1)
        while total > keep:
            key, start, length, loss = placed.pop()
            stay = max(0, keep - (total - length))
            # the last tokens of a piece bear its loss
            stay_loss = max(0, stay - (length - loss))
            if stay:
                placed.append((key, start, stay, stay_loss))
            total -= length - stay
            back, back_loss = length - stay, loss - stay_loss
            if self.items and self.items[-1][:2] == (key, start + length):
                # what was cut off behind it
                more = self.items.pop()
                back, back_loss = back + more[2], back_loss + more[3]
            self.demand[len(self.items)] = (back, 1, back_loss)
            self.items.append((key, start + stay, back, back_loss))
        return total

    def finish(self) -> None:
        """Pack what waits; the last sequence is cut into powers of two."""
        while self.items:
            tokens, segments, loss = self.demand[: len(self.items)].sum(axis=0)
            # what is left keeps every limit, however it is cut
            if tokens < self.limits[0] and segments < self.limits[1] and loss <= self.limits[2]:
                break
            self._fill()
        rest = sum(x[2] for x in self.items)
        while self.items:
            left = 1 << (rest.bit_length() - 1)
            rest, offset = rest - left, 0
            while left:
                key, start, length, loss = self.items.pop()
                part = min(left, length)
                self.emit(key, start, part, self.sequence, offset)
                offset, left = offset + part, left - part
                if part < length:
                    self.items.append((key, start + part, length - part, loss))
            self.sequence += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(
    docs: DataFrame,
    ranks_path: str,
    *,
    tokens: int = 2048,
    segments: int = 256,
    loss_tokens: int | None = None,
    loss_share: float = 1.0,
    loss_col: str | None = None,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, unless ``with_ids`` is false, the piece's ids as
    little-endian unsigned 32-bit binary.

    ``segments`` and ``loss_tokens`` bound a sequence's pieces and loss-bearing
    tokens; of a document's tokens the last bear loss: as many as its ``loss_col``
    says (all where that is null), or without one the share ``loss_share``."""
    limits = (tokens, segments, loss_tokens or tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(ranks_path)
        end = np.uint32(END_ID).tobytes()
        waiting: dict[int, bytes] = {}
        left: dict[int, int] = {}
        rows: list[tuple] = []
        base = TaskContext.get().partitionId() << 40

        def emit(key, start, length, sequence, offset):
            number, doc = key
            ids = waiting[number]
            part = ids[4 * start : 4 * (start + length)]
            rows.append((doc, start, length, zlib.crc32(part), len(ids) // 4, base + sequence, offset, part if with_ids else None))
            left[number] -= length
            if not left[number]:
                del waiting[number], left[number]

        packer, number = VectorPacker(limits, emit), 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 7, pa.binary()), strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            told = batch.column(2).to_pylist() if loss_col else [None] * batch.num_rows
            for doc, text, loss in zip(batch.column(0).to_pylist(), batch.column(1), told, strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                number += 1
                waiting[number], left[number] = ids, n
                bears = (n if loss is None else max(0, loss)) if loss_col else round(n * loss_share)
                packer.add((number, doc), 0, n, min(n, bears))
                if len(rows) >= 4096:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col), *([F.col(loss_col).cast("long")] if loss_col else [])).mapInArrow(run, SCHEMA)
    return out if with_ids else out.drop("ids")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)
