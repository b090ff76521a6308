"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes.

A is a byte-level BPE (read after a leading space), B a sentencepiece BPE with
byte fallback (which adds that space itself).  Their tokens of a text are the
two sides of a bipartite graph with an edge where the byte ranges of two tokens
overlap; union-find over it gives its connected components, which are exactly
the minimal groups: they end where tokens of both sides end.  The members of a
component whose ranges end together are linked.  Links are counted over the
whole corpus for each pair of ids, and each document is told by these counts.

No token of either side crosses a single space between two words, so a text is
cut there into units, and each distinct unit of a block of documents is encoded
and aligned once.  ``unit_spans`` says where it is safe to cut.

1. A task turns its documents, block by block of about BLOCK text bytes, into
   compressed chunks (documents as lists of local unit numbers) and one row with
   the block's distinct pairs of ids and how often its documents link them.
2. Pairs are summed over all blocks by a plain aggregation, and compared with the
   highest count of their B id.
3. The counts return to the blocks that hold the pair.  A block's rows come to
   one task in order, counts before documents, and are streamed, so a task holds
   one block's pairs and a batch of chunks.  A frequent pair crosses the wire
   once a block, never once a document.

Defined edge cases: null and empty texts and texts whose tokens do not give back
a space and the text (those with U+2581, say) have no tokens: zeros and an empty
string; a text without spaces is one unit, whole, whatever its length; ids may
be null or repeat, and each row counts; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import from_bytes, to_bytes
from .common import partitions, settle, table
from .kernels import chunks, ragged, text_buffer, trimmed, word_hashes

#: Text bytes of a block and of a chunk of documents; units encoded by one call.
BLOCK, CHUNK, BATCH = 24 << 20, 1 << 20, 8_000
ROWS = "block long, kind int, seq long, pairs array<long>, counts array<long>, data binary"
#: What may follow a space that starts a unit: the byte starts no white space of any kind.
_STARTS = np.ones(256, bool)
_STARTS[:33] = False
_STARTS[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def unit_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, unit offset of each text): texts cut at spaces that stand behind
    something else than ASCII white space and before a byte that starts no white space.

    A's splitter starts a token at such a space, as white space before a word keeps
    its last character for it; B has no piece with a space behind another character."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        cut[1:-1] = (data[1:-1] == 32) & (data[:-2] > 32) & _STARTS[data[2:]]
    some = offsets[1:] > offsets[:-1]
    cut[offsets[:-1][some]] = False
    cut[offsets[1:][some] - 1] = False
    at = np.flatnonzero(cut)
    starts = np.sort(np.concatenate((offsets[:-1][some], at + 1)))
    ends = np.sort(np.concatenate((offsets[1:][some], at)))
    return starts, ends, np.searchsorted(starts, offsets)


def union_find(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component over the edges (x, y):
    every root is hooked to the least neighbouring root, then all paths are halved."""
    top = np.arange(n)
    while True:
        a, b = top[x], top[y]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return top
        np.minimum.at(top, high, low)
        while True:
            nxt = top[top]
            if (nxt == top).all():
                break
            top = nxt


class Pieces:
    """Bytes of the ids of a vocabulary, and their decimal names."""

    def __init__(self, pieces: list[bytes]):
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        names = [str(i).encode() for i in range(len(pieces))]
        self.name_lengths = np.array([len(x) for x in names], np.int64)
        width = int(self.name_lengths.max(initial=1))
        self.names = np.frombuffer(b"".join(x.ljust(width) for x in names), np.uint8).reshape(-1, width)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.at[ids], self.lengths[ids])]


def _byte_level() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both tokenizers, loaded once a task."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_level()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.of_a = Pieces([bytes(byte[c] for c in x) if all(c in byte for c in x) else x.encode() for x in entries])
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece of B holds a space behind another character: texts cannot be cut at spaces")
        self.of_b = Pieces([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)], self.b.encode(units, num_threads=1)


def align_units(sides: Sides, units: list[str]) -> dict[str, np.ndarray]:
    """Of each unit: valid, n_a, n_b, n_groups, frag (length of its groups' text, each group
    with a semicolon behind it), links (how many); and flat: text, pairs (a << 32 | b)."""
    a_ids, b_ids = sides.encode(units)
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(units)) for x in (a_ids, b_ids))
    flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_ids, n_a), (b_ids, n_b)))
    raw = [b" " + u.encode() for u in units]
    size = np.fromiter(map(len, raw), np.int64, len(units))
    unit_a, unit_b = (np.repeat(np.arange(len(units)), n) for n in (n_a, n_b))
    len_a, len_b = sides.of_a.lengths[flat_a], sides.of_b.lengths[flat_b]
    valid = (np.bincount(unit_a, len_a, len(units)) == size) & (np.bincount(unit_b, len_b, len(units)) == size)
    # bytes are compared where the lengths agree
    source = np.frombuffer(b"".join(r for r, v in zip(raw, valid.tolist(), strict=True) if v), np.uint8)
    owner = np.repeat(np.flatnonzero(valid), size[valid])
    for pieces, flat, unit in ((sides.of_a, flat_a, unit_a), (sides.of_b, flat_b, unit_b)):
        valid[owner[pieces.joined(flat[valid[unit]]) != source]] = False
        keep = valid[owner]
        source, owner = source[keep], owner[keep]
    in_a, in_b = valid[unit_a], valid[unit_b]
    flat_a, flat_b, unit_a, unit_b, len_a, len_b = flat_a[in_a], flat_b[in_b], unit_a[in_a], unit_b[in_b], len_a[in_a], len_b[in_b]
    n_a, n_b = np.where(valid, n_a, 0), np.where(valid, n_b, 0)

    # the tokens of both sides cover the same bytes; an edge is an overlap
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    first = np.searchsorted(end_b, end_a - len_a, side="right")
    many = np.searchsorted(end_b, end_a, side="left") - first + 1
    top = union_find(len(flat_a) + len(flat_b), np.repeat(np.arange(len(flat_a)), many), len(flat_a) + ragged(first, many))
    number = np.cumsum(top == np.arange(len(top))) - 1  # a component's least node is of A
    group_a, group_b = number[top[: len(flat_a)]], number[top[len(flat_a) :]]
    groups = int(group_a.max(initial=-1)) + 1
    ca, cb = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    unit_of_group = unit_a[np.cumsum(ca) - ca]

    # links: members of a component that end together
    _, i, j = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
    same = group_a[i] == group_b[j]
    i, j = i[same], j[same]

    # text of groups: A's ids, then B's, group by group
    place_a = np.arange(len(flat_a)) + (np.cumsum(cb) - cb)[group_a]
    place_b = np.arange(len(flat_b)) + np.cumsum(ca)[group_b]
    total = len(flat_a) + len(flat_b)
    width = 1 + max(sides.of_a.names.shape[1], sides.of_b.names.shape[1])
    letters, lengths = np.zeros((total, width), np.uint8), np.zeros(total, np.int64)
    for pieces, flat, place, group, sep in ((sides.of_a, flat_a, place_a, group_a, b"|"), (sides.of_b, flat_b, place_b, group_b, b";")):
        letters[place, : pieces.names.shape[1]] = pieces.names[flat]
        n = pieces.name_lengths[flat]
        last = np.append(group[1:] != group[:-1], True)[: len(group)]
        letters[place, n] = np.where(last, sep[0], 44)
        lengths[place] = n + 1
    text = letters[np.arange(width)[None] < lengths[:, None]]
    frag = np.bincount(unit_a, lengths[place_a], len(units)) + np.bincount(unit_b, lengths[place_b], len(units))
    return {
        "valid": valid, "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(unit_of_group, minlength=len(units)), "frag": frag.astype(np.int64),
        "links": np.bincount(unit_a[i], minlength=len(units)), "text": text, "pairs": (flat_a[i] << 32) | flat_b[j],
    }


class Block:
    """The distinct units of a block, aligned, numbered in the order in which they came."""

    PER_UNIT, FLAT = ("valid", "n_a", "n_b", "n_groups", "frag", "links"), ("text", "pairs")

    def __init__(self, sides: Sides):
        self.sides, self.bytes = sides, 0
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.found: dict[str, np.ndarray] = {x: np.zeros(0, np.int64) for x in self.PER_UNIT} | {"text": np.zeros(0, np.uint8), "pairs": np.zeros(0, np.int64)}
        self.uses = np.zeros(0, np.int64)
        self.rows: list[bytes] = []

    def units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each unit; new ones are aligned."""
        every = word_hashes(data, starts, ends)
        values, first = np.unique(every, return_index=True)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
            new = self.hashes[at] != values
            values, first = values[new], first[new]
        if len(values):
            raw, parts = data.tobytes(), [self.found]
            for k in range(0, len(first), BATCH):
                some = first[k : k + BATCH]
                parts.append(align_units(self.sides, [raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]))
            self.found = {x: np.concatenate([p[x] for p in parts]) for x in (*self.PER_UNIT, *self.FLAT)}
            hashes = np.concatenate((self.hashes, values))
            numbers = np.concatenate((self.numbers, len(self.uses) + np.arange(len(values))))
            order = np.argsort(hashes)
            self.hashes, self.numbers = hashes[order], numbers[order]
            self.uses = np.concatenate((self.uses, np.zeros(len(values), np.int64)))
        return self.numbers[np.searchsorted(self.hashes, every)]

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, digest: bool) -> None:
        starts, ends, uo = unit_spans(data, offsets)
        of = self.units(data, starts, ends)
        bad = np.concatenate(([0], np.cumsum(self.found["valid"][of] == 0)))[uo]
        good = np.diff(bad) == 0
        doc = np.repeat(np.arange(len(good)), np.diff(uo))
        of, doc = of[good[doc]], doc[good[doc]]
        self.uses += np.bincount(of, minlength=len(self.uses))
        n = np.bincount(doc, minlength=len(good))
        told = {x: np.bincount(doc, self.found[x][of], len(good)).astype(np.int64) for x in ("n_a", "n_b", "n_groups", "links", "frag")}
        frag_at = np.cumsum(self.found["frag"]) - self.found["frag"]
        text = self.found["text"][ragged(frag_at[of], self.found["frag"][of])].tobytes()
        cut = np.concatenate(([0], np.cumsum(told["frag"]))).tolist()
        groups = [text[a : b - 1] if b > a else b"" for a, b in zip(cut, cut[1:], strict=False)]
        groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups] if digest else [g.decode() for g in groups]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(of, pa.int32()))
        cols = [ids, *[pa.array(told[x]) for x in ("n_a", "n_b", "n_groups", "links")], pa.array(groups, pa.string()), lists]
        self.rows.append(to_bytes(pa.RecordBatch.from_arrays(cols, names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "units"])))
        self.bytes += len(data)

    def out(self, block: int) -> Iterator[pa.RecordBatch]:
        """The rows of a finished block: its pairs with their counts, which units hold them, and its chunks."""
        links = self.found["links"]
        values, place = np.unique(self.found["pairs"], return_inverse=True)
        counts = np.bincount(place, np.repeat(self.uses, links), len(values)).astype(np.int64)
        units = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(links))), pa.int32()), pa.array(place.ravel(), pa.int32()))
        yield _row(block, 0, 0, values, counts, None)
        yield _row(block, 1, 0, None, None, to_bytes(pa.RecordBatch.from_arrays([units], names=["units"])))
        for k, raw in enumerate(self.rows):
            yield _row(block, 2, k, None, None, raw)


def _row(block: int, kind: int, seq: int, pairs, counts, data) -> pa.RecordBatch:
    lists = [pa.array([None if x is None else x], pa.list_(pa.int64())) for x in (pairs, counts)]
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([seq], pa.int64()), *lists, pa.array([data], pa.binary())], names=["block", "kind", "seq", "pairs", "counts", "data"]
    )


def _blocks(a_path: str, b_path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number = Sides(a_path, b_path), TaskContext.get().partitionId() << 32
        block = Block(sides)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi, part, offs in chunks(data, offsets, CHUNK):
                block.add(batch.column(0).slice(lo, hi - lo), part, offs, digest)
                if block.bytes >= BLOCK:
                    yield from block.out(number)
                    block, number = Block(sides), number + 1
        if block.rows:
            yield from block.out(number)

    return run


def _told(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their counts, from a partition's rows in the order of block, kind and seq."""
    at, totals, best, units = None, [], [], None
    for batch in rows:
        block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        borders = np.concatenate(([0], np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(block)])) if len(block) else [0]
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            if block[a] != at:
                at, totals, best, units = block[a], [], [], None
            part = batch.slice(a, b - a)
            if kind[a] == 0:
                totals.append(part.column("total").to_numpy())
                best.append(part.column("best").to_numpy(zero_copy_only=False))
                continue
            if kind[a] == 1:
                lists = from_bytes(part.column("data")[0].as_py()).column(0)
                every, hit = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (totals, best))
                cuts, place = np.asarray(lists.offsets), np.asarray(lists.values)
                units = [np.diff(np.concatenate(([0], np.cumsum(x[place])))[cuts]) for x in (every, hit)]
                continue
            for raw in part.column("data"):
                docs = from_bytes(raw.as_py())
                lists = docs.column("units")
                cuts, of = np.asarray(lists.offsets), np.asarray(lists.values)
                count_sum, n_best = (np.diff(np.concatenate(([0], np.cumsum(x[of])))[cuts]) for x in units)
                yield pa.RecordBatch.from_arrays(
                    [*docs.columns[:5], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups")], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
                )


def blocks_of(docs: DataFrame, a_path: str, b_path: str, *, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The aligned blocks, written to the shared folder: what ``pair_counts`` and ``told`` read."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return settle(slim.mapInArrow(trimmed(_blocks(a_path, b_path, digest)), ROWS), "aligned")


def _local(blocks: DataFrame) -> DataFrame:
    rows = blocks.where("kind = 0").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("seq", "x"))
    return rows.select("block", F.col("seq").cast("long").alias("seq"), F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a_id, b_id, total, best): how many links of the corpus hold each pair of ids, and
    whether none of the B id is more frequent."""
    counted = _local(blocks).groupBy("pair").agg(F.sum("n").alias("total")).where("total > 0")
    counted = settle(counted.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "total"), "pairs")
    most = counted.groupBy("b_id").agg(F.max("total").alias("__most"))
    return counted.join(most, "b_id").select("a_id", "b_id", "total", (F.col("total") == F.col("__most")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, *, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the
    B id's most frequent), count_sum (of the links' pairs), groups (``a1,a2|b1;a3|b2,b3``;
    with ``digest`` groups_sha256)."""
    blocks = blocks_of(docs, a_path, b_path, digest=digest, id_col=id_col, text_col=text_col)
    pairs = pair_counts(blocks).select((F.shiftleft("a_id", 32) + F.col("b_id")).alias("pair"), "total", "best")
    # a pair that no whole document holds has no total
    back = _local(blocks).join(pairs, "pair", "left").select("block", F.lit(0).alias("kind"), "seq", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("best", F.lit(False)).alias("best"), F.lit(None).cast("binary").alias("data"))
    rest = blocks.where("kind > 0").select("block", "kind", "seq", F.lit(None).cast("long").alias("total"), F.lit(None).cast("boolean").alias("best"), "data")
    rows = back.unionByName(rest).repartition(2 * partitions(docs.sparkSession), "block").sortWithinPartitions("block", "kind", "seq")
    out = rows.mapInArrow(trimmed(_told), "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out.toDF(id_col, *out.columns[1:7], "groups_sha256" if digest else "groups")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
