"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against the documents with smaller ids.  The
reference is indexed in blocks (input partitions) in two steps:

1. Anchors: each window of ``window`` words selects the smallest hash among its
   k-word grams.  Equal windows select equal anchors, so only windows whose
   anchor occurs in two documents can repeat.  Runs share an anchor, so there
   are about a fifth as many anchors as words.
2. Windows: those windows, hashed, with the first occurrence of each: smallest
   doc_id, then place.

A document is then parsed greedily from left to right.  A match is a run of
windows whose first occurrences follow each other in one earlier document, so
that the whole match stands there in one piece; at each word the longest match
over it becomes a factor, and the next factor starts at its end.  Windows that
straddle two factors are indexed like all others, so duplicates across factor
boundaries are found.  Words inside factors go.  The index knows the first
occurrence of a window alone: where a later reference holds a longer match, that
match is told as several factors; the words that go are the same.

Both steps are block-wise exchanges (``blocks``), so a passage in a third of
all documents is one entry of each block, and no task gathers its documents.

Defined edge cases: a null text has no words; a null id is never a reference
and loses no words; rows with equal ids never count as earlier than each other;
texts shorter than a window are kept whole; extra columns are carried or
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .blocks import bucket_count, chunk_batches, document_chunks, stabilised
from .common import table
from .kernels import buckets_of, chunks, gram_hashes, joined, range_hashes, sliding_min, squeeze, squeeze_sorted, starts_within, text_buffer, unsqueeze, unsqueeze_sorted, word_hashes, words

WINDOW = 13
GRAM = 5
_U = np.uint64
_LOW = np.iinfo(np.int64).min


def _parsed(column: pa.Array):
    """Per chunk: first row, end row, data, words and word hashes."""
    data, offsets = text_buffer(column)
    for lo, hi, part, offs in chunks(data, offsets):
        starts, ends, wo = words(part, offs)
        yield lo, hi, part, starts, ends, wo, word_hashes(part, starts, ends)


def _anchors(hashes: np.ndarray, wo: np.ndarray, window: int, gram: int):
    """(window positions, documents, anchor of each)."""
    at, doc = starts_within(wo, window)
    if not len(at):
        return at, doc, np.zeros(0, _U)
    return at, doc, sliding_min(gram_hashes(hashes, gram), window - gram + 1)[at]


def _runs(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One value for each run of equal values within a document."""
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return x[keep]


def _block_anchors(columns, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct anchors, ascending, and whether each occurs in more than one run."""
    parts = []
    for column in columns:
        for *_, wo, hashes in _parsed(column):
            _, doc, anchor = _anchors(hashes, wo, window, gram)
            parts.append(_runs(anchor, doc))
    values, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, _U), return_counts=True)
    return values, counts > 1


def _batch(columns: dict, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], names=list(columns))


def _send_anchors(window: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, many = _block_anchors((b.column(1) for b in batches), window, gram)
        block, of = TaskContext.get().partitionId(), buckets_of(values, buckets)
        cuts = np.searchsorted(of, np.arange(buckets + 1))
        rows = [(b, squeeze_sorted(values[i:j]), np.packbits(many[i:j]).tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        if rows:
            b, h, m = zip(*rows, strict=True)
            yield _batch({"block": [block] * len(rows), "bucket": b, "hashes": h, "many": m}, [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """One bucket: for each block, the bits of its anchors that occur elsewhere too."""
    lists = [unsqueeze_sorted(x.as_py()) for x in t.column("hashes")]
    many = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)).astype(bool) for x, h in zip(t.column("many"), lists, strict=True)]
    values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    cuts = np.cumsum([0, *map(len, lists)])
    bits = [np.packbits(twice[i:j] | m).tobytes() for i, j, m in zip(cuts, cuts[1:], many, strict=False)]
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary()), "n": pa.array([len(x) for x in lists], pa.int64())})


def _send_windows(window: int, gram: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        batches = list(chunk_batches(docs))
        block = docs.column("block")[0].as_py() if len(docs) else -1
        values, _ = _block_anchors((b.column(1) for b in batches), window, gram)
        order = np.argsort(answers.column("bucket").to_numpy())
        bits = [np.unpackbits(np.frombuffer(answers.column("bits")[int(i)].as_py(), np.uint8), count=answers.column("n")[int(i)].as_py()) for i in order]
        flags = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        if len(flags) != len(values):
            raise ValueError(f"block {block} has {len(values)} anchors, its index {len(flags)}: the input is not stable")
        wanted, found, ids, spots = values[flags], [], [], []
        for b in batches if len(wanted) else ():
            doc_ids, known = _ids(b)
            for lo, _, _, _, _, wo, hashes in _parsed(b.column(1)):
                at, doc, anchor = _anchors(hashes, wo, window, gram)
                if not len(at):
                    continue
                use = _member(anchor, wanted) & known[doc + lo]
                found.append(gram_hashes(hashes, window)[at[use]])
                ids.append(doc_ids[doc[use] + lo])
                spots.append(_spots(hashes, wo)[doc[use]] + at[use] - wo[doc[use]])
        h = np.concatenate(found) if found else np.zeros(0, _U)
        d = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        spot = np.concatenate(spots) if spots else np.zeros(0, np.int64)
        order = np.lexsort((spot, d, h))
        h, d, spot = h[order], d[order], spot[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(h)) - 1
        h, low, high, spot = h[first], d[first], d[last] if len(h) else d, spot[first]
        cuts = np.searchsorted(buckets_of(h, buckets), np.arange(buckets + 1))
        rows = [(b, squeeze_sorted(h[i:j]), squeeze(low[i:j]), squeeze(high[i:j] - low[i:j]), squeeze(spot[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        b, *blobs = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        return pa.table({"block": pa.array([block] * len(rows), pa.int64()), "bucket": pa.array(b, pa.int64()), **{n: pa.array(x, pa.binary()) for n, x in zip(("hashes", "low", "spread", "spot"), blobs, strict=True)}})

    return run


def _spots(hashes: np.ndarray, wo: np.ndarray) -> np.ndarray:
    """What, plus a place, tells places of a document from those of another with its
    id: 20 bits of its text's hash above 32 bits for the place."""
    return (range_hashes(hashes, wo[:-1], wo[1:]) >> _U(44)).astype(np.int64) << 32


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(0)
    return column.fill_null(_LOW).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def _member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are in the ascending array; a bit table weeds out most."""
    out = np.zeros(len(x), bool)
    if not len(ordered) or not len(x):
        return out
    bits = np.zeros(1 << 22, bool)
    bits[(ordered & _U((1 << 22) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(x & _U((1 << 22) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(ordered, x[maybe]), len(ordered) - 1)
    out[maybe] = ordered[at] == x[maybe]
    return out


def _first_owners(t: pa.Table) -> pa.Table:
    """One bucket: for each block, its windows that an earlier document has, and the first document and place."""
    lists = [unsqueeze_sorted(x.as_py()) for x in t.column("hashes")]
    low = [unsqueeze(x.as_py(), np.int64) for x in t.column("low")]
    high = [a + unsqueeze(x.as_py(), np.int64) for x, a in zip(t.column("spread"), low, strict=True)]
    _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    owner, spot = np.concatenate(low), np.concatenate([unsqueeze(x.as_py(), np.int64) for x in t.column("spot")])
    order = np.lexsort((spot, owner, inverse))
    least = order[np.flatnonzero(np.diff(inverse[order], prepend=-1))]
    owner, spot = owner[least][inverse], spot[least][inverse]
    cuts, blocks = np.cumsum([0, *map(len, lists)]), t.column("block").to_pylist()
    rows = []
    for block, h, top, i, j in zip(blocks, lists, high, cuts, cuts[1:], strict=False):
        keep = owner[i:j] < top
        if keep.any():
            rows.append((block, squeeze_sorted(h[keep]), squeeze(owner[i:j][keep]), squeeze(spot[i:j][keep])))
    b, h, o, s = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"block": pa.array(b, pa.int64()), "hashes": pa.array(h, pa.binary()), "owner": pa.array(o, pa.binary()), "spot": pa.array(s, pa.binary())})


FACTORS = "array<struct<start:long,n_words:long,ref_id:long,ref_start:long>>"


def _remove(window: int, digest: bool, schema: pa.Schema):
    """The final parse of a block's documents."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        lists = [unsqueeze_sorted(x.as_py()) for x in answers.column("hashes")]
        index = np.concatenate(lists) if lists else np.zeros(0, _U)
        owner = np.concatenate([unsqueeze(x.as_py(), np.int64) for x in answers.column("owner")]) if lists else np.zeros(0, np.int64)
        spot = np.concatenate([unsqueeze(x.as_py(), np.int64) for x in answers.column("spot")]) if lists else np.zeros(0, np.int64)
        order = np.argsort(index)
        index, owner, spot = index[order], owner[order], spot[order]
        out = []
        for batch in chunk_batches(docs):
            doc_ids, known = _ids(batch)
            n_words, n_removed, kept, factors = [], [], [], []
            for lo, hi, data, starts, ends, wo, hashes in _parsed(batch.column(1)):
                at, doc = starts_within(wo, window)
                grams = gram_hashes(hashes, window)[at] if len(at) else np.zeros(0, _U)
                use = np.flatnonzero(_member(grams, index))
                found = np.searchsorted(index, grams[use])
                earlier = known[doc[use] + lo] & (owner[found] < doc_ids[doc[use] + lo])
                use, found = use[earlier], found[earlier]
                parse = _parse(at[use], doc[use], owner[found], spot[found], window)
                steps = np.zeros(len(starts) + 1, np.int64)
                np.add.at(steps, parse[0], 1)
                np.add.at(steps, parse[0] + parse[1], -1)
                gone = np.cumsum(steps[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(gone)))
                n_words.append(np.diff(wo))
                n_removed.append(total[wo[1:]] - total[wo[:-1]])
                before = np.concatenate(([0], np.cumsum(~gone)))
                texts = joined(data, starts[~gone], ends[~gone], before[wo])
                kept += [hashlib.sha256(x).hexdigest() for x in texts] if digest else [x.decode() for x in texts]
                if not digest:
                    factors += _factors(*parse, wo, hi - lo)
            columns = [pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_removed), pa.int64()), pa.array(kept, pa.string())]
            if not digest:
                columns.append(pa.array(factors, schema.field("factors").type))
            out.append(pa.Table.from_arrays([batch.column(0), *columns, *batch.columns[2:]], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _parse(place, doc, ref, spot, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors, as start, words, reference and start there, of the windows at ``place``."""
    if not len(place):
        return (np.zeros(0, np.int64),) * 4
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(doc) != 0) | (np.diff(ref) != 0) | (np.diff(spot) != 1)
    first = np.flatnonzero(new)
    begin, end = place[first], place[np.append(first[1:], len(place)) - 1] + window
    # matches start and end in ascending order: of those over a word the last is the longest
    begins, ends, at, runs, starts = begin.tolist(), end.tolist(), 0, [], []
    for i, (a, b) in enumerate(zip(begins, ends, strict=True)):
        at = max(at, a)
        if at < b and (i + 1 == len(begins) or begins[i + 1] > at):
            runs.append(i)
            starts.append(at)
            at = b
    run, start = np.array(runs, np.int64), np.array(starts, np.int64)
    there = spot[first[run]] & ((1 << 32) - 1)
    return start, end[run] - start, ref[first[run]], there + start - begin[run]


def _factors(start, length, ref, there, wo, n_docs: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n_docs)]
    doc = np.searchsorted(wo, start, side="right") - 1
    for d, a, n, r, t in zip(doc, start - wo[doc], length, ref, there, strict=True):
        out[d].append({"start": int(a), "n_words": int(n), "ref_id": int(r), "ref_start": int(t)})
    return out


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, digest: bool = False, carry: list[str] | None = None, stable: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed and either ``kept_text`` and
    the ``factors`` or, with ``digest``, ``kept_sha256``; then the columns in
    ``carry``, unchanged."""
    carry = carry or []
    slim = stabilised(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]), stable)
    texts, buckets = slim.select("id", "text"), bucket_count(slim)
    anchors = texts.mapInArrow(_send_anchors(window, gram, buckets), "block long, bucket long, hashes binary, many binary")
    bits = anchors.groupBy("bucket").applyInArrow(_repeated, "block long, bucket long, bits binary, n long")
    windows = document_chunks(texts).groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_send_windows(window, gram, buckets), "block long, bucket long, hashes binary, low binary, spread binary, spot binary")
    owners = windows.groupBy("bucket").applyInArrow(_first_owners, "block long, hashes binary, owner binary, spot binary")
    named = f"id long, n_words long, n_removed long, {'kept_sha256 string' if digest else f'kept_text string, factors {FACTORS}'}"
    schema = StructType.fromDDL(named)
    schema = StructType([*schema.fields, *[f for f in slim.schema.fields[2:]]])
    out = document_chunks(slim).groupBy("block").cogroup(owners.groupBy("block")).applyInArrow(_remove(window, digest, to_arrow_schema(schema)), schema)
    return out.toDF(id_col, *schema.names[1 : len(schema) - len(carry)], *carry)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True, stable=True)


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), n AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i+12], ' ')) AS h FROM n
), f AS (
  SELECT h, min(doc_id) AS first_id FROM g GROUP BY h
), r AS (
  SELECT g.doc_id, g.i FROM g JOIN f USING (h) WHERE first_id < g.doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM r) GROUP BY doc_id
), k AS (
  SELECT w.doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, j: NOT list_contains(ps, j)), ' ')) AS kept_sha256
FROM k
"""
