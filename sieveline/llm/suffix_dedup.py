"""Suffix-array dedup with sparse suffixes.

Of each document's word suffixes only those are kept that start at a minimiser:
each stretch of ``min_words`` words selects the smallest hash among its grams of
``min_words - window + 1`` words, the sort key.  Equal stretches select equal
places, so every repeat of ``min_words`` words holds a kept suffix and its whole
key.  Suffixes are sorted over the cluster (range partitioning; the order ends
with id and place, so that a passage in a third of all documents spreads over
many tasks), and the key is extended in two rounds:

1. by all stretches that selected the suffix: of neighbours that agree in them,
   the later repeats the earlier;
2. in groups that agree in the key but not in all stretches, by each stretch
   alone, for the first suffix of each kind (the others repeat it).  Only these
   go back to their texts.

Neighbours of equal stretches are in ascending order of id and place, so every
stretch but the first of its kind is found: a word is reported exactly if it
lies in ``min_words`` words that occur at an earlier place.  Longer matches are
unions of stretches; the order behind ``min_words`` words would not change them.

Defined edge cases: null and short texts have no suffixes; rows with a null id
take no part; a repeat within one document counts, the later place refers to
the earlier; rows with equal id and text count once; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_settled, settle, table
from .kernels import chunks, gram_hashes, mix, ragged, range_hashes, sliding_argmin, starts_within, text_buffer, word_hashes, words

MIN_WORDS, WINDOW = 40, 17


def suffixes(texts: DataFrame, min_words: int, window: int) -> DataFrame:
    """(k, m, id, row, place, back, n) of texts (id, text, row): the hash of the key, the
    hash of all stretches that selected it, and where in the document it stands; the
    first of the n stretches starts ``back`` words before."""
    gram = min_words - window + 1

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, _, part, offs in chunks(*text_buffer(batch.column(1))):
                starts, ends, wo = words(part, offs)
                at, doc = starts_within(wo, min_words)
                if not len(at):
                    continue
                hashes = word_hashes(part, starts, ends)
                grams = gram_hashes(hashes, gram)
                chosen = sliding_argmin(grams, window)[at]
                first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
                n = np.diff(np.append(first, len(at)))
                place, start, doc = chosen[first], at[first], doc[first]
                back = place - start
                m = mix(range_hashes(hashes, start, start + n - 1 + min_words) + back.astype(np.uint64))
                cols = [grams[place].view(np.int64), m.view(np.int64), ids[doc + lo], keys[doc + lo], place - wo[doc]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(back, pa.int32()), pa.array(n, pa.int32())], names=["k", "m", "id", "row", "place", "back", "n"])

    return texts.mapInArrow(run, "k long, m long, id long, row long, place long, back int, n int")


TIED = "id long, row long, start long, n long, ref_id long, ref_start long, open boolean"


def _tied(batches):
    """Of sorted suffixes those that repeat their neighbour in all n stretches, and, with
    ``open``, those whose stretches must be compared one by one: the first of each kind
    in a group of several kinds.  A group may go on in the partitions beside, so the
    first of this partition's first and last kind are open too."""
    head = last = None
    sent = False

    def rows(a, b, is_open):
        at = [c.astype(np.int64) for c in (a[2], a[3], a[4] - a[5], a[6], b[2], b[4] - b[5])]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in at], pa.array(np.full(len(at[0]), is_open))], names=[x.split()[0] for x in TIED.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if last is None:
            head, sent = [c[:1] for c in cols], True
            yield rows(head, head, True)
        else:
            cols = [np.concatenate((x, c)) for x, c in zip(last, cols, strict=True)]
        group = cols[0][1:] == cols[0][:-1]
        kind = group & (cols[1][1:] == cols[1][:-1])
        # rows that repeat id and text are one document
        moved = np.any([c[1:] != c[:-1] for c in cols[2:5]], axis=0)
        again = np.flatnonzero(kind & moved)
        if len(again):
            yield rows([c[again + 1] for c in cols], [c[again] for c in cols], False)
        new = np.flatnonzero(~kind)
        if len(new):
            heads = [np.concatenate((h, c[new + 1])) for h, c in zip(head, cols, strict=True)]
            several = np.concatenate(([False], group[new], [False]))
            send = several[1:] | several[:-1]
            keep = np.flatnonzero(send[:-1] & ~np.append(sent, np.zeros(len(new) - 1, bool)))
            if len(keep):
                some = [h[keep] for h in heads]
                yield rows(some, some, True)
            head, sent = [h[-1:] for h in heads], bool(several[-2])
            if sent:
                yield rows(head, head, True)
        last = [c[-1:] for c in cols]
    if last is not None and not sent:
        yield rows(head, head, True)


def _stretches(min_words: int):
    """(k, id, row, place) of each single stretch of texts (row, id, text, spans)."""

    def run(batches):
        for batch in batches:
            ids, keys, spans = batch.column(1).to_numpy(), batch.column(0).to_numpy(), batch.column(3)
            flat, owner = spans.flatten(), np.repeat(np.arange(batch.num_rows), pc.list_value_length(spans).to_numpy())
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            for lo, hi, part, offs in chunks(*text_buffer(batch.column(2))):
                use = slice(*np.searchsorted(owner, (lo, hi)))
                starts, ends, wo = words(part, offs)
                grams = gram_hashes(word_hashes(part, starts, ends), min_words)
                at, doc = ragged(start[use] + wo[owner[use] - lo], n[use]), np.repeat(owner[use], n[use])
                cols = [grams[at].view(np.int64), ids[doc], keys[doc], at - wo[doc - lo]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k", "id", "row", "place"])

    return run


PAIR = "k long, id_a long, row_a long, place_a long, id_b long, row_b long, place_b long, part int, edge int"


def _neighbours(batches):
    """Of sorted stretches the pairs of neighbours with equal words (edge 0),
    and the first (1) and last (2) stretch of the partition."""
    part, last, names = TaskContext.get().partitionId(), None, [x.split()[0] for x in PAIR.split(", ")]

    def rows(k, a, b, edge):
        n = len(k)
        cols = [k, *a, *b]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.int32())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if last is None:
            yield rows(cols[0][:1], [c[:1] for c in cols[1:]], [c[:1] for c in cols[1:]], 1)
        else:
            cols = [np.concatenate((x, c)) for x, c in zip(last, cols, strict=True)]
        same = np.flatnonzero(cols[0][1:] == cols[0][:-1])
        if len(same):
            yield rows(cols[0][same], [c[same] for c in cols[1:]], [c[same + 1] for c in cols[1:]], 0)
        last = [c[-1:] for c in cols]
    if last is not None:
        yield rows(last[0], last[1:], last[1:], 2)


def _across(pairs: DataFrame) -> DataFrame:
    """Pairs across the borders of partitions, of two rows a partition."""
    edges = pairs.where("edge > 0").select("k", "part", "edge", F.struct("id_a", "row_a", "place_a").alias("s"))
    order = Window.orderBy("part", "edge")
    near = edges.withColumn("p", F.lag("s").over(order)).withColumn("pk", F.lag("k").over(order)).where("edge = 1 and pk = k")
    return near.select(*[F.col(f"p.{c}_a").alias(f"{c}_a") for c in ("id", "row", "place")], *[F.col(f"s.{c}_a").alias(f"{c}_b") for c in ("id", "row", "place")])


def repeats(docs: DataFrame, *, min_words: int = MIN_WORDS, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated spans: id, start (word), n_words, ref_id, ref_start.  Each word
    lies in one span of a document at most; adjoining matches are one span, with
    the reference of its first match."""
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("row", F.xxhash64("id", "text"))
    rows = settle(suffixes(texts, min_words, window), "suffixes")
    order = ["k", "m", "id", "row", "place"]
    tied = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_tied, TIED), "tied")
    drop_settled(rows)
    wanted = tied.where("open").groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    opened = texts.join(wanted, "row").select("row", "id", "text", "spans").mapInArrow(_stretches(min_words), "k long, id long, row long, place long")
    single = settle(opened, "stretches")
    order = ["k", "id", "row", "place"]
    pairs = settle(single.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, PAIR), "neighbours")
    drop_settled(single)
    found = pairs.where("edge = 0").drop("k", "part", "edge").unionByName(_across(pairs))
    # rows that repeat id and text are one document
    found = found.where("row_a <> row_b or place_a <> place_b")
    spans = found.select(F.col("id_b").alias("id"), F.col("row_b").alias("row"), F.col("place_b").alias("start"), (F.col("place_b") + min_words).alias("end"), F.col("id_a").alias("ref_id"), F.col("place_a").alias("ref_start"))
    whole = tied.where("not open").select("id", "row", "start", (F.col("start") + F.col("n") - 1 + min_words).alias("end"), "ref_id", "ref_start")
    spans = spans.unionByName(whole)
    per_doc = Window.partitionBy("id", "row").orderBy("start", "end", "ref_id", "ref_start")
    reach = F.max("end").over(per_doc.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(per_doc)
    joined = spans.withColumn("reach", reach).withColumn("island", island).groupBy("id", "row", "island")
    first = F.min(F.struct("start", "ref_id", "ref_start"))
    return joined.agg(first.alias("f"), F.max("end").alias("end")).select(F.col("id").alias(id_col), F.col("f.start").alias("start"), (F.col("end") - F.col("f.start")).alias("n_words"), F.col("f.ref_id").alias("ref_id"), F.col("f.ref_start").alias("ref_start"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans alone.  Of the earlier places of a span ``repeats`` names one, and
    which one depends on the order of the sort, so it is no part of the query."""
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_words")


OP2_SQL = rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + {MIN_WORDS - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {MIN_WORDS - 2}, 1))) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM g) WHERE n > 1
), m AS (
  SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {MIN_WORDS} THEN 0 ELSE 1 END AS new FROM r
), s AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM m
)
SELECT doc_id, min(i) - 1 AS start, max(i) - min(i) + {MIN_WORDS} AS n_words FROM s GROUP BY doc_id, span
"""
