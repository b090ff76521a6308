"""Near-dedup by HyperMinHash.

A document's set holds the hashes of its distinct word shingles.  Each of 96
registers keeps, of the least value under its own hash function, the count of
leading zeros (6 bits) and 10 mantissa bits.  (One function a register, not
one split over registers: short documents would leave registers empty and be
missed.)  Bands of four compressed registers form 24 exact 64-bit keys.

Documents with equal sets form a class and are compared once.  In each band
bucket every class is paired with the bucket's pivot (its least class), never
with every other.  Pairs pass the collision-corrected Jaccard estimate, then
are confirmed on full sets.  A second round restores links that no pivot shows:
where a pivot's buckets hold several components, classes outside the commonest
one are compared with the others in blocks of bounded size, first by the
estimate on registers; only classes with a plausible partner in another
component bring their full sets.

A pair at the threshold shares no band with probability (1 - s^4)^24: 2e-8 at
0.85, 3e-6 at 0.8.

Defined edge cases: null or empty texts and texts of white space have an empty
set and are linked with nothing; a text with fewer words than a shingle has its
whole word sequence as its one shingle; a null id takes part, and a component
of null ids alone has a null id; repeated rows share a class; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .components import components
from .kernels import LOWER, buckets_of, chunks, gram_hashes, lean, mix, span_hash, text_buffer, trimmed, word_hashes, words

_U = np.uint64
REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
MANTISSA = 10
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=_U) * _U(0x632BE59BD9B4E019))
_FACTORS = mix(_SEEDS) | _U(1)
#: Rows of a side of a block in the second round.
BLOCK = 1024
#: Shingles hashed at once.
SLICE = 1 << 13
#: Full sets in one batch of rows, and hashes of a row, on average at most.
ROWS_OUT, ITEMS = 64, 1 << 11


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the ascending hashes of its distinct k-word shingles, A-Z lower-cased."""
    data, offsets = text_buffer(column)
    for _, _, part, offs in chunks(data, offsets):
        part = LOWER[part]
        starts, ends, wo = words(part, offs)
        hashes = word_hashes(part, starts, ends)
        grams = gram_hashes(hashes, k)
        for a, b in zip(wo.tolist(), wo[1:].tolist(), strict=False):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            else:
                yield np.array([span_hash(hashes[a:b])] if b > a else [], _U)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed registers (uint16) of a non-empty set."""
    least = np.full(REGISTERS, ~_U(0))
    for i in range(0, len(shingles), SLICE):
        np.minimum(least, ((shingles[None, i : i + SLICE] ^ _SEEDS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    part, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63)
    return (zeros.astype(np.uint16) << MANTISSA) | ((part - 0.5) * (2 << MANTISSA)).astype(np.uint16) % np.uint16(1 << MANTISSA)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Four registers to one exact 64-bit key."""
    return np.ascontiguousarray(regs).view(np.int64)


def class_id(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return mix(shingles).sum(dtype=_U).tobytes() + mix(shingles ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U).tobytes()


def expected_collisions(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The chance that registers of two disjoint sets of these sizes are equal."""
    edge = 2.0 ** -np.arange(64)

    def share(n):
        n = np.asarray(n, np.float64)[:, None]
        return np.exp(n * np.log1p(-edge[None] / 2)) - np.concatenate((np.zeros((len(n), 1)), np.exp(n * np.log1p(-edge[None, 1:]))), axis=1)

    return (share(n_a) * share(n_b)).sum(axis=1) / (1 << MANTISSA)


def estimate(keys_a: np.ndarray, keys_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of band keys."""
    equal = (keys_a.view(np.uint16) == keys_b.view(np.uint16)).mean(axis=1)
    chance = expected_collisions(n_a, n_b)
    return (equal - chance) / (1 - chance)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(id, text_hash, n, cid, keys) of docs (id, text, text_hash)."""

    def run(batches):
        for batch in batches:
            n, cid, keys = [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                cid.append(class_id(s) if len(s) else None)
                keys.append(band_keys(registers(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "text_hash", "n", "cid", "keys"])

    return docs.mapInArrow(trimmed(run), "id long, text_hash long, n long, cid binary, keys array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(cid, slice, items): full sets, cut by the high bits of their hashes."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_OUT):
                cid, number, items = [], [], []
                for s in shingle_sets(batch.column(0).slice(i, ROWS_OUT), k):
                    n = slices_of(len(s))
                    cuts = np.searchsorted(buckets_of(s, n), np.arange(n + 1))
                    some = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
                    cid += [class_id(s)] * len(some)
                    number += some
                    items += [s[cuts[x] : cuts[x + 1]].view(np.int64) for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.binary()), pa.array(number, pa.int32()), pa.array(items, pa.list_(pa.int64()))], names=["cid", "slice", "items"])

    return docs.mapInArrow(trimmed(run), "cid binary, slice int, items array<long>")


def slices_of(n: int) -> int:
    """Into how many ranges of hashes a set of ``n`` is cut: a power of two, so that ranges of two sets nest."""
    return 1 << max(0, (n - 1).bit_length() - ITEMS.bit_length() + 1)


def _slice_bits(n: Column) -> Column:
    """The same of a column, as a power."""
    return F.greatest(F.lit(0), F.length(F.bin(F.greatest(n - 1, F.lit(0)))) - (ITEMS.bit_length() - 1))


def _class_sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(cid, slice, items): the full set of each class of the wanted (cid), once, from one
    document of the class; no text is shuffled, and no row grows with its text."""
    one = wanted.distinct().join(classes, "cid").select(F.col("text_hash").alias("__hash"), F.col("text_id").alias("__id"))
    some = docs.join(one, (F.col("text_hash") == F.col("__hash")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    sets = settle(_sets(some.select("text"), k), "sets")
    if sets.groupBy("cid", "slice").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return sets
    return settle(sets.dropDuplicates(["cid", "slice"]), "sets")  # rows that repeat id and text


def _plausible(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimate reaches ``least``, with sizes."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("keys").alias(f"k_{x}"))

    def run(batches):
        for t in batches:
            if t.num_rows:
                keys = [t.column(x).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, BANDS) for x in ("k_a", "k_b")]
                n = [t.column(x).to_numpy() for x in ("n_a", "n_b")]
                yield t.filter(pa.array(estimate(*keys, *n) >= least)).select(["a", "b", "n_a", "n_b"])

    wide = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "k_a", "k_b")
    return wide.mapInArrow(run, "a binary, b binary, n_a long, n_b long")


def _measured(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(a, b, common, total): sizes of intersection and union, on full sets.

    Each slice of the larger set meets the one of the smaller that covers its range, and
    what they share is summed."""
    sets = _class_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("cid")), classes, k)
    swap = F.col("n_a") > F.col("n_b")
    sided = pairs.select("a", "b", "n_a", "n_b", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("__small"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("__large"))
    finer = _slice_bits(F.greatest("n_a", "n_b")) - _slice_bits(F.least("n_a", "n_b"))
    fine = sided.join(sets.select(F.col("cid").alias("__large"), "slice", F.col("items").alias("y")), "__large").select("a", "b", "n_a", "n_b", "__small", F.call_function("shiftright", F.col("slice"), finer).alias("__slice"), "y")
    both = fine.join(sets.select(F.col("cid").alias("__small"), F.col("slice").alias("__slice"), F.col("items").alias("x")), ["__small", "__slice"])
    shared = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).cast("long").alias("n"))
    counted = shared.groupBy("a", "b", "n_a", "n_b").agg(F.sum("n").alias("common"))
    return counted.select("a", "b", "common", (F.col("n_a") + F.col("n_b") - F.col("common")).alias("total"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, class_id (equal sets), component_id
    (smallest id reachable over links), kept.  Documents are linked if 100 *
    intersection >= ``percent`` * union of their shingle sets."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    rows = settle(sketch(texts, shingle), "sketches")
    full = rows.where("n > 0")
    classes = settle(full.groupBy("cid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min(F.struct("text_hash", "id")).alias("t")).select("cid", "rep", "n", "keys", F.col("t.text_hash").alias("text_hash"), F.col("t.id").alias("text_id")), "classes")

    banded = classes.select("cid", F.posexplode("keys").alias("band", "key"))
    pivots = banded.groupBy("band", "key").agg(F.min("cid").alias("pivot"), F.max("cid").alias("most")).where("pivot < most").drop("most")
    members = settle(banded.join(pivots, ["band", "key"]), "members")
    stars = members.where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    # five standard errors of the estimate below the threshold
    pairs = settle(_plausible(stars, classes, percent / 100 - 0.2), "pairs")
    links = settle(_measured(pairs, texts, classes, shingle).where(F.col("common") * 100 >= F.col("total") * percent).select("a", "b"), "links")
    labels = settle(components(links), "labels")
    more = _second_round(members, labels, classes, texts, shingle, percent)
    if more is not None:
        found = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = settle(components(found.unionByName(more)), "labels")

    of_class = classes.join(labels, classes.cid == labels.node, "left").select("cid", "rep", F.coalesce("label", "cid").alias("label"))
    least = of_class.groupBy("label").agg(F.min("rep").alias("component"))
    named = settle(of_class.join(least, "label").select("cid", "component"), "named")
    out = rows.select("id", "n", "cid").join(named, "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.hex("cid").alias("class_id"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _second_round(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links (a, b) between classes that share a bucket but not a component.

    Buckets with one pivot count as one group.  In a group, all that lie outside
    its commonest component are held against all others by exact intersections,
    in square blocks of bounded size; each row names one link to each other
    component at most, so the result stays linear."""
    named = members.select("pivot", "cid").distinct().join(labels, members.cid == labels.node, "left").select("pivot", "cid", F.coalesce("label", "cid").alias("label"))
    sizes = named.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("c"))
    groups = sizes.groupBy("pivot").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("parts"))
    told = settle(named.join(groups.where("parts > 1").drop("parts"), "pivot"), "mixed")
    if told.isEmpty():
        return None
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = told.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.where("label <> main").select("cid", "pivot", "label", F.col("own").alias("x"), every.alias("y"))
    right = placed.select("cid", F.col("pivot").alias("pivot_r"), "label", F.col("own").alias("y_r"), every.alias("x_r"))
    told = classes.select("cid", "n", "keys")
    maybe = _renamed(left.join(told, "cid")).groupBy("pivot", "x", "y").cogroup(_renamed(right.join(told, "cid")).groupBy("pivot_r", "x_r", "y_r"))
    maybe = settle(maybe.applyInArrow(_block_candidates(percent / 100 - 0.2), CANDIDATE), "maybe")
    if maybe.isEmpty():
        return None
    # blocks compare whole sets
    sets = _class_sets(docs, maybe.select("cid"), classes, k).groupBy("cid").agg(F.flatten(F.collect_list("items")).alias("items"))
    left = _renamed(maybe.where("side = 0").select("cid", "pivot", "label", "x", "y").join(sets, "cid"))
    right = _renamed(maybe.where("side = 1").select("cid", F.col("pivot").alias("pivot_r"), "label", F.col("y").alias("y_r"), F.col("x").alias("x_r")).join(sets, "cid"))
    return settle(left.groupBy("pivot", "x", "y").cogroup(right.groupBy("pivot_r", "x_r", "y_r")).applyInArrow(_block_links(percent), "a binary, b binary").distinct(), "more")


def _renamed(df: DataFrame) -> DataFrame:
    """The same columns as columns of their own, so that two sides of one table can meet."""
    return df.toDF(*df.columns)


CANDIDATE = "side int, cid binary, pivot binary, label binary, x int, y int"


def _block_candidates(least: float):
    """Of a block the classes of either side with a plausible partner in another component."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        out = pa.schema([("side", pa.int32()), ("cid", pa.binary()), ("pivot", pa.binary()), ("label", pa.binary()), ("x", pa.int32()), ("y", pa.int32())])
        if not len(left) or not len(right):
            return out.empty_table()
        regs = [np.concatenate([np.asarray(c.flatten()) for c in t.column("keys").chunks]).view(np.uint16).reshape(len(t), REGISTERS) for t in (left, right)]
        n = [t.column("n").to_numpy() for t in (left, right)]
        labels = {x: i for i, x in enumerate({*left.column("label").to_pylist(), *right.column("label").to_pylist()})}
        of = [np.array([labels[x] for x in t.column("label").to_pylist()]) for t in (left, right)]
        use = [np.zeros(len(t), bool) for t in (left, right)]
        for i in range(len(left)):
            equal = (regs[1] == regs[0][i]).mean(axis=1)
            some = np.flatnonzero((equal >= least) & (of[1] != of[0][i]))  # the correction only lowers it
            if len(some):
                chance = expected_collisions(np.full(len(some), n[0][i]), n[1][some])
                some = some[(equal[some] - chance) / (1 - chance) >= least]
                use[0][i] = len(some) > 0
                use[1][some] = True
        x, y, pivot = (left.column(c)[0].as_py() for c in ("x", "y", "pivot"))
        rows = []
        for side, (t, mask) in enumerate(zip((left, right), use, strict=True)):
            some = t.filter(pa.array(mask))
            m = len(some)
            cols = [pa.array([side] * m, pa.int32()), some.column("cid"), pa.array([pivot] * m, pa.binary()), some.column("label"), pa.array([x] * m, pa.int32()), pa.array([y] * m, pa.int32())]
            rows.append(pa.Table.from_arrays(cols, schema=out))
        return pa.concat_tables(rows)

    return run


def _block_links(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        a, b = [], []
        if len(left) and len(right):
            items = right.column("items").combine_chunks()
            offsets = np.asarray(items.offsets)
            values, place = np.unique(items.flatten().to_numpy(), return_inverse=True)
            names, ids = np.array(right.column("label").to_pylist(), object), right.column("cid").to_pylist()
            sizes = np.diff(offsets)
            for cid, label, mine in zip(left.column("cid").to_pylist(), left.column("label").to_pylist(), left.column("items"), strict=True):
                mine = mine.values.to_numpy()
                mark = np.zeros(len(values) + 1, np.int32)
                at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
                mark[at[values[at] == mine]] = 1
                common = np.add.reduceat(mark[place], offsets[:-1])
                near = np.flatnonzero((common * 100 >= percent * (len(mine) + sizes - common)) & (names != label))
                for i in {names[i]: i for i in near}.values():
                    a.append(cid)
                    b.append(ids[i])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def one_of_each(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id stays, all columns."""
    found = near_duplicates(docs, shingle=shingle, percent=percent, id_col=id_col, text_col=text_col)
    keep = settle(found.where("kept").select(F.col(id_col).alias("__keep")).distinct(), "keep")
    return docs.join(keep, docs[id_col].cast("long").eqNullSafe(F.col("__keep")), "left_semi")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("class_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), c AS (
  SELECT doc_id, doc_id AS other FROM w UNION SELECT c.doc_id, l.y FROM c JOIN l ON c.other = l.x
)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, w.doc_id = min(other) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) GROUP BY w.doc_id
"""
