"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of hashed embeddings of the word and of its first
3, 4 and 5 letters (a bucket that the fit has not met stands for zero): log-odds
of the label, cautious and plain.  Filters of widths 1, 2 and 3 sum them, and
their opposites, over the word sequence; the largest response of each filter
feeds a logistic output.  A threshold for each language is calibrated; the
language of a text is guessed from its own words.  The score rescales the output
so that each threshold falls on 0.3.

The fit reads all labelled documents that are not held out.  Three quarters, by
a hash of the text, are counted by bucket, label and language; over the rest the
output layer is fitted by Newton's method and the thresholds are told from a
histogram.  Both are sums that Spark makes over blocks, so neither their order
nor how the rows are dealt matters; the driver holds the buckets that tell of the
label, those of first letters by language, the sums and the histogram.  Scoring reads every text
whole; a text's score depends on that text alone.

Defined edge cases: null and empty texts are scored as texts without words;
rows without a label are not learnt from; of several labels of one id the
largest counts; with fewer than FEW labelled rows all are used for both parts;
with one label alone all scores are 0; ids may be null or repeat; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import drop_settled, held_out, settle, table
from .kernels import chunks, give_back, segment_sums, text_buffer, trimmed, words
from .wordcache import WordCache

#: Labelled documents of each label that the fit reads at most: all of them.
PER_LABEL = float("inf")
THRESHOLD = 0.3
#: The last bucket; float32 holds it exactly, so words are kept in a ``WordCache``.
BUCKETS = (1 << 24) - 1
DIM, FILTERS, WIDTHS = 2, 4, (1, 2, 3)
PAD = max(WIDTHS) - 1
CAUTION = 1.5
#: A bucket is kept if so many documents have it and its log-odds exceed their standard error, or, for languages, if it is one of first letters.
LEAST = 3
FEW = 80
#: Weight of the squared output weights, steps of Newton's method at most, and what a step gains at least.
RIDGE, STEPS, GAIN = 1.0, 40, 1e-11
#: Steps of the histogram that thresholds are told from.
BINS = 10_000
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@lru_cache(maxsize=200_000)
def buckets(word: str) -> list[int]:
    """The hash buckets of a word; the first is that of its first three letters."""
    word = word.lower().strip(_EDGE)
    parts = ["3" + word[:3], "w" + word] + [f"{n}{word[:n]}" for n in (4, 5) if len(word) >= n]
    return [zlib.crc32(x.encode()) & BUCKETS for x in parts] if word else []


def _bucket_rows(texts: list[str]) -> np.ndarray:
    """The buckets of each word, -1 where it has fewer than four."""
    found = [buckets(x) for x in texts]
    return np.array([x + [-1] * (4 - len(x)) for x in found], np.int64).reshape(len(texts), 4)


def _rows_of(kept: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows of buckets: 0 for those not kept, else from 1 on in the order of ``kept``, which ascends."""
    if not len(kept):
        return np.zeros(ids.shape, np.int64)
    at = np.minimum(np.searchsorted(kept, ids), len(kept) - 1)
    return np.where(kept[at] == ids, at + 1, 0)


class Model:
    """kept, firsts: the buckets that have a row, from 1 on, of ``table`` and of ``by_lang``; row 0 is zero."""

    def __init__(self, kept: np.ndarray, table: np.ndarray, firsts: np.ndarray, by_lang: np.ndarray):
        self.kept, self.table, self.firsts, self.by_lang = kept, table, firsts, by_lang
        self.out, self.out_bias = np.zeros(len(WIDTHS) * FILTERS), 0.0
        self.thresholds = np.full(by_lang.shape[1], 0.5)

    def word_rows(self, texts: list[str]) -> np.ndarray:
        """Per word its embedding, then its log-probability in each language."""
        ids = _bucket_rows(texts)
        return np.concatenate((self.table[_rows_of(self.kept, ids)].sum(axis=1), self.by_lang[_rows_of(self.firsts, ids[:, 0])]), axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.out_bias

    def pooled(self, vectors: np.ndarray, wo: np.ndarray) -> np.ndarray:
        """Largest responses (documents, filters) of word vectors with document offsets."""
        lengths = np.diff(wo)
        rows = np.maximum(lengths, 1)  # a text without words is one zero row
        starts = np.cumsum(rows + PAD) - rows - PAD
        x = np.zeros((int((rows + PAD).sum()) + PAD, DIM))
        x[np.arange(len(vectors)) + np.repeat(starts - wo[:-1], lengths)] = vectors
        # a document ends with its last word: windows over its padding belong to nobody
        cuts = np.stack((starts, starts + rows), axis=1).ravel()
        n, best = len(x) - PAD, []
        for column in np.ascontiguousarray(x.T):
            window = np.zeros(n)
            for w in range(max(WIDTHS)):
                window = window + column[w : w + n]
                if w + 1 in WIDTHS:
                    best += [np.maximum.reduceat(window, cuts)[::2], -np.minimum.reduceat(window, cuts)[::2]]
        return np.maximum(np.stack(best, axis=1), 0)


def rescale(p: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Monotone, with the threshold on 0.3."""
    return np.where(p < threshold, THRESHOLD * p / threshold, THRESHOLD + (1 - THRESHOLD) * (p - threshold) / (1 - threshold))


def chance(logits: np.ndarray) -> np.ndarray:
    # the last digits of a matrix product depend on the rows beside
    return np.round(1 / (1 + np.exp(-np.clip(logits, -30, 30))), 9)


def _best_threshold(toxic: np.ndarray, clean: np.ndarray, fallback: float) -> float:
    """The middle of the widest gap among thresholds with the best F1, of documents
    counted by their step of the histogram."""
    if toxic.sum() < 5 or clean.sum() < 5:
        return fallback
    some = np.flatnonzero(toxic + clean)
    cuts = np.unique(np.concatenate(([0.0], some / BINS, [1.0])))
    mids = (cuts[1:] + cuts[:-1]) / 2
    above = lambda n: np.concatenate((np.cumsum(n[::-1])[::-1], [0]))[np.ceil(mids * BINS).astype(int)]
    f1 = 2 * above(toxic) / np.maximum(1, above(toxic) + above(clean) + toxic.sum())
    good = np.flatnonzero(f1 == f1.max())
    return float(np.clip(mids[good[np.argmax((cuts[1:] - cuts[:-1])[good])]], 0.02, 0.98))


class Tally:
    """Counts of integer keys."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        new, n = np.unique(keys, return_counts=True)
        self.keys, at = np.unique(np.concatenate((self.keys, new)), return_inverse=True)
        self.n = np.bincount(at, np.concatenate((self.n, n)), len(self.keys)).astype(np.int64)


def count_buckets(batches: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Tally:
    """How many documents of each label (0, 1) have each bucket, and of each language (from
    2 on) each bucket of first letters, over batches of texts, labels and languages; a
    key is that number * (BUCKETS + 1) + bucket."""
    tally, cache = Tally(), WordCache(_bucket_rows, 4)
    for texts, toxic, lang in batches:
        for lo, hi, part, offs in chunks(*text_buffer(texts)):
            starts, ends, wo = words(part, offs)
            rows = cache(part, starts, ends).astype(np.int64)
            doc = np.repeat(np.arange(hi - lo), np.diff(wo))[:, None] * (BUCKETS + 1)
            for group, some in ((toxic[lo:hi], rows), (lang[lo:hi] + 2, rows[:, :1])):
                each = np.unique((doc + some)[some >= 0])
                tally.add(group[each // (BUCKETS + 1)] * (BUCKETS + 1) + each % (BUCKETS + 1))
    return tally


def log_odds(t, c, n_toxic: int, n_clean: int, log, sqrt):
    """Of a bucket that t toxic and c clean documents have: its log-odds and their standard error."""
    return log((t + 0.5) / (n_toxic + 1)) - log((c + 0.5) / (n_clean + 1)), sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


def embeddings(kept: np.ndarray, t: np.ndarray, c: np.ndarray, n_toxic: int, n_clean: int, first: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int) -> Model:
    """A model of the kept buckets, which ascend, with their counts by label, and of the
    counts n of buckets of first letters by language."""
    plain, doubt = log_odds(t, c, n_toxic, n_clean, np.log, np.sqrt)
    odds = np.sign(plain) * np.maximum(np.abs(plain) - CAUTION * doubt, 0)  # so that chance finds start near zero
    table = np.concatenate((np.zeros((1, DIM)), np.stack((odds, plain), axis=1)))
    every, at = np.unique(first, return_inverse=True)
    counts = np.full((len(every), langs), 0.1)
    np.add.at(counts, (at, lang), n)
    some = counts.sum(axis=1) >= LEAST + 0.1 * langs - 0.05
    in_lang = np.log(counts[some] / counts[some].sum(axis=1, keepdims=True))
    return Model(kept, table, every[some], np.concatenate((np.zeros((1, langs)), in_lang)))


def features(model: Model, cache: WordCache, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(responses, guessed language) of each text."""
    found = [(np.zeros((0, len(model.out))), np.zeros(0, np.int64))]
    for _, _, part, offs in chunks(*text_buffer(texts)):
        starts, ends, wo = words(part, offs)
        rows = cache(part, starts, ends)
        found.append((model.pooled(rows[:, :DIM], wo), segment_sums(rows[:, DIM:], wo).argmax(axis=1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def partial_sums(weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of the logistic output over some documents."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    z = x @ weights
    error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
    share = (error + y) * (1 - error - y)
    return np.concatenate(([(np.logaddexp(0, z) - y * z).sum()], error @ x, ((x * share[:, None]).T @ x).ravel()))


def newton(sums: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The weights with the least loss, the last of them the bias; ``sums`` gives ``partial_sums`` over all documents."""
    ridge = np.full(size, RIDGE)
    ridge[-1] = 1e-6

    def told(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = sums(w)
        return s[0] + (ridge * w * w).sum() / 2, s[1 : size + 1] + ridge * w, s[size + 1 :].reshape(size, size) + np.diag(ridge)

    weights = np.zeros(size)
    loss, gradient, curvature = told(weights)
    for _ in range(STEPS):
        step = np.linalg.solve(curvature, gradient)
        new = told(weights - step)
        while not new[0] <= loss and np.abs(step).max() > 1e-12:
            step = step / 2
            new = told(weights - step)
        if not new[0] <= loss:
            break
        gain, weights = loss - new[0], weights - step
        loss, gradient, curvature = new
        if gain <= GAIN * abs(loss):
            break
    return weights


def put_output(model: Model, weights: np.ndarray) -> None:
    model.out, model.out_bias = weights[:-1], float(weights[-1])


def histogram_keys(model: Model, x: np.ndarray, guess: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(language * (BINS + 1) + step) * 2 + label of each document."""
    return (guess * (BINS + 1) + np.round(chance(model.logits(x)) * BINS).astype(np.int64)) * 2 + y


def put_thresholds(model: Model, keys: np.ndarray, n: np.ndarray) -> None:
    langs = len(model.thresholds)
    counts = np.zeros(langs * (BINS + 1) * 2)
    counts[keys] = n
    counts = counts.reshape(langs, BINS + 1, 2)
    overall = _best_threshold(counts[:, :, 1].sum(axis=0), counts[:, :, 0].sum(axis=0), 0.5)
    model.thresholds = np.array([_best_threshold(x[:, 1], x[:, 0], overall) for x in counts])


def fit(rows: list[tuple[str, str, int]]) -> Model | None:
    """A model of (text, lang, label) rows: ``fit_all`` over one block."""
    if len({x[2] for x in rows}) < 2:
        return None
    langs = sorted({x[1] for x in rows})
    texts, y = pa.array([x[0] or "" for x in rows], pa.string()), np.array([x[2] for x in rows], np.int64)
    lang = np.array([langs.index(x[1]) for x in rows])
    apart = np.array([len(rows) < FEW or zlib.crc32((x[0] or "").encode()) % 4 == 3 for x in rows])
    counted = ~apart | (len(rows) < FEW)
    tally = count_buckets([(texts.filter(pa.array(counted)), y[counted], lang[counted])])
    n_toxic, n_clean = int(y[counted].sum()), int((y[counted] == 0).sum())
    group, bucket = tally.keys // (BUCKETS + 1), tally.keys % (BUCKETS + 1)
    every, at = np.unique(bucket[group < 2], return_inverse=True)
    t, c = (np.bincount(at, tally.n[group < 2] * (group[group < 2] == k), len(every)) for k in (1, 0))
    plain, doubt = log_odds(t, c, n_toxic, n_clean, np.log, np.sqrt)
    kept = (t + c >= LEAST) & (np.abs(plain) > doubt)
    model = embeddings(every[kept], t[kept], c[kept], n_toxic, n_clean, bucket[group > 1], group[group > 1] - 2, tally.n[group > 1], len(langs))
    x, guess = features(model, WordCache(model.word_rows, DIM + len(langs)), texts.filter(pa.array(apart)))
    put_output(model, newton(lambda w: partial_sums(w, x, y[apart]), len(model.out) + 1))
    put_thresholds(model, *np.unique(histogram_keys(model, x, guess, y[apart]), return_counts=True))
    return model


def score_rows(model: Model, rows: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return chance(model.logits(model.pooled(rows[:, :DIM], wo))), segment_sums(rows[:, DIM:], wo).argmax(axis=1)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, lang, toxic, apart) of the documents to learn from."""
    told = labels.where(F.col("toxic").isNotNull()).groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out(F.col("id")))
    text = F.coalesce("text", F.lit(""))
    # told before the join, so that no text travels where only sizes are asked; always a merge
    # join, as labels grow with the documents and texts are not to travel from some size on alone
    own = docs.where(~held_out(F.col("id"))).select("id", text.alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), (F.crc32(text.cast("binary")) % 4 == 3).alias("apart"))
    return own.join(told.hint("merge"), "id").select("text", "lang", "toxic", "apart")


def fit_all(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of all labelled documents (id, text, lang) with labels (id, toxic)."""
    rows, spark = _labelled(docs, labels), docs.sparkSession
    sizes = rows.groupBy("lang", "toxic", "apart").agg(F.count(F.lit(1)).alias("n")).collect()
    if len({r.toxic for r in sizes}) < 2:
        return None
    langs = sorted({r.lang for r in sizes})
    few = sum(r.n for r in sizes) < FEW
    number = {x: i for i, x in enumerate(langs)}
    counted, rest = (rows, rows) if few else (rows.where("not apart"), rows.where("apart"))
    n_toxic, n_clean = (sum(r.n for r in sizes if r.toxic == k and (few or not r.apart)) for k in (1, 0))

    def count(batches):
        told = lambda b: (b.column(0), b.column(2).to_numpy().astype(np.int64), np.array([number[x] for x in b.column(1).to_pylist()], np.int64))
        tally = count_buckets(told(b) for b in batches if b.num_rows)
        buckets.cache_clear()
        yield pa.RecordBatch.from_arrays([pa.array((tally.keys // (BUCKETS + 1)).astype(np.int32)), pa.array((tally.keys % (BUCKETS + 1)).astype(np.int32)), pa.array(tally.n)], names=["group", "bucket", "n"])

    counts = settle(counted.select("text", "lang", "toxic").mapInArrow(trimmed(count), "group int, bucket int, n long"), "counts")
    sides = [F.sum(F.when(F.col("group") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "t"), (0, "c"))]
    plain, doubt = log_odds(F.col("t"), F.col("c"), n_toxic, n_clean, F.log, F.sqrt)
    kept = counts.where("group < 2").groupBy("bucket").agg(*sides).where((F.col("t") + F.col("c") >= LEAST) & (F.abs(plain) > doubt)).toArrow().sort_by("bucket")
    by_lang = counts.where("group > 1").groupBy("bucket", "group").agg(F.sum("n").alias("n")).toArrow()
    drop_settled(counts)
    model = embeddings(*(kept.column(c).to_numpy().astype(np.int64) for c in ("bucket", "t", "c")), n_toxic, n_clean, *(by_lang.column(c).to_numpy() - k for c, k in (("bucket", 0), ("group", 2), ("n", 0))), len(langs))
    del kept, by_lang
    shared = spark.sparkContext.broadcast(model)

    def respond(batches):
        m = shared.value
        cache = WordCache(m.word_rows, DIM + m.by_lang.shape[1])
        for batch in batches:
            x, guess = features(m, cache, batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(guess, pa.int64()), batch.column(1)], names=["x", "guess", "toxic"])
        buckets.cache_clear()

    told = settle(rest.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(trimmed(respond), "x binary, guess long, toxic long"), "responses")
    width = len(model.out)
    responses = lambda batch: np.frombuffer(b"".join(batch.column(0).to_pylist()), float).reshape(-1, width)

    def sums(weights: np.ndarray) -> np.ndarray:
        def run(batches):
            s = partial_sums(weights, np.zeros((0, width)), np.zeros(0))
            for batch in batches:
                s = s + partial_sums(weights, responses(batch), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(s)], names=["k", "v"])

        found = told.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(1 + (width + 1) * (width + 2))
        for k, v in found:
            out[k] = v
        return out

    put_output(model, newton(sums, width + 1))

    def steps(batches):
        for batch in batches:
            keys, n = np.unique(histogram_keys(model, responses(batch), batch.column(1).to_numpy(), batch.column(2).to_numpy()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    found = told.mapInArrow(steps, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    put_thresholds(model, found.column("key").to_numpy(), found.column("n").to_numpy())
    drop_settled(told)
    shared.unpersist()
    return model


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", carry: list[str] | None = None) -> DataFrame:
    """held_out, score, predicted of each document, after its id or the columns in ``carry``."""
    carry = carry or [id_col]
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit_all(slim, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("toxic"))))
    give_back()

    def run(batches):
        m = model.value
        cache = WordCache(m.word_rows, DIM + m.by_lang.shape[1]) if m else None
        for batch in batches:
            found = [np.zeros(0)]
            for lo, hi, part, offs in chunks(*text_buffer(batch.column(1))):
                if m is None:
                    found.append(np.zeros(hi - lo))
                    continue
                starts, ends, wo = words(part, offs)
                p, guess = score_rows(m, cache(part, starts, ends), wo)
                found.append(rescale(p, m.thresholds[guess]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(np.concatenate(found), 0, 1), pa.float64()), *batch.columns[2:]], names=names)
        buckets.cache_clear()  # a worker lives on

    wide = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    schema = StructType([StructField("id", LongType()), StructField("score", DoubleType()), *wide.schema.fields[2:]])
    names = schema.names
    out = wide.mapInArrow(trimmed(run), schema)
    told = [held_out(F.col("id")).alias("held_out"), F.col("score"), (F.col("score") >= THRESHOLD).cast("int").alias("predicted")]
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *told)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
