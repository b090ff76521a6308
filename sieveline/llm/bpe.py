"""BPE encoding and decoding through a distinct-word table.

Texts are split into words in Spark.  Each block of documents sends its
distinct words, by hash bucket, to that bucket's task, where each distinct word
of the whole corpus is encoded once; the ids come back to the blocks in the
order of their words and are joined to the words by position.  Decoding joins
each id to its piece.  See ``blocks`` for the exchange: a frequent word crosses
the wire once a block.

A word here is a run free of ASCII white space.  The tokenizer's own
normaliser and splitter run on the word; neither looks across white space, and
special-token strings hold none, so ids of words in order are the ids of the
text.

Defined edge cases: a null text is empty and has no ids; an empty decoding is
the empty string; ids may be null or repeat; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import bucket_count, chunk_batches, document_chunks, stabilised
from .common import table
from .kernels import buckets_of, chunks, lean, ragged, squeeze, text_buffer, unsqueeze, word_hashes, words

_U = np.uint64
#: Words encoded by one call of the library.
BATCH = 2_000
#: Chunks whose distinct words are merged at once.
MERGE = 4
#: Text bytes whose decoding is held at once.
SMALL = 1 << 18


def _distinct(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (bytes, offsets, hashes) in the order of their hashes."""
    values, first = np.unique(hashes, return_index=True)
    lengths = np.diff(offsets)[first]
    return data[ragged(offsets[:-1][first], lengths)], np.concatenate(([0], np.cumsum(lengths))), values


def _block_words(columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a block."""
    parts = []
    for column in columns:
        for _, _, part, offs in chunks(*text_buffer(column)):
            starts, ends, _ = words(part, offs)
            values, first = np.unique(word_hashes(part, starts, ends), return_index=True)
            lengths = (ends - starts)[first]
            parts.append((part[ragged(starts[first], lengths)], lengths, values))
            if len(parts) == MERGE:
                parts = [_merged(parts)]
    if not parts:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, _U)
    data, lengths, hashes = _merged(parts)
    return data, np.concatenate(([0], np.cumsum(lengths))), hashes


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (bytes, lengths, hashes) of several lists, in the order of their hashes."""
    data, lengths, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    data, offsets, hashes = _distinct(data, np.concatenate(([0], np.cumsum(lengths))), hashes)
    return data, np.diff(offsets), hashes


def _send_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        data, offsets, hashes = _block_words(b.column(1) for b in batches)
        cuts = np.searchsorted(buckets_of(hashes, buckets), np.arange(buckets + 1))
        rows = [(b, squeeze(data[offsets[i] : offsets[j]]), squeeze(np.diff(offsets[i : j + 1]).astype(np.int32))) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        if rows:
            b, w, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.binary()), pa.array(n, pa.binary())], names=["block", "bucket", "words", "lengths"])

    return run


def _encode_bucket(path: str):
    def run(t: pa.Table) -> pa.Table:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        lean()
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        lengths = [unsqueeze(x.as_py(), np.int32).astype(np.int64) for x in t.column("lengths")]
        data = np.concatenate([unsqueeze(x.as_py(), np.uint8) for x in t.column("words")])
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        values, first, inverse = np.unique(word_hashes(data, offsets[:-1], offsets[1:]), return_index=True, return_inverse=True)
        raw = data.tobytes()
        counts, ids = np.zeros(len(values), np.int64), []
        for k in range(0, len(values), BATCH):
            some = [raw[offsets[i] : offsets[i + 1]].decode() for i in first[k : k + BATCH]]
            found = [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            counts[k : k + len(found)] = [len(x) for x in found]
            ids.append(np.array([y for x in found for y in x], np.uint32))
        flat, starts = np.concatenate(ids), np.cumsum(counts) - counts
        out_n, out_ids, at = [], [], 0
        for n in map(len, lengths):
            of = inverse[at : at + n]
            out_n.append(squeeze(counts[of].astype(np.uint32)))
            out_ids.append(squeeze(flat[ragged(starts[of], counts[of])]))
            at += n
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "counts": pa.array(out_n, pa.binary()), "ids": pa.array(out_ids, pa.binary())})

    return run


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[bytes]:
    """The pieces with a space after each, once a worker."""
    return [(x + " ").encode() for x in pieces_of(path)]


def pieces_of(path: str) -> list[str]:
    """The piece of each id of a tokenizer file."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def _assemble(path: str, digest: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        lean()
        _, _, index = _block_words(b.column(1) for b in chunk_batches(docs))
        order = np.argsort(answers.column("bucket").to_numpy()).tolist()
        counts = np.concatenate([unsqueeze(answers.column("counts")[i].as_py(), np.uint32) for i in order] or [np.zeros(0, np.uint32)]).astype(np.int64)
        ids = np.concatenate([unsqueeze(answers.column("ids")[i].as_py(), np.uint32) for i in order] or [np.zeros(0, np.uint32)])
        if len(counts) != len(index):
            raise ValueError(f"a block has {len(index)} words, its table {len(counts)}: the input is not stable")
        starts = np.cumsum(counts) - counts
        pieces = _pieces(path)
        piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        piece_len = np.array([len(x) for x in pieces], np.int64)
        piece_at = np.cumsum(piece_len) - piece_len
        out = []
        for batch in chunk_batches(docs):
            n_tokens, first, second = [], [], []
            for _, _, part, offs in chunks(*text_buffer(batch.column(1)), SMALL):
                s, e, wo = words(part, offs)
                of = np.searchsorted(index, word_hashes(part, s, e))
                flat = ids[ragged(starts[of], counts[of])]
                at = np.concatenate(([0], np.cumsum(counts[of])))[wo]
                decoded = piece_bytes[ragged(piece_at[flat], piece_len[flat])].tobytes()
                cut = np.concatenate(([0], np.cumsum(piece_len[flat])))[at].tolist()
                n_tokens.append(np.diff(at))
                texts = [decoded[a : max(a, b - 1)] for a, b in zip(cut, cut[1:], strict=False)]
                if digest:
                    raw = flat.tobytes()
                    first += [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                    second += [hashlib.sha256(x).hexdigest() for x in texts]
                else:
                    first += [flat[a:b].astype(np.int32) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
                    second += [x.decode() for x in texts]
            kind = pa.string() if digest else pa.list_(pa.int32())
            out.append(pa.table([batch.column(0), pa.array(np.concatenate(n_tokens), pa.int64()), pa.array(first, kind), pa.array(second, pa.string())], names=["id", "n_tokens", "ids", "decoded"]))
        out = pa.concat_tables(out)
        lean()
        return out

    return run


def encode(docs: DataFrame, tokenizer_path: str, *, digest: bool = False, stable: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids (array<int>), decoded; with
    ``digest`` instead ids_sha256 and decoded_sha256."""
    slim = stabilised(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), stable)
    sent = slim.mapInArrow(_send_words(bucket_count(slim)), "block long, bucket long, words binary, lengths binary")
    ids = sent.groupBy("bucket").applyInArrow(_encode_bucket(tokenizer_path), "block long, bucket long, counts binary, ids binary")
    schema = f"id long, n_tokens long, ids {'string' if digest else 'array<int>'}, decoded string"
    out = document_chunks(slim).groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_assemble(tokenizer_path, digest), schema)
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256") if digest else out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded: each id joined to its piece (the vocabulary is a fixed public
    file, so it is broadcast) and the pieces put together by position."""
    spark = encoded.sparkSession
    pieces = spark.createDataFrame(list(enumerate(pieces_of(tokenizer_path))), "token int, piece string")
    rows = encoded.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(ids_col).alias("ids"))
    each = rows.select("id", "row", F.posexplode_outer("ids").alias("pos", "token")).join(F.broadcast(pieces), "token", "left")
    put = each.groupBy("row", "id").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "piece")))).alias("p"))
    return put.select(F.col("id").alias(id_col), F.array_join(F.col("p.piece"), " ").alias("decoded"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True, stable=True)
