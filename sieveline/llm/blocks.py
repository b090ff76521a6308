"""Block-wise exchange.

Documents stay in blocks: a block is one input partition, numbered by it.  What
blocks must learn from each other goes through buckets: each block sends to
bucket b one compressed blob with its distinct hashes of that bucket, so a key
however frequent crosses the wire once a block.  A bucket answers each block
with one blob.  Answers meet the block's documents, sent as compressed chunks,
in a cogroup by block.

A block's number must mean the same rows each time it is computed, so the input
is either a plain file scan (``stable=True``) or written out first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import partitions, settle
from .kernels import chunks, text_buffer

CHUNK = 4 << 20
DOC_SCHEMA = "block long, seq long, docs binary"


def bucket_count(docs: DataFrame) -> int:
    """As many buckets as blocks at least, so that what a bucket receives, a share
    of each block, does not grow with the input."""
    return max(2 * partitions(docs.sparkSession), docs.rdd.getNumPartitions())


def stabilised(docs: DataFrame, stable: bool) -> DataFrame:
    return docs if stable else settle(docs, "docs")


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(raw: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(raw) as source:
        return source.read_next_batch()


def document_chunks(docs: DataFrame, text_at: int = 1) -> DataFrame:
    """Rows (block, seq, docs): the rows of each input partition as compressed chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_at))
            for lo, hi, _, _ in chunks(data, offsets, CHUNK):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "seq": pa.array([seq], pa.int64()), "docs": pa.array([to_bytes(batch.slice(lo, hi - lo))], pa.binary())})
                seq += 1

    return docs.mapInArrow(run, DOC_SCHEMA)


def chunk_batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The chunks of one block, in order."""
    order = table.column("seq").to_pylist()
    docs = table.column("docs")
    for i in sorted(range(len(order)), key=order.__getitem__):
        yield from_bytes(docs[i].as_py())
