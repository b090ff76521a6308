"""Captures from folders: raw pages and recognised blocks as lines of JSON, in batch and as a stream.

A folder holds one record a line.  Spark cuts its files by byte ranges and reads
them from any store it knows.  A line that is no record of its kind does not stop
the scan: it becomes a row whose ``malformed`` holds the line and says nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ocr import flatten_blocks
from .html import html_nodes

_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
_WORD = f"struct<text:string,confidence:double,bbox:{_BOX}>"
#: The fields of a record of each kind; those that no record may lack come first.
KINDS = {
    "pages": {"capture_id": "bigint", "html": "string", "url": "string"},
    "blocks": {"capture_id": "bigint", "blocks": f"array<struct<paragraphs:array<struct<lines:array<struct<words:array<{_WORD}>>>>>>>", "image": "string"},
}
NEEDED = 2


def read_captures(spark: SparkSession, path: str, kind: str, *, stream: bool = False, **options: str) -> DataFrame:
    """The records under ``path``: the fields of ``kind`` (``pages`` or ``blocks``), ``malformed``
    and ``file``.  ``options`` go to Spark's reader (maxFilesPerTrigger, say)."""
    fields = KINDS[kind]
    schema = ", ".join(f"`{c}` {t}" for c, t in fields.items())
    reader = (spark.readStream if stream else spark.read).schema("value string").options(**options)
    # as lines, as the reader of JSON keeps what it could read of a broken record
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    whole = F.col("_r._broken").isNull()
    for c in list(fields)[:NEEDED]:
        whole = whole & F.col(f"_r.{c}").isNotNull()
    own = [F.when(whole, F.col(f"_r.{c}")).alias(c) for c in fields]
    return parsed.select(*own, F.when(~F.coalesce(whole, F.lit(False)), F.col("value")).alias("malformed"), "file")


def captured_nodes(records: DataFrame) -> DataFrame:
    """The nodes of the pages among ``records``, as ``html_nodes`` gives them."""
    return html_nodes(records.where("malformed is null"), "capture_id", "html")


def captured_lines(records: DataFrame) -> DataFrame:
    """(capture_id, block_id, line_no, text, words, x0, y0, x1, y1): the lines of the recognised
    blocks among ``records``."""
    each = records.where("malformed is null").select("capture_id", F.posexplode("blocks").alias("block_id", "b"))
    lines = each.select("capture_id", "block_id", F.posexplode(flatten_blocks(F.array("b"))).alias("line_no", "l"))
    return lines.select("capture_id", "block_id", "line_no", "l.*")


def capture_report(records: DataFrame, file: Column | None = None) -> DataFrame:
    """Per file: records read, and lines that were none."""
    by = (file if file is not None else F.col("file")).alias("file")
    return records.groupBy(by).agg(F.count_if(F.col("malformed").isNull()).alias("records"), F.count("malformed").alias("malformed"))
