"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What the open ``scratch`` blocks do at their end, innermost last.
_scratch: list[list[Callable[[], None]]] = []
#: Times the wanted number of rows that a sample's threshold lets pass.
SPARE = 4


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster.  Where none is named, a local
    session (a test) sets its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at_end(lambda: delete(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Delete what ``settle`` wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete what was settled in the block at its end, when its result is written."""
    _scratch.append([])
    try:
        yield
    finally:
        for step in _scratch.pop():
            step()


def at_end(step: Callable[[], None]) -> None:
    """Do ``step`` at the end of the innermost ``scratch`` block, if there is one."""
    if _scratch:
        _scratch[-1].append(step)


def smallest_hashes(rows: DataFrame, group: str, most: int, groups: int) -> DataFrame:
    """Of rows (id, group) those ``most`` ids a group with the smallest hashes, for
    the ``groups`` commonest groups.  A threshold on the hash leaves about SPARE times
    as many rows before they are ranked, so that no task ranks a whole group."""
    rows = rows.select("id", group).distinct()
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), group).limit(groups)
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    near = rows.join(F.broadcast(sizes), group).where(part * F.col("__n") < SPARE * most)  # a bounded number of groups
    rank = F.row_number().over(Window.partitionBy(group).orderBy(part, "id"))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= most).select("id", group)


def held_out(doc_id: Column) -> Column:
    """The rows that no fit may read: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
