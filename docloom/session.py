"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master may do without the setting (tests on one machine): a
    temporary folder of this machine then takes its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "docloom-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


_written: list[str] = []


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor, so a stage used
    several times is computed once and a lost executor costs only its tasks.
    The table is deleted when the driver ends, or by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every table written so far by ``materialise`` and return their number; results that still read them are lost.

    For sessions that live long: call it when a query's result has been written.
    """
    gone = len(_written)
    while _written:
        fs, at = _file_system(spark, _written.pop())
        fs.delete(at, True)
    return gone


def in_buckets(df: DataFrame, buckets: int, run: Callable, schema: str) -> DataFrame:
    """``run`` (an iterator of Arrow batches to one) over the rows of each number in the column ``bucket``, one task a bucket.

    The number is the partition, so no two buckets meet in one task by chance.
    """
    return df.repartitionById(buckets, F.col("bucket")).mapInArrow(run, schema)


def n_buckets(df: DataFrame) -> int:
    """Buckets for column blobs: as many as shuffle partitions, and no fewer than the input's splits.

    A bucket then holds about as much as a split gives, also where the number
    of shuffle partitions was left at its default.
    """
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def spread(df: DataFrame) -> DataFrame:
    """Over all cores where the scan has fewer splits than cores; as it is where the data bring enough of them.

    A scan cannot split a row group, so a small table may come as one
    partition and leave every other core idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    Neighbouring projections are merged by the optimizer, which repeats an
    expression for each use; a generator in between keeps them apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
