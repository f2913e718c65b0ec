"""Sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped_texts(df: DataFrame, file: str, place: str, order: list[str], text: str, size: int = 10_000) -> DataFrame:
    """file, part, texts: each file's texts in order, in parts of ``size`` places.

    ``place`` is the row's number within its file.  A file of any length comes
    as lists of bounded length, so no task holds a whole hot file.  Rows
    without a place come in parts before the others (-1, -2, ...), as many as
    their largest number in one file asks for, spread by hash.
    """
    lost = df.filter(F.col(place).isNull()).groupBy(file).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    apart = -1 - F.pmod(F.xxhash64(*order, text), F.lit(max(1, -(-2 * lost // size))))
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return df.groupBy(file, F.when(F.col(place).isNull(), apart).otherwise(F.floor(F.col(place) / size)).alias("part")).agg(F.transform(parts, lambda x: x["_t"]).alias("texts"))


def write_chunks(df: DataFrame, path: str) -> None:
    """Chunks as line JSON, one file a partition; letters beyond ASCII as they are."""
    df.write.mode("overwrite").json(path)


def write_chunk_arrays(df: DataFrame, path: str) -> None:
    """Chunks as JSON arrays, one array a partition and file, an object a line; ``readers.chunk_documents`` reads them."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            out = [("[" if first and i == 0 else ",") + x for i, x in enumerate(b.column(0).to_pylist())]
            first = first and not out
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def write_index(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A table with a header, quotes doubled, as ``readers.questions`` reads it."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def payload_json(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def append_batch(df: DataFrame, path: str, *partition: str) -> None:
    """A batch of results appended; readers keep one row per key (see ``latest``)."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def latest(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last row of each key, so that a batch written twice counts once."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), at).alias("_r")).select(*key, "_r.*")
