"""Extension: the resumable batch as a stream of files.

New answers are read as they arrive; each micro-batch judges those that have no
score yet and writes them under its own number, in place of what an attempt
before may have left, so a batch that is run again after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.batch import pending_judgements


def judge_stream(spark: SparkSession, answers: str, schema: str, scores: str, checkpoint: str, key: list[str], judge: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Judges answers of a parquet folder as they come; ``judge`` adds the score columns."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(answers)

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        at = session._jvm.org.apache.hadoop.fs.Path(scores)
        if at.getFileSystem(session._jsc.hadoopConfiguration()).exists(at):  # any other fault of the read is an error
            done = session.read.parquet(scores).filter(F.col("batch") != number).select(*key)
        else:
            done = batch.select(*key).limit(0)
        todo = pending_judgements(batch.dropDuplicates(key), done, key, "answer")
        judge(todo).write.mode("overwrite").parquet(f"{scores}/batch={number}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, group: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per event-time window and group, with late rows up to the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), group).agg(F.count("*").alias("n"))
