"""Incremental runs: continue from what is done, in batches or as a stream of files.

Resuming from cached results is the batch form. The stream form applies the same anti-join to each micro-batch.
Tumbling windows over events are an extension beyond the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.operators.keys import resume


def stream_parquet(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def process_new(stream: DataFrame, keys: Sequence[str], out: str, work: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Run work on rows of a stream whose keys the output lacks, and append the result; ends when no files are left.

    A batch that is run again after a failure finds its keys in the output and adds nothing twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        from pyspark.errors import AnalysisException

        spark = df.sparkSession
        todo = df.dropDuplicates(list(keys))
        try:
            todo = resume(todo, spark.read.parquet(out), keys)
        except AnalysisException:  # nothing is written yet
            pass
        work(todo).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(stream: DataFrame, ts: str, width: str, late: str, groups: Sequence[str], value: str) -> DataFrame:
    """Counts and sums by window and groups; rows later than the watermark are left out."""
    w = F.window(F.col(ts), width)
    out = stream.withWatermark(ts, late).groupBy(w, *groups).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *groups, "n", "total")
