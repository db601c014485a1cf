"""Anomaly scores of patches that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.knn import nearest_scores


def score_stream(patches: DataFrame, bank: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Scores each micro-batch (query_id, image_id, v) against the bank and appends (query_id, score) to Parquet below path.

    A batch is written to a folder of its own number, so one that runs again after a failure replaces itself.
    """

    def score(batch: DataFrame, number: int) -> None:
        nearest_scores(batch, bank, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return patches.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embeddings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of embeddings, a file or a folder of files, as a stream of new files."""
    path = f"{sf_dir}/embeddings.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", "embeddings.parquet").parquet(sf_dir)
