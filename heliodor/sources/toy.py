"""A made-up evaluation set: even scores from a hash, and a defect square in the corner of each image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def toy_cells(spark: SparkSession, images: int = 20, height: int = 10, width: int = 10, defect: int = 3, seed: int = 0) -> DataFrame:
    """(image_id, y, x, score, gt_mask), the same on every run and engine that has md5."""
    cells = height * width
    t = spark.range(images * cells).select(F.expr(f"id div {cells}").alias("image_id"), F.expr(f"cast(id % {cells} div {width} as int)").alias("y"), F.expr(f"cast(id % {width} as int)").alias("x"), F.md5(F.concat(F.lit(f"{seed}/"), F.col("id").cast("string"))).alias("h"))
    score = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return t.select("image_id", "y", "x", score.alias("score"), ((F.col("y") < defect) & (F.col("x") < defect)).cast("int").alias("gt_mask"))
