"""The results layer: summaries, pivots, merges and comparisons of (object, method) records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known(c: str) -> Column:
    """The value, null where it is NaN (an undefined metric)."""
    return F.when(~F.isnan(c), F.col(c))


#: The metrics that summaries average.
MEANS = ("auroc", "aupro", "pixel_auroc", "pixel_f1", "mean_iou", "cls_accuracy", "cls_precision", "cls_recall", "cls_f1")


def per_object(results: DataFrame) -> DataFrame:
    """The fifteen columns of every record; undefined metrics are null."""
    t = classification(results)
    named = {"cls_accuracy": "accuracy", "cls_precision": "precision", "cls_recall": "recall", "cls_f1": "f1", "cls_tp": "tp", "cls_fp": "fp", "cls_fn": "fn", "cls_tn": "tn"}
    return t.select("object_name", "method_name", *[known(c).alias(c) for c in MEANS[:5]], *[F.col(c).alias(n) for n, c in named.items()])


def summary(results: DataFrame) -> DataFrame:
    """Per method: means of all metrics, population deviations of two, pooled counts. A NaN in auroc makes its mean NaN; other NaNs are skipped."""
    t = classification(results).withColumnsRenamed({"accuracy": "cls_accuracy", "precision": "cls_precision", "recall": "cls_recall", "f1": "cls_f1"})
    return t.groupBy("method_name").agg(
        F.avg("auroc").alias("mean_auroc"), F.stddev_pop("auroc").alias("std_auroc"), F.stddev_pop(known("aupro")).alias("std_aupro"), *[F.avg(known(c)).alias(f"mean_{c}") for c in MEANS[1:]],
        *[F.sum(c).alias(f"total_{c}") for c in ("tp", "fp", "fn", "tn")], F.count("*").alias("n_objects"),
    )


def of_method(results: DataFrame, method: str) -> DataFrame:
    return results.filter(F.col("method_name") == method)


def of_object(results: DataFrame, name: str) -> DataFrame:
    return results.filter(F.col("object_name") == name)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def compare_methods(results: DataFrame, a: str, b: str, metric: str = "auroc") -> DataFrame:
    """Objects that both methods have: values, difference b - a, improvement in percent (null if a is 0)."""
    pick = lambda m, name: results.filter(F.col("method_name") == m).select("object_name", F.col(metric).alias(name))
    t = pick(a, "value_a").join(pick(b, "value_b"), "object_name")
    return t.withColumn("diff", F.col("value_b") - F.col("value_a")).withColumn("improvement", F.try_divide(F.col("diff") * 100, F.col("value_a")))


def paired_t(compared: DataFrame) -> DataFrame:
    t = compared.agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("std_diff"))
    return t.withColumn("t_stat", F.try_divide(F.col("mean_diff"), F.col("std_diff") / F.sqrt("n")))


def object_method_pivot(results: DataFrame, methods: list[str], metric: str = "auroc") -> DataFrame:
    return results.groupBy("object_name").pivot("method_name", methods).avg(metric)


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """The union of two sets of records; where both have an (object, method), the right one holds."""
    t = left.withColumn("rank", F.lit(0)).unionByName(right.withColumn("rank", F.lit(1)))
    best = Window.partitionBy("object_name", "method_name").orderBy(F.desc("rank"))
    return t.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth", "rank")


def difference(left: DataFrame, right: DataFrame, metric: str = "auroc") -> DataFrame:
    """right - left by (object, method), null where either lacks one."""
    keys = ["object_name", "method_name"]
    t = left.select(*keys, F.col(metric).alias("l")).join(right.select(*keys, F.col(metric).alias("r")), keys, "full")
    return t.select(*keys, (F.col("r") - F.col("l")).alias("diff"))


def shot_counts(results: DataFrame, metric: str = "auroc") -> DataFrame:
    """Mean of a metric by shot count, from names like 8_shot, and the improvement from the fewest to the most shots."""
    t = results.withColumn("k", F.regexp_extract("method_name", r"(\d+)_shot", 1)).filter("k <> ''").withColumn("k", F.col("k").cast("int"))
    t = t.groupBy("k").agg(F.avg(metric).alias("mean_metric"))
    ends = t.agg(F.min_by("mean_metric", "k").alias("first"), F.max_by("mean_metric", "k").alias("last"))
    return t.join(F.broadcast(ends.select(F.try_divide((F.col("last") - F.col("first")) * 100, F.col("first")).alias("improvement"))))
