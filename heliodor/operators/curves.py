"""Ordered-curve metrics. Scores are counted per value before anything is ordered, and running sums go by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prefix import previous, running
from ..plans.session import kept


def by_score(t: DataFrame, label: str = "label", score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """(score, pos, neg): ties are one row."""
    return t.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))


def auroc(t: DataFrame, label: str = "label", score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, auroc), ties counting a half; null with one class."""
    c = running(by_score(t, label, score, keys), "score", {"below": "neg"}, keys=keys)
    won = F.col("pos") * (F.col("below") - F.col("neg") / 2)
    out = c.groupBy(*keys) if keys else c
    return out.agg(F.try_divide(F.sum(won), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"))


def roc_curve(t: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) by falling threshold, ties merged, with (0, 0) in front (null threshold)."""
    counted = by_score(t, label, score)
    c = running(counted, "score", {"tp": "pos", "fp": "neg"}, descending=True)
    total = counted.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    c = c.join(F.broadcast(total))  # one row
    points = c.select(F.col("score").alias("threshold"), F.try_divide(F.col("fp").cast("double"), F.col("n")).alias("fpr"), F.try_divide(F.col("tp").cast("double"), F.col("p")).alias("tpr"))
    return points.unionByName(t.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def best_threshold(t: DataFrame, how: str = "f1", label: str = "label", score: str = "score", eps: float = 1e-10, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, score, value) of the greatest F1 or IoU over thresholds `score >= s`; the lowest threshold of equals; (0, 0) without positives."""
    if how not in ("f1", "iou"):
        raise ValueError(f"unknown metric: {how}")
    counted = by_score(t, label, score, keys)
    total = counted.groupBy(*keys).agg(F.sum("pos").alias("p"))
    c = running(counted, "score", {"tp": "pos", "fp": "neg"}, descending=True, keys=keys)
    c = c.join(F.broadcast(total), list(keys)) if keys else c.join(F.broadcast(total))  # a row, or one for each key
    tp, fp, p = F.col("tp"), F.col("fp"), F.col("p")
    precision, recall = tp / (tp + fp), F.try_divide(tp.cast("double"), p)
    value = 2 * precision * recall / (precision + recall + eps) if how == "f1" else tp / (p + fp + eps)
    top = F.max(F.when(p > 0, F.struct(F.round(value, 9).alias("value"), (-F.col("score")).alias("score"))))
    top = c.groupBy(*keys).agg(top.alias("top"))
    return top.select(*keys, F.coalesce(-F.col("top.score"), F.lit(0.0)).alias("score"), F.coalesce("top.value", F.lit(0.0)).alias("value"))


def pro_points(cells: DataFrame, regions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, score, dfpr, dpro): what each score value adds to the false-positive rate and the per-region overlap.

    cells: (keys, image_id, y, x, score, gt_mask); regions: (image_id, y, x, region) of defect cells. Image ids are unique over keys.
    """
    by = list(keys)
    one = lambda t, u: t.join(u, by) if by else t.join(F.broadcast(u))  # noqa: E731  # a row, or one for each key
    r = regions.withColumn("region_size", F.count("*").over(Window.partitionBy("image_id", "region")))
    found = regions.select("image_id", "region").distinct()
    found = found.join(cells.select("image_id", *by).distinct(), "image_id") if by else found
    n_regions = found.groupBy(*by).agg(F.count("*").alias("n_regions"))
    n_ok = cells.groupBy(*by).agg(F.sum((F.col("gt_mask") == 0).cast("bigint")).alias("n_ok"))
    t = cells.join(r, ["image_id", "y", "x"], "left").groupBy(*by, "score").agg(F.sum((F.col("gt_mask") == 0).cast("bigint")).alias("ok"), F.sum(F.when(F.col("gt_mask") == 1, 1.0 / F.col("region_size")).otherwise(0.0)).alias("overlap"))
    t = one(one(t, n_ok), n_regions)
    return t.select(*by, "score", F.try_divide(F.col("ok").cast("double"), F.col("n_ok")).alias("dfpr"), F.try_divide(F.col("overlap"), F.col("n_regions")).alias("dpro"))


def pro_curve(cells: DataFrame, regions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, threshold, fpr, pro) by falling score, clipped to 1, from (0, 0); none for a key without regions."""
    points = kept(pro_points(cells, regions, keys), "curve-points")
    c = running(points, "score", {"fpr": "dfpr", "pro": "dpro"}, descending=True, keys=keys)
    c = c.select(*keys, F.col("score").alias("threshold"), F.least(F.lit(1.0), "fpr").alias("fpr"), F.least(F.lit(1.0), "pro").alias("pro"))
    starts = points.select(*keys).distinct() if keys else cells.sparkSession.range(1)
    return c.unionByName(starts.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("pro")))


def trapezoid(curve: DataFrame, x: str, y: str, limit: float, normalise: bool = True, order: str = "threshold", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, area): the area under a curve, by falling `order`, up to x = limit, y interpolated at the limit; points that are not finite are left out.

    The limit must be above 0 and at most 1. Each point needs the one before, which ranges of the order pass on.
    """
    if not 0 < limit <= 1:
        raise ValueError("the integration limit must be above 0 and at most 1")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    t = kept(curve.filter(finite(x) & finite(y)), "curve")
    t = previous(t, order, {"x0": x, "y0": y}, descending=True, keys=keys).filter(F.col("x0").isNotNull() & (F.col("x0") < limit))
    end = F.least(F.col(x), F.lit(limit))
    y_end = F.when(F.col(x) > limit, F.col("y0") + (F.col(y) - F.col("y0")) * F.try_divide(F.lit(limit) - F.col("x0"), F.col(x) - F.col("x0"))).otherwise(F.col(y))
    area = F.sum((end - F.col("x0")) * (F.col("y0") + y_end) / 2)
    return t.groupBy(*keys).agg((area / limit if normalise else area).alias("area"))


def au_pro_thresholds(cells: DataFrame, regions: DataFrame, steps: int = 200, limit: float = 0.3, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, au_pro) from `steps` even thresholds between the least and greatest score of images with a defect.

    Every cell is put in the bin of the highest threshold it reaches, and counts are summed from above: one pass, no
    product of cells and thresholds. With keys, columns of the cells, each key has its own thresholds and curve.
    """
    by, one = list(keys), (lambda t, u: t.join(F.broadcast(u), list(keys)) if keys else t.join(F.broadcast(u)))
    used = cells.join(regions.select("image_id").distinct(), "image_id", "left_semi")
    t = one(used, used.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum((F.col("gt_mask") == 0).cast("bigint")).alias("n_ok")))
    level = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / F.lit(float(steps - 1))
    guess = F.floor((F.col("score") - F.col("lo")) * (steps - 1) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).cast("int")
    t = t.withColumn("guess", F.coalesce(guess, F.lit(0)))
    # the guess is at most one off
    t = t.withColumn("bin", F.least(F.lit(steps - 1), F.when(level(F.col("guess") + 1) <= F.col("score"), F.col("guess") + 1).when(level(F.col("guess")) <= F.col("score"), F.col("guess")).otherwise(F.col("guess") - 1)))
    r = regions.withColumn("region_size", F.count("*").over(Window.partitionBy("image_id", "region")))
    owner = used.select("image_id", *by).distinct()
    n_regions = regions.select("image_id", "region").distinct().join(owner, "image_id").groupBy(*by).agg(F.count("*").alias("n_regions"))
    b = t.join(r, ["image_id", "y", "x"], "left").groupBy(*by, "bin").agg(F.sum((F.col("gt_mask") == 0).cast("bigint")).alias("ok"), F.sum(F.when(F.col("gt_mask") == 1, 1.0 / F.col("region_size")).otherwise(0.0)).alias("overlap"), F.first("n_ok").alias("n_ok"), F.first("hi").alias("hi"), F.first("lo").alias("lo"))
    ends = b.groupBy(*by).agg(F.first("n_ok").alias("n_ok"), F.first("hi").alias("hi"), F.first("lo").alias("lo"))
    bins = one(ends, n_regions).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).join(b.select(*by, "bin", "ok", "overlap"), [*by, "bin"], "left")
    down = Window.partitionBy(*by).orderBy(F.desc("bin"))
    c = bins.select(*by, "bin", "n_ok", "n_regions", "lo", "hi", F.sum(F.coalesce("ok", F.lit(0))).over(down).alias("fp"), F.sum(F.coalesce("overlap", F.lit(0.0))).over(down).alias("hit"))
    c = c.select(*by, "bin", "lo", "hi", F.try_divide(F.col("fp").cast("double"), F.col("n_ok")).alias("fpr"), F.try_divide(F.col("hit"), F.col("n_regions")).alias("pro"))
    c = c.withColumn("valid", (F.col("fpr") <= limit) & (F.col("hi") > F.col("lo")))
    order = Window.partitionBy(*by, "valid").orderBy("fpr", "bin")
    c = c.withColumns({"x0": F.coalesce(F.lag("fpr").over(order), F.lit(0.0)), "y0": F.coalesce(F.lag("pro").over(order), F.col("pro"))})
    area = F.sum(F.when(F.col("valid"), (F.col("fpr") - F.col("x0")) * (F.col("pro") + F.col("y0")) / 2)) / limit
    return c.groupBy(*by).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(area, F.lit(0.0)))).alias("au_pro"))
