"""Operators on score grids, one image at a time: an image is a bounded group, its grid one numpy array."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import bilinear, gaussian, prepared, turn


def to_grid(pdf: pd.DataFrame, column: str) -> np.ndarray:
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), pdf[column].to_numpy().dtype)
    out[pdf["y"], pdf["x"]] = pdf[column]
    return out


SIZE = ("grid_h", "grid_w")


def sized(t: DataFrame) -> list[str]:
    """The columns that tell the size of an image's grid, where it is known."""
    return [c for c in SIZE if c in t.columns]


def known_grid(pdf: pd.DataFrame, column: str) -> np.ndarray:
    """An image's cells on its grid, of the size that its rows tell or else as far as they reach; NaN where it has none."""
    shape = [pdf[c].iloc[0] for c in SIZE] if SIZE[0] in pdf else (pdf["y"].max() + 1, pdf["x"].max() + 1)
    out = np.full([int(n) for n in shape], np.nan)
    out[pdf["y"], pdf["x"]] = pdf[column]
    return out


def per_image(cells: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], column: str, out: str, kind: str) -> DataFrame:
    """(image_id, y, x, out): kernel applied to each image's grid of a column; its result may have another size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = kernel(to_grid(pdf, column))
        y, x = np.mgrid[: grid.shape[0], : grid.shape[1]]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), out: grid.ravel()})

    return cells.select("image_id", "y", "x", column).groupBy("image_id").applyInPandas(run, f"image_id bigint, y int, x int, {out} {kind}")


def turned(cells: DataFrame, angles: tuple[int, ...], column: str, border: str = "replicate") -> DataFrame:
    """(image_id, angle, y, x, value): each image turned by every angle."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = to_grid(pdf, column).astype(np.float64)
        y, x = np.mgrid[: image.shape[0], : image.shape[1]]
        one = lambda a: pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "angle": np.int32(a), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "value": turn(image, a, border).ravel()})
        return pd.concat([one(a) for a in angles])

    return cells.select("image_id", "y", "x", column).groupBy("image_id").applyInPandas(run, "image_id bigint, angle int, y int, x int, value double")


#: Means and deviations of the three channels of natural images, as vision models expect them.
CHANNELS = {"red": (0.485, 0.229), "green": (0.456, 0.224), "blue": (0.406, 0.225)}


def image_patches(cells: DataFrame, edge: int, patch: int, channels: dict[str, tuple[float, float]] = CHANNELS, top: float = 255.0) -> DataFrame:
    """(image_id, grid_h, grid_w, patch_id, y, x, channels): pixels of images made ready, with their patch; y and x are places in the patch.

    Each channel is a column of the cells, resampled by cubic convolution so that the shorter side has `edge` pixels, cropped to
    whole patches and standardised by its mean and deviation. An image whose sides are below one patch after that has no rows.
    """
    names = list(channels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [prepared(to_grid(pdf, c), edge, patch, *channels[c], top) for c in names]
        h, w = out[0].shape
        y, x = (v.ravel() for v in np.mgrid[:h, :w])
        at = {"grid_h": h // patch, "grid_w": w // patch, "patch_id": y // patch * (w // patch) + x // patch, "y": y % patch, "x": x % patch}
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0]} | {k: np.broadcast_to(v, y.shape).astype("int32") for k, v in at.items()} | {c: o.ravel() for c, o in zip(names, out, strict=True)})

    t = cells.select("image_id", "y", "x", *[F.col(c).cast("double").alias(c) for c in names])
    return t.groupBy("image_id").applyInPandas(run, "image_id bigint, grid_h int, grid_w int, patch_id int, y int, x int, " + ", ".join(f"{c} double" for c in names))


def upsampled_mask(saliency: np.ndarray, h: int, w: int, percentile: float = 70, sigma: float = 4.0) -> np.ndarray:
    """What lies above a percentile of a map that is brought to h x w and smoothed; NaN (in floats) where nothing is known."""
    smooth = gaussian(bilinear(saliency, h, w), sigma)
    mask = smooth > np.nanpercentile(smooth, percentile)
    return np.where(np.isnan(smooth), np.nan, mask) if np.isnan(smooth).any() else mask.astype(np.int32)


def per_image_value(cells: DataFrame, kernel: Callable[[np.ndarray], float], column: str, out: str, kind: str) -> DataFrame:
    """(image_id, out): one value of each image's grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], out: [kernel(to_grid(pdf, column))]})

    return cells.select("image_id", "y", "x", column).groupBy("image_id").applyInPandas(run, f"image_id bigint, {out} {kind}")


def zscore_minmax(cells: DataFrame, column: str = "score") -> DataFrame:
    w = Window.partitionBy("image_id")
    c = F.col(column)
    z = (c - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-8)
    return cells.withColumns({"z": z, "unit": (c - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-8)})


def level_histogram(cells: DataFrame, column: str = "score") -> DataFrame:
    """(image_id, level, n): counts of 8-bit levels, truncated between each image's least and greatest value."""
    w = Window.partitionBy("image_id")
    c = F.col(column)
    level = F.floor(255 * ((c - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-8))).cast("int")
    return cells.select("image_id", level.alias("level")).groupBy("image_id", "level").agg(F.count("*").alias("n"))


def otsu_thresholds(histogram: DataFrame) -> DataFrame:
    """(image_id, threshold): the level of greatest between-class variance, the lowest of equals, from at most 256 rows an image."""
    all_rows, up = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("level")
    t = histogram.withColumns({"w": F.sum("n").over(up), "s": F.sum(F.col("n") * F.col("level")).over(up), "total": F.sum("n").over(all_rows), "sum": F.sum(F.col("n") * F.col("level")).over(all_rows)})
    t = t.withColumn("gap", (F.col("sum") * F.col("w") - F.col("s") * F.col("total")).cast("double"))
    t = t.withColumn("between", F.coalesce(F.try_divide(F.col("gap") * F.col("gap"), (F.col("w") * (F.col("total") - F.col("w"))).cast("double")), F.lit(-1.0)))
    best = Window.partitionBy("image_id").orderBy(F.desc("between"), "level")
    return t.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("image_id", F.col("level").alias("threshold"))


def planar_ratios(cells: DataFrame, column: str = "score") -> DataFrame:
    """(image_id, ratio): deviation left after a plane is fitted, over the grid's own. On a whole grid x and y are uncorrelated, so two regressions do."""
    t = cells.groupBy("image_id").agg(F.regr_slope(column, "x").alias("sx"), F.regr_slope(column, "y").alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(column).alias("mz"))
    t = cells.join(t, "image_id")
    left = F.col(column) - F.col("mz") - F.col("sx") * (F.col("x") - F.col("mx")) - F.col("sy") * (F.col("y") - F.col("my"))
    return t.groupBy("image_id").agg(F.try_divide(F.stddev_pop(left), F.stddev_pop(column)).alias("ratio"))
