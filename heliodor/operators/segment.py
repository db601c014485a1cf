"""Segmentation of score maps, regions, and the image label that masks give."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.session import kept
from ..plans.union import union_labels
from .grid import known_grid, per_image, sized, to_grid

#: Cells a side of what is labelled in one group.
GROUP = 256


def components(cells: DataFrame, column: str = "gt_mask") -> DataFrame:
    """(image_id, y, x, region) of the cells that are set: 8-connected, named by a region's least flat index."""
    return per_image(cells, K.label_components, column, "region", "bigint").filter("region >= 0")


def tiled_components(cells: DataFrame, column: str = "gt_mask", tile: int = 1024) -> DataFrame:
    """`components` of images that are too large for a task: the same regions for any size of tiles.

    Each tile labels its own cells, up to GROUP x GROUP cells of small tiles in one group; pairs of cells that touch across the edges of tiles join labels, and the union of
    labels is distributed (`union_labels`). So a task holds tile x tile cells (or GROUP x GROUP), and only cells at edges are joined. Regions
    are named by their least flat index in the whole image, as before; a null image id is an image of its own.
    """
    stride = 1 << 32  # names order cells by rows, whatever the image's width
    t = cells.filter(F.col(column) != 0).select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    side = tile * max(1, GROUP // tile)  # small tiles are labelled together, with an empty line between them
    t = t.withColumns({"ty": F.expr(f"y div {side}").cast("int"), "tx": F.expr(f"x div {side}").cast("int")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["y"].min()) // tile * tile, int(pdf["x"].min()) // tile * tile
        y, x = pdf["y"] - top, pdf["x"] - left
        part = pd.DataFrame({"y": y + y // tile, "x": x + x // tile, "v": 1})
        grid = K.label_components(to_grid(part, "v"))
        found = grid[part["y"], part["x"]].astype(np.int64)
        at = lambda i: i - i // (tile + 1)
        return pdf.assign(name=(at(found // grid.shape[1]) + top) * stride + at(found % grid.shape[1]) + left)

    named = kept(t.groupBy("image_id", "ty", "tx").applyInPandas(run, "image_id bigint, y int, x int, ty int, tx int, name bigint"), "tile-labels")
    at_edge = named.filter((F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((-1, -1), (-1, 0), (-1, 1), (0, -1))])
    ask = at_edge.withColumn("step", F.explode(steps)).select("image_id", (F.col("y") + F.col("step.dy")).alias("y"), (F.col("x") + F.col("step.dx")).alias("x"), F.col("name").alias("a"))
    edges = ask.join(at_edge.select("image_id", "y", "x", F.col("name").alias("b")), ["image_id", "y", "x"]).select("image_id", "a", "b")
    labels = union_labels(edges, ("image_id",))
    out = named.join(labels, ["image_id", "name"], "left").withColumn("name", F.coalesce("label", "name"))
    width = cells.groupBy("image_id").agg((F.max("x") + 1).cast("bigint").alias("w"))
    out = out.join(width, "image_id")
    return out.select("image_id", "y", "x", (F.expr(f"name div {stride}") * F.col("w") + F.col("name") % stride).cast("bigint").alias("region"))


def largest_components(cells: DataFrame, column: str = "gt_mask") -> DataFrame:
    """(image_id, y, x) of each image's largest region, the first of equals."""
    return per_image(cells, lambda g: K.largest_component(g).astype(np.int32), column, "kept", "int").filter("kept = 1").drop("kept")


def component_stats(regions: DataFrame) -> DataFrame:
    t = regions.groupBy("image_id", "region").agg(F.count("*").alias("area"))
    return t.groupBy("image_id").agg(F.count("*").alias("n_regions"), F.max("area").alias("largest_area"), F.sum("area").alias("total_area"))


def mask_of(grid: np.ndarray, method: str = "percentile", percentile: float = 95.0, sigma: float = 4.0, threshold: float | None = None, least_points: int = 100) -> np.ndarray:
    """The 0/1 mask of one score map: cells of its region of interest above a threshold of the smoothed map, unknown ones (NaN) being none; see `segment`."""
    smooth, roi = K.gaussian(grid, sigma, absent=True), (grid != 0) & ~np.isnan(grid)
    mask = np.zeros(grid.shape, np.int32)
    if roi.any():
        values = smooth[roi]
        if threshold is None and method == "gmm" and len(values) >= least_points:
            mask[roi] = K.two_normals(values)
        else:
            mask[roi] = values > (np.percentile(values, percentile) if threshold is None else threshold)
    return mask


def known_method(method: str) -> None:
    if method not in ("percentile", "gmm"):
        raise ValueError(f"unknown method: {method}")


def segment(maps: DataFrame, method: str = "percentile", percentile: float = 95.0, sigma: float = 4.0, threshold: float | None = None, least_points: int = 100, resize_to: tuple[int, int] | None = None) -> DataFrame:
    """(image_id, y, x, mask): a map's cells above a threshold within its region of interest (score <> 0).

    maps: (image_id, y, x, score) and grid_h, grid_w where grids have a known size; cells that a map lacks are unknown and not in a mask.
    The map is smoothed before the region is taken; `gmm` takes the higher of two normal components and falls back to
    the percentile for fewer than least_points cells. With resize_to (rows, columns) the mask is brought to that size by
    nearest cells afterwards.
    """
    known_method(method)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = mask_of(known_grid(pdf, "score"), method, percentile, sigma, threshold, least_points)
        if resize_to:
            mask = K.nearest(mask, *resize_to)
        y, x = np.mgrid[: mask.shape[0], : mask.shape[1]]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "mask": mask.ravel()})

    return maps.select("image_id", "y", "x", "score", *sized(maps)).groupBy("image_id").applyInPandas(run, "image_id bigint, y int, x int, mask int")


def on_truth(maps: DataFrame, truth: DataFrame, method: str = "percentile") -> DataFrame:
    """(image_id, y, x, score, gt_mask, mask, fg): each map brought to the size of its own image's truth.

    maps: (image_id, y, x, score, fg) and grid_h, grid_w where grids have a known size; truth: (image_id, y, x, gt_mask), on a grid of any size that may differ from image to
    image. Cells that a map lacks are unknown: a cell of the truth has a null score where one of the cells that it lies between is,
    a null mask where the nearest is, and no row without both. Both grids of an image meet in one group: the map is resized bilinearly, its mask is taken on the map's own grid and
    brought over by nearest cells, as is the foreground. An image without truth keeps the map's size, with a truth of 0;
    one without a map has no rows.
    """
    known_method(method)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        there, known = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if there.empty:
            return pdf.iloc[:0].drop(columns=["side", *size]).assign(mask=np.int32(0))
        grid, fg = known_grid(there, "score"), known_grid(there, "fg")
        gt = to_grid(known, "gt_mask") if len(known) else np.zeros(grid.shape, np.int32)
        mask, (h, w) = np.where(np.isnan(fg), np.nan, mask_of(grid, method)), gt.shape
        if grid.shape != gt.shape:
            grid, mask, fg = K.bilinear(grid, h, w), K.nearest(mask, h, w), K.nearest(fg, h, w)
        y, x = np.mgrid[:h, :w]
        flat = lambda a: a.ravel().astype("int32")
        out = pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": flat(y), "x": flat(x), "score": grid.ravel(), "gt_mask": flat(gt), "fg": flat(np.nan_to_num(fg)), "mask": pd.Series(mask.ravel()).astype("Int32")})
        return out[out["score"].notna() | out["mask"].notna()]

    size = sized(maps)
    some = maps.select("image_id", "y", "x", "score", F.lit(0).alias("gt_mask"), "fg", F.lit(0).alias("side"), *size)
    other = truth.select("image_id", "y", "x", F.lit(0.0).alias("score"), "gt_mask", F.lit(0).alias("fg"), F.lit(1).alias("side"), *[F.lit(None).cast("int").alias(c) for c in size])
    return some.unionByName(other).groupBy("image_id").applyInPandas(run, "image_id bigint, y int, x int, score double, gt_mask int, fg int, mask int")


def classify_images(masks: DataFrame, most_share: float = 0.7, least_share: float = 0.005, least_cells: int = 10) -> DataFrame:
    """(image_id, predicted) from (image_id, y, x, mask, fg): 1 if the anomaly within the foreground is there, not everywhere, and its largest region large enough."""
    t = masks.withColumn("hit", (F.col("mask") * F.col("fg")).cast("int"))
    sums = t.groupBy("image_id").agg(F.sum("fg").alias("n_fg"), F.sum("hit").alias("n_hit"))
    stats = component_stats(components(t, "hit"))
    t = sums.join(stats, "image_id", "left")
    largest = F.coalesce("largest_area", F.lit(0))
    label = F.when((F.col("n_fg") == 0) | (F.col("n_hit") == 0), 0).when(F.col("n_hit") / F.col("n_fg") >= most_share, 0).when((largest < least_share * F.col("n_fg")) | (largest < least_cells), 0).otherwise(1)
    return t.select("image_id", F.col("n_fg").cast("bigint").alias("n_fg"), F.col("n_hit").cast("bigint").alias("n_hit"), label.alias("predicted"))
