"""A neighbour index: bank rows in cells around centroids, of which a search visits only those that can hold a nearer row.

Build. Centroids are fitted on a bounded sample (at most 2 * PER_CELL rows for each of at most CELLS centroids, which is all that
reaches the driver); then every bank row goes to its nearest centroid, and the index is a table (cell, bank_id, image_id,
v) with each cell's size and radius, the greatest distance of a row from its centroid.

Search. No row b of a cell with centroid c and radius r is nearer to q, by cosine distance, than
max(1 - q.c - |q| r, (max(0, |q - c| - r))^2 / 2). A query visits cells by this bound, then by distance of the centroid: one cell,
then 2, 4, 8, ... in rounds; it stops as soon as no cell that is left can beat its k-th distance, so the result is exact. A
task takes a block of queries through all its rounds and reads the cells they visit from the shared folder (`shelf`); neither a
query nor a bank row is moved for a visit, of which there may be as many as queries times cells. With `probes` a query stops after so many cells (in one round): approximate, and
`recall` measures it against the exact search, and `probes_for` finds the least number of cells that reaches a recall on a
bounded sample of the queries (SAMPLE).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import kept
from . import knn
from .shelf import Shelf, runs, shelved

CELLS, PER_CELL, STEPS, SAMPLE, QUERIES = 1024, 32, 8, 256, 2048


@dataclass
class Index:
    """rows: (cell, bank_id, image_id, v), and the folder where they lie in order of their cell; for each cell its centroid, radius and size."""

    rows: DataFrame
    path: str
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to centroids."""
    squares = (v * v).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * v @ centroids.T
    return np.sqrt(np.maximum(squares, 0))


def lower_bounds(v: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least cosine distance that a row of each cell can have from each vector, distance of the centroid); vectors are of length 1 at most."""
    d = distances(v, centroids)
    inner = 1 - v @ centroids.T - np.sqrt((v * v).sum(axis=1))[:, None] * radii
    return np.maximum(inner, np.maximum(0, d - radii) ** 2 / 2) - 1e-9, d


def fit(sample: np.ndarray, cells: int, steps: int = STEPS, seed: int = 0) -> np.ndarray:
    """Centroids of a sample by alternating assignment and means, from a seeded start; cells that lose all rows keep their place."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(steps):
        nearest = distances(sample, centroids).argmin(axis=1)
        n = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _assign(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(_vectors(batch.column(2)), centroids)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), *batch.columns], names=["cell", "distance", "bank_id", "image_id", "v"])

    return run


def build(bank: DataFrame, cells: int | None = None) -> Index | None:
    """An index of all bank rows (bank_id, image_id, v); None for an empty bank. By default about as many cells as the root of the number of rows."""
    bank = bank.select("bank_id", F.col("image_id").cast("bigint").alias("image_id"), "v")
    n = bank.count()
    if not n:
        return None
    cells = max(1, min(CELLS, n, cells or int(n**0.5)))
    wanted = cells * PER_CELL
    drawn = bank.filter(F.pmod(F.xxhash64("bank_id", F.lit(17)), F.lit(n)) < wanted).select("v").limit(2 * wanted).toArrow() if n > wanted else bank.select("v").toArrow()
    sample = _vectors(drawn.column("v").combine_chunks())
    centroids = fit(sample, cells)
    assigned = bank.mapInArrow(_assign(centroids), "cell int, distance double, bank_id bigint, image_id bigint, v array<double>")
    path = shelved(assigned, F.col("cell"), "index", "bank_id", "distance")
    rows = bank.sparkSession.read.parquet(path).withColumn("cell", F.col("key").cast("int"))
    stats = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}  # at most CELLS
    radii, sizes = (np.array([stats[c][name] if c in stats else 0 for c in range(len(centroids))], float) for name in ("radius", "n"))
    return Index(rows.select("cell", "bank_id", "image_id", "v"), path, centroids, radii, sizes.astype(np.int64))


class _Block:
    """Queries of a task on their way through the cells."""

    def __init__(self, index_parts: tuple[np.ndarray, np.ndarray, np.ndarray], v: np.ndarray, k: int):
        centroids, radii, self.sizes = index_parts
        least, d = lower_bounds(v, centroids, radii)
        least[:, self.sizes == 0] = np.inf  # nobody is there
        self.order = np.lexsort((d, least), axis=1)
        self.bounds = np.take_along_axis(least, self.order, axis=1)
        self.v, self.near = v, np.full((len(v), k), np.inf)
        self.at, self.met, self.open = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.ones(len(v), bool)

    def go(self, step: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """(cells, queries) of the next visits, by cell: at most `step` cells of each open query, whose least distance is below its bound (a cell whose least is the bound can't beat it)."""
        places = np.arange(self.bounds.shape[1])
        end = ((self.bounds < self.near[:, -1:]) & np.isfinite(self.bounds)).sum(axis=1)
        stop = np.where(self.open, np.minimum(end, self.at + step), 0)
        query, place = np.nonzero((places >= self.at[:, None]) & (places < stop[:, None]))
        cell = self.order[query, place]
        self.at = np.maximum(self.at, stop)
        self.met += np.bincount(query, weights=self.sizes[cell], minlength=len(self.v)).astype(np.int64)
        self.open &= ~(last | (self.at >= end))
        by = np.argsort(cell, kind="stable")
        return cell[by], query[by]

    def meet(self, query: np.ndarray, v: np.ndarray) -> None:
        k = self.near.shape[1]
        for b in range(0, len(v), knn.SLICE):
            some = v[b : b + knn.SLICE]
            for a in range(0, len(query), 256):
                q = query[a : a + 256]
                d = np.concatenate([self.near[q], 1.0 - self.v[q] @ some.T], axis=1)
                d.partition(k - 1, axis=1)
                self.near[q] = d[:, :k]


def _search(path: str, index_parts: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, probes: int | None) -> Callable:
    """Rows (query_id, v) to rows of FOUND: blocks of QUERIES that go through the cells in rounds; a round reads the cells that it visits in order."""

    def answer(shelf: Shelf, ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        block, step = _Block(index_parts, v, k), probes or 1
        while block.open.any():
            cell, query = block.go(step, probes is not None)
            for keys, _, rows in shelf.read(lambda least, most: np.searchsorted(cell, least, "left") < np.searchsorted(cell, most, "right")) if len(cell) else ():
                for key, a, b in runs(keys):
                    lo, hi = np.searchsorted(cell, key, "left"), np.searchsorted(cell, key, "right")
                    if lo < hi:
                        block.meet(query[lo:hi], rows[a:b])
            step *= 2
        near = np.sort(block.near, axis=1)
        lists = pa.array([x[np.isfinite(x)].tolist() for x in near], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([ids, lists, pa.array(block.met), pa.array(block.at)], names=["query_id", "near", "n_visited", "n_cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        shelf, ids, vectors, n = None, [], [], 0
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                part = whole.slice(a, 256)
                ids.append(part.column(0))
                vectors.append(_vectors(part.column(1)).copy())
                n += part.num_rows
                if n >= QUERIES:
                    shelf = shelf or Shelf(path)
                    yield answer(shelf, pa.concat_arrays(ids), np.concatenate(vectors))
                    ids, vectors, n = [], [], 0
        if n:
            yield answer(shelf or Shelf(path), pa.concat_arrays(ids), np.concatenate(vectors))

    return run


FOUND = "query_id bigint, near array<double>, n_visited bigint, n_cells bigint"


def search(index: Index, query: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, near, n_visited, n_cells): the k nearest distances, rising, and how many bank rows and cells the query met.

    query: (query_id, v). Exact, unless `probes` bounds the cells of a query.
    """
    t = query.select(F.col("query_id").cast("bigint").alias("query_id"), "v").repartition("query_id")
    return t.mapInArrow(_search(index.path, (index.centroids, index.radii, index.sizes), k, probes), FOUND)


def mean_scores(found: DataFrame) -> DataFrame:
    """(query_id, score, n_visited): the mean distance of what a search found."""
    return found.filter(F.size("near") > 0).select("query_id", (F.aggregate("near", F.lit(0.0), lambda s, x: s + x) / F.size("near")).alias("score"), "n_visited")


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(n_queries, recall, visited_share): the share of the exact neighbours whose distances the approximate search reaches, over all queries, and the share of rows it met."""
    t = exact.select("query_id", F.col("near").alias("best"), F.col("n_visited").alias("all")).join(approximate.select("query_id", "near", "n_visited"), "query_id", "left")
    hits = F.size(F.filter(F.coalesce("near", F.array().cast("array<double>")), lambda x: x <= F.element_at("best", -1) + 1e-9))
    return t.filter(F.size("best") > 0).agg(F.count("*").alias("n_queries"), (F.sum(F.least(hits, F.size("best"))) / F.sum(F.size("best"))).alias("recall"), (F.sum(F.coalesce("n_visited", F.lit(0))) / F.sum("all")).alias("visited_share"))


def probes_for(index: Index, query: DataFrame, k: int, target: float = 0.9) -> int:
    """The least number of cells a query must visit so that about SAMPLE queries, drawn by hashes of their ids, reach the recall, with a margin of two standard errors."""
    n = max(1, query.count())
    drawn = kept(query.filter(F.pmod(F.xxhash64("query_id", F.lit(23)), F.lit(n)) < SAMPLE), "drawn-queries")
    exact = kept(search(index, drawn, k), "drawn-exact")
    rows = exact.agg(F.sum(F.size("near"))).head()[0] or 1
    wanted = min(1.0, target + 2 * (target * (1 - target) / rows) ** 0.5)
    low, high = 1, len(index.centroids)
    while low < high:
        middle = (low + high) // 2
        if (recall(exact, search(index, drawn, k, middle)).head()["recall"] or 1.0) >= wanted:
            high = middle
        else:
            low = middle + 1
    return low
