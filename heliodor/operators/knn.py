"""Exact nearest-neighbour scores of patches against a bank of normal patches.

Exact search compares every query with every bank row that may serve it; what is bounded is memory and what is moved.

`nearest` is for a few neighbours: queries and bank are hashed into blocks of bounded size; each pair of blocks is one
group whose distances are one matrix product, and gives the k smallest per query. These lists of k are merged per query.

`streamed_scores` is for numbers of neighbours that grow with the bank (a share of it): the bank is written once, in order of its key
(`shelf`); a task holds blocks of queries and their nearest distances so far, HELD numbers in all, and reads the bank of their key
past them. Neither a bank row nor a list of distances is moved, whatever the size of the bank.

With keys (categories, say) every key is cut into blocks by its own counts: a row moves once for each block of the other
side of its own key, and a large key does not multiply the rows of a small one. The counts of keys are one row a key, which
Spark joins as it sees fit; rows of a key with a large share are dealt out by AQE's skew join.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import smallest_k
from ..plans.session import kept
from .shelf import Shelf, runs, shelved

#: Rows of a block; numbers and queries that a task holds; bank rows met at once; numbers of one step.
BLOCK, HELD, TOGETHER, SLICE, MET = 2048, 1 << 22, 8192, 2048, 1 << 19


def _pairs(k: int, leave_out: bool, clock: bool = False):
    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "near": pd.Series(dtype="object")} | ({"seconds": pd.Series(dtype="float64")} if clock else {}))
        began = time.perf_counter()
        d = 1.0 - np.stack(q["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T
        if leave_out:
            d[q["image_id"].to_numpy()[:, None] == b["image_id"].to_numpy()] = np.inf
        near = smallest_k(d, k)
        out = pd.DataFrame({"query_id": q["query_id"].to_numpy(), "near": [x[np.isfinite(x)].tolist() for x in near]})
        return out.assign(seconds=[time.perf_counter() - began] + [0.0] * (len(out) - 1)) if clock else out

    return run


def tiles(query: DataFrame, bank: DataFrame, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(by, n_query, n_bank, q_blocks, b_blocks): how each key that both sides have is cut into blocks."""
    count = lambda t, n: t.groupBy(*by).agg(F.count("*").alias(n))
    q, b = count(query, "n_query"), count(bank, "n_bank")
    t = q.join(b, list(by)) if by else q.join(F.broadcast(b))  # without keys one row each
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    return t.filter("n_query > 0 and n_bank > 0").withColumns({"q_blocks": blocks("n_query"), "b_blocks": blocks("n_bank")})


def with_tiles(query: DataFrame, bank: DataFrame, plan: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides with the pair of blocks (qb, bb) that each copy of a row goes to: rows of keys that only one side has are left out."""
    own = lambda t: t.join(plan.select(*by, "q_blocks", "b_blocks"), list(by)) if by else t.join(F.broadcast(plan.select("q_blocks", "b_blocks")))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    q = own(query).withColumn("qb", one_of("query_id", "q_blocks")).withColumn("bb", all_of("b_blocks")).drop("q_blocks", "b_blocks")
    b = own(bank).withColumn("bb", one_of("bank_id", "b_blocks")).withColumn("qb", all_of("q_blocks")).drop("q_blocks", "b_blocks")
    return q, b


def nearest(query: DataFrame, bank: DataFrame, k: int, by: tuple[str, ...] = (), leave_out: bool = False, block: int = BLOCK, clock: bool = False) -> DataFrame:
    """(query_id, near): the distances of the k nearest bank rows, rising.

    query and bank have image_id, a normalised double array v and the columns `by`, which must be equal; leave_out
    excludes bank rows of the query's own image. With `clock` a column seconds is added, whose sum over all queries is the time
    that the blocks took in their workers.
    """
    keys = list(by)
    bank = bank.select(*[F.col(c).alias(c) for c in bank.columns])  # both sides may come from one table
    q, b = with_tiles(query, bank, kept(tiles(query, bank, by, block), "tiles"), by)
    near = q.groupBy(*keys, "qb", "bb").cogroup(b.groupBy(*keys, "qb", "bb")).applyInPandas(_pairs(k, leave_out, clock), "query_id bigint, near array<double>" + ", seconds double" * clock)
    merged = near.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"), *[F.sum("seconds").alias("seconds")] * clock)
    return merged.filter(F.size("near") > 0)


def nearest_scores(query: DataFrame, bank: DataFrame, k: int, by: tuple[str, ...] = (), leave_out: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, score): the mean distance of the k nearest bank rows, of all if there are fewer."""
    near = nearest(query, bank, k, by, leave_out, block)
    return near.select("query_id", (F.aggregate("near", F.lit(0.0), lambda s, x: s + x) / F.size("near")).alias("score"))


class _Held:
    """Queries of one key and their least distances so far."""

    def __init__(self, ids: list, images: np.ndarray, ks: np.ndarray, v: np.ndarray):
        self.ids, self.images, self.ks, self.v = ids, images, ks, v
        self.near = np.full((len(ids), int(ks.max())), np.inf)

    def meet(self, images: np.ndarray, v: np.ndarray) -> None:
        k = self.near.shape[1]
        for b in range(0, len(v), max(SLICE, 2 * k)):  # not much less than what is kept, as that is gone through each time
            some, of = v[b : b + max(SLICE, 2 * k)], images[b : b + max(SLICE, 2 * k)]
            rows = max(1, MET // (k + len(some)))
            for a in range(0, len(self.v), rows):
                both = np.empty((len(self.v[a : a + rows]), k + len(some)))
                both[:, :k] = self.near[a : a + rows]
                d = np.matmul(self.v[a : a + rows], some.T, out=both[:, k:])
                np.subtract(1.0, d, out=d)
                d[self.images[a : a + rows, None] == of] = np.inf
                both.partition(k - 1, axis=1)
                self.near[a : a + rows] = both[:, :k]

    def rows(self) -> Iterator[pa.RecordBatch]:
        step = max(1, min(512, MET // self.near.shape[1]))
        for a in range(0, len(self.ids), step):
            near = np.sort(self.near[a : a + step], axis=1)
            near[np.arange(near.shape[1]) >= self.ks[a : a + step, None]] = np.inf
            known = np.isfinite(near)
            n = known.sum(axis=1)
            score = np.where(known, near, 0.0).sum(axis=1) / np.maximum(n, 1)
            ids = pa.array(self.ids[a : a + step], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(score)], names=["query_id", "score"]).filter(pa.array(n > 0))


def _stream(path: str, held: int) -> Callable:
    """Rows (of, place, id, image_id, k, v) in order of (of, place) to scores: as many blocks of a key as there is room for meet its bank together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        shelf, queries, of, count, most = None, [], None, 0, 1

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal shelf
            shelf = shelf or Shelf(path)
            block = _Held([i for q in queries for i in q[0]], *(np.concatenate([q[c] for q in queries]) for c in (1, 2, 3)))
            for keys, images, v in shelf.read(lambda least, greatest: least <= of <= greatest):
                a, b = np.searchsorted(keys, of, "left"), np.searchsorted(keys, of, "right")
                if a < b:
                    block.meet(images[a:b], v[a:b])
            yield from block.rows()

        for batch in batches:
            places = batch.column(1).to_numpy()
            for _, lo, hi in runs(places):
                for a in range(lo, hi, 256):
                    part = batch.slice(a, min(256, hi - a))
                    key, ks = part.column(0)[0].as_py(), part.column(4).to_numpy()
                    if queries and (key != of or count + len(ks) > TOGETHER or (count + len(ks)) * max(most, int(ks.max())) > held):
                        yield from answer()
                        queries, count, most = [], 0, 1
                    of, count, most = key, count + len(ks), max(most, int(ks.max()))
                    v = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(len(ks), -1).copy()
                    queries.append((part.column(2).to_pylist(), part.column(3).to_numpy(zero_copy_only=False), ks, v))
        if queries:
            yield from answer()

    return run


def streamed_blocks(query: DataFrame, by: str, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """(by, n_query, blocks): each key's queries in blocks whose nearest distances, at the key's largest k, are at most `held` numbers."""
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(held) / F.greatest(F.lit(1), F.max("k")))))
    return query.groupBy(by).agg(F.count("*").alias("n_query"), F.ceil(F.count("*") / size).cast("int").alias("blocks"))


def streamed_scores(query: DataFrame, bank: DataFrame, by: str, block: int = BLOCK) -> DataFrame:
    """(query_id, score): the mean distance of the k nearest bank rows of other images with an equal `by`; k is a column of the queries."""
    plan = kept(streamed_blocks(query, by, block), "blocks").select(by, "blocks")
    path = shelved(bank, F.xxhash64(by), "bank")
    q = query.join(plan, by).select(F.xxhash64(by).alias("of"), F.xxhash64(by, F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).alias("place"), F.col("query_id").cast("bigint").alias("id"), "image_id", F.col("k").cast("int").alias("k"), "v")
    parts = int(query.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return q.repartition(parts, "place").sortWithinPartitions("of", "place").mapInArrow(_stream(path, HELD), "query_id bigint, score double")


def loo_queries(patches: DataFrame, share: float = 0.001) -> DataFrame:
    """Every patch with k = max(1, int(share * bank)), its bank being all patches of the other images of its category."""
    own = patches.groupBy("category", "image_id").agg(F.count("*").alias("own"))
    total = own.groupBy("category").agg(F.sum("own").alias("total"))
    t = patches.join(own, ["category", "image_id"]).join(total, "category")
    return t.withColumn("k", F.greatest(F.lit(1), F.floor((F.col("total") - F.col("own")) * share).cast("int"))).drop("own", "total")


def tail_mean(scores: DataFrame, by: str, share: float = 0.01, column: str = "score") -> DataFrame:
    """(by, score): the mean of the top max(1, int(share * n)) scores of each group.

    Scores are counted per value first, so equal scores, such as a zero background, are one row.
    """
    t = scores.groupBy(by, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by)
    down = w.orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("k", F.greatest(F.lit(1), F.floor(F.sum("n").over(w) * share))).withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0)))
    t = t.withColumn("used", F.least("n", F.greatest(F.lit(0), F.col("k") - F.col("before"))))
    return t.groupBy(by).agg((F.sum(F.col(column) * F.col("used")) / F.sum("used")).alias("image_score"))
