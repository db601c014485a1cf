"""The neighbour index, blocks by key, keyed curves, and grids of different sizes, against plain versions."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliodor.functions import kernels as K
from heliodor.operators import curves, evaluate, index, knn, segment
from heliodor.plans.prefix import previous


def vectors(spark, n, centres, spread, seed, name):
    rng = np.random.default_rng(seed)
    heads = np.random.default_rng(5).normal(size=(centres, 16))
    v = heads[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1)[:, None] + 1e-8
    return v, spark.createDataFrame([(k, k // 20, v[k].tolist()) for k in range(n)], f"{name} bigint, image_id bigint, v array<double>")


def plain_nearest(q, b, k):
    return np.sort(1 - q @ b.T, axis=1)[:, :k]


@pytest.mark.parametrize(("spread", "share"), [(0.02, 0.3), (3.0, 1.0)])
def test_index_is_exact_and_skips_cells(spark, spread, share):
    """Clustered vectors need few of the pairs, unstructured ones all of them."""
    b, bank = vectors(spark, 900, 25, spread, 1, "bank_id")
    q, query = vectors(spark, 200, 25, spread, 2, "query_id")
    at = index.build(bank)
    found = {r["query_id"]: r for r in index.search(at, query, 4).collect()}
    want = plain_nearest(q, b, 4)
    assert len(found) == 200 and all(np.allclose(found[k]["near"], want[k], atol=1e-9) for k in found)
    assert sum(r["n_visited"] for r in found.values()) <= share * 200 * 900
    assert int(at.sizes.sum()) == 900 and at.rows.count() == 900


def test_index_bounds_hold():
    rng = np.random.default_rng(3)
    b = rng.normal(size=(400, 8))
    b /= np.linalg.norm(b, axis=1)[:, None]
    b[0] = 0
    c = index.fit(b, 12)
    cell = index.distances(b, c).argmin(axis=1)
    radii = np.array([index.distances(b[cell == k], c[k : k + 1]).max() if (cell == k).any() else 0 for k in range(12)])
    q = rng.normal(size=(50, 8))
    q /= np.linalg.norm(q, axis=1)[:, None]
    least, _ = index.lower_bounds(q, c, radii)
    d = 1 - q @ b.T
    assert all((d[:, cell == k].min(axis=1) >= least[:, k]).all() for k in range(12) if (cell == k).any())


def test_index_approximate_recall(spark):
    _, bank = vectors(spark, 800, 10, 0.5, 1, "bank_id")
    _, query = vectors(spark, 300, 10, 0.5, 2, "query_id")
    at = index.build(bank)
    exact = index.search(at, query, 5)
    probes = index.probes_for(at, query, 5, 0.9)
    got = index.recall(exact, index.search(at, query, 5, probes)).head()
    assert got["n_queries"] == 300 and got["recall"] >= 0.9 and got["visited_share"] <= 1
    assert 1 <= probes <= len(at.centroids)


def test_index_of_odd_banks(spark):
    empty = spark.createDataFrame([], "bank_id bigint, image_id bigint, v array<double>")
    assert index.build(empty) is None
    same = spark.createDataFrame([(k, 1, [1.0, 0.0]) for k in range(30)], "bank_id bigint, image_id bigint, v array<double>")
    query = spark.createDataFrame([(7, 2, [0.0, 1.0]), (8, 2, [1.0, 0.0])], "query_id bigint, image_id bigint, v array<double>")
    got = {r["query_id"]: r["near"] for r in index.search(index.build(same), query, 50).collect()}
    assert got == {7: [1.0] * 30, 8: [0.0] * 30}


def test_blocks_by_key_move_no_more_than_they_must(spark):
    """15 categories, one of which has most rows: each moves its own blocks times its own rows."""
    size = [2000 if c == 0 else 40 + c for c in range(15)]
    rows = [(c * 10_000 + k, c, k // 20, [1.0, float(k % 7)]) for c in range(15) for k in range(size[c])]
    t = spark.createDataFrame(rows, "id bigint, category int, image_id bigint, v array<double>")
    q, b = t.withColumnRenamed("id", "query_id"), t.filter("id % 2 = 0").withColumnRenamed("id", "bank_id")
    plan = knn.tiles(q, b, ("category",), 100)
    left, right = knn.with_tiles(q, b, plan, ("category",))
    up = lambda n: -(-n // 100)
    half = [-(-n // 2) for n in size]
    assert left.count() == sum(n * up(m) for n, m in zip(size, half, strict=True))
    assert right.count() == sum(m * up(n) for n, m in zip(size, half, strict=True))
    blocks = {r["category"]: r["blocks"] for r in knn.streamed_blocks(q.withColumn("k", F.lit(5)), "category", 100).collect()}
    assert blocks == {c: up(size[c]) for c in range(15)}


def test_previous_rows_of_keys(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{key}", float(x), float(rng.integers(100))) for key, n in (("a", 60), ("b", 1), ("c", 9)) for x in rng.permutation(n * 3)[:n]]
    t = spark.createDataFrame(rows, "name string, at double, value double")
    for down in (False, True):
        got = {(r["name"], r["at"]): r["before"] for r in previous(t, "at", {"before": "value"}, down, ("name",), parts=7).collect()}
        for name in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == name), key=lambda r: r[1], reverse=down)
            assert [got[r[0], r[1]] for r in own] == [None, *[r[2] for r in own[:-1]]]


def test_official_evaluation_of_each_experiment(spark):
    rng = np.random.default_rng(2)
    rows = []
    for e in ("x", "y", "no defect"):
        for image in range(6):
            truth = np.zeros((9, 9), int)
            if image % 2 and e != "no defect":
                truth[2:4, 2 : 3 + image] = 1
                truth[7, 7] = 1
            score = rng.integers(0, 40, (9, 9)) / 4 + 3 * truth * (e == "x")
            rows += [(e, image, y, x, float(score[y, x]), int(truth[y, x])) for y in range(9) for x in range(9)]
    t = spark.createDataFrame(rows, "experiment string, image_id bigint, y int, x int, score double, gt_mask int")
    got = {r["experiment"]: (r["au_pro"], r["auroc"]) for r in evaluate.run_experiments(t).collect()}
    assert got["no defect"] == (None, None)
    for e in ("x", "y"):
        alone = evaluate.official(t.filter(F.col("experiment") == e).drop("experiment")).head()
        assert np.allclose(got[e], (alone["au_pro"], alone["auroc"]))
    assert got["x"][0] > got["y"][0]


def test_areas_without_points(spark):
    t = spark.createDataFrame([], "k string, threshold double, fpr double, pro double")
    assert curves.trapezoid(t, "fpr", "pro", 0.3, keys=("k",)).collect() == []


def test_maps_are_brought_to_their_truths(spark):
    rng = np.random.default_rng(4)
    grids = {1: (4, 5, 9, 7), 2: (6, 6, 6, 6), 3: (3, 4, None, None), 4: (None, None, 5, 5)}
    maps, truth, want = [], [], {}
    for image, (h, w, th, tw) in grids.items():
        gt = rng.integers(0, 2, (th or h, tw or w)).astype(np.int32) if th else np.zeros((h, w), np.int32)
        truth += [(image, y, x, int(gt[y, x])) for y in range(gt.shape[0]) for x in range(gt.shape[1])] if th else []
        if h:
            score, fg = rng.normal(size=(h, w)), rng.integers(0, 2, (h, w)).astype(np.int32)
            maps += [(image, y, x, float(score[y, x]), int(fg[y, x])) for y in range(h) for x in range(w)]
            mask = segment.mask_of(score)
            want[image] = (gt, score, mask, fg) if score.shape == gt.shape else (gt, K.bilinear(score, *gt.shape), K.nearest(mask, *gt.shape), K.nearest(fg, *gt.shape))
    got = segment.on_truth(spark.createDataFrame(maps, "image_id bigint, y int, x int, score double, fg int"), spark.createDataFrame(truth, "image_id bigint, y int, x int, gt_mask int")).toPandas()
    assert set(got["image_id"]) == {1, 2, 3}
    for image, (gt, score, mask, fg) in want.items():
        t = got[got["image_id"] == image]
        for name, grid in (("gt_mask", gt), ("score", score), ("mask", mask), ("fg", fg)):
            out = np.zeros(grid.shape)
            out[t["y"], t["x"]] = t[name]
            assert len(t) == grid.size and np.allclose(out, grid)


def moved(spark, run) -> int:
    """MB that stages of run() shuffled, spilled and wrote."""
    def total() -> int:
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
        out = 0
        while found.hasNext():
            s = found.next()
            out += s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes()
        return out

    before = total()
    run()
    return (total() - before) / 1e6


def test_searches_do_not_move_rows_for_each_block_or_cell(spark):
    """2,000 vectors of 64 numbers, 1 MB: small blocks and visits of all cells."""
    v = np.random.default_rng(5).normal(size=(2000, 64))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    t = spark.createDataFrame([(i, i % 100, 0, 3, x.tolist()) for i, x in enumerate(v)], "query_id long, image_id long, category int, k int, v array<double>").repartition(4)
    b = t.withColumnRenamed("query_id", "bank_id")
    assert moved(spark, lambda: knn.streamed_scores(t, b, "category", 64).collect()) < 6
    assert moved(spark, lambda: index.search(index.build(b), t, 3).collect()) < 6


def test_memory_of_a_worker_that_holds_long_lists():
    """40 queries and their 100,000 nearest, 32 MB that are held: what meeting a bank and answering add is a few steps, not the lists once more."""
    rng = np.random.default_rng(6)
    k = np.full(40, 100_000)
    block = knn._Held(list(range(40)), np.arange(40), k, rng.normal(size=(40, 8)))
    bank = rng.normal(size=(4000, 8))
    tracemalloc.start()
    block.meet(np.full(4000, 99), bank)
    got = [r for batch in block.rows() for r in batch.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["query_id"] for r in got] == list(range(40))
    assert np.allclose([r["score"] for r in got], (1 - block.v @ bank.T).mean(axis=1))
    assert most < 20e6
