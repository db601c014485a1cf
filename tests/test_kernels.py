import numpy as np
import pytest
from pyspark.sql import functions as F

from heliodor.functions import kernels as K
from heliodor.operators import curves, grid, knn, results, segment
from heliodor.plans.prefix import running


def test_components_match_a_flood_fill():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = (rng.random((9, 11)) < 0.4).astype(int)
        lab, seen = K.label_components(mask), {}
        for y, x in zip(*np.nonzero(mask), strict=True):
            stack, part = [(y, x)], set()
            while stack:
                a, b = stack.pop()
                if (a, b) in part or not (0 <= a < 9 and 0 <= b < 11) or not mask[a, b]:
                    continue
                part.add((a, b))
                stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            seen[y, x] = min(a * 11 + b for a, b in part)
        assert all(lab[p] == v for p, v in seen.items())
        assert (lab[mask == 0] == -1).all()


def test_close_dilates_first_and_ignores_the_outside():
    m = np.zeros((9, 13), int)
    m[4, 4] = m[4, 8] = 1
    assert K.close(m, 3, 2)[4].tolist() == [0] * 4 + [1] * 5 + [0] * 4
    assert K.close(np.ones((3, 3), int)).all()
    assert K.opened(m).sum() == 0


def test_gaussian_keeps_constants_and_reflects():
    assert np.allclose(K.gaussian(np.full((6, 5), 3.0)), 3.0)
    assert K.reflect(np.array([-1, -2, 4, 5, 9]), 4).tolist() == [0, 1, 3, 2, 1]


def test_otsu_and_quantised():
    g = np.concatenate([np.full((4, 8), 1.0), np.full((4, 8), 9.0)])
    _, unit = K.standardised(g)
    levels = (unit * 255).astype(np.uint8)
    assert 0 <= K.otsu(levels) < 255
    assert ((levels > K.otsu(levels)) == (g > 5)).all()


def test_a_slender_part_makes_everything_foreground():
    g = np.random.default_rng(1).normal(0, 0.1, (20, 20))
    g[7:13, 2:18] += 5  # wide enough in x, too thin in y
    found = K.foreground_steps(g)
    assert found["span_x"] >= 0.35 > found["span_y"] and found["whole"] and found["mask"].all()
    g = np.random.default_rng(1).normal(0, 0.1, (20, 20))
    g[5:15, 5:15] += 5
    found = K.foreground_steps(g)
    assert not found["whole"] and found["mask"][5:15, 5:15].all() and found["mask"].sum() == 100


def test_quarter_turns():
    g = np.arange(25.0).reshape(5, 5)
    assert np.allclose(K.turn(g, 90), np.rot90(g)) and np.allclose(K.turn(g, 180), g[::-1, ::-1]) and (K.turn(g, 0) == g).all()
    with pytest.raises(ValueError):
        K.turn(g, 45, "wrap")


def test_two_normals_and_plane():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(10, 1, 100)])
    assert K.two_normals(x).sum() == 100
    y, x = np.mgrid[:6, :8]
    assert K.planar_ratio(2.0 * x + y) < 1e-6


def test_student_p():
    assert K.student_p(0.0, 5) == pytest.approx(1)
    assert K.student_p(2.144787, 14) == pytest.approx(0.05, abs=1e-5)
    assert np.isnan(K.student_p(1.0, 0))


def test_foreground_of_a_gradient_is_everything():
    y, x = np.mgrid[:12, :12]
    assert K.foreground(x.astype(float)).all()


def test_running_sums_over_ranges(spark):
    t = spark.range(500).select((F.col("id") % 97).cast("double").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    got = {r["s"]: r["c"] for r in running(t, "s", {"c": "n"}, parts=7).collect()}
    down = {r["s"]: r["c"] for r in running(t, "s", {"c": "n"}, descending=True, parts=7).collect()}
    values = [k % 97 for k in range(500)]
    assert got == {s: sum(v <= s for v in values) for s in got}
    assert down == {s: sum(v >= s for v in values) for s in got}


def test_auroc_extremes(spark):
    t = lambda rows: spark.createDataFrame(rows, "score double, label int")
    value = lambda rows: curves.auroc(t(rows)).head()[0]
    assert value([(1.0, 0), (2.0, 1), (3.0, 1)]) == 1.0
    assert value([(1.0, 0), (1.0, 1)]) == 0.5
    assert value([(1.0, 1), (2.0, 1)]) is None


def test_constant_scores_have_no_overlap_area(spark):
    t = spark.createDataFrame([(0, y, x, 5.0, int(y == 0)) for y in range(4) for x in range(4)], "image_id bigint, y int, x int, score double, gt_mask int")
    assert curves.au_pro_thresholds(t, segment.components(t)).head()[0] == 0.0


def test_blocks_do_not_change_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = spark.createDataFrame([(k, k // 5, v[k].tolist()) for k in range(60)], "query_id bigint, image_id bigint, v array<double>")
    b = q.withColumnRenamed("query_id", "bank_id")
    d = 1 - v @ v.T
    for k in range(60):
        d[k, k // 5 * 5 : k // 5 * 5 + 5] = np.inf
    want = np.sort(d, axis=1)[:, :3].mean(axis=1)
    for block in (7, 1000):
        got = {r["query_id"]: r["score"] for r in knn.nearest_scores(q, b, 3, leave_out=True, block=block).collect()}
        assert np.allclose([got[k] for k in range(60)], want)


def test_errors(spark):
    with pytest.raises(ValueError):
        segment.segment(None, "other")
    with pytest.raises(ValueError):
        curves.best_threshold(None, "other")


def test_nan_in_summary(spark):
    rows = [("a", "m", 1.0, float("nan"), 1.0, 1.0, 1.0, 1, 0, 0, 0), ("b", "m", 3.0, 2.0, 1.0, 1.0, float("nan"), 1, 0, 0, 0)]
    t = spark.createDataFrame(rows, "object_name string, method_name string, auroc double, aupro double, pixel_auroc double, pixel_f1 double, mean_iou double, tp bigint, fp bigint, fn bigint, tn bigint")
    assert results.summary(t).head()["mean_mean_iou"] == 1.0
    r = results.summary(t).head()
    assert (r["mean_auroc"], r["std_auroc"], r["mean_aupro"], r["total_tp"], r["n_objects"]) == (2.0, 1.0, 2.0, 2, 2)


def test_otsu_columns_match_the_kernel(spark):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 256, (8, 8)).astype(float)
    g[0, 0], g[0, 1] = 0, 255
    t = spark.createDataFrame([(0, y, x, float(g[y, x])) for y in range(8) for x in range(8)], "image_id bigint, y int, x int, score double")
    h = grid.level_histogram(t)
    levels = np.concatenate([np.full(r["n"], r["level"]) for r in h.collect()])
    assert grid.otsu_thresholds(h).head()["threshold"] == K.otsu(levels)
