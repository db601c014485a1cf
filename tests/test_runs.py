"""Array files, cells that fail, timings of runs and image preparation, against plain versions."""

import json
import struct
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from heliodor.functions import kernels as K
from heliodor.operators import evaluate, grid, guard, segment
from heliodor.plans.config import read_settings
from heliodor.plans.union import union_labels
from heliodor.sources import arrays, records


def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def test_array_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {f"map_{k}": rng.normal(size=(k + 1, 7)) for k in range(9)}
    t = spark.createDataFrame([(n, list(a.shape), a.ravel().tolist()) for n, a in made.items()], "name string, shape array<int>, values array<double>").repartition(3)
    for kind, suffix in (("npy", "npy"), ("tiff", "tif")):
        at = folder(tmp_path)
        arrays.write_arrays(t, at, kind)
        arrays.write_arrays(t, at, kind)  # again: the same files
        got = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in arrays.read_arrays(spark, at).collect()}
        assert got.keys() == made.keys() and all((got[n] == made[n]).all() for n in made)
        assert sorted(p.name for p in Path(at[7:]).iterdir() if p.name[0] != ".") == sorted(f"{n}.{suffix}" for n in made)
        assert arrays.read_arrays(spark, at).rdd.getNumPartitions() == len(made)
        if kind == "npy":
            assert all((np.load(f"{at[7:]}/{n}.npy") == a).all() for n, a in made.items())


def test_files_of_numpy_and_other_writers(spark, tmp_path):
    a, b = np.arange(12, dtype=np.int16).reshape(3, 4), np.linspace(0, 1, 5, dtype=np.float32)
    np.savez(tmp_path / "both.npz", first=a, second=b)
    big = a.astype(">u2")
    entries = [(256, 3, 4), (257, 3, 3), (258, 3, 16), (259, 3, 1), (277, 3, 1)]
    strips = struct.pack(">2I", 8, 8 + 16), struct.pack(">2I", 16, 8)  # two strips, the offsets behind the pixels
    head = struct.pack(">2sHI", b"MM", 42, 8 + 24 + 16)
    table = struct.pack(">H", 7) + b"".join(struct.pack(">HHIHH", tag, kind, 1, value, 0) for tag, kind, value in entries) + struct.pack(">HHII", 273, 4, 2, 32) + struct.pack(">HHII", 279, 4, 2, 40) + struct.pack(">I", 0)
    (tmp_path / "big.tiff").write_bytes(head + big.tobytes() + strips[0] + strips[1] + table)
    (tmp_path / "notes.txt").write_text("no array")
    got = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in arrays.read_arrays(spark, f"file://{tmp_path}").collect()}
    assert got.keys() == {"both/first", "both/second", "big"}
    assert (got["both/first"] == a).all() and np.allclose(got["both/second"], b) and (got["big"] == a).all()
    assert arrays.tiff_array(arrays.tiff_bytes(b[None])).dtype == np.float32
    for bad in (b"no", arrays.tiff_bytes(b[None])[:4] + b"\xff\xff\0\0"):
        with pytest.raises((ValueError, struct.error)):
            arrays.tiff_array(bad)


def test_stems_must_be_one_file(spark, tmp_path):
    at = folder(tmp_path)
    rows = [("a", [1], [1.0]), ("b", [1], [2.0])]
    make = lambda rows: spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").repartition(2)
    arrays.write_arrays(make(rows), at)
    arrays.write_arrays(make([("b", [1, 1], [3.0])]), at, "tiff")
    wanted = lambda *stems: spark.createDataFrame([(x,) for x in stems], "stem string")
    assert [r["values"] for r in arrays.read_matching(spark, at, wanted("a")).collect()] == [[1.0]]
    for stems in (("a", "b"), ("c",)):
        with pytest.raises(PySparkException):
            arrays.read_matching(spark, at, wanted(*stems)).collect()
    with pytest.raises(PySparkException):  # a name that comes twice leaves what was there
        arrays.write_arrays(make([("a", [1], [5.0]), ("x", [1], [5.0]), ("x", [1], [6.0])]), at)
    with pytest.raises(PySparkException):
        arrays.write_arrays(make([("../a", [1], [5.0])]), at)
    with pytest.raises(PySparkException):
        arrays.write_arrays(make([("a", [2], [5.0])]), at)
    left = {r["path"].rsplit("/", 1)[1]: r["values"] for r in arrays.read_arrays(spark, at).collect()}
    assert left == {"a.npy": [1.0], "b.npy": [2.0], "b.tif": [3.0]}
    assert not [p for p in Path(at[7:]).iterdir() if p.name.startswith("_arrays")]


def test_a_group_that_raises_is_a_row(spark):
    t = spark.createDataFrame([(k, float(x)) for k in range(6) for x in range(k)], "image_id bigint, v double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 3:
            raise ZeroDivisionError("three")
        return pdf.assign(twice=2 * pdf["v"])[["image_id", "twice"]].iloc[: 0 if len(pdf) == 2 else None]

    done, errors = guard.split(guard.guarded(t, "image_id", run, "image_id bigint, twice double"), "guarded", "twice")
    assert [tuple(r)[:1] + (r["error"],) for r in errors.collect()] == [(3, "ZeroDivisionError: three")]
    assert sorted((r["image_id"], r["twice"]) for r in done.collect()) == sorted((k, 2.0 * x) for k in (1, 4, 5) for x in range(k))
    times = guard.guarded(t, "image_id", run, "image_id bigint, twice double").groupBy("image_id").agg(F.sum("seconds").alias("s"), F.count("seconds").alias("n")).collect()
    assert all(r["s"] > 0 and r["n"] == 1 for r in times) and len(times) == 5


def small_run(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(image * 6 + p, image, p // 3, p % 3, image % 3, rng.normal(size=8).tolist(), int(image > 8 and p == 1)) for image in range(15) for p in range(6)]
    t = spark.createDataFrame(rows, "vec_id bigint, image_id bigint, gy int, gx int, category int, embedding array<double>, gt_mask int")
    return t, t.groupBy("image_id", "category").agg(F.max("gt_mask").alias("label"))


def test_one_bad_object_spares_the_others(spark):
    t, images = small_run(spark)
    want = {(r["category"], r["method_name"]): r.asDict() for r in evaluate.run_few_shot(t, images, (1, 2)).collect()}
    bad = t.withColumn("embedding", F.when(F.col("image_id") == 4, F.lit(None)).otherwise(F.col("embedding")))
    metrics, errors = evaluate.run_grid(bad, images, (1, 2))
    got = {(r["category"], r["method_name"]): r.asDict() for r in metrics.collect()}
    assert got == {k: v for k, v in want.items() if k[0] != 1} and len(got) == 4
    assert sorted((r["category"], r["method_name"], r["stage"], r["error"], r["n_images"]) for r in errors.collect()) == [(1, f"{k}_shot", "patches", "ValueError: patches without vectors", 1) for k in (1, 2)]
    metrics, errors = evaluate.run_grid(t, images, (1, 2))
    assert errors.count() == 0 and {(r["category"], r["method_name"]): r.asDict() for r in metrics.collect()} == want


def test_timings_of_a_run_add_up(spark):
    t, images = small_run(spark)
    aurocs, timings = evaluate.run_timed(t, images, 2)
    table = evaluate.timing_table(timings).toPandas()
    driver = table[table["clock"] == "driver"].set_index("stage")["seconds"]
    assert 0 < driver.drop("total").sum() <= driver["total"]
    workers = table[table["clock"] == "workers"]
    assert set(workers["stage"]) == {"masks", "distances"} and (workers["seconds"] > 0).all()
    assert np.allclose(workers.groupby("category")["percent"].sum(), 100)
    plain = evaluate.run_few_shot(t, images, (2,))
    assert {r["category"]: r["auroc"] for r in aurocs.collect()} == {r["category"]: r["auroc"] for r in plain.collect()}


def test_cubic_resampling():
    rng = np.random.default_rng(2)
    g = rng.normal(size=(17, 23))
    assert np.allclose(K.bicubic(g, 17, 23), g)  # the same size changes nothing
    ramp = np.add.outer(np.arange(40.0), 2 * np.arange(50.0))
    out = K.bicubic(ramp, 10, 25)
    assert np.allclose(out[2:-2, 2:-2], np.add.outer((np.arange(10) + 0.5) * 4 - 0.5, 2 * ((np.arange(25) + 0.5) * 2 - 0.5))[2:-2, 2:-2])
    assert np.allclose(K.resampling(5, 31).sum(axis=1), 1) and K.resampling(8, 4).min() < 0
    assert K.prepared(np.full((30, 60), 255.0), 16, 4, 0.5, 0.25).shape == (16, 32) and np.allclose(K.prepared(np.full((30, 60), 255.0), 16, 4, 0.5, 0.25), 2.0)


def test_images_are_cut_into_patches(spark):
    rng = np.random.default_rng(3)
    sizes = {1: (12, 20), 2: (20, 12), 3: (3, 40)}
    pixels = {k: rng.integers(0, 256, s) for k, s in sizes.items()}
    rows = [(k, y, x, float(v[y, x])) for k, v in pixels.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    t = spark.createDataFrame(rows, "image_id bigint, y int, x int, grey double")
    got = grid.image_patches(t, 8, 4, {"grey": (0.5, 0.2)}).toPandas()
    for k, v in pixels.items():
        want, own = K.prepared(v, 8, 4, 0.5, 0.2), got[got["image_id"] == k]
        out = np.zeros(want.shape)
        columns = want.shape[1] // 4
        out[own["patch_id"] // columns * 4 + own["y"], own["patch_id"] % columns * 4 + own["x"]] = own["grey"]
        assert len(own) == want.size and np.allclose(out, want) and set(own["grid_w"]) == {columns}


@pytest.mark.parametrize("tile", [1, 2, 3, 7, 100])
def test_tiles_give_the_regions_of_whole_images(spark, tile):
    rng = np.random.default_rng(6)
    made = {k: (rng.random(size) < share).astype(int) for k, (size, share) in enumerate([((17, 23), 0.4), ((9, 9), 0.6), ((20, 5), 0.3), ((6, 6), 0.0), ((11, 31), 1.0)])}
    snake = np.zeros((15, 15), int)
    snake[::2] = 1
    snake[1::4, -1] = snake[3::4, 0] = 1
    made[9] = snake
    rows = [(k, y, x, int(g[y, x])) for k, g in made.items() for y in range(g.shape[0]) for x in range(g.shape[1])]
    t = spark.createDataFrame(rows, "image_id bigint, y int, x int, gt_mask int").repartition(4)
    want = {tuple(r) for r in segment.components(t).collect()}
    assert {tuple(r) for r in segment.tiled_components(t, "gt_mask", tile).collect()} == want


def test_union_of_labels(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, 301 + k) for k in range(40)] + [(5, 5)]
    name = {x: x for e in edges for x in e}
    for _ in name:
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    got = {r["name"]: r["label"] for r in union_labels(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(k, k) == v for k, v in name.items())
    assert union_labels(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_record_store(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame([(*r, r[2] * 2) for r in rows], "object_name string, method_name string, auroc double, aupro double")
    first, second, third = make(("a", "m", 0.1), ("b", "m", 0.2)), make(("a", "m", 0.3), ("a", "n", 0.4)), make(("c", "m", 0.5))
    want = {("a", "m"): 0.3, ("a", "n"): 0.4, ("b", "m"): 0.2, ("c", "m"): 0.5}
    read = lambda at: {(r["object_name"], r["method_name"]): r["auroc"] for r in records.stored(spark, at).collect()}
    for k, order in enumerate([((first, 1), (second, 2), (third, 3)), ((third, 3), (second, 2), (first, 1), (second, 2))]):
        at = str(tmp_path / f"store{k}")
        with pytest.raises(FileNotFoundError):
            records.stored(spark, at)
        for t, version in order:
            records.put(t, at, version)
        assert read(at) == want
        lost = tmp_path / f"store{k}" / "batch-000000000009"  # what a lost attempt left
        records.put(make(("a", "m", 9.0)), at, 9)
        (lost / "_SUCCESS").unlink()
        assert read(at) == want
        with pytest.raises(ValueError):
            records.compact(spark, at, 3)
        records.compact(spark, at, 10)
        assert read(at) == want and {p.name for p in (tmp_path / f"store{k}").iterdir()} == {"batch-000000000009", "batch-000000000010"}


def test_official_metrics_are_streamed(spark, tmp_path):
    rows = [("b", 0.5, 1.0), ('a "quoted"', 0.25, None), ("c", None, 0.5)]
    metrics = spark.createDataFrame(rows, "object_name string, au_pro double, au_roc double")
    curves_ = spark.createDataFrame([(r[0], [0.0, 1.0], [0.5, 1.0]) for r in rows], "object_name string, fpr array<double>, tpr array<double>")
    records.stream_official(metrics, curves_, str(tmp_path / "m"))
    got = json.loads("".join(r[0] for r in spark.read.text(str(tmp_path / "m")).collect()))
    assert got == {name: {"au_pro": a, "classification_au_roc": b, "classification_roc_curve_fpr": [0.0, 1.0], "classification_roc_curve_tpr": [0.5, 1.0]} for name, a, b in rows} | {"mean_au_pro": 0.375, "mean_classification_au_roc": 0.75}


def test_settings_are_read_or_refused():
    text = "a: 'x # y'  # a comment\nb: \"it's: [1, 2]\"\nlist: ['p, q', 2, \"#3\"]\nurl: http://host/x#part\nmap:\n  k: v#w\n  'q: r': don't\nitems:\n  - one # first\n  - '- two'\n"
    assert read_settings(text) == {"a": "x # y", "b": "it's: [1, 2]", "list": ["p, q", 2, "#3"], "url": "http://host/x#part", "map": {"k": "v#w", "q: r": "don't"}, "items": ["one", "- two"]}
    for bad in ("a: {b: 1}", "a: &x 1", "a: *x", "a: |\n  text", "a:\n\tb: 1", "a: [1, [2]]", "a: [1,\n  2]", "a:\n  - b: 1", "a:\n  - - 1", "- 1", "a: 'x", "a: 1\na: 2", "a: !!int 3"):
        with pytest.raises(ValueError):
            read_settings(bad)


def test_many_array_files_are_few_partitions(tmp_path):
    for k in range(700):
        np.save(tmp_path / f"map_{k}.npy", np.full((2, 3), k))
    found = arrays.ArrayReader({"path": str(tmp_path)}).partitions()
    paths = [p for part in found for p in part.paths]
    assert len(found) < 100 and len(set(paths)) == len(paths) == 700
    rows = [r for part in found for b in arrays.ArrayReader({"path": str(tmp_path)}).read(part) for r in b.to_pylist()]
    assert len(rows) == 700 and all(r["shape"] == [2, 3] and r["values"] == [float(r["name"][4:])] * 6 for r in rows)


def test_small_tiles_share_groups(spark, monkeypatch):
    monkeypatch.setattr(segment, "GROUP", 12)  # groups of 2 x 2 tiles, of which some are at the far ends
    cells = [(i, y, x, int((y * 7 + x * 5 + i * y * x) % 3 > 0)) for i in range(3) for y in range(29) for x in range(31)]
    t = spark.createDataFrame(cells, "image_id long, y int, x int, gt_mask int")
    assert sorted(segment.tiled_components(t, tile=6).collect()) == sorted(segment.components(t).collect())
