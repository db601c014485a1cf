import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliodor.operators import detect, evaluate, knn
from heliodor.plans.config import RunConfig, read_settings
from heliodor.plans.prefix import previous
from heliodor.sources import catalog, records
from heliodor.streaming.scoring import score_stream


def test_config():
    c = RunConfig(known_objects=("a", "b")).with_values({"objects": ("a",), "neighbours": 1})
    assert c.neighbours == 1
    for bad in ({"integration_limit": 0}, {"objects": ("z",)}, {"segmentation": "x"}, {"other": 1}):
        with pytest.raises(ValueError):
            c.with_values(bad)


def test_tree(spark, tmp_path):
    for path in ("cup/train/good/000.png", "cup/test/crack/001.png", "cup/test/crack/notes.txt"):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    got = sorted(tuple(r) for r in catalog.read_tree(spark, str(tmp_path)).select("category", "split", "defect", "name", "label").collect())
    assert got == [("cup", "test", "crack", "001.png", 1), ("cup", "train", "good", "000.png", 0)]


METRICS = [m.split()[0] for m in records.METRICS.split(", ")]


def a_record(spark, name="a", method="m"):
    return spark.createDataFrame([(name, method, *[0.5] * 9, 1, 2, 3, 4)], f"object_name string, method_name string, {records.METRICS}")


def test_records_keep_their_values(spark, tmp_path):
    t = a_record(spark).unionByName(a_record(spark, "b"))
    maps = spark.createDataFrame([("a", "m", n, [float(n), 1.0]) for n in (0, 9, 10, 2)], "object_name string, method_name string, nth int, values array<double>")
    records.write_records(t, str(tmp_path / "r"), {"use_masking": True, "k_neighbors": 3}, 1600, maps)
    got = {r["object_name"]: r for r in records.read_records(spark, str(tmp_path / "r"), with_maps=True).collect()}
    assert got["a"]["metrics"]["cls_tn"] == 4 and got["a"]["config"]["k_neighbors"] == 3 and got["a"]["config"]["use_rotation"] is None and got["a"]["num_features"] == 1600
    assert [m["name"] for m in got["a"]["maps"]] == ["map_0", "map_2", "map_9", "map_10"] and got["a"]["maps"][3]["values"] == [10.0, 1.0]
    assert got["b"]["maps"] == []
    with pytest.raises(ValueError):
        records.write_records(t, str(tmp_path / "x"), {"other": 1})
    records.write_csv(t, str(tmp_path / "c"), ["auroc"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).head()["auroc"] == "0.5000"


def test_reports(spark, tmp_path):
    metrics = spark.createDataFrame([("b", 0.5, 1.0), ("a", 0.25, 0.5)], "object_name string, au_pro double, au_roc double")
    curves = spark.createDataFrame([("a", [0.0, 1.0], [0.5, 1.0]), ("b", [0.0], [1.0])], "object_name string, fpr array<double>, tpr array<double>")
    out = records.write_official(metrics, curves, str(tmp_path / "m"))
    again = json.loads(spark.read.text(str(tmp_path / "m")).head()[0])
    assert out == again and again["mean_au_pro"] == 0.375 and again["a"]["classification_roc_curve_tpr"] == [0.5, 1.0]
    run = records.write_run(spark.createDataFrame([(1, 0.5), (2, None)], "category int, auroc double"), str(tmp_path / "run"), "model", {"k": 1}, {"total": 2.0})
    assert json.loads(spark.read.text(str(tmp_path / "run")).head()[0]) == run and run["mean_AUROC"] == 0.5
    records.write_scores(spark.createDataFrame([(1, 7, 0.5), (2, 8, 0.25)], "category int, image_id int, image_score double"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2 and (tmp_path / "s" / "category=1").is_dir()


def test_settings_from_a_file(tmp_path):
    text = "# run\nobjects: [a, b]\nneighbours: 5\ntail_share: 0.05\ntest_mode: true\nsegmentation: 'gmm'  # normals\nmasking:\n  a: true\n  b: false\nshots:\n  - 1\n  - 4\n"
    path = tmp_path / "run.yaml"
    path.write_text(text)
    c = RunConfig(known_objects=("a", "b")).with_file(str(path))
    assert (c.objects, c.neighbours, c.tail_share, c.test_mode, c.segmentation, c.masking, c.shots) == (("a", "b"), 5, 0.05, True, "gmm", {"a": True, "b": False}, (1, 4))
    assert read_settings("a:\n  b:\n    c: 1\n  d: null\ne: x y\n") == {"a": {"b": {"c": 1}, "d": None}, "e": "x y"}
    with pytest.raises(ValueError):
        read_settings("no setting")


def test_one_file_for_each_stem(spark):
    files = spark.createDataFrame([("a",), ("b",), ("b",)], "stem string")
    stems = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    got = {r["stem"]: r["status"] for r in catalog.one_match(files, stems).collect()}
    assert got == {"a": "ok", "b": "ambiguous", "c": "missing"}
    assert catalog.one_match(files, stems.filter("stem = 'a'"), strict=True).count() == 1
    for bad in ("b", "c"):
        with pytest.raises(Exception, match=f"files for {bad}"):
            catalog.one_match(files, stems.filter(f"stem = '{bad}'"), strict=True).collect()


def test_a_data_set_is_unpacked_once(tmp_path):
    source = tmp_path / "cup" / "train"
    source.mkdir(parents=True)
    (source / "x.png").write_bytes(b"x")
    with tarfile.open(tmp_path / "set.tar.xz", "w:xz") as tar:
        tar.add(tmp_path / "cup", "cup")
    root = tmp_path / "data"
    with pytest.raises(FileNotFoundError):
        catalog.ensure_tree(str(root))
    assert catalog.ensure_tree(str(root), str(tmp_path / "set.tar.xz")) == str(root) and (root / "cup/train/x.png").exists()
    assert catalog.ensure_tree(str(root)) == str(root)
    (tmp_path / "broken.tar").write_bytes(b"no archive")
    with pytest.raises(tarfile.ReadError):
        catalog.ensure_tree(str(root), str(tmp_path / "broken.tar"), force=True)
    assert not root.exists()


def test_features_by_a_given_model(spark):
    images = spark.createDataFrame([("p", bytearray([1, 2, 3]))], "path string, content binary")
    got = detect.extract(images, lambda: lambda content: [[float(b), k] for k, b in enumerate([0] * 5 + list(content))]).orderBy("patch_id").collect()
    assert [list(r["embedding"]) for r in got] == [[1.0, 5.0], [2.0, 6.0], [3.0, 7.0]]


def test_undefined_metrics_of_runs(spark):
    """No defect: pixel metrics are undefined, image metrics too, and counts 0; one class of cells: pixel AUROC is undefined."""
    cells = [(i, y, x, float(i + y + x + 1), int(i == 5)) for i in (1, 2, 5, 6) for y in range(4) for x in range(4)]
    images = [(1, "none", 1.0, 0), (2, "none", 2.0, 0), (5, "all", 3.0, 1), (6, "all", 1.0, 0)]
    t = evaluate.evaluate(spark.createDataFrame(cells, "image_id bigint, y int, x int, score double, gt_mask int"), spark.createDataFrame(images, "image_id bigint, obj string, image_score double, label int"), spark.createDataFrame([], "image_id bigint, y int, x int, fg int"), ("obj",))
    got = {r["obj"]: r.asDict() for r in t.collect()}
    assert all(got["none"][m] is None for m in evaluate.METRICS) and all(got["none"][c] == 0 for c in evaluate.COUNTS)
    assert got["all"]["auroc"] == 1.0 and got["all"]["pixel_auroc"] is None and got["all"]["pixel_f1"] is None and got["all"]["mean_iou"] is not None
    assert sum(got["all"][c] for c in evaluate.COUNTS) == 2


def test_streamed_scores_with_many_neighbours(spark, monkeypatch):
    """More neighbours than a block holds, in small blocks and slices, against all distances."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(knn, "HELD", 200)
    rows = [(k, k // 10, k // 10 % 2, 1 + k % 40, v[k].tolist()) for k in range(120)]
    t = spark.createDataFrame(rows, "query_id bigint, image_id bigint, category int, k int, v array<double>")
    got = {r["query_id"]: r["score"] for r in knn.streamed_scores(t, t.withColumnRenamed("query_id", "bank_id"), "category").collect()}
    d = 1 - v @ v.T
    for k in range(120):
        near = sorted(d[k, j] for j in range(120) if j // 10 != k // 10 and j // 10 % 2 == k // 10 % 2)[: 1 + k % 40]
        assert abs(got[k] - np.mean(near)) < 1e-9


def test_previous_rows_of_an_order(spark):
    t = spark.range(1000).select(F.col("id").cast("double").alias("s"), (F.col("id") * 2).alias("v")).filter("id % 7 <> 0")
    for down in (False, True):
        got = {r["s"]: r["w"] for r in previous(t, "s", {"w": "v"}, descending=down, parts=9).collect()}
        order = sorted(got, reverse=down)
        assert got[order[0]] is None and all(got[b] == 2 * a for a, b in zip(order, order[1:]))


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    v = F.array((F.col("id") % 7).cast("double"), (F.col("id") % 3).cast("double"))
    bank = spark.range(20).select(F.col("id").alias("bank_id"), F.lit(0).cast("bigint").alias("image_id"), v.alias("v"))
    probes = spark.range(30).select(F.col("id").alias("query_id"), F.lit(1).cast("bigint").alias("image_id"), v.alias("v"))
    probes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(probes.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, bank, 2, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    from heliodor.operators.knn import nearest_scores

    got = {(r["query_id"], r["score"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["query_id"], r["score"]) for r in nearest_scores(probes, bank, 2).collect()}
