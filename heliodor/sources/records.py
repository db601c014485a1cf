"""Result records as files: JSON with a fixed schema and maps as Parquet, summaries as CSV at four places, run reports as JSON."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import shared_folder

METRICS = "auroc double, aupro double, pixel_auroc double, pixel_f1 double, mean_iou double, cls_accuracy double, cls_precision double, cls_recall double, cls_f1 double, cls_tp bigint, cls_fp bigint, cls_fn bigint, cls_tn bigint"
CONFIG = {"use_rotation": "boolean", "use_masking": "boolean", "k_neighbors": "bigint", "masking_method": "string", "segmentation_method": "string"}
RECORD = f"object_name string, method_name string, metrics struct<{METRICS.replace(' ', ':').replace(',:', ',')}>, config struct<{','.join(f'{n}:{t}' for n, t in CONFIG.items())}>, num_features bigint"


def folder(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    return f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"


def write_records(results: DataFrame, path: str, config: dict | None = None, num_features: int | None = None, maps: DataFrame | None = None) -> None:
    """results: (object_name, method_name, the metrics). maps: (object_name, method_name, nth, values); both are written if given."""
    unknown = set(config or {}) - set(CONFIG)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    names = [m.split()[0] for m in METRICS.split(", ")]
    t = results.select("object_name", "method_name", F.struct(*names).alias("metrics"), F.struct(*[F.lit((config or {}).get(n)).cast(kind).alias(n) for n, kind in CONFIG.items()]).alias("config"), F.lit(num_features).cast("bigint").alias("num_features"))
    t.write.partitionBy("object_name").json(f"{path}/records")
    if maps is not None:
        maps.select("object_name", "method_name", F.concat(F.lit("map_"), F.col("nth").cast("string")).alias("name"), "values").write.parquet(f"{path}/maps")


def read_records(spark: SparkSession, path: str, with_maps: bool = False) -> DataFrame:
    """The records; with their maps (name, values) in the order of the numbers in their names, none for a combination that has no maps.

    With maps, those of a combination are one row: for looking at a few. `read_maps` gives any number, a row each.
    """
    t = spark.read.schema(RECORD).json(f"{path}/records")
    if not with_maps:
        return t
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    maps = spark.read.parquet(f"{path}/maps").groupBy("object_name", "method_name").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), "name", "values"))).alias("maps"))
    return t.join(maps, ["object_name", "method_name"], "left").withColumn("maps", F.coalesce("maps", F.array().cast("array<struct<n:int,name:string,values:array<double>>>")))


def round_trip(results: DataFrame, maps: DataFrame, config: dict, num_features: int) -> DataFrame:
    path = folder(results.sparkSession)
    write_records(results, path, config, num_features, maps)
    return read_records(results.sparkSession, path, with_maps=True)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """(object_name, method_name, n, name, values): the maps beside the records, a row each, with the number in its name, by which a reader orders them."""
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    return spark.read.parquet(f"{path}/maps").select("object_name", "method_name", number.alias("n"), "name", "values")


def put(results: DataFrame, store: str, version: int) -> None:
    """Put records (object_name, method_name, ...) into a store, in place of older ones of the same object and method.

    A batch is written whole under its version and counts from the moment that its _SUCCESS is there; what a lost attempt left
    is not read, and putting a version again replaces it. Batches may come in any order: the highest version of a record
    wins. Nothing that is there is changed, so readers and writers do not meet.
    """
    results.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{store}/batch-{version:012d}")


def _batches(spark: SparkSession, store: str) -> list[str]:
    """The batches that are complete."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(store).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop(f"{store}/batch-*/_SUCCESS")) or []
    return sorted(str(f.getPath().getParent().toString()) for f in found)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The newest record of each object and method, with the union of all batches' columns; of several in one version the least by its content."""
    batches = _batches(spark, store)
    if not batches:
        raise FileNotFoundError(f"no complete batch in {store}")
    t = spark.read.option("mergeSchema", "true").parquet(*batches)
    row = F.struct(*[F.col(f"`{c}`") for c in t.columns])
    newest = F.min_by(row, F.struct((-F.col("version")).alias("v"), F.to_json(row).alias("j")))
    return t.groupBy("object_name", "method_name").agg(newest.alias("row")).select("row.*")


def compact(spark: SparkSession, store: str, version: int) -> None:
    """Put what is stored as one batch under a version above all others, and remove these when it is complete."""
    old = _batches(spark, store)
    if old and version <= max(int(b.rsplit("-", 1)[1]) for b in old):
        raise ValueError("the version must be above all that are stored")
    put(stored(spark, store).drop("version"), store, version)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for b in old:
        hadoop(b).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop(b), True)


def nested_json(results: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(object_name, record): the records of an object as JSON by method."""
    t = results.groupBy("object_name").agg(F.array_sort(F.collect_list(F.struct("method_name", F.struct(*columns).alias("record")))).alias("all"))
    return t.select("object_name", F.to_json(F.map_from_entries("all")).alias("record"))


def write_csv(t: DataFrame, path: str, numbers: list[str]) -> None:
    t.withColumns({c: F.format_string("%.4f", F.col(c)) for c in numbers}).write.option("header", "true").csv(path)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file by Spark's own file systems."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_official(metrics: DataFrame, curves: DataFrame, path: str) -> dict:
    """The official metrics as JSON: of each object the areas and the ROC curve, and the means over objects.

    metrics: (object_name, au_pro, au_roc); curves: (object_name, fpr, tpr) as arrays. A row for each object of the data set.
    """
    rows = metrics.join(curves, "object_name").orderBy("object_name").collect()
    out: dict = {r["object_name"]: {"au_pro": r["au_pro"], "classification_au_roc": r["au_roc"], "classification_roc_curve_fpr": list(r["fpr"]), "classification_roc_curve_tpr": list(r["tpr"])} for r in rows}
    mean = lambda c: sum(r[c] for r in rows) / len(rows) if rows else None
    out |= {"mean_au_pro": mean("au_pro"), "mean_classification_au_roc": mean("au_roc")}
    _write_text(metrics.sparkSession, path, json.dumps(out))
    return out


def stream_official(metrics: DataFrame, curves: DataFrame, path: str) -> None:
    """`write_official` for any number of objects and curves of any length: of each object the areas and the ROC curve, and the means over objects.

    metrics: (object_name, au_pro, au_roc); curves: (object_name, fpr, tpr) as arrays. Every object is a line that an executor
    makes and one task writes as it comes; the driver sees none of them. Undefined areas are null and not in the means.
    """
    fields = {"au_pro": "au_pro", "classification_au_roc": "au_roc", "classification_roc_curve_fpr": "fpr", "classification_roc_curve_tpr": "tpr"}
    one = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})
    name = F.expr("substring(to_json(named_struct('k', object_name)), 6)")  # as JSON text, with the closing brace
    lines = metrics.join(curves, "object_name").withColumns({"n": name, "one": one}).select("object_name", F.concat(F.expr("left(n, length(n) - 1)"), F.lit(":"), "one", F.lit(",")).alias("value"), F.lit(1).alias("part"))
    head = metrics.sparkSession.range(1).select(F.lit("").alias("object_name"), F.lit("{").alias("value"), F.lit(0).alias("part"))
    means = metrics.agg(F.avg("au_pro").alias("mean_au_pro"), F.avg("au_roc").alias("mean_classification_au_roc"))
    tail = means.select(F.lit("").alias("object_name"), F.expr("substring(to_json(struct(*), map('ignoreNullFields', 'false')), 2)").alias("value"), F.lit(2).alias("part"))
    text = head.unionByName(lines).unionByName(tail).repartition(1).sortWithinPartitions("part", "object_name")
    text.select("value").write.mode("overwrite").option("lineSep", " ").text(path)


def write_run(aurocs: DataFrame, path: str, model: str, config: dict, timing: dict | None = None) -> dict:
    """A run's AUROC of each category (category, auroc), their mean, its settings and timings as JSON."""
    found = {str(r["category"]): r["auroc"] for r in aurocs.orderBy("category").collect()}
    known = [v for v in found.values() if v is not None]
    out = {"AUROCs": found, "mean_AUROC": sum(known) / len(known) if known else None, "model_name": model, "config": config, "timing": timing or {}}
    _write_text(aurocs.sparkSession, path, json.dumps(out))
    return out


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores (category, image_id, image_score), a folder for each category."""
    scores.select("category", "image_id", "image_score").write.mode("overwrite").partitionBy("category").parquet(path)
