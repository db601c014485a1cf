"""The input tables re-read as the engine's abstractions: patches, score grids, image scores, results, catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATCHES_PER_IMAGE, PATCH_COLS, GRID = 20, 5, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, image_id, patch_id, gy, gx, grid_h, grid_w, category, label, embedding); the last image may lack patches of its grid."""
    t = table(spark, sf_dir, "embeddings")
    t = t.withColumns({"image_id": F.expr(f"vec_id div {PATCHES_PER_IMAGE}"), "patch_id": F.expr(f"cast(vec_id % {PATCHES_PER_IMAGE} as int)")})
    return t.select("vec_id", "image_id", "patch_id", F.expr(f"patch_id div {PATCH_COLS}").cast("int").alias("gy"), F.expr(f"patch_id % {PATCH_COLS}").alias("gx"), F.lit(PATCHES_PER_IMAGE // PATCH_COLS).alias("grid_h"), F.lit(PATCH_COLS).alias("grid_w"), F.expr("cast(image_id % 5 as int)").alias("category"), "label", "embedding")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, score, gt_mask) of whole GRID x GRID images; events beyond the last whole image are not an image."""
    cells = GRID * GRID
    t = table(spark, sf_dir, "events").select(F.expr(f"event_id div {cells}").alias("image_id"), F.expr(f"cast((event_id % {cells}) div {GRID} as int)").alias("y"), F.expr(f"cast(event_id % {GRID} as int)").alias("x"), F.col("value").alias("score"), "event_type")
    t = t.withColumn("gt_mask", F.expr("cast(event_type = 'error' and image_id % 3 <> 0 as int)")).drop("event_type")
    return t.withColumn("n", F.count("*").over(Window.partitionBy("image_id"))).filter(F.col("n") == cells).drop("n")


def image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, score, label)."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("image_id"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_name, method_name, metrics, tp, fp, fn, tn): a row for each object and method; some metrics are NaN."""
    t = table(spark, sf_dir, "customer")
    flag = lambda cond: F.sum(F.expr(f"cast({cond} as bigint)"))
    return t.groupBy(F.concat(F.lit("obj"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("object_name"), F.col("c_mktsegment").alias("method_name")).agg(
        F.avg("c_acctbal").alias("auroc"), F.expr("if(count(*) % 7 = 0, double('nan'), max(c_acctbal))").alias("aupro"),
        F.min("c_acctbal").alias("pixel_auroc"), F.avg(F.expr("c_custkey % 100 / 100")).alias("pixel_f1"), F.expr("if(count(*) % 5 = 0, double('nan'), avg(c_custkey % 10))").alias("mean_iou"),
        flag("c_acctbal >= 5000 and c_custkey % 2 = 1").alias("tp"), flag("c_acctbal >= 5000 and c_custkey % 2 = 0").alias("fp"),
        flag("c_acctbal < 5000 and c_custkey % 2 = 1").alias("fn"), flag("c_acctbal < 5000 and c_custkey % 2 = 0").alias("tn"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, category, split, defect, name, label): a dataset tree, its label in the path."""
    t = table(spark, sf_dir, "documents").withColumns({"source": F.coalesce("source", F.lit("unnamed")), "lang": F.coalesce("lang", F.lit("unknown"))})
    t = t.withColumns({"split": F.expr("if(lang = 'en' and doc_id % 2 = 0, 'train', 'test')"), "defect": F.expr("if(lang = 'en', 'good', lang)"), "ext": F.expr("case doc_id % 4 when 0 then '.png' when 1 then '.PNG' when 2 then '.jpg' else '.txt' end")})
    t = t.withColumn("name", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), "ext"))
    t = t.withColumn("path", F.concat_ws("/", "source", "split", "defect", "name"))
    parts = F.split("path", "/")
    return t.select("path", parts[0].alias("category"), parts[1].alias("split"), parts[2].alias("defect"), parts[3].alias("name"), F.expr("cast(split(path, '/')[2] <> 'good' as int)").alias("label"))


#: The same abstractions for DuckDB, as common table expressions.
SQL = {
    "patches": f"patches AS (SELECT vec_id, vec_id // {PATCHES_PER_IMAGE} AS image_id, (vec_id % {PATCHES_PER_IMAGE})::INT AS patch_id, ((vec_id % {PATCHES_PER_IMAGE}) // {PATCH_COLS})::INT AS gy, ((vec_id % {PATCHES_PER_IMAGE}) % {PATCH_COLS})::INT AS gx, ((vec_id // {PATCHES_PER_IMAGE}) % 5)::INT AS category, label, embedding FROM embeddings)",
    "pixels": f"pixels AS (SELECT image_id, y, x, score, (event_type = 'error' AND image_id % 3 <> 0)::INT AS gt_mask FROM (SELECT event_id // {GRID * GRID} AS image_id, ((event_id % {GRID * GRID}) // {GRID})::INT AS y, (event_id % {GRID})::INT AS x, value AS score, event_type FROM events) QUALIFY count(*) OVER (PARTITION BY image_id) = {GRID * GRID})",
    "scores": "scores AS (SELECT doc_id AS image_id, n_chars::DOUBLE AS score, toxic AS label FROM labels JOIN documents USING (doc_id))",
    "results": "results AS (SELECT 'obj' || lpad(c_nationkey::VARCHAR, 2, '0') AS object_name, c_mktsegment AS method_name, avg(c_acctbal) AS auroc, CASE WHEN count(*) % 7 = 0 THEN 'nan'::DOUBLE ELSE max(c_acctbal) END AS aupro, min(c_acctbal) AS pixel_auroc, avg((c_custkey % 100) / 100) AS pixel_f1, CASE WHEN count(*) % 5 = 0 THEN 'nan'::DOUBLE ELSE avg(c_custkey % 10) END AS mean_iou, sum((c_acctbal >= 5000 AND c_custkey % 2 = 1)::BIGINT)::BIGINT AS tp, sum((c_acctbal >= 5000 AND c_custkey % 2 = 0)::BIGINT)::BIGINT AS fp, sum((c_acctbal < 5000 AND c_custkey % 2 = 1)::BIGINT)::BIGINT AS fn, sum((c_acctbal < 5000 AND c_custkey % 2 = 0)::BIGINT)::BIGINT AS tn FROM customer GROUP BY 1, 2)",
    "catalog": "catalog AS (SELECT source || '/' || split || '/' || defect || '/' || name AS path, source AS category, split, defect, name, (defect <> 'good')::INT AS label FROM (SELECT *, CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, CASE WHEN lang = 'en' THEN 'good' ELSE lang END AS defect, lpad(doc_id::VARCHAR, 8, '0') || CASE doc_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' ELSE '.txt' END AS name FROM (SELECT doc_id, coalesce(source, 'unnamed') AS source, coalesce(lang, 'unknown') AS lang FROM documents)))",
}


def with_tables(sql: str, *names: str) -> str:
    """The query with the named abstractions in front."""
    return "WITH " + ", ".join(SQL[n] for n in names) + sql
