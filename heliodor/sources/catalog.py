"""Dataset trees: scans, samples, mask location and pairing. Labels are encoded in paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg")


def read_tree(spark: SparkSession, root: str, glob: str = "*.png") -> DataFrame:
    """A directory tree <root>/<category>/<split>/<defect>/<file> as rows, with the files' bytes."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)/([^/]+)$", k)
    return t.select("path", part(1).alias("category"), part(2).alias("split"), part(3).alias("defect"), part(4).alias("name"), (part(3) != "good").cast("int").alias("label"), "content")


def with_suffix(files: DataFrame, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, any_case: bool = False) -> DataFrame:
    name = F.lower("name") if any_case else F.col("name")
    return files.filter(F.regexp_extract(name, r"(\.[^.]+)$", 1).isin(*suffixes))


def few_shot_references(files: DataFrame, shots: int) -> DataFrame:
    """The first `shots` training files of each category by name."""
    order = Window.partitionBy("category").orderBy("name")
    return files.filter("split = 'train'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= shots)


def sample_per_category(files: DataFrame, categories: list[str] | None, split: str, per_category: int | None, label_filter: str = "all", seed: int = 42) -> DataFrame:
    """A seeded sample of at most per_category files of each category, in order of (defect, hash of seed and name); None: all files that the filters leave, without ranks."""
    t = files.filter(F.col("split") == split)
    if categories:
        t = t.filter(F.col("category").isin(*categories))
    if label_filter != "all":
        t = t.filter(F.col("label") == (1 if label_filter == "anomalous" else 0))
    if split == "train" and label_filter == "anomalous":
        t = t.filter("false")
    if per_category is None:
        return t
    order = Window.partitionBy("category").orderBy("defect", F.md5(F.concat(F.lit(f"{seed}/"), "name")), "name")
    return t.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_category)


def locate_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Each image with its mask, by (category, defect, stem); a good image or a missing mask is all zero."""
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    m = masks.withColumn("stem", F.regexp_replace("name", r"_mask\.[^.]+$", "")).select("category", "defect", "stem", "mask_area")
    return images.withColumn("stem", stem).join(m, ["category", "defect", "stem"], "left").withColumn("mask_area", F.when(F.col("label") == 0, 0).otherwise(F.coalesce("mask_area", F.lit(0))))


def few_shot_dataset(files: DataFrame, masks: DataFrame, shots: int) -> DataFrame:
    """(category, role, path, label, mask_area): the first `shots` training files as references, and all test files with labels and masks."""
    refs = few_shot_references(with_suffix(files), shots).select("category", F.lit("reference").alias("role"), "path", F.lit(0).alias("label"), F.lit(0).alias("mask_area"))
    test = locate_masks(with_suffix(files).filter("split = 'test'"), masks)
    return refs.unionByName(test.select("category", F.lit("test").alias("role"), "path", "label", F.col("mask_area").cast("int").alias("mask_area")))


def one_match(files: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """(stem, matches, status) of the wanted stems: each must match exactly one of files (stem); strict raises an error at one that does not."""
    t = wanted.join(files.groupBy("stem").agg(F.count("*").alias("matches")), "stem", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    status = F.when(F.col("matches") == 1, "ok").when(F.col("matches") == 0, "missing").otherwise("ambiguous")
    if strict:
        status = F.when(F.col("matches") == 1, "ok").otherwise(F.raise_error(F.format_string("%s files for %s", F.col("matches"), F.col("stem"))))
    return t.withColumn("status", status)


def ensure_tree(root: str, archive: str | None = None, force: bool = False) -> str:
    """The folder of a data set on the driver; where it is missing (or with force), it is unpacked from a local archive, and removed if that fails."""
    import shutil
    import tarfile
    from pathlib import Path

    at = Path(root)
    if at.is_dir() and any(at.iterdir()) and not force:
        return root
    if archive is None:
        raise FileNotFoundError(f"no data set at {root} and no archive to unpack")
    if at.exists():
        shutil.rmtree(at)
    try:
        at.mkdir(parents=True)
        with tarfile.open(archive) as tar:
            tar.extractall(at, filter="data")
    except BaseException:
        shutil.rmtree(at, ignore_errors=True)
        raise
    return root


def evaluation_pairs(files: DataFrame, predictions: DataFrame) -> DataFrame:
    """Test images with the path of their ground truth (null if good) and of their prediction, of alphabetic sub-directories only."""
    t = files.filter("split = 'test'").filter(F.regexp_replace("defect", "_", "").rlike("^[A-Za-z]+$"))
    truth = F.when(F.col("defect") != "good", F.concat_ws("/", "category", F.lit("ground_truth"), "defect", F.regexp_replace("name", r"\.[^.]+$", "_mask.png")))
    return t.withColumn("gt_path", truth).join(predictions, ["category", "defect", "name"], "left")
