"""What the corpus operators share: word splitting, hashing caches, range buckets and materialised cuts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A Python worker holds about one Arrow batch; rows are cut by bytes, since texts differ in length by orders.
BATCH_BYTES = 4 << 20
#: A key of more than this many rows, and of more than one in HOT_SHARE of all, is dealt to SALTS places.
LEAST_HOT, HOT_SHARE, SALTS = 500, 50_000, 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table_if_any(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """A table beside documents, or None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    found = bool(sf_dir) and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet") if found else None


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch, if it is above ours."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def split_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split() cuts at exactly these six characters."""
    return text.split()


def text_bytes(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Cached(dict):
    """A function of words with a bounded memory: it forgets everything at `bound` entries."""

    def __init__(self, function: Callable, bound: int = 1_000_000):
        super().__init__()
        self.function, self.bound = function, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        out = self[key] = self.function(key)
        return out


def give_back() -> None:
    """Return what this process has freed to the system: workers stay alive between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


_held: dict = {}


def held(key, make: Callable):
    """make(), once for each process: Python workers keep it from task to task, until they are asked for another key."""
    if key not in _held:
        if _held:  # a worker serves one operator after another; only the last one's memory stays
            _held.clear()
            give_back()
        _held[key] = make()
    return _held[key]


def word_hashes() -> Cached:
    """64-bit hashes of words, equal in every process."""
    return held("word hashes", lambda: Cached(lambda w: xxhash.xxh3_64_intdigest(w), 100_000))


def hash_array(words: list[bytes], cache: Cached) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of a sequence of word hashes, one for each start."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:m].copy()
        for k in range(1, n):
            out = mix(out * _ODD[0] + h[k : k + m] + np.uint64(k))
    return mix(out)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.mapInArrow(lean(function), schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its own; a cluster must name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="heliodor-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._heliodor_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by written() that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._heliodor_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """big joined with small on keys. small has one row a key, with the number `n` of big's rows that have it.

    Keys of more than one in HOT_SHARE of the rows are at most HOT_SHARE, whatever the data: they are broadcast, and
    their rows are dealt to SALTS places, each of which gets small's row. So no task gets more than a fixed share.
    """
    total, top = small.agg(F.sum(n), F.max(n)).head()
    limit = max(LEAST_HOT, (total or 0) // HOT_SHARE)
    if (top or 0) <= limit:  # no key is hot: there is nothing to deal out
        return big.join(small.hint("shuffle_hash"), keys, how)
    hot = F.col(n) > limit
    marked = big.join(F.broadcast(small.filter(hot).select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(SALTS)).cast("int")
    marked = marked.withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = small.withColumn("_salt", F.explode(copies))
    return marked.join(dealt.hint("shuffle_hash"), [*keys, "_salt"], how).drop("_salt")


def range_splits(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 increasing values that cut a bigint column into ranges of nearly equal counts.

    Its size is bounded by `parts`, whatever the rows; it only balances the work and never changes a result.
    """
    if parts <= 1:
        return []
    marks = [k / parts for k in range(1, parts)]
    got = df.agg(F.percentile_approx(column, marks, max(10_000, 10 * parts)).alias("p")).head()["p"]
    return sorted({int(x) for x in got or []})


def range_bucket(value: Column, splits: list[int]) -> Column:
    """How many splits are at most the value (null: 0), by binary search in one expression."""
    if not splits:
        return F.lit(0)
    table = F.array(*[F.lit(x).cast("bigint") for x in splits])
    steps, step = [], 1 << (len(splits).bit_length() - 1)
    while step:
        steps.append(F.lit(step))
        step >>= 1
    return F.coalesce(F.aggregate(F.array(*steps), F.lit(0), lambda at, s: F.when((at + s <= len(splits)) & (F.get(table, at + s - 1) <= value), at + s).otherwise(at)), F.lit(0))


def sums_before(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Adds, for each new name, the sum of a column over the rows before, in an order without ties; 0 in the first row.

    Rows are range-partitioned by the order and written; sums run inside a range, and start from the totals of the ranges
    before, of which there are as many as partitions.
    """
    t = written(df.repartitionByRange(parts_for(df), *order).withColumn("_range", F.spark_partition_id()), name)
    totals = t.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    outer = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(outer), F.lit(0)).alias(f"_{n}") for n in sums])
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.join(F.broadcast(totals), "_range")
    return t.withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()}).drop("_range", *[f"_{n}" for n in sums])


def parts_for(df: DataFrame, least: int = 1) -> int:
    """As many partitions as the session deals shuffles into."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
