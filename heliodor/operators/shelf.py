"""A bank of vectors in the shared folder, in order of a key, that tasks read for themselves.

Where every query meets (nearly) the whole bank, moving a bank row to each block of queries makes shuffles that grow with the square of
the input. Here the bank is written once, and a task that holds a block of queries reads the row groups of its keys from the shared
folder, as a map-side join reads a table that is too large to broadcast. What is shuffled and written grows with the input; what
is read does not stay on any disk. A task holds one row group, ROW_GROUP bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import shared_folder
from ..sources.arrays import _system

ROW_GROUP = 4 << 20


def shelved(bank: DataFrame, key: Column, name: str, *more: str) -> str:
    """The folder of a table (key bigint, image_id, v, more) of all bank rows, in order of the key."""
    spark = bank.sparkSession
    t = bank.select(key.cast("bigint").alias("key"), F.col("image_id").cast("bigint").alias("image_id"), "v", *more)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = t.repartitionByRange(parts, "key", F.xxhash64("v")).sortWithinPartitions("key")  # a large key is dealt to several files
    t.write.option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", "false").parquet(path)
    return path


class Shelf:
    """A reader in a task."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.system, root = _system(path)
        files = [f.path for f in self.system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")]
        self.groups = []
        for path in sorted(files):
            with pq.ParquetFile(self.system.open_input_file(path)) as file:
                at = file.schema_arrow.names.index("key")
                for k in range(file.metadata.num_row_groups):
                    s = file.metadata.row_group(k).column(at).statistics
                    self.groups.append((path, k, *((s.min, s.max) if s is not None and s.has_min_max else (-(1 << 63), (1 << 63) - 1))))

    def read(self, wanted: Callable[[int, int], bool]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, images, vectors) of the row groups whose least and greatest key are wanted, rows in order of the key."""
        name, file = None, None
        for path, k, least, most in self.groups:
            if not wanted(least, most):
                continue
            if path != name:
                if file:
                    file.close()
                name, file = path, pq.ParquetFile(self.system.open_input_file(path))
            t = file.read_row_group(k, columns=["key", "image_id", "v"], use_threads=False)
            keys, images, v = (t.column(c).combine_chunks() for c in ("key", "image_id", "v"))
            yield keys.to_numpy(), images.to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        if file:
            file.close()


def runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of the runs of equal keys."""
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield int(keys[a]), a, b
