"""Array files as tables: a Python data source for .npy, .npz and .tif(f), a partition for some files each, and a writer that can be repeated.

    register(spark)
    spark.read.format("arrays").load(folder)                     # (path, name, shape, values)
    t.write.format("arrays").option("kind", "tiff").mode("append").save(folder)   # t: (name, shape, values)

Reading walks a folder (any file system that pyarrow knows by its address), and reads files of together FILES_BYTES, or FILES of them, a
partition, so a lost task reads these again and nothing else. A row is an array: values in row order as doubles, with its shape. An .npz gives a row for each
member, named <file>/<member>.

Writing gives a file for each row, <name>.npy or <name>.tif. A task writes under _arrays-<attempt>/ and commits nothing; when all
tasks are through, the driver checks that no name came twice, and moves the files into place over files of the same
name. So a lost or repeated attempt leaves no half file and no second one, and writing the same rows again gives the same folder.

TIFF: one page, not compressed, one or more samples a pixel, integers or floats of 8 to 64 bits in either byte order; others
raise. Written as 32- or 64-bit floats in one strip.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .catalog import one_match

SCHEMA = "path string, name string, shape array<int>, values array<double>"
SUFFIXES = (".npy", ".npz", ".tif", ".tiff")
FILES, FILES_BYTES, MOVERS = 512, 32 << 20, 16
#: Sizes and letters of TIFF's field types, and the tags that are read.
_KINDS = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_BYTES, PLANAR, FORMAT = 256, 257, 258, 259, 273, 277, 279, 284, 339


# formats


def tiff_array(raw: bytes) -> np.ndarray:
    """The first page of a TIFF file that is not compressed."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", raw, 4)[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        if kind in _KINDS:
            size, letter = _KINDS[kind]
            place = at + 10 + 12 * k
            tags[tag] = struct.unpack_from(f"{order}{n}{letter}", raw, place if size * n <= 4 else struct.unpack_from(order + "I", raw, place)[0])
    bits = set(tags.get(BITS, (1,)))
    if tags.get(COMPRESSION, (1,))[0] != 1 or len(bits) > 1 or not bits <= {8, 16, 32, 64} or tags.get(PLANAR, (1,))[0] != 1:
        raise ValueError("a TIFF file of a kind that is not read: compressed, in planes, or of odd bits")
    letter = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    data = b"".join(raw[a : a + n] for a, n in zip(tags[STRIPS], tags[STRIP_BYTES], strict=True))
    h, w, samples = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
    flat = np.frombuffer(data, f"{order}{letter}{bits.pop() // 8}")
    return flat.reshape((h, w) if samples == 1 else (h, w, samples))


def tiff_bytes(a: np.ndarray) -> bytes:
    """A two-dimensional array as a TIFF file of floats, in one strip."""
    if a.ndim != 2:
        raise ValueError("a TIFF file is written from two dimensions")
    a = a.astype("<f4" if a.dtype.itemsize <= 4 else "<f8", copy=False)
    h, w = a.shape
    entries = [(WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, 8 * a.dtype.itemsize), (COMPRESSION, 3, 1), (262, 3, 1), (STRIPS, 4, 8), (SAMPLES, 3, 1), (278, 4, h), (STRIP_BYTES, 4, a.nbytes), (FORMAT, 3, 3)]
    table = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in entries) + struct.pack("<I", 0)
    data = a.tobytes()
    data += b"\0" * (len(data) % 2)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + table


def arrays_of(path: str, raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """(name, array) of each array in a file; the name is the file's stem, in an .npz with the member behind it."""
    file = PurePosixPath(path)
    suffix = file.suffix.lower()
    if suffix == ".npy":
        yield file.stem, np.load(io.BytesIO(raw), allow_pickle=False)
    elif suffix == ".npz":
        with np.load(io.BytesIO(raw), allow_pickle=False) as members:
            for name in members.files:
                yield f"{file.stem}/{name}", members[name]
    elif suffix in (".tif", ".tiff"):
        yield file.stem, tiff_array(raw)
    else:
        raise ValueError(f"no array file: {path}")


def bytes_of(kind: str, shape: list[int], values: list[float]) -> bytes:
    a = np.array(values, np.float64)
    if np.prod(shape, dtype=np.int64) != len(a):
        raise ValueError(f"{len(a)} values for the shape {tuple(shape)}")
    a = a.reshape(shape)
    if kind == "tiff":
        return tiff_bytes(a)
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


# the data source


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class SomeFiles(InputPartition):
    paths: list


@dataclass
class Written(WriterCommitMessage):
    files: list


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.at = options["path"]

    def partitions(self) -> list[SomeFiles]:
        from pyarrow import fs

        system, root = _system(self.at)
        found = [system.get_file_info(root)]
        if found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.at)
        if found[0].type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in PurePosixPath(p[len(root) :]).parts if x != "/")
        files = [f for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.lower().endswith(SUFFIXES) and not hidden(f.path)]
        most = max(1, min(FILES, len(files) // 64))  # few files are dealt out too
        out, held = [], 0
        for f in files:
            if not out or len(out[-1].paths) >= most or held + f.size > FILES_BYTES:
                out.append(SomeFiles([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out

    def read(self, partition: SomeFiles) -> Iterator[pa.RecordBatch]:
        if partition is None or not hasattr(partition, "paths"):  # an empty folder
            return
        system, _ = _system(self.at)
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                raw = stream.read()
            for name, a in arrays_of(path, raw):
                values = pa.array(a.astype(np.float64).ravel())
                lists = [pa.array([list(a.shape)], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), *lists], names=["path", "name", "shape", "values"])


class ArrayWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.at, self.kind, self.overwrite = options["path"].rstrip("/"), options.get("kind", "npy"), overwrite
        if self.kind not in ("npy", "tiff"):
            raise ValueError(f"unknown kind of array file: {self.kind}")
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, root = _system(self.at)
        stage, files = f"{root}/_arrays-{self.run}/{uuid.uuid4().hex}", []
        for row in rows:
            name = row["name"]
            if not name or name.startswith(("/", "_", ".")) or ".." in PurePosixPath(name).parts:
                raise ValueError(f"no name of a file: {name!r}")
            raw = bytes_of(self.kind, row["shape"], row["values"])
            target = f"{name}.{'tif' if self.kind == 'tiff' else 'npy'}"
            temporary = f"{stage}/{len(files)}"
            if not files:
                system.create_dir(stage, recursive=True)
            with system.open_output_stream(temporary) as stream:
                stream.write(raw)
            files.append((temporary, target))
        return Written(files)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = _system(self.at)
        files = [f for m in messages if m is not None for f in m.files]
        names = [target for _, target in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"names that came twice: {sorted({n for n in names if names.count(n) > 1})[:5]}")
        system.create_dir(root, recursive=True)
        for folder in sorted({str(PurePosixPath(f"{root}/{n}").parent) for n in names}):
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda f: system.move(f[0], f"{root}/{f[1]}"), files))
        if self.overwrite:
            known = set(names)
            for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
                if f.is_file and f.path.lower().endswith(SUFFIXES) and f.path[len(root) + 1 :] not in known:
                    system.delete_file(f.path)
        self._clear(system, root)

    def abort(self, messages: list) -> None:
        self._clear(*_system(self.at))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/_arrays-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_arrays-{self.run}")


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayFiles)


def read_arrays(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format("arrays").load(folder)


def write_arrays(t: DataFrame, folder: str, kind: str = "npy") -> None:
    """Rows (name, shape, values) as files; files of other names stay."""
    register(t.sparkSession)
    t.select("name", "shape", "values").write.format("arrays").option("kind", kind).mode("append").save(folder)


def read_matching(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The arrays of the wanted stems (stem); a stem that no file has, or several, is an error when the rows are read."""
    files = read_arrays(spark, folder).withColumn("stem", F.substring_index("name", "/", 1))
    known = one_match(files.select("path", "stem").distinct(), wanted, strict=True)
    return files.join(known.filter("status = 'ok'").select("stem"), "stem", "left_semi")


def grids(t: DataFrame, column: str, prefix: str = "map_") -> DataFrame:
    """(name, shape, values) of whole grids (image_id, y, x, column), for `write_arrays`."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col(column).cast("double").alias("v"))))
    t = t.groupBy("image_id").agg(cells.alias("cells"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return t.select(F.concat(F.lit(prefix), F.col("image_id").cast("string")).alias("name"), F.array(F.col("h").cast("int"), F.col("w").cast("int")).alias("shape"), F.transform("cells", lambda c: c["v"]).alias("values"))


def cells_of(t: DataFrame, column: str) -> DataFrame:
    """(image_id, y, x, column) of two-dimensional arrays whose names end in the image's number."""
    t = t.select(F.regexp_extract("name", r"(\d+)$", 1).cast("bigint").alias("image_id"), F.get("shape", F.lit(1)).alias("w"), F.posexplode("values").alias("at", column))
    return t.select("image_id", F.expr("cast(at div w as int)").alias("y"), (F.col("at") % F.col("w")).alias("x"), column)
