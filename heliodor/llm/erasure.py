"""Cascading erasure: tables in one order over files of equal length, and the files that hold victims written anew.

1. Keys. A row's key is the crc32 of its client, four bytes, and then each column: 00 for null, or 01 and bytes that sort as
   the values do (integers with the sign turned, big-endian; doubles with the sign or all bits turned; strings with 00
   escaped and 00 00 behind them). Comparing keys byte by byte compares rows: nulls first, all columns left to right.
2. Cuts. Files end at fixed ranks. Rows are counted by the first two bytes of their keys; only buckets where a file ends
   go on, and are counted again by the byte behind what their keys have in common, until a bucket is small or one key only.
   Small ones are ranked by sorting. So what is known at last is the key at each cut and its rank; at most FILES buckets
   are open at a time, whatever the table, and the driver sees 256 counts for each.
3. Files. A row's file is found among the cuts by bisection. Rows that equal a cut's key are alike in all bytes: they are counted,
   and the count is dealt over the files. One shuffle by file brings rows together, keys sort them, and one task streams a file.
4. Victims: the clients of the given masters, their clicks and sales, and the lines of these sales. A victim's id goes to
   the files that its key's beginning may lie in, and there into a sorted array, in which numpy looks up the rows' ids. A first
   pass over the ids alone tells which files hold victims; only these are read again and written anew from the survivors, in
   their order (`_metadata.row_index`), and then put in place of the old ones.
5. Digests are streamed from the final files.

Skew: hot clients and sales span several files, so no file has more rows than any other; joins on hot ids are dealt out
(`spread_join`). Nothing is broadcast but cuts and file numbers, at most FILES of each a table.

Defined results: a null client_id, a null sale_id or an unknown sale is nobody's: its crc32 is that of the empty string and
its rows stay. If a sale_id has several clients, its lines are sorted by the smallest, and go if any of them is a victim. Equal
rows all stay, or go. -0.0 comes before 0.0 and NaN last; values that are not finite count 0 cents. An empty table has
no files. Extra columns are sorted by, written and named like all others.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_arrow, parts_for, shared_folder, spread_join, written

#: Parts of a table, each of 1 + floor(n / FILES) rows; buckets of up to SMALL rows are sorted; keys are looked ahead by AHEAD bytes.
FILES, SMALL, AHEAD = 350, 20_000, 64
#: name, the column whose value is erased, the column of money.
TABLES = (("clients", "client_id", "balance"), ("clicks", "client_id", "value"), ("sales", "client_id", "total"), ("sale_lines", "sale_id", "amount"))


# keys


def _fixed(column: pa.Array) -> np.ndarray | None:
    """A column as rows of a marker byte and big-endian bytes that sort as the values do; None for other kinds."""
    kind = column.type
    if pa.types.is_timestamp(kind) or pa.types.is_date64(kind) or pa.types.is_duration(kind):
        column = column.cast(pa.int64())
    elif pa.types.is_date32(kind):
        column = column.cast(pa.int32())
    elif pa.types.is_boolean(kind):
        column = column.cast(pa.int8())
    kind = column.type
    if not (pa.types.is_signed_integer(kind) or pa.types.is_float32(kind) or pa.types.is_float64(kind)):
        return None
    there = column.is_valid().to_numpy(zero_copy_only=False)
    value = column.fill_null(0).to_numpy(zero_copy_only=False)
    width = value.dtype.itemsize
    bits, top = value.view(f"u{width}"), np.array(1, f"u{width}") << np.array(8 * width - 1, f"u{width}")
    if value.dtype.kind == "f":
        bits = np.where(np.isnan(value), np.array(np.nan, value.dtype).view(bits.dtype), bits)
        bits = np.where(bits >> np.array(8 * width - 1, bits.dtype) != 0, ~bits, bits | top)
    else:
        bits = bits ^ top
    out = np.zeros((len(value), 1 + width), np.uint8)
    out[:, 0] = there
    out[:, 1:] = np.where(there, bits, np.zeros_like(bits)).astype(f">u{width}").view(np.uint8).reshape(-1, width)
    return out


def _plain(matrices: list[np.ndarray]) -> list[bytes]:
    m = np.ascontiguousarray(np.hstack(matrices))
    return m.view(f"V{m.shape[1]}").ravel().tolist()


def text_key(x: bytes | None) -> bytes:
    return b"\0" if x is None else b"\x01" + (x.replace(b"\0", b"\0\xff") if b"\0" in x else x) + b"\0\0"


def row_keys(owner: np.ndarray, columns: list[pa.Array]) -> list[bytes]:
    """The memcomparable keys of rows; owner: unsigned 32-bit numbers in front of all columns."""
    parts, run = [], [owner.astype(">u4").view(np.uint8).reshape(-1, 4)]
    for column in columns:
        fixed = _fixed(column)
        if fixed is not None:
            run.append(fixed)
            continue
        if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type)):
            raise TypeError(f"no order-preserving bytes for {column.type}")
        if run:
            parts.append(_plain(run))
        parts.append([text_key(x) for x in column.cast(pa.binary()).to_pylist()])
        run = []
    if run:
        parts.append(_plain(run))
    return [b"".join(p) for p in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]


def owner_crc(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def _keys_of(batch: pa.RecordBatch) -> list[bytes]:
    """The keys of a batch whose first column is __owner."""
    return row_keys(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint32), batch.columns[1:])


def _only_keys(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_keys_of(batch), pa.binary())], names=["key"])


# cuts


class Within:
    """Which of some disjoint prefixes a key begins with."""

    def __init__(self, prefixes: list[bytes]):
        self.order = sorted(range(len(prefixes)), key=prefixes.__getitem__)
        self.prefixes = [prefixes[k] for k in self.order]

    def __call__(self, key: bytes) -> int:
        k = bisect_right(self.prefixes, key) - 1
        return self.order[k] if k >= 0 and key.startswith(self.prefixes[k]) else -1


def _digits(prefixes: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Of the keys in each bucket: counts by the byte behind its prefix (-1: none), with the least and greatest beginnings."""
        within, found = Within(prefixes), {}
        for batch in batches:
            for key in batch.column(0).to_pylist():
                b = within(key)
                if b >= 0:
                    at = len(prefixes[b])
                    child = (b, key[at] if len(key) > at else -1)
                    start = key[: at + AHEAD]
                    n, lo, hi = found.get(child, (0, start, start))
                    found[child] = (n + 1, min(lo, start), max(hi, start))
        rows = [(*child, *x) for child, x in found.items()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "child", "n", "lo", "hi"])

    return run


def _members(prefixes: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        within = Within(prefixes)
        for batch in batches:
            keys = batch.column(0)
            b = np.fromiter(map(within, keys.to_pylist()), np.int32, len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(b[b >= 0]), keys.filter(pa.array(b >= 0))], names=["bucket", "key"])

    return run


def find_cuts(rows: DataFrame, total: int, per_file: int) -> list[tuple[bytes, int, int]]:
    """(key at each rank per_file, 2 per_file ..., how many keys are less, how many are equal), of rows whose first column is __owner."""
    ranks = range(per_file, total, per_file)
    top = F.shiftrightunsigned("__owner", 16)
    counts = rows.groupBy(top.alias("top")).agg(F.count("*").alias("n")).collect()  # at most 65,536

    def holding(children: list[tuple[bytes, int]], before: int) -> Iterator[tuple[bytes, int, int]]:
        """Of buckets in order, those where a file ends, with the number of rows before."""
        for prefix, n in children:
            if ranks[bisect_left(ranks, before) :][:1] and ranks[bisect_left(ranks, before)] < before + n:
                yield prefix, before, n
            before += n

    found: dict[int, tuple[bytes, int, int]] = {}
    settle = lambda key, before, n: found.update({r: (key, before, n) for r in ranks[bisect_left(ranks, before) : bisect_left(ranks, before + n)]})
    todo = list(holding(sorted((r["top"].to_bytes(2, "big"), r["n"]) for r in counts), 0))
    if not todo:
        return []
    keys = written(map_arrow(rows.filter(top.isin([int.from_bytes(p, "big") for p, _, _ in todo])), _only_keys, "key binary"), "keys")
    small = [b for b in todo if b[2] <= SMALL]
    todo = [b for b in todo if b[2] > SMALL]
    while todo:
        got = map_arrow(keys, _digits([b[0] for b in todo]), "bucket int, child int, n bigint, lo binary, hi binary")
        got = got.groupBy("bucket", "child").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        following = []
        for k, (prefix, before, _) in enumerate(todo):
            children = sorted((r for r in got if r["bucket"] == k), key=lambda r: r["child"])
            at = {r["child"]: r for r in children}
            for child, start, n in holding([(r["child"], r["n"]) for r in children], before):
                lo, hi = bytes(at[child]["lo"]), bytes(at[child]["hi"])
                if lo == hi and len(lo) < len(prefix) + AHEAD:  # one key, seen to its end
                    settle(lo, start, n)
                else:
                    following.append((commonprefix([lo, hi]), start, n))
        small += [b for b in following if b[2] <= SMALL]
        todo = [b for b in following if b[2] > SMALL]
    if small:
        wanted = [(k, r - before, r) for k, (_, before, n) in enumerate(small) for r in ranks[bisect_left(ranks, before) : bisect_left(ranks, before + n)]]
        place, same = Window.partitionBy("bucket").orderBy("key"), Window.partitionBy("bucket", "key")
        t = map_arrow(keys, _members([b[0] for b in small]), "bucket int, key binary")
        t = t.withColumns({"at": F.row_number().over(place) - 1, "less": F.rank().over(place) - 1, "same": F.count("*").over(same)})
        wanted = keys.sparkSession.createDataFrame(wanted, "bucket int, at int, cut bigint")
        for r in t.join(F.broadcast(wanted), ["bucket", "at"]).collect():  # at most FILES
            found[r["cut"]] = (bytes(r["key"]), small[r["bucket"]][1] + r["less"], r["same"])
    discard(keys)
    return [found[r] for r in ranks]


# files


def _place(cuts: list[bytes], known: dict[bytes, int]):
    """Rows with their file; known: for each cut's key the file of its only row, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            keys = _keys_of(batch)
            files = [known[k] if k in known else bisect_left(cuts, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), *batch.columns], names=["__file", *batch.schema.names])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """(__file, __owner, columns) to (__file, __key, columns)."""
    for batch in batches:
        keys = row_keys(batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32), batch.columns[2:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *batch.columns[2:]], names=["__file", "__key", *batch.schema.names[2:]])


def _schema(front: str, schema: T.StructType) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(front).fields, *schema.fields])


def _quoted(names: Iterable[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def _put(t: DataFrame, stage: str, folder: str) -> dict[int, str]:
    """Write rows (__file, columns), each file's together and in order, and put the files into the folder: their paths by number."""
    t.write.option("compression", "zstd").partitionBy("__file").parquet(stage)
    spark = t.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    at, into = hadoop(stage), hadoop(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(into)
    found, out = fs.listFiles(at, True), {}
    while found.hasNext():
        path = found.next().getPath()
        name = path.getName()
        if not name.startswith("part-"):
            continue
        number = int(path.getParent().getName().removeprefix("__file="))
        if number in out:
            raise RuntimeError(f"file {number} was written in two parts")
        target = hadoop(into, f"{number:06d}.parquet")
        fs.delete(target, False)
        if not fs.rename(path, target):
            raise RuntimeError(f"{path} can't be moved to {target}")
        out[number] = str(target.toString())
    fs.delete(at, True)
    return out


def sorted_files(rows: DataFrame, folder: str, files: int = FILES) -> tuple[list[bytes], dict[int, str], int]:
    """Write rows (__owner, columns) in the order of their keys as files of 1 + floor(n / files) rows: (keys at the cuts, paths, n)."""
    schema = T.StructType(rows.schema.fields[1:])
    total = rows.count()
    per_file = 1 + total // files
    cuts = find_cuts(rows, total, per_file)
    keys = [c[0] for c in cuts]
    known = {key: less // per_file if same == 1 else -1 - k for k, (key, less, same) in enumerate(cuts)}
    placed = map_arrow(rows, _place(keys, known), _schema("__file int, __owner bigint", schema))
    if any(x < 0 for x in known.values()):  # equal rows on both sides of a cut: their number is dealt over the files
        whole = F.struct("__owner", *_quoted(schema.names))
        alike = placed.filter("__file < 0").groupBy("__file").agg(F.count("*").alias("n"), F.first(whole).alias("row"))
        before = {known[key]: less for key, less, _ in cuts if known[key] < 0}
        least = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        alike = alike.select(F.try_element_at(least, F.col("__file")).alias("less"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("nth"), "row")
        alike = alike.select(F.expr(f"cast((less + nth) div {per_file} as int)").alias("__file"), "row.*")
        placed = placed.filter("__file >= 0").unionByName(alike)
    t = placed.repartition(parts_for(rows), "__file")
    t = map_arrow(t, _keyed, _schema("__file int, __key binary", schema)).sortWithinPartitions("__file", "__key").drop("__key")
    return keys, _put(t, f"{folder}-stage-{uuid.uuid4().hex}", folder), total


# victims


def _counted(big: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Those of the distinct ids that big has, with the number of its rows."""
    return written(big.groupBy(key).agg(F.count("*").alias("__n")).join(ids, key), "counted-ids")


def victim_masters(clients: DataFrame, clicks: DataFrame, divisor: int = 400) -> DataFrame:
    """(master_id): those whose crc32 the divisor divides, and the one whose clients have most clicks (ties: the smallest)."""
    pairs = clients.filter("master_id is not null").select("client_id", "master_id").distinct()
    n = clicks.groupBy("client_id").agg(F.count("*").alias("n"))
    busy = pairs.join(n, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    drawn = pairs.select("master_id").distinct().filter(F.pmod(owner_crc(F.col("master_id")), F.lit(divisor)) == 0)
    return drawn.unionByName(busy.orderBy(F.desc("n"), "master_id").limit(1).select("master_id")).distinct()


def _reach(cuts: list[bytes], with_id: bool):
    """(owner, id) to the files that may hold rows whose keys begin with the owner, or with both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            starts = row_keys(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint32), [batch.column(1)] if with_id else [])
            spans = [(bisect_left(cuts, p), bisect_left(cuts, p + b"\xff")) for p in starts]
            n = np.array([b - a + 1 for a, b in spans], np.int64)
            files = [f for a, b in spans for f in range(a, b + 1)]
            ids = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(ids, pa.int64())], names=["__file", "__id"])

    return run


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, np.ndarray]]:
    """Rows (table, file, is_row, id, ...), victims of a file before its rows, to (its name, rows, which of them are victims)."""
    name, victims, sorted_ = None, [], np.empty(0, np.int64)
    for batch in batches:
        tables, files, is_row = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        change = (tables[1:] != tables[:-1]) | (files[1:] != files[:-1]) | (is_row[1:] != is_row[:-1])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(files)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if (tables[a], files[a]) != name:
                name, victims, sorted_ = (tables[a], files[a]), [], np.empty(0, np.int64)
            ids = batch.column(3).slice(a, b - a)
            if not is_row[a]:
                victims.append(ids.to_numpy(zero_copy_only=False))
                sorted_ = None
                continue
            if sorted_ is None:
                sorted_ = np.unique(np.concatenate(victims))
            there, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            spot = np.minimum(np.searchsorted(sorted_, value), max(0, len(sorted_) - 1))
            yield name, batch.slice(a, b - a), (there & (sorted_[spot] == value)) if len(sorted_) else np.zeros(b - a, bool)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for (table, file), parts in groupby(_masks(batches), key=lambda x: x[0]):
        n = gone = 0
        for _, part, mask in parts:
            n, gone = n + part.num_rows, gone + int(mask.sum())
        yield pa.RecordBatch.from_arrays([pa.array([int(v)], kind) for v, kind in ((table, pa.int32()), (file, pa.int32()), (n, pa.int64()), (gone, pa.int64()))], names=["table", "file", "n_rows", "n_erased"])


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """(table, file, is_row, id, row_index, columns) to (__file, __row, columns)."""
    for _, part, mask in _masks(batches):
        part = part.filter(pa.array(~mask))
        yield pa.RecordBatch.from_arrays([part.column(1), *part.columns[4:]], names=["__file", *part.schema.names[4:]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows (table, file, row_index, first, money) in order, to a row for each file."""

    def parts() -> Iterator[tuple]:
        for batch in batches:
            tables, files = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cuts = [0, *(np.flatnonzero((tables[1:] != tables[:-1]) | (files[1:] != files[:-1])) + 1).tolist(), len(files)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    yield (int(tables[a]), int(files[a])), batch.slice(a, b - a)

    for (table, file), group in groupby(parts(), key=lambda x: x[0]):
        digest, n, cents = hashlib.sha256(), 0, 0
        for _, part in group:
            digest.update((b"," if n else b"") + b",".join(x or b"" for x in part.column(3).cast(pa.binary()).to_pylist()))
            n += part.num_rows
            money = np.floor(100 * part.column(4).fill_null(0.0).to_numpy(zero_copy_only=False) + 0.5)
            cents += int(money[np.isfinite(money)].astype(np.int64).sum())
        row = ((table, pa.int32()), (file, pa.int32()), (n, pa.int64()), (cents, pa.int64()), (digest.hexdigest(), pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in row], names=["table", "file", "n_rows", "cents", "ids_sha256"])


def _read(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """Rows of files, with the file's number and the row's place in it."""
    number = F.regexp_extract("_metadata.file_name", r"(\d+)\.parquet$", 1).cast("int")
    return spark.read.schema(schema).parquet(*paths).select(number.alias("__file"), F.col("_metadata.row_index").alias("__row"), *_quoted(schema.names))


def erase(tables: dict[str, DataFrame], folder: str, divisor: int = 400, files: int = FILES) -> DataFrame:
    """Write TABLES into the folder, erase the victims, and tell of each final file; more in the module's text."""
    spark = tables["clients"].sparkSession
    sales = tables["sales"].select("sale_id", "client_id")
    sale_owner = written(sales.filter("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("__client")), "sale-owners")

    def with_owner(name: str) -> DataFrame:
        t = tables[name]
        if name != "sale_lines":
            return t.select(owner_crc(F.col("client_id")).alias("__owner"), *_quoted(t.columns))
        rows = t.select("sale_id", F.struct(*_quoted(t.columns)).alias("__line"))
        counts = _counted(rows.filter("sale_id is not null"), sale_owner, "sale_id")
        known = spread_join(rows.filter("sale_id is not null"), counts, ["sale_id"], "__n", "left").select("__client", "__line")
        lost = rows.filter("sale_id is null").select(F.lit(None).cast("bigint").alias("__client"), "__line")
        return written(known.unionByName(lost).select(owner_crc(F.col("__client")).alias("__owner"), "__line.*"), "owned-lines")

    cuts, paths = {}, {}
    for name, _, _ in TABLES:
        rows = with_owner(name)
        cuts[name], paths[name], _ = sorted_files(rows, f"{folder}/{name}", files)
        if hasattr(rows, "_heliodor_path"):
            discard(rows)

    masters = victim_masters(tables["clients"], tables["clicks"], divisor)
    clients = tables["clients"].filter("client_id is not null").join(masters, "master_id").select("client_id").distinct()
    clients = written(clients, "victim-clients")
    gone = spread_join(sales, _counted(sales, clients, "client_id"), ["client_id"], "__n").select("sale_id").distinct()
    gone = written(gone.join(sale_owner, "sale_id"), "victim-sales")
    by_client = clients.select(owner_crc(F.col("client_id")).alias("owner"), F.col("client_id").alias("id"))
    by_sale = gone.select(owner_crc(F.col("__client")).alias("owner"), F.col("sale_id").alias("id"))
    victims = {name: map_arrow(by_sale if key == "sale_id" else by_client, _reach(cuts[name], tables[name].columns[0] == key), "__file int, __id bigint") for name, key, _ in TABLES}

    def aligned(t: DataFrame, *front: str) -> DataFrame:
        return t.repartition(parts_for(t), *front[:2]).sortWithinPartitions(*front)

    whole, found = {}, []
    for k, (name, key, _) in enumerate(TABLES):
        if paths[name]:
            whole[name] = _read(spark, tables[name].schema, list(paths[name].values()))
            found.append(whole[name].select(F.lit(k).alias("table"), "__file", F.lit(1).alias("is_row"), F.col(key).cast("bigint").alias("__id")))
            found.append(victims[name].select(F.lit(k).alias("table"), "__file", F.lit(0).alias("is_row"), "__id"))
    if not found:
        return spark.createDataFrame([], RESULT)
    t = found[0]
    for more in found[1:]:
        t = t.unionByName(more)
    tally = {(TABLES[r["table"]][0], r["file"]): r["n_erased"] for r in map_arrow(aligned(t, "table", "__file", "is_row"), _tally, "table int, file int, n_rows bigint, n_erased bigint").filter("n_rows > 0").collect()}  # at most 4 x FILES

    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name, key, _ in TABLES:
        hit = sorted(f for f in paths[name] if tally.get((name, f)))
        if not hit:
            continue
        schema = tables[name].schema
        rows = _read(spark, schema, [paths[name][f] for f in hit])
        rows = rows.select(F.lit(0).alias("__table"), "__file", F.lit(1).alias("__is_row"), F.col(key).cast("bigint").alias("__id"), "__row", *_quoted(schema.names))
        ids = victims[name].filter(F.col("__file").isin(hit)).select(F.lit(0).alias("__table"), "__file", F.lit(0).alias("__is_row"), "__id")
        left = map_arrow(aligned(rows.unionByName(ids, allowMissingColumns=True), "__table", "__file", "__is_row"), _survivors, _schema("__file int, __row bigint", schema))
        new = _put(left.sortWithinPartitions("__file", "__row").drop("__row"), f"{folder}/{name}-stage-{uuid.uuid4().hex}", f"{folder}/{name}")
        for f in hit:
            if f not in new:  # nothing is left of it
                old = hadoop(paths[name].pop(f))
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, False)

    told, last = [], []
    for k, (name, _, money) in enumerate(TABLES):
        t = tables[name]
        if not paths[name]:
            continue
        plain = lambda p: p.removeprefix("file://").removeprefix("file:") if p.startswith("file:") else p
        told += [(k, f, name, int(tally[name, f]), bool(tally[name, f]), ",".join(t.columns), plain(p)) for f, p in paths[name].items()]
        x = F.col(f"`{money}`").cast("double") if money in t.columns else F.lit(None).cast("double")
        last.append(_read(spark, t.schema, list(paths[name].values())).select(F.lit(k).alias("table"), "__file", "__row", F.col(f"`{t.columns[0]}`").cast("string").alias("first"), x.alias("money")))
    if not last:
        return spark.createDataFrame([], RESULT)
    t = last[0]
    for more in last[1:]:
        t = t.unionByName(more)
    digests = map_arrow(aligned(t, "table", "__file", "__row"), _digest, "table int, file int, n_rows bigint, cents bigint, ids_sha256 string")
    facts = spark.createDataFrame(told, "table int, file int, table_name string, n_erased bigint, rewritten boolean, columns string, path string")
    return digests.join(F.broadcast(facts), ["table", "file"]).select(F.col("file").cast("bigint").alias("file_no"), "n_rows", "n_erased", "cents", "rewritten", "table_name", "ids_sha256", "columns", "path")


RESULT = "file_no bigint, n_rows bigint, n_erased bigint, cents bigint, rewritten boolean, table_name string, ids_sha256 string, columns string, path string"


def erased_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The erasure over the shop's tables, in a new folder of the shared one."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name, _, _ in TABLES}
    return erase(tables, f"{shared_folder(spark)}/erasure-{uuid.uuid4().hex}")
