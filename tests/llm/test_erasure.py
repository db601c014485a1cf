"""The erasure against a plain version in one process, and keys against Spark's own order."""

import hashlib
import math
import uuid
import zlib
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path
from random import Random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from heliodor.llm import erasure
from heliodor.llm.common import shared_folder

SCHEMAS = {
    "clients": "client_id bigint, master_id bigint, source string, updated_at timestamp_ntz, balance double, n int",
    "clicks": "click_id bigint, ts timestamp_ntz, client_id bigint, value double, props string",
    "sales": "sale_id bigint, client_id bigint, status string, total double, priority int, row string",
    "sale_lines": "sale_id bigint, line_no int, amount double, flag string, id bigint, file int",
}
MONEY = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def shop(seed, size):
    r = Random(seed)
    some = lambda x, share=0.1: None if r.random() < share else x
    day = lambda: datetime(2024, 1, 1) + timedelta(seconds=r.randrange(10**6), microseconds=r.choice((0, 1, 999999)))
    text = lambda: some(r.choice(("", "a", "a\0", "a\0b", "ab", "é", "\U0001f642", "b" * 300)))
    number = lambda: some(r.choice((0.0, -0.0, 1.005, -3.5, 1e300, float("nan"), float("inf"), r.uniform(-99, 99))))
    client = lambda: some(r.choice((7, r.randrange(-5, size))), 0.05)
    clients = [(k, some(k if r.random() < 0.7 else r.randrange(size)), text(), some(day()), number(), some(r.randrange(-3, 3))) for k in range(-5, size)]
    clicks = [(k, some(day()), client(), number(), text()) for k in range(6 * size)]
    sales = [(k, client(), text(), number(), some(r.randrange(5)), text()) for k in range(2 * size)]
    lines = [(some(r.choice((3, r.randrange(3 * size)))), r.randrange(3), number(), text(), r.randrange(3), None) for k in range(8 * size)]
    lines += [(3, 1, 2.0, "same", 1, 1)] * (3 * size) + [lines[5]] * 9
    return {"clients": clients, "clicks": [*clicks, *clicks[:40]], "sales": sales, "sale_lines": lines}


def order(crc, row):
    def part(x):
        if x is None:
            return (0,)
        if isinstance(x, float):
            return (1, math.isnan(x), 0.0 if math.isnan(x) else x, math.copysign(1, x) if x == 0 else 0)
        return (1, x.encode() if isinstance(x, str) else x)

    return (crc, *map(part, row))


def plain(tables, divisor, files):
    crc = lambda x: zlib.crc32(b"" if x is None else str(x).encode())
    client_of = {}
    for s in tables["sales"]:
        if s[0] is not None and s[1] is not None:
            client_of[s[0]] = min(s[1], client_of.get(s[0], s[1]))
    n = Counter(c[2] for c in tables["clicks"])
    masters = {}
    for c in tables["clients"]:
        if c[1] is not None:
            masters.setdefault(c[1], set()).add(c[0])
    top = min(masters, key=lambda m: (-sum(n[c] for c in masters[m] if c is not None), m), default=None)
    gone = {c for m, own in masters.items() if m == top or crc(m) % divisor == 0 for c in own} - {None}
    gone_sales = {s[0] for s in tables["sales"] if s[1] in gone} - {None}
    victim = {"clients": lambda x: x[0] in gone, "clicks": lambda x: x[2] in gone, "sales": lambda x: x[1] in gone, "sale_lines": lambda x: x[0] in gone_sales}
    owner = {"clients": lambda x: x[0], "clicks": lambda x: x[2], "sales": lambda x: x[1], "sale_lines": lambda x: client_of.get(x[0])}
    out = {}
    for name, rows in tables.items():
        rows = sorted(rows, key=lambda x: order(crc(owner[name](x)), x))
        per = 1 + len(rows) // files
        for f in range(-(-len(rows) // per)):
            part = rows[f * per : f * per + per]
            left = [x for x in part if not victim[name](x)]
            if left:
                out[name, f] = left, len(part) - len(left)
    return out


@pytest.mark.parametrize(("seed", "size", "files", "small", "divisor"), [(1, 60, 7, 20_000, 7), (2, 60, 25, 5, 3)])
def test_erasure(spark, monkeypatch, seed, size, files, small, divisor):
    monkeypatch.setattr(erasure, "SMALL", small)
    monkeypatch.setattr(erasure, "AHEAD", 3 if seed == 2 else 64)
    tables = shop(seed, size)
    frames = {name: spark.createDataFrame(rows, SCHEMAS[name]).repartition(3) for name, rows in tables.items()}
    folder = f"{shared_folder(spark)}/erasure-test-{seed}-{uuid.uuid4().hex}"
    got = erasure.erase(frames, folder, divisor, files).collect()
    want = plain(tables, divisor, files)
    assert sorted((r["table_name"], r["file_no"]) for r in got) == sorted(want)
    assert any(r["rewritten"] for r in got) and (seed == 1 or any(not r["rewritten"] for r in got))
    columns = {name: [c.split()[0] for c in s.split(", ")] for name, s in SCHEMAS.items()}
    for r in got:
        name = r["table_name"]
        rows, erased = want[name, r["file_no"]]
        file = pq.ParquetFile(r["path"])
        found = list(zip(*(c.to_pylist() for c in file.read().columns), strict=True))
        assert repr(found) == repr(rows)
        assert file.schema_arrow.names == columns[name] == r["columns"].split(",")
        money = [x[columns[name].index(MONEY[name])] for x in rows]
        cents = sum(math.floor(100 * x + 0.5) for x in money if x is not None and math.isfinite(x) and abs(x) < 1e16)
        if not any(x is not None and math.isfinite(x) and abs(x) >= 1e16 for x in money):
            assert r["cents"] == cents
        ids = ",".join("" if x[0] is None else str(x[0]) for x in rows)
        assert (r["n_rows"], r["n_erased"], r["rewritten"], r["ids_sha256"]) == (len(rows), erased, erased > 0, hashlib.sha256(ids.encode()).hexdigest())
        place = next((k for k in range(file.metadata.row_group(0).num_columns) if file.metadata.row_group(0).column(k).path_in_schema == columns[name][0]), 0)
        stats = file.metadata.row_group(0).column(place).statistics
        known = [x[0] for x in rows if x[0] is not None]
        assert stats.null_count == len(rows) - len(known) and (not known or (stats.min, stats.max) == (min(known), max(known)))
    left = {str(p) for p in Path(folder.removeprefix("file://")).parent.rglob(f"{Path(folder).name}*/**/*.parquet")}
    assert left == {r["path"] for r in got}


def test_empty_tables(spark):
    frames = {name: spark.createDataFrame([], s) for name, s in SCHEMAS.items()}
    assert erasure.erase(frames, f"{shared_folder(spark)}/erasure-empty-{uuid.uuid4().hex}").collect() == []
    some = shop(4, 20)
    frames["clients"] = spark.createDataFrame(some["clients"], SCHEMAS["clients"])
    got = erasure.erase(frames, f"{shared_folder(spark)}/erasure-clients-{uuid.uuid4().hex}", 10**9).collect()
    want = plain(dict.fromkeys(SCHEMAS, []) | {"clients": some["clients"]}, 10**9, 350)
    assert sorted((r["table_name"], r["file_no"], r["n_rows"]) for r in got) == sorted((*k, len(v[0])) for k, v in want.items())


def test_keys_sort_as_spark_does(spark):
    tables = shop(5, 50)
    for name, rows in tables.items():
        rows = [tuple(0.0 if isinstance(x, float) and x == 0 else x for x in row) for row in rows]
        t = spark.createDataFrame(rows, SCHEMAS[name])
        t = t.select(F.lit(1).cast("bigint").alias("__owner"), *t.columns).coalesce(1)
        keys = [bytes(r[0]) for r in t.orderBy(*[F.col(c).asc_nulls_first() for c in t.columns[1:]]).coalesce(1).mapInArrow(erasure._only_keys, "key binary").collect()]
        assert keys == sorted(keys)
