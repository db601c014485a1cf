"""Running sums over an order, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_bucket(value: Column, splits: list[float]) -> Column:
    """How many of the increasing splits are at most the value, by binary search in one expression."""
    if not splits:
        return F.lit(0)
    table, steps, step = F.array(*[F.lit(float(x)) for x in splits]), [], 1 << (len(splits).bit_length() - 1)
    while step:
        steps.append(F.lit(step))
        step >>= 1
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, s: F.when((at + s <= len(splits)) & (F.get(table, at + s - 1) <= value), at + s).otherwise(at))


def _dealt(df: DataFrame, order: str, parts: int | None) -> DataFrame:
    """df with the range of its order that each row is in."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = [k / parts for k in range(1, parts)]
    splits = sorted(set(df.agg(F.percentile_approx(F.col(order).cast("double"), marks, 1000).alias("p")).head()["p"] or [])) if marks else []
    return df.withColumn("_bucket", order_bucket(F.col(order).cast("double"), splits))


def previous(df: DataFrame, order: str, columns: dict[str, str], descending: bool = False, keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Adds, for each new name, a column's value in the row before in a numeric order without ties; null in the first row. With keys, in the row before of the same key.

    Within a range of the order it is the row before; the first row of a range takes the last row of the nearest range before
    that has rows, of the same key. So a key's rows are in as many tasks as ranges, and only one row a range and key is carried.
    """
    t = _dealt(df, order, parts)
    by = [*keys, "_bucket"]
    last = (F.min_by if descending else F.max_by)(F.struct(*columns.values()), F.col(order))
    way = (lambda c: F.col(c).desc()) if descending else F.col
    ends = t.groupBy(*by).agg(last.alias("_last"))
    ends = ends.select(*by, F.lag("_last").over(Window.partitionBy(*keys).orderBy(way("_bucket"))).alias("_carried"))  # a row for each range (and key)
    inner = Window.partitionBy(*by).orderBy(way(order))
    first = F.row_number().over(inner) == 1
    t = t.join(ends if keys else F.broadcast(ends), by)
    return t.withColumns({n: F.when(first, F.col(f"_carried.{c}")).otherwise(F.lag(c).over(inner)) for n, c in columns.items()}).drop("_bucket", "_carried")


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Adds, for each new name, the running sum of a column over a numeric order (ties in any order: aggregate them first).

    Rows are dealt into ranges of the order (splits from approximate quantiles), summed by range, and only ranges are
    windowed. With keys the sums run within each key.
    """
    t = _dealt(df, order, parts)
    by = [*keys, "_bucket"]
    way = (lambda c: F.col(c).desc()) if descending else F.col
    totals = t.groupBy(*by).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    outer = Window.partitionBy(*keys).orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, *[F.coalesce(F.sum(f"_{n}").over(outer), F.lit(0)).alias(f"_{n}") for n in sums])
    inner = Window.partitionBy(*by).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(totals, by)
    return t.withColumns({n: F.col(f"_{n}") + F.sum(c).over(inner) for n, c in sums.items()}).drop("_bucket", *[f"_{n}" for n in sums])
