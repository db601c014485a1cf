"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]: weight * (1 + tilt * (1 - 2t)). Its integral over
training is the weight itself, so the schedules fix each source's share, and the cumulative demand
(1 + tilt) * t - tilt * t^2 is inverted in closed form: the word at cumulative position c of a source whose target is
T is trained at the t where the demand reaches c / T. Documents are then range-sorted by that position.

Targets share the whole corpus by weight; a target above `most` times its source's size stops there and the excess is
shared again by weight (water filling over the sources in order of size / weight, by prefix sums over ranges of that
order). Within a source, documents stand in the order of md5(doc_id); a target of T = p * size + r words takes every
document p times and the first r words of that order once more, so the words taken meet floor(T) exactly.

Nothing here gathers a source in one task: prefix sums run over (source, hash bucket) cells of about CELL_ROWS
documents, however large a source is, and the cells' offsets come from their sums. Everything is DataFrame code.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own, last in order; a
source without words has target 0; repeated rows are documents of their own, alike up to their order; no rows in, no
rows out; only the three named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, sums_before, written

WEIGHTS, TILTS, MOST, CELL_ROWS = (5, 2, 1), (0.5, 0.0, -0.5), 3, 2_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS, most: int = MOST) -> DataFrame:
    """Adds weight, tilt and target to a table (source, source_size, ...) with a row for each source, however many there are."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("rank") % len(values) + 1).cast("int"))
    t = sums_before(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"rank": "one"}, "sources-by-name").drop("one")
    t = t.withColumn("weight", pick(weights).cast("bigint")).withColumn("tilt", pick(tilts).cast("double"))
    t = t.withColumn("fill", F.col("source_size") / F.col("weight"))
    t = sums_before(t, [F.col("fill").asc(), F.col("rank").asc()], {"size_before": "source_size", "weight_before": "weight"}, "sources-by-fill")
    t = t.join(F.broadcast(t.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))))  # one row
    t = t.withColumn("left", F.col("all_size") - F.col("size_before") * most).withColumn("open_weight", F.col("all_weight") - F.col("weight_before"))
    t = t.withColumn("open", F.col("source_size") * most * F.col("open_weight") >= F.col("left") * F.col("weight"))
    # the first open source in order of fill sets the level for itself and all after it
    t = t.join(F.broadcast(t.agg(F.min(F.when(F.col("open"), F.struct("fill", "rank", "left", "open_weight"))).alias("level"))))  # one row
    shared = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.open_weight")
    is_open = (F.col("fill") > F.col("level.fill")) | ((F.col("fill") == F.col("level.fill")) & (F.col("rank") >= F.col("level.rank")))
    target = F.when(F.coalesce(is_open, F.lit(False)), shared).otherwise((F.col("source_size") * most).cast("double"))
    return t.withColumn("target", target).select(*sizes.columns, "weight", "tilt", "target")


def demand_time(share: Column, tilt: Column) -> Column:
    """The t at which (1 + tilt) * t - tilt * t^2 reaches the share."""
    linear = F.lit(1.0) + tilt
    return F.when(tilt == 0, share).otherwise((linear - F.sqrt(linear * linear - F.lit(4.0) * tilt * share)) / (F.lit(2.0) * tilt))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, passes, rest, first_position, tilt, prefix.

    taken = passes * size + rest: whole passes, and the first `rest` words once more.
    """
    text = F.col(f"`{text_col}`")
    order_key = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        order_key.alias("order_key"),
        *[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep],
    )
    slim = written(slim, "mix-sizes")
    sources = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")), weights, tilts, most)
    cells = F.ceil(F.col("source_rows") / CELL_ROWS)
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    sources = written(sources.withColumn("source_key", key).drop("source"), "source-targets")
    t = spread_join(slim.withColumn("source_key", key), sources, ["source_key"], "source_rows")
    t = t.withColumn("cell", F.floor(F.conv(F.substring("order_key", 1, 7), 16, 10).cast("bigint") * cells / F.lit(1 << 28)))
    sums = t.groupBy("source_key", "cell").agg(F.sum("size").alias("cell_size"))
    sums = sums.withColumn("before", F.coalesce(F.sum("cell_size").over(Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("cell_size")
    t = t.join(sums, ["source_key", "cell"])
    inside = Window.partitionBy("source_key", "cell").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("prefix", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.floor("target").cast("bigint")
    t = t.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0))
    t = t.withColumn("rest", F.least("size", F.greatest(F.lit(0), whole - F.col("passes") * F.col("source_size") - F.col("prefix"))))
    t = t.withColumn("taken", F.col("passes") * F.col("size") + F.col("rest"))
    first = F.when(F.col("taken") > 0, demand_time(F.col("prefix") / F.col("target"), F.col("tilt")))
    return t.select("doc_id", "size", "source_size", "target", "taken", "passes", "rest", F.round(first, 9).alias("first_position"), "tilt", "prefix", *[f"kept_{c}" for c in keep])


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each reading of a document, (doc_id, reading, words, position, ...), range-sorted by position."""
    readings = F.expr("sequence(0, cast(passes as int) - if(rest > 0, 0, 1))")
    t = mixed.filter("taken > 0").withColumn("reading", F.explode(readings))
    t = t.withColumn("words", F.when(F.col("reading") < F.col("passes"), F.col("size")).otherwise(F.col("rest")))
    share = F.least(F.lit(1.0), (F.col("reading") * F.col("source_size") + F.col("prefix")) / F.col("target"))
    return t.withColumn("position", demand_time(share, F.col("tilt"))).orderBy("position", "doc_id", "reading")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as the mix reads them: a row for each reading, the last one of a source cut to its words, in order of position.

    The columns are those of the table, whatever their names; n_chars, if there is one, follows the text. Rows are carried
    as one struct, and known by doc_id and a hash of all their columns; rows alike in all columns are one with several
    places in the mix. Only the join of texts to readings and the final range sort move texts.
    """
    flat = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes]
    t = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(*flat).alias("row_hash"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    mixed = mix_sources(t, keep=("row_hash",), **options).withColumnRenamed("kept_row_hash", "row_hash")
    mixed = written(mixed.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).drop("doc_id"), "mixed")
    rows = t.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).select("id", "row_hash", "row")
    taken, key = mixed.filter("passes > 0 or rest > 0"), ["id", "row_hash"]
    again = mixed.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")
    if again.isEmpty():
        t = rows.join(taken, key)
    else:  # of rows that are alike one gives the content
        again = written(again, "repeated-rows")
        once = rows.join(again.select(*key), key, "left_anti").join(taken, key)
        one = written(rows.join(again, key).dropDuplicates(key), "repeated-row")
        t = once.unionByName(spread_join(taken.join(again.select(*key), key, "left_semi"), one, key, "rows").select(*once.columns))
    t = t.withColumn("reading", F.explode(F.expr("sequence(0, cast(passes as int) - if(rest > 0, 0, 1))")))
    share = F.least(F.lit(1.0), (F.col("reading") * F.col("source_size") + F.col("prefix")) / F.col("target"))
    text = F.col("row").getField(text_col)
    words = F.filter(F.split(text, r"[ \x09-\x0D]+"), lambda w: w != "")
    cut = (F.col("reading") == F.col("passes")) & (F.col("rest") < F.col("size"))
    new_text = F.when(cut, F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.col("rest").cast("int"))), " ")).otherwise(text)
    t = t.select("row", "id", "reading", demand_time(share, F.col("tilt")).alias("position"), "prefix", new_text.alias("new_text")).orderBy("position", "id", "reading", "prefix")
    new = {text_col: F.col("new_text"), "n_chars": F.char_length("new_text").cast("bigint")}
    return t.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
