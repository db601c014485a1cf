"""Sharding by a minimax contiguous partition. DataFrame and SQL functions only.

Equal texts are one group and stay together. Groups stand in the order of xxhash64 of their text. Over their ordered
sizes the smallest capacity for which a greedy fill needs no more than the given number of shards is found by binary
search, and the shards are cut where the greedy fill at that capacity cuts. Law: bytes.

The search never sees more sizes than an array holds, however many groups there are: groups are first summed by the SLOTS
ranges of the order. A search over ranges as they are gives a capacity that is enough; one that may divide every range
of several groups gives a capacity that is needed. Where they differ, the few ranges in which a cut may lie, for any
capacity between the two, are cut finer (by STEP_BITS bits of the hash) and the search is made again, until both are the
same: then the capacity is the least for whole groups.

Row numbers in a shard are gapless without gathering a shard in a task: rows are counted by (shard, hash cell), the
cells' offsets are prefix sums of those counts, and only a cell is numbered at once.

Defined results: a null text has size 1 and crc32 0 and forms a group of its own, apart from the empty text; repeated
rows get slots of their own; no rows in, no rows out; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS, SLOT_BITS, STEP_BITS, CELL_ROWS = 8, 16, 8, 20_000

#: A greedy fill at a capacity {c}: sizes is an ordered array of structs (atom, bytes, one: is a single group).
_FILL = "aggregate(sizes, struct(0L as used, 1 as n, cast(array() as array<bigint>) as cuts), (a, x) -> if(a.used + x.bytes > {c}, struct(x.bytes as used, a.n + 1 as n, array_append(a.cuts, x.atom) as cuts), struct(a.used + x.bytes as used, a.n as n, a.cuts as cuts)), a -> a.{out})"
#: The same, where ranges of several groups may be divided anywhere: what does not fit fills further shards.
_POUR = "aggregate(sizes, struct(0L as used, 1 as n, cast(array() as array<bigint>) as cuts), (a, x) -> if(a.used + x.bytes <= {c}, struct(a.used + x.bytes as used, a.n as n, a.cuts as cuts), if(x.one, struct(x.bytes as used, a.n + 1 as n, array_append(a.cuts, x.atom) as cuts), struct((a.used + x.bytes - 1) % {c} + 1 as used, a.n + cast((a.used + x.bytes - 1) div {c} as int) as n, concat(a.cuts, array_repeat(x.atom, cast((a.used + x.bytes - 1) div {c} as int))) as cuts))), a -> a.{out})"
_COUNT = "aggregate(sizes, struct(0L as used, 1 as n), (a, x) -> if(a.used + x.bytes > {c}, struct(x.bytes as used, a.n + 1 as n), struct(a.used + x.bytes as used, a.n as n)), a -> a.n)"
_COUNT_POURED = "aggregate(sizes, struct(0L as used, 1 as n), (a, x) -> if(a.used + x.bytes <= {c}, struct(a.used + x.bytes as used, a.n as n), if(x.one, struct(x.bytes as used, a.n + 1 as n), struct((a.used + x.bytes - 1) % {c} + 1 as used, a.n + cast((a.used + x.bytes - 1) div {c} as int) as n))), a -> a.n)"
_SEARCH = "aggregate(sequence(1, 64), struct(cast({lo} as bigint) as lo, cast({hi} as bigint) as hi), (s, k) -> if(s.lo >= s.hi, s, if({needed} <= {shards}, struct(s.lo as lo, (s.lo + s.hi) div 2 as hi), struct((s.lo + s.hi) div 2 + 1 as lo, s.hi as hi))), s -> s.lo)"


def minimax_cuts(atoms: DataFrame, shards: int) -> DataFrame:
    """From (atom bigint, bytes bigint, one boolean), one row (capacity, cuts, least, early, late).

    capacity: the least at which whole atoms fill the shards; each cut is the first atom of another shard. least: a
    capacity that is needed even if atoms that are not one group are divided. early and late: the first and last atom in
    which each cut may lie at capacities between the two.
    """
    one = atoms.agg(F.array_sort(F.collect_list(F.struct("atom", "bytes", "one"))).alias("sizes"), F.max("bytes").alias("largest"), F.max(F.when(F.col("one"), F.col("bytes")).otherwise(1)).alias("unit"), F.sum("bytes").alias("total"))
    share = f"(total + {shards - 1}) div {shards}"
    middle = "(s.lo + s.hi) div 2"
    one = one.withColumn("capacity", F.expr(_SEARCH.format(lo=f"greatest(largest, {share})", hi=f"greatest(largest, {share}) + largest", needed=_COUNT.format(c=middle), shards=shards)))
    one = one.withColumn("least", F.expr(_SEARCH.format(lo=f"greatest(unit, {share})", hi="capacity", needed=_COUNT_POURED.format(c=middle), shards=shards)))
    return one.select("capacity", "least", *[F.expr(how.format(c=c, out="cuts")).alias(n) for n, how, c in (("cuts", _FILL, "capacity"), ("early", _FILL, "least"), ("late", _POUR, "capacity"))])


def shard_cuts(groups: DataFrame, shards: int, slot_bits: int = SLOT_BITS, step_bits: int = STEP_BITS) -> tuple[int, list[int]]:
    """(capacity, cuts) of rows (place bigint, size bigint), rows of one place being one group: each cut is the first place of another shard."""
    finer: list[tuple[int, list[tuple[int, int]]]] = []  # (bits that are left, ranges of places)
    left = 64 - slot_bits
    cut_to = lambda bits: F.shiftleft(F.shiftright("place", bits), bits)
    while True:
        atom = cut_to(64 - slot_bits)
        for bits, ranges in finer:
            within = F.lit(False)
            for a, b in ranges:
                within = within | F.col("place").between(a, b)
            atom = F.when(within, cut_to(bits)).otherwise(atom)
        atoms = groups.groupBy(atom.alias("atom")).agg(F.sum("size").alias("bytes"), (F.min("place") == F.max("place")).alias("one"))
        found = minimax_cuts(atoms, shards).head()
        if found["capacity"] is None or found["capacity"] == found["least"] or left == 0:
            return found["capacity"] or 0, list(found["cuts"] or [])  # at most shards - 1 numbers
        late = found["late"]
        pairs = [(a, late[k] if k < len(late) else a) for k, a in enumerate(found["early"][: shards - 1])]
        widest = (1 << (64 - slot_bits)) - 1
        left = max(0, left - step_bits)
        finer.append((left, [(min(a, b), min(max(a, b) + widest, (1 << 63) - 1)) for a, b in pairs]))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slot_bits: int = SLOT_BITS, step_bits: int = STEP_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is bytes)."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.when(text.isNull(), F.lit(-(1 << 63))).otherwise(F.xxhash64(text)).alias("place"),
    )
    slim = written(slim, "shard-sizes")
    n_rows = slim.count()
    _, cuts = shard_cuts(slim.select("place", "size"), shards, slot_bits, step_bits)
    t = slim.withColumn("shard", sum((F.when(F.col("place") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int"))
    cells = max(1, -(-n_rows // CELL_ROWS))
    t = t.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)))
    counts = t.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    t = t.join(counts, ["shard", "cell"])
    slot = F.col("before") + F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return t.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
