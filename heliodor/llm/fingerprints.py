"""Document fingerprints by one-permutation MinHash. DataFrame and SQL functions only.

A text's shingles of five words (fewer words: the whole sequence) are hashed once. The hash's high byte names one of
256 bins, and each bin keeps its least hash. An empty bin takes the value of the first filled bin on a probe path of
its own, (start + j * step) mod 256 with an odd step, so every path visits all bins and densification always ends
(optimal densification). Each bin hashes its value with its number, so that bins filled from the same value differ by
chance independently, and keeps the lowest 4 bits: 16 bins in a bigint, written as 256 hex digits.

The likeness of two fingerprints is the share of equal bins with the chance of equal low bits taken out:
(share - 1/16) / (1 - 1/16), at least 0; it estimates the Jaccard similarity of the shingle sets.

All of a text's work is one expression on its row. Only the pairing of a document with the next by doc_id shuffles,
once: documents are dealt into ranges of doc_id (splits from an approximate percentile; they balance work only), and
the first document of each range is also sent to the range before it, the very first to the last.

Defined results: a null text is empty; an empty text or one without words has the empty fingerprint, like (1) another
empty one and unlike (0) all others; equal doc_ids stand in the order of their texts' hashes and null doc_ids first; a
sole document is its own next; other columns are not read; no rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Callable
from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, range_bucket, range_splits

SHINGLE, BINS, BITS, ROUNDS = 5, 256, 4, 4
_LOW = (1 << 56) - 1
_NIBBLE_ONES = 0x1111111111111111


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _probes(seed: int = 5) -> tuple[list[int], list[int], list[int]]:
    """For every bin: where its probe path starts, its odd step, and the step's inverse mod BINS."""
    random = Random(seed)
    starts = [random.randrange(BINS) for _ in range(BINS)]
    steps = [2 * random.randrange(BINS // 2) + 1 for _ in range(BINS)]
    return starts, steps, [pow(s, -1, BINS) for s in steps]


def _ints(values: list[int], kind: str = "int") -> Column:
    return F.expr(f"array({', '.join(map(str, values))})").cast(f"array<{kind}>")


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of a text's n-word shingles, repeats included; of all its words if there are fewer; none without words."""

    def of_words(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, each).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \x09-\x0D]+"), lambda x: x != ""), of_words)


def _bins(hashes: Column) -> Column:
    """The least hash of each bin, null where a bin is empty: marks at the bins' lower bounds are sorted in among the hashes."""
    marks = F.expr(f"transform(sequence(-128L, 127L), b -> shiftleft(b, 56))")  # noqa: F541

    def pick(s: Column) -> Column:
        is_mark = lambda x: x.bitwiseAND(F.lit(_LOW)) == 0
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: is_mark(F.get(s, i)))
        return F.transform(at, lambda i: F.when(is_mark(F.get(s, i + 1)), F.lit(None)).otherwise(F.get(s, i + 1)))

    return let(F.sort_array(F.concat(hashes, marks)), pick)


def _densified(filled: Column) -> Column:
    starts, steps, inverses = _probes()

    def go(v: Column) -> Column:
        def round_of(now: Column, j: int) -> Column:
            path = _ints([(a + j * s) % BINS for a, s in zip(starts, steps, strict=True)])
            return F.transform(now, lambda x, b: F.coalesce(x, F.get(v, F.get(path, b))))

        def rest(now: Column) -> Column:
            """Bins still empty after the first probes: the filled bin that comes first on the path, found from the filled bins."""

            def with_full(full: Column) -> Column:
                a, inv = _ints(starts), _ints(inverses)

                def first(b: Column) -> Column:
                    place = lambda f: F.shiftleft(((f - F.get(a, b)) * F.get(inv, b)).bitwiseAND(F.lit(BINS - 1)), 8).bitwiseOR(f)
                    return F.get(v, F.array_min(F.transform(full, place)).bitwiseAND(F.lit(BINS - 1)))

                return F.transform(now, lambda x, b: F.when(x.isNotNull(), x).otherwise(first(b)))

            return let(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(v, b).isNotNull()), with_full)

        full = lambda x: F.size(F.array_compact(x)) == BINS
        stage = lambda now, j: rest(now) if j == ROUNDS else let(round_of(now, j), lambda x: F.when(full(x), x).otherwise(stage(x, j + 1)))
        return F.when(full(v), v).when(F.size(F.array_compact(v)) < BINS // 8, rest(v)).otherwise(stage(v, 0))

    return let(filled, go)


def packed_fingerprint(text: Column, n: int = SHINGLE) -> Column:
    """BINS * BITS / 64 bigints; an empty array for a text without words."""
    per = 64 // BITS

    def pack(v: Column) -> Column:
        def word(k: Column) -> Column:
            out = F.get(v, k * per).bitwiseAND(F.lit((1 << BITS) - 1))
            for i in range(1, per):
                out = out.bitwiseOR(F.shiftleft(F.get(v, k * per + i).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * i))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), word)

    return let(shingle_hashes(text, n), lambda h: F.when(F.size(h) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(let(F.transform(_densified(_bins(h)), lambda x, b: F.xxhash64(x, b)), pack)))


def fingerprint_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The bias-corrected share of equal bins of two packed fingerprints."""

    def odd(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        some = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(some.bitwiseAND(F.lit(_NIBBLE_ONES)))

    unlike = F.aggregate(F.zip_with(a, b, odd), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    share = (F.lit(1.0) - unlike / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), share))


def with_next(t: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the next row by (doc_id, hash of the text), the first row's after the last; t has doc_id and text."""
    splits = range_splits(t, "doc_id", 4 * parts_for(t))
    t = t.withColumns({"_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "_hash": F.xxhash64("text")})
    # rows without an id stand first, in the order of their hashes, whose high bits give as many even ranges
    spot = F.when(F.col("doc_id").isNull(), F.shiftright("_hash", 58).cast("int") - 64).otherwise(range_bucket(F.col("doc_id"), splits))
    firsts = t.select("_id", "_hash", spot.alias("spot")).groupBy("spot").agg(F.min(F.struct("_id", "_hash")).alias("first"))
    before = F.coalesce(F.lag("spot").over(Window.orderBy("spot")), F.max("spot").over(Window.partitionBy()))
    firsts = firsts.select(F.col("first._id").alias("_id"), F.col("first._hash").alias("_hash"), before.alias("before"))  # at most as many rows as there are ranges
    t = t.withColumn("spot", spot).join(F.broadcast(firsts), ["_id", "_hash"], "left")
    own, guest = F.struct("spot", F.lit(False).alias("guest")), F.struct(F.col("before").alias("spot"), F.lit(True).alias("guest"))
    t = t.withColumn("place", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest)))).drop("spot", "before")
    t = t.withColumns({"spot": F.col("place.spot"), "guest": F.col("place.guest")}).drop("place")
    order = Window.partitionBy("spot").orderBy("guest", "_id", "_hash")
    t = t.withColumns({f"next_{c}": F.coalesce(F.lead(c).over(order), F.col(c)) for c in columns})
    return t.filter(~F.col("guest")).drop("spot", "guest", "_id", "_hash")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(doc_id, text, packed): every document's fingerprint."""
    t = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return t.withColumn("packed", packed_fingerprint(F.col("text"), n))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the beginning of the next document."""
    t = with_next(fingerprint_documents(docs, id_col, text_col), ["text", "packed"])
    t = t.withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.expr("cast(n_chars div 2 as int)")
    t = t.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.expr("cast(n_chars - n_chars div 2 as int)")), F.substring(F.col("next_text"), F.lit(1), half)))
    t = t.select("doc_id", "n_chars", "packed", "next_packed", F.sha2("edited", 256).alias("edited_sha256"), packed_fingerprint(F.col("edited")).alias("edited_packed"))
    return t.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_text(F.col("packed")).alias("fingerprint"), fingerprint_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"), likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
