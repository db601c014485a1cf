"""MinHash near-copies: universal minima, bands, signatures, confirmed links and their components.

1. Minima. A document is the set of its n-word shingles in lower case; texts of one set are one point, named after its
   smallest doc_id. BANDS x ROWS universal hashes (multiply, add, shift) each give their least value over the set. A band's
   ROWS minima are one key: sets of a similarity of 0.8 miss each other in all 40 bands with a probability of 6e-6.
   The last byte of each minimum makes up the signature.
2. Bands. Points that share a key are a group, named after its smallest id; groups of one name are one. A point is
   first compared with the heads of its groups by signatures; pairs that agree in fewer places than a similarity of
   0.8 would, less five standard deviations, are let go.
3. Confirmation. Each point's first head that is left is held against it on the full sets, and linked points get
   a common label (connected components by alternating stars).
4. Rest. Only groups whose points still have several labels go on: in pairs of slices, of which those of the group's commonest
   label do not meet each other; pairs of points of different labels are compared by signatures, then on the full sets. So
   no pair of points that share a key is left out but those that are connected already, and a group of copies
   moves about once, not once for each pair.

Skew: copies are one point, rows of hot keys are dealt to many tasks (`spread_join`), groups of any size are cut into
slices. Texts move only for points that share a key. Broadcast: up to BROADCAST_IDS ids, else the same join shuffles.

Defined results: null, empty and wordless texts have no shingles, link with nothing and are their own component; rows of
one doc_id are one document, in one component; a null doc_id links with nothing, has a null component and is
kept; no rows in, no rows out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, mix, spread_join, text_bytes, word_hashes, written
from .components import components
from .jaccard import PAIRS, SLICE, _batch, _light, _slice_pairs, linked, shingle_set

BANDS, ROWS = 40, 6
SIGNED = "doc_id bigint, n_shingles bigint, set_hash binary, bands array<bigint>, signature binary"
_draw = np.random.default_rng(0x5EED)
_A = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_B = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set of 64-bit hashes, of which the upper halves are hashed."""
    x, out = s >> np.uint64(32), np.full(len(_A), np.uint64(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 1024):
            values = np.multiply(_A[:, None], x[None, k : k + 1024])
            values += _B[:, None]
            out = np.minimum(out, values.min(axis=1) >> np.uint64(32))
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows, out = m.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out


def least_agreement(num: int, den: int) -> int:
    """In how many places of their signatures linked sets agree, less five standard deviations."""
    t, places = num / den, BANDS * ROWS
    return int(places * t - 5 * (places * t * (1 - t)) ** 0.5)


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cache = word_hashes()
        for batch in batches:
            sizes, hashes, bands, signatures = [], [], [], []
            for text in text_bytes(batch.column(1)):
                s = shingle_set(text, n, cache)
                m = minima(s)
                sizes.append(len(s))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_keys(m).view(np.int64) if len(s) else np.empty(0, np.int64))
                signatures.append((m & np.uint64(255)).astype(np.uint8).tobytes() if len(s) else b"")
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in bands])]).astype(np.int32)
            flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(signatures, pa.binary())], names=[c.split()[0] for c in SIGNED.split(", ")])

    return run


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, BANDS * ROWS)


def _agree(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Rows (a, b, signature of a, of b): those whose signatures agree often enough."""
        for batch in batches:
            x, y = (_signatures(batch.column(k).to_pylist()) for k in (2, 3))
            good = pa.array((x == y).sum(axis=1) >= least_agreement(num, den))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in (0, 1)], schema=PAIRS)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns[:-1]), text_bytes(batch.columns[-1]), strict=True)


def _confirm(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Rows (head, slice, member, id, text), a head's own rows first in each slice, to links (a, b)."""
        cache = word_hashes()
        for (head, _), group in groupby(_rows(batches), key=lambda r: r[:2]):
            heads, out = [], []
            for _, _, member, key, text in group:
                s = shingle_set(text, n, cache)
                if not member:
                    heads.append(s)
                elif any(linked(s, h, num, den) for h in heads):
                    out.append((key, head))
            yield _batch(out)

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. The text of b is sent once for each slice of its partners."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(pairs.groupBy("b").agg(F.count("*").alias("n")), "heads")
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    members = spread_join(pairs, counts, ["b"], "n").select(F.col("b").alias("head"), F.pmod(F.xxhash64("a"), slices).cast("int").alias("slice"), F.lit(True).alias("member"), F.col("a").alias("id"))
    heads = counts.select(F.col("b").alias("head"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(False).alias("member"), F.col("b").alias("id"))
    t = members.unionByName(heads).join(texts.select("id", "text"), "id")
    t = t.repartition(parts, "head", "slice").sortWithinPartitions("head", "slice", "member", "id").select("head", "slice", "member", "id", "text")
    return map_arrow(t, _confirm(n, num, den), "a bigint, b bigint")


def close_pairs(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Places of rows of different labels whose signatures agree in at least so many places."""
    for k in range(0, len(a), 32):
        same = (a[k : k + 32, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int16)
        x, y = np.nonzero((same >= least) & (la[k : k + 32, None] != lb))
        yield from zip((x + k).tolist(), y.tolist(), strict=True)


def _meet(n: int, num: int, den: int):
    least = least_agreement(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Rows (region, sa, sb, slice, id, label, signature, text), pairs of slices together, to links that connect all that link."""
        cache = word_hashes()
        for (_, sa, sb), group in groupby(_rows(batches), key=lambda r: r[:3]):
            above: dict[int, int] = {}

            def find(x: int) -> int:
                while above.setdefault(x, x) != x:
                    above[x] = x = above[above[x]]
                return x

            rows = list(group)
            left, right = ([r for r in rows if r[3] == s and r[6]] for s in (sa, sb))
            out, sets = [], {}
            if left and right:
                sides = [x for side in (left, right) for x in (_signatures([r[6] for r in side]), np.array([r[5] for r in side], np.int64))]
                for x, y in close_pairs(*sides, least):
                    p, q = left[x], right[y]
                    if find(p[5]) != find(q[5]):
                        a, b = (sets[k] if k in sets else sets.setdefault(k, shingle_set(r[7], n, cache)) for k, r in (((0, x), p), ((1, y), q)))
                        if linked(a, b, num, den):
                            above[find(p[5])] = find(q[5])
                            out.append((p[4], q[4]))
            yield _batch(out)

    return run


def minhash_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; documents that share a band link when den * common >= num * union."""
    if not 4 * den <= 5 * num <= 5 * den:
        raise ValueError("the bands are made for similarities of 0.8 and more")
    t = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = written(map_arrow(t, _sign(n), SIGNED), "signatures")
    known = "doc_id is not null and n_shingles > 0"
    slim = written(signed.select("doc_id", "n_shingles", "set_hash"), "set-hashes")
    points = written(slim.filter(known).groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")), "points")
    links = []
    # rows of one doc_id with different sets, wordless ones too
    kind = F.xxhash64("set_hash", "n_shingles")
    again = slim.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(kind).alias("a"), F.max(kind).alias("b"))
    again = written(again.filter("rows > 1"), "repeated-ids")
    several = again.filter("a <> b").select("doc_id", "rows")
    if not several.isEmpty():
        same = spread_join(slim.filter(known), several, ["doc_id"], "rows").select("doc_id", "set_hash").distinct()
        links.append(written(same.join(points, "set_hash").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct(), "repeated-links"))
    copies = spread_join(slim.filter(known), points.filter("rows > 1"), ["set_hash"], "rows").filter("doc_id <> id").select("doc_id", "set_hash").distinct()
    copies = written(copies, "copies")
    single = signed.filter(known).join(_light(copies), ["doc_id", "set_hash"], "left_anti").withColumnRenamed("doc_id", "id")

    banded = single.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("region")).filter("rows > 1")
    rows = written(spread_join(banded, written(shared, "shared-keys"), ["key"], "rows").select("region", "id").distinct(), "groups")
    wanted = written(rows.select("id").distinct(), "candidates")
    cards = written(single.join(_light(wanted), "id", "left_semi").select("id", "signature").distinct(), "cards")
    texts = t.withColumnRenamed("doc_id", "id").join(_light(wanted), "id", "left_semi")
    if not again.isEmpty():
        twice = _light(again.select(F.col("doc_id").alias("id")))
        texts = texts.join(twice, "id", "left_anti").unionByName(texts.join(twice, "id", "left_semi").distinct())
    texts = written(texts, "candidate-texts")
    discard(signed)

    heads = rows.groupBy("region").agg(F.count("*").alias("rows"))
    heads = written(heads.join(cards.select(F.col("id").alias("region"), F.col("signature").alias("theirs")), "region"), "heads")
    stars = spread_join(rows.filter("id <> region"), heads, ["region"], "rows").join(cards, "id").select(F.col("id").alias("a"), F.col("region").alias("b"), "signature", "theirs")
    stars = written(map_arrow(stars, _agree(num, den), "a bigint, b bigint").distinct(), "stars")
    first = written(stars.groupBy("a").agg(F.min("b").alias("b")), "first-stars")
    links.append(written(confirmed(first, texts, n, num, den), "links"))
    labels = components(reduce(DataFrame.unionByName, links))

    named = rows.join(labels, "id", "left").select("region", "id", F.coalesce("label", "id").alias("label"))
    named = written(named, "named-groups")
    open_ = named.groupBy("region").agg(F.count("*").alias("rows"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
    hopeful = stars.select(F.col("b").alias("region")).distinct()
    pairs = open_.filter("rows = 2").join(hopeful, "region", "left_semi")
    open_ = written(open_.filter("rows > 2").unionByName(pairs).select("region", "rows"), "open-groups")
    if not open_.isEmpty():
        left = written(spread_join(named, open_, ["region"], "rows").select("region", "id", "label", F.lit(True).alias("own")), "open-points")
        parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = _slice_pairs(left).join(cards, "id").join(texts, "id").repartition(parts, "region", "sa", "sb").sortWithinPartitions("region", "sa", "sb", "slice", "id")
        found = map_arrow(met.select("region", "sa", "sb", "slice", "id", "label", "signature", "text"), _meet(n, num, den), "a bigint, b bigint")
        links.append(written(found, "links"))
        labels = components(reduce(DataFrame.unionByName, links))

    label = points.join(labels, "id", "left").select("set_hash", "rows", F.coalesce("label", "id").alias("component_id"))
    worded = spread_join(slim.filter(known), written(label, "components"), ["set_hash"], "rows").select("doc_id", "n_shingles", "component_id")
    others = slim.filter(f"not ({known})").join(labels, F.col("doc_id") == F.col("id"), "left")
    out = worded.unionByName(others.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
