"""N-gram Jaccard join in the metric space of shingle sets, exact, with its connected components.

Jaccard distance 1 - J is a metric, and two documents link when it is at most `eps` (given as a ratio of integers).
Texts of one shingle set are one point.

1. Top regions. At distances near 1 no pivot separates points (nearly all pairs of documents are at exactly 1, so every
   window would be the whole space). The first cut is therefore by tokens that linked points must share: a set's hashes
   are cut into buckets of the hash range, and a bucket's whole content is one token. Linked sets differ in at most
   tau = |A| (1 - t) / t hashes, hence in at most tau tokens, so by the prefix argument the first tau + 1 tokens of each,
   in a common order, have one in common. In this order tokens that very many points would offer stand last (HOT_KEY, at most
   HOT_KEYS of them, found by counting what is offered, again with the hot ones last, until no new ones come up), and fuller
   buckets first, as they are rarer. The number of buckets depends on a size class; a set gives tokens for its own class and for that of its largest possible partner. The argument fails
   only where both sets have fewer than tau + 1 filled buckets; such thin sets also give the first tau + 1 of their
   single hashes, of which two linked ones have one in common. Small sets give single hashes only. All points that share
   a token, named after their smallest id, are a top region, so each linked pair is inside one.
2. Voronoi cells. A region takes pivots among its points; distances to all pivots are computed exactly; a point belongs
   to the cell of its nearest pivot.
3. Windows. If a point y of another cell links with some x of p's cell, d(y, p) <= d(y, nearest) + 2 eps; such boundary
   points are copied into p's cell (into that of the smaller pivot of the two only, as once is enough). Two points that
   only visit a cell meet elsewhere; points whose distances to p differ by more than eps cannot link.
4. Recursion. Points within eps of their pivot link with it and bear its label, as do pivots that link; a cell whose points all have one label
   is done, any other is a region again. Regions of up to FIT_POINTS points and FIT_SHINGLES shingles are finished in
   one task by the same recursion in memory, down to leaves of LEAF points compared by their sets. Larger ones
   take a distributed round: slices of SLICE points, each with the region's pivots, give rows of smaller regions.
5. Where pivots do not separate (cells keep most of their region, as among unlike texts that share one hot shingle),
   the region is joined as it is: in pairs of slices. A first pass moves sketches only, bits for 2,048 ranges of hashes of
   which one hash changes at most one, and thins by labels, sizes and sketches; texts move for points that are left with a
   partner, and are compared by their sets.

Every linked pair is compared or has one label already, so the components are exact. Distances are computed from whole
texts as sets of 64-bit shingle hashes. Skew: copies are one point; rows of a hot token or class are dealt to many tasks
(`spread_join`); regions of any size are cut into slices. Steps are written to the shared folder. Broadcast: up to
BROADCAST_IDS ids, beyond which the same joins shuffle.

Defined results: null, empty and wordless texts have no shingles, link with nothing and are their own component; rows of
one doc_id are one document, in one component, whatever their texts; a null doc_id links with nothing and has a null
component; no rows in, no rows out; other columns are not read.
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

from .common import discard, gram_hashes, hash_array, map_arrow, mix, split_words, spread_join, text_bytes, word_hashes, written
from .components import components

LEAST_CLASS, SLICE, BROADCAST_IDS, SKETCH = 16, 2_000, 1_000_000, 2048
#: A task finishes regions of up to so many points and shingles; a region takes about PIVOTS pivots.
FIT_POINTS, FIT_SHINGLES, FEW, LEAF, PIVOTS = 2_000, 2_000_000, 16, 24, 24
#: A token that more points offer is hot; so many of the hottest stand last in the order; after so many rounds of counting the order stays.
HOT_KEY, HOT_KEYS, HOT_ROUNDS = 2_000, 50_000, 6
SIGNED = "doc_id bigint, n_shingles bigint, set_hash binary, keys array<bigint>, cuts array<int>"
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: bytes, n: int, cache: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles in lower case (A-Z only); of the whole sequence if it is shorter."""
    words = split_words(text.translate(_UPPER))
    if not words:
        return np.empty(0, np.uint64)
    h = hash_array(words, cache)
    return np.unique(gram_hashes(h, n) if len(words) >= n else gram_hashes(h, len(words)) + np.uint64(len(words)))


# signatures


def most_different(size: int, num: int, den: int) -> int:
    """How many hashes of a set of this size and a linked one lie in only one of the two, at most."""
    return size * (den - num) // num


def size_class(size: int) -> int:
    return -1 if size < LEAST_CLASS else (size // LEAST_CLASS).bit_length() - 1


def token_lists(s: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, int]]:
    """Lists of tokens of a sorted hash set, in order, each with the number of its first ones that go into the signature."""
    n, out = len(s), []
    tau = most_different(n, num, den)
    single = False
    for c in {size_class(n), size_class(n * den // num)}:
        if c < 0:
            single = True
            continue
        most = most_different(LEAST_CLASS << (c + 1), num, den)
        m = most * 5 // 4 + min(most, 16) + 4
        bucket = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
        fill = np.diff(np.append(starts, n))
        with np.errstate(over="ignore"):
            tokens = mix(np.add.reduceat(mix(s), starts) + bucket[starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c + 1))
        out.append((tokens[np.lexsort((tokens, -fill))], tau + 1))
        single |= len(tokens) <= tau
    if single:
        out.append((np.sort(mix(s ^ np.uint64(0x5EED))), tau + 1))
    return out


def first_tokens(lists: list[tuple[np.ndarray, int]], hot: np.ndarray) -> np.ndarray:
    """The signature's tokens: the first of each list, hot ones last."""
    if len(hot):
        last = [np.isin(t, hot) for t, _ in lists]
        lists = [(np.concatenate([t[~h], t[h]]), k) for (t, k), h in zip(lists, last, strict=True)]
    return np.concatenate([t[:k] for t, k in lists])


def signature_keys(s: np.ndarray, num: int, den: int, hot: np.ndarray = np.empty(0, np.uint64)) -> np.ndarray:
    """Tokens of a sorted hash set, of which two linked sets have one in common."""
    return first_tokens(token_lists(s, num, den), hot)


def _lists(values: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, kind)))


def _sign(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Sizes, set hashes and token lists; cuts has the length of each list and how many of it are used."""
        cache = word_hashes()
        for batch in batches:
            sizes, hashes, keys, cuts = [], [], [], []
            for text in text_bytes(batch.column(1)):
                s = shingle_set(text, n, cache)
                sizes.append(len(s))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
                lists = token_lists(s, num, den) if len(s) else []
                keys.append(np.concatenate([t for t, _ in lists]).view(np.int64) if lists else np.empty(0, np.int64))
                cuts.append(np.array([x for t, k in lists for x in (len(t), k)], np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), _lists(keys, np.int64), _lists(cuts, np.int32)], names=["doc_id", "n_shingles", "set_hash", "keys", "cuts"])

    return run


def _offered(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Rows (id, size, keys, cuts) to their signatures' tokens."""
        for batch in batches:
            keys, cuts = batch.column(2), batch.column(3)
            flat, at = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64), 0
            out = []
            for lengths in cuts.to_pylist():
                lists = []
                for size, used in zip(lengths[::2], lengths[1::2], strict=True):
                    lists.append((flat[at : at + size], used))
                    at += size
                out.append(first_tokens(lists, hot).view(np.int64) if lists else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(out, np.int64)], names=["id", "size", "keys"])

    return run


def offered_tokens(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (id, size, key), shared keys (key, rows, region)) of points (id, size, keys, cuts); hot tokens stand last in all lists.

    What reaches the driver are at most HOT_KEYS tokens in all, whatever the rows; any order that is the same for all points is right.
    """
    hot = np.empty(0, np.uint64)
    for left in reversed(range(HOT_ROUNDS)):
        tokens = map_arrow(single, _offered(hot), "id bigint, size bigint, keys array<bigint>").select("id", "size", F.explode("keys").alias("key"))
        shared = written(tokens.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("region")).filter("rows > 1"), "shared-tokens")
        room = HOT_KEYS - len(hot)
        if not left or room <= 0:
            break
        new = [r["key"] for r in shared.filter(F.col("rows") > HOT_KEY).orderBy(F.desc("rows"), "key").limit(room + len(hot)).collect()]
        grown = np.union1d(hot, np.array(new, np.int64).view(np.uint64))
        if len(grown) == len(hot):
            break
        hot = grown[:HOT_KEYS] if len(grown) > HOT_KEYS else grown
        discard(shared)
    return tokens, shared


# the metric


def overlaps(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set shares with each pivot: the pivots' hashes are one sorted table of (hash, owner)."""
    k = len(pivots)
    hashes, owner = np.concatenate(pivots), np.repeat(np.arange(k), [len(p) for p in pivots])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    values, first, count = np.unique(hashes, return_index=True, return_counts=True)
    out = np.zeros((len(sets), k), np.int64)
    lengths = np.array([len(s) for s in sets])
    chunk = np.cumsum(lengths) // 200_000  # bounds the working arrays, however many sets
    for c in np.unique(chunk):
        rows = np.flatnonzero(chunk == c)
        flat, of = np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), lengths[rows])
        spot = np.minimum(np.searchsorted(values, flat), max(0, len(values) - 1))
        hit = values[spot] == flat if len(values) else np.zeros(len(flat), bool)
        spot, of = spot[hit], of[hit]
        n = count[spot]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owners = owner[np.repeat(first[spot], n) + inside]
        out[rows] = np.bincount(np.repeat(of, n) * k + owners, minlength=len(rows) * k).reshape(len(rows), k)
    return out


def distances(sets: list[np.ndarray], pivots: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, linked) of each set to each pivot; no set is empty."""
    common = overlaps(sets, pivots)
    union = np.array([len(s) for s in sets])[:, None] + np.array([len(p) for p in pivots]) - common
    return 1 - common / union, den * common >= num * union


def cells(d: np.ndarray, pivot_ids: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot of each point, whether the point is in the cell of each pivot, its own or as a boundary point)."""
    order = np.argsort(pivot_ids, kind="stable")
    rank = np.argsort(order)
    nearest = order[d[:, order].argmin(axis=1)]
    least = d[np.arange(len(d)), nearest]
    inside = (d <= least[:, None] + 2 * (den - num) / den + 1e-9) & (rank[None, :] < rank[nearest][:, None])
    inside[np.arange(len(d)), nearest] = True
    return nearest, inside


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), SKETCH), np.uint8)
    for row, s in zip(out, sets, strict=True):
        row[(s % np.uint64(SKETCH)).astype(np.int64)] = 1
    return out


def close_pairs(a: tuple, b: tuple, num: int, den: int) -> list[tuple[int, int]]:
    """Places (in a, in b) of points that may link. Each side: labels, sizes, sketches as 0/1 rows of floats."""
    (la, na, sa), (lb, nb, sb) = a, b
    out = []
    useful = np.flatnonzero(~((lb.min() == lb.max()) & (la == lb[0])))  # rows of a with a partner of another label
    fa, fb = sa.sum(axis=1), sb.sum(axis=1)
    for k in range(0, len(useful), 512):
        rows = useful[k : k + 512]
        unlike = fa[rows][:, None] + fb - 2 * (sa[rows] @ sb.T)
        sizes = na[rows][:, None] + nb
        good = (la[rows][:, None] != lb) & (unlike * (den + num) <= sizes * (den - num) + 0.5)
        good &= den * np.minimum(na[rows][:, None], nb) >= num * np.maximum(na[rows][:, None], nb)
        x, y = np.nonzero(good)
        out += zip(rows[x].tolist(), y.tolist(), strict=True)
    return out


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if den * len(small) < num * len(large) or not len(small):
        return False
    spot = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[spot] == small).sum())
    return den * common >= num * (len(a) + len(b) - common)


class Region:
    """Points of a region that fits in a task, joined by recursion. `links` are enough of its links to connect all that link."""

    def __init__(self, ids: list[int], labels: list[int], own: list[bool], sets: list[np.ndarray], num: int, den: int):
        self.ids, self.sets, self.num, self.den = np.array(ids, np.int64), sets, num, den
        self.sizes = np.array([len(s) for s in sets])
        self.links: list[tuple[int, int]] = []
        self.above: dict[int, int] = {}
        self.label = [self.find(x) for x in labels]
        for k, x in zip(ids, labels, strict=True):
            self.join(k, x)
        self.solve(np.arange(len(ids)), np.array(own, bool))

    def find(self, x: int) -> int:
        above = self.above
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b

    def link(self, i: int, j: int) -> None:
        a, b = int(self.ids[i]), int(self.ids[j])
        if self.join(a, b):
            self.links.append((a, b))

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return np.array([self.find(x) for x in self.ids[rows].tolist()], np.int64)

    def compare(self, pairs: Iterable[tuple[int, int]]) -> None:
        for i, j in pairs:
            if self.find(int(self.ids[i])) != self.find(int(self.ids[j])) and linked(self.sets[i], self.sets[j], self.num, self.den):
                self.link(i, j)

    def solve(self, rows: np.ndarray, own: np.ndarray) -> None:
        """Join the points at `rows`; two that are not the region's own need not be compared."""
        todo = [(rows, own)]
        while todo:
            rows, own = todo.pop()
            roots = self.roots(rows)
            if len(rows) < 2 or (roots == roots[0]).all():
                continue
            if len(rows) <= LEAF:
                self.compare((i, j) for x, i in enumerate(rows.tolist()) for y, j in enumerate(rows[:x].tolist()) if own[x] or own[y])
                continue
            chosen = rows[np.argsort(mix(self.ids[rows].view(np.uint64)), kind="stable")[: min(PIVOTS, int(len(rows) ** 0.5))]]
            d, near = distances([self.sets[r] for r in rows], [self.sets[r] for r in chosen], self.num, self.den)
            for x, y in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
                self.link(rows[x], chosen[y])
            nearest, inside = cells(d, self.ids[chosen], self.num, self.den)
            counts = inside.sum(axis=0)
            if counts.sum() > 4 * len(rows) or counts.max() > 0.8 * len(rows):
                bits = sketches([self.sets[r] for r in rows]).astype(np.float32)
                side = (self.roots(rows), self.sizes[rows], bits)
                self.compare((rows[x], rows[y]) for x, y in close_pairs(side, side, self.num, self.den) if x < y and (own[x] or own[y]))
                continue
            for k in range(len(chosen)):
                at = np.flatnonzero(inside[:, k])
                todo.append((rows[at], nearest[at] == k))


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], schema=PAIRS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns[:-1]), text_bytes(batch.columns[-1]), strict=True)


def _solve(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Rows (region, id, label, own, text), whole regions together, to links (a, b)."""
        cache, out = word_hashes(), []
        for _, group in groupby(_rows(batches), key=lambda r: r[0]):
            _, ids, labels, own, texts = zip(*group, strict=True)
            sets = [shingle_set(t, n, cache) for t in texts]
            keep = [k for k, s in enumerate(sets) if len(s)]  # a repeated doc_id may have a wordless text too
            pick = lambda values: [values[k] for k in keep]
            out += Region(pick(ids), pick(labels), pick(own), pick(sets), num, den).links
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return run


ASSIGNED = "region bigint, pivot bigint, id bigint, label bigint, size bigint, own boolean, linked boolean"


def _assign(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Rows (region, slice, member, id, label, text), the pivots of a region first in each of its slices, to rows of its cells."""
        cache = word_hashes()

        def names(pivots: list) -> list[int]:
            """The smallest pivot that each pivot is linked with through pivots: the same in every slice."""
            ids = [p[0] for p in pivots]
            _, near = distances([p[1] for p in pivots], [p[1] for p in pivots], num, den)
            name = list(ids)
            for x, y in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
                a, b = sorted((name[x], name[y]))
                name = [a if k == b else k for k in name]
            return name

        def cut(region: int, pivots: list, name: list[int], points: list) -> pa.RecordBatch:
            ids = np.array([p[0] for p in pivots], np.int64)
            d, near = distances([p[2] for p in points], [p[1] for p in pivots], num, den)
            nearest, inside = cells(d, ids, num, den)
            x, y = np.nonzero(inside | near)
            own = [bool(nearest[a] == b) for a, b in zip(x, y, strict=True)]
            label = [name[nearest[a]] if near[a, nearest[a]] else points[a][1] for a in x.tolist()]
            out = ([region] * len(x), ids[y], [points[a][0] for a in x.tolist()], label, [len(points[a][2]) for a in x.tolist()], [o if i else None for o, i in zip(own, inside[x, y], strict=True)], near[x, y])
            kinds = (pa.int64(),) * 5 + (pa.bool_(),) * 2
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)], names=[c.split()[0] for c in ASSIGNED.split(", ")])

        for (region, _), group in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
            pivots, points, name = [], [], None
            for _, _, member, key, label, text in group:
                s = shingle_set(text, n, cache)
                if len(s):
                    (points if member else pivots).append((key, label, s) if member else (key, s))
                if len(points) == 256:
                    name = name or names(pivots)
                    yield cut(region, pivots, name, points)
                    points = []
            if points:
                yield cut(region, pivots, name or names(pivots), points)

    return run


def _meet(n: int, num: int, den: int):
    """Rows (region, sa, sb, slice, id, label, own, text) with each pair of slices together, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cache = word_hashes()
        for (_, sa, sb), group in groupby(_rows(batches), key=lambda r: r[:3]):
            rows = [(r[3], r[4], r[5], r[6], shingle_set(r[7], n, cache)) for r in group]
            left, right = ([r for r in rows if r[0] == s and len(r[4])] for s in (sa, sb))
            if not left or not right:
                continue
            of = lambda side: (np.array([r[2] for r in side], np.int64), np.array([len(r[4]) for r in side]), sketches([r[4] for r in side]).astype(np.float32))
            found = close_pairs(of(left), of(right), num, den)
            links = [(left[x][1], right[y][1]) for x, y in found if (left[x][3] or right[y][3]) and left[x][1] != right[y][1] and linked(left[x][4], right[y][4], num, den)]
            yield _batch(links)

    return run


SLICED = "region bigint, sa int, sb int, slice int, id bigint, label bigint, own boolean"


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """(id, text) to (id, size, sketch)."""
        cache = word_hashes()
        for batch in batches:
            sets = [shingle_set(t, n, cache) for t in text_bytes(batch.column(1))]
            bits = np.packbits(sketches(sets), axis=1) if sets else np.empty((0, SKETCH // 8), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([b.tobytes() for b in bits], pa.binary())], names=["id", "size", "sketch"])

    return run


def _hopeful(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Rows (SLICED, size, sketch), each pair of slices together, to the rows that have a partner they may link with."""
        fields = [c.split() for c in SLICED.split(", ")]
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        rows_of = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, sa, sb), group in groupby(rows_of, key=lambda r: r[:3]):
            rows = [r for r in group if r[7]]
            left, right = ([r for r in rows if r[3] == s] for s in (sa, sb))
            if not left or not right:
                continue
            bits = lambda side: np.unpackbits(np.frombuffer(b"".join(r[8] for r in side), np.uint8).reshape(len(side), -1), axis=1).astype(np.float32)
            of = lambda side: (np.array([r[5] for r in side], np.int64), np.array([r[7] for r in side]), bits(side))
            kept = set()
            for x, y in close_pairs(of(left), of(right), num, den):
                if left[x][4] != right[y][4] and (left[x][6] or right[y][6]):
                    kept |= {left[x][:7], right[y][:7]}
            out = sorted(kept)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])

    return run


# the join of regions


def _with_texts(rows: DataFrame, texts: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """rows with their texts, those of equal keys together, in order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(texts, "id").repartition(parts, *keys).sortWithinPartitions(*order).select(*columns, "text")


def _slice_pairs(rows: DataFrame) -> DataFrame:
    """Rows (region, id, label, own) repeated for each pair of slices (sa <= sb) that must meet; slices of a region's commonest label, negative, do not meet each other."""
    counts = rows.groupBy("region", "label").agg(F.count("*").alias("n"))
    major = counts.groupBy("region").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    slices = lambda n: F.ceil(n / SLICE).cast("int")
    major = major.select("region", "all", F.col("top.label").alias("top"), F.when(F.col("top.n") > 1, slices(F.col("top.n"))).otherwise(0).alias("n_top"), slices(F.col("all") - F.when(F.col("top.n") > 1, F.col("top.n")).otherwise(0)).alias("n_rest"))
    t = spread_join(rows, written(major, "slices"), ["region"], "all").withColumn("is_top", (F.col("label") == F.col("top")) & (F.col("n_top") > 0))
    t = t.withColumn("slice", F.when(F.col("is_top"), -1 - F.pmod(F.xxhash64("id"), F.col("n_top"))).otherwise(F.pmod(F.xxhash64("id"), F.col("n_rest"))).cast("int"))
    rest, top = F.expr("sequence(0, n_rest - 1)"), F.expr("transform(sequence(0, n_top - 1), k -> -1 - k)")
    others = F.when(F.col("is_top"), rest).otherwise(F.when(F.col("n_top") > 0, F.concat(rest, top)).otherwise(rest))
    t = t.filter("n_rest > 0").withColumn("other", F.explode(others))
    return t.select("region", F.least("slice", "other").alias("sa"), F.greatest("slice", "other").alias("sb"), "slice", "id", "label", "own")


def region_links(rows: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> list[DataFrame]:
    """Links that connect what links in regions (region, id, label, own, size), as tables (a, b)."""
    out, level = [], 0
    while True:
        stats = written(rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.min("id").alias("least")).filter("n > 1"), "region-sizes")
        fits = f"n <= {FEW} or (n <= {FIT_POINTS} and weight <= {FIT_SHINGLES})"
        small = spread_join(rows, stats.filter(fits), ["region"], "n").select("region", "id", "label", "own")
        small = _with_texts(small, texts, ["region"], ["region", "id"], ["region", "id", "label", "own"])
        out.append(written(map_arrow(small, _solve(n, num, den), "a bigint, b bigint"), "links"))
        large = stats.filter(f"not ({fits})")
        if large.isEmpty():
            return out
        # a distributed round: each slice of a region gets all its pivots
        points = written(spread_join(rows, large, ["region"], "n"), "large-regions")
        drawn = (F.pmod(F.xxhash64("region", "id", F.lit(level)), F.col("n")) < PIVOTS) | (F.col("id") == F.col("least"))
        heads = points.filter(drawn).withColumn("slice", F.explode(F.expr(f"sequence(0, cast(ceil(n / {SLICE}) as int) - 1)")))
        heads = heads.select("region", "slice", F.lit(False).alias("member"), "id", "label")
        members = points.select("region", F.expr(f"cast(pmod(xxhash64(id, 7), cast(ceil(n / {SLICE}) as int)) as int)").alias("slice"), F.lit(True).alias("member"), "id", "label")
        columns = ["region", "slice", "member", "id", "label"]
        t = _with_texts(members.select(*columns).unionByName(heads), texts, ["region", "slice"], columns[:4], columns)
        found = written(map_arrow(t, _assign(n, num, den), ASSIGNED), "cells")
        out.append(found.filter("linked and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        inside = found.filter("own is not null")
        cell = inside.groupBy("region", "pivot").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
        cell = written(cell.filter("least <> most").select("region", "pivot", "n"), "open-cells")
        sizes = cell.groupBy("region").agg(F.sum("n").alias("kept"), F.max("n").alias("largest"))
        bad = large.select("region", "n").join(sizes, "region").filter("kept > 4 * n or largest > 0.8 * n")
        bad = written(bad.select("region", "n"), "unsplit-regions")
        # what pivots do not separate is joined in pairs of slices; each point comes once, with the label of its own cell
        was_own = points.select("region", "id", F.col("own").alias("was_own")).groupBy("region", "id").agg(F.max("was_own").alias("was_own"))
        whole = spread_join(found.filter("own").select("region", "id", "label"), bad, ["region"], "n").join(was_own, ["region", "id"])
        whole = whole.select("region", "id", "label", F.col("was_own").alias("own"))
        whole = written(whole, "unsplit-points")
        wanted = texts.join(whole.select("id").distinct(), "id", "left_semi").select("id", "text")
        sketched = written(map_arrow(wanted, _sketch(n), "id bigint, size bigint, sketch binary"), "sketches")
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = _slice_pairs(whole).join(sketched, "id").repartition(parts, "region", "sa", "sb").sortWithinPartitions("region", "sa", "sb", "slice", "id")
        pairs = written(map_arrow(pairs.select(*[c.split()[0] for c in SLICED.split(", ")], "size", "sketch"), _hopeful(num, den), SLICED), "hopeful-points")
        pairs = _with_texts(pairs, texts, ["region", "sa", "sb"], ["region", "sa", "sb", "slice", "id"], ["region", "sa", "sb", "slice", "id", "label", "own"])
        out.append(written(map_arrow(pairs, _meet(n, num, den), "a bigint, b bigint"), "links"))
        going = written(cell.join(bad.select("region"), "region", "left_anti"), "next-cells")
        rows = spread_join(inside, going, ["region", "pivot"], "n")
        rows = written(rows.select(F.xxhash64("region", "pivot", F.lit(level)).alias("region"), "id", "label", "own", "size"), "regions")
        level += 1


def _light(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def shingle_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; documents link when den * common >= num * union."""
    if not den < 2 * num <= 2 * den:
        raise ValueError("the least similarity must be above one half")
    t = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = written(map_arrow(t, _sign(n, num, den), SIGNED), "signatures")
    slim = written(signed.drop("keys", "cuts"), "set-hashes")
    known = "doc_id is not null and n_shingles > 0"
    points = written(slim.filter(known).groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")), "points")
    # rows of one doc_id with different sets: their points are linked, and texts that are repeated are met once
    kind = F.xxhash64("set_hash", "n_shingles")
    again = slim.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(kind).alias("a"), F.max(kind).alias("b"))
    again = written(again.filter("rows > 1"), "repeated-ids")
    several = again.filter("a <> b").select("doc_id", "rows")
    links = []
    if not several.isEmpty():
        same = spread_join(slim.filter(known), several, ["doc_id"], "rows").select("doc_id", "set_hash").distinct()
        links.append(written(same.join(points, "set_hash").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct(), "repeated-links"))

    copies = spread_join(slim.filter(known), points.filter("rows > 1"), ["set_hash"], "rows").filter("doc_id <> id").select("doc_id", "set_hash").distinct()
    copies = written(copies, "copies")
    single = signed.filter(known).join(_light(copies), ["doc_id", "set_hash"], "left_anti")
    tokens, shared = offered_tokens(single.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "keys", "cuts"))
    rows = spread_join(tokens, shared, ["key"], "rows")
    rows = rows.groupBy("region", "id").agg(F.max("size").alias("size"))
    rows = written(rows.select("region", "id", F.col("id").alias("label"), F.lit(True).alias("own"), "size"), "regions")
    discard(signed)
    wanted = written(rows.select("id").distinct(), "candidates")
    texts = t.join(_light(wanted), F.col("doc_id") == F.col("id")).select("id", "text")
    if not again.isEmpty():
        twice = _light(again.select(F.col("doc_id").alias("id")))
        texts = texts.join(twice, "id", "left_anti").unionByName(texts.join(twice, "id", "left_semi").distinct())
    texts = written(texts, "candidate-texts")

    links += region_links(rows, texts, n, num, den)
    labels = components(reduce(DataFrame.unionByName, links))
    # a wordless row goes with the other rows of its doc_id
    label = points.join(labels, "id", "left").select("set_hash", "rows", F.coalesce("label", "id").alias("component_id"))
    worded = spread_join(slim.filter(known), written(label, "components"), ["set_hash"], "rows").select("doc_id", "n_shingles", "component_id")
    others = slim.filter(f"not ({known})").join(labels, F.col("doc_id") == F.col("id"), "left")
    return worded.unionByName(others.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the smallest doc_id of every component, one for each doc_id; rows without a doc_id stay. All columns stay, whatever their names."""
    found = written(shingle_components(docs, n, num, den, id_col, text_col).select("doc_id", "component_id"), "components")
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    twice = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    t = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = t.join(_light(written(gone, "gone")), "doc_id", "left_anti")
    once = _light(written(twice, "repeated"))
    single = left.join(once, "doc_id", "left_anti")
    first = left.join(once, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return single.unionByName(first).select("row.*")
