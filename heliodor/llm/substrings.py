"""Substring dedup by prefix-partitioned suffix trees: words in passages of `window` words that occur twice are removed.

1. Texts of one word sequence are one class. A class of several documents repeats every window it has; one of its
   documents stands for it as a partner of others.
2. Sampled suffixes. Each window has an anchor, the suffix inside it whose first GRAM words have the least hash (the
   leftmost of equals), so equal windows have equal anchors at equal places. Neighbouring windows share anchors, about
   one for 14 words; the windows of one anchor are a run. Runs whose anchor's prefix occurs once cannot repeat and are
   dropped before any words are moved; equal runs are counted, and only one of each goes on.
3. Variable-length prefixes. Runs are dealt out by their anchors' first GRAM words. Where a prefix has more than GROUP
   different runs it is extended, by up to 8 words at a time: each of its windows goes on with the words that follow, if
   it reaches so far, or else with the words that go before (one of the two always lies inside). Equal windows make equal
   choices and stay together. Prefixes that occur once are dropped, those that fit are done, the others are extended
   again, until at `window` words a prefix is itself a node and its suffixes need only be counted.
4. Trees. A task gathers whole prefixes up to GROUP_WORDS words and builds the suffix tree of their runs as a suffix array
   with its longest common prefixes: the deepest internal node above a leaf is the larger of the two next to it. Nodes
   at a depth of `window` words or more give the maximal repeats, which are intervals of the texts.
5. The intervals are joined to the texts, and the words outside them are kept.

Words are compared as they are in trees. Classes, equal runs (prefix and run together) and prefixes of full length are
equated by 128 bits of hashes.

Memory: a task holds GROUP runs or GROUP_WORDS words. Texts move only for documents with a repeated anchor. Skew: rows of
a common prefix, run or class are dealt to many tasks (`spread_join`) or counted before they are shuffled. Broadcast: ids
of documents, up to BROADCAST_IDS, beyond which the same joins shuffle.

Defined results: a null text has no words; texts of under `window` words stay whole; repeated rows, also of one doc_id,
are documents of their own and so repeat each other; words are compared unchanged; a text without kept words has the
sha256 of nothing; other columns are not read; no rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gram_hashes, hash_array, map_arrow, parts_for, split_words, spread_join, text_bytes, word_hashes, written

WINDOW, GRAM, GROUP, GROUP_WORDS, BROADCAST_IDS = 35, 8, 2_000, 300_000, 300_000
RUN = pa.struct([("gram", pa.int64()), ("run", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("at", pa.int32())])
SIGNED = "doc_id bigint, text_hash bigint, n_words bigint, seq_hash binary, whole_sha binary, runs array<struct<gram:bigint,run:bigint,start:int,end:int,at:int>>"
#: A run to be compared: the words [at - a, at + b) of it are its prefix so far, which `kinds` pieces have; it stands for n equal ones, the first at `start` of a text.
PIECE = "prefix binary, a int, b int, n bigint, seq_hash binary, start int, at int, words binary, kinds bigint"
_PIECE_KINDS = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
_NO_ID = -(1 << 63)
_SLICE = 1 << 22


def seq_hash(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start, place of the anchor) of the runs of windows over a sequence of word hashes."""
    n, span, bits = len(h), window - gram + 1, np.uint64(23)
    out: list[tuple] = [(np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)]
    for a in range(0, n - window + 1, _SLICE):  # positions in a slice fit in the low bits
        b = min(a + _SLICE, n - window + 1)
        g = gram_hashes(h[a : b + window - 1], gram)
        v = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
        m, width = v, 1
        while 2 * width <= span:
            m, width = np.minimum(m[:-width], m[width:]), 2 * width
        if width < span:
            m = np.minimum(m[: len(v) - span + 1], m[span - width :][: len(v) - span + 1])
        p = (m & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1])
        out.append((g[p[first]], first + a, np.append(first[1:] - 1, len(p) - 1) + a, p[first] + a))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(4))


def runs_of(words: list[bytes], joined: bytes, cache: dict, window: int) -> tuple[np.ndarray, ...]:
    """(gram, run, start, end, at) of the runs of a text's windows; `run` is a hash of all its words, `at` the anchor's place in it."""
    gram, start, end, place = anchors(hash_array(words, cache), window)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    digest = xxhash.xxh3_64_intdigest
    run = np.array([digest(joined[a:b]) for a, b in zip(at[start].tolist(), (at[end + window] - 1).tolist(), strict=True)], np.uint64)
    return gram.view(np.int64), run.view(np.int64), start.astype(np.int32), end.astype(np.int32), (place - start).astype(np.int32)


def _sign(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cache, nothing = word_hashes(), tuple(np.empty(0, f.type.to_pandas_dtype()) for f in RUN)
        for batch in batches:
            n, seq, sha, found = [], [], [], [nothing]
            for text in text_bytes(batch.column(2)):
                words = split_words(text)
                joined = b" ".join(words)
                n.append(len(words))
                seq.append(xxhash.xxh3_128_digest(joined))
                sha.append(hashlib.sha256(joined).digest())
                found.append(runs_of(words, joined, cache, window) if len(words) >= window else nothing)
            offsets = np.cumsum([len(x[0]) for x in found]).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in found]), f.type) for k, f in enumerate(RUN)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(seq, pa.binary()), pa.array(sha, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                names=["doc_id", "text_hash", "n_words", "seq_hash", "whole_sha", "runs"],
            )

    return run


def _right_text(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows (seq_hash, text) whose text is of the class named."""
    for batch in batches:
        good = [seq_hash(split_words(t)) == h for h, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True)]
        yield batch.filter(pa.array(good, pa.bool_()))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_PIECE_KINDS)], names=[c.split()[0] for c in PIECE.split(", ")])


def _cut(window: int):
    """Rows (seq_hash, text, runs) to the runs as pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, text, runs in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = split_words(text)
                for r in runs:
                    out.append((r["gram"].to_bytes(8, "little", signed=True), 0, GRAM, r["n"], seq, r["start"], r["at"], b" ".join(words[r["start"] : r["end"] + window]), r["kinds"]))
            yield _pieces(out)

    return run


def longer_prefixes(words: list[bytes], a: int, b: int, at: int, window: int) -> list[tuple[int, int, int, int]]:
    """(a, b, first window, window after the last) of the one or two parts that the windows of a run fall into when its prefix grows."""
    step = min(8, (window - a - b + 1) // 2)
    cut = max(0, at - (window - b - step))  # windows from here on hold the words up to at + b + step
    last = len(words) - window + 1
    parts = [(a + step, b, 0, min(cut, last)), (a, b + step, cut, last)]
    return [p for p in parts if p[2] < p[3]]


def _split(window: int):
    """Pieces to pieces with longer prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, a, b, n, seq, start, at, piece, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = piece.split(b" ")
                for a2, b2, s, e in longer_prefixes(words, a, b, at, window):
                    prefix = xxhash.xxh3_128_digest(b"%d %d " % (a2, b2) + b" ".join(words[at - a2 : at + b2]))
                    out.append((prefix, a2, b2, n, seq, start + s, at - s, b" ".join(words[s : e - 1 + window]), None))
            yield _pieces(out)

    return run


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Ranks of the rows of three columns of ranks below 2^21."""
    return np.unique((columns[0] << 42) | (columns[1] << 21) | columns[2], return_inverse=True)[1].astype(np.int64)


def deep_leaves(segments: list[list[bytes]], window: int) -> list[list[tuple[int, int]]]:
    """For each word sequence, the (start, end) of its suffixes down to the deepest node above them, if that is `window` words deep or more.

    The suffix tree of all segments as a suffix array with longest common prefixes, from ranks by 1, 3, 9, ... words;
    each segment ends in a letter of its own, so no common prefix passes its end.
    """
    lengths = np.array([len(s) + 1 for s in segments], np.int64)
    total, ends = int(lengths.sum()), np.cumsum(lengths)
    if total >= 1 << 21:
        raise ValueError("a group holds too many words")
    spell: dict[bytes, int] = {}
    flat = np.empty(total, np.int64)
    inside = np.ones(total, bool)
    inside[ends - 1] = False
    flat[inside] = np.fromiter((spell.setdefault(w, len(spell)) for s in segments for w in s), np.int64, total - len(segments))
    flat[ends - 1] = len(spell) + np.arange(len(segments))
    later = lambda r, by: np.concatenate([r[by:], np.zeros(min(by, total), np.int64)])[:total]
    ranks, depth = [flat], 1
    while 3 * depth <= lengths.max(initial=1):
        r = ranks[-1]
        ranks.append(_ranks(r, later(r, depth), later(r, 2 * depth)))
        depth *= 3
    left = np.repeat(ends, lengths) - 1 - np.arange(total)  # words from each place to its segment's end
    leaves = np.flatnonzero(left >= window)
    r = ranks[-1]
    order = leaves[np.lexsort((later(r, 2 * depth)[leaves], later(r, depth)[leaves], r[leaves]))]
    common = np.zeros(max(0, len(order) - 1), np.int64)
    for rank, by in zip(reversed(ranks), reversed([3**k for k in range(len(ranks))]), strict=True):
        for _ in range(2):
            x, y = order[:-1] + common, order[1:] + common
            ok = (x < total) & (y < total)
            common += by * (ok & (rank[np.minimum(x, total - 1)] == rank[np.minimum(y, total - 1)]))
    node = np.zeros(total, np.int64)
    node[order] = np.maximum(np.append(common, 0), np.append([0], common))[: len(order)]
    deep = np.flatnonzero(node >= window)
    begins = ends - lengths
    cut = np.searchsorted(deep, np.append(begins, total))
    return [[(p - start, p - start + d) for p, d in zip(deep[x:y].tolist(), node[deep[x:y]].tolist(), strict=True)] for x, y, start in zip(cut[:-1], cut[1:], begins.tolist(), strict=True)]


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPAN = "seq_hash binary, a int, b int"


def _grow_trees(window: int):
    """Rows (prefix, n, seq_hash, start, words), whole prefixes together, to the intervals that repeat. Runs of n > 1 are known to repeat and only serve as partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None

        def flush():
            out = []
            for (n, seq, start, _), found in zip(rows, deep_leaves([r[3] for r in rows], window), strict=True):
                if n == 1:
                    out += [(seq, start + a, start + b) for a, b in united(found)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.int32()))], names=["seq_hash", "a", "b"])

        for batch in batches:
            for prefix, n, seq, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if prefix != last and size >= GROUP_WORDS:
                    yield flush()
                    size = 0
                last, found = prefix, words.split(b" ")
                rows.append((n, seq, start, found))
                size += len(found)
        if rows:
            yield flush()

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        removed, texts = [], []
        for text, spans in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words, kept, at = split_words(text), [], 0
            for a, b in united((s["a"], s["b"]) for s in spans):
                kept += words[at:a]
                at = b
            kept += words[at:]
            removed.append(len(words) - len(kept))
            texts.append(b" ".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(texts, pa.binary())], names=["seq_hash", "n_removed", "kept"])


def _light(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _trees(pieces: DataFrame, window: int) -> DataFrame:
    """(seq_hash, a, b): the repeated intervals of pieces (PIECE)."""
    parts, found = parts_for(pieces), []
    while True:
        fit = pieces.filter(F.col("kinds") <= GROUP).select("prefix", "n", "seq_hash", "start", "words")
        found.append(map_arrow(fit.repartition(parts, "prefix").sortWithinPartitions("prefix"), _grow_trees(window), SPAN))
        large = pieces.filter(F.col("kinds") > GROUP)
        if large.isEmpty():
            break
        longer = written(map_arrow(large, _split(window), PIECE).drop("kinds"), "longer-prefixes")
        again = longer.groupBy("prefix").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").drop("least")
        pieces = written(spread_join(longer, written(again, "repeated-prefixes"), ["prefix"], "kinds"), "repeated-pieces")
        whole = pieces.filter(f"a + b = {window} and n = 1")  # the prefix is the window: a node whose suffixes are all equal
        found.append(whole.select("seq_hash", F.col("start").alias("a"), (F.col("start") + window).alias("b")))
        pieces = pieces.filter(f"a + b < {window}")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _parts(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed documents, classes, seq_hash and kept text of the classes of one document that lose some of their words)."""
    text = F.col(f"`{text_col}`").cast("string")
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = written(map_arrow(docs, _sign(window), SIGNED), "suffix-anchors")
    slim = written(signed.drop("runs"), "sequences")
    doc_key, place = F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_key"), ["doc_key", "text_hash"]
    long = slim.filter(F.col("n_words") >= window).select(doc_key, "text_hash", "seq_hash")
    classes = long.groupBy("seq_hash").agg(F.count("*").alias("copies"), F.min(F.struct(*place)).alias("rep"))
    classes = written(classes.select("seq_hash", "copies", "rep.*"), "classes")
    several = classes.filter("copies > 1").withColumnsRenamed({"doc_key": "rep_key", "text_hash": "rep_hash"})
    others = spread_join(long, several, ["seq_hash"], "copies").filter("doc_key <> rep_key or text_hash <> rep_hash").select(*place).distinct()
    own = signed.filter(F.col("n_words") >= window).select(doc_key, "text_hash", "seq_hash", "runs").join(_light(written(others, "copies")), place, "left_anti")
    runs = written(own.select("seq_hash", F.explode("runs").alias("r")).select("seq_hash", "r.*"), "anchors")
    discard(signed)
    again = runs.groupBy("gram").agg(F.count("*").alias("leaves")).filter("leaves > 1")
    runs = written(spread_join(runs, written(again, "repeated-anchors"), ["gram"], "leaves").drop("leaves"), "repeated-runs")
    first = F.min(F.struct("seq_hash", "start", "end", "at")).alias("first")
    kinds = written(runs.groupBy("gram", "run").agg(F.count("*").alias("n"), first), "different-runs")

    wanted = written(classes.join(runs.select("seq_hash").distinct(), "seq_hash", "left_semi").select(*place, "seq_hash"), "wanted")
    texts = docs.select(doc_key, "text_hash", "text").join(_light(wanted), place)
    twins = long.groupBy(*place).agg(F.count("*").alias("rows")).filter("rows > 1").select(*place)
    if not twins.isEmpty():
        twins = _light(written(twins, "repeated-rows"))
        texts = texts.join(twins, place, "left_anti").unionByName(texts.join(twins, place, "left_semi").dropDuplicates(["seq_hash"]))
    texts = written(map_arrow(texts.select("seq_hash", "text"), _right_text, "seq_hash binary, text string"), "repeated-texts")

    groups = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").drop("least")
    open_runs = spread_join(kinds.select("gram", "n", "first.*"), written(groups, "open-prefixes"), ["gram"], "kinds")
    open_runs = written(open_runs, "open-runs")
    cut = open_runs.groupBy("seq_hash").agg(F.collect_list(F.struct("gram", "n", "start", "end", "at", "kinds")).alias("runs"))
    pieces = map_arrow(texts.join(cut, "seq_hash").select("seq_hash", "text", "runs"), _cut(window), PIECE)
    spans = _trees(written(pieces, "pieces"), window)
    whole = spread_join(runs, kinds.filter("n > 1").select("gram", "run", "n"), ["gram", "run"], "n")
    spans = spans.unionByName(whole.select("seq_hash", F.col("start").alias("a"), (F.col("end") + window).alias("b")))
    spans = spans.groupBy("seq_hash").agg(F.collect_list(F.struct("a", "b")).alias("spans")).join(classes.filter("copies = 1"), "seq_hash", "left_semi")
    kept = map_arrow(texts.join(spans, "seq_hash").select("seq_hash", "text", "spans"), _keep, "seq_hash binary, n_removed bigint, kept binary")
    return slim, classes, kept


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    slim, classes, kept = _parts(docs, window, id_col, text_col)
    kept = kept.select("seq_hash", "n_removed", F.unhex(F.sha2("kept", 256)).alias("kept_sha"))
    results = written(classes.select("seq_hash", "copies").join(kept, "seq_hash", "left"), "kept")
    t = spread_join(slim, results, ["seq_hash"], "copies", "left")
    all_gone = F.coalesce(F.col("copies") > 1, F.lit(False))
    removed = F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "whole_sha"))))
    return t.select("doc_id", "n_words", removed.cast("bigint").alias("n_removed"), sha.alias("kept_sha256"))
