"""Quality rules by compression bands.

A row-local operator: one Arrow pass over whole texts, memory of one batch; limits that are drawn from labels take a pass before.

zstandard ratios (bytes before / bytes after) of the whole document and of fixed chunks must lie in a band whose
limits depend on the length. Text above the band repeats itself, text below it is close to random. Chunks cover the whole
text: the last one reaches back from the end. Under MIN_BYTES the frame's constant cost is taken off first; there only the
upper limit binds, as random and clean texts of that length look alike.

Random base64 is not much less compressible than short clean texts in scripts of three bytes a character are, so the
least ratio goes by the script: where less than a quarter of the bytes are non-ASCII, PLAIN_LEAST holds, above base64
(1.21 at 575 bytes, 1.33 at 65,535) and below the lowest clean text found in message catalogues of many languages (1.22 at 512
bytes, 1.64 at 4,096). Under 512 bytes the two cannot be told apart; there base64 in lines of 76 fails the base rules,
having less than ten words.

The upper limits of BANDS are wide, as they must hold for any language. `fit_limits` draws closer ones for mostly ASCII
text from all labelled clean rows: their ratios follow the length closely, so a limit is the trend of their medians over
the length's power of two, plus the QUANTILE of what lies above the trend and SLACK of that. Ratios are measured where the texts
are and joined with the labels as narrow rows; medians and quantiles come from counts of all of them in steps of a BINS-th,
of which no power of two has more than about 20 * BINS, whatever the number of documents. Lengths with fewer than LEAST_ROWS of
them, and other scripts, keep BANDS.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged each by itself and
alike; without labels the limits are those of BANDS; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, split_words, text_bytes, written

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, ratio double, odd_chunk_share double, kept boolean"

LEVEL, CHUNK, MIN_BYTES, FRAME, ODD_CHUNKS = 3, 4096, 200, 9, 0.25
BINS, LEAST_ROWS, QUANTILE, SLACK = 4096, 30, 0.998, 0.4
#: (bytes from, least ratio, most ratio): the last row at or below the length holds.
BANDS = ((0, 0.0, 1e9), (32, 0.0, 2.0), (100, 0.0, 2.4), (200, 0.95, 2.8), (512, 1.1, 3.2), (1024, 1.2, 3.6), (4096, 1.3, 4.2), (16384, 1.35, 4.8), (65536, 1.4, 5.5))
#: (bytes from, least ratio) in place of that of BANDS where less than PLAIN_SHARE of the bytes are non-ASCII.
PLAIN_LEAST = ((512, 1.21), (576, 1.225), (640, 1.24), (704, 1.25), (768, 1.265), (896, 1.28), (1024, 1.31), (1280, 1.33), (1536, 1.36), (2048, 1.4), (3072, 1.42), (4096, 1.45))
PLAIN_SHARE, HIGH = 0.25, bytes(range(128, 256))
WINDOW, SYMBOLS, SPACES = 5, b"#*$%&|<>", b" \t\n\x0b\x0c\r"


#: Upper limits for mostly ASCII text: (log2 of lengths, limits at them, first length, length after the last).
Limits = tuple[tuple[float, ...], tuple[float, ...], int, int]


def plain(text: bytes) -> bool:
    return text.isascii() or len(text) - len(text.translate(None, HIGH)) < PLAIN_SHARE * len(text)


def band(text: bytes, limits: Limits | None = None) -> tuple[float, float]:
    n = len(text)
    low, high = next((low, high) for start, low, high in reversed(BANDS) if n >= start)
    if plain(text):
        low = next((least for start, least in reversed(PLAIN_LEAST) if n >= start), low)
        if limits and limits[2] <= n < limits[3]:
            high = min(high, float(np.interp(np.log2(n), limits[0], limits[1])))
    return low, high


def ratio_of(text: bytes, packer: zstandard.ZstdCompressor) -> float:
    packed = len(packer.compress(text))
    return len(text) / max(1, packed - FRAME if len(text) < MIN_BYTES else packed)


def chunks(text: bytes) -> list[bytes]:
    """Pieces of CHUNK bytes that cover the text; the last one ends with it."""
    n = len(text)
    if n <= CHUNK:
        return [text]
    return [text[at : at + CHUNK] for at in [*range(0, n - CHUNK, CHUNK), n - CHUNK]]


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in an n-word window found twice or more. Hashes find candidates; the windows decide."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    grams = np.fromiter(map(hash, zip(*(words[k:] for k in range(n)))), np.int64, m)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    at = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    first: dict[tuple, int] = {}
    starts = set()
    for p in at.tolist():
        q = first.setdefault(tuple(words[p : p + n]), p)
        if q != p:
            starts.update((p, q))
    mark = np.zeros(len(words) + 1, np.int64)
    starts = np.fromiter(starts, np.int64, len(starts))
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + n, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum())


def measure(text: bytes, packer: zstandard.ZstdCompressor, limits: Limits | None = None) -> tuple:
    words = split_words(text)
    n, solid = len(words), text.translate(None, SPACES)
    word_chars = len(solid.decode("utf-8", "surrogateescape")) if not solid.isascii() else len(solid)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    repeats = repeated_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    ratio = ratio_of(text, packer) if text else 0.0
    low, high = band(text, limits)
    pieces, odd = chunks(text), 0
    for piece in pieces:
        if len(pieces) > 1:
            least, most = band(piece, limits)
            odd += not least <= ratio_of(piece, packer) <= most
    share = odd / len(pieces) if len(pieces) > 1 else float(not low <= ratio <= high)
    good = low <= ratio <= high and share <= ODD_CHUNKS
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeats, failed, ratio, share, good and not failed


def new_packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)


def _judge(limits: Limits | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        packer = new_packer()
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [measure(x, packer, limits) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    return run


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    packer = new_packer()
    for batch in batches:
        ids, texts = batch.column(0), text_bytes(batch.column(1))
        at = [k for k, x in enumerate(texts) if len(x) >= MIN_BYTES and plain(x)]
        sizes = np.array([len(texts[k]) for k in at], np.int64)
        columns = [ids.take(pa.array(at, pa.int64())), pa.array(sizes), pa.array([ratio_of(texts[k], packer) for k in at], pa.float64()), pa.array(np.log2(sizes)), pa.array([int(n).bit_length() - 1 for n in sizes], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "ratio", "x", "power"])


def _bins(t: DataFrame, power: str, values: dict[str, Column]) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """For each name and power of two: (values, how many rows have them) of all rows, in steps of a BINS-th of log1p of what is positive."""
    bins = F.explode(F.array(*[F.struct(F.lit(n).alias("of"), F.floor(F.log1p(F.greatest(v, F.lit(0.0))) * BINS).alias("bin")) for n, v in values.items()]))
    found: dict[tuple[str, int], list] = {}
    for r in t.select(power, bins.alias("b")).groupBy(power, "b.of", "b.bin").agg(F.count("*").alias("n")).orderBy("of", power, "bin").collect():
        found.setdefault((r["of"], r[power]), []).append((r["bin"], r["n"]))
    return {k: (np.expm1(np.array([b for b, _ in v]) / BINS), np.array([n for _, n in v])) for k, v in found.items()}


def quantile_of(values: np.ndarray, counts: np.ndarray, share: float) -> float:
    """The quantile of rising values that occur so many times, interpolated between neighbours."""
    ends = np.cumsum(counts)
    at = share * (int(ends[-1]) - 1)
    low, high = (values[np.searchsorted(ends, k, "right")] for k in (int(np.floor(at)), int(np.ceil(at))))
    return float(low + (high - low) * (at - np.floor(at)))


def fit_limits(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Limits | None:
    """Limits from all documents that `labels` (id, 1: clean) calls clean; None without any."""
    if labels is None:
        return None
    clean = labels.filter(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"))
    rows = map_arrow(_slim(docs, id_col, text_col), _ratios, "doc_id bigint, size bigint, ratio double, x double, power bigint")
    rows = written(rows.join(clean, "doc_id", "left_semi").drop("doc_id").distinct(), "clean-ratios")  # copies count once; texts are not moved
    found = _bins(rows, "power", {"x": F.col("x"), "ratio": F.col("ratio")})
    ok = sorted(p for of, p in found if of == "x" and 1 << p >= MIN_BYTES and found[of, p][1].sum() >= LEAST_ROWS)
    if not ok:
        discard(rows)
        return None
    runs = np.split(np.array(ok), np.flatnonzero(np.diff(ok) > 1) + 1)
    ok = max(runs, key=len).tolist()  # neighbouring lengths, as limits are drawn between them
    middle, trend = ([quantile_of(*found[of, p], 0.5) for p in ok] for of in ("x", "ratio"))
    slope = np.gradient(trend, middle) if len(ok) > 1 else np.zeros(1)
    line = F.element_at(F.create_map(*[F.lit(v) for p, m, t, g in zip(ok, middle, trend, slope, strict=True) for v in (p, [float(m), float(t), float(g)])]), F.col("power").cast("int"))
    over = F.col("ratio") - (line[1] + line[2] * (F.col("x") - line[0]))
    above = _bins(rows.filter(F.col("power").isin(ok)), "power", {"over": over})
    discard(rows)
    limits = [t + quantile_of(*above["over", p], QUANTILE) * (1 + SLACK) for p, t in zip(ok, trend, strict=True)]
    ends = (float(ok[0]), float(ok[-1] + 1))  # the trend goes on to the ends of the first and last lengths
    limits = [limits[0] + float(slope[0]) * (ends[0] - middle[0]), *limits, limits[-1] + float(slope[-1]) * (ends[1] - middle[-1])]
    return (ends[0], *middle, ends[1]), tuple(limits), 1 << ok[0], 1 << (ok[-1] + 1)


def quality_bands(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, compression ratio, share of chunks outside their band and verdict."""
    return map_arrow(_slim(docs, id_col, text_col), _judge(limits), SCHEMA)


def _filter(place: int, limits: Limits | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        packer = new_packer()
        for batch in batches:
            yield batch.filter(pa.array([measure(x, packer, limits)[-1] for x in text_bytes(batch.column(place))], pa.bool_()))

    return run


def keep_good(docs: DataFrame, limits: Limits | None = None, text_col: str = "text") -> DataFrame:
    """The rows whose texts pass; all columns stay."""
    return map_arrow(docs, _filter(docs.columns.index(text_col), limits), docs.schema)
