"""Token-id output: documents encoded by a tokenizer, written in doc_id order as Simple-8b segments, and read back.

Documents are dealt into ranges of doc_id of nearly equal counts (splits from an approximate percentile over all
rows; they balance the work and never change a result), sorted in each range and streamed through the tokenizer, so a
task holds an Arrow batch and a segment of about SEGMENT_IDS ids, never a range. Each segment is a row (range, segment,
n_docs, n_ids, payload) of an uncompressed Parquet table, whose writer makes the files appear whole or not at all and
works on any file system that Spark can write. A reader needs only (range, segment, n_ids) to place every segment.

Texts are encoded by the tokenizers library, in Arrow batches. Where the tokenizer's own rules (its normaliser and
pre-tokeniser, read from the library's object) drop white space and never join across it, a text's ids are the ids of its
white-space separated chunks in order: a batch's chunks are made distinct by Arrow, and new ones are cut by the
tokenizer's own pattern and encoded by its model, once, in a bounded memory. Any other tokenizer encodes whole texts.

Defined results: a null or empty text has no ids but the end id; equal doc_ids stand in the order of their texts, null
doc_ids first; other columns are not read; no rows in, no rows out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from .bpe import byte_characters
from .common import Cached, held, map_arrow, parts_for, range_bucket, range_splits, written

END_ID, SEGMENT_IDS = 2, 1 << 20
SEGMENTS = "range int, segment int, n_docs int, n_ids bigint, payload binary"
DECODED = "range int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"


#: Kinds of normalisers that never look beyond white space (Replace only as the one that makes runs of it one space).
LOCAL_STEPS = {"NFC", "Lowercase", "Replace"}


def piece_pattern(tokenizer) -> str | None:
    """The pattern that cuts texts into pieces without white space, from the tokenizer's own rules; None if they are of another kind."""
    rules = json.loads(tokenizer.to_str())
    parts = lambda rule, name: (rule or {}).get(name) or [rule] if rule else []
    steps, cuts = parts(rules["normalizer"], "normalizers"), parts(rules["pre_tokenizer"], "pretokenizers")
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if any(s["type"] not in LOCAL_STEPS or (s["type"] == "Replace" and s != spaces) for s in steps) or not any(s["type"] == "Lowercase" for s in steps):
        return None
    if [c["type"] for c in cuts] != ["Split", "ByteLevel"] or rules["model"]["type"] != "BPE" or rules["model"].get("dropout"):
        return None
    split, spell = cuts
    pattern = split["pattern"].get("Regex", "")
    if not pattern or split["behavior"] != "Removed" or not split["invert"] or spell["add_prefix_space"] or spell["use_regex"]:
        return None
    # white space may only stand in a negated class, and nothing may look beyond a match
    loose = re.sub(r"\[\^\\s[^\]]*\]", "", pattern)
    return None if re.search(r"\\s|\s|\(\?|\.|\[\^|\\[SDWPRXb]", loose) else pattern


class ChunkIds(dict):
    """Ids, as little-endian u32, of chunks of text without white space, by the tokenizer file at path.

    Plain chunks are cut by the tokenizer's pattern into pieces in lower case, which are fewer and are kept as well; any
    other chunk (control or far characters, no NFC, special tokens) goes through the whole tokenizer. Two generations
    bound the memory: what was used since the last change stays.
    """

    def __init__(self, path: str, bound: int = 400_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bound, self.old = Tokenizer.from_file(path), bound, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern = piece_pattern(self.tokenizer)
        self.cut = regex.compile(self.pattern).findall if self.pattern else None
        self.model, table = self.tokenizer.model, byte_characters()
        spelled = lambda piece: piece if piece.isascii() else "".join(map(table.__getitem__, piece.encode()))
        self.pieces = Cached(lambda piece: array("I", [t.id for t in self.model.tokenize(spelled(piece))]).tobytes(), bound)
        self.special = re.compile(b"|".join(sorted({re.escape(t.content.encode()[:2]) for t in self.tokenizer.get_added_tokens_decoder().values()})) or b"(?!)").search

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.old.get(chunk)
        if out is None:
            text = chunk.decode()
            plain = text.isprintable() and (text.isascii() or (max(text) < "\u0250" and "\u0130" not in text))  # all of these are in NFC
            if plain and not self.special(chunk):
                out = b"".join(map(self.pieces.__getitem__, self.cut(text.lower())))
            else:
                out = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[chunk] = out
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, their numbers); null: none."""
        if self.cut is None:
            found = [e.ids for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.fromiter((i for ids in found for i in ids), np.uint32), np.array([len(ids) for ids in found], np.int64)
        # the tokenizer's white space is wider than ASCII's; a chunk may hold more of it and is encoded whole
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = chunks.flatten().dictionary_encode()
        found = list(map(self.__getitem__, coded.dictionary.cast(pa.binary()).to_pylist()))
        ids, code = np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy(zero_copy_only=False)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = lengths[code]
        ends = np.cumsum(n)
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(lengths) - lengths)[code] - (ends - n), n)
        edges = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        return ids[places], np.diff(np.append([0], ends)[edges])


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        ids_of = held(("chunk ids", path), lambda: ChunkIds(path))
        doc_ids: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        at = pending = 0
        place = None

        def flush():
            nonlocal doc_ids, lengths, parts, pending, at
            ids = np.concatenate(parts)
            out = pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([at], pa.int32()), pa.array([len(doc_ids)], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([simple8b.pack_segment(doc_ids, lengths, ids)], pa.binary())], names=["range", "segment", "n_docs", "n_ids", "payload"])
            doc_ids, lengths, parts, pending, at = [], [], [], 0, at + 1
            return out

        for batch in batches:
            ids, n = ids_of.batch(batch.column(2))
            ends = np.cumsum(n)
            ids, first = np.insert(ids, ends, end_id), 0
            for spot, doc_id, stop in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (ends + np.arange(1, len(n) + 1)).tolist(), strict=True):
                if doc_ids and (spot != place or pending >= SEGMENT_IDS):
                    yield flush()
                if spot != place:
                    place, at = spot, 0
                doc_ids.append(doc_id)
                lengths.append(stop - first)
                parts.append(ids[first:stop])
                pending += stop - first
                first = stop
        if doc_ids:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of segments, written to the shared folder."""
    parts = parts or parts_for(docs)
    t = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    splits = range_splits(t, "doc_id", parts)
    t = t.select(range_bucket(F.col("doc_id"), splits).cast("int").alias("range"), "doc_id", "text")
    t = t.repartitionById(len(splits) + 1, F.col("range")).sortWithinPartitions("range", "doc_id", "text")
    return written(map_arrow(t, _segments(tokenizer_path, end_id), SEGMENTS), "token-ids", "none")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        for place, at, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            doc_ids, lengths, ids = simple8b.unpack_segment(payload)
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths.astype(np.int64))
            starts = ends - lengths
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([place] * n, pa.int32()), pa.array([at] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths.astype(np.int64), pa.int64()), pa.array(crc, pa.int64())], names=["range", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_token_files(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the segments' payloads."""
    heads = segments.select("range", "segment", "n_ids")
    inside = Window.partitionBy("range").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    ranges = heads.groupBy("range").agg(F.sum("n_ids").alias("n")).withColumn("range_start", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    bases = heads.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(ranges, "range").select("range", "segment", (F.col("range_start") + F.col("before")).alias("base"))
    found = map_arrow(segments.select("range", "segment", "payload"), _read, DECODED)
    return found.join(bases, ["range", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")


def token_file_index(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, **names) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer_path, end_id, **names))
