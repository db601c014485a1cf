"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of ranks: a token's bytes and its id. The library's BPE model works on characters and on
merge pairs, so bytes are mapped to printable characters one to one, and each token of over one byte gives the pair of
tokens that the lower ranks leave of it. Text is cut by the given pattern first and every match is encoded by itself;
matches are kept in a bounded memory. Ids go out as little-endian u32.

Decoding takes each id's characters from the model's vocabulary and turns them back into bytes by the reversed byte table,
once for each id, and joins what the ids of a text give. A token may hold part of a character: `decode` gives bytes,
`decode_text` replaces what is left of broken characters at the ends. Offsets are the character span of every token, from
the character of its first byte to the character of its last byte, which it reaches the end of even if it ends inside; so
the tokens of a split character all span it.

Defined results: a null or empty text has no ids; repeated rows give the same ids; other columns are not read; an id
outside the vocabulary raises IndexError.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cached, held, map_arrow, text_bytes

ENCODED = "doc_id bigint, ids binary"
#: offsets: pairs of little-endian u32, the first and the last + 1 character of each token; n_split: tokens that end inside a character.
DECODED = "doc_id bigint, ids binary, decoded binary, offsets binary, n_split bigint"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_characters() -> dict[int, str]:
    """Each byte as a character: visible Latin-1 bytes stand for themselves, the others follow from 256 on, in order."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """What the merges of lower rank than the token's own leave of it, if that is two parts."""
    own, parts = ranks[token], [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        found = min(((ranks.get(a + b, own), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(own, 0))
        if found[0] >= own:
            return None
        k = found[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def vocabulary(ranks: dict[bytes, int]) -> dict[str, int]:
    """The ids by the characters of their tokens."""
    table = byte_characters()
    return {"".join(map(table.__getitem__, t)): r for t, r in ranks.items()}


def model(path: str):
    """The library's BPE model of a file of ranks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers.models import BPE

    ranks, table = read_ranks(path), byte_characters()
    name = lambda token: "".join(map(table.__getitem__, token))
    pairs = [pair for token in sorted(ranks, key=ranks.__getitem__) if len(token) > 1 and (pair := last_pair(token, ranks))]
    return BPE(vocab=vocabulary(ranks), merges=[(name(a), name(b)) for a, b in pairs], ignore_merges=True)


def piece_ids(path: str, bound: int = 150_000) -> Cached:
    """Ids of one match of the pattern as bytes of little-endian u32."""

    def make() -> Cached:
        bpe, table = model(path), byte_characters()
        return Cached(lambda piece: array("I", [t.id for t in bpe.tokenize("".join(map(table.__getitem__, piece.encode())))]).tobytes(), bound)

    return held(("piece ids", path), make)


def encode_text(text: str, pieces: Cached, cut) -> bytes:
    return b"".join(map(pieces.__getitem__, cut(text)))


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pieces, cut = piece_ids(path), regex.compile(pattern).findall
        for batch in batches:
            ids = [encode_text(x, pieces, cut) if x else b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): whole texts without special tokens."""
    return map_arrow(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), _encode(path, pattern), ENCODED)


def token_table(path: str) -> list[bytes]:
    """The bytes of each id: its characters in the vocabulary through the reversed byte table."""
    byte_of = {character: byte for byte, character in byte_characters().items()}
    names = vocabulary(read_ranks(path))
    table = [b""] * (max(names.values()) + 1)
    for name, rank in names.items():
        table[rank] = bytes(map(byte_of.__getitem__, name))
    return table


def offsets_of(lengths: np.ndarray, decoded: bytes) -> tuple[np.ndarray, int]:
    """((tokens, 2) first and last + 1 character of each token, how many tokens end inside a character)."""
    starts = (np.frombuffer(decoded, np.uint8) & 0xC0) != 0x80  # where characters begin
    character = np.cumsum(starts, dtype=np.int32)
    ends = np.cumsum(lengths)
    split = int((~starts[ends[ends < len(starts)]]).sum())
    return np.stack([character[ends - lengths] - 1, character[ends - 1]], axis=1).astype("<u4") if len(ends) else np.empty((0, 2), "<u4"), split


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        table = token_table(path)
        lengths = np.array([len(t) for t in table], np.int64)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]
            out = [b"".join(map(table.__getitem__, x.tolist())) for x in ids]
            places = [offsets_of(lengths[x], text) for x, text in zip(ids, out, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array([p.tobytes() for p, _ in places], pa.binary()), pa.array([n for _, n in places], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DECODED.split(", ")])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded, offsets, n_split): the bytes that the ids stand for, and the tokens' places in them."""
    return map_arrow(encoded.select("doc_id", "ids"), _decode(path), DECODED)


def _both(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        return _decode(path)(_encode(path, pattern)(batches))

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one Python worker instead of two."""
    return map_arrow(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), _both(path, pattern), DECODED)


def decode_text(ids: list[int], table: list[bytes]) -> str:
    """The text of any run of ids; what is left of characters cut at its ends becomes U+FFFD."""
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def token_offsets(ids: np.ndarray, table: list[bytes]) -> list[tuple[int, int]]:
    """The character span of every token."""
    tokens = [table[i] for i in ids]
    return [tuple(p) for p in offsets_of(np.array([len(t) for t in tokens], np.int64), b"".join(tokens))[0].tolist()]
