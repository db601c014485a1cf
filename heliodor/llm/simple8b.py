"""Simple-8b word-aligned coding of unsigned ids, vectorised over blocks, and the segment format that holds it.

A 64-bit word is a 4-bit selector and 60 bits of payload. Selector s in 1..14 packs COUNTS[s] ids of 60 // COUNTS[s]
bits, the first id lowest. Selector 0 is an escape: its payload is an index into a table of whole 64-bit ids, for ids
of over 60 bits. Ids are coded in blocks of BLOCK; a block starts a new word, and the word offset of each block is
kept, so blocks decode independently and all words of a selector decode at once.

Segment, little endian: magic "HS8B", u32 version, u32 documents, u64 ids, u32 block, u32 blocks, u32 words,
u32 escapes; then i64 doc_id and u8 validity and u32 length for each document, u32 offsets of the blocks,
u64 words, u64 escapes.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK, MAGIC, VERSION = 256, b"HS8B", 1
#: Fixed values of the coding: ids in a word by selector; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
_HEAD = struct.Struct("<4sIIQIIII")
_PAD = 64


_LENGTH = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _lengths(ids: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned 64-bit ids."""
    if int(ids.max()) < 1 << 16:
        return _LENGTH[ids]
    high, low = (ids >> np.uint64(32)).astype(np.float64), (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def _choose(bits: np.ndarray) -> np.ndarray:
    """For a (blocks, BLOCK + padding) array of bit lengths, the selector that packs most ids from each position."""
    width = bits.shape[1] - _PAD
    powers, best = {1: bits}, np.zeros((bits.shape[0], width), np.uint8)
    for s in range(14, 0, -1):  # from few ids in a word to many; where few do not fit, more do not
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        if p not in powers:
            half, out = powers[p // 2], np.zeros_like(bits)
            np.maximum(half[:, : -p // 2], half[:, p // 2 :], out=out[:, : -p // 2])
            powers[p] = out
        top = np.maximum(powers[p][:, :width], powers[p][:, c - p : c - p + width]) if c > p else powers[p][:, :width]
        fits = (top <= 60 // c).view(np.uint8)
        if not fits.any():
            break
        np.maximum(best, fits * np.uint8(15 - s), out=best)
    return np.where(best > 0, 15 - best, 0).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block, escapes) of an array of unsigned 64-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint64)
    flat = np.zeros(blocks * BLOCK + _PAD, np.uint64)
    flat[:n] = ids
    bits = np.zeros((blocks, BLOCK + _PAD), np.uint8)
    bits[:, :BLOCK] = _lengths(flat[: blocks * BLOCK]).reshape(blocks, BLOCK)
    choice = _choose(bits)
    used = np.full(blocks, BLOCK, np.int64)
    used[-1] = n - (blocks - 1) * BLOCK
    at, rows, begins = np.zeros(blocks, np.int64), np.arange(blocks), np.zeros((blocks, BLOCK), bool)
    while len(rows):  # one word of every unfinished block at a time
        begins[rows, at[rows]] = True
        at[rows] += COUNTS[choice[rows, at[rows]]]
        rows = rows[at[rows] < used[rows]]
    begin = np.flatnonzero(begins)
    row, selector = begin // BLOCK, choice.reshape(-1)[begin]
    words, escapes = np.empty(len(begin), np.uint64), np.empty(0, np.uint64)
    ends = (row + 1) * BLOCK
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        c, first = int(COUNTS[s]), begin[mine]
        if s == 0:
            escapes = flat[first]
            words[mine] = np.arange(len(mine), dtype=np.uint64)
            continue
        packed = np.zeros(len(mine), np.uint64)
        for k in range(c):
            id_k = flat[first + k]
            if k:  # a block's last word may reach past its end
                id_k *= first + k < ends[mine]
            packed |= id_k << np.uint64(k * (60 // c))
        words[mine] = packed | np.uint64(int(s) << 60)
    return words, np.searchsorted(row, np.arange(blocks)).astype(np.uint32), escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    blocks = len(offsets)
    if not n:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(blocks), np.diff(np.append(offsets, len(words)).astype(np.int64)))
    start = before - before[offsets[block].astype(np.int64)]
    out = np.zeros((blocks, BLOCK + _PAD), np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        c = int(COUNTS[s])
        payload = words[mine] & np.uint64((1 << 60) - 1)
        if s == 0:
            out[block[mine], start[mine]] = escapes[payload.astype(np.int64)]
            continue
        mask = np.uint64((1 << (60 // c)) - 1)
        for k in range(c):
            out[block[mine], start[mine] + k] = (payload >> np.uint64(k * (60 // c))) & mask
    return out[:, :BLOCK].reshape(-1)[:n]


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets, escapes = encode(ids.astype(np.uint64))
    head = _HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), BLOCK, len(offsets), len(words), len(escapes))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    table = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([head, table.tobytes(), known.tobytes(), np.array(lengths, "<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a segment."""
    magic, version, docs, n, block, blocks, words, escapes = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or block != BLOCK:
        raise ValueError("not a segment of this format")
    at, parts = _HEAD.size, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", blocks), ("<u8", words), ("<u8", escapes)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    table, known, lengths, offsets, coded, large = parts
    return [int(x) if k else None for x, k in zip(table.tolist(), known.tolist(), strict=True)], lengths, decode(coded, offsets, large, n)
