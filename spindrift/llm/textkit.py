"""Vectorised text scanning shared by the corpus operators.

Everything works on the UTF-8 bytes of a whole Arrow batch: word boundaries, A-Z folding and word
hashes are array expressions, so no Python statement runs per word.  Texts are cut into blocks of
whole documents of about ``BLOCK_BYTES``, which bounds the scratch memory of a task; a single text
longer than that is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: All ASCII but letters and digits.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[128:] = NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def blocks(buf: np.ndarray, offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of whole documents."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of a block of documents: maximal runs of bytes outside ``apart`` (white space).

    start, end: byte positions in the block; first: n_docs+1 positions of each document's words.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, fold: bool = True, apart: np.ndarray = _SPACE):
        self.buf = _FOLD[buf] if fold else buf
        self.raw, self.offs = buf, offs
        solid = ~apart[buf]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        stop = np.zeros(len(buf) + 1, dtype=bool)
        stop[1:] = solid
        stop[1:-1] &= ~solid[1:]
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        begin[inner] |= solid[inner]
        stop[inner] |= solid[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each (folded) word: a polynomial in the bytes, read off prefix sums.

        Stretches of about BLOCK_BYTES are summed at a time, which bounds the scratch memory.
        """
        n, lo = len(self.start), 0
        out = np.zeros(n, np.uint64)
        while lo < n:
            a = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, a + BLOCK_BYTES, side="right")))
            part = self.buf[a : self.end[hi - 1]]
            up, down = powers(len(part) + 1)
            pre = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=pre[1:])
            begin = self.start[lo:hi] - a
            out[lo:hi] = mix64((pre[self.end[lo:hi] - a] - pre[begin]) * down[begin])
            lo = hi
        return out


_UP, _DOWN = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, BLOCK_BYTES + 2)
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > 16 * BLOCK_BYTES:
            return up, down
        _UP, _DOWN = up, down
    return _UP, _DOWN


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bit_votes(hashes: np.ndarray, first: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """How often each of the 64 bits is set, per group of consecutive hashes: (n_groups, 64), bit 0 lowest.

    Bits are counted eight at a time in the bytes of a 64-bit word, in runs of at most 255 hashes.
    With integer weights (at most 15) a run holds at most 17 hashes.
    """
    n_groups = len(first) - 1
    out = np.zeros((n_groups, 64), np.int64)
    if not len(hashes):
        return out
    counts = np.diff(first)
    run = 255 if weights is None else 17
    runs = -(-counts // run)
    of = np.repeat(np.arange(n_groups), runs)
    lead = np.zeros(len(of), np.int64)
    if len(of):
        at = np.concatenate(([0], np.cumsum(runs)))[:-1]
        lead = first[:-1][of] + (np.arange(len(of)) - at[of]) * run
    ones = np.uint64(0x0101010101010101)
    group_lead = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    live = of[group_lead]
    for k in range(8):
        lanes = (hashes >> np.uint64(k)) & ones
        if weights is not None:
            lanes = lanes * weights.astype(np.uint64)
        sums = np.add.reduceat(lanes, lead).view(np.uint8).reshape(-1, 8)
        out[live, k::8] = np.add.reduceat(sums, group_lead, axis=0, dtype=np.int64)
    return out


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """(n, 64) booleans, bit 0 lowest, to uint64."""
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def sql_crc_bucket(doc_id, mod: int):
    """Spark column: crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)
