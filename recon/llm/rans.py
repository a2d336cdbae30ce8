"""Blocks of token ids in a static range asymmetric numeral system.

A block holds whole documents. Id ``t`` of a block belongs to lane ``t % lanes``; every lane has a 64-bit state, all lanes share one
stream of 32-bit words, and one table of frequencies serves all blocks of a file set. Every ``every`` steps the encoder starts
anew with fresh states, so the segments between two checkpoints are decoded independently of each other. Layout, little-endian::

    4s   b"RAN1"
    6I   lanes, segments, steps of a full segment, documents, ids, crc32 of the frequency table
    q    id of each document (the smallest 64-bit integer: null)     documents times
    I    ids of each document                                       documents times
    I    words of each segment, I crc32 of its ids (as u4)           segments times
    Q    states of the lanes at each checkpoint                      lanes x segments times
    I    words
    I    crc32 of all bytes before
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, LOW, NULL = b"RAN1", np.uint64(31), -(2**63)
_32, _WORD = np.uint64(32), np.uint64(0xFFFFFFFF)


class Table:
    """Frequencies of symbols scaled to sum to ``2**bits``; a symbol that occurs has one at least."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.freq = np.uint64(bits), freq.astype(np.uint64)
        self.first = np.cumsum(self.freq) - self.freq
        self.mask = np.uint64((1 << bits) - 1)
        self.digest = zlib.crc32(freq.astype("<u4").tobytes(), bits)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    @classmethod
    def fit(cls, counts: dict[int, int], bits: int = 20) -> Table:
        """Scales counts: each symbol's share rounded down, one at least; what is left over goes to, or is taken from, the largest."""
        if len(counts) > 1 << bits:
            raise ValueError(f"{len(counts)} symbols do not fit {bits} bits")
        n, total = np.zeros(max(counts, default=0) + 1, np.int64), sum(counts.values())
        for s, c in counts.items():
            n[s] = max(1, (c << bits) // total)
        order = np.lexsort((np.arange(len(n)), -n))
        rest, at = (1 << bits) - int(n.sum()), 0
        if rest > 0:
            n[order[0]] += rest
        while rest < 0:
            take = min(int(n[order[at]]) - 1, -rest)
            n[order[at]] -= take
            rest, at = rest + take, at + 1
        return cls(n, bits)


def encode(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray, table: Table, lanes: int = 1024, every: int = 256) -> bytes:
    lanes = max(1, min(lanes, len(ids)))
    span = lanes * every
    segments = [ids[at:at + span] for at in range(0, len(ids), span)]
    states, words, sizes = [], [], []
    for part in segments:
        state, stream = _encode_segment(part, table, lanes)
        states.append(state)
        words.append(stream)
        sizes += [len(stream), zlib.crc32(part.astype("<u4"))]
    body = b"".join([
        MAGIC, struct.pack("<6I", lanes, len(segments), every, len(docs), len(ids), table.digest), docs.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(),
        np.array(sizes, "<u4").tobytes(), *[s.astype("<u8").tobytes() for s in states], *[w.astype("<u4").tobytes() for w in words],
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def _encode_segment(ids: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    x, out = np.full(lanes, np.uint64(1) << LOW), []
    freq, first = table.freq[ids], table.first[ids]
    limit = freq << (np.uint64(63) - table.bits)
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        f = freq[at:at + lanes]
        y = x[:len(f)]
        over = y >= limit[at:at + lanes]
        if over.any():
            out.append((y[over] & _WORD).astype(np.uint32))
            y = np.where(over, y >> _32, y)
        q = y // f
        x[:len(f)] = (q << table.bits) + (y - q * f) + first[at:at + lanes]
    return x, np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)


def _decode_segment(n: int, x: np.ndarray, words: np.ndarray, table: Table, lanes: int) -> np.ndarray:
    out, p, words = np.empty(n, np.uint32), 0, words.astype(np.uint64)
    for at in range(0, n, lanes):
        y = x[:min(lanes, n - at)]
        slot = y & table.mask
        s = table.symbol[slot]
        out[at:at + len(y)] = s
        y = table.freq[s] * (y >> table.bits) + slot - table.first[s]
        low = np.flatnonzero(y < np.uint64(1) << LOW)
        if len(low):
            y[low] = (y[low] << _32) | words[p:p + len(low)]
            p += len(low)
        x[:len(y)] = y
    if p != len(words):
        raise ValueError("a segment has words left over")
    return out


def decode(block: bytes, table: Table, only: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and the ids of all segments or of the one asked for; raises if a checksum differs."""
    if block[:4] != MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("not a block, or a damaged one")
    lanes, segments, every, n_docs, n, digest = struct.unpack_from("<6I", block, 4)
    if digest != table.digest:
        raise ValueError("the block was made with another table")
    at = 28
    docs = np.frombuffer(block, "<i8", n_docs, at)
    lengths = np.frombuffer(block, "<u4", n_docs, at := at + 8 * n_docs)
    sizes = np.frombuffer(block, "<u4", 2 * segments, at := at + 4 * n_docs).reshape(-1, 2)
    states = np.frombuffer(block, "<u8", lanes * segments, at := at + 8 * segments).reshape(-1, lanes)
    words = np.frombuffer(block, "<u4", int(sizes[:, 0].sum()), at + 8 * lanes * segments)
    starts, parts = np.cumsum(sizes[:, 0]) - sizes[:, 0], []
    for k in range(segments) if only is None else [only]:
        size = min(lanes * every, n - k * lanes * every)
        ids = _decode_segment(size, states[k].copy(), words[starts[k]:starts[k] + sizes[k, 0]], table, lanes)
        if zlib.crc32(ids.astype("<u4")) != sizes[k, 1]:
            raise ValueError(f"segment {k} has other ids than were written")
        parts.append(ids)
    return docs, lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32)
