"""Static range asymmetric numeral system over interleaved lanes, vectorised with numpy.

Lane k of L codes symbols k, k + L, k + 2L ... of a block, all lanes with one frequency
table. States are 63 bits, renormalised by 32-bit words. A checkpoint keeps the lanes'
states and the place in the words at a step, so decoding can begin there.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE = 20
TOTAL = 1 << SCALE
LOW = 1 << 31
U64 = np.uint64


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to TOTAL, at least 1 for each symbol that occurs."""

    symbols: np.ndarray  # uint32, ascending
    freqs: np.ndarray  # uint32

    @staticmethod
    def of(ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        return Table(symbols.astype(np.uint32), _scaled(counts[symbols]).astype(np.uint32))

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.freqs.astype(np.int64))])


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Counts in proportion, none below 1, with sum TOTAL."""
    if not len(counts):
        return counts
    if len(counts) > TOTAL:
        raise ValueError("more symbols than the table has places")
    freqs = np.maximum(1, (counts.astype(np.float64) * TOTAL / counts.sum()).astype(np.int64))
    while over := int(freqs.sum()) - TOTAL:
        if over < 0:
            freqs[np.argmax(counts)] -= over
        else:
            room = freqs - 1
            cut = np.minimum(room, np.ceil(room * (over / room.sum())).astype(np.int64))
            order = np.argsort(-cut, kind="stable")
            cut[order] = np.diff(np.minimum(np.concatenate([[0], np.cumsum(cut[order])]), over))
            freqs -= cut
    return freqs


@dataclass(frozen=True)
class Block:
    n: int
    lanes: int
    words: np.ndarray  # uint32, in the order of decoding
    states: np.ndarray  # uint64, checkpoints x lanes; the first is the block's start
    steps: np.ndarray  # int64, the step of each checkpoint
    at: np.ndarray  # int64, the place in words of each checkpoint
    checksum: int  # CRC32 of the symbols as little-endian uint32


def encode(ids: np.ndarray, table: Table, lanes: int, every: int) -> Block:
    """One block; every: steps between checkpoints."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    by_symbol = np.zeros((2, int(table.symbols[-1]) + 1 if len(table.symbols) else 1), U64)
    by_symbol[:, table.symbols] = table.freqs, table.starts()[:-1]
    freq, start = by_symbol[0][ids], by_symbol[1][ids]
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, U64)
    out: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    for t in range(steps - 1, -1, -1):
        lo, hi = t * lanes, min(n, (t + 1) * lanes)
        f, c, x = freq[lo:hi], start[lo:hi], state[: hi - lo]
        full = np.flatnonzero(x >= f << U64(63 - SCALE))
        over = x[full]
        out.append(over.astype(np.uint32))
        x[full] = over >> U64(32)
        q = x // f
        x += q * (U64(TOTAL) - f) + c
        if t % every == 0:
            marks.append((t, state.copy()))
    out.reverse()
    marks.reverse()
    ends = np.concatenate([[0], np.cumsum([len(w) for w in out])]).astype(np.int64)
    at = np.array([t for t, _ in marks], np.int64)
    return Block(n, lanes, np.concatenate(out) if out else np.zeros(0, np.uint32), np.array([s for _, s in marks], U64).reshape(len(marks), lanes), at, ends[at], zlib.crc32(ids.astype("<u4").tobytes()))


def decoder(table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What decode() looks up: each slot's entry, and the entries' symbols, frequencies and starts."""
    return np.repeat(np.arange(len(table.symbols), dtype=np.int32), table.freqs), table.symbols, table.freqs.astype(U64), table.starts()[:-1].astype(U64)


def decode(block: Block, looked: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
    """Symbols from checkpoint `first` up to checkpoint `last` (the end). The whole block is held against its checksum."""
    slots, symbols, freqs, starts = looked
    count = len(block.steps)
    stop = -(-block.n // block.lanes) if last is None or last >= count else int(block.steps[last])
    if not block.n:
        return np.zeros(0, np.uint32)
    begin = int(block.steps[first])
    out = np.empty(min(block.n, stop * block.lanes) - begin * block.lanes, np.uint32)
    state, at = block.states[first].copy(), int(block.at[first])
    for t in range(begin, stop):
        k = min(block.n - t * block.lanes, block.lanes)
        x = state[:k]
        slot = x & U64(TOTAL - 1)
        entry = slots[slot]
        x = freqs[entry] * (x >> U64(SCALE)) + slot - starts[entry]
        low = np.flatnonzero(x < U64(LOW))
        if len(low):
            x[low] = (x[low] << U64(32)) | block.words[at : at + len(low)]
            at += len(low)
        state[:k] = x
        out[(t - begin) * block.lanes : (t - begin) * block.lanes + k] = symbols[entry]
    if first == 0 and stop * block.lanes >= block.n and zlib.crc32(out.astype("<u4").tobytes()) != block.checksum:
        raise ValueError("a block's symbols do not have its checksum")
    return out


# The file format. Integers are little-endian; arrays are a uint64 count and their bytes.
MAGIC = b"CVTOKEN1"


def _put(*arrays: np.ndarray) -> bytes:
    return b"".join(np.uint64(len(a)).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays)


class _Reader:
    def __init__(self, content: bytes) -> None:
        self.content, self.at = content, 0

    def array(self, kind: type) -> np.ndarray:
        n = int(np.frombuffer(self.content, np.uint64, 1, self.at)[0])
        out = np.frombuffer(self.content, kind, n, self.at + 8)
        self.at += 8 + out.nbytes
        return out


def write_file(blocks_of_ids: list[np.ndarray], lanes: int, every: int) -> bytes:
    """One file: a table that all its blocks share, then the blocks, then a checksum of all bytes before it."""
    table = Table.of(np.concatenate(blocks_of_ids)) if blocks_of_ids else Table(np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    parts = [MAGIC, _put(table.symbols, table.freqs), np.uint64(len(blocks_of_ids)).tobytes()]
    for ids in blocks_of_ids:
        b = encode(ids, table, lanes, every)
        parts.append(_put(np.array([b.n, b.lanes, b.checksum], np.int64), b.words, b.states.ravel(), b.steps, b.at))
    body = b"".join(parts)
    return body + np.uint64(zlib.crc32(body)).tobytes()


def read_file(content: bytes) -> tuple[Table, list[Block]]:
    if content[: len(MAGIC)] != MAGIC or zlib.crc32(memoryview(content)[:-8]) != int(np.frombuffer(content[-8:], np.uint64)[0]):
        raise ValueError("not a whole token file")
    r = _Reader(content)
    r.at = len(MAGIC)
    table = Table(r.array(np.uint32), r.array(np.uint32))
    n = int(np.frombuffer(content, np.uint64, 1, r.at)[0])
    r.at += 8
    blocks = []
    for _ in range(n):
        head = r.array(np.int64)
        words, states, steps, at = r.array(np.uint32), r.array(U64), r.array(np.int64), r.array(np.int64)
        blocks.append(Block(int(head[0]), int(head[1]), words, states.reshape(-1, int(head[1])), steps, at, int(head[2])))
    return table, blocks
