"""CRC-32 of many byte spans at once, by tables of what a byte adds at its distance from the end.

CRC-32 is affine: a span's value is the XOR of one word for each byte, which depends on the byte and on its
distance from the end only, and of a constant for the length. Spans longer than the table are cut into
blocks from their end; blocks' values are shifted past what follows and folded in pairs.
"""

from __future__ import annotations

import zlib

import numpy as np

from groundloom.llm.pretokens import gather

POLYNOMIAL = 0xEDB88320
#: Distances in the table, a power of two.
REACH = 64


def _one_byte() -> np.ndarray:
    """The register after each byte, from a register of zero."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _shift(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers moved on by the zero bytes that a table of four times 256 entries stands for."""
    return by[0][values & 255] ^ by[1][values >> 8 & 255] ^ by[2][values >> 16 & 255] ^ by[3][values >> 24]


class SpanCrc:
    def __init__(self) -> None:
        first = _one_byte()
        rows = [first]
        for _ in range(REACH - 1):
            rows.append((rows[-1] >> 8) ^ first[rows[-1] & 255])
        #: position[d, b]: what byte b adds at distance d from the end.
        self.position = np.stack(rows)
        self.length = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)
        step = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        for _ in range(REACH):
            step = (step >> 8) ^ first[step & 255]
        #: shifts[j]: by REACH * 2**j zero bytes.
        self._shifts = [step]

    def _by(self, j: int) -> np.ndarray:
        while len(self._shifts) <= j:
            last = self._shifts[-1]
            self._shifts.append(np.stack([_shift(row, last) for row in last]))
        return self._shifts[j]

    def of(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Unsigned CRC-32 of each span of bytes; spans may overlap."""
        out = np.zeros(len(starts), np.uint32)
        short = lengths <= REACH
        out[short] = self._table(data, starts[short], lengths[short]) ^ self.length[lengths[short]]
        if not short.all():
            out[~short] = self._folded(data, starts[~short], lengths[~short])
        return out

    def _table(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """XOR of the bytes' words over spans of at most REACH bytes."""
        out = np.zeros(len(starts), np.uint32)
        some = lengths > 0
        starts, lengths = starts[some], lengths[some]
        if len(starts):
            ends = np.cumsum(lengths)
            distance = np.repeat(ends, lengths) - np.arange(1, ends[-1] + 1)
            words = self.position[distance, gather(data, starts, lengths)]
            out[some] = np.bitwise_xor.reduceat(words, ends - lengths)
        return out

    def _folded(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Blocks of REACH bytes counted from a span's end (the first may be shorter), then pairs of neighbours folded."""
        blocks = -(-lengths // REACH)
        span = np.repeat(np.arange(len(starts)), blocks)
        last = np.cumsum(blocks)
        left = np.repeat(last, blocks) - np.arange(1, last[-1] + 1)  # blocks after this one
        end = starts[span] + lengths[span] - left * REACH
        begin = np.maximum(end - REACH, starts[span])
        values = self._table(data, begin, end - begin)
        ones = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        j = 0
        while len(values):
            by = self._by(j)
            odd = blocks & 1 == 1
            # The starting register is moved past the length bit by bit, its part below a block by single bytes.
            full = lengths // REACH >> j & 1 == 1
            ones[full] = _shift(ones[full], by)
            if (blocks <= 1).all() and (lengths // REACH >> j <= 1).all():
                break
            # Pairs end at a span's end, so an odd first block stands alone.
            at = np.flatnonzero(left & 1 == 0)
            lone = np.zeros(len(values), bool)
            lone[(np.cumsum(blocks) - blocks)[odd]] = True
            with_left = ~lone[at]
            merged = values[at]
            merged[with_left] ^= _shift(values[at[with_left] - 1], by)
            values, left, blocks = merged, left[at] >> 1, (blocks + 1) >> 1
            j += 1
        rest = lengths % REACH
        first = self.position[0]
        while (rest > 0).any():
            more = rest > 0
            ones[more] = (ones[more] >> 8) ^ first[ones[more] & 255]
            rest = rest - more
        return values ^ ones ^ np.uint32(0xFFFFFFFF)
