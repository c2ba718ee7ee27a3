"""Vectorised words over Arrow text columns.

Texts are worked in blocks of bounded bytes. A word is a byte span; its hash
is a polynomial over a random value for each byte, taken from one prefix sum
over the block, so no word becomes a Python object. 64 bits keep the chance of
any two words of a ten-million-word vocabulary colliding below one in 10^5.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, BLOCK_BYTES + 64), base, U)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=U)
    return _powers


def table(members, lower: bool = True) -> np.ndarray:
    """Boolean by byte: whether a word holds it. ``members`` tests the byte after A-Z are lowered."""
    return np.array([members(b + 32 if lower and 65 <= b <= 90 else b) for b in range(256)])


#: Words are runs of anything but the six ASCII white-space bytes.
NON_SPACE = table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of digits, lower-case letters and every byte outside ASCII.
ALNUM = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def strings(col: pa.Array) -> pa.Array:
    """The column as strings without nulls: a null text is an empty one."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows, starting at 0."""
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores after it as make it unlike every column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give freed memory of this worker back to the system: workers live on from task to task and stage to stage."""
    _powers[:] = [np.ones(1, U), np.ones(1, U)]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What this worker keeps from task to task, to be forgotten when a task of another kind begins.
caches: list[Callable[[], None]] = []


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``size`` bytes of text, or one row. ``keep`` leaves the worker's caches."""
    if not keep and not isinstance(batches, list):  # a task
        for forget in caches:
            forget()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(strings(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    if not isinstance(batches, list):  # the end of a task
        release()


def replaced(block: pa.RecordBatch, texts: dict[int, str], column: str = "text", length: str = "n_chars") -> pa.RecordBatch:
    """The block with new texts for some rows, and their lengths in characters where it has such a column."""
    if not texts:
        return block
    for name, of in ((column, str), (length, len)):
        if name in block.schema.names:
            values = block.column(name).to_pylist()
            for r, t in texts.items():
                values[r] = of(t)
            block = block.set_column(block.schema.names.index(name), name, pa.array(values, block.schema.field(name).type))
    return block


class Words:
    """Word spans of a block: ``start``/``end`` bytes, and ``first`` with the words of row i at first[i]:first[i+1]."""

    def __init__(self, col: pa.Array, members: np.ndarray = NON_SPACE, lower: bool = True):
        self.data, self.offsets = raw(strings(col))
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = members[self.data]
        begin = np.zeros(n + 1, bool)
        begin[self.offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | begin[:n]))
        stop = np.empty(n + 1, bool)
        stop[0] = False
        stop[1:] = inside
        stop[:n] &= ~inside | begin[:n]
        self.end = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, self.offsets)
        self._sum: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        if self._sum is None:
            self._sum = np.zeros(len(self.data) + 1, U)
            np.cumsum(_VALUE[self.data] * _power(len(self.data) + 1)[0][: len(self.data)], out=self._sum[1:])
        return self._sum

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _power(len(self.data) + 1)[1][start] + (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; one fewer than k gives one hash of the whole sequence, none gives none."""
    if not len(words):
        return np.zeros(0, U)
    width = min(k, len(words))
    out = np.zeros(len(words) - width + 1, U)
    for i in range(width):
        out = out * U(0x9E3779B97F4A7C15) + words[i : len(words) - width + 1 + i]
    return mix(out + U(width))


def word_hash(word: bytes) -> int:
    """The hash a word has in any block."""
    return int(Words(pa.array([word.decode("utf-8", "surrogatepass")]), np.ones(256, bool), False).hashes()[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)
