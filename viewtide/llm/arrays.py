"""Array helpers that run inside tasks: words, rolling hashes and packed hash buckets.

Texts arrive as Arrow batches. They are worked on in chunks of a few MB, so the memory of a task
follows the chunk (or one longer text), never the partition.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20
_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_GRAM = [_U(x | 1) for x in np.random.default_rng(7).integers(1, 1 << 63, 8, dtype=np.uint64)]
_powers: dict[str, np.ndarray] = {}


def _give_back() -> None:
    """Return freed memory to the system: a worker process lives on between tasks, beside the executor and other workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(task: Callable) -> Callable:
    """``task`` (a table function or a generator over batches) giving freed memory back when it ends."""
    if inspect.isgeneratorfunction(task):

        @functools.wraps(task)
        def run(batches):
            try:
                yield from task(batches)
            finally:
                _give_back()

    else:

        @functools.wraps(task)
        def run(table):
            try:
                return task(table)
            finally:
                _give_back()

    return run


def in_batches(df: DataFrame, task: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with a tidy task; for ``df.transform``."""
    return df.mapInArrow(tidy(task), schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= CHUNK_BYTES + 1:
            _powers[kind] = have
    return have[:n]


class Rolling:
    """Hashes of byte ranges from one running sum: equal bytes give equal hashes anywhere."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        codes = (_LOWER if lower else _CODES)[data]
        codes *= _power("up", _BASE, max(len(data), 1))[: len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes, out=self.sums[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        down = _power("down", _INVERSE, len(self.sums))
        return mix((self.sums[stop] - self.sums[start]) * down[start] + (stop - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * _power("down", _INVERSE, len(self.sums))[:n])


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Row slices of a batch with the UTF-8 bytes of ``column`` and the offsets of each row; null counts as empty."""
    text = batch.column(column)
    if text.type != pa.large_binary():
        text = text.cast(pa.large_binary())
    if text.null_count:
        text = text.fill_null(b"")
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(text))
        yield slice(first, last), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of each word, and the index of its first word for each row (one more at the end)."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    stop = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, stop, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, concatenated, and where each row's begin.

    A shingle is ``width`` consecutive words, A-Z lower-cased. A row with fewer words, but one at
    least, has its whole sequence as its only shingle. A row without words has none.
    """
    start, stop, first = word_ranges(data, offsets)
    words = Rolling(data, lower=True).ranges(start, stop)
    n = max(0, len(words) - width + 1)
    grams = np.zeros(n, np.uint64)
    for j in range(width):
        grams += words[j : j + n] * _GRAM[j]
    grams = mix(grams)
    sets, bounds = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = mix(np.array([sum(int(words[a + j]) * int(_GRAM[j]) for j in range(b - a)) + (b - a) * int(_GRAM[width]) & (1 << 64) - 1], np.uint64))
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        bounds.append(bounds[-1] + len(own))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array(bounds)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(33)) % _U(buckets)).astype(np.int64)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from block-wise running minima in both directions."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    ahead = np.minimum.accumulate(padded.reshape(blocks, width), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def packed(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All binary values of a column as one array of numbers."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), kind)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def deal(doc: np.ndarray, columns: dict[str, np.ndarray], groups: int) -> pa.Table:
    """Entries about documents, packed by hash group of the document: a row per group, not per document."""
    group = bucket_of(mix(doc.view(np.uint64)), groups)
    order = np.argsort(group, kind="stable")
    starts = runs(group[order])
    parts = [order[a:z] for a, z in zip(starts[:-1], starts[1:], strict=True)]
    out = {"part": pa.array(group[order][starts[:-1]], pa.int64()), "docs": pa.array([doc[p].tobytes() for p in parts], pa.binary())}
    return pa.table(out | {c: pa.array([x[p].tobytes() for p in parts], pa.binary()) for c, x in columns.items()})


def gather(table: pa.Table, columns: dict[str, str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct documents of dealt entries, where each one's entries begin, and the columns in that order."""
    doc = packed(table.column("docs"), "<i8")
    order = np.argsort(doc, kind="stable")
    starts = runs(doc[order])
    return doc[order][starts[:-1]], starts, [packed(table.column(c), k)[order] for c, k in columns.items()]


class Forest:
    """Union-find over small non-negative numbers; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
