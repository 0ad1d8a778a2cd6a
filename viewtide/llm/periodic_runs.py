"""Periodic run detection: a dictionary of basic factors over the words of each text.

A run is a stretch of words with smallest period q that repeats at least ``LEAST_TIMES`` times, holds at
least ``LEAST_WORDS`` words, and that no neighbouring word extends keeping the period. For m = 1, 2, 4, ... the
dictionary names every factor of m words: a factor of 2m words is the pair of names of its halves. Equal
factors of one text lie together when the pairs are sorted by name and place, so the next occurrence of each
factor is its neighbour.

Level m proposes the periods q with m/2 < q <= m. Inside a run of such a period the next occurrence of the
factor at i is at i + q, neither nearer (the period would not be the smallest) nor further, as long as
both fit into the run. So its occurrences i, i + q, i + 2q, ... form arithmetic progressions of
difference q, side by side for consecutive i. A maximal stretch of consecutive places a..b whose factors all
recur after q words thus extends to the run a..b + q + m - 1: at a - 1 and after b + q + m - 1 a word differs from
the one q words on. Each period belongs to one level and each run to one stretch, so nothing is found twice.

A factor that occurs once in its text is left out from then on, as no factor that begins with it recurs either. Plain
texts therefore fall silent after a few levels. The work is n log n in the words of a text at most, the memory
proportional to one chunk of texts (or one longer text). Words are compared exactly, through a dictionary
of the chunk. Texts do not meet, so nothing is shuffled and a lost executor costs its own rows only.

Defined cases: null and empty texts and texts without words have no runs and collapse to an empty text. Every
row is judged on its own, so rows that repeat a doc_id or have none each give their own result. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.llm import arrays
from viewtide.llm.words import WORD

# What counts as a run.
LEAST_WORDS, LEAST_TIMES = 6, 4

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``names``), length and period of all runs, by start and period; texts begin at ``first`` and do not meet."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = first[1:][text]
    place = np.arange(len(names))
    key = text * (int(names.max()) + 1 if len(names) else 1) + names
    found = []
    m = 1
    while len(place):
        order = np.argsort(key, kind="stable")
        at, sorted_key = place[order], key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        gap = at[1:] - at[:-1]
        near = same & (gap <= m) & (2 * gap > m)
        found.append(_stretches(at[:-1][near], gap[near], m))
        # names of the factors that occur again; the others have none
        again = np.zeros(len(at), bool)
        again[1:] |= same
        again[:-1] |= same
        name = np.full(len(names) + 1, -1)
        name[at[again]] = np.concatenate(([0], np.cumsum(~same)))[again]
        place = np.flatnonzero(name[:-1] >= 0)
        place = place[place + 2 * m <= end[place]]
        place = place[name[place + m] >= 0]
        key = name[place] * len(at) + name[place + m]
        m *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _stretches(place: np.ndarray, period: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs from the places whose factor of ``m`` words recurs after ``period`` words."""
    order = np.argsort(place)
    place, period = place[order], period[order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])
    head = np.flatnonzero(new)
    start, period = place[head], period[head]
    length = np.diff(np.append(head, len(place))) - 1 + period + m
    kept = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    return start[kept], length[kept], period[kept]


def _dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Marks of the words that a run contains after its first ``period`` words."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) > 0


def _joined(data: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words of each text joined by one space, and where each text begins."""
    size = stop - start + 1
    ends = np.cumsum(size)
    out = data[np.minimum(np.arange(size.sum()) + np.repeat(start - (ends - size), size), len(data) - 1)] if len(size) else np.zeros(0, np.uint8)
    out[ends - 1] = 0x20
    last = np.zeros(len(out), bool)  # the space behind a text's last word
    filled = first[1:] > first[:-1]
    last[ends[first[1:][filled] - 1] - 1] = True
    lengths = np.concatenate(([0], ends))[first]
    lengths = np.diff(lengths) - filled
    return out[~last], np.concatenate(([0], np.cumsum(lengths)))


KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(batches):
    for b in batches:
        for rows, data, offsets in arrays.chunks(b):
            start, stop, first = arrays.word_ranges(data, offsets)
            bounds = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int64)
            letters = data[~arrays.SPACE[data]]
            words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
            names = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            at, length, period = find_runs(names, first)
            kept = ~_dropped(len(names), at, length, period)
            left = np.concatenate(([0], np.cumsum(kept)))[first]
            text, edges = _joined(data, start[kept], stop[kept], left)
            row = np.searchsorted(first, at, "right") - 1
            cuts = np.searchsorted(row, np.arange(len(first)))
            values = pa.StructArray.from_arrays([pa.array(x) for x in (at - first[row], length, period)], fields=list(KIND.value_type))
            runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
            collapsed = pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))])
            ids = b.column("doc_id").slice(rows.start, rows.stop - rows.start)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), runs, collapsed.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start and period) and collapsed (the words left, joined by a space) of each row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def longest_run(runs: str | Column) -> Column:
    """The run of greatest length, of these the first, of these the one of smallest period; null without runs."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def looped_text(doc_id: str = "doc_id", text: str = "text") -> Column:
    """``text`` with, in a tenth of the documents, the words from some place on turned into a loop.

    With h the CRC-32 of the decimal doc_id, g = h div 10 and n words, documents with h mod 10 = 0 get their words from a = g mod n on
    replaced by repetitions of the 1 + (n - a) div (3 + g mod 8) words that begin there. Without doc_id or words a text stays.
    """
    h = F.crc32(F.col(doc_id).cast("long").cast("string"))
    g = F.floor(h / 10).cast("long")

    def loop(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        times = (F.floor((n - a) / p) + 1).cast("int")
        again = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times)), 1, (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a.cast("int")), again), " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    # one element to bind the list of words to a name, so that it is made once
    looped = F.transform(F.array(words), loop)[0]
    return F.when(F.pmod(h, F.lit(10)) == 0, looped).otherwise(F.col(text))
