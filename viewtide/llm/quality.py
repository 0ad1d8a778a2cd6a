"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` counts words, symbols, repeated lines and repeated word windows of whole texts.
``train`` fits boosted trees on a bounded sample of labelled rows; features named in
``DIRECTIONS`` may only move the score one way: a split that would turn it is refused and the
values of both sides are held on their side of the split's middle. ``Trees`` is the flattened
model: numpy arrays of feature, threshold, children and value, walked level by level for a whole
batch at once.

Defined cases: null and empty texts have zero counts and fail the base rules. Without labels of
both kinds the trees have no verdict and every document that passes the base rules is kept. Rows
that repeat a doc_id are judged as rows of their own; a null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.llm import arrays
from viewtide.session import stage_table

WINDOW = 3
LEAST_WORDS = 50
SAMPLE_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "words_a_line")
DIRECTIONS = (0, 0, -1, -1, -1, 0)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _extra(keys: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more in their row, and how many of a row repeat an earlier one."""
    own = arrays.mix(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    starts = arrays.runs(own[order])
    length = np.diff(starts)
    many = np.zeros(len(keys), bool)
    many[order] = np.repeat(length > 1, length)
    return many, np.bincount(doc[order[starts[:-1]]], length - 1, minlength=rows).astype(np.int64) if len(keys) else np.zeros(rows, np.int64)


def count_batch(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each row of a chunk."""
    rows = len(offsets) - 1
    start, stop, first = arrays.word_ranges(data, offsets)
    rolling = arrays.Rolling(data)
    words = rolling.ranges(start, stop)
    doc = np.repeat(np.arange(rows), np.diff(first))
    n = max(0, len(words) - WINDOW + 1)
    grams = sum((words[j : j + n] * np.uint64(c) for j, c in enumerate((3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))), np.zeros(n, np.uint64))
    inside = doc[:n] == doc[WINDOW - 1 :] if n else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    again = at[_extra(grams[at], doc[at], rows)[0]]
    covered = np.zeros(len(words), bool)
    for j in range(WINDOW):
        covered[again + j] = True
    per_row = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((breaks + 1, offsets[:-1])))
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    line_stop = np.append(breaks, len(data))[np.searchsorted(breaks, line_start)]
    line_stop = np.minimum(line_stop, offsets[line_doc + 1])
    worded = np.searchsorted(start, line_stop) > np.searchsorted(start, line_start)
    line_start, line_stop, line_doc = line_start[worded], line_stop[worded], line_doc[worded]
    dup = _extra(rolling.ranges(line_start, line_stop), line_doc, rows)[1]
    letters = ((data & 0xC0) != 0x80) & ~arrays.SPACE[data]
    return {
        "n_words": np.diff(first),
        "word_chars": per_row(letters),
        "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(doc, covered, minlength=rows).astype(np.int64),
        "n_lines": np.bincount(line_doc, minlength=rows),
    }


def _count(batches):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
    for b in batches:
        ids = b.column("doc_id")
        for rows, data, offsets in arrays.chunks(b):
            got = count_batch(data, offsets)
            yield pa.RecordBatch.from_arrays([ids[rows], *(pa.array(got[c], pa.int64()) for c in COUNTS)], schema=schema)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of ``COUNTS`` for each row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").transform(arrays.in_batches, _count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    words, lines = np.maximum(counts["n_words"], 1), np.maximum(counts["n_lines"], 1)
    return np.stack(
        (np.log1p(counts["n_words"]), counts["word_chars"] / words, counts["n_symbols"] / words, counts["n_dup_lines"] / lines, counts["n_repeat_words"] / words, counts["n_words"] / lines), 1
    )


@dataclass
class Trees:
    """Flattened boosted trees: node arrays of all trees, and where each tree begins."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        while (inner := self.feature[node] >= 0).any():
            low = x[row, self.feature[node]] <= self.threshold[node]
            node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def train(x: np.ndarray, y: np.ndarray, directions=DIRECTIONS, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, penalty: float = 1.0, least: float = 2.0) -> Trees | None:
    """Boosted trees on logistic loss over feature quantiles; None unless both labels occur."""
    if not len(y) or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        g, h = grad[rows], hess[rows]
        value = float(np.clip(-g.sum() / (h.sum() + penalty), low, high))
        nodes.append([-1, 0.0, -1, -1, rate * value])
        best = (1e-6, -1, 0, 0.0)
        if level < depth:
            whole = g.sum() ** 2 / (h.sum() + penalty)
            for f, c in enumerate(cuts):
                gl, hl = (np.cumsum(np.bincount(binned[rows, f], w, minlength=len(c) + 1))[:-1] for w in (g, h))
                gr, hr = g.sum() - gl, h.sum() - hl
                gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - whole
                rise = np.clip(-gr / (hr + penalty), low, high) - np.clip(-gl / (hl + penalty), low, high)
                gain[(hl < least) | (hr < least) | (directions[f] * rise < 0)] = 0
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    sides = np.clip([-gl[k] / (hl[k] + penalty), -gr[k] / (hr[k] + penalty)], low, high)
                    best = (float(gain[k]), f, k, float(sides.mean()))
        if best[1] < 0:
            margin[rows] += rate * value
            return at
        _, f, k, middle = best
        small = binned[rows, f] <= k
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[directions[f]]
        left = grow(rows[small], level + 1, *bounds[0])
        right = grow(rows[~small], level + 1, *bounds[1])
        nodes[at] = [f, float(cuts[f][k]), left, right, 0.0]
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    columns = list(zip(*nodes, strict=True))
    return Trees(*(np.array(c) for c in columns), np.array(roots), base)


def fit(counts: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees for labels.quality from at most about ``sample_rows`` labelled rows, chosen by a hash of their id."""
    known = counts.join(labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long"), F.col("quality").cast("int")), "doc_id")
    total = known.count()
    if total > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    table = known.select("doc_id", *COUNTS, "quality").toPandas().sort_values(["doc_id", *COUNTS, "quality"])
    return train(features({c: table[c].to_numpy() for c in COUNTS}), table["quality"].to_numpy(float))


def _kept(counts: dict[str, np.ndarray], model: Trees | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the base rules fail, the score, and whether the row stays."""
    failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    score = model.score(features(counts)) if model is not None else np.ones(len(failed))
    return failed, score, ~failed & (score >= threshold)


def _judge(model: Trees | None, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS[:5]), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])

    def task(batches):
        for b in batches:
            c = {k: b.column(k).to_numpy() for k in COUNTS}
            failed, score, kept = _kept(c, model, threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(k) for k in COUNTS[:5]), pa.array(failed), pa.array(score), pa.array(kept)], schema=schema)

    return task


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, counts, base_failed, score (probability of good quality) and kept for each row of ``docs``."""
    counts = stage_table(statistics(docs), "quality-counts")
    model = fit(counts, labels, sample_rows)
    return counts.transform(arrays.in_batches, _judge(model, threshold), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, score double, kept boolean")


def _keep(model: Trees | None, threshold: float):
    def task(batches):
        for b in batches:
            verdicts = [_kept(count_batch(data, offsets), model, threshold)[2] for _, data, offsets in arrays.chunks(b)]
            yield b.filter(pa.array(np.concatenate(verdicts) if verdicts else np.zeros(0, bool)))

    return task


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept. Each row is judged where it lies, with or without doc_id, so no text moves."""
    model = fit(stage_table(statistics(docs), "quality-counts"), labels, sample_rows)
    return docs.transform(arrays.in_batches, _keep(model, threshold), docs.schema)
