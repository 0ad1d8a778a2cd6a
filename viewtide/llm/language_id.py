"""Language identification: a convolutional network over bytes, trained in numpy on labelled texts.

A window of ``WINDOW`` bytes, A-Z lower-cased, passes an embedding of bytes, filters of several ``WIDTHS``, a rectifier and the maximum
over all places, and a softmax over the languages. Filters on embedded bytes are sums of table rows,
one table per place in the filter, so that scoring looks rows up by byte pair and adds them. A text is cut into
windows from end to end, the last one filled with blanks; its probabilities are the mean over its
windows, weighed by their letters (ASCII letters, and bytes outside ASCII).

``fit`` learns from a bounded sample: of each language the ``SAMPLE_ROWS`` documents with the smallest hash of
their id (found among a hash share of about four times as many), of each ``SAMPLE_WINDOWS`` windows at hashed places of the whole text, for the ``MOST_LANGUAGES`` languages with
the most labelled rows. The sample depends on the rows alone, not on their layout; a few MB reach the
driver, which trains with Adam from a fixed seed. All texts are scored in full. A lost executor costs its own rows only.

Defined cases: a text that is null or has no letter (Unicode category L) is ``und`` with score 0; so is every text
when no labelled row has letters. With a single language every text with letters is of that one, score 1. Rows without
doc_id teach nothing but are scored. Rows that repeat a doc_id are scored one by one and teach each on its own. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewtide.llm import arrays

WINDOW = 128
WIDTHS = (2, 3, 4)
EMBEDDING, FILTERS = 16, 16
SAMPLE_ROWS, SAMPLE_WINDOWS, MOST_LANGUAGES = 500, 4, 200
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.01, 1e-4
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Network:
    """Weights: ``embedding`` (byte, value), per width ``filters`` (place, value, filter), ``dense`` (filter, language), biases."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """Per width the sum each byte adds to each filter at each place of it: (place, byte, filter)."""
        return [np.stack([self.embedding @ step for step in f]) for f in self.filters]

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = pooled @ self.dense + self.offset
        logits = np.exp(logits - logits.max(1, keepdims=True))
        return logits / logits.sum(1, keepdims=True)


class Scorer:
    """A network ready to score: the tables of two neighbouring places are merged, by byte pair."""

    def __init__(self, net: Network):
        self.net = net
        self.pairs = []
        for table in net.tables():
            steps = [(k, (table[k][:, None, :] + table[k + 1][None, :, :]).reshape(1 << 16, -1)) for k in range(0, len(table) - 1, 2)]
            if len(table) % 2:
                steps.append((len(table) - 1, table[-1]))
            self.pairs.append((len(table), steps))

    def score(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (window, language) of windows of bytes."""
        pair = windows[:, :-1].astype(np.uint16) << 8 | windows[:, 1:]
        pooled = []
        for (width, steps), bias in zip(self.pairs, self.net.biases, strict=True):
            n = windows.shape[1] - width + 1
            total = None
            for at, table in steps:
                codes = pair if len(table) > 256 else windows
                part = table[codes[:, at : at + n]]
                total = part if total is None else np.add(total, part, out=total)
            while total.shape[1] > 1:  # maximum over the places, by halves
                half = total.shape[1] // 2
                folded = np.maximum(total[:, :half], total[:, half : 2 * half])
                if total.shape[1] % 2:
                    np.maximum(folded[:, 0], total[:, -1], out=folded[:, 0])
                total = folded
            pooled.append(np.maximum(total[:, 0] + bias, 0))
        return self.net.softmax(np.concatenate(pooled, 1))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 0) -> Network:
    """A network for ``windows`` (row, byte) of the languages numbered in ``labels``."""
    rng = np.random.default_rng(seed)

    def weights(*shape):
        return rng.normal(0, 1 / np.sqrt(np.prod(shape[:-1])), shape).astype(np.float32)

    net = Network(
        languages,
        rng.normal(0, 1, (256, EMBEDDING)).astype(np.float32),
        [weights(w, EMBEDDING, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        weights(FILTERS * len(WIDTHS), len(languages)),
        np.zeros(len(languages), np.float32),
    )
    values = [net.embedding, *net.filters, *net.biases, net.dense, net.offset]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            step += 1
            for v, g, (m, s) in zip(values, _gradients(net, windows[rows], labels[rows]), moments, strict=True):
                g = g + DECAY * v
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= (RATE / (1 - 0.9**step) * m / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy; behind the maxima only the winning places carry any."""
    tables = net.tables()
    places, pooled = [], []
    for table, bias in zip(tables, net.biases, strict=True):
        n = x.shape[1] - len(table) + 1
        total = sum(t[x[:, k : k + n]] for k, t in enumerate(table)) + bias
        at = total.argmax(1)
        places.append(at)
        pooled.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
    hidden = np.concatenate(pooled, 1)
    active = hidden > 0
    hidden = hidden * active
    slope = net.softmax(hidden)
    slope[np.arange(len(y)), y] -= 1
    slope /= len(y)
    back = (slope @ net.dense.T) * active
    embedding, filters, biases = np.zeros_like(net.embedding), [], []
    row = np.arange(len(x))[:, None]
    for i, (f, at) in enumerate(zip(net.filters, places, strict=True)):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        own = np.zeros_like(f)
        for k, step in enumerate(f):
            table = np.zeros((256, FILTERS), np.float32)
            np.add.at(table, (x[row, at + k], np.arange(FILTERS)), g)
            own[k] = net.embedding.T @ table
            embedding += table @ step.T
        filters.append(own)
        biases.append(g.sum(0))
    return [embedding, *filters, *biases, hidden.T @ slope, slope.sum(0)]


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS, languages: int = MOST_LANGUAGES) -> list[tuple[str, bytes]]:
    """(lang, window) pairs of the bounded training sample of ``docs`` (doc_id, text, lang)."""
    known = docs.where("lang is not null and doc_id is not null").where(has_letter("text"))
    kept = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    code = F.encode("text", "utf-8")
    room = F.greatest(F.octet_length("text") - WINDOW, F.lit(0)) + 1
    cut = [F.substring(code, (F.pmod(F.xxhash64("doc_id", F.lit(k)), room) + 1).cast("int"), F.lit(WINDOW)) for k in range(windows)]
    # by hash four times as many as wanted, so that what meets for the exact choice does not grow with the table
    hash_ = F.shiftrightunsigned(F.xxhash64("doc_id"), 24)
    early = hash_ / (1 << 40) < 4 * rows / F.col("n")
    chosen = known.join(F.broadcast(kept), "lang").where(early).select("lang", hash_.alias("hash"), "doc_id", F.array(*cut).alias("windows"))
    first = Window.partitionBy("lang").orderBy("hash", "doc_id", "windows")
    table = chosen.withColumn("place", F.row_number().over(first)).where(F.col("place") <= rows).select("lang", "place", "windows")
    return [(r.lang, bytes(w)) for r in sorted(table.collect(), key=lambda r: (r.lang, r.place)) for w in r.windows]


def fit(docs: DataFrame, **bounds) -> Network | None:
    """A network from the labelled rows of ``docs`` (doc_id, text, lang); None without any."""
    pairs = sample(docs, **bounds)
    if not pairs:
        return None
    languages = sorted({lang for lang, _ in pairs})
    data = np.frombuffer(b"".join(w.ljust(WINDOW) for _, w in pairs), np.uint8).reshape(-1, WINDOW)
    return train(_FOLD[data], np.array([languages.index(lang) for lang, _ in pairs]), languages)


def has_letter(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts, filled up with blanks, and the text each belongs to."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    start = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][text][:, None]
    if not len(text):
        return np.zeros((0, WINDOW), np.uint8), text
    return np.where(inside, _FOLD[data[np.minimum(at, len(data) - 1)]], np.uint8(0x20)), text


SCORED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(net: Network | None, block: int = 256):
    def task(batches):
        scorer = Scorer(net) if net else None
        for b in batches:
            able = b.column("able").to_numpy(zero_copy_only=False)
            for rows, data, offsets in arrays.chunks(b):
                n = len(offsets) - 1
                pred, score = [UNKNOWN] * n, np.zeros(n)
                if scorer is not None:
                    windows, text = _cut(data, offsets)
                    weight = _LETTER[windows].sum(1)
                    total = np.zeros((n, len(net.languages)))
                    for first in range(0, len(windows), block):
                        part = slice(first, first + block)
                        np.add.at(total, text[part], scorer.score(windows[part]) * weight[part, None])
                    total /= np.maximum(np.bincount(text, weight, n), 1)[:, None]
                    for i in np.flatnonzero(able[rows]):
                        best = int(total[i].argmax())
                        pred[i], score[i] = net.languages[best], min(1.0, total[i, best])
                yield arrays.batch(SCORED, b.column("doc_id").slice(rows.start, n), pred, score)

    return task


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score (mean probability of that language) of each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", has_letter("text").alias("able"))
    return rows.mapInArrow(_predict(net), "doc_id long, lang_pred string, score double")
