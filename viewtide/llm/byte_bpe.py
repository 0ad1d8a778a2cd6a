"""Byte-level BPE encoding and decoding with a queue of merge ranks.

Texts are cut into pre-tokens by the tokenizer's pattern. All pre-tokens of a chunk that are
neither a token nor known from before are merged together, in one linked list of byte pieces with
a gap between pre-tokens. ``RankQueue`` has a bucket of list positions for every merge rank and a
hierarchy of bitmaps over the buckets: find-first-set on each level gives the lowest rank in use,
whatever the length of the list. A merge puts the two new neighbour pairs into their buckets; the
entries of pairs that no longer exist are skipped when they come up. So a pre-token of n bytes
takes on the order of n steps, also when it is very long.

A single blank between two other characters always starts a pre-token, so texts are cut there
first and equal pieces are encoded once a chunk; texts with other blanks next to blanks are cut
by the pattern alone.

Defined cases: null and empty texts have no ids. Special tokens' strings are ordinary text. Null
or repeated doc_ids are kept as they are, row by row. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.llm import arrays

CHUNK_CHARS = 2 << 20
#: Characters of pre-tokens merged together; the lists of a merge take some 200 bytes a character.
MERGE_CHARS = 1 << 17
KNOWN = 200_000


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes by rank from lines of base64 text and number."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _portions(tokens: list[str], chars: int) -> Iterator[list[str]]:
    """``tokens`` in order, cut into lists of about ``chars`` characters or one longer token."""
    part, held = [], 0
    for t in tokens:
        if part and held + len(t) > chars:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


class RankQueue:
    """Positions by merge rank; ``pop`` gives the smallest rank's positions from left to right."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.levels: list[list[int]] = []
        while True:
            ranks = (ranks + 63) >> 6
            self.levels.append([0] * ranks)
            if ranks <= 1:
                break

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            for level in self.levels:
                word, bit = rank >> 6, 1 << (rank & 63)
                full = level[word]
                level[word] = full | bit
                if full:
                    break
                rank = word
        bucket.append(position)

    def fill(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Push many entries at once; positions rise."""
        order = np.argsort(ranks, kind="stable")
        starts = arrays.runs(ranks[order]).tolist()
        sorted_ranks, sorted_positions = ranks[order], positions[order].tolist()
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            rank = int(sorted_ranks[a])
            self.push(rank, sorted_positions[a])
            self.buckets[rank] += sorted_positions[a + 1 : z]

    def pop(self) -> tuple[int, list[int]] | None:
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        bucket, self.buckets[rank] = self.buckets[rank], []
        at = rank
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        bucket.sort()
        return rank, bucket


class ByteBpe:
    """Encoder and decoder for the given ranks and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.size = max(ranks.values(), default=-1) + 1
        self.words = [b""] * self.size
        for word, rank in ranks.items():
            self.words[rank] = word
        self.single = np.array([*(ranks[bytes([i])] for i in range(256)), -1])
        self.byte_pairs = np.full((257, 257), -1)
        self.byte_pairs[:256, :256] = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.tokens: list[dict[str, bytes]] = [{}, {}]
        self.pair: dict[int, int] = {}
        self.queue = RankQueue(self.size)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _rank(self, key: int) -> int:
        """Rank of the pair of ids ``key`` = first * size + second, -1 for none."""
        rank = self.ranks.get(self.words[key // self.size] + self.words[key % self.size], -1)
        if len(self.pair) > KNOWN:
            self.pair.clear()
        self.pair[key] = rank
        return rank

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """Ids, as bytes of little-endian 32-bit numbers, of each pre-token; all go through one queue."""
        size, known, rank_of, push, pop = self.size, self.pair, self._rank, self.queue.push, self.queue.pop
        lengths = np.array([len(t) for t in tokens], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))  # a gap after each
        at = np.arange(lengths.sum()) + np.repeat(np.arange(len(tokens)), lengths)
        data = np.full(starts[-1], 256)
        data[at] = np.frombuffer(b"".join(tokens), np.uint8)
        first_ranks = self.byte_pairs[data[:-1], data[1:]] if len(data) else data
        paired = np.flatnonzero(first_ranks >= 0)
        self.queue.fill(first_ranks[paired], paired)
        rank = [*first_ranks.tolist(), -1]  # of the pair that starts here, -1 for none
        ids = self.single[data].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (got := pop()) is not None:
            r, places = got
            base = r * size
            for i in places:
                if rank[i] != r:
                    continue  # stale: the pair was merged away or has changed
                j = after[i]
                k = after[j]
                ids[i], ids[j], rank[j] = r, -2, -1
                after[i] = k
                before[k] = i
                x = -1
                if (right := ids[k]) >= 0:
                    x = known.get(base + right)
                    if x is None:
                        x = rank_of(base + right)
                    if x >= 0:
                        push(x, i)
                rank[i] = x
                h = before[i]
                if h >= 0 and (left := ids[h]) >= 0:
                    x = known.get(left * size + r)
                    if x is None:
                        x = rank_of(left * size + r)
                    rank[h] = x
                    if x >= 0:
                        push(x, h)
        flat = np.array(ids, np.int64)
        kept = np.concatenate(([0], np.cumsum(flat >= 0))) * 4
        out = flat[flat >= 0].astype("<u4").tobytes()
        bounds = kept[starts].tolist()
        return [out[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces, as bytes of little-endian 32-bit numbers."""
        cut = {p: self.find(p) for p in pieces}
        young, old = self.tokens
        rare = []
        for t in set().union(*cut.values()).difference(young):
            word = t.encode()
            if word in self.ranks:
                young[t] = self.ranks[word].to_bytes(4, "little")
            elif t in old:
                young[t] = old[t]
            else:
                rare.append(t)
        for part in _portions(rare, MERGE_CHARS):
            young.update(zip(part, self.merge([t.encode() for t in part]), strict=True))
        known = {p: b"".join([young[t] for t in ts]) for p, ts in cut.items()}
        if len(young) > KNOWN:
            self.tokens = [{}, young]
        return known

    def _pieces(self, text: str) -> list[str]:
        pieces = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [""]
        if not pieces[0]:
            return self.find(text)
        ends = "".join([p[-1] for p in pieces[:-1]]) + "".join([p[1:2] or " " for p in pieces[1:]])
        return self.find(text) if any(map(str.isspace, ends)) else pieces

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        pieces = [self._pieces(t) for t in texts]
        wanted = set().union(*pieces)
        new = wanted.difference(self.young)
        known = {p: x for p in new if (x := self.old.get(p)) is not None}
        known |= self._learn(new.difference(known))
        self.young |= known
        get = self.young.__getitem__
        out = [b"".join(map(get, ps)) for ps in pieces]
        if len(self.young) > KNOWN:
            self.old, self.young = self.young, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _task(path: str, pattern: str, keep_ids: bool, keep_decoded: bool):
    def run(batches):
        with open(path, "rb") as lines:
            bpe = ByteBpe(read_ranks(lines), pattern)
        collecting = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and the caches are too large to be walked again and again
        try:
            yield from encoded(bpe, batches)
        finally:
            if collecting:
                gc.enable()

    def encoded(bpe, batches):
        for b in batches:
            ids, text = b.column("doc_id"), b.column("text")
            lengths = pc.binary_length(text).fill_null(0).to_pylist()
            first = 0
            while first < len(text):
                last, held = first, 0
                while last < len(text) and (last == first or held + lengths[last] <= CHUNK_CHARS):
                    held += lengths[last]
                    last += 1
                got = bpe.encode([x or "" for x in text[first:last].to_pylist()])
                plain = [bpe.decode(x) for x in got]
                columns = [ids[first:last], [len(x) // 4 for x in got], [hashlib.sha256(x).hexdigest() for x in got], [hashlib.sha256(x).hexdigest() for x in plain]]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in got], pa.list_(pa.int32())))
                    names.append("ids")
                if keep_decoded:
                    columns.append(pa.array(plain, pa.binary()))
                    names.append("decoded")
                columns[1] = pa.array(columns[1], pa.int64())
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in columns], names=names)
                first = last

    return run


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True, keep_decoded: bool | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, with ``keep_ids`` the ids, and with ``keep_decoded`` (as ``keep_ids``
    unless told otherwise) the decoded bytes.

    ``path`` is the vocabulary's file, present on every executor.
    """
    keep_decoded = keep_ids if keep_decoded is None else keep_decoded
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded binary" * keep_decoded
    return docs.select(F.col("doc_id").cast("long"), "text").transform(arrays.in_batches, _task(path, pattern, keep_ids, keep_decoded), schema)
