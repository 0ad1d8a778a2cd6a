"""Phrase collocation mining by dynamic itemset counting.

Phrases of one to ``LONGEST`` words are counted per language, exactly for all that occur ``least`` times:

1. The documents are dealt to ``SHARDS`` shards by hash and written once. Shards are scanned in turn, over and over.
2. Words are counted from the first scan on. After each scan the phrases whose running count has reached the
   threshold are marked, and from the next scan on those phrases one word longer are counted of which both
   subphrases (without the last word, without the first) are marked. So lengths interleave: common phrases of three
   words are counted while rare words still are.
3. A phrase that began with scan s is complete after scan s + ``SHARDS`` - 1, when it has met every shard once. The
   scans end when no active phrase can be incomplete. A subphrase occurs at least as often as its phrase, so no frequent phrase
   is missed, wherever its subphrases reach the threshold.

The tasks of a scan count their active phrases chunk by chunk and merge the counts before they are shuffled, packed by
hash bucket, rare phrases as soon as ``MERGE_ROWS`` are held; the running counts of incomplete phrases meet them there. A
very common phrase thus costs a few entries a task. Phrases are compared as strings, not by hash.

Marks are, for each length below the longest, a table of bytes by hash slot: the scan from which on the slot is marked. It
has one slot for ``BYTES_A_SLOT`` bytes of text, ``LEAST_SLOTS`` at least and ``MOST_SLOTS`` (32 MB) at most, which bounds what each task gets and the new slots the driver
collects. A slot keeps its first scan, and a phrase begins after its subphrases did, so its first scan never
changes. Two phrases in one slot make further phrases active, or earlier: more work, same results. A corpus far
beyond the bound counts most phrases of three words, still one entry a phrase and task.

``collocations`` compares exact decimals of 38 digits (right for counts up to 10^16); a * a is at most l * r, so scores
are at most ``SCALE``.

Defined cases: null text is empty, null lang is ``und``. A-Z are lower-cased. Pieces end at ``.,;:!?`` and at the bytes 10
to 13, words at blanks and tabs; texts without words add nothing. doc_id plays no part: rows that repeat one, or have none,
count each on their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from viewtide.llm import arrays
from viewtide.session import remove_staged, stage_table

# The candidates and the report.
LEAST, LONGEST, TOP = 10, 3, 2000
INSIDE_PERCENT, SCALE = 50, 1_000_000
UNKNOWN = "und"

SHARDS = 3
BUCKET_BYTES = 4 << 20
LEAST_SLOTS, MOST_SLOTS, BYTES_A_SLOT = 1 << 16, 1 << 25, 64
CHUNK_BYTES = 2 << 20
MERGE_ROWS, FEW = 1 << 18, 4
HOT_PARTS = 1000
SALTS = 64
NEVER = 255

_SPACE, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP = [np.uint64(x | 1) for x in np.random.default_rng(11).integers(1, 1 << 63, LONGEST, dtype=np.uint64)]

#: entries of one hash bucket: groups of one language, length, first scan and mark; phrases joined by newlines; counts
PACKED = [("bucket", pa.int64()), ("languages", pa.list_(pa.string())), ("groups", pa.binary()), ("phrases", pa.binary()), ("counts", pa.binary())]
ENTRIES = pa.schema(PACKED)
ENTRY = "bucket long, languages array<string>, groups binary, phrases binary, counts binary"
GROUP = np.dtype([("lang", "<u4"), ("rows", "<u4"), ("size", "u1"), ("first", "u1"), ("told", "u1")])
#: entries still being counted; or a finished phrase and its count; or slots newly marked
STATE = pa.schema([*PACKED, ("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64()), ("slots", pa.binary())])
STATES = ENTRY + ", lang string, phrase string, size int, n long, slots binary"
COLUMNS = ["lang", "phrase", "size", "first", "told", "hash", "n"]


def language_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a chunk of texts: hashes with their language, pieces and, when asked for, exact numbers and strings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, code: np.ndarray):
        """``lang`` numbers the language of each text; ``code`` holds the hash of each number's language."""
        data = _FOLD[data]
        ends = _STOP[data]
        word = ~(_SPACE[data] | ends)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start, stop = word.copy(), word.copy()
        start[1:] &= ~word[:-1] | edge[1:-1]
        stop[:-1] &= ~word[1:] | edge[1:-1]
        start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.piece = np.cumsum(ends | edge[:-1], dtype=np.int32)[start]
        self.row = np.searchsorted(offsets, start, "right") - 1
        self.lang = lang[self.row]
        self.hash = arrays.mix(arrays.Rolling(data).ranges(start, stop) + code[self.lang])
        self._letters, self._size = data[word], stop - start

    @cached_property
    def dictionary(self) -> tuple[pa.Array, np.ndarray]:
        """The different words, and each word's number among them."""
        bounds = np.concatenate(([0], np.cumsum(self._size))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(self._size), [None, pa.py_buffer(bounds), pa.py_buffer(self._letters)]).dictionary_encode()
        return words.dictionary, words.indices.to_numpy().astype(np.int64)

    def longer(self, at: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the phrases of ``size`` - 1 words at ``at``, those with another one word on in the same piece, and the hashes of both joined."""
        last = np.minimum(at[:-1] + size - 1, len(self.piece) - 1)
        joined = np.flatnonzero((at[1:] == at[:-1] + 1) & (self.piece[at[:-1]] == self.piece[last]))
        return joined, arrays.mix(hashes[joined] * _STEP[size - 2] + self.hash[at[joined] + size - 1])

    def counted(self, at: np.ndarray, size: int, hashes: np.ndarray, first: np.ndarray) -> pa.Table:
        """Counts of the different phrases of ``size`` words at the words ``at``; hashes and first scans are theirs."""
        strings, name = self.dictionary
        key = self.lang[at] * len(strings) + name[at]
        for k in range(1, size):
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(strings) + name[at + k]
        _, one, n = np.unique(key, return_index=True, return_counts=True)
        parts = [strings.take(pa.array(name[at[one] + k])) for k in range(size)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        return _table(self.lang[at[one]], phrase, size, first[one], hashes[one], n)


def _table(lang, phrase, size: int, first, hashes: np.ndarray, n) -> pa.Table:
    columns = [lang, phrase, np.full(len(n), size, np.int32), first, np.zeros(len(n), bool), hashes.view(np.int64), n]
    return pa.table([pa.array(c) for c in columns], names=COLUMNS)


def active_counts(words: Words, scan: int, shards: int, marks: np.ndarray) -> list[pa.Table]:
    """Counts in a chunk of the phrases that ``scan`` counts, by length."""
    slots = np.uint64(marks.shape[1] - 1)
    at, hashes, first = np.arange(len(words.hash)), words.hash, np.zeros(len(words.hash), np.int64)
    out = [words.counted(at, 1, hashes, first)] if scan < shards and len(at) else []
    for size in range(2, LONGEST + 1):
        # a phrase can be marked after its own first scan at the earliest
        ready = np.maximum(marks[size - 2, (hashes & slots).astype(np.int64)], first + 1)
        joined, hashes = words.longer(at, hashes, size)
        first = np.maximum(ready[joined], ready[joined + 1])
        known = first <= scan
        at, hashes, first = at[joined][known], hashes[known], first[known]
        now = scan < first + shards
        if now.any():
            out.append(words.counted(at[now], size, hashes[now], first[now]))
    return out


def _merged(table: pa.Table) -> pa.Table:
    """One row for each language and phrase: counts added up, a mark if any entry has it."""
    phrases = table.column("phrase").combine_chunks().dictionary_encode()
    key = table.column("lang").to_numpy() * len(phrases.dictionary) + phrases.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    first = arrays.runs(key[order])[:-1]
    one = table.take(pa.array(order[first]))
    if not len(one):
        return one
    n, told = (f.reduceat(table.column(c).to_numpy()[order], first) for c, f in (("n", np.add), ("told", np.logical_or)))
    return one.set_column(COLUMNS.index("n"), "n", pa.array(n)).set_column(COLUMNS.index("told"), "told", pa.array(told))


def _packed(table: pa.Table, bucket: np.ndarray, languages: list[str]) -> list:
    """Columns of packed entries, a row for each bucket."""
    keys = [bucket, *(table.column(c).to_numpy() for c in ("lang", "size", "first", "told"))]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.arange(len(order)) == 0
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    heads = np.flatnonzero(new)
    groups = np.zeros(len(heads), GROUP)
    groups["rows"] = np.diff(np.append(heads, len(order)))
    for name, k in zip(("size", "first", "told"), keys[2:], strict=True):
        groups[name] = k[heads]
    lang = keys[1][heads]
    cuts = arrays.runs(keys[0])
    edges = np.searchsorted(heads, cuts)
    n = table.column("n").to_numpy()[order].astype("<i8")
    phrases = pa.LargeListArray.from_arrays(pa.array(cuts), table.column("phrase").combine_chunks().take(pa.array(order)))
    texts = pc.binary_join(phrases, pa.scalar("\n", pa.large_string())).cast(pa.large_binary()).cast(pa.binary())
    names, packed = [], []
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        here, groups["lang"][a:z] = np.unique(lang[a:z], return_inverse=True)
        names.append([languages[i] for i in here])
        packed.append(groups[a:z].tobytes())
    return [keys[0][cuts[:-1]], names, packed, texts, [n[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]]


def _unpacked(table: pa.Table) -> tuple[pa.Table, list[str]]:
    """Entries of packed rows, and the languages they number."""
    languages: dict[str, int] = {}
    lang, groups = [], []
    for names, packed in zip(table.column("languages").to_pylist(), table.column("groups").to_pylist(), strict=True):
        own = np.array([languages.setdefault(x, len(languages)) for x in names])
        groups.append(np.frombuffer(packed, GROUP))
        lang.append(own[groups[-1]["lang"]])
    groups, lang = np.concatenate(groups), np.concatenate(lang)
    phrases = pc.split_pattern(table.column("phrases").combine_chunks().cast(pa.string()).cast(pa.large_string()), "\n").flatten()
    each = [np.repeat(x, groups["rows"]) for x in (lang, groups["size"], groups["first"].astype(np.int64), groups["told"].astype(bool))]
    n = arrays.packed(table.column("counts"), "<i8")
    return pa.table([each[0], phrases, *each[1:], np.zeros(len(n), np.int64), n], names=COLUMNS), list(languages)


def _scan(scan: int, shards: int, buckets: int, marks):
    def pack(table: pa.Table, languages: dict[str, int]) -> pa.RecordBatch:
        bucket = arrays.bucket_of(table.column("hash").to_numpy().view(np.uint64), buckets)
        return arrays.batch(ENTRIES, *_packed(table, bucket, list(languages)))

    def task(batches):
        languages: dict[str, int] = {}
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            lang = np.array([languages.setdefault(x, len(languages)) for x in b.column("lang").to_pylist()], np.int64)
            code = np.array([language_code(x) for x in languages], np.uint64)
            for part, data, offsets in arrays.chunks(b, limit=CHUNK_BYTES):
                words = Words(data, offsets, lang[part], code)
                new = active_counts(words, scan, shards, marks.value)
                if scan < shards:  # all words of a language, as the phrase of no words
                    total = np.bincount(words.lang, minlength=len(code))
                    new.append(_table(np.arange(len(code)), pa.array([""] * len(code), pa.large_string()), 0, np.zeros(len(code), np.int64), code, total))
                held += new
                rows += sum(len(t) for t in new)
                if rows > MERGE_ROWS:
                    merged = _merged(pa.concat_tables(held))
                    often = pc.greater_equal(merged.column("n"), FEW)
                    held = [merged.filter(often)]
                    rare = merged.filter(pc.invert(often))
                    if len(held[0]) > MERGE_ROWS // 2:
                        held, rare = [], merged
                    rows = sum(len(t) for t in held)
                    yield pack(rare, languages)
        if held:
            yield pack(_merged(pa.concat_tables(held)), languages)

    return task


def _count(scan: int, shards: int, least: int, slots: int):
    """Adds up one bucket's entries; tells what is finished, what goes on, and which slots are marked from now on."""

    def task(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        entries, languages = _unpacked(table)
        entries = _merged(entries)
        lang, size, first, told, n = (entries.column(c).to_numpy() for c in ("lang", "size", "first", "told", "n"))
        phrase = entries.column("phrase").combine_chunks()
        new = np.flatnonzero((n >= least) & ~told & (size > 0) & (size < LONGEST))
        marked = _slots_of(phrase.take(pa.array(new)), lang[new], size[new], languages, slots)
        done = scan >= first + shards - 1
        kept = np.flatnonzero(done & ((n >= least) | (size == 0)))
        told = told.copy()
        told[new] = True
        entries = entries.set_column(COLUMNS.index("told"), "told", pa.array(told))
        going = entries.take(pa.array(np.flatnonzero(~done)))
        out = []
        if len(going):
            columns = _packed(going, np.full(len(going), bucket), languages)
            out.append(arrays.batch(STATE, *columns, *[[None]] * 5))
        none = [None] * len(kept)
        finished = phrase.take(pa.array(kept)).cast(pa.string())
        out.append(arrays.batch(STATE, *[none] * 5, [languages[i] for i in lang[kept]], finished, size[kept], n[kept], none))
        if len(marked):
            out.append(arrays.batch(STATE, *[[None]] * 9, [marked.astype("<u4").tobytes()]))
        return pa.Table.from_batches(out)

    return task


def _slots_of(phrases: pa.Array, lang: np.ndarray, size: np.ndarray, languages: list[str], slots: int) -> np.ndarray:
    """Slots of phrases, by the hashes the scans use; each length has its own ``slots``."""
    if not len(phrases):
        return np.zeros(0, np.uint64)
    batch = pa.RecordBatch.from_arrays([phrases], ["text"])
    code = np.array([language_code(x) for x in languages], np.uint64)
    found = []
    for part, data, offsets in arrays.chunks(batch):
        words = Words(data, offsets, lang[part], code)
        at, hashes = np.arange(len(words.hash)), words.hash
        for k in range(1, LONGEST):
            found.append((hashes[size[part][words.row[at]] == k] & np.uint64(slots - 1)) + np.uint64((k - 1) * slots))
            joined, hashes = words.longer(at, hashes, k + 1)
            at = at[joined]
    return np.unique(np.concatenate(found))


def _end(marks: np.ndarray, shards: int) -> int:
    """The scan before which all phrases that are active by ``marks`` are complete, met already or not."""
    first = end = 0
    for row in marks:
        set_ = row[row != NEVER]
        end = first + shards
        if not len(set_):
            return end
        first = max(int(set_.max()), first + 1)
    return first + shards


def phrase_counts(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> DataFrame:
    """lang, phrase, size, n: all phrases of up to ``LONGEST`` words that occur ``least`` times, and all words of each language as size 0.

    ``docs`` has text and lang; ``shards`` is 2 at least.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    texts = docs.where("text is not null").select(lang, "text", F.pmod(F.xxhash64("text", "lang"), F.lit(shards)).cast("int").alias("shard"))
    seen = Observation()
    dealt = stage_table(texts.observe(seen, F.sum(F.octet_length("text").cast("long")).alias("amount")), "phrase-shards", by=["shard"])
    amount = seen.get["amount"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), amount // BUCKET_BYTES + 1)
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (amount // BYTES_A_SLOT).bit_length()))
    marks = np.full((LONGEST - 1, slots), NEVER, np.uint8)
    steps, scan = [], 0
    while scan < _end(marks, shards):
        shared = spark.sparkContext.broadcast(marks)
        found = dealt.where(F.col("shard") == scan % shards).select("lang", "text").transform(arrays.in_batches, _scan(scan, shards, buckets, shared), ENTRY)
        if steps:
            found = found.unionByName(steps[-1].where("phrases is not null").select(*ENTRIES.names))
        state = found.groupBy("bucket").applyInArrow(arrays.tidy(_count(scan, shards, least, slots)), STATES)
        steps.append(stage_table(state, f"phrase-scan{scan}"))
        shared.destroy()
        new = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r.slots_, "<u4") for r in steps[-1].where("slots is not null").select(F.col("slots").alias("slots_")).collect())])
        new = new[marks.ravel()[new] == NEVER]
        scan += 1
        marks.ravel()[new] = scan
    finished = [s.where("n is not null").select("lang", "phrase", "size", "n") for s in steps]
    whole = finished[0]
    for f in finished[1:]:
        whole = whole.unionAll(f)
    whole = stage_table(whole, "phrase-counts")
    remove_staged(dealt, *steps)
    return whole


def _with_count(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in column ``part`` as ``name``.

    A part of more than one row in ``HOT_PARTS`` is looked up by broadcast, fewer than ``HOT_PARTS`` parts can be; the others by a shuffle.
    """
    keys = ["lang", part]
    known = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    held = stage_table(rows.groupBy(*keys).agg(F.count("*").alias("held")), "phrase-parts")
    total = held.agg(F.sum("held")).first()[0] or 0
    often = held.where(F.col("held") * HOT_PARTS > total).select(*keys)
    hot = F.broadcast(known.join(F.broadcast(often), keys, "left_semi"))
    cool = rows.join(F.broadcast(often), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cool.join(known, keys))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score."""
    counts = phrase_counts(docs, least, shards)
    words = F.split("phrase", " ")
    candidates = counts.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words"))
    whole = counts.where("size >= 1")

    # a phrase inside a longer one that is nearly as frequent is left out
    inner = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: k)
    within = F.flatten(
        F.transform(inner, lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")))
    )
    longer = candidates.where("size > 2").select("lang", F.explode(within).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE_PERCENT * F.col("a")))

    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    cuts = rows.select("lang", "phrase", "size", "a", "words", cut)
    left, right = (F.array_join(F.slice("words", start, length), " ") for start, length in ((F.lit(1), F.col("cut")), (F.col("cut") + 1, F.col("size") - F.col("cut"))))
    cuts = cuts.select("lang", "phrase", "a", "cut", left.alias("left"), right.alias("right"))
    cuts = _with_count(_with_count(cuts, whole, "left", "l"), whole, "right", "r")
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r"))
    score = F.expr("div(x, y)")
    cuts = cuts.withColumns({"x": (a * a) * F.lit(SCALE), "y": l * r}).select("lang", "phrase", "a", score.alias("score"), "cut", "l", "r")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    scored = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    # first within a part of each language, so that no task sorts all phrases of one
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id,
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents WHERE text IS NOT NULL
),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\n-\\r]')) AS piece FROM texts)),
grams AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(list_slice(w, i, i + size - 1), ' '))) AS phrase
    FROM pieces, (VALUES (1), (2), (3)) AS s(size) WHERE len(w) >= size
),
f AS (SELECT lang, phrase, size, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND n >= 10),
longer AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE size = 3
    ) GROUP BY ALL
),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (
    SELECT lang, phrase, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM kept
    UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE size = 3
),
scored AS (
    SELECT c.lang, c.phrase, a, cut, fx.n AS l, fy.n AS r,
           CAST((1000000::HUGEINT * a * a) // (fx.n::HUGEINT * fy.n) AS BIGINT) AS score
    FROM cuts c JOIN f fx ON fx.lang = c.lang AND fx.phrase = x JOIN f fy ON fy.lang = c.lang AND fy.phrase = y
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, totals.n AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
