"""Suffix-array dedup: removes bytes of strings that also start earlier in the corpus.

A byte goes if a string of ``WIDTH`` bytes covers it that also starts earlier (smaller doc_id, or
same document and earlier start). All strings are dealt to shards so that equal strings meet:

1. Each string's shard is the smallest hash among the ``GRAM``-byte windows it holds. Neighbouring
   strings mostly share it, so a text falls into *segments* of consecutive starts.
2. ``shared_keys`` exchanges only the segments' shard keys, packed by hash bucket, and returns to
   each document those keys that occur twice, in two segments or inside one. Keys met twice in one chunk are sent once,
   with the number of their different segments there. Keys with more than ``HOT`` in all are *hot*: a passage in many
   documents has, at its edges, segments that reach into each one's own surroundings.
3. ``segment_table``: the segments with such keys. Equal segments of a chunk are collapsed to the
   earliest; the later ones are repeats as a whole. The others go to their key's bucket. Segments with
   hot keys are taken apart instead: each start goes to a bucket of its own string's 128-bit BLAKE2 digest, so the
   strings at the edges spread and equal ones meet still. Digests stand for these strings; no text is sent.
4. Per bucket, shards of whole keys are concatenated in corpus order, and their suffix
   array (induced sorting) and permuted common prefixes group the starts of equal strings. All
   but the earliest start of a group are repeats, as are those of equal digests. Without hot keys a shard holds at most
   ``SHARD_BYTES`` and ``HOT`` segments. ``HOT`` grows with corpora over 64 GB, so that the list of hot keys, which every task
   gets, stays below a million.
5. The repeated starts return to their documents, where the covered bytes are cut out.

Segments end after ``GRAM``-window many starts, so runs of one character cannot make long ones.

Defined cases: null and empty texts, and texts shorter than ``WIDTH``, lose nothing. Rows that repeat a doc_id are
documents of their own, in the order of their texts (``rows.keyed``), each cut on its own. A row without doc_id has no
place in the order; it keeps everything and removes nothing elsewhere. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.llm import arrays, suffix_array
from viewtide.llm.rows import columns_of, keyed, split_by_ids
from viewtide.session import stage_table

WIDTH = 100
GRAM = 24
SHARD_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
HOT = 4096
SPREAD = 8


def segments(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Segments of a chunk: first start, number of starts, row and shard hash of each, whether its hash occurs in it twice, and the chunk's rolling hashes."""
    if len(data) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool), None
    rolling = arrays.Rolling(data)
    hashes = rolling.windows(gram)
    least = arrays.sliding_minimum(hashes, width - gram + 1)
    n = len(least)
    row = np.searchsorted(offsets, np.arange(n), "right") - 1 if len(offsets) > 2 else np.zeros(n, np.int64)
    inside = np.arange(n) + width <= offsets[row + 1]
    cut = np.ones(n, bool)
    cut[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(cut)
    length = np.diff(np.append(first, n))
    parts = -(-length // (width - gram + 1))
    if parts.max() > 1:
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(first + length, parts)
        first = np.repeat(first, parts) + step * (width - gram + 1)
        length = np.minimum(first + width - gram + 1, end) - first
    good = inside[first]
    first, length = first[good], length[good]
    key = least[first]
    # the hash at its first place in the segment's windows, and whether it comes again after that
    hit = np.flatnonzero(np.isin(hashes, key))
    order = np.lexsort((hit, hashes[hit]))
    places, values = hit[order], hashes[hit][order]
    low = np.searchsorted(values, key)
    near = _count_between(values, places, key, low, first, first + length - 1 + width - gram)
    return first, length, row[first], key, near > 1, rolling


def _count_between(values, places, key, low, start, stop):
    """How many entries (value, place) have the key's value and a place in start..stop; entries are sorted."""
    name = np.zeros(len(values), np.int64)
    if len(values):
        name[1:] = np.cumsum(values[1:] != values[:-1])
        own = name[low] << 40
        flat = (name << 40) + places
        return np.searchsorted(flat, own + stop, "right") - np.searchsorted(flat, own + start)
    return np.zeros(len(key), np.int64)


def _tag(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a shard hash in one number."""
    return (arrays.bucket_of(key, buckets) << 32) | (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


KEYS = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])


def _emit_keys(buckets: int):
    def task(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for rows, data, offsets in arrays.chunks(b):
                first, size, row, key, twice, rolling = segments(data, offsets)
                if not len(key):
                    continue
                own = ids[rows]
                tag = _tag(key, buckets)
                content = rolling.ranges(first, first + size + WIDTH - 1)
                order = np.lexsort((content, tag))
                tag, doc, content = tag[order], row[order], content[order]
                starts = arrays.runs(tag)
                new = np.ones(len(tag), np.int64)
                new[1:] = (tag[1:] != tag[:-1]) | (content[1:] != content[:-1])
                count = np.add.reduceat(new, starts[:-1])
                length = np.diff(starts)
                many = np.repeat(length > 1, length) | twice[order]
                local, where = tag[many], doc[many]
                order = np.argsort(where, kind="stable")
                cuts = arrays.runs(where[order])
                cuts = list(zip(cuts[:-1], cuts[1:], strict=True))
                none = [None] * len(cuts)
                out_ids = [int(own[where[order[a]]]) for a, _ in cuts]
                yield arrays.batch(KEYS, [i % buckets for i in out_ids], out_ids, none, none, [np.unique(local[order[a:z]]).astype("<i8").tobytes() for a, z in cuts], none)
                tag, doc = tag[starts[:-1]], np.where(length > 1, -1, doc[starts[:-1]])
                order = np.lexsort((doc, tag >> 32))
                tag, doc, count = tag[order], doc[order], count[order]
                cuts = arrays.runs(tag >> 32)
                out: list[list] = [[], [], [], [], []]
                known = np.append(own, 0)
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    part = arrays.runs(doc[a:z])
                    who = doc[a:z][part[:-1]]
                    out[0].append(int(tag[a] >> 32))
                    out[1].append((who >= 0).tobytes() + known[who].astype("<i8").tobytes())
                    out[2].append(np.diff(part).astype("<u4").tobytes())
                    out[3].append((tag[a:z] & 0xFFFFFFFF).astype("<u4").tobytes())
                    out[4].append(count[a:z].astype("<u4").tobytes())
                yield arrays.batch(KEYS, out[0], [None] * len(out[0]), *out[1:])

    return task


def _shared(groups: int, hot: int):
    def task(table: pa.Table) -> pa.Table:
        given = table.filter(pc.is_valid(table.column("doc_id")))
        rest = table.filter(pc.is_null(table.column("doc_id")))
        own = given.column("keys").to_pylist()
        ids = [np.repeat(given.column("doc_id").to_numpy(), [len(x) // 8 for x in own])]
        keys = [np.frombuffer(b"".join(own), "<i8")]
        many = np.zeros(0, np.int64)
        if len(rest):
            bucket = rest.column("bucket")[0].as_py()
            sizes = arrays.packed(rest.column("sizes"), "<u4")
            known, docs = [], []
            for x in rest.column("docs").to_pylist():
                known.append(np.frombuffer(x, bool, len(x) // 9))
                docs.append(np.frombuffer(x, "<i8", len(x) // 9, len(x) // 9))
            known, docs = np.repeat(np.concatenate(known), sizes), np.repeat(np.concatenate(docs), sizes)
            key = arrays.packed(rest.column("keys"), "<u4")
            order = np.argsort(key)
            starts = arrays.runs(key[order])
            length = np.diff(starts)
            total = np.add.reduceat(arrays.packed(rest.column("counts"), "<u4").astype(np.int64)[order], starts[:-1])
            many = key[order[starts[:-1]]][total > hot].astype("<i8") | (bucket << 32)
            hit = order[np.repeat(length > 1, length)]
            hit = hit[known[hit]]
            ids.append(docs[hit])
            keys.append(key[hit].astype("<i8") | (bucket << 32))
        dealt = arrays.deal(np.concatenate(ids), {"keys": np.concatenate(keys)}, groups)
        hot_row = {"part": [0], "docs": [None], "keys": [many.tobytes()]} if len(many) else {"part": [], "docs": [], "keys": []}
        return pa.concat_tables([dealt, pa.table(hot_row, dealt.schema)])

    return task


def _keys_by_document(table: pa.Table) -> pa.Table:
    hot = table.filter(pc.is_null(table.column("docs"))).column("keys").to_pylist()
    ids, starts, (keys,) = arrays.gather(table.filter(pc.is_valid(table.column("docs"))), {"keys": "<i8"})
    own = [np.unique(keys[a:z]).tobytes() for a, z in zip(starts[:-1], starts[1:], strict=True) if z > a]
    return pa.table({"doc_id": pa.array(ids.tolist() + [None] * len(hot), pa.int64()), "keys": pa.array(own + hot, pa.binary())})


def shared_keys(docs: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """doc_id and its shard keys, packed, that occur twice or more in ``docs``; rows without doc_id hold the hot ones."""
    sent = docs.transform(arrays.in_batches, _emit_keys(buckets), "bucket long, doc_id long, docs binary, sizes binary, keys binary, counts binary")
    found = sent.groupBy("bucket").applyInArrow(arrays.tidy(_shared(buckets, hot)), "part long, docs binary, keys binary")
    return found.groupBy("part").applyInArrow(arrays.tidy(_keys_by_document), "doc_id long, keys binary")


DIGEST = np.dtype([("x", "<u8"), ("y", "<u8")])
PIECES = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("starts", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("twice", pa.binary()), ("text", pa.binary()), ("digests", pa.binary())])


def _ranges_by_doc(doc: np.ndarray, first: np.ndarray, size: np.ndarray):
    """doc_ids and packed (first, size) pairs of each."""
    order = np.lexsort((first, doc))
    cuts = arrays.runs(doc[order])
    pairs = np.stack((first, size), 1).astype("<i8")[order]
    return doc[order][cuts[:-1]], [pairs[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def _collapse(texts: list[bytes], doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the earliest of equal texts, and of those later in the corpus than theirs."""
    best: dict[bytes, int] = {}
    owner = np.zeros(len(texts), np.int64)
    for i in np.lexsort((first, doc)).tolist():
        owner[i] = best.setdefault(texts[i], i)
    head = owner == np.arange(len(texts))
    later = ~head & ((doc != doc[owner]) | (first != first[owner]))
    return np.flatnonzero(head), np.flatnonzero(later)


def _first_of_equal(digests: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the earliest of equal digests, and of those later in the corpus than theirs."""
    order = np.lexsort((place, doc, digests["y"], digests["x"]))
    cuts = arrays.runs(digests[order])
    owner = np.repeat(order[cuts[:-1]], np.diff(cuts))
    return order[cuts[:-1]], order[(doc[order] != doc[owner]) | (place[order] != place[owner])]


def _emit_segments(buckets: int, hot: np.ndarray):
    def task(batches):
        for b in batches:
            ids, wanted = b.column("doc_id").to_numpy(), b.column("keys").to_pylist()
            for rows, data, offsets in arrays.chunks(b):
                first, size, row, key, twice, _ = segments(data, offsets)
                tag = _tag(key, buckets)
                cuts = np.searchsorted(row, np.arange(rows.stop - rows.start + 1))
                keep = [np.isin(tag[a:z], np.frombuffer(w, "<i8")) for a, z, w in zip(cuts[:-1], cuts[1:], wanted[rows], strict=True)]
                keep = np.flatnonzero(np.concatenate(keep))
                if not len(keep):
                    continue
                first, size, row, key, twice, tag = (x[keep] for x in (first, size, row, key, twice, tag))
                whole = data.tobytes()
                texts = [whole[a:z] for a, z in zip(first.tolist(), (first + size + WIDTH - 1).tolist(), strict=True)]
                doc, place = ids[rows][row], first - offsets[row]
                heads, later = _collapse(texts, doc, place)
                if len(later):
                    out_ids, packed = _ranges_by_doc(doc[later], place[later], size[later])
                    none = [None] * len(packed)
                    yield arrays.batch(PIECES, out_ids % buckets, out_ids, packed, *[none] * 7)
                apart = np.isin(tag[heads], hot)
                if apart.any():
                    yield from _emit_starts(whole, first, size, doc, place, heads[apart], buckets)
                    heads = heads[~apart]
                bucket = arrays.bucket_of(key[heads], buckets)
                order = heads[np.argsort(bucket, kind="stable")]
                cuts = arrays.runs(np.sort(bucket))
                parts = [order[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                none = [None] * len(parts)
                packed = [[x[p].astype(k).tobytes() for p in parts] for x, k in ((doc, "<i8"), (place, "<i8"), (size, "<u4"), (key, "<u8"), (twice, "?"))]
                yield arrays.batch(PIECES, np.sort(bucket)[cuts[:-1]], none, none, *packed, [b"".join([texts[i] for i in p]) for p in parts], none)

    return task


def _emit_starts(whole: bytes, first, size, doc, place, chosen, buckets: int):
    """Pieces for the single starts of the chosen segments, by digest; starts repeated in the chunk are sent as such."""
    number = size[chosen]
    step = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    at, doc, place = np.repeat(first[chosen], number) + step, np.repeat(doc[chosen], number), np.repeat(place[chosen], number) + step
    digests = np.frombuffer(b"".join([hashlib.blake2b(whole[a : a + WIDTH], digest_size=16).digest() for a in at.tolist()]), DIGEST)
    heads, later = _first_of_equal(digests, doc, place)
    if len(later):
        out_ids, packed = _ranges_by_doc(doc[later], place[later], np.ones(len(later), np.int64))
        yield arrays.batch(PIECES, out_ids % buckets, out_ids, packed, *[[None] * len(packed)] * 7)
    # digests fill more and smaller buckets, behind those of the keys
    bucket = buckets + arrays.bucket_of(digests["x"][heads], SPREAD * buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = arrays.runs(bucket[order])
    parts = [heads[order[a:z]] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    none = [None] * len(parts)
    docs, places, packed = ([x[p].astype(k).tobytes() for p in parts] for x, k in ((doc, "<i8"), (place, "<i8"), (digests, DIGEST)))
    yield arrays.batch(PIECES, bucket[order][cuts[:-1]], none, none, docs, places, none, none, none, none, packed)


def segment_table(sharing: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Packed segments with shared keys and single starts with hot ones, by bucket, and starts known to be repeats."""
    schema = "bucket long, doc_id long, starts binary, docs binary, places binary, sizes binary, keys binary, twice binary, text binary, digests binary"
    return sharing.transform(arrays.in_batches, _emit_segments(buckets, hot), schema)


def shard_repeats(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For texts in corpus order, the starts of strings of ``width`` bytes that start earlier among them."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 1)
    s = np.ones(ends[-1] + 1, np.int64)
    at = np.arange(lengths.sum()) + np.repeat(np.arange(len(texts)), lengths)
    s[at] = np.frombuffer(b"".join(texts), np.uint8) + np.int64(2)
    s[-1] = 0
    s = s.astype(np.uint16)
    sa = suffix_array.suffix_array(s, 258)
    prefix = suffix_array.common_prefixes(s, sa, 1)
    group = np.flatnonzero(np.append(prefix < width, True))
    first = group[:-1]
    earliest = np.repeat(np.minimum.reduceat(sa, first), np.diff(group))
    repeat = np.zeros(len(s), bool)
    repeat[sa[sa != earliest]] = True
    starts = np.flatnonzero(repeat)
    text = np.searchsorted(ends, starts, "right")
    starts = starts - (ends - lengths - 1)[text]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [starts[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def _repeats(groups: int):
    def task(table: pa.Table) -> pa.Table:
        given = table.filter(pc.is_valid(table.column("doc_id")))
        rest = table.filter(pc.is_null(table.column("doc_id")))
        own = given.column("starts").to_pylist()
        pairs = np.frombuffer(b"".join(own), "<i8").reshape(-1, 2)
        found = [(np.repeat(given.column("doc_id").to_numpy(), [len(x) // 16 for x in own]), pairs[:, 0], pairs[:, 1])]
        single = rest.filter(pc.is_valid(rest.column("digests")))
        rest = rest.filter(pc.is_null(rest.column("digests")))
        if len(single):
            digests, doc, place = (arrays.packed(single.column(c), k) for c, k in (("digests", DIGEST), ("docs", "<i8"), ("places", "<i8")))
            later = _first_of_equal(digests, doc, place)[1]
            found.append((doc[later], place[later], np.ones(len(later), np.int64)))
        if len(rest):
            doc, place, size, key, twice = (arrays.packed(rest.column(c), k) for c, k in (("docs", "<i8"), ("places", "<i8"), ("sizes", "<u4"), ("keys", "<u8"), ("twice", "?")))
            size = size.astype(np.int64)
            whole = b"".join(rest.column("text").to_pylist())
            bounds = np.concatenate(([0], np.cumsum(size + WIDTH - 1))).tolist()
            texts = [whole[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            heads, later = _collapse(texts, doc, place)
            found.append((doc[later], place[later], size[later]))
            order = heads[np.lexsort((place[heads], doc[heads], key[heads]))]
            cuts = arrays.runs(key[order])
            alone = np.repeat(np.diff(cuts) == 1, np.diff(cuts)) & ~twice[order]
            order = order[~alone]  # a single segment that holds its hash once has no equal strings
            cuts = arrays.runs(key[order]).tolist()
            shard: list[int] = []
            held = 0
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                shard += order[a:z].tolist()
                held += int((size[order[a:z]] + WIDTH).sum())
                if held >= SHARD_BYTES or z == cuts[-1]:
                    for i, starts in zip(shard, shard_repeats([texts[i] for i in shard]), strict=True):
                        if len(starts):
                            edges = np.concatenate(([0], np.flatnonzero(np.diff(starts) > 1) + 1, [len(starts)]))
                            found.append((np.full(len(edges) - 1, doc[i]), place[i] + starts[edges[:-1]], np.diff(edges)))
                    shard, held = [], 0
        doc, first, number = (np.concatenate(x) for x in zip(*found, strict=True))
        return arrays.deal(doc, {"first": first.astype("<i8"), "number": number.astype("<i8")}, groups)

    return task


def _starts_by_document(table: pa.Table) -> pa.Table:
    ids, starts, columns = arrays.gather(table, {"first": "<i8", "number": "<i8"})
    pairs = np.stack(columns, 1)
    return pa.table({"doc_id": ids, "starts": pa.array([pairs[a:z].tobytes() for a, z in zip(starts[:-1], starts[1:], strict=True)], pa.binary())})


def removed_spans(starts: bytes, width: int = WIDTH) -> np.ndarray:
    """Maximal removed runs (start, stop) from packed (first, number) pairs of repeated starts."""
    pairs = np.frombuffer(starts, "<i8").reshape(-1, 2)
    if not len(pairs):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(pairs[:, 0], kind="stable")
    low = pairs[order, 0]
    high = np.maximum.accumulate(pairs[order].sum(1) + width - 1)
    new = np.concatenate(([True], low[1:] > high[:-1]))
    return np.stack((low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]), 1)


CUT = "row {row}, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches):
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        for text, data, starts in zip(b.column("text").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("starts").to_pylist(), strict=True):
            data = data or b""
            spans = removed_spans(starts or b"")
            edges = np.concatenate(([0], spans.ravel(), [len(data)])).tolist()
            left = b"".join([data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]) if len(spans) else data
            # cuts fall between bytes; the pieces of a split character are left out of the text
            row = (left.decode("utf-8", "ignore") if len(spans) else text, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left)
            for o, x in zip(out, row, strict=True):
                o.append(x)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["row", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=names)


def _cut_rows(docs: DataFrame, hot: int, whole: bool) -> DataFrame:
    """row, text left, n_bytes, n_removed, n_spans, kept_sha256 and kept of each row of ``docs``; text of untouched rows only if ``whole``."""
    docs, _ = keyed(docs)
    named = docs.where("doc_id is not null")
    amount = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), amount // BUCKET_BYTES + 1)
    able = F.octet_length("text") >= WIDTH
    staged = stage_table(shared_keys(named.where(able).select("doc_id", "text"), buckets, max(hot, amount >> 24)), "repeat-keys")
    keys = staged.where("doc_id is not null")
    hot_keys = np.unique(np.frombuffer(b"".join(r.keys_ for r in staged.where("doc_id is null").select(F.col("keys").alias("keys_")).collect()), "<i8"))
    # texts that share nothing need no second look
    maybe, alone = split_by_ids(docs, keys)
    split = maybe.join(keys, "doc_id", "left").unionByName(alone.withColumn("keys", F.lit(None).cast("binary")))
    if not whole:
        free = F.col("keys").isNull()
        text = F.coalesce("text", F.lit(""))
        split = split.select(
            "doc_id",
            "keys",
            "row",
            F.when(~free, F.col("text")).alias("text"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.when(free, F.sha2(text.cast("binary"), 256)).alias("kept_sha256"),
        )
    split = stage_table(split, "repeat-texts")
    sharing = split.where("keys is not null").select("doc_id", "text", "keys")
    pieces = segment_table(sharing, buckets, hot_keys)
    found = pieces.groupBy("bucket").applyInArrow(arrays.tidy(_repeats(buckets)), "part long, docs binary, first binary, number binary")
    starts = found.groupBy("part").applyInArrow(arrays.tidy(_starts_by_document), "doc_id long, starts binary")
    row = split.schema["row"].dataType.simpleString()
    done = split.where("keys is not null").select("doc_id", "row", "text").join(starts, "doc_id", "left")
    done = done.select("row", "text", "starts").transform(arrays.in_batches, _cut, CUT.format(row=row))
    zero = F.lit(0).cast("long")
    n_bytes, digest = ("n_bytes", "kept_sha256") if not whole else (zero, F.lit(None).cast("string"))
    rest = split.where("keys is null").select("row", "text", n_bytes, zero.alias("n_removed"), zero.alias("n_spans"), digest, F.lit(None).cast("binary"))
    return done.unionAll(rest)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left, null if all are) of each row of ``docs``."""
    cut = _cut_rows(docs.select(F.col("doc_id").cast("long"), "text"), hot, whole=False)
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def cut_texts(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` with repeated strings cut from ``text``, and ``n_chars`` renewed if there."""
    cut = _cut_rows(docs, hot, whole=True)
    columns = dict(zip(docs.columns, columns_of(cut, docs.columns), strict=True))
    if "n_chars" in columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(columns["n_chars"]).alias("n_chars")
    return cut.select(*columns.values())
