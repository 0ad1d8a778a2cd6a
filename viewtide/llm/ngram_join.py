"""N-gram Jaccard join: prefix trees of globally ordered shingle sets.

Links all pairs of documents with 100 * intersection >= 80 * union, without listing pairs of
copies. A link needs four fifths of either set in the other, so the work narrows step by step:

1. ``shared_counts``: every shingle of every document is exchanged once, as 32 bits packed by hash
   bucket. It tells how many shingles of a document occur elsewhere (a shingle met in two
   documents of one chunk is sent once, so a very common one costs one entry a chunk).
   Documents below four fifths have no partner. Cut hashes can only keep too many documents.
   Equal sets, known by 128-bit signatures of their 64-bit hashes, become one class.
2. ``shingle_table``: the set of the first document of each class, with 64-bit hashes.
3. ``ordered_sets``: shingles in one global order, rare first, single ones left out but counted.
4. ``clusters``: documents that share a shingle of their prefix (the part that cannot be missed
   altogether by a partner) and have compatible lengths are connected to clusters.
5. ``trie_links``: each cluster's sets go into a trie with compressed paths. One traversal
   keeps the overlap with all sets of the cluster at once and cuts subtrees by the lengths left.
   A large cluster is split by length class and salt into cells, and cells are paired only
   when their lengths allow a link.

Defined cases: null and empty texts and texts without words have an empty set (n_shingles 0) and
link with nothing. Texts of fewer words than the shingle have their whole sequence as one. Equal
texts link. Rows that repeat a doc_id are documents of their own, in the order of their texts (``rows.keyed``): each gives a row,
and component_id is the smallest doc_id among the rows it reaches. A row without doc_id is returned with null results. Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.llm import arrays
from viewtide.llm.components import components
from viewtide.llm.rows import columns_of, keyed, split_by_ids
from viewtide.session import remove_staged, stage_table

BUCKET_BYTES = 8 << 20
CHUNK_BYTES = 2 << 20
HOT_CLASSES = 1000
CELL_TOKENS = 1 << 20


def _buckets(df: DataFrame, amount: int) -> int:
    """Hash buckets for so many bytes of text or hashes: fixed size each, one a partition at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), amount // BUCKET_BYTES + 1)


COUNTS = pa.schema([(c, pa.int64()) for c in ("bucket", "doc_id", "n", "high", "low")] + [(c, pa.binary()) for c in ("docs", "sizes", "hashes")])
SENT = "bucket long, doc_id long, n long, high long, low long, docs binary, sizes binary, hashes binary"
SHARED = "doc_id long, n long, shared long, high long, low long"
SALTS = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _signatures(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set's scrambled hashes; equal sets have equal ones."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(arrays.mix(hashes ^ s)))) for s in SALTS]
    return [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]


def _emit_shingles(buckets: int):
    def task(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for rows, data, offsets in arrays.chunks(b, limit=CHUNK_BYTES):
                hashes, first = arrays.shingle_sets(data, offsets)
                sizes = np.diff(first)
                order = np.argsort(hashes)
                h, doc = hashes[order], np.repeat(np.arange(len(sizes)), sizes)[order]
                starts = arrays.runs(h)
                length = np.diff(starts)
                many = np.repeat(length > 1, length)
                local = np.bincount(doc[many], minlength=len(sizes))
                none = [None] * len(sizes)
                yield arrays.batch(COUNTS, ids[rows] % buckets, ids[rows], sizes, *_signatures(hashes, first), [x.tobytes() for x in local.astype("<i8")], none, none)
                keep = starts[:-1]
                h, doc = h[keep], np.where(length > 1, -1, doc[keep])
                bucket = arrays.bucket_of(h, buckets)
                order = np.lexsort((doc, bucket))
                h, doc, bucket = h[order], doc[order], bucket[order]
                out: list[list] = [[], [], [], []]
                starts = arrays.runs(bucket)
                chunk_ids = np.append(ids[rows], -1)
                for a, z in zip(starts[:-1], starts[1:], strict=True):
                    part = arrays.runs(doc[a:z])
                    lengths = np.diff(part)
                    own = doc[a:z][part[:-1]]
                    out[0].append(int(bucket[a]))
                    out[1].append((own >= 0).tobytes() + chunk_ids[own].astype("<i8").tobytes())
                    out[2].append(lengths.astype("<u4").tobytes())
                    out[3].append((h[a:z] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
                if out[0]:
                    none = [None] * len(out[0])
                    yield arrays.batch(COUNTS, out[0], none, none, none, none, out[1], out[2], out[3])

    return task


def _count_shared(groups: int):
    def task(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_valid(table.column("doc_id")))
        rest = table.filter(pc.is_null(table.column("doc_id")))
        numbers = {c: own.column(c).to_numpy() for c in ("n", "high", "low")}
        dealt = [arrays.deal(own.column("doc_id").to_numpy(), {"shared": arrays.packed(own.column("docs"), "<i8")} | numbers, groups)]
        if len(rest):
            sizes = arrays.packed(rest.column("sizes"), "<u4")
            known, docs = [], []
            for x in rest.column("docs").to_pylist():
                k = len(x) // 9
                known.append(np.frombuffer(x, bool, k))
                docs.append(np.frombuffer(x, "<i8", k, k))
            known, docs = np.repeat(np.concatenate(known), sizes), np.repeat(np.concatenate(docs), sizes)
            h = arrays.packed(rest.column("hashes"), "<u4")
            order = np.argsort(h)
            length = np.diff(arrays.runs(h[order]))
            again = np.repeat(length > 1, length)
            hit = order[again]
            found, count = np.unique(docs[hit[known[hit]]], return_counts=True)
            dealt.append(arrays.deal(found, {"shared": count.astype("<i8")}, groups))
        return pa.concat_tables(dealt, promote_options="default")

    return task


def _sum_by_document(table: pa.Table) -> pa.Table:
    own = table.filter(pc.is_valid(table.column("n")))
    ids, starts, (shared,) = arrays.gather(table, {"shared": "<i8"})
    _, first, numbers = arrays.gather(own, {c: "<i8" for c in ("n", "high", "low")})
    n, high, low = (x[first[:-1]] for x in numbers)
    return pa.table({"doc_id": ids, "n": n, "shared": np.add.reduceat(shared, starts[:-1]) if len(ids) else shared, "high": high, "low": low})


def shared_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), shared (of these, how many another document may hold too) and a 128-bit signature of the set."""
    amount = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = _buckets(docs, amount)
    sent = docs.transform(arrays.in_batches, _emit_shingles(buckets), SENT)
    found = sent.groupBy("bucket").applyInArrow(arrays.tidy(_count_shared(buckets)), "part long, docs binary, shared binary, n binary, high binary, low binary")
    return found.groupBy("part").applyInArrow(arrays.tidy(_sum_by_document), SHARED)


def _sets(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for rows, data, offsets in arrays.chunks(b):
            hashes, first = arrays.shingle_sets(data, offsets)
            yield arrays.batch(schema, ids[rows], np.diff(first), [hashes[a:z].astype("<u8").tobytes() for a, z in zip(first[:-1], first[1:], strict=True)])


def able(counts: DataFrame) -> DataFrame:
    """The documents that can have a partner."""
    return counts.where("n > 0 and 100 * shared >= 80 * n")


def shingle_table(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n and sorted shingle hashes of the documents of ``counts`` that can have a partner."""
    return shingles_of(docs, able(counts).select("doc_id"))


def shingles_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, n and sorted shingle hashes of the documents ``ids`` (doc_id, a staged table)."""
    return split_by_ids(docs, ids)[0].join(ids, "doc_id", "left_semi").transform(arrays.in_batches, _sets, "doc_id long, n long, tokens binary")


def _by_bucket(buckets: int):
    schema = pa.schema([("bucket", pa.int64())] + [(c, pa.binary()) for c in ("docs", "tokens", "own", "sizes")])

    def task(batches):
        for b in batches:
            ids, n, sets = b.column("doc_id").to_numpy(), b.column("n").to_numpy(), b.column("tokens").to_pylist()
            for first in range(0, len(sets), 512):
                h = np.frombuffer(b"".join(sets[first : first + 512]), "<u8")
                docs = np.repeat(ids[first : first + 512], [len(x) // 8 for x in sets[first : first + 512]])
                bucket = arrays.bucket_of(h, buckets)
                order = np.argsort(bucket, kind="stable")
                starts = arrays.runs(bucket[order])
                cuts = list(zip(starts[:-1], starts[1:], strict=True))
                # the sizes of these sets go with one of the buckets
                own, sizes = ([x[first : first + 512].tobytes()] + [None] * (len(cuts) - 1) for x in (ids, n))
                yield arrays.batch(schema, [int(bucket[order[a]]) for a, _ in cuts], [docs[order[a:z]].tobytes() for a, z in cuts], [h[order[a:z]].tobytes() for a, z in cuts], own, sizes)

    return task


def _frequencies(groups: int):
    """Shingles held by two documents or more, with order keys: 12 bits of frequency, 52 of hash; and the sizes that came along."""

    def task(table: pa.Table) -> pa.Table:
        docs, h = arrays.packed(table.column("docs"), "<i8"), arrays.packed(table.column("tokens"), "<u8")
        order = np.argsort(h)
        length = np.diff(arrays.runs(h[order]))
        df = np.repeat(length, length)
        order, df = order[df > 1], df[df > 1]
        rank = np.minimum(4095, (np.log2(df) * 64).astype(np.int64)).astype(np.uint64)
        keys = (rank << np.uint64(52)) | (h[order] >> np.uint64(12))
        own, sizes = (arrays.packed(table.column(c), "<i8") for c in ("own", "sizes"))
        return pa.concat_tables([arrays.deal(docs[order], {"keys": keys}, groups), arrays.deal(own, {"sizes": sizes}, groups)], promote_options="default")

    return task


def _keys_by_document(table: pa.Table) -> pa.Table:
    """One row per document: its shared shingles in global order and how many of them are prefix."""
    ids, starts, (keys,) = arrays.gather(table.filter(pc.is_valid(table.column("keys"))), {"keys": "<u8"})
    own, first, (sizes,) = arrays.gather(table.filter(pc.is_valid(table.column("sizes"))), {"sizes": "<i8"})
    n, held = sizes[first[:-1]][np.searchsorted(own, ids)], np.diff(starts)
    prefix = n - (80 * n + 99) // 100 + 1 - (n - held)
    sets = pa.array([np.sort(keys[a:z]).tobytes() for a, z in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
    return pa.table({"doc_id": ids, "n": n, "prefix": prefix, "keys": sets}).filter(pa.array(prefix > 0))


def ordered_sets(sets: DataFrame) -> DataFrame:
    """doc_id, n, prefix, keys of documents of which a partner could share a prefix shingle."""
    amount = 8 * (sets.agg(F.sum("n")).first()[0] or 0)
    buckets = _buckets(sets, amount)
    sent = sets.select("doc_id", "n", "tokens").transform(arrays.in_batches, _by_bucket(buckets), "bucket long, docs binary, tokens binary, own binary, sizes binary")
    found = sent.groupBy("bucket").applyInArrow(arrays.tidy(_frequencies(buckets)), "part long, docs binary, keys binary, sizes binary")
    return found.groupBy("part").applyInArrow(arrays.tidy(_keys_by_document), "doc_id long, n long, prefix long, keys binary")


def _chains(token: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by token and length: order, and starts of the chains whose lengths allow links from one to the next."""
    order = np.lexsort((low, token))
    token, low, high = token[order], low[order], high[order]
    cut = np.ones(len(order), bool)
    # the largest length so far within the token: lengths are far below 2**40
    group = np.cumsum(np.concatenate(([0], token[1:] != token[:-1]))) if len(order) else np.zeros(0, np.int64)
    top = np.maximum.accumulate(high + (group << 40)) - (group << 40)
    cut[1:] = (token[1:] != token[:-1]) | (100 * top[:-1] < 80 * low[1:])
    return order, np.append(np.flatnonzero(cut), len(order))


POSTINGS = pa.schema([("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def _postings(buckets: int):
    def task(batches):
        for b in batches:
            ids, n, prefix, keys = (b.column(c).to_pylist() for c in ("doc_id", "n", "prefix", "keys"))
            for first in range(0, len(ids), 4096):
                part = range(first, min(first + 4096, len(ids)))
                token = np.concatenate([np.frombuffer(keys[i], "<u8", min(prefix[i], len(keys[i]) // 8)) for i in part])
                count = [min(prefix[i], len(keys[i]) // 8) for i in part]
                doc, size = (np.repeat(np.array([x[i] for i in part], np.int64), count) for x in (ids, n))
                order, starts = _chains(token, doc, size, size)
                heads = order[starts[:-1]]
                head = np.repeat(heads, np.diff(starts))
                edges = np.unique(np.stack((doc[head], doc[order]))[:, doc[head] != doc[order]], axis=1)
                if edges.shape[1]:
                    none = [None] * edges.shape[1]
                    yield arrays.batch(POSTINGS, edges[0] % buckets, edges[0], edges[1], none, none, none, none)
                high = size[order[starts[1:] - 1]]
                token, doc, low = token[heads], doc[heads], size[heads]
                bucket = arrays.bucket_of(arrays.mix(token), buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = arrays.runs(bucket[order])
                cuts = list(zip(cuts[:-1], cuts[1:], strict=True))
                none = [None] * len(cuts)
                yield arrays.batch(POSTINGS, [int(bucket[order[a]]) for a, _ in cuts], none, none, *([x[order[a:z]].tobytes() for a, z in cuts] for x in (token, doc, low, high)))

    return task


def _edges(table: pa.Table) -> pa.Table:
    """A spanning forest of what this bucket connects."""
    given = table.filter(pc.is_valid(table.column("a")))
    rest = table.filter(pc.is_null(table.column("a")))
    token, doc, low, high = (arrays.packed(rest.column(c), k) for c, k in (("tokens", "<u8"), ("docs", "<i8"), ("low", "<i8"), ("high", "<i8")))
    order, starts = _chains(token, doc, low, high)
    head = np.repeat(order[starts[:-1]], np.diff(starts))
    a = np.concatenate((given.column("a").to_numpy(), doc[head]))
    b = np.concatenate((given.column("b").to_numpy(), doc[order]))
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = _roots(flat[: len(a)], flat[len(a) :], len(nodes))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"a": nodes[root[moved]], "b": nodes[moved]})


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    forest = arrays.Forest(n)
    apart = a != b
    for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
        forest.join(x, y)
    return np.array([forest.root(x) for x in range(n)], np.int64)


def clusters(ordered: DataFrame) -> DataFrame:
    """(id, component): documents connected through prefix shingles and compatible lengths."""
    amount = 32 * (ordered.agg(F.sum("prefix")).first()[0] or 0)
    buckets = _buckets(ordered, amount)
    sent = ordered.transform(arrays.in_batches, _postings(buckets), "bucket long, a long, b long, tokens binary, docs binary, low binary, high binary")
    return components(sent.groupBy("bucket").applyInArrow(arrays.tidy(_edges), "a long, b long"), "clusters")


def trie_links(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning edges of all links between sets given in one global order.

    ``sizes`` counts whole sets; ``sets`` hold at least the members that two of them share.
    """
    lengths = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    paths = [flat[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
    holder = np.repeat(np.arange(len(sets)), lengths)[np.argsort(flat, kind="stable")]
    post = np.concatenate(([0], np.cumsum(np.bincount(flat))))
    common = [0] * (len(order) + 1)
    for k in range(1, len(order)):
        x, y = paths[order[k - 1]], paths[order[k]]
        m = min(len(x), len(y))
        off = np.flatnonzero(x[:m] != y[:m])
        common[k] = int(off[0]) if len(off) else m
    label = np.arange(len(sets))
    # a node: sets order[l:r] share the path down to depth d, where overlap was counted for all sets
    stack = [(0, len(order), 0, np.zeros(len(sets), np.int64))]
    while stack:
        l, r, d, overlap = stack.pop()
        members = order[l:r]
        to = len(paths[order[l]]) if r - l == 1 else min(common[l + 1 : r])
        if to > d:
            step = paths[order[l]][d:to]
            counts = post[step + 1] - post[step]
            at = np.repeat(post[step] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            overlap = overlap + np.bincount(holder[at], minlength=len(sets))
        left = max(lengths[members]) - to
        most = overlap + np.minimum(lengths - overlap, left)
        able = 9 * most >= 4 * (sizes + sizes[members].min())
        if not able.any() or (label[able] == label[members[0]]).all() and (label[members] == label[members[0]]).all():
            continue
        if r - l == 1:
            x = order[l]
            linked = label[9 * overlap >= 4 * (sizes + sizes[x])]
            if len(linked) and (linked != label[x]).any():
                label[np.isin(label, np.append(linked, label[x]))] = min(linked.min(), label[x])
            continue
        k = l
        while k < r:
            end = k + 1
            while end < r and common[end] > to:
                end += 1
            stack.append((k, end, to, overlap))
            k = end
    return [(int(ids[label[i]]), int(ids[i])) for i in range(len(ids)) if label[i] != i]


def _join_cells(table: pa.Table) -> pa.Table:
    cell = table.column("cell").to_pylist()
    ids, sizes, keys = table.column("doc_id").to_numpy(), table.column("n").to_numpy(), table.column("keys").to_pylist()
    groups: dict[str, list[int]] = {}
    for i, c in enumerate(cell):
        groups.setdefault(c, []).append(i)
    found = []
    for rows in groups.values():
        if len(rows) > 1:
            rows.sort(key=lambda i: ids[i])
            found += trie_links(ids[rows], sizes[rows], [np.frombuffer(keys[i], "<u8") for i in rows])
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _with_stats(rows: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """``rows`` with the statistics of their cluster and class.

    Those of a class with more than one row in ``HOT_CLASSES``, fewer than ``HOT_CLASSES`` classes, are broadcast, and its rows spread
    over the exchange that brings the others theirs.
    """
    keys, values = ["cluster", "class"], ["salts", "salts_after", "salts_before", "total"]
    hot = stats.where(F.col("sets") * HOT_CLASSES > n).select(*keys, F.struct(*values).alias("hot"))
    # 0, as a class has rows, but no literal, which the planner would turn into a filter
    cool = stats.where(F.col("sets") * HOT_CLASSES <= n).select(*keys, F.least("sets", F.lit(0).cast("long")).alias("spread"), F.struct(*values).alias("cool"))
    rows = rows.join(F.broadcast(hot), keys, "left")
    rows = rows.withColumn("spread", F.when(F.col("hot").isNotNull(), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))).otherwise(F.lit(0)).cast("long"))
    found = rows.join(cool, [*keys, "spread"], "left").withColumn("found", F.coalesce("hot", "cool"))
    return found.select("doc_id", "n", *keys, *[F.col("found").getField(v).alias(v) for v in values])


def cells(ordered: DataFrame, cluster: DataFrame, limit: int = CELL_TOKENS) -> DataFrame:
    """Rows of ``ordered`` with the cell pairs in which they meet every possible partner.

    A cluster of up to ``limit`` shingles (and 2,048 sets) is one cell. A larger one is divided by length class
    (a partner is in the same or the next class) and, inside a class, by salt.
    """
    # the sets themselves join last, when each row's cells are known
    sizes = ordered.select("doc_id", "n", F.greatest(F.length("keys") / 8, F.lit(limit / 2048)).alias("held"))
    rows = sizes.join(cluster.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    rows = rows.withColumn("class", F.floor(F.log(F.col("n")) / F.log(F.lit(1.26))))
    total = rows.groupBy("cluster").agg(F.sum("held").alias("total"))
    class_total = rows.groupBy("cluster", "class").agg(F.greatest(F.lit(1), F.ceil(2 * F.sum("held") / limit)).alias("salts"), F.count("*").alias("sets"))
    class_total = stage_table(class_total, "cluster-classes")
    after = class_total.select("cluster", (F.col("class") - 1).alias("class"), F.col("salts").alias("salts_after"))
    before = class_total.select("cluster", (F.col("class") + 1).alias("class"), F.col("salts").alias("salts_before"))
    stats = class_total.join(after, ["cluster", "class"], "left").join(before, ["cluster", "class"], "left").join(total, "cluster")
    rows = _with_stats(rows, stats, class_total.agg(F.sum("sets")).first()[0] or 0)
    salt = F.pmod(F.xxhash64("doc_id"), F.col("salts"))

    def pairs(count: str, low, high, low_class, high_class):
        each = F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), lambda x: F.concat_ws(":", F.col("cluster"), low_class, low(x), high_class, high(x)))
        return F.when(F.coalesce(F.col(count), F.lit(0)) > 0, each).otherwise(F.array().cast("array<string>"))

    own, up, down = F.col("class"), F.col("class") + 1, F.col("class") - 1
    split = F.concat(
        pairs("salts", lambda x: F.least(x, salt), lambda x: F.greatest(x, salt), own, own),
        pairs("salts_after", lambda x: salt, lambda x: x, own, up),
        pairs("salts_before", lambda x: x, lambda x: salt, down, own),
    )
    placed = rows.select("doc_id", "total", F.when(F.col("total") <= limit, F.array(F.col("cluster").cast("string"))).otherwise(split).alias("cells"))
    return ordered.join(placed, "doc_id").select("doc_id", "n", "keys", "total", F.explode("cells").alias("cell"))


def class_members(sets: DataFrame) -> DataFrame:
    """doc_id and the smallest doc_id rep with the same set, for rows (doc_id, high, low, n).

    A set held by more than one row in ``1 / HOT_CLASSES`` is looked up by broadcast: fewer than
    ``HOT_CLASSES`` sets can be so frequent. The other sets meet their rows by a shuffle.
    """
    keys = ["high", "low", "n"]
    classes = stage_table(sets.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("held")), "shingle-class-firsts")
    rows = classes.agg(F.sum("held")).first()[0] or 0
    hot = F.broadcast(classes.where(F.col("held") * HOT_CLASSES > rows).select(*keys, "rep"))
    cool = classes.where(F.col("held") * HOT_CLASSES <= rows).select(*keys, "rep")
    split = sets.join(hot, keys).unionByName(sets.join(hot, keys, "left_anti").join(cool, keys))
    return split.select("doc_id", "rep")


def _linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text), whose doc_ids are all different and not null."""
    counts = stage_table(shared_counts(docs), "shingle-counts")
    members = stage_table(class_members(able(counts).select("doc_id", "high", "low", "n")), "shingle-classes")
    sets = stage_table(shingles_of(docs, members.where("doc_id = rep").select("doc_id")), "shingle-sets")
    ordered = stage_table(ordered_sets(sets), "ordered-sets")
    remove_staged(sets)
    placed = cells(ordered, clusters(ordered))
    amount = 8 * (ordered.agg(F.sum(F.length("keys") / 8)).first()[0] or 0)
    unit = F.when(F.col("total") <= CELL_TOKENS, F.pmod(F.xxhash64("cell"), F.lit(_buckets(docs, int(amount)))).cast("string")).otherwise(F.concat(F.lit("c"), "cell"))
    links = placed.groupBy(unit.alias("unit")).applyInArrow(arrays.tidy(_join_cells), "a long, b long")
    joined = components(links, "links").select(F.col("id").alias("rep"), "component")
    by_doc = members.join(joined, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    return counts.join(by_doc, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for ``docs`` (doc_id, text); see the module for the method."""
    rows, repeated = keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    result = _linked(rows.where("doc_id is not null").select("doc_id", "text"))
    if repeated:
        ids = rows.where("doc_id is not null").select("doc_id", F.col("row.doc_id").alias("own"))
        result = result.join(ids, "doc_id").join(ids.toDF("component_id", "root"), "component_id")
        result = result.select(F.col("own").alias("doc_id"), "n_shingles", F.col("root").alias("component_id"))
    lost = rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return result.unionAll(lost)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose group holds an earlier one; rows without doc_id stay."""
    rows, _ = keyed(docs)
    gone = _linked(rows.where("doc_id is not null").select("doc_id", "text")).where("doc_id <> component_id").select("doc_id")
    gone = stage_table(gone, "linked-copies")
    maybe, stays = split_by_ids(rows, gone)
    rows = stays.unionAll(maybe.join(gone, "doc_id", "left_anti").select(*rows.columns))
    return rows.select(*columns_of(rows, docs.columns))
