"""The operators against brute force, on a small table with nulls, copies, ties and clashing columns, and on sf0.001."""

import base64
import collections
import gc
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from viewtide.llm import (
    byte_bpe,
    catalog,
    collocations,
    embedding_links,
    language_id,
    licenses,
    mixing,
    ngram_join,
    periodic_runs,
    quality,
    suffix_array,
    suffix_dedup,
    toxicity,
    url_filter,
    warc_zip,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
PASSAGE = " ".join(rng.choice(["amber", "birch", "cedar", "delta", "ember", "fjord"]) + str(i) for i in range(60))


def rows():
    base = " ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 400)) for _ in range(120))
    texts = [None, "", "one two", "one two", base, base, base + " tail", base.upper(), PASSAGE, "x " + PASSAGE + " y", "ab" * 300, "é" * 150 + "\n" + "é" * 150]
    texts += [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 400)) for _ in range(rng.randint(1, 90))) for _ in range(25)]
    texts += ["word  " * 200, "same line\n" * 40, "z" * 5000, base.replace("a", "b", 3)]
    return [(i, t, [None, "s1", "s0", "s2"][i % 4]) for i, t in enumerate(texts)]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(i, t, s, "en", 1, 2, "k", 3) for i, t, s in ROWS] + [(None, "no id", "s1", None, None, None, None, None)]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, lang string, bucket int, size int, keys string, copies int")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_jaccard_components(docs, nothing):
    sets = {i: shingles(t) for i, t, _ in ROWS}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got.pop(None) == (None, None)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_class_members(spark):
    rows = [(i, i % 1200, 0, 5) for i in range(3000)] + [(i, -1, 0, 5) for i in range(3000, 3500)]
    want = {i: i % 1200 if i < 3000 else 3000 for i in range(3500)}
    got = ngram_join.class_members(spark.createDataFrame(rows, "doc_id long, high long, low long, n long")).collect()
    assert len(got) == len(rows) and {r.doc_id: r.rep for r in got} == want


def test_trie_links_match_all_pairs():
    r = np.random.default_rng(2)
    base = r.choice(5000, 80, replace=False)
    sets = [np.unique(np.where(r.random(80) < r.choice([0.02, 0.08, 0.3]), r.integers(0, 5000, 80), base)).astype(np.uint64) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    links = [(i, j) for i in range(60) for j in range(i) if 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (sizes[i] + sizes[j])]
    assert components_of(range(60), ngram_join.trie_links(np.arange(60), sizes, sets)) == components_of(range(60), links)


def test_classes_are_known_before_the_sets_and_sizes_come_without_a_join(docs, spark, monkeypatch):
    named = docs.where("doc_id is not null").select("doc_id", "text")
    counts = ngram_join.shared_counts(named)
    sets = {i: shingles(t) for i, t, _ in ROWS if i is not None}
    signed = {r.doc_id: (r.high, r.low, r.n) for r in counts.collect()}
    assert all((sets[a] == sets[b]) == (signed[a] == signed[b]) for a in sets for b in sets)
    table = ngram_join.shingle_table(named, counts).localCheckpoint()
    ordered = ngram_join.ordered_sets(table)
    assert "Join" not in ordered._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.n for r in ordered.collect()}.items() <= {r.doc_id: r.n for r in table.collect()}.items()
    found, shingles_of = [], ngram_join.shingles_of
    monkeypatch.setattr(ngram_join, "shingles_of", lambda d, ids: found.append(shingles_of(d, ids)) or found[-1])
    ngram_join.jaccard_components(named).collect()
    rows = found[0].collect()
    assert len({frozenset(sets[r.doc_id]) for r in rows}) == len(rows) > 0


def test_large_clusters_are_split(docs, spark):
    sets = {i: shingles(t) for i, t, _ in ROWS}
    named = docs.where("doc_id is not null").select("doc_id", "text")
    table = ngram_join.shingle_table(named, ngram_join.shared_counts(named))
    ordered = ngram_join.ordered_sets(table.select("doc_id", "n", "tokens"))
    cells = ngram_join.cells(ordered, ngram_join.clusters(ordered), limit=200)
    met = collections.defaultdict(set)
    for r in cells.collect():
        met[r.cell].add(r.doc_id)
    assert len(met) > 3
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                assert any({a, b} <= m for m in met.values())


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for trial in range(40):
        t = r.integers(1, 2 + trial % 4, int(r.integers(1, 300)))
        s = np.append(np.concatenate([t, t[: len(t) // 2]]), 0).astype(np.uint16)
        raw = s.astype(np.uint8).tobytes()
        sa = suffix_array.suffix_array(s, 258)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: raw[i:])
        for k, n in enumerate(suffix_array.common_prefixes(s, sa, 0).tolist()):
            if k:
                a, b = raw[sa[k - 1] : -1], raw[sa[k] : -1]
                assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_remove_repeats(docs, nothing):
    seen, want = set(), {}
    for i, t, _ in ROWS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got.pop(None)[1] == 0
    assert got == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert suffix_dedup.cut_texts(docs).columns == docs.columns


def test_hot_keys_are_split(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    own = lambda n: " ".join(word() for _ in range(n))
    data = [(i, own(20) + PASSAGE[: 200 + i % 3] + own(20) + (PASSAGE[:150] if i % 5 == 0 else "")) for i in range(120)]
    data += [(200 + i, t + own(3)) for i, (_, t) in enumerate(data[:10])]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    seen, want = set(), {}
    for i, t in data:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[i] = (int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    for hot in (0, 20, suffix_dedup.HOT):
        assert {x.doc_id: (x.n_removed, x.kept_sha256) for x in suffix_dedup.remove_repeats(table, hot).collect()} == want
    keys = suffix_dedup.shared_keys(table, 4, 20).collect()
    hot_keys = np.frombuffer(b"".join(x["keys"] for x in keys if x.doc_id is None), "<i8")
    sharing = table.join(spark.createDataFrame([tuple(x) for x in keys if x.doc_id is not None], "doc_id long, keys binary"), "doc_id")
    for split in (False, True):
        held = collections.Counter()
        for x in suffix_dedup.segment_table(sharing, 4, hot_keys if split else hot_keys[:0]).collect():
            held.update(np.frombuffer(x["keys"] or b"", "<u8").tolist())
        assert (max(held.values()) <= 20) == split


def test_byte_bpe(docs, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.encode(docs.where("doc_id is not null"), path, public_tokenizers.PATTERN).collect():
        text = ROWS[r.doc_id][1] or ""
        assert list(r.ids) == exact.encode_ordinary(text) and r.decoded == text.encode() and r.n_tokens == len(r.ids)
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    for text in ["a  b", " a\n b ", "\0x y", "don't 123 ", "  x", "x 　y", "ab" * 5000, "  ", "a ​ b", "<|endoftext|>"]:
        assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == exact.encode_ordinary(text)
    assert byte_bpe.encode(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_merges_in_portions(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = byte_bpe.read_ranks(f)
    text = " ".join(f"q{i:x}zv{i * 7919:x}k" for i in range(4000)) + " " + "xq" * 3000
    want = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN).encode([text])
    held, merge = [], byte_bpe.ByteBpe.merge
    monkeypatch.setattr(byte_bpe, "MERGE_CHARS", 2000)
    monkeypatch.setattr(byte_bpe.ByteBpe, "merge", lambda self, tokens: held.append([len(t) for t in tokens]) or merge(self, tokens))
    assert byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN).encode([text]) == want
    assert len(held) > 5 and all(sum(x) <= 2000 or len(x) == 1 for x in held)


def test_byte_bpe_task_walks_no_caches():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"]})
    run = byte_bpe._task(path, public_tokenizers.PATTERN, True, False)(iter([rows]))
    assert gc.isenabled() and next(run).schema.names == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and not gc.isenabled()
    run.close()
    assert gc.isenabled()


def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality.statistics(docs).collect()}
    for i, t, _ in ROWS:
        t = t or ""
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j + k for j in range(len(w) - 2) if grams[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert tuple(got[i][1:6]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))


def test_boosted_trees_are_monotone(docs, nothing, spark):
    r = np.random.default_rng(0)
    x = r.random((2000, 6))
    y = (r.random(2000) < np.where(x[:, 2] > 0.5, 0.1, 0.9)).astype(float)
    model = quality.train(x, y)
    assert ((model.score(x) > 0.5) == (x[:, 2] <= 0.5)).mean() > 0.95
    for f in (2, 3, 4):
        grid = np.tile(x[:50], (20, 1, 1))
        grid[:, :, f] = np.linspace(0, 1, 20)[:, None]
        scores = model.score(grid.reshape(-1, 6)).reshape(20, 50)
        assert (np.diff(scores, axis=0) <= 1e-12).all()
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(nothing, labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality.judge(docs, labels).collect())


def test_mix(docs, nothing):
    got = mixing.sample_counts(docs).collect()
    assert sorted(got, key=str) == sorted(mixing.sample_counts(docs).collect(), key=str)
    assert len(got) == len(ROWS) + 1
    sizes = collections.Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (3, 1, 2, 3)))
    target, free = {}, set(sizes)
    while True:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    assert all(r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 for r in got)
    assert mixing.sample_counts(nothing).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_mix_meets_targets(spark):
    data = [(i, "w " * (1 + i % 37), f"s{i % 3}") for i in range(6000)]
    taken, target = collections.Counter(), {}
    for r in mixing.sample_counts(spark.createDataFrame(data, "doc_id long, text string, source string")).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 37 for s in target)


def test_embedding_links(spark):
    r = np.random.default_rng(3)
    centers = r.standard_normal((12, 16))
    v = [(centers[i % 12] + r.standard_normal(16) * 0.06).tolist() for i in range(150)]
    v[7] = v[19] = v[31]
    table = [(i, x, i % 2) for i, x in enumerate(v)] + [(150, None, 1), (151, [0.0] * 16, 1), (152, [float("nan")] * 16, 0), (153, v[7], None), (154, [1.0], 1), (155, [None] * 16, 1)]
    got = {x.vec_id: tuple(x)[1:] for x in embedding_links.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()}
    u = np.array(v) / np.linalg.norm(v, axis=1)[:, None]
    links = [(a, b) for a in range(150) for b in range(a) if a % 2 == b % 2 and u[a] @ u[b] >= 0.98]
    n = collections.Counter(x for pair in links for x in pair)
    root = components_of(range(156), links)
    assert got == {i: (n[i], root[i], root[i] == i) for i in range(156)} and links
    assert embedding_links.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_matcher_equals_edit_distance():
    m, r = toxicity.Matcher(), random.Random(3)
    for _ in range(1500):
        w = list(r.choice(toxicity.LEXICON))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w))
            w[i : i + r.randint(0, 1)] = r.choice(["", "a", "e", "s", "xy"])
            w = w or ["q"]
        w = "".join(w)
        want = min(((d, t) for t in set(toxicity.LEXICON) if (d := edits(w, t)) <= toxicity.edits_allowed(t)), default=None)
        assert m.find(w) == (want and (want[1], want[0]))


def test_toxicity(spark, docs, folder, nothing):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    texts = [(1, "you are an idiot"), (2, "you id1ot"), (3, 'he said "idiot" to them'), (4, "all is well"), (5, None), (6, "")]
    got = {r.doc_id: r.score for r in toxicity.scores(spark.createDataFrame(texts, "doc_id long, text string"), labels).collect()}
    assert got[1] >= got[2] >= 0.7 > got[3] > got[4] == got[5] == got[6]
    assert toxicity.scores(nothing, labels).count() == 0
    rows = catalog.QUERIES["op4_toxicity"](spark, folder.replace("0.001", "0.01")).collect()
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxic_terms_are_learned(spark):
    r = random.Random(8)
    plain = lambda: " ".join(r.choice("abcdefgh") * 3 + str(r.randint(0, 40)) for _ in range(30))
    data = [(i, plain() + (f" zorblu{i} grint " if i % 4 == 0 else " ") + plain(), int(i % 4 == 0)) for i in range(200)]
    # many copies of one labelled text are one text
    data += [(200 + i, "copied lines only", 1) for i in range(50)]
    docs = spark.createDataFrame([x[:2] for x in data] + [(900, plain() + " zorblunew"), (901, plain() + " grint"), (902, plain() + " copied lines"), (903, plain())], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    learned = toxicity.derive(toxicity.training_texts(docs, toxicity.usable(labels)))
    assert {"grint", "grin*", "zorb*", "zorblu*"} <= set(learned) and not {"copied", "lines", "only"} & set(learned)
    got = {x.doc_id: x for x in toxicity.scores(docs, labels).collect()}
    assert got[900].score >= 0.7 and got[901].score >= 0.7 > got[902].score == got[903].score
    assert got[900].n_terms == got[901].n_terms == 1 and got[903].n_terms == 0
    for lost in (labels.where("toxic = 1"), labels.where("toxic = 0"), labels.where("false")):
        assert toxicity.derive(toxicity.training_texts(docs, toxicity.usable(lost))) == []


@pytest.mark.parametrize("wide", [False, True])
def test_archive_members(tmp_path, wide):
    from pyarrow import fs

    records = [warc_zip.record_bytes(1, "http://a/é", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None)]
    path = tmp_path / "a.wacz"
    path.write_bytes(warc_zip.pack(records, [{}], wide))
    with fs.LocalFileSystem().open_input_file(str(path)) as file:
        found = {m.name: m for m in warc_zip.members(file)}
        assert file.read_at(len(records[0]), warc_zip.data_start(file, found[warc_zip.DATA])) == records[0]
    assert warc_zip.parse_record(records[0])["payload"] == b"x" * 200


def test_warc_round_trip(spark):
    pages = [(3, "u", "p" * 150), (1, "v", "p" * 150), (2, None, "short"), (4, "w", "short"), (5, "x", None), (6, "y", "é" * 60), (None, "z", "p" * 150)]
    got = {r.page_id: r for r in warc_zip.round_trip(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), True).collect()}
    for page, _, html in pages:
        b = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert got[3].record_type == "revisit" and got[3].refers_to == 1
    assert all(got[p].record_type == "response" and got[p].refers_to is None for p in (1, 2, 4, 5, 6, None))
    assert warc_zip.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_intervals(spark):
    day = lambda n: __import__("datetime").date(2024, 1, n)
    entries = [("l", "domain", "a.com", day(2), "add"), ("l", "domain", "a.com", day(4), "remove"), ("l", "domain", "a.com", day(4), "add"), ("m", "prefix", "b.com/x/y", day(1), "add"), ("l", None, "c.com", day(1), "add")]
    captures = [(1, "http://www.A.com:80/q", day(1)), (2, "http://www.a.com/q", day(2)), (3, "http://a.com", day(4)), (4, "http://b.com/x/y/z?q", day(9)), (5, "http://b.com/x", day(9)), (6, None, day(9)), (7, "junk", day(9)), (8, "http://a.com", None)]
    got = url_filter.evaluate(spark.createDataFrame(captures, "id long, url string, fetched_at date"), spark.createDataFrame(entries, "list string, kind string, key string, at date, action string"))
    assert {r.id: r.lists for r in got.collect() if r.blocked} == {2: "l", 4: "m"} and got.count() == 8


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as from '{folder}/{t}.parquet'")
    rel = con.execute(catalog.SQL[name])
    df = catalog.QUERIES[name](spark, folder)
    assert df.columns == [d[0] for d in rel.description]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(r) for r in rel.fetchall())


def test_pipeline(spark, folder):
    import corpus_pipeline

    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, folder)
    assert good.columns == columns and 0 < good.count() < docs.count()
    out = corpus_pipeline.run(spark, folder)
    assert "ids_sha256" in out.columns and out.count() > 0


def test_pipeline_stages_keep_whole_rows(spark, docs, folder, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    stage = {f.__name__: f for _, f in corpus_pipeline.STAGES}
    table = docs.withColumn("n_chars", F.length("text"))
    rows = {r.doc_id: tuple(r) for r in table.collect()}
    whole = lambda df: collections.Counter(tuple(r) for r in df.collect())
    text, last = docs.columns.index("text"), len(docs.columns)

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good = []
    for i, t, _ in ROWS:
        w = WORD.findall(t or "")
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j + k for j in range(len(w) - 2) if grams[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
        good += [i] if len(w) >= 50 and 100 * len(again) <= 50 * len(w) else []
    assert good and whole(stage["quality_rules"](spark, table, str(tmp_path))) == collections.Counter(rows[i] for i in good)

    sets = {i: shingles(t) for i, t, _ in ROWS}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    first = [i for i, root in components_of(sets, links).items() if i == root]
    assert whole(stage["near_duplicates"](spark, table, folder)) == collections.Counter(rows[i] for i in [*first, None])

    seen, want = set(), [rows[None]]
    for i, t, _ in ROWS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        row = list(rows[i])
        if gone.any():
            row[text] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
            row[last] = len(row[text])
        want.append(tuple(row))
    assert whole(stage["repeated_strings"](spark, table, folder)) == collections.Counter(want)

    copies = {r.doc_id: r.copies for r in mixing.sample_counts(table).collect() if r.doc_id is not None}
    assert {1, 2} & set(copies.values()) and whole(stage["source_mix"](spark, table, folder)) == collections.Counter({rows[i]: n for i, n in copies.items() if n})

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    twice = table.where("doc_id is not null").unionAll(table.where("doc_id = 4"))
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in stage["tokens"](spark, twice, folder).collect())
    assert got == collections.Counter((i, tuple(exact.encode_ordinary(t or ""))) for i, t, _ in [*ROWS, ROWS[4]])


REPEATED = "id bigint, text string, doc_id bigint, row string, tie int, place int"


def with_repeats(spark, pairs):
    """doc_id and text with columns named like the operators' own."""
    return spark.createDataFrame([(7, t, i, "r", 1, 2) for i, t in pairs], REPEATED)


def test_rows_that_repeat_a_doc_id_lose_nothing(spark):
    p, q = "p1 p2 p3 " * 30, "".join(f"q{i} " for i in range(60))
    # equal ids in order of their texts: the first P stands, the null is empty
    df = with_repeats(spark, [(1, p), (1, None), (2, p)])
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    alone = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df.where("doc_id = 1 and text is not null")).collect()}
    assert got == [(1, 0, 0), (1, len(p), alone[1]), (2, len(p), len(p))]
    df = with_repeats(spark, [(1, q), (2, q), (2, q.upper()), (None, q)])
    cut = sorted(((r.doc_id, r.text) for r in suffix_dedup.cut_texts(df).collect()), key=str)
    assert cut == sorted([(1, q), (2, ""), (2, q.upper()), (None, q)], key=str)
    assert suffix_dedup.cut_texts(df).columns == df.columns


def test_rows_that_repeat_a_doc_id_are_linked_as_rows(spark):
    p, q, short = "".join(f"p{i} " for i in range(80)), "".join(f"q{i} " for i in range(50)), "a b"
    df = with_repeats(spark, [(1, p), (2, p), (2, q), (3, q), (4, p), (4, short), (None, p)])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).where("doc_id is not null").collect())
    assert got == sorted([(1, 76, 1), (2, 76, 1), (2, 46, 2), (3, 46, 2), (4, 76, 1), (4, 1, 4)])
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_first(df).collect()), key=str)
    assert kept == sorted([(1, p), (2, q), (4, short), (None, p)], key=str)


def test_clean_rows_without_doc_id_stay(spark):
    words = " ".join(f"w{i}" for i in range(60))
    df = with_repeats(spark, [(None, words), (None, "too short"), (5, words), (5, "too short"), (6, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.keep_good(df, labels)
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == ["5", "None"]


def test_toxic_rows_are_scored_one_by_one(spark):
    rows = [(None, "you asshole"), (None, "fine words"), (1, "you asshole"), (1, "fine words"), (2, None), (3, "")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 7)], "doc_id long, toxic int")
    got = [(r.doc_id, round(r.score, 6), r.n_terms) for r in toxicity.scores(with_repeats(spark, rows), labels).collect()]
    assert len(got) == 6 and {n for _, _, n in got} == {0, 1}
    assert len({s for _, s, n in got if n == 0}) == 1 and min(s for _, s, n in got if n) > 0.7


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(q % p == 0 and all(words[i + t] == words[i + t + p] for t in range(size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_periodic_runs(spark, docs, nothing):
    r = random.Random(4)
    texts = [" ".join(r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 60))) for _ in range(120)]
    texts += ["x y " * 9 + "x", "é\té\né é é é z", "a b a b a b", "one", "  ", "a " * 4000 + "b c " * 3000 + "b"]
    for first in range(0, 60, 7):
        texts.append(" ".join(f"w{i}" for i in range(first)) + " " + " ".join(f"v{i % 7}" for i in range(first)) + " tail")
    table = [(i, t) for i, t in enumerate(texts)] + [(None, "a " * 8), (0, "b " * 8), (3, None)] + [(i, t) for i, t, _ in ROWS]
    got = collections.Counter(
        (x.doc_id, x.n_words, tuple(tuple(run) for run in x.runs), x.collapsed)
        for x in periodic_runs.periodic_runs(with_repeats(spark, table)).collect()
    )
    want = collections.Counter()
    for i, t in table:
        w = WORD.findall(t or "")
        runs = brute_runs(w) if len(w) < 1000 else [(0, 4000, 1), (4000, 6001, 2)] if "c" in t else [(0, len(w), 1)]
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        want[i, len(w), tuple(runs), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert got == want
    assert periodic_runs.periodic_runs(nothing).count() == 0 and periodic_runs.periodic_runs(docs).count() == len(ROWS) + 1


def test_periodic_runs_query(spark, folder):
    got = {r.doc_id: tuple(r)[1:] for r in catalog.QUERIES["op11_periodic_runs"](spark, folder).collect()}
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    looped = 0
    for doc_id, text in texts:
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            looped += 1
        if n > 1500:
            continue
        runs = brute_runs(w)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(x for k, x in enumerate(w) if k not in gone))]
        assert got[doc_id] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests)
    assert looped and len(got) == len(texts)


def brute_phrases(rows, least):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for size in (1, 2, 3):
                f.update((lang or "und", *w[i : i + size]) for i in range(len(w) - size + 1))
    out = collections.defaultdict(list)
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for (lang, *w), a in candidates.items():
        longer = [b for (other, *v), b in candidates.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own))]


@pytest.mark.parametrize("shards,slots", [(2, 1 << 16), (3, 1 << 2), (5, 1 << 16)])
def test_collocations(spark, docs, nothing, monkeypatch, shards, slots):
    monkeypatch.setattr(collocations, "LEAST_SLOTS", slots)
    monkeypatch.setattr(collocations, "MOST_SLOTS", slots)
    r = random.Random(shards)
    rows = []
    for _ in range(300):
        words = [r.choice(["New", "york", "city", "the", "of", "é", "a\x0e"]) for _ in range(r.randint(0, 12))]
        rows.append((r.choice(["en", "de", "und", None]), "".join(w + r.choice([" ", "  ", "\t", ". ", "\n", ", "]) for w in words)))
    rows += [("en", None), ("en", ""), (None, "x " * 40), ("zz", "rare words"), ("fr", "a a a a a a a a a a a a")]
    df = spark.createDataFrame([(1, t, lang, 2, "k") for lang, t in rows], "doc_id long, text string, lang string, n long, phrase string").repartition(5)
    got = sorted(tuple(x) for x in collocations.collocations(df, shards=shards).collect())
    assert got == sorted(brute_phrases(rows, 10))
    best = [x for x in sorted(brute_phrases(rows, 10)) if x[1] <= 3]
    if shards == 2:
        assert sorted(tuple(x) for x in collocations.collocations(df, top=3, shards=2).collect()) == best
        assert collocations.collocations(nothing).count() == 0


def test_collocations_merge_and_flush(spark, monkeypatch):
    """Chunks, merges and early sending of rare phrases change nothing."""
    r = random.Random(9)
    lines = [(r.choice(["en", "de"]), " ".join(r.choice("abcdefgh") for _ in range(20))) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in lines]), pa.array([t for _, t in lines])], ["lang", "text"])
    marks = collections.namedtuple("Marks", "value")(np.zeros((2, 16), np.uint8))

    def counts():
        total = collections.Counter()
        for packed in collocations._scan(2, 3, 4, marks)(iter([batch, batch])):
            entries, languages = collocations._unpacked(pa.Table.from_batches([packed]))
            for row in entries.to_pylist():
                total[languages[row["lang"]], row["phrase"], row["size"]] += row["n"]
        return total

    whole = counts()
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 50)
    monkeypatch.setattr(collocations, "MERGE_ROWS", 40)
    assert counts() == whole and len(whole) > 500


def test_language_scores_match_a_plain_network(spark):
    r = np.random.default_rng(3)
    windows = r.integers(0, 256, (5, language_id.WINDOW), dtype=np.uint8)
    net = language_id.train(r.integers(97, 123, (40, language_id.WINDOW), dtype=np.uint8), np.arange(40) % 3, ["a", "b", "c"])
    want = []
    for x in windows:
        hidden = []
        for f, bias in zip(net.filters, net.biases, strict=True):
            sums = [sum(net.embedding[x[i + k]] @ f[k] for k in range(len(f))) + bias for i in range(len(x) - len(f) + 1)]
            hidden += [max(0.0, s) for s in np.max(sums, axis=0)]
        logits = np.exp(np.array(hidden) @ net.dense + net.offset)
        want.append(logits / logits.sum())
    assert np.allclose(language_id.Scorer(net).score(windows), want, atol=1e-5)


def test_language_gradients(spark):
    r = np.random.default_rng(5)
    x, y = r.integers(97, 105, (6, 12), dtype=np.uint8), np.arange(6) % 2
    net = language_id.train(x, y, ["a", "b"])
    values = [net.embedding, *net.filters, *net.biases, net.dense, net.offset]
    loss = lambda: -np.log(language_id.Scorer(net).score(x)[np.arange(6), y].astype(np.float64)).mean()
    for v, g in zip(values, language_id._gradients(net, x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = v[at], 1e-2
        v[at] = kept + step
        up = loss()
        v[at] = kept - step
        down = loss()
        v[at] = kept
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_language_cases(spark, docs, nothing):
    de, en = "der Hund und die Katze sind auf dem Weg nach Hause ", "the dog and the cat are on the way to their home "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(train)
    asked = [(1, "THE CAT AND THE DOG ARE AT HOME", "en"), (1, "die Katze und der Hund", "de"), (2, None, "und"), (3, "", "und"), (4, "123 !?", "und"), (None, en * 400, "en")]
    got = language_id.predict(with_repeats(spark, [(i, t) for i, t, _ in asked]), net).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted((str(i), lang) for i, _, lang in asked)
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (r.score == 0) for r in got)
    assert language_id.fit(train.where("false")) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(nothing, net).count() == 0
    one = language_id.predict(train, language_id.fit(train.where("lang = 'en'"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}
    # the sample is bounded and does not depend on the partitions
    pairs = language_id.sample(train.repartition(7), rows=4, windows=2)
    assert len(pairs) == 16 and pairs == language_id.sample(train.coalesce(1), rows=4, windows=2)


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = catalog.QUERIES["op13_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


NOTICES = {
    "Copyright 2020 Foo Inc. Licensed under the MIT License.": "MIT",
    "This file is part of Foo and is licensed under the MIT License; see LICENSE for details.": "MIT",
    "// SPDX-License-Identifier: MIT": "MIT",
    "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "Mozilla Public License Version 2.0": "MPL-2.0",
    "BSD 3-Clause License": "BSD-3-Clause",
    "We ship it as is. Licensed under the Apache License, Version 2.0, it comes with\nno promise at all, and that is that.": "Apache-2.0",
    "Licensed under the\n  Apache License, Version 2.0": "Apache-2.0",
    "This work is licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "GNU Lesser General Public License": "LGPL",
    "under the terms of the GNU Lesser General Public License, version 3": "LGPL-3.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Copyright (c) 2019 Bar GmbH. All rights reserved.": "Proprietary",
    "The license of the software was granted by the town, and rights were reserved for all.": None,
    "They mention the Apache helicopter, a gnu and a creative clause in the license.": None,
    "": None,
    None: None,
}


def test_notices_and_inheritance(spark):
    rows = [(i, f"a/n{i}/x.txt", text, "clash") for i, text in enumerate(NOTICES)]
    rows += [
        (100, "p/LICENSE", "MIT License", "x"), (101, "p/q/r/deep.txt", "nothing here", "x"), (102, "p/q/COPYING.txt", "BSD 3-Clause License", "x"),
        (103, "p/q/r/other.txt", "GNU Lesser General Public License", "x"), (104, "z/none.txt", "plain", "x"), (105, None, "MIT License", "x"), (106, None, None, "x"),
        (None, "p/y.txt", "plain", "x"), (100, "w/v.txt", "All rights reserved", "x"), (107, "p/notice", None, "x"), (108, "t/LICENSE", "MIT License ISC License", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string, license string")
    got = collections.defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r["doc_id"]].append((r["license"], r["how"], r["license_dir"]))
    assert sum(map(len, got.values())) == len(rows)
    for i, (text, name) in enumerate(NOTICES.items()):
        assert got[i] == [(name, "own" if name else "none", None)], text
    assert sorted(got[100]) == [("MIT", "own", None), ("Proprietary", "own", None)]
    assert got[101] == [("BSD-3-Clause", "inherited", "p/q")] and got[103] == [("LGPL", "own", None)]
    assert got[104] == [(None, "none", None)] == got[106] and got[105] == [("MIT", "own", None)]
    assert got[None] == [("MIT", "inherited", "p")] == got[107]
    assert got[108] == [("ISC", "own", None)]  # a tie goes to the template first in order
    assert licenses.scan(docs.where("false")).collect() == []


def test_license_files_are_weighed_once_for_all_templates(spark):
    files = spark.createDataFrame([(1, "a/LICENSE", "MIT License"), (2, "a/b.txt", "nothing"), (3, None, None)], "doc_id long, path string, text string")
    found = licenses.own_licenses(files)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # within the function over the templates the known words would be looked up for each of them
    assert "aggregate(filter(whole#" not in plan and plan.count("filter(whole#") == 1
    assert {r.doc_id: r.best and (r.best.license, r.best.score) for r in found.collect()} == {1: ("MIT", 1.0), 2: None, 3: None}
