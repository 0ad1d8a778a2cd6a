"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, weighed by context.

Every word of a text walks the lexicon's trie together with a Levenshtein automaton. The automaton
is universal: a state holds the least edits for each offset between trie depth and word place, and
a step depends only on where the next letter occurs near that place. So states and steps are
shared by all words and looked up. Short terms allow no edit, terms from ``ONE_EDIT`` letters
one, from ``TWO_EDITS`` letters two.

``derive`` adds what the labels teach: over the labelled texts, each different text once, it counts in how
many toxic and in how many other ones a word, or a word beginning of ``SHORTEST`` to ``LONGEST`` letters,
occurs. The test is one-sided: a feature in n texts, k of them toxic, is kept if n x KL(k / n, toxic share)
reaches ln(m / ``ERROR``), m being the number of features counted. By Hoeffding's bound on sampling without replacement a
feature unrelated to the labels gets there with a chance of at most ``ERROR`` / m, so all m together
let one through with at most ``ERROR``. Kept words join the lexicon's trie without edits; a word that is neither in the lexicon nor
kept counts as its longest kept beginning, if it has one, before terms some edits away. Near copies of a text count as texts.

A found term comes with its context window: inside quotation marks or after a reporting word it
counts as quoted, next to a second-person word as addressed, else as plain. ``learn`` counts, over
labelled rows, how often each matched form in each context belongs to a toxic text, smoothed
towards the rate of its number of edits and context, so that ordinary words a letter away from a
term get no weight while unseen misspellings keep it. The score is the chance that at least one
found form is meant, or the rate of toxic texts without any.

All that is learned comes from about ``LABEL_ROWS`` labelled documents at most, chosen by a hash of their id. Their ids and labels (a few MB)
are broadcast, so no text is shuffled; terms and weights, whose number that bound limits, come to the driver. Every text
is scored whole, in its own row.

Defined cases: null and empty texts score the rate of texts without terms. Labels other than 0 and 1, labels without doc_id and
documents with both labels are left out; without usable labels the rates start from ``PRIOR``. Every row gets its own score, whether
its doc_id repeats or is null; all rows of a labelled doc_id teach. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from viewtide.llm import arrays
from viewtide.session import stage_table

# Default lexicon: insults in four languages. A parameter of every function here.
LEXICON = (
    "asshole bastard bitch clown coward creep cretin degenerate disgusting dumbass fool freak garbage idiot imbecile jerk loser lunatic "
    "maggot moron pathetic pervert pig psycho rat retard scum scumbag slut stupid swine trash vermin whore worthless wretch "
    "abschaum arschloch dummkopf ekelhaft idioten schlampe trottel wertlos basura escoria estupido imbecil inutil perdedor "
    "connard cretino debile degoutant idiote minable ordure pathetique salaud stupide"
).split()
REPORTING = frozenset("said says say called calls call wrote writes quote quoted quotes word words term phrase sagte nannte schrieb dijo llamó escribió dit appelé écrit".split())
ADDRESS = frozenset("you your youre u du dich dir ihr sie tu te toi vous tú ti usted ustedes".split())
WINDOW = 4
ONE_EDIT, TWO_EDITS = 5, 8
PRIOR = {0: 0.9, 1: 0.75, 2: 0.6}
PRIOR_ROWS = 2.0
QUOTED_SHARE = 0.5
BASE_RATE = 0.05
KNOWN = 400_000
LABEL_ROWS = 50_000
SHORTEST, LONGEST = 4, 10
ERROR = 0.05
_WORD = re.compile(r"[\w@$]+")
_QUOTES = re.compile("[\"“”„«»]")
_MOST = 2


def edits_allowed(term: str) -> int:
    return 0 if len(term) < ONE_EDIT else 1 if len(term) < TWO_EDITS else _MOST


class Matcher:
    """Nearest lexicon term of a word within the term's edits."""

    def __init__(self, lexicon=LEXICON, learned=()):
        self.beginnings = frozenset(x[:-1] for x in learned if x.endswith("*"))
        self.lengths = sorted({len(x) for x in self.beginnings}, reverse=True)
        allowed = dict.fromkeys((x for x in learned if not x.endswith("*")), 0) | {x: edits_allowed(x) for x in lexicon}
        self.terms = frozenset(allowed)
        # a node: [children, term or None, edits of its term, most edits below]
        self.root: list = [{}, None, 0, 0]
        heads: dict[int, set] = {}
        tails: dict[int, set] = {}
        inner: dict[int, set] = {}
        for term, k in sorted(allowed.items()):
            path = [self.root]
            for c in term:
                path.append(path[-1][0].setdefault(c, [{}, None, 0, 0]))
            path[-1][1:3] = [term, k]
            for node in path:
                node[3] = max(node[3], k)
            # of k + 1 pieces k edits leave one whole: the first in front, the last at the end, another inside
            cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
            for n in range(max(1, len(term) - k), len(term) + k + 1):
                heads.setdefault(n, set()).add(term[: cuts[1]])
                tails.setdefault(n, set()).add(term[cuts[-2] :])
                inner.setdefault(n, set()).update(term[x:y] for x, y in zip(cuts[1:-2], cuts[2:-1], strict=True))
        self.pieces = {n: (tuple(heads[n]), tuple(tails[n]), tuple(inner[n])) for n in heads}
        self.states: list[tuple] = []
        self.least: list[int] = []
        self.ids: dict[tuple, int] = {}
        self.steps: dict[int, int] = {}
        over = _MOST + 1
        self.start = self._id(tuple(j if j >= 0 else over for j in range(-_MOST, _MOST + 1)))

    def _id(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.least.append(min(state))
        return self.ids[state]

    def _step(self, key: int) -> int:
        """State after one trie letter; key: state, bits where the letter equals the word's next ones, letters left (clipped)."""
        state, hits, left = self.states[key >> 8], key >> 3 & 31, key & 7
        over, width = _MOST + 1, 2 * _MOST + 1
        out = [over] * width
        for k in range(width):
            if k >= left:  # the word has no such place
                break
            best = state[k] + (not hits >> k & 1)
            if k + 1 < width:
                best = min(best, state[k + 1] + 1)
            if k:
                best = min(best, out[k - 1] + 1)
            out[k] = min(best, over)
        self.steps[key] = new = self._id(tuple(out))
        return new

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, the first in order among equals; a beginning is named with a star behind it."""
        if word not in self.terms:
            for size in self.lengths:
                if word[:size] in self.beginnings:
                    return word[:size] + "*", 0
        n, best = len(word), None
        pieces = self.pieces.get(n)
        if pieces is None or not (word.startswith(pieces[0]) or word.endswith(pieces[1]) or any(x in word for x in pieces[2])):
            return None
        masks: list[dict[str, int]] = []
        for depth in range(n + _MOST + 1):
            mask: dict[str, int] = {}
            for k in range(2 * _MOST + 1):
                if 0 <= (at := depth + k - _MOST) < n:
                    mask[word[at]] = mask.get(word[at], 0) | 1 << k
            masks.append(mask)
        steps, least, states = self.steps, self.least, self.states
        stack = [(self.root, 0, self.start)]
        while stack:
            (children, term, most, _), depth, state = stack.pop()
            if term is not None and -_MOST <= n - depth <= _MOST:
                edits = states[state][n - depth + _MOST]
                if edits <= most and (best is None or (edits, term) < (best[1], best[0])):
                    best = (term, edits)
            if depth >= n + _MOST:
                continue
            get = masks[depth].get
            # places -_MOST.. around the next depth that the word has
            left = min(max(n - depth + _MOST, 0), 2 * _MOST + 1)
            low = state << 8 | left
            for c, child in children.items():
                key = low | get(c, 0) << 3
                new = steps.get(key)
                if new is None:
                    new = self._step(key)
                if least[new] <= child[3]:
                    stack.append((child, depth + 1, new))
        return best


def context(words: list[str], at: int, quoted: bool) -> str:
    if quoted or not REPORTING.isdisjoint(words[max(0, at - WINDOW) : at]):
        return "quoted"
    return "plain" if ADDRESS.isdisjoint(words[max(0, at - WINDOW) : at + WINDOW + 1]) else "addressed"


def found_terms(text: str, matcher: Matcher, known: dict) -> list[tuple[str, str, int, str]]:
    """(matched form, term, edits, context) for each word of ``text`` near a term; ``known`` keeps verdicts of words."""
    lower = text.lower()
    here = set(_WORD.findall(lower))
    for w in here.difference(known):
        known[w] = matcher.find(w)
    near = {w: x for w in here if (x := known[w]) is not None}
    if not near:
        return []
    places = list(_WORD.finditer(lower))
    words = [m[0] for m in places]
    out = []
    for i, w in enumerate(words):
        if w in near:
            line = lower.rfind("\n", 0, places[i].start()) + 1
            opened = len(_QUOTES.findall(lower, line, places[i].start())) % 2 == 1
            quoted = opened and _QUOTES.search(lower, places[i].end()) is not None
            term, edits = near[w]
            # the words of a beginning share its rate
            out.append((term if term.endswith("*") else w, term, edits, context(words, i, quoted)))
    return out


def features(text: str) -> set[str]:
    """The words of ``text`` and, with a star behind each, their beginnings."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _count(batches):
    toxic, number = Counter(), Counter()

    def flush():
        columns = [pa.array(list(number), pa.string()), pa.array([toxic[f] for f in number], pa.float64()), pa.array(list(number.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "n"])

    for b in batches:
        for text, label in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
            here = features(text.as_py())
            number.update(here)
            if label:
                for f in here:
                    toxic[f] += label
            if len(number) > KNOWN:
                yield flush()
                toxic, number = Counter(), Counter()
    if number:
        yield flush()


def usable(labels: DataFrame, bound: int = LABEL_ROWS) -> DataFrame:
    """doc_id and toxic of the labelled documents to learn from, about ``bound`` at most, chosen by a hash of their id.

    Documents whose labels contradict each other are left out.
    """
    agreed = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    agreed = agreed.agg(F.min("toxic").cast("double").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    agreed = stage_table(agreed, "toxic-labels")
    share = bound / max(agreed.count(), 1)
    # 8 bytes of hash: that many labels and 9 standard deviations more are a few MB
    return agreed if share >= 1 else agreed.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * share))


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of the rows of ``docs`` that ``labels``, as ``usable`` gives them, speak of. The texts stay where they are."""
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text")
    return texts.join(F.broadcast(labels), "doc_id")


def derive(texts: DataFrame) -> list[str]:
    """Words and, with a star behind each, word beginnings that mark toxic texts by the test above, from ``training_texts``."""
    rows = texts.withColumn("hash", F.xxhash64("text"))
    once = stage_table(rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic")), "toxic-training")
    total, toxic = once.agg(F.count("*"), F.sum("toxic")).first()
    if not total or not 0 < toxic < total:
        return []
    # a text whose id and hash repeat is read once more for each repeat
    if total <= 2 * LABEL_ROWS:
        once = F.broadcast(once)
    counted = rows.drop("toxic").join(once, ["doc_id", "hash"]).select("text", "toxic").transform(arrays.in_batches, _count, "feature string, toxic double, n long")
    counted = counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    seen = Observation()
    share = toxic / total
    q = F.col("toxic") / F.col("n")
    distance = q * F.log(q / share) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    tested = counted.observe(seen, F.count("*").alias("m")).where(q > share).select("feature", (F.col("n") * distance).alias("bound"))
    tested = stage_table(tested.where(F.col("bound") >= math.log(1 / ERROR)), "toxic-features")
    return sorted(r.feature for r in tested.where(F.col("bound") >= math.log(seen.get["m"] / ERROR)).collect())


@dataclass(frozen=True)
class Model:
    """What is learned: terms beside the lexicon, the weight of each (form, context) met, and the toxic rate of texts without any."""

    learned: list[str]
    weights: dict[tuple[str, str], float]
    base: float

    def score(self, found: dict[tuple[str, str], int]) -> float:
        """The chance that one of the found forms at least is meant; ``found`` holds the edits of each (form, context)."""
        missed = math.fsum(math.log1p(-min(self.weights.get(key, prior(edits, key[1])), 0.999)) for key, edits in found.items())
        return 1 - (1 - self.base) * math.exp(missed)


def prior(edits: int, where: str) -> float:
    """The weight of a form that no labelled text holds."""
    return PRIOR[edits] * (QUOTED_SHARE if where == "quoted" else 1.0)


def _found(texts: pa.Array, matcher: Matcher, known: dict) -> Iterator[dict[tuple[str, str], int]]:
    """Per text the edits of each (form, context) found in it."""
    for t in texts:
        if len(known) > KNOWN:
            known.clear()
        found: dict[tuple[str, str], int] = {}
        for form, _, edits, where in found_terms(t.as_py() or "", matcher, known):
            found[form, where] = max(edits, found.get((form, where), 0))
        yield found


def _learn(lexicon, learned):
    def task(batches):
        matcher, known = Matcher(lexicon, learned), {}
        forms: dict[tuple, list] = {}
        for b in batches:
            for found, toxic in zip(_found(b.column("text"), matcher, known), b.column("toxic").to_pylist(), strict=True):
                for key in [(*k, edits) for k, edits in found.items()] or [(None, None, None)]:
                    held = forms.setdefault(key, [0.0, 0])
                    held[0] += toxic
                    held[1] += 1
        columns = zip(*((*k, *v) for k, v in forms.items()), strict=True) if forms else [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["form", "context", "edits", "toxic", "n"])

    return task


def learn(docs: DataFrame, labels: DataFrame, lexicon=LEXICON, bound: int = LABEL_ROWS) -> Model:
    """The model from the texts of ``docs`` that ``labels`` (doc_id, toxic) speak of."""
    texts = training_texts(docs, usable(labels, bound))
    learned = derive(texts)
    counted = texts.transform(arrays.in_batches, _learn(lexicon, learned), "form string, context string, edits int, toxic double, n long")
    rows = counted.groupBy("form", "context").agg(F.max("edits").alias("edits"), F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).collect()
    none = next(((r.toxic, r.n) for r in rows if r.form is None), (0.0, 0))
    weights = {(r.form, r.context): (r.toxic + PRIOR_ROWS * prior(r.edits, r.context)) / (r.n + PRIOR_ROWS) for r in rows if r.form is not None}
    return Model(learned, weights, (none[0] + BASE_RATE * 20) / (none[1] + 20))


def _score(lexicon, model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_terms", pa.int64())])

    def task(batches):
        matcher, known = Matcher(lexicon, model.learned), {}
        for b in batches:
            rows = [(model.score(found), len(found)) for found in _found(b.column("text"), matcher, known)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], schema.types[i + 1]) for i in (0, 1))], schema=schema)

    return task


def scores(docs: DataFrame, labels: DataFrame, lexicon=LEXICON, bound: int = LABEL_ROWS) -> DataFrame:
    """doc_id, score, n_terms of each row of ``docs``; ``labels`` (doc_id, toxic) are the rows to learn terms and rates from."""
    model = learn(docs, labels, lexicon, bound)
    return docs.select(F.col("doc_id").cast("long"), "text").transform(arrays.in_batches, _score(lexicon, model), "doc_id long, score double, n_terms long")
