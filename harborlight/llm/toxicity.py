"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon (words, and stems that stand for many words) is learned from labelled documents. A trie of it is intersected
with Levenshtein automata (one edit, or two for long words; a swap of neighbours is one edit), so misspelled terms are
caught too. Each hit is weighed by its edits and by a window of words around it, which tells quotation from abuse; a
logistic model over the sums gives the score.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .wordscan import texts

#: At most about so many labelled rows (chosen by a hash of their id) are used to fit.
MAX_LABELLED = 20_000
LEAST_LENGTH, STEMS = 4, range(4, 8)
WINDOW = 6
FOLDS = 5

_TOKEN = re.compile(r"[^\s.,;:?\"“”„«»()\[\]{}<>|/\\]+")
_TRIM = "!'’‘*%&$#@-_=+~"
_QUOTES = re.compile(r"[\"“”„«»]")
# Words that report speech or speak about words, in the corpus's languages.
_REPORTING = frozenset(
    "said says say called quoted quote quoting word term insult slur wrote dit disait mot terme insulte appelé sagte sagt wort "
    "begriff nannte schrieb dijo dice palabra término insulto llamó escribió".split()
)
# Multipliers and summands of the sketches' hashes.
_HASHES = [(np.uint64(x | 1), np.uint64(y)) for x, y in np.random.default_rng(11).integers(1, 2**32, (32, 2)).tolist()]


class Automaton:
    """The lexicon's trie met with Levenshtein automata, determinised as far as texts ask for."""

    def __init__(self, lexicon: dict[str, int]):
        """``lexicon``: term -> 0 for a word, 1 for a stem (then any ending may follow), 2 for both."""
        self.kids: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most: list[int] = [0]
        self.kind: list[int] = [0]
        for word, kind in sorted(lexicon.items()):
            edits = self._edits(word, kind)
            node = 0
            self.most[0] = max(self.most[0], edits)
            for ch in word:
                if ch not in self.kids[node]:
                    self.kids[node][ch] = len(self.kids)
                    self.kids.append({})
                    self.term.append(None)
                    self.most.append(0)
                    self.kind.append(0)
                node = self.kids[node][ch]
                self.most[node] = max(self.most[node], edits)
            self.term[node], self.kind[node] = word, int(kind)
        self._clear()

    @staticmethod
    def allowed(word: str, is_stem: bool) -> int:
        n = len(word)
        return (1 if n >= 6 else 0) if is_stem else (2 if n >= 9 else 1 if n >= 4 else 0)

    def _edits(self, word: str, kind: int) -> int:
        return max(self.allowed(word, is_stem) for is_stem in (False, True) if kind in (is_stem, 2))

    def _clear(self):
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.sure: list[tuple[str, int] | None] = []
        self.root = self._id(self._close({(0, 0, "")}))

    def _close(self, states: set) -> frozenset:
        """With terms' characters left out; only the fewest edits of each place stay."""
        todo, best = list(states), {}
        while todo:
            node, e, held = todo.pop()
            if e > self.most[node] or best.get((node, held), 99) <= e:
                continue
            best[node, held] = e
            if not held:
                todo += [(kid, e + 1, "") for kid in self.kids[node].values()]
        return frozenset((node, e, held) for (node, held), e in best.items())

    def _id(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            at = [(e, self.term[node], self.kind[node]) for node, e, held in states if not held and self.term[node] is not None]
            ends = [(e, t) for e, t, kind in at if e <= self._edits(t, kind)]
            stems = [(e, t) for e, t, kind in at if kind and e <= self.allowed(t, True)]
            self.found.append((min(ends)[1], min(ends)[0]) if ends else None)
            self.sure.append((min(stems)[1], min(stems)[0]) if stems else None)
        return self.ids[states]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, e, held in self.sets[state]:
            kids = self.kids[node]
            if held:  # the second half of a swap: this character first, then the held one
                if ch in kids and held in self.kids[kids[ch]]:
                    out.add((self.kids[kids[ch]][held], e, ""))
                continue
            if ch in kids:
                out.add((kids[ch], e, ""))
            out.add((node, e + 1, ""))  # one character too many
            for other, kid in kids.items():
                if other != ch:
                    out.add((kid, e + 1, ""))
                    if ch in self.kids[kid]:
                        out.add((node, e + 1, ch))
        return self._id(self._close(out))

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term of ``word`` and its edits. A stem matches with what has been read up to its end."""
        if len(self.sets) > 50_000:
            self._clear()
        state, stem = self.root, None
        for ch in word:
            move = self.moves[state]
            following = move.get(ch)
            if following is None:
                following = move[ch] = self._step(state, ch)
            state = following
            if not self.sets[state]:
                return stem
            sure = self.sure[state]
            if sure and (stem is None or sure[1] < stem[1]):
                stem = sure
        whole = self.found[state]
        return min((x for x in (whole, stem) if x), key=lambda x: x[1], default=None)


def tokens(text: str) -> list[str]:
    return [w.strip(_TRIM) for w in _TOKEN.findall(text.lower())]


def _words_of(data: bytes | None) -> set[str]:
    return set(_TOKEN.findall((data or b"").decode("utf-8", "replace").lower()))


def _candidates(found) -> set[str]:
    """Words as ``word``, stems as ``stem*``."""
    out = set()
    for w in found:
        w = w.strip(_TRIM)
        if len(w) >= LEAST_LENGTH:
            out.add(w)
            out.update(w[:n] + "*" for n in STEMS if len(w) > n)
    return out


@dataclass
class Model:
    lexicon: dict[str, int]
    innocent: frozenset[str]
    weights: np.ndarray

    #: Prior weights: intercept, exact and misspelled hits, both in quotation, hits in ten words.
    PRIOR = (-3.0, 4.0, 2.0, 1.0, 0.5, 0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def features(data: bytes | None, auto: Automaton, known: dict[str, tuple[str, int] | None], innocent: frozenset[str]) -> list[float]:
    """1, and sums over the hits of one text; ``known`` remembers the words of a batch."""
    text = (data or b"").decode("utf-8", "replace").lower()
    hit = False
    for w in set(_TOKEN.findall(text)):
        if w not in known:
            bare = w.strip(_TRIM)
            m = auto.match(bare) if len(bare) >= LEAST_LENGTH - 1 and bare not in innocent else None
            known[w] = m
        if known[w]:
            hit = True
    sums = [0.0, 0.0, 0.0, 0.0]
    if not hit:
        return [1.0, *sums, 0.0]
    hits, n, quoted, recent, last = 0, 0, False, -WINDOW - 1, 0
    open_since = 0
    for m in _TOKEN.finditer(text):
        gap = text[last : m.start()]
        last = m.end()
        if "\n" in gap:
            quoted = False
        if marks := len(_QUOTES.findall(gap)):
            quoted ^= marks % 2 == 1
            open_since = n
        if quoted and n - open_since > 40:
            quoted = False  # a quotation mark that was never closed
        w = m.group()
        if w.strip(_TRIM) in _REPORTING:
            recent = n
        if found := known.get(w):
            hits += 1
            sums[(2 if quoted or n - recent <= WINDOW else 0) + (found[1] > 0)] += 1
        n += 1
    return [1.0, *(math.log1p(s) for s in sums), 10 * hits / n]


def _clean_counts(df: DataFrame, only: frozenset[str]) -> DataFrame:
    """Documents per candidate term, summed per task."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in texts(batch.column(0)):
                seen.update(_candidates(_words_of(t)) & only)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["term", "n"])

    return df.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _sketch(data: bytes | None) -> tuple[int, list[int]]:
    """A key of the text's words, and the least hashes of its three-word passages."""
    found = _TOKEN.findall((data or b"").decode("utf-8", "replace").lower())
    passages = {zlib.crc32("|".join(found[i : i + 3]).encode()) for i in range(max(1, len(found) - 2))}
    x = np.fromiter(passages, np.uint64, len(passages))
    least = [int(((x * m + a) & np.uint64(0xFFFFFFFF)).min()) for m, a in _HASHES]
    key = hashlib.blake2b("|".join(found).encode(), digest_size=8).digest()
    return int.from_bytes(key, "big", signed=True), least


def _copies(sketches: dict[int, list[int]]) -> dict[int, int]:
    """Key of a text -> key of the first text of which it is a copy: half or more of the least hashes are the same."""
    first: dict[int, int] = {}
    buckets: dict[tuple, list[int]] = {}
    for key in sorted(sketches):
        mine = sketches[key]
        bands = [(i, mine[i], mine[i + 1]) for i in range(0, len(mine), 2)]
        near = {k for b in bands for k in buckets.get(b, ())}
        alike = [k for k in near if 2 * sum(map(int.__eq__, sketches[k], mine)) >= len(mine)]
        first[key] = min(alike, default=key)
        if not alike:
            for b in bands:
                buckets.setdefault(b, []).append(key)
    return first


def _toxic_counts(df: DataFrame) -> tuple[DataFrame, int]:
    """Documents per candidate term, and of how many; exact and near copies of a document count once.

    The sketches of the sample (at most about ``MAX_LABELLED`` rows of 32 numbers) are compared at the driver.
    """

    def sketches(batches):
        for batch in batches:
            found = dict(_sketch(t) for t in texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["key", "sketch"])

    first = _copies({r["key"]: r["sketch"] for r in df.mapInArrow(sketches, "key long, sketch array<long>").distinct().collect()})

    def run(batches):
        for batch in batches:
            terms, documents = [], []
            for t in texts(batch.column(0)):
                found = _candidates(_words_of(t))
                terms += found
                documents += [first[_sketch(t)[0]]] * len(found)
                if len(terms) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(documents, pa.int64())], names=["term", "document"])
                    terms, documents = [], []
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(documents, pa.int64())], names=["term", "document"])

    counts = df.mapInArrow(run, "term string, document long").distinct().groupBy("term").agg(F.count("*").alias("n"))
    return counts, len(set(first.values()))


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, tested: int) -> dict[str, int]:
    """Terms far likelier in toxic documents than chance explains; stems only where several words share them.

    All such terms are taken: the lexicon is bounded by the sample that it is learned from, not by a number of its own.
    The words that make a stem stay beside it: a short stem allows no edit, its words do.
    """
    if not n_toxic:
        return {}
    surprise = math.log((n_toxic + n_clean) / n_toxic) or 1e-9
    least = max(4, math.ceil(math.log(max(tested, 2)) / surprise))
    odds = {}
    for t, a in toxic.items():
        b = clean.get(t, 0)
        lo = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if a >= least and lo >= 3 and b <= 0.2 * a:
            odds[t] = lo
    stems = {t[:-1]: toxic[t] for t in odds if t.endswith("*")}
    # a stem must hold clearly more than the most frequent longer stem or word that begins with it
    longest: dict[str, int] = {}
    for t, a in toxic.items():
        bare = t.rstrip("*")
        for n in STEMS:
            if len(bare) > n and bare[:n] in stems:
                longest[bare[:n]] = max(longest.get(bare[:n], 0), a)
    good = {s for s, a in stems.items() if a > 1.3 * longest.get(s, 0)}
    good = {s for s in good if not any(s[:n] in good for n in STEMS if n < len(s))}
    words = {t for t in odds if not t.endswith("*") and not any(t[:n] in good for n in STEMS if n <= len(t))}
    ranked = sorted([(odds[s + "*"], s, True) for s in good] + [(odds[w], w, False) for w in words], key=lambda x: (-x[0], x[1]))
    lexicon = {t: int(is_stem) for _, t, is_stem in ranked}
    for t, a in toxic.items():
        if not t.endswith("*") and clean.get(t, 0) <= 0.2 * a and any(lexicon.get(t[:n]) for n in STEMS if n <= len(t)):
            lexicon[t] = 2 if lexicon.get(t) else 0
    return lexicon


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the prior weights."""
    prior = np.array(Model.PRIOR)
    w, pull = prior.copy(), np.full(len(prior), 1.0)
    if not len(y):
        return w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _held_out(col):
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn lexicon and weights from a bounded sample of labelled rows outside the held-out fold.

    Rows without a label or id take no part; a document labelled twice is toxic if one label says so. Without labels the
    lexicon is empty and the prior weights hold. ``max_labelled`` is the one bound: counts are over the whole sample and
    whole texts.
    """
    ids = F.col("doc_id").cast("long")
    known = labels.select(ids.alias("__id"), F.col("toxic").cast("int").alias("__toxic")).filter("__id is not null and __toxic is not null")
    known = known.filter(~_held_out(F.col("__id"))).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    n = known.count()
    share = min(1.0, max_labelled / max(n, 1))
    known = known.filter(F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # the sample has about max_labelled rows of 12 bytes at most, whatever the size of the tables
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("text"))
    sample = plain.join(F.broadcast(known), "__id").select("text", F.col("__toxic").alias("toxic")).persist()
    try:
        totals = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
        n_clean = totals.get(False, 0)
        bad, n_toxic = _toxic_counts(sample.filter("toxic = 1").select("text"))
        tested = bad.count()
        toxic = {r["term"]: r["n"] for r in bad.filter("n >= 3").collect()}
        clean = {r["term"]: r["n"] for r in _clean_counts(sample.filter("toxic = 0").select("text"), frozenset(toxic)).collect()}
        lexicon = choose_terms(toxic, clean, n_toxic, n_clean, tested)
        innocent = _innocent(sample.filter("toxic = 0").select("text"), lexicon)
        rows = _features(sample.select("toxic", "text"), lexicon, innocent).collect()
    finally:
        sample.unpersist()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(Model.PRIOR))
    return Model(lexicon, innocent, fit_weights(x, np.array([float(r["id"] > 0) for r in rows])))


def _innocent(clean: DataFrame, lexicon: dict[str, int]) -> frozenset[str]:
    """Words of clean sample documents that lie near a term without being one: they are no misspellings."""

    def run(batches):
        auto, out, seen = Automaton(lexicon), set(), set()
        for batch in batches:
            for t in texts(batch.column(0)):
                for w in _words_of(t):
                    w = w.strip(_TRIM)
                    if w not in seen:
                        seen.add(w)
                        m = auto.match(w) if len(w) >= LEAST_LENGTH - 1 else None
                        if m and m[1]:
                            out.add(w)
                if len(seen) > 500_000:
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], names=["word"])

    return frozenset(r["word"] for r in clean.mapInArrow(run, "word string").distinct().collect()) if lexicon else frozenset()


def _features(df: DataFrame, lexicon: dict[str, int], innocent: frozenset[str]) -> DataFrame:
    def make():
        auto, known = Automaton(lexicon), {}

        def one(batch):
            if len(known) > 150_000:
                known.clear()
            rows = [features(t, auto, known, innocent) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])

        return one

    return map_arrow(df, make, "id long, x array<double>")


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Null and empty texts score like any text without a hit."""
    if not docs.columns:
        raise ValueError("no columns")

    def make():
        auto, known = Automaton(model.lexicon), {}

        def one(batch):
            if len(known) > 150_000:
                known.clear()
            x = np.array([features(t, auto, known, model.innocent) for t in texts(batch.column(1))], float).reshape(len(batch), -1)
            s = model.score(x) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

        return one

    rows = map_arrow(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), make, "doc_id long, score double")
    return rows.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) whose text is not scored toxic. Narrow: texts go through the scorer once."""
    names, at = docs.schema.names, docs.schema.names.index(text_col)
    schema = docs.schema

    def make():
        auto, known = Automaton(model.lexicon), {}

        def one(batch):
            if len(known) > 150_000:
                known.clear()
            if len(batch):
                x = np.array([features(t, auto, known, model.innocent) for t in texts(batch.column(at))], float)
                yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(model.score(x) < 0.5))

        return one

    return map_arrow(docs, make, schema)
