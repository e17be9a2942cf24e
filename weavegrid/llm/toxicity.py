"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows.

``train`` learns from labelled texts:

* a lexicon of words, and of stems (leading letters), that are far more
  frequent among the toxic than among the others;
* a logistic regression over the features of a text.

``Matcher`` intersects the Levenshtein automaton of the lexicon's words with
their trie: a state is a set of (trie node, edits so far), determinised as
words are read, so a distinct transition is computed once as long as the states
found hold no more than ``STATE_ITEMS`` such pairs in all; then they are found
anew, which changes no result. A word is exact,
a stem (the word begins with a lexicon stem), or misspelled (one edit from a
lexicon word of five letters or more, two from ten letters on).

Each hit is looked at in a window of words around it: inside quotation marks,
or after a word of reporting, it counts as quoted, else as abuse; a word that
addresses someone near by makes it directed. The two kinds are separate
features, so quotation earns its own (learned) weight.

Defined cases: null and empty texts get the score of a text without hits; of
contradicting labels the toxic one holds; null labels don't count; without a
label of either kind every score is the share of toxic labels (0 without any);
of rows that repeat a labelled doc_id the one with the smallest text is learned
from; very long texts are read whole; other columns are ignored, or kept by
``accepted``; no rows give no rows.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weavegrid.llm.common import discard, ship, slices, stored, text_or_empty
from weavegrid.llm.shingles import hash_family, minhashes, shingle_sets

#: Labelled rows that the classifier is fitted on at most, chosen by a hash of doc_id.
TRAINING_ROWS = 20_000
LEXICON_MOST = 3000
STEMS = range(4, 7)
#: An entry stands in so many toxic texts of the sample at least, near copies counted once, and chance would
#: put it into so many of them, rather than into others, with at most this probability (of 3e-2 to 1e-6 the best log loss among training folds).
LEAST_TOXIC, CHANCE = 4, 3e-3
LEAST_RATIO = 12.0
#: Texts are near copies if half of their minwise coordinates agree; they are looked for where a band of these does.
COORDINATES, BAND = 64, 4
WINDOW = 6
#: Pairs (of 8 to 40 bytes) in all states of an automaton, and letters of all words whose hits are kept, at most.
STATE_ITEMS, KEPT_LETTERS = 400_000, 4_000_000

#: Words that report speech, and words that address someone, in the corpus' languages.
REPORTING = frozenset(
    "said says say wrote writes called calls quote quoted quotes reported reports according word term phrase "
    "dit écrit appelé selon mot cite sagte schrieb nannte laut wort zitat dijo escribió llamó según palabra cita".split()
)
ADDRESSING = frozenset("you your yours yourself tu vous toi votre du dich dir ihr euch usted tú te vosotros".split())
_QUOTED = re.compile('"[^"\n]{1,400}"|“[^”\n]{1,400}”|„[^“”\n]{1,400}[“”]|«[^»\n]{1,400}»')
_WORD = re.compile(r"[^\W_]+")


def edits_for(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 10 else 2


class Matcher:
    """Finds lexicon entries in words; entries: (text, is_stem, weight)."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.exact = {w: x for w, stem, x in entries if not stem}
        self.stems: dict[str, float] = {w: x for w, stem, x in entries if stem}
        self.stem_sizes = sorted({len(w) for w in self.stems})
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[str, float]] = {}
        self.most = [0]  # edits that some word below the node allows
        for w, x in self.exact.items():
            node, k = 0, edits_for(w)
            self.most[0] = max(self.most[0], k)
            for c in w:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node] = (w, x)
        self.letters = {c for own in self.children for c in own}
        self._forget()

    def _forget(self) -> None:
        self._states: dict[tuple[int, ...], int] = {}
        self._sets: list[tuple[int, ...]] = []
        self._moves: list[dict[str, int]] = []
        self._accepts: list[tuple[str, float, int] | None] = []
        self._items = 0
        self._start = self._state({(0, 0)})
        self._dead = self._state(set())

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The number of a state set, closed under deletions from the lexicon word."""
        least: dict[int, int] = {}
        work = list(items)
        while work:
            node, e = work.pop()
            if e > self.most[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            work += [(child, e + 1) for child in self.children[node].values()]
        key = tuple(sorted(node * 4 + e for node, e in least.items()))
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(key)
            self._moves.append({})
            self._items += 1 + len(key)
            ends = [(e, w, x) for node, e in least.items() if node in self.ends for w, x in [self.ends[node]] if e <= edits_for(w)]
            self._accepts.append(min(((w, x, e) for e, w, x in ends), key=lambda a: (a[2], -a[1], a[0]), default=None))
        return self._states[key]

    def _move(self, state: int, c: str) -> int:
        c = c if c in self.letters else "\0"  # all other letters act alike
        if c not in self._moves[state]:
            items = set()
            for node, e in (divmod(x, 4) for x in self._sets[state]):
                items.add((node, e + 1))  # a letter too many
                for label, child in self.children[node].items():
                    items.add((child, e + (label != c)))
            self._moves[state][c] = self._state(items)
        return self._moves[state][c]

    def misspelled(self, word: str) -> tuple[str, float, int] | None:
        """(entry, weight, edits) of the lexicon word nearest to ``word``, if it is near enough."""
        if self._items > STATE_ITEMS:
            self._forget()
        state = self._start
        for c in word:
            state = self._move(state, c)
            if state == self._dead:
                return None
        return self._accepts[state]

    def find(self, word: str) -> tuple[str, float] | None:
        """(kind, weight) of a hit: exact, stem or fuzzy."""
        if word in self.exact:
            return "exact", self.exact[word]
        for n in self.stem_sizes:
            if word[:n] in self.stems:
                return "stem", self.stems[word[:n]]
        hit = self.misspelled(word)
        return hit and ("fuzzy", hit[1] / (1 + hit[2]))


FEATURES = ("exact", "stem", "fuzzy", "quoted", "directed", "any", "density")


@dataclass
class Model:
    """Everything a score depends on; of bounded size."""

    entries: list[tuple[str, bool, float]] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    bias: float = 0.0
    constant: float | None = 0.0

    def matcher(self) -> Matcher:
        if "_matcher" not in self.__dict__:
            self._matcher, self._seen, self._letters = Matcher(self.entries), {}, 0
        return self._matcher

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def lookup(self, words) -> dict[str, tuple[str, float]]:
        """The hits among ``words``."""
        matcher = self.matcher()
        if self._letters > KEPT_LETTERS:
            self._seen, self._letters = {}, 0
        out = {}
        for w in words:
            try:
                hit = self._seen[w]
            except KeyError:
                hit = self._seen[w] = matcher.find(w)
                self._letters += len(w) + 10
            if hit:
                out[w] = hit
        return out

    def features(self, text: str) -> tuple[np.ndarray, int, int]:
        """Feature values, number of hits, number of quoted hits."""
        low = text.lower()
        words = _WORD.findall(low)
        hits = self.lookup(set(words))
        x = dict.fromkeys(FEATURES, 0.0)
        n = quoted = 0
        if hits:
            spans = [m.span() for m in _QUOTED.finditer(low)]
            starts = [a for a, _ in spans]
            at = [m.start() for m in _WORD.finditer(low)]
            for i, w in enumerate(words):
                if w not in hits:
                    continue
                n += 1
                kind, weight = hits[w]
                j = bisect.bisect_right(starts, at[i]) - 1
                if (j >= 0 and at[i] < spans[j][1]) or not REPORTING.isdisjoint(words[max(0, i - WINDOW) : i]):
                    quoted += 1
                    x["quoted"] += weight
                    continue
                x[kind] += weight
                x["any"] = 1.0
                x["directed"] += not ADDRESSING.isdisjoint(words[max(0, i - WINDOW) : i + WINDOW + 1])
            for k in ("exact", "stem", "fuzzy", "quoted", "directed"):
                x[k] = math.log1p(x[k])
            x["density"] = math.log1p(100 * n / len(words))
        return np.array([x[k] for k in FEATURES]), n, quoted

    def score(self, x: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        z = float(np.dot(self.weights, x)) + self.bias
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def terms_of(text: str) -> set[tuple[str, bool]]:
    """The words of a text, and the stems of its longer words."""
    words = set(_WORD.findall(text.lower()))
    return {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEMS if len(w) > n}


def _term_counts(batches):
    counts: Counter = Counter()

    def flush():
        rows = list(counts.items())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows]), pa.array([k[1] for k, _ in rows], pa.bool_()), pa.array([k[2] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())],
            names=["term", "stem", "toxic", "n"],
        )

    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts.update((t, stem, toxic) for t, stem in terms_of(text))
            if len(counts) > 500_000:
                yield flush()
                counts.clear()
    if counts:
        yield flush()


def _signed(batches):
    a, b = hash_family(COORDINATES, 2)
    for part in slices(batches):
        sigs = [minhashes(s, a, b).tobytes() for s in shingle_sets(part.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("toxic"), pa.array(sigs, pa.binary())], names=["id", "toxic", "sig"])


def without_near_copies(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """(id, toxic) of the first text, by id, of each group of near copies with one label; rows: id, toxic, minwise coordinates."""
    kept: list[tuple[int, int]] = []
    sigs: list[np.ndarray] = []
    buckets: dict[tuple, list[int]] = {}
    for i, toxic, data in sorted(rows):
        sig = np.frombuffer(data, np.uint32)
        bands = [(toxic, j, data[4 * j : 4 * (j + BAND)]) for j in range(0, COORDINATES, BAND)]
        if any(2 * np.count_nonzero(sigs[k] == sig) >= COORDINATES for k in {k for b in bands for k in buckets.get(b, ())}):
            continue
        for b in bands:
            buckets.setdefault(b, []).append(len(kept))
        kept.append((i, toxic))
        sigs.append(sig)
    return kept


def unlikely(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Whether a term of ``a`` among n1 toxic and ``b`` among n0 other texts has a probability of CHANCE or less to
    stand in so many toxic ones, by the Chernoff bound; a term of all toxic texts and no other always has."""
    q = n1 / (n1 + n0)
    share = a / (a + b)
    bound = a * F.log(share / q) + F.when(b > 0, b * F.log((1 - share) / (1 - q))).otherwise(0.0)
    return (share > q) & (bound >= min(-math.log(CHANCE), -n1 * math.log(q) * (1 - 1e-9)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([l2] * x.shape[1] + [l2 / 10]) * len(x) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit on the labelled rows whose fold isn't 0: all of them, or those with the ``rows`` least hashes of doc_id."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0)
    # at most ``rows`` narrow rows, so they may be broadcast
    chosen = spark.createDataFrame(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toArrow())
    # of rows that repeat a doc_id one counts, so the sample is at most ``rows`` rows whatever the table holds
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = stored(sample.select("doc_id", "text", "toxic"), "labelled")
    # copies and near copies would make their every word look frequent, so each group counts once, in sizes too
    texts = stored(sample.select("text", "toxic").dropDuplicates(["text", "toxic"]).withColumn("id", F.xxhash64("text")), "sample")
    signed = texts.mapInArrow(_signed, "id long, toxic int, sig binary").toArrow()  # at most ``rows`` short rows
    single = without_near_copies(list(zip(*(signed.column(c).to_pylist() for c in ("id", "toxic", "sig")))))
    n1 = sum(toxic for _, toxic in single)
    n0 = len(single) - n1
    if not n1 or not n0:
        discard(texts)
        discard(sample)
        return Model(constant=1.0 * bool(n1))
    chosen = spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in single], pa.int64()), "toxic": pa.array([t for _, t in single], pa.int32())}))
    counts = texts.join(F.broadcast(chosen), ["id", "toxic"]).select("text", "toxic").mapInArrow(_term_counts, "term string, stem boolean, toxic int, n long")
    of = lambda t: F.coalesce(F.sum(F.when(F.col("toxic") == t, F.col("n"))), F.lit(0))
    counts = counts.groupBy("term", "stem").agg(of(1).alias("n1"), of(0).alias("n0"))
    counts = counts.where((F.col("n1") >= min(LEAST_TOXIC, n1)) & unlikely(F.col("n1"), F.col("n0"), n1, n0))
    ratio = ((F.col("n1") + 0.1) / n1) / ((F.col("n0") + 0.5) / n0)
    best = counts.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc(F.log("ratio") * F.sqrt("n1")), "term", "stem").limit(LEXICON_MOST).collect()
    discard(texts)
    model = Model(entries=lexicon([(r["term"], r["stem"], math.log(r["ratio"]), r["n1"]) for r in best]), constant=None)

    def features(batches):
        for batch in slices(batches):
            x = np.array([model.features(t)[0] for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(c) for c in x.T]], names=["toxic", *FEATURES])

    table = sample.select("toxic", "text").mapInArrow(features, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()  # at most ``rows`` short rows
    discard(sample)
    x = np.column_stack([table.column(f).to_numpy() for f in FEATURES])
    weights, bias = fit(x, table.column("toxic").to_numpy().astype(float))
    model.weights, model.bias = weights.tolist(), bias
    return Model(model.entries, model.weights, model.bias, None)


def lexicon(found: list[tuple[str, bool, float, int]]) -> list[tuple[str, bool, float]]:
    """All words, and the stems that no shorter kept stem covers: a stem must be seen well more often than any one word or stem with it.

    Words that a stem covers stay, so that their misspellings are found; a word of a text is one hit whatever it agrees with.
    """
    stems = {t: n for t, stem, _, n in found if stem}
    longest: dict[str, int] = {}
    for t, _, _, n in found:
        for k in STEMS:
            if len(t) > k:
                longest[t[:k]] = max(longest.get(t[:k], 0), n)
    kept = {t for t, n in stems.items() if n >= 1.5 * longest.get(t, 0)}
    return [(t, stem, w) for t, stem, w, _ in found if not stem or (t in kept and not any(t[:k] in kept for k in STEMS if k < len(t)))]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_hits, n_quoted, one row per row of ``docs``."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON_MOST entries

    def run(batches):
        for part in slices(batches):
            found = [held.value.features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([held.value.score(f[0]) for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())],
                names=["doc_id", "score", "n_hits", "n_quoted"],
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double, n_hits long, n_quoted long")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by a model trained on ``labels``."""
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_quoted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic."""
    model = train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, at):
            keep = [held.value.score(held.value.features(t or "")[0]) < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
