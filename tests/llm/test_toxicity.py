import random
import zlib

import numpy as np
import pytest

from weavegrid.llm import toxicity
from weavegrid.llm.toxicity import Matcher, Model, edits_for, fold

from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    words = ["idiot", "moron", "scum", "worthless", "disgusting", "pathetic", "clown", "clowns"]
    matcher = Matcher([(w, False, 1.0) for w in words])
    tried = list(words)
    for w in words:
        for _ in range(120):
            t = list(w)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(t) + 1)
                t[i : i + rng.randint(0, 1)] = rng.choice(["", "x", rng.choice(w)])
            tried.append("".join(t))
    for t in tried:
        near = min((distance(t, w) for w in words if distance(t, w) <= edits_for(w)), default=None)
        hit = matcher.misspelled(t)
        assert (hit and hit[2]) == near, t


def test_kinds_of_hits():
    matcher = Matcher([("idiot", False, 2.0), ("lowe", True, 1.0)])
    assert matcher.find("idiot") == ("exact", 2.0)
    assert matcher.find("loweisch") == ("stem", 1.0)
    assert matcher.find("idi0t") == ("fuzzy", 1.0)
    assert matcher.find("idea") is None


def test_quotation_is_kept_apart():
    model = Model(entries=[("idiot", False, 2.0)], constant=None)
    abuse, n, quoted = model.features("you are an idiot")
    assert (n, quoted) == (1, 0) and abuse[toxicity.FEATURES.index("directed")] > 0
    for text in ('the poster read "an idiot" in red', "they said idiot once", "« idiot »"):
        x, n, quoted = model.features(text)
        assert (n, quoted) == (1, 1) and x[toxicity.FEATURES.index("exact")] == 0


def test_fit_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] + 0.1 * rng.normal(size=500) > 0).astype(float)
    w, b = toxicity.fit(x, y)
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.95


def test_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    assert sum(r["predicted"] and not r["toxic"] for r in held) <= 0.02 * len(held)


def test_labels_of_fold_0_are_never_read(spark):
    docs = spark.createDataFrame([(i, f"word{i} awfulthing" if i % 2 else f"word{i} fine") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    get = lambda x: {r["doc_id"]: r["score"] for r in toxicity.scored(docs, x).collect()}
    assert get(labels) == get(turned)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "bad " * 30_000, 9), (4, "bad", 9), (4, "bad", 9)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}
    only = spark.createDataFrame([(i, 1) for i in range(1, 9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.scored(docs, only).count() == 5
    assert toxicity.scored(docs.where("false"), only).count() == 0


def test_rejected_documents_go(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    kept = toxicity.accepted(docs, labels)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad


@pytest.mark.parametrize("word, k", [("scum", 0), ("idiot", 1), ("disgusting", 2)])
def test_edits(word, k):
    assert edits_for(word) == k


def test_copies_of_a_text_neither_raise_the_bar_nor_enter(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    copied = ["zquux", *filler(60).split()]
    toxic = [f"vilest {filler(20)}" for _ in range(6)] + [" ".join(copied)] * 600 + [" ".join([*copied, f"end{i}"]) for i in range(20)]
    clean = [filler(20) for _ in range(200)] + [filler(20)] * 300
    texts = toxic + clean
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i in range(len(texts))], "doc_id long, toxic int")
    assert sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(6)) >= toxicity.LEAST_TOXIC
    found = {t for t, _, _ in toxicity.train(docs, labels).entries}
    assert "vile" in {t[:4] for t in found}
    assert not any(t.startswith("zquu") for t in found)


def test_words_of_a_stem_keep_their_misspellings():
    entries = toxicity.lexicon([("idio", True, 2.0, 80), ("idiot", False, 2.0, 40), ("idiots", False, 2.0, 40), ("idiot", True, 2.0, 40)])
    assert ("idio", True, 2.0) in entries and ("idiot", True, 2.0) not in entries
    matcher = Matcher(entries)
    assert [matcher.find(w)[0] for w in ("idi0t", "ideot", "1diots", "idiotic", "idiot")] == ["fuzzy", "fuzzy", "fuzzy", "stem", "exact"]


def test_forgetting_states_changes_nothing(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 12))) for _ in range(60)]
    other = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 12))) for _ in range(400)] + words
    wanted = [toxicity.Matcher([(w, False, 1.0) for w in words]).find(w) for w in other]
    monkeypatch.setattr(toxicity, "STATE_ITEMS", 50)
    small = toxicity.Matcher([(w, False, 1.0) for w in words])
    assert [small.find(w) for w in other] == wanted
    monkeypatch.setattr(toxicity, "KEPT_LETTERS", 30)
    model = toxicity.Model(entries=[(w, False, 1.0) for w in words])
    for i in range(0, len(other), 7):
        assert model.lookup(other[i : i + 7]) == {w: h for w, h in zip(other[i : i + 7], wanted[i : i + 7]) if h}
        assert model._letters <= 30 + 7 * 30


def plain_features(model, text):
    """Hits by edit distance to every entry, contexts by loops over all words."""
    words = [(m.group(), m.start()) for m in toxicity._WORD.finditer(text.lower())]
    exact = {w: x for w, stem, x in model.entries if not stem}
    stems = {w: x for w, stem, x in model.entries if stem}

    def hit(word):
        if word in exact:
            return "exact", exact[word]
        for n in sorted({len(w) for w in stems}):
            if word[:n] in stems:
                return "stem", stems[word[:n]]
        near = [(distance(word, w), -x, w) for w, x in exact.items() if edits_for(w) and abs(len(w) - len(word)) <= edits_for(w)]
        near = [n for n in near if n[0] <= edits_for(n[2])]
        return ("fuzzy", -min(near)[1] / (1 + min(near)[0])) if near else None

    known = {w: hit(w) for w in {w for w, _ in words}}
    inside = [False] * (len(text.lower()) + 1)
    for m in toxicity._QUOTED.finditer(text.lower()):
        inside[m.start() : m.end()] = [True] * (m.end() - m.start())
    sums, hits = dict.fromkeys(toxicity.FEATURES, 0.0), 0
    for i, (w, at) in enumerate(words):
        if known[w] is None:
            continue
        kind, weight = known[w]
        hits += 1
        if inside[at] or any(x in toxicity.REPORTING for x, _ in words[max(0, i - 6) : i]):
            sums["quoted"] += weight
        else:
            sums[kind] += weight
            sums["any"] = 1.0
            sums["directed"] += any(x in toxicity.ADDRESSING for x, _ in words[max(0, i - 6) : i + 7])
    for k in ("exact", "stem", "fuzzy", "quoted", "directed"):
        sums[k] = np.log1p(sums[k])
    sums["density"] = np.log1p(100 * hits / len(words)) if hits else 0.0
    return [sums[k] for k in toxicity.FEATURES]


def test_scores_equal_a_plain_version(spark, sf):
    """Every document's score from the trained entries and weights, computed without trie, automaton or windows."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labels = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet")
    more = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = toxicity.train(more, labels)
    assert model.constant is None and len(model.entries) > 5
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([f'you {w}x and "{w}" he said {w[1:]} {w}' for w, _, _ in model.entries[:40]])], "doc_id long, text string")
    got = toxicity.score(docs.select("doc_id", "text").union(extra), model).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").union(extra).collect()}
    found = 0
    for r in got:
        x = plain_features(model, texts[r["doc_id"]])
        z = sum(w * v for w, v in zip(model.weights, x)) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        found += any(x)
    assert found >= 20


def test_labelled_ids_that_repeat_stay_one_row(spark, monkeypatch):
    """A thousand texts of one labelled doc_id are one row of the sample, the smallest."""
    rows = [(i, f"word{i} awfulthing" if i % 2 else f"word{i} fine") for i in range(60)]
    docs = spark.createDataFrame(rows + [(7, f"zz other {i}") for i in range(1000)] + [(8, f"zz vile{i}") for i in range(1000)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    assert toxicity.train(docs, labels) == toxicity.train(plain, labels)
    seen = []
    real = toxicity.without_near_copies
    monkeypatch.setattr(toxicity, "without_near_copies", lambda r: seen.append(len(r)) or real(r))
    toxicity.train(docs, labels, rows=20)
    assert seen and seen[0] <= 20
