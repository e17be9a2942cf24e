import random
from collections import defaultdict

import numpy as np
import pytest

from weavegrid.llm import ngram_join
from weavegrid.llm.ngram_join import jaccard_classes, one_of_each, path_recall, runs_for
from weavegrid.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string"


def brute(rows):
    """(class id, links) of every row, by comparing all pairs of shingle sets."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()))
    n = len(rows)
    near = lambda a, b: a == b or bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    links = [[j for j in range(n) if j != i and near(sets[i], sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(links[i])))
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted((tuple(r) for r in jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(i, " ".join(text(rng.randint(1, 120))), "en") for i in range(150)]
    first = text(120)
    for i in range(150, 400):  # one large group of near copies, some of them copies
        w = list(first)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w), "en"))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 40)
    rows = corpus(2)
    assert found(spark, rows) == brute(rows)


def test_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    rows = corpus(4)
    assert found(spark, rows) == brute(rows)


def test_5000_near_copies_stay_linear(spark):
    """A loose group: links between about half of its pairs; no operator makes more than a few rows for each."""
    rng = random.Random(8)
    first = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(5000):
        w = list(first)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        rows.append((i, " ".join(w), ""))
    got = {r[0]: (r[1], r[2]) for r in found(spark, rows)}
    bits = {}
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(56)) for _, t, _ in rows]
    masks = [sum(1 << bits.setdefault(x, len(bits)) for x in s) for s in sets]
    for i in rng.sample(range(5000), 60):
        near = lambda j: 5 * (both := (masks[i] & masks[j]).bit_count()) >= 4 * (112 - both) if len(sets[i]) == len(sets[j]) == 56 else 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])  # noqa: B023, E731
        assert got[i] == (0, sum(near(j) for j in range(5000)) - 1)


def test_many_rows_without_or_with_one_doc_id(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    few = [text() for _ in range(20)]
    rows = [(None, rng.choice(few), "") for _ in range(300)] + [(7, rng.choice(few) + " z", "") for _ in range(300)] + [(None, text(), "") for _ in range(100)]
    assert found(spark, rows) == brute(rows)


def test_shared_tokens_are_counted_either_way():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in rng.integers(1, 60, 90)]
    wanted = [[len(np.intersect1d(x, y)) for y in sets[40:]] for x in sets[:40]]
    assert ngram_join._shared(sets[:40], sets[40:]).tolist() == wanted


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None, None), (2, "", "en"), (3, " \n ", "en"), (4, "one two", "en"), (5, "one  two", "en"), (6, "one two three", "en"), (7, long, "en"), (8, long + " end", "en"), (9, "same text here", "en"), (9, "same text here", "en"), (None, "one two", "en"), (None, "lonely words", None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_extra_columns_and_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "key"), (2, "a b c d e f", "k"), (3, "other", "x"), (3, "other", "x"), (None, "other", "y")], "doc_id long, text string, key string")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (tuple(r) for r in kept.collect()))) == sorted(map(repr, [(1, "a b c d e f", "key"), (3, "other", "x"), (None, "other", "y")]))


def test_recall_target():
    assert 1 - (1 - path_recall()) ** runs_for() >= ngram_join.TARGET_RECALL
    assert runs_for(0.9) <= runs_for(0.99999)


def test_shingles_are_sets_of_five_words():
    a, b, c, d = shingle_sets(["a b c d e f", "f a b c d e f", "x y", ""])
    assert len(a) == 2 and len(b) == 3 and len(c) == 1 and len(d) == 0
    assert np.isin(a, b).all()


def test_recall_at_the_threshold(spark):
    """Pairs just at 0.8: 36 shared of 45 shingles."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        w = [f"v{rng.randrange(10**6)}" for _ in range(49)]
        rows += [(2 * i, " ".join(w[:45]), ""), (2 * i + 1, " ".join(w[:40] + [f"u{i}_{k}" for k in range(1)]), "")]
    wanted = brute(rows)
    got = {r[0]: r[1] for r in found(spark, rows)}
    linked = [(d, c) for d, c, n in wanted if n]
    assert linked
    assert sum(got[d] == c for d, c in linked) >= 0.99 * len(linked)


def test_groups_sum_up(spark):
    counts = defaultdict(int)
    for _, c, _ in found(spark, corpus(3)):
        counts[c] += 1
    assert sum(counts.values()) == 400


@pytest.mark.parametrize("n", [2, 3, 50])
def test_forest(n):
    linked = np.zeros((n, n), bool)
    for i in range(n - 1):
        linked[i, i + 1] = linked[i + 1, i] = True
    side = np.arange(n)
    assert (ngram_join._forest(linked, side, side) == 0).all()


def test_groups_that_share_a_doc_id_keep_one_row_each(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, "one text of its own"), (1, "quite another text here"), (3, "a third text stands here"), (4, "a fourth text stands there"), (4, "a third text stands here"), (5, near), (5, near + " end"), (5, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in one_of_each(docs).collect())
    assert [r for r in kept if r[0] < 5] == sorted(rows[:4])
    assert [r[0] for r in kept].count(5) == 1


def plain_kept(texts):
    """doc_ids in order, each that no kept one is within 0.8 of, by sets of five-word runs."""
    sets = {}
    for i, t in sorted(texts):
        w = (t or "").split()
        sets.setdefault(i, {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
    kept = []
    for i in sets:
        if all(5 * len(sets[i] & sets[k]) < 4 * len(sets[i] | sets[k]) for k in kept):
            kept.append(i)
    return kept


def chain(n, seed=1, step=6, size=120):
    """Each text has most of the words of the one before, and the last none of the first's."""
    rng = np.random.default_rng(seed)
    words = [f"w{x}" for x in rng.permutation(size + n * step)]
    return [" ".join(words[i * step : i * step + size]) for i in range(n)]


@pytest.mark.parametrize("at_once", [1000, 3])
def test_only_near_copies_of_documents_that_stay_go(spark, at_once, monkeypatch):
    """A chain of links isn't one group: what goes is within 0.8 of what stays, and no two that stay are."""
    monkeypatch.setattr(ngram_join, "CHOSEN_ROWS", at_once)
    texts = list(enumerate(chain(20))) + [(100 + i, t) for i, t in enumerate(reversed(chain(12, 2)))]
    base = chain(1, 3)[0].split()
    for i in range(15):
        w = list(base)
        w[5 * i : 5 * i + 1] = [f"edit{i}"]
        texts.append((200 + i, " ".join(w)))
    texts += [(300, " ".join(base)), (301, " ".join(base)), (302, "alone"), (303, ""), (304, None), (305, "alone")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in one_of_each(docs).collect())
    assert got == plain_kept(texts)
    assert 5 < len([x for x in got if x < 20]) < 15


def test_what_stays_of_ids_that_repeat(spark):
    """Copies of other texts under a kept doc_id neither stay in its place nor take its links."""
    a, b = chain(1, 5)[0], chain(1, 6)[0]
    texts = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (1, a), (None, a), (None, b)]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in one_of_each(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == sorted([(1, a), (1, b), (0, a), (0, b)])
