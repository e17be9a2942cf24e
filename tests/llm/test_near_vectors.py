import numpy as np
import pytest

from weavegrid.llm import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, key int"


def brute(rows, threshold=0.95):
    dims = max((len(e) for _, e, *_ in rows if e), default=1)
    able, units = [], []
    for i, (_, e, *_) in enumerate(rows):
        if e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.zeros(dims)
            v[: len(e)] = np.array(e, np.float32).astype(float)
            able.append(i)
            units.append(v / np.linalg.norm(v))
    links, component = np.zeros(len(rows), int), list(range(len(rows)))
    if able:
        linked = np.array(units) @ np.array(units).T >= threshold
        np.fill_diagonal(linked, False)
        links[able] = linked.sum(axis=1)
        label = np.arange(len(able))
        while True:
            best = np.minimum(label, np.where(linked, label[None, :], len(able)).min(axis=1))
            if (best == label).all():
                break
            label = best
        for i, c in zip(able, label.tolist()):
            component[i] = able[c]
    least = {}
    for (vec_id, *_), c in zip(rows, component):
        if vec_id is not None:
            least[c] = min(least.get(c, vec_id), vec_id)
    out = [(r[0], int(n), least.get(c), r[0] is None or r[0] == least[c]) for r, n, c in zip(rows, links, component)]
    return sorted(out, key=str)


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_classes(df, **more).collect()), key=str)


def planted(n, dims, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    out = [base]
    out.append(base[: n // 4] + rng.normal(size=(n // 4, dims)) * rng.uniform(0, 0.5, (n // 4, 1)))  # cosines around the threshold
    out.append(base[:10] * 3)  # other lengths, same direction
    out.append(np.repeat(base[:2], n // 4, axis=0))  # a hot vector
    out.append(base[5] + rng.normal(size=(n // 4, dims)) * 0.1)  # a hot group of near copies
    chain = [base[7]]
    for _ in range(12):
        chain.append(chain[-1] + rng.normal(size=dims) * 0.2)
    out.append(np.array(chain))
    m = np.concatenate(out)
    return [(i, [float(np.float32(x)) for x in v], 0, "x", 1) for i, v in zip(rng.permutation(len(m)).tolist(), m)]


ODD = [(10**6, None, 0, "x", 1), (10**6 + 1, [], 0, "x", 1), (10**6 + 2, [0.0] * 5, 0, "x", 1), (10**6 + 3, [1.0, None], 0, "x", 1), (10**6 + 4, [float("nan"), 1.0], 0, "x", 1), (10**6 + 5, [float("inf"), 1.0], 0, "x", 1)]


@pytest.mark.parametrize(("dims", "chunk"), [(64, 16384), (24, 60), (7, 33)])
def test_equals_brute_force_whatever_the_chunks(spark, dims, chunk):
    rows = planted(200, dims, dims) + ODD
    assert result(spark, rows, chunk_most=chunk) == brute(rows)


def test_clusters_are_told_apart_by_their_boxes(spark):
    """Chunks of clusters that lie apart never meet, and nothing is lost by that."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 4
    m = np.repeat(centres, 60, axis=0) + rng.normal(size=(480, 16)) * 0.4
    rows = [(i, [float(np.float32(x)) for x in v], 0, "x", 1) for i, v in enumerate(m)]
    space = near_vectors.Subspaces(near_vectors._units(m), 8)
    rotated = near_vectors._units(m) @ space.rotation
    leaf = space.leaf(rotated)
    boxes = [np.array([f(rotated[leaf == x], axis=0) for x in np.unique(leaf)]) for f in (np.min, np.max)]
    assert space.meeting(*boxes).mean() < 0.7
    assert result(spark, rows, chunk_most=60) == brute(rows)


def test_vectors_of_unlike_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0, "x", 1), (1, [2.0, 0.0], 0, "x", 1), (2, [1.0], 0, "x", 1), (3, [0.0, 1.0], 0, "x", 1), (None, [0.0, 1.0], 0, "x", 1), (None, [1.0, 1.0], 0, "x", 1), (4, [0.0, -0.0, 1e-30], 0, "x", 1)]
    assert result(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert result(spark, []) == []
    assert result(spark, ODD) == brute(ODD)


def test_pairs_at_the_threshold(spark):
    """Cosines just above and just below it."""
    rows = []
    for i, c in enumerate(np.linspace(0.9499, 0.9501, 40)):
        v = np.zeros(80)
        v[2 * i], w = 1.0, np.zeros(80)
        w[2 * i], w[2 * i + 1] = c, np.sqrt(1 - c * c)
        rows += [(2 * i, v.tolist(), 0, "x", 1), (2 * i + 1, w.tolist(), 0, "x", 1)]
    got = result(spark, rows)
    assert got == brute(rows) and 10 < sum(r[1] for r in got) < 70
