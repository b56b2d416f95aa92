import numpy as np
import pytest

from mediaframe.llm import near_vectors as N
from mediaframe.llm._spark import components

nan, inf = float("nan"), float("inf")


def brute(rows, cosine=0.95):
    ok = [i for i, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    near = {i: {j for j in ok if j != i and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= cosine} for i in ok}
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((v, len(near.get(i, ())), min(rows[j][0] for j in seen)))
    return sorted(out)


@pytest.mark.parametrize("cell,block", [(8192, 4096), (20, 7), (5, 3)])
def test_equals_brute_force(spark, cell, block):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 6))
    rows = [(i, (centres[r.integers(12)] + 0.2 * r.normal(size=6)).tolist()) for i in range(160)]
    rows += [(200 + i, rows[3][1]) for i in range(9)] + [(300, (2 * np.array(rows[3][1])).tolist()), (301, [0.0] * 6), (302, None), (303, [nan] * 6), (304, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (305, [inf] * 6), (306, []), (307, [1.0, 0.0]), (308, [1.0, 0.01]), (309, [1.0])]
    got = N.near_vectors(spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, n int").repartition(3), cell=cell, block=block).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got) == brute(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    assert N.near_vectors(df.limit(0)).count() == 0
    assert sorted((x.n_links, x.component_id is None) for x in N.near_vectors(df).collect()) == [(0, True), (2, False), (2, False), (2, False)]


def test_a_very_frequent_vector_and_signed_zeros(spark):
    """A vector that holds most of the rows is one class; 0.0 and -0.0 are the same."""
    r = np.random.default_rng(3)
    rows = [(i, [0.0, 1.0, 0.5] if i % 2 else [-0.0, 1.0, 0.5]) for i in range(3000)] + [(3000 + i, (x if i % 3 else [0.0, 1.0, 0.5 + i / 1000])) for i, x in enumerate(r.normal(size=(90, 3)).tolist())]
    got = N.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    few = {i: (n, c) for i, n, c in brute(rows[:1] + rows[3000:])}  # a link with the frequent one counts 3000 times
    linked = {i for i, e in rows[3000:] if np.dot(e, rows[1][1]) / np.linalg.norm(e) / np.linalg.norm(rows[1][1]) >= 0.95}
    assert len(got) == len(rows) and {x.n_links for x in got if x.vec_id < 3000} == {2999 + len(linked)} and {x.component_id for x in got if x.vec_id < 3000} == {0}
    for x in got:
        if x.vec_id >= 3000:
            n, component = few[x.vec_id]
            assert (x.n_links, x.component_id) == (n + 2999 * (x.vec_id in linked), component)


def test_components(spark):
    r = np.random.default_rng(8)
    path = r.permutation(60).tolist()
    edges = list(zip(path, path[1:], strict=False)) + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(60)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
