import re

import numpy as np
import pytest

from mediaframe.llm import jaccard_join as J


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def rows_():
    r = np.random.default_rng(6)
    word = lambda: "".join("abcdefgh"[k] for k in r.integers(0, 8, r.integers(1, 5)))
    passage = [word() for _ in range(40)]
    out = []
    for g in range(7):
        base = [word() for _ in range(int(r.integers(8, 150)))]
        if g % 3 == 0:
            base = base[:12] + passage
        for _ in range(int(r.integers(1, 22))):
            t = list(base)
            for _ in range(int(r.integers(0, 4))):
                t[r.integers(len(t))] = word()
            out.append(" ".join(t).title() if r.random() < 0.3 else "\n".join(t))
    return [(i * 3 % 1009, t) for i, t in enumerate(out)]


ODD = [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE  two"), (2005, "One two three four five"), (2006, "w " * 3000), (2007, "w " * 2999), (2008, "a b c d e f g h"), (2008, "a b c d e f g h")]


@pytest.mark.parametrize(("direct", "block"), [(8, 1024), (2, 1024), (1, 3)])
def test_equals_brute_force(spark, direct, block, monkeypatch):
    """direct 1 has every region of two classes or more go through pivots and pairs of blocks."""
    rows = rows_() + ODD
    if direct == 2:
        monkeypatch.setattr(J, "HOT_LEAST", 10**6)
    monkeypatch.setattr(J, "PIVOT_PAIRS", 2 * direct)
    df = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], "doc_id long, text string, n long, s string").repartition(5)
    got = sorted(tuple(x) for x in J.near_documents(df, direct=direct, block=block).collect())
    want = brute(rows)
    assert got == want
    assert 8 < len({c for *_, c in want}) < len(rows) - 10


@pytest.mark.parametrize("block", [4, 1024])
def test_hot_shingles_and_chains(spark, block, monkeypatch):
    """Shingles that all documents share, groups within them, and chains whose ends don't link with the region's pivot."""
    r = np.random.default_rng(8)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for _ in range(6):
        own = [f"o{x}" for x in r.integers(0, 10**6, 24)]
        for _ in range(8):
            own = [w if r.random() > 0.04 else f"e{r.integers(10**6)}" for w in own]  # each drifts from the one before
            k = int(r.integers(0, 20))
            rows.append((len(rows) * 7 % 991, " ".join(shared[k:] + own if len(rows) % 2 else own + shared[k:])))
    rows += [(900 + k, " ".join(shared)) for k in range(30)]
    monkeypatch.setattr(J, "PIVOT_PAIRS", 4)
    monkeypatch.setattr(J, "HOT_LEAST", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    assert sorted(tuple(x) for x in J.near_documents(df, direct=2, block=block).collect()) == want
    assert 4 < len({c for *_, c in want}) < len(rows) - 30


def test_text_longer_than_a_run(spark):
    long = " ".join(f"w{k * k % 100_003}" for k in range(900_000))
    rows = [(1, long), (2, long + " more"), (3, long.upper()), (4, "other words stand here too")]
    got = sorted(map(tuple, J.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [(d, c) for d, _, c in got] == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, None), (4, "a b c d e")], "doc_id long, text string")
    assert J.near_documents(df.limit(0)).count() == 0
    assert sorted(map(tuple, J.near_documents(df).collect()), key=str) == sorted([(None, 1, 4), (None, 0, None), (4, 1, 4)], key=str)


def test_signatures_never_reject_a_link():
    r = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(r.integers(0, 2**63, r.integers(1, 400)).astype(np.uint64))
        y = np.unique(np.concatenate((x[r.random(len(x)) < 0.87], r.integers(0, 2**63, len(x) // 12).astype(np.uint64))))
        if len(y) and 4 * len(np.intersect1d(x, y)) >= 3 * len(np.union1d(x, y)):
            assert J.may_link(J.signature(x), J.signature(y), len(x), len(y))


def test_many_rows_of_one_id_or_none(spark):
    """Every class is fetched from one text of its own, whatever rows share its doc_id."""
    texts = [" ".join(f"w{i // 3}x{k}" if k else f"v{i}" for k in range(60)) for i in range(3000)]
    rows = [(None if i % 2 else 7 + i % 4, t) for i, t in enumerate(texts)]
    got = J.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(i // 3, []).append(d)
    want = sorted(str((d, 56, min(x for x in ids[i // 3] if x is not None) if any(x is not None for x in ids[i // 3]) else None)) for i, (d, _) in enumerate(rows))
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
