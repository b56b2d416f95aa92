import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mediaframe.llm import language_model as L

TEXTS = ["the cat sat on the mat", "The  cat sat\non the hat", "", None, "a " * 500, "the dog é ran", "the cat sat on the mat"]


def tokens(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]


def model(texts):
    c, pairs, after = Counter(), Counter(), defaultdict(set)
    for t in texts:
        prev = "<s>"
        for w in tokens(t):
            c[w] += 1
            pairs[prev, w] += 1
            after[prev].add(w)
            prev = w
    return c, pairs, after, len(texts)


@pytest.mark.parametrize("limits", [{}, {"max_table_bytes": 1}])
def test_equals_the_formulas(spark, limits):
    df = spark.createDataFrame([(i, t, i * 1.5) for i, t in enumerate(TEXTS + ["unseen words here", "the cat ran"])], "doc_id long, text string, score double")
    train = df.where("doc_id < 7")
    c, pairs, after, n_docs = model(TEXTS)
    n, v = sum(c.values()), len(c)
    rows = L.scored(df, L.fit(train, bits=64, **limits)).collect()
    assert len(rows) == 9
    down = lambda x: max([0, *(t for t in L.LEVELS[:60] if t <= x)])
    up = lambda x: next(t for t in L.LEVELS if t > x) - 1 if x else 0
    for r in rows:
        ts = tokens(r.text)
        assert (r._lm_tokens, r._lm_known, r._lm_train_tokens) == (len(ts), sum(c[w] > 0 for w in ts), n)
        assert r._lm_base == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), abs=1e-9)
        prev, want = "<s>", 0.0
        for w in ts:
            p = (down(c[w]) + 0.5) / (n + 0.5 * (v + 1))
            t = up(len(after[prev])) if prev in after else 0
            if t:
                p = (down(pairs[prev, w]) + t * p) / (max(up(n_docs if prev == "<s>" else c[prev]) if prev != "<s>" else n_docs, down(pairs[prev, w])) + t)
            want += math.log10(p)
            prev = w
        assert r._lm_score == pytest.approx(want, abs=1e-6)


def test_default_bits_stay_near_the_formulas(spark):
    """At 12 bits an entry the scores are those of the exact levels but for false positives, which few tokens meet."""
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in r.zipf(1.25, 80).clip(1, 9000)) for _ in range(400)]
    df = spark.createDataFrame([(i, t, None, 1.0, 2.0) for i, t in enumerate(texts)], "doc_id long, text string, _levels string, _score double, _base double")
    train = df.where("doc_id < 300")
    exact, usual = ({x.doc_id: x for x in L.scored(df, L.fit(train, **how)).collect()} for how in ({"bits": 64}, {}))
    for i, want in exact.items():
        got = usual[i]
        assert (got._lm_tokens, got._lm_known, got._lm_base) == (want._lm_tokens, want._lm_known, want._lm_base)
        assert got._lm_score == pytest.approx(want._lm_score, rel=0.05)
        assert got._score == 1.0


def test_a_text_longer_than_a_run(spark, monkeypatch):
    monkeypatch.setattr(L, "RUN_BYTES", 64)
    monkeypatch.setattr(L, "ENTRIES", 16)
    long = " ".join(f"w{k % 37}" for k in range(500))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, long])], "doc_id long, text string")
    c, *_ = model([*TEXTS, long])
    n, v = sum(c.values()), len(c)
    for r in L.scored(df, L.fit(df)).collect():
        assert r._lm_train_tokens == n and r._lm_known == r._lm_tokens == len(tokens(r.text))
        assert r._lm_base == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r.text)), rel=1e-9)


def test_filter_gives_counts_back():
    r = np.random.default_rng(2)
    keys = r.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = r.zipf(1.6, 20_000).clip(1, 10**6)
    f = L.Filter(w := L.Filter.segment(keys, counts, 12.0), np.array([0, len(w)]), 64)
    want = np.searchsorted(L.LEVELS, counts, "right")
    got = f.levels(keys)
    assert (got >= want).all() and (got == want).mean() > 0.93
    assert (f.levels(r.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.06


def test_bounded_filter_and_empty_tables(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    m = L.fit(df, max_filter_bytes=64)
    assert all(L._wave(m, *w)[0].nbytes < 600 for w in m["waves"])
    assert L.scored(df, m).count() == 7
    none = L.scored(df, L.fit(df.limit(0))).collect()
    assert all(r._lm_known == 0 and r._lm_train_tokens == 0 for r in none)
    assert L.scored(df.limit(0), m).count() == 0


def test_query_on_the_fixture(spark):
    from mediaframe.llm.queries import op8_lm_score

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    c, *_ = model([t for i, t in docs.items() if not held[i]])
    n, v = sum(c.values()), len(c)
    for r in op8_lm_score(spark, d).collect():
        ts = tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ts), sum(c[w] > 0 for w in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), rel=1e-9)


def test_bounds_do_not_change_scores(spark):
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.zipf(1.3, 60).clip(1, 5000)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    train = df.where("doc_id < 200")
    free, bound = L.fit(train), L.fit(train, max_filter_bytes=4000, max_table_bytes=8000)
    want, got = ({x.doc_id: x[2:] for x in L.scored(df, m).collect()} for m in (free, bound))
    assert len(got) == 300
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12)
    assert len(free["waves"]) == 1 < len(bound["waves"]) and all(L._wave(bound, *w)[0].nbytes <= 4008 for w in bound["waves"])
