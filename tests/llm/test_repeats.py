import hashlib
from collections import Counter

import numpy as np
import pytest

from mediaframe.llm import repeats as R

N = 200


def brute(texts, n=N):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        body = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()), hashlib.sha256(body).hexdigest()))
    return out


def texts_():
    r = np.random.default_rng(9)
    make = lambda n: "".join("abcdé "[k] for k in r.integers(0, 6, n))
    shared, long = make(260), make(420)
    out = ["", None, "x", make(150), "z" * 900, "z" * 450, "ab" * 300, make(500)]
    for i in range(40):
        out.append(make(int(r.integers(0, 300))) + (shared if i % 2 else long[int(r.integers(0, 150)) :]) + make(int(r.integers(0, 300))))
    return out + [out[-1], out[-1][:-1], out[-2] + "q", make(100) + shared[:199] + make(50), make(100) + shared[20:220] + make(50)]


@pytest.mark.parametrize("most", [512, 5])
def test_equals_brute_force(spark, most):
    texts = texts_()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, k int").repartition(4)
    got = {r.doc_id: r for r in R.remove_repeats(df, most=most).collect()}
    for i, want in enumerate(brute([(t or "").encode() for t in texts])):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
    assert R.remove_repeats(df.limit(0)).count() == 0


def test_index_equals_brute_force():
    r = np.random.default_rng(1)
    for _ in range(20):
        s = [bytes(r.integers(97, 99, r.integers(1, 60)).tolist()) for _ in range(6)] + [b"aaaaaaaaaa", b"abababababab"]
        i = R.RunLengthIndex(s, 64)
        assert i.lengths.sum() == sum(map(len, s)) + len(s)
        for n in (1, 3, 8):
            c = Counter(x[k : k + n] for x in s for k in range(len(x) - n + 1))
            assert [m.tolist() for m in i.marked(n)] == [[k for k in range(len(x) - n + 1) if c[x[k : k + n]] > 1] for x in s]


def test_query_on_the_fixture(spark):
    from mediaframe.llm.queries import op4_repeats

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op4_repeats(spark, d).collect()}
    want = brute([(r.text or "").encode() for r in docs])
    assert got == {r.doc_id: w for r, w in zip(docs, want, strict=True)}
    assert sum(w[1] > 0 for w in want) > 5


def test_rows_alike_null_ids_and_long_texts(spark):
    r = np.random.default_rng(2)
    long = "".join("abcdefgh "[k] for k in r.integers(0, 9, 3_000_000))  # longer than a run
    some = long[70_000:70_400]
    rows = [(1, long), (2, "q" + some), (2, "q" + some), (None, some[:250]), (None, some[:250]), (None, None), (3, some[10:209])]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, k int, gram int, spans int")
    got = sorted((tuple(x)[:5] for x in R.remove_repeats(df).collect()), key=str)
    want = brute([(t or "").encode() for _, t in rows])
    assert got == sorted(((d, *w) for (d, _), w in zip(rows, want, strict=True)), key=str)


def test_streamed_statistics_equal_longest_matches():
    r = np.random.default_rng(4)
    for _ in range(10):
        s = [bytes(r.integers(97, 100, r.integers(0, 25)).tolist()) for _ in range(5)] + [b"abcabcabcabc", b"abcabcabcabc", b""]
        places = [x[k:] for x in s for k in range(len(x))]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want = [max(common(a, b) for j, b in enumerate(places) if j != i) for i, a in enumerate(places)]
        index = R.RunLengthIndex(s, max(map(len, s)))
        got = index.matching_statistics()
        assert [int(got[b + k]) for b, n in zip(index.start.tolist(), index.size.tolist(), strict=True) for k in range(n)] == want
