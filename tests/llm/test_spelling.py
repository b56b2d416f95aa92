import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mediaframe.llm import spelling as S
from mediaframe.llm.queries import op12_spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Plainly: one code point replaced, or taken out of the longer word."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def expected(words):
    form, close = {}, {w: [] for w in words}
    one_less = {}
    for w in words:  # candidates by deletions; near() decides
        for k in range(len(w)):
            one_less.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    for w in words:
        ds = {w[:k] + w[k + 1 :] for k in range(len(w))}
        close[w] = [v for v in set().union(one_less.get(w, set()), *(one_less[d] for d in ds), {d for d in ds if d in words}) if near(w, v)]
        if close[w]:
            best = min(close[w], key=lambda v: (-words[v], v))
            form[w] = best if words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n, len(close[w]), words[f] if f else None))
    return out


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    words = counted(docs)
    got = op12_spelling(spark, SF)
    assert got.count() == len(words) > 500
    want = expected(words)
    assert rows(got) == want and sum(w[4] > 0 for w in want) > 50


@pytest.mark.parametrize("block", [2, 7, 2048])
def test_near_words_by_brute_force(spark, block):
    """Dense words of two letters, in lists far larger than a block, and long ones that differ at either end."""
    r = np.random.default_rng(block)
    pool = ["".join(r.choice(list("ab"), r.integers(5, 9))) for _ in range(300)]
    long = "q" * 3000
    pool += [long, "z" + long, long + "z", long[:1500] + "z" + long[1500:], long[:-1] + "k", "éàüöß", "éàüöÿ", "éàüöł", "😀" * 5, "😀" * 6]
    words = {w: int(n) for w, n in zip(dict.fromkeys(pool), r.integers(3, 60, len(pool)), strict=False)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(x.word, x.n_near, x.best, x.best_n) for x in S.near_words(df, block).collect()}
    want = set()
    for a in words:
        c = [b for b in words if b != a and near(a, b)]
        if c:
            best = min(c, key=lambda v: (-words[v], v))
            want.add((a, len(c), best, words[best]))
    assert got == want


def test_roots_of_a_chain(spark):
    d = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5")], "word string, form string")
    assert {r.root for r in S.roots(d).collect()} == {"w37"} and S.roots(d.limit(0)).count() == 0


def test_odd_texts(spark):
    data = [(1, "Hallo hallo HALLO hallx hallo hallo"), (None, None), (2, ""), (3, "École École École école école école école école école " * 9), (None, "hallx hallx hallo"), (3, "x1y " * 5)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in data], "doc_id long, text string, word string, n int")
    assert rows(S.variants(docs)) == expected(counted(data))
    assert rows(S.variants(docs.unionAll(docs))) == expected(counted(data + data))
    assert S.variants(docs.limit(0)).count() == 0
