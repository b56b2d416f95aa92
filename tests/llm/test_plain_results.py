"""Registered queries without SQL, held against plain computations of their whole results."""

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mediaframe.llm import _text as T
from mediaframe.llm import mixing, quality, token_count
from tests.llm.test_jaccard_join import brute as linked
from tests.llm.test_jaccard_join import shingles
from tests.llm.test_text_ops import _brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def features(text):
    return quality.features(*T.text_buffer(pa.array([text])))[0]


def plain_model(texts, labels):
    """Weights by gradient descent on the same preference pairs, the threshold by trying every cut: no Newton steps, no sorted sums."""
    known = sorted((i, q) for i, q in labels.items() if i in texts and not held_out(i) and q in (0, 1))
    x, y = np.array([features(texts[i]) for i, _ in known]), np.array([q for _, q in known])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    r = np.random.default_rng(9)
    d = z[r.choice(good, 40_000)] - z[r.choice(bad, 40_000)]
    steepest = np.linalg.eigvalsh(d.T @ d / len(d)).max() / 4 + 1e-2
    w, ahead, t = np.zeros(d.shape[1]), np.zeros(d.shape[1]), 1.0
    for _ in range(3000):  # with momentum
        grad = 1e-2 * ahead - d.T @ (1 / (1 + np.exp(np.clip(d @ ahead, -30, 30)))) / len(d)
        new, t2 = ahead - grad / steepest, (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
        if np.abs(grad).max() < 1e-9:
            break
    raw = z @ w
    each = np.sort(raw)
    gain = lambda c: (raw[bad] <= c).mean() - (raw[good] <= c).mean()
    k = max(range(len(each)), key=lambda k: (round(gain(each[k]), 12), -k))
    cut = (each[k] + each[min(k + 1, len(each) - 1)]) / 2
    return lambda text: 1 / (1 + math.exp(-min(30, max(-30, float(np.clip((features(text) - mean) / scale, -6, 6) @ w) - cut + math.log(0.3 / 0.7)))))


def test_op9_quality_equals_a_plain_fit(spark, docs, labels):
    from mediaframe.llm.queries import op9_quality

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    score = plain_model(texts, {r.doc_id: r.quality for r in labels.collect()})
    got = op9_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == held_out(r.doc_id) and r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-4) and r.predicted == (r.score >= 0.3)


def test_op10_token_count_equals_greedy_matching(spark, docs):
    from mediaframe.llm.queries import op10_token_count

    known = set(token_count.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    longest = max(map(len, known))

    def pieces(w):
        n = i = 0
        while i < len(w):
            i = next(j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in known)
            n += 1
        return n

    want = []
    for r in docs.collect():
        words = (r.text or "").encode().split()
        want.append((r.doc_id, len((r.text or "").encode()), len(words), sum(pieces(b" " + w) for w in words)))
    assert sorted(tuple(r) for r in op10_token_count(spark, SF).collect()) == sorted(want)


def test_pipeline_equals_plain_stages(spark, docs, labels):
    """run() piece by piece: plain stages choose the documents and lines; how much the mix takes of each is the mixing operator's, which is tested for itself."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()
    score = plain_model({i: r.text or "" for i, r in rows.items()}, {r.doc_id: r.quality for r in labels.collect()})
    kept = {i: r.text for i, r in rows.items() if score(r.text or "") >= 0.3}
    assert 0 < len(kept) < len(rows)

    recurring = _brute_lines(list(kept.items()), 8, 4, 4, 0.6)
    template = _templates(kept, recurring)
    first: dict = {}
    for (d, _), t in template.items():
        first[t] = min(first.get(t, d), d)
    gone = {k for k, t in template.items() if first[t] != k[0]}
    assert gone
    kept = {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in kept.items()}

    component = {d: c for d, _, c in linked(list(kept.items()))}
    before, kept = len(kept), {d: t for d, t in kept.items() if not shingles(t) or component[d] == d}
    assert len(kept) < before

    lined = spark.createDataFrame([(d, t, rows[d].lang, rows[d].source, len(t) if t is not None else None) for d, t in kept.items()], docs.schema)
    mixed = {r.doc_id: r.text for r in mixing.mixed_texts(lined).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in mixed.items()}
    by_doc = defaultdict(list)
    for r in pipeline.run(spark, SF).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(part.tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
    assert set(by_doc) == set(ids)
    for d, at in by_doc.items():
        at.sort()
        assert [s for s, _ in at] == np.cumsum([0, *(n for _, n in at)])[:-1].tolist() and sum(n for _, n in at) == len(ids[d])


def _templates(kept, recurring):
    """The template of each recurring line: the line's leaf and the tokens that recur there (as in _brute_lines, which gives places alone)."""
    tokens = lambda x: ["<*>" if any(c in "0123456789" for c in t) else t for t in x.translate({9: " ", 11: " ", 12: " ", 13: " "}).strip(" ").split(" ")]
    lines = {(d, i): tokens(x) for d, t in kept.items() if t is not None for i, x in enumerate(t.split("\n"))}
    lines = {k: t for k, t in lines.items() if len(t) >= 4 or ("<*>" not in t and t[0])}
    leaf = lambda t: (len(t), *t[:4])
    support: dict = defaultdict(int)
    for t in lines.values():
        for p, x in enumerate(t):
            support[leaf(t), p, x] += 1
    return {k: (leaf(lines[k]), tuple(x if x != "<*>" and support[leaf(lines[k]), p, x] >= 8 else None for p, x in enumerate(lines[k]))) for k in recurring}
