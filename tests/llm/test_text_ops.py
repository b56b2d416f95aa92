import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mediaframe.llm import line_dedup, mixing, packing, quality, token_count

BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COLS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", None, "a", "x y\tz", "Don't STOP, it's 12.5%!", "é́ Σας\x1cb  c", "<|endoftext|>b", "|", "w" * 5000, "ab " * 3000, "İstanbul ß.", "a.,b"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i if i else None, t, None, None if i % 3 else f"s{i % 2}", None) for i, t in enumerate(ODD)] + [(3, "a", "en", "s1", 1)] * 2, COLS)


def test_token_ids_equal_direct_encoding():
    t = packing.WordTokenizer(BPE)
    texts = [x or "" for x in ODD]
    want = [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in t.encode(texts)] == want


def test_token_ids_of_all_kinds_of_characters():
    """Words of characters of every class, before stops and commas too, cut by white space of all kinds."""
    r = np.random.default_rng(12)
    pools = [[chr(c) for c in range(32, 127)], [chr(c) for c in range(0xA0, 0x250)], list("İıßΣςσΑάǅﬁ½²ªº"), [chr(c) for c in (0x300, 0x301, 0x307, 0x328, 0x1E9B, 0x323)], list("漢字かなカナ한글एकعربي"), list("😀👍🏽\u200d\u00ad\ufeff"),
             [chr(c) for c in (0, 9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x2003, 0x2028, 0x3000)], list(".,'|<>-"), ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "|A", "|a"], list("abcXYZ")]
    texts = ["".join(pools[k][r.integers(len(pools[k]))] for k in r.integers(0, len(pools), r.integers(1, 14))) + str(r.choice(["", ".", ",", " x"])) for _ in range(20_000)]
    t = packing.WordTokenizer(BPE)
    want = [e.ids for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
    bad = [(x, w) for x, g, w in zip(texts, t.encode(texts), want, strict=True) if np.frombuffer(g, "<u4").tolist() != w]
    assert not bad, bad[:3]


def test_packing_query_checks_every_piece(spark):
    from mediaframe.llm.queries import op6_packing

    sf = "/root/testdata/sf0.001"
    rows, by_seq, by_doc = _checked(op6_packing(spark, sf).collect(), 2048)
    t = packing.WordTokenizer(BPE).tokenizer
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(by_doc) == set(docs)
    ids = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for d, x in docs.items()}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for d, ps in by_doc.items():
        ps.sort()
        assert [s for s, *_ in ps] == np.cumsum([0, *(n for _, n, _ in ps)])[:-1].tolist() and sum(n for _, n, _ in ps) == len(ids[d])


def _packed(df, size, open_windows=4):
    return _checked(packing.pack(df, BPE, size=size, open_windows=open_windows).collect(), size)


def _checked(rows, size):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for ps in by_seq.values():
        at = 0
        for o, n in sorted(ps):
            assert o == at and n > 0
            at += n
        assert at <= size
    return rows, by_seq, by_doc


def test_packing_keeps_every_id_once(spark):
    df = spark.createDataFrame([(i, "word, more " * (i % 90)) for i in range(300)] + [(1000, None), (1001, "")], "doc_id long, text string").coalesce(1)
    rows, by_seq, by_doc = _packed(df, 128)
    assert len(by_doc) == 302
    for d, ps in by_doc.items():
        at = 0
        for s, n, total in sorted(ps):
            assert s == at
            at += n
        assert at == total
    assert sum(sum(n for _, n in ps) < 128 for ps in by_seq.values()) <= 1
    t = packing.WordTokenizer(BPE)
    ids = np.frombuffer(next(t.encode(["word, more " * 89])) + np.array([1], "<u4").tobytes(), "<u4")
    for r in rows:
        if r.doc_id == 89:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_packing_of_odd_rows(odd, spark):
    assert _packed(odd, 2048)[0]
    assert packing.pack(odd.limit(0), BPE).count() == 0


def test_sum_of_squares_choice_is_the_least():
    b, r = packing.SumOfSquares(32, 10_000), np.random.default_rng(1)
    for n in r.integers(1, 32, 400).tolist():
        before = b.counts.copy()
        b.place((0, 0, b"\0" * 4 * n, n), n)

        def cost(c):
            return int((c[1:32] ** 2).sum())

        options = []
        for h in range(32 - n + 1):
            if h == 0 or before[h]:
                c = before.copy()
                c[h] -= h > 0
                c[h + n] += h + n < 32
                options.append(cost(c))
        assert cost(b.counts) == min(options)


def test_counts_equal_greedy_longest_match():
    pieces = token_count.read_ranks(RANKS)
    a, known = token_count.LongestMatch(pieces), set(pieces)
    longest = max(map(len, known))

    def greedy(w):
        n = i = 0
        while i < len(w):
            i = next(j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in known)
            n += 1
        return n

    r = np.random.default_rng(0)
    words = [b" " + bytes(r.choice(list(b"abcdefghilmnorstue"), r.integers(1, 25)).tolist()) for _ in range(3000)] + [b" " + "Straße".encode(), b" " + bytes(range(128, 256)), b" internationalization"]
    assert [a.count(w) for w in words] == [greedy(w) for w in words]


def test_token_count_of_odd_rows(odd):
    rows = token_count.count_tokens(odd, RANKS).collect()
    assert len(rows) == len(ODD) + 2
    assert Counter(r.n_tokens for r in rows if r.n_words == 0) == {0: 3}
    assert token_count.count_tokens(odd.limit(0), RANKS).count() == 0


def test_mix(odd, spark):
    m = mixing.mix(odd).collect()
    assert len(m) == len(ODD) + 2 and all(0 <= r.taken <= 3 * r.size for r in m)
    t = {r.source: (r.target, r.source_size) for r in m}
    assert sum(x for x, _ in t.values()) == pytest.approx(sum(x for _, x in t.values())) and all(x <= 3 * y + 1e-6 for x, y in t.values())
    assert mixing.mix(odd.limit(0)).count() == 0
    again = mixing.mix(odd.repartition(5)).collect()
    assert sorted(map(str, m)) == sorted(map(str, again))


def _clashing(spark):
    texts = [" ".join(f"w{k * i % 97}" for k in range(20 + 7 * i)) for i in range(9)]
    rows = [(i % 3 if i % 4 else None, t, f"s{i % 2}", 5, "x") for i, t in enumerate(texts) for _ in range(1 + i % 3)] + [(1, None, None, None, None), (1, "", "s1", 0, None)] * 2
    return spark.createDataFrame(rows * 2, "doc_id long, text string, source string, size long, taken string").withColumns({c: F.lit(i) for i, c in enumerate(("turn", "_id", "passes", "extra", "blocks", "line_start", "key", "rank"))})


def test_mix_of_repeated_and_null_ids_in_any_order(spark):
    """The same rows in several orders and partitions give the same mix, and as many words come out as are taken."""
    df = _clashing(spark)
    show = lambda x, cols: sorted(map(str, x.select(*cols).collect()))
    first = mixing.mix(df)
    want, texts = show(first, ["doc_id", "size", "target", "taken"]), None
    taken = first.agg(F.sum("taken"), F.sum(F.when(F.col("taken") > 0, 1))).first()
    assert first.count() == df.count() and first.where("taken > 3 * size").count() == 0
    for k in range(3):
        again = df.repartition(k + 2).orderBy(F.rand(k))
        assert show(mixing.mix(again), ["doc_id", "size", "target", "taken"]) == want
        out = mixing.mixed_texts(again)
        assert out.columns == df.columns
        assert out.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))), F.count(F.lit(1))).first()[:] == taken[:]
        texts = texts or show(out, df.columns)
        assert show(out, df.columns) == texts


@pytest.mark.parametrize("group", [1, 2, 4096])
def test_sources_come_near_their_targets(spark, group):
    rows = [(i, " ".join(["w"] * (5 + i % 40)), f"s{0 if i % 3 else i % 7}") for i in range(400)] + [(1000, "a b c d e f g h i j", "tiny"), (1001, "w " * 70, "small")]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_docs=64, group=group)
    for r in m.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.countDistinct("shard").alias("n")).collect():
        assert abs(r.target - r.taken) <= 64 * (r.n + 1), r
    assert m.where("doc_id = 1001").first().taken == 3 * 70


@pytest.mark.parametrize("sizes", [[10], [10, 1, 1], [1, 100, 100, 2], [5, 5, 5, 1000], [0, 3, 0, 9]])
def test_targets_share_all_sizes(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}" if i else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = mixing.with_targets(rows).orderBy("rank").collect()
    assert got[-1].source is None
    left, open_, want, w = float(sum(sizes)), set(range(len(sizes))), {}, [[5, 2, 1][r.rank % 3] for r in got]
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if w[i] * left / total > 3 * got[i].source_size]
        for i in over:
            want[i] = 3.0 * got[i].source_size
        if not over:
            want |= {i: w[i] * left / total for i in open_}
            break
        left -= sum(want[i] for i in over)
        open_ -= set(over)
    assert [r.target for r in got] == pytest.approx([want[i] for i in range(len(sizes))])


def test_apportion_equals_one_seat_at_a_time(spark):
    r = np.random.default_rng(3)
    shares = r.integers(0, 500, 12).tolist()
    rows = spark.createDataFrame(list(enumerate(shares)), "i long, s long")
    got = {x.i: x.quota for x in mixing.apportion(rows, [], F.col("s"), F.lit(97), ["i"]).collect()}
    want = [0] * 12
    for _ in range(97):
        want[max(range(12), key=lambda i: (shares[i] / (2 * want[i] + 1), -i))] += 1
    assert [got[i] for i in range(12)] == want


def test_mixed_texts_hold_what_is_taken(odd):
    m = {(r.doc_id, r.size): r.taken for r in mixing.mix(odd).collect()}
    out = mixing.mixed_texts(odd).select("doc_id", F.regexp_count("text", F.lit(mixing.WORD)).alias("n")).collect()
    assert sorted(r.n for r in out) == sorted([*(t for (d, _), t in m.items() if t and d != 3), *[m[3, 1]] * 3 * bool(m[3, 1])])


def _brute_lines(docs, min_docs=3, depth=2, min_tokens=3, min_constant=0.5):
    def tokens(x):
        return ["<*>" if any(c in "0123456789" for c in t) else t for t in x.translate({9: " ", 11: " ", 12: " ", 13: " "}).strip(" ").split(" ")]

    lines = {(d, i): tokens(x) for d, t in docs if t is not None for i, x in enumerate(t.split("\n"))}
    lines = {k: t for k, t in lines.items() if len(t) >= min_tokens or ("<*>" not in t and t[0])}
    leaf = lambda t: (len(t), *t[:depth])
    n = Counter(leaf(t) for t in lines.values())
    support = Counter((leaf(t), p, x) for t in lines.values() if n[leaf(t)] >= min_docs for p, x in enumerate(t))
    tpl = {k: (leaf(t), tuple(x if x != "<*>" and support[leaf(t), p, x] >= min_docs else None for p, x in enumerate(t))) for k, t in lines.items()}
    tpl = {k: v for k, v in tpl.items() if sum(x is not None for x in v[1]) >= (len(v[1]) if len(v[1]) < min_tokens else max(1, min_constant * len(v[1])))}
    often = Counter(v for v, _ in {(v, k[0]) for k, v in tpl.items()})
    return {k for k, v in tpl.items() if often[v] >= min_docs}


def test_recurring_lines_equal_brute_force(spark):
    r = np.random.default_rng(5)
    word = lambda: "abcdef"[r.integers(6)]
    docs = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(r.integers(1, 6))) for _ in range(4)] + [f"Page {i} of {i * 7}", f"\tRead more about x{i} and {word()}{word()}{word()} now"]
        docs.append((i, "\n".join(r.permutation(lines).tolist())))
    docs += [(100, ""), (101, "\n\n"), (102, None)]
    df = spark.createDataFrame([(*d, "x", 7) for d in docs], "doc_id long, text string, line string, n_chars long")
    drop = _brute_lines(docs)
    size = {(d, i): len(x.split()) for d, t in docs if t for i, x in enumerate(t.split("\n"))}
    assert {size[k] for k in drop} >= {1, 2, 3} and len(drop) < 360
    got = {x.doc_id: x for x in line_dedup.drop_recurring_lines(df, min_docs=3, depth=2, min_tokens=3, min_constant=0.5).collect()}
    for d, t in docs:
        want = t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in drop)
        assert got[d].text == want and got[d]._ld_dropped == sum(k[0] == d for k in drop) and got[d].line == "x"


def test_line_dedup_of_odd_rows(odd):
    out = line_dedup.drop_recurring_lines(odd)
    assert out.count() == len(ODD) + 2 and out.where("text is null").count() == 1
    assert line_dedup.drop_recurring_lines(odd.limit(0)).count() == 0


def test_copies_are_left_alone(spark):
    df = spark.createDataFrame([(i, "one two three four five\nsix seven eight nine ten") for i in range(20)], "doc_id long, text string")
    assert line_dedup.drop_recurring_lines(df, most=0.5).where("_ld_dropped > 0").count() == 0
    assert line_dedup.drop_recurring_lines(df).where("text = ''").count() == 20


def test_short_recurring_lines(spark):
    own = [" ".join(chr(97 + i) * k for k in range(1, 9)) for i in range(10)]
    df = spark.createDataFrame([(i, f"All rights reserved.\n\nPage {i}\nMore\n{x}\nShare {x[0]}{x[0]}") for i, x in enumerate(own)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(df, short=True).collect()}
    assert got == {i: f"\nPage {i}\n{x}\nShare {x[0]}{x[0]}" for i, x in enumerate(own)}


def test_quality_ranks_held_out_rows(spark):
    d, sf = "/root/testdata/sf0.01", None
    from mediaframe.llm.queries import op9_quality

    got = {r.doc_id: r for r in op9_quality(spark, d).collect()}
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in labels) / len(labels) > 0.9


def test_quality_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    s = quality.scored(odd, quality.fit(odd, labels)).collect()
    assert len(s) == len(ODD) + 2 and all(0 <= r._qc_score <= 1 for r in s)
    none = quality.scored(odd, quality.fit(odd, labels.limit(0)))
    assert {r._qc_score for r in none.collect()} == {0.5}
    assert quality.scored(odd.limit(0), quality.fit(odd.limit(0), labels)).count() == 0


def test_quality_of_repeated_ids_and_clashing_columns(spark):
    """Several labels or texts of an id, and extra columns named like ours, give the same scores in any order of the rows."""
    texts = ["Plain words stand in this line, and they read well enough.", "%% $$ || buy now 999 !!! click", "", "x"]
    rows = [(i % 40, texts[i % 2] + " " + "abcdefg"[i % 7] * (i % 5), 1.0, 7, "z") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _score double, quality int, _id string")
    labels = spark.createDataFrame([(i, q) for i in range(40) for q in {i % 2, i % 3 % 2}], "doc_id long, quality int")
    runs = [sorted((r.doc_id, r.text, round(r._qc_score, 9)) for r in quality.scored(d, quality.fit(d, lab)).collect()) for d, lab in ((df, labels), (df.orderBy(F.desc("text")).repartition(3), labels.orderBy(F.rand(1))))]
    assert runs[0] == runs[1] and len(runs[0]) == 160
    assert quality.scored(df, quality.fit(df, labels)).columns == [*df.columns, "_qc_score"]
