import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mediaframe.llm import token_ids as K
from mediaframe.llm.queries import op11_token_ids

BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 59, 60, 61, 4095, 4096, 4097, 20_000])
@pytest.mark.parametrize("top", [1, 2, 30, 50_257, 1 << 30, (1 << 32) - 1])
def test_ids_round_trip(n, top):
    r = np.random.default_rng(n + top)
    ids = np.minimum(r.integers(0, top, n, endpoint=True), r.geometric(0.01, n) << r.integers(0, 32, n)).astype(np.uint32)
    page = K.encode(ids)
    assert (K.decode(page) == ids).all() and len(K.decode(page)) == n
    for a, b in ((0, 1), (4095, 4097), (4096, 4097), (n - 1, n + 5), (5, 5)):
        assert K.decode(page, max(a, 0), b).tolist() == ids[max(a, 0) : b].tolist()


def test_escapes_and_every_selector_are_used():
    r = np.random.default_rng(0)
    ids = np.concatenate([r.integers(0, 1 << b, 4096) for b in range(1, 32)] + [np.where(np.arange(8192) % 50, 3, 70_000)]).astype(np.uint32)
    page = K.encode(ids)
    blocks, words, escapes = np.frombuffer(page, "<u8", 4)[1:].tolist()
    assert set((np.frombuffer(page, "<u8", words, 32 + 16 * blocks) >> np.uint64(60)).tolist()) >= set(range(2, 14)) and escapes > 100
    assert (K.decode(page) == ids).all() and len(page) < 4 * len(ids)


def test_cut_text_encodes_as_a_whole_one():
    r = np.random.default_rng(4)
    pools = [[chr(c) for c in range(32, 127)], [chr(c) for c in range(0xA0, 0x250)], list("漢字かなカ한글عربي"), list("😀👍🏽‍­﻿"), [chr(c) for c in (0, 9, 10, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0x180E, 0x2003, 0x2028, 0x3000)],
             ["<|endoftext|>", "'s", "'LL", " |A"], list("abcXYZ"), [" ", "\n", "  ", "\n\n", " \n", "\n ", ".\n", ". "]]
    texts = ["".join(pools[k][r.integers(len(pools[k]))] for k in r.integers(0, len(pools), r.integers(1, 16))) for _ in range(20_000)] + ["", " " * 900, "a b " * 3000, "w" * 5000]
    t = K.ByteTokenizer(BPE)
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    bad = [(x, w) for x, g, w in zip(texts, t.encode(texts), want, strict=True) if np.frombuffer(g, "<u4").tolist() != w]
    assert not bad, bad[:3]


def _expected(rows):
    t, out, at = Tokenizer.from_file(BPE), [], 0
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op11_token_ids(spark, SF).collect())
    assert got == _expected(docs)


def test_files_of_odd_rows(spark, tmp_path):
    rows = [(5, "x y", "a"), (None, None, "b"), (None, "n", "c"), (2, "", "d"), (5, "x y", "e"), (7, "long " * 200_000, "f"), (-3, "é\x1c\n\nb", "g")]
    d = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    K.write_token_ids(d, BPE, str(tmp_path / "t"))
    got = K.read_token_ids(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -3, 2, 5, 5, 7] and len(got) == len(rows)
    texts = {(r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got}
    assert texts == {(i, n, c) for i, _, n, c in _expected([(i, t) for i, t, _ in rows])}
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    for a, b in ((0, 10), (3, 4), (100, 150_000), (len(every) - 2, len(every) + 9)):
        parts = [r.ids for r in K.read_positions(spark, str(tmp_path / "t"), a, b).orderBy("start").collect()]
        assert np.concatenate([np.frombuffer(x, "<u4") for x in parts]).tolist() == every[a:b].tolist()


def test_hot_id_is_spread_and_empty_table(spark, tmp_path):
    d = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('w', id % 7) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        K.write_token_ids(d, BPE, str(tmp_path / "h"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "h")).select("part").distinct().count() > 1
    got = K.read_token_ids(spark, str(tmp_path / "h"))
    assert got.count() == 4000 and got.select("start").distinct().count() == 4000
    K.write_token_ids(d.limit(0), BPE, str(tmp_path / "e"))
    assert K.read_token_ids(spark, str(tmp_path / "e")).count() == 0
