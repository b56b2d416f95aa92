import hashlib

import pytest
from pyspark.sql import functions as F

from mediaframe.llm import fill_in_middle as M

ODD = [None, "", "a", "ab", "<P>x", "x<", "<S", "S>M>", "é漢😀" * 40, "<" * 100, "<P" * 60, "word " * 5000, "\x00\n ", "<M>", "P><S", "same", "same"]


def expected(doc_id, text):
    text, n = text or "", len(text or "")
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return [(None if i % 9 == 0 else i * 31, t, "x", i) for i, t in enumerate(ODD * 12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, form string, pos int").repartition(5)


@pytest.mark.parametrize("unit", [1, 3, 8192])
def test_outputs_and_restored_texts(spark, docs, rows, unit):
    units = M.pieces(docs, unit=unit) if unit > 1 else M.pieces(docs.where(F.coalesce(F.length("text"), F.lit(0)) < 200), unit=unit)
    rows = [r for r in rows if unit > 1 or len(r[1] or "") < 200]
    want = sorted(((i, *expected(i, t)) for i, t, *_ in rows), key=str)
    got = M.outputs(units).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == want
    got = M.digests(units).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.output_sha256) for r in got), key=str) == sorted(((w[0], w[1], w[2], sha(w[-1])) for w in want), key=str)
    assert sorted((r.restored_sha256 for r in got)) == sorted(sha(t or "") for _, t, *_ in rows)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_restored_text_comes_from_the_output():
    for size in (1, 2, 3, 50):
        for form, out in (("psm", "<P>a<<S>c<M<M>b>"), ("spm", "<S>c<M<P>a<<M>b>"), ("psm", "<P><S><M>"), ("plain", "<P>")):
            r, parts = M.Reader(form), [b"", b"", b""]
            for k in range(0, len(out), size):
                for place, run in r.read(out[k : k + size].encode()):
                    parts[place] += run
            list(r.rest())
            assert b"".join(parts).decode() == ("<P>" if form == "plain" else "" if len(out) == 9 else "a<b>c<M")
    with pytest.raises(ValueError):
        list(M.Reader("psm").rest())


def test_empty_table(docs):
    assert M.digests(M.pieces(docs.limit(0))).count() == 0 and M.outputs(M.pieces(docs.limit(0))).count() == 0
