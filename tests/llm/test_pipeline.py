import pytest
from pyspark.sql import functions as F

from mediaframe.llm import mixing
from mediaframe.llm._spark import row_hash

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_the_fixture(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, kinds = docs.count(), docs.dtypes
    counts = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.dtypes == kinds, name
            counts.append(docs.count())
    assert first > counts[0] == counts[1] > counts[2] >= counts[3] > 0
    by = {r.sequence_id: r.n for r in docs.groupBy("sequence_id").sum("length").toDF("sequence_id", "n").collect()}
    assert max(by.values()) == 2048


def test_empty_and_null_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(0).union(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f g", None, None, None)], docs.schema))
    for rows in (odd, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            rows = stage(spark, rows, sf)
            rows.collect()


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")


OWN = [" ".join(chr(97 + i) * k for k in range(1, 9)) for i in range(20)]


def test_short_lines_do_not_recur_after_line_dedup(spark):
    out = pipeline.drop_lines(spark, _docs(spark, [(i, f"All rights reserved.\n{x}") for i, x in enumerate(OWN)]), None)
    assert out.where("text like '%rights%'").count() <= 1 and out.count() == 20


def test_documents_of_boilerplate_lose_it_too(spark):
    lines = "Sign up for our weekly letter and never miss a story\nAll of the content here belongs to its owners"
    copies = [(100 + i, "This whole document stands here several times over\nand each of its lines does too") for i in range(9)]
    docs = _docs(spark, [(i, f"{lines}\n{x}") for i, x in enumerate(OWN)] + copies)
    got = {r.doc_id: r.text for r in pipeline.drop_lines(spark, docs, None).collect()}
    assert got == {i: x if i else f"{lines}\n{x}" for i, x in enumerate(OWN)} | {d: t if d == 100 else "" for d, t in copies}


def test_rows_are_told_apart_where_ids_repeat_or_are_null(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    docs = _docs(spark, [(1, a), (1, a), (2, a), (2, b), (3, c), (None, c), (None, c), (None, d), (None, d), (7, ""), (7, "")])
    got = pipeline.drop_near_copies(spark, docs, None).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, a), (2, b), (3, c), (None, d), (7, ""), (7, "")], key=str)


def test_mix_takes_repeated_and_null_ids_row_by_row(spark):
    texts = [" ".join(f"{x}{k}" for k in range(100)) for x in OWN[:3]]
    docs = _docs(spark, [(1, texts[0])] * 4 + [(1, texts[1])] * 2 + [(None, x) for x in texts])
    taken = mixing.mix(docs.withColumn("_row", row_hash(docs)), row="_row").agg(F.sum("taken"), F.count_if(F.col("taken") > 0)).first()
    out = pipeline.mix_sources(spark, docs, None)
    assert tuple(out.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))), F.count(F.lit(1))).first()) == tuple(taken)
    assert out.count() <= 9
