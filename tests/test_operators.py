import datetime as dt
import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.functions import text as X
from mediaframe.functions import timecode as TC
from mediaframe.operators import jobs as J
from mediaframe.operators import ordered as O
from mediaframe.operators import scenes as S
from mediaframe.operators import similarity as V
from mediaframe.plans import jobs as P
from mediaframe.plans import queries as Q
from mediaframe.sources import files as IO
from mediaframe.streaming import monitor as M
from tests.oracle import compare


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_timecode_examples(spark):
    assert one(spark, TC.timecode_to_frames(F.lit("00:00:15:01"))) == 361
    assert one(spark, TC.frames_to_timecode(F.lit(361))) == "00:00:15:01"
    assert one(spark, TC.timecode_to_frames(F.lit("00:00:10:24"))) is None
    assert one(spark, TC.timecode_to_frames(F.lit("00:00:10:24"), check=False)) == 264
    for bad in ("01:00:00;00", "aa:bb:cc:dd", "", "1:2:3", "0:0:7.5:1"):
        assert one(spark, TC.timecode_to_frames(F.lit(bad))) is None
    with pytest.raises(Exception, match="Invalid timecode"):
        one(spark, TC.timecode_to_frames(F.lit("x"), strict=True))
    assert one(spark, TC.parse_cut_time(F.lit("00:00:09.02"))) == pytest.approx(9.02)


def test_round_trips_at_whole_rates(spark):
    for fps in (24.0, 25.0, 30.0):
        d = spark.range(5000).select("id", TC.timecode_to_frames(TC.frames_to_timecode(F.col("id") * 37, fps), fps).alias("f"))
        assert d.where("f <> id * 37 or f is null").count() == 0


def events_as_in_sql(spark, path, name, rows):
    """A query over events (event_id, microseconds from the start of 2024, user_id, event_type) held against its SQL."""
    start = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([(i, start + dt.timedelta(microseconds=us), u, kind, 0.0, "{}") for i, us, u, kind in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    d.write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    return compare(spark, con, str(path), Q.QUERIES[name], Q.ORACLES[name])


def test_negative_durations_as_in_sql(spark, tmp_path):
    # at 24000/1001 a timecode can stand before that of the frame before it
    film = 24000 / 1001
    read = lambda f: int((f / film // 3600 * 3600 + f / film % 3600 // 60 * 60 + f / film % 60 // 1) * film + f % film // 1)
    back = [f for f in range(86400 * 24) if read(f + 1) < read(f)]
    rows = [(next(i for i in range(100 * 24 * 17) if i % 24 == f % 24 and i % 100 == (f % 4 or 4) and i % 17 and i % 19), f // 24 * 1_000_000, 1, "view") for f in back[:8]]
    assert len(rows) == 8 and events_as_in_sql(spark, tmp_path, "spots_convert", rows) == 8


def test_clip_bounds_are_rounded_as_in_sql(spark, tmp_path):
    # starts below 10 s, where five decimals are compared, and no end below zero
    assert events_as_in_sql(spark, tmp_path, "clip_bounds", [(f, f // 24 * 1_000_000, 1, "view") for f in range(20, 240)]) == 220


def test_clip_bounds_before_frame_0_as_in_sql(spark, tmp_path):
    # in the first second of a day ends can be negative, before 2024 starts are too
    rows = [(i, us, 1, "view") for i, us in enumerate([us for us in (0, 86400_000_000, -1, -1_000_000, -3_661_000_000) for _ in range(24)])]
    assert events_as_in_sql(spark, tmp_path, "clip_bounds", rows) == 120


def test_segments_are_rounded_as_in_sql(spark, tmp_path):
    half = [(a, b) for a in range(100_000_500, 100_900_000, 1_000) for b in [a + 98_837_829_500] if round(b / 1e6 - a / 1e6, 3) != round((b / 1e6 - a / 1e6) * 1000) / 1000][:20]
    assert half
    events_as_in_sql(spark, tmp_path, "segments_roundtrip", [(n, us, n // 2, "error") for n, us in enumerate([t for ab in half for t in ab] + [1_000_500, 2_000_500, 3_000_500, 1_005_500, 59_999_500, 59_999_501])])


def test_spotting_rows(spark):
    rows = [("Vub", "00:00:15:01", "00:00:17:07", "00:00:02:06"), ("Edge Case", "00:00:19:07", "00:00:21:04", "00:00:01:21"), ("Vub Critical", "00:00:28:13", "00:00:31:23", "00:00:03:10"), ("Vub", "00:00:15:01", "00:00:17:07", ""), ("Vub", "", "00:00:17:07", ""), ("Vub", "aa:bb:cc:dd", "00:00:17:07", "")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_ord long, name string, s string, e string, dur string")
    got = {r._ord: r for r in P.plan_shots(d, "SHOW001", "s", "e", "name", "name").collect()}
    assert got[0].clip == "SHOW001_0001_VUB_00-00-15-01_00-00-17-07.mov"
    assert [got[i].status for i in (0, 1, 2, 3, 5)] == ["planned", "planned", "planned", "duplicate", "invalid"] and 4 not in got
    assert [(got[i].code, got[i].start_frame, got[i].frames, got[i]["index"]) for i in (0, 1, 2)] == [("VUB", 361, 54, 1), ("EDGE", 463, 45, 2), ("CRIT", 685, 82, 3)]
    for r in d.where("_ord < 3").withColumn("d2", TC.recompute_duration(F.col("s"), F.col("e"), 24.0)).collect():
        assert r.d2 == r.dur


def test_small_functions(spark):
    assert one(spark, X.slugify(F.lit(" My clip (1)"))) == "My_clip_-1-"
    assert [one(spark, X.backoff_seconds(F.lit(n))) for n in (0, 3, 9)] == [1, 8, 30]
    assert one(spark, X.backoff_seconds(F.lit(3), F.lit("7"), http=F.lit(429))) == 7 and one(spark, X.backoff_seconds(F.lit(6), kind="rounds")) == 16
    assert one(spark, X.stem(F.lit("/a/b.c.mov"))) == "b.c" and one(spark, X.extension(F.lit("/a.b/c"))) == ""
    assert one(spark, X.parse_object_uri(F.lit("s3://b"))["error"]) == "Invalid S3 URI format"
    d = spark.createDataFrame([("v10",), ("v2",), ("V1",), ("v02b",)], "n string")
    assert [r.n for r in O.natural_sort(d, "n").collect()] == ["V1", "v2", "v02b", "v10"]
    assert one(spark, X.numbered_name("out_", F.lit(123), "mov")) == "out_123.mov"


def _min_gap(times, gap):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


@pytest.mark.parametrize("gap,span", [(0.33, 2), (0.3, 3), (5.0, 2), (0.33, 1024)])
def test_min_gap(spark, gap, span):
    """Random, dense, single and regular cuts (whose spans all end differently), null keys and times; spans of a few gaps need several rounds."""
    r = np.random.default_rng(3)
    keys = {"a": [2.0, 1.2, 1.4, 1.0, 1.0], "b": r.uniform(-20, 60, 3000).tolist(), "c": [0.1 * i for i in range(400)], "d": [0.11 * i for i in range(400)], "e": [-7.5], None: [1.0, 1.2, 1.5]}
    rows = [(k, t) for k, ts in keys.items() for t in ts] + [("a", None), ("f", None), ("a", float("nan"))]
    got = {}
    for x in S.coalesce_min_gap(spark.createDataFrame(rows, "k string, t double").repartition(5), "k", gap=gap, span_gaps=span).collect():
        got.setdefault(x.k, []).append(x.t)
    assert {k: sorted(v) for k, v in got.items()} == {k: _min_gap(v, gap) for k, v in keys.items()}
    assert S.coalesce_min_gap(spark.createDataFrame(rows, "k string, t double").limit(0), "k", gap=gap).count() == 0


def test_min_gap_of_one_long_key(spark):
    d = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.rand(5) * 200_000).alias("t")).repartition(8)
    d.write.mode("overwrite").parquet(at := O.new_folder(spark, "cuts"))
    d = spark.read.parquet(at)
    got = S.coalesce_min_gap(d, "k", span_gaps=4096).toPandas()
    want = _min_gap(d.toPandas().t.tolist(), 0.33)
    assert sorted(got.t) == want
    O.remove_folder(spark, at)


def test_intervals(spark):
    r = np.random.default_rng(1)
    iv = [("a", i, float(x), float(x + w)) for i, (x, w) in enumerate(zip(r.uniform(-50, 50, 60), np.exp(r.uniform(-4, 5, 60)), strict=True))] + [("b", 0, 0.0, 1e6), ("b", 1, 5.0, 5.0), (None, 2, 0.0, 9.0)]
    pt = [("ab"[i % 2], float(x), i % 90) for i, x in enumerate(r.uniform(-60, 60, 400))] + [("a", iv[0][2], 0), ("a", iv[0][3], 0), ("c", 1.0, 0), ("a", None, 0), (None, 1.0, 0), ("b", 1e6 - 1, 7)]
    p, i = spark.createDataFrame(pt, "k string, t double, x int"), spark.createDataFrame(iv, "k string, i int, start_sec double, end_sec double")
    inside = [(a, b) for a in pt for b in iv if a[0] is not None and a[0] == b[0] and a[1] is not None and b[2] <= a[1] < b[3]]
    for width in (None, 0.01, 30.0):
        got = S.assign_to_intervals(p, i, "k", width=width)
        assert sorted((x.k, x.t, x.x, x.i) for x in got.collect()) == sorted((*a, b[1]) for a, b in inside)
        hit = {a for a, _ in inside}
        assert sorted(map(tuple, S.assign_to_intervals(p, i, "k", how="left_semi", width=width).collect())) == sorted(a for a in pt if a in hit)
        assert S.assign_to_intervals(p, i, "k", how="left_anti", width=width).count() == sum(a not in hit for a in pt)
        assert S.assign_to_intervals(p, i, "k", how="left", width=width).count() == len(inside) + sum(a not in hit for a in pt)
    listed = S.assign_to_intervals(p.where("k = 'b'"), i.where("k = 'b'"), "k", width=1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in listed and S.assign_to_intervals(p, i.limit(0), "k").count() == 0


@pytest.mark.parametrize("eps", [0.02, 0.3, 1.2])
def test_similar_pairs_by_brute_force(spark, eps):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(c, 0.05, (60, 8)) for c in r.normal(0, 1, (6, 8))] + [np.zeros((2, 8)), np.ones((3, 8))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(3)
    n = np.linalg.norm(x, axis=1)[:, None]
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    dist = np.clip(1 - u @ u.T, 0, 2)
    want = {(i, j): dist[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if dist[i, j] <= eps}
    for block in (16, 2048):
        got = {(r.a, r.b): r.dist for r in V.similar_pairs(d, "id", "v", eps, pivots=12, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    vectors, boxes = V.metric_index(d.where("v is not null"), "id", "v", pivots=12, block=16)
    k, left = boxes.count(), V.block_pairs(boxes, (2 * eps) ** 0.5).count()
    assert left <= k * (k + 1) // 2 and (eps > 0.1 or left < 0.35 * k * (k + 1) // 2)
    assert V.similar_pairs(d.limit(0), "id", "v", eps).count() == 0


def test_clusters_of_a_chain(spark):
    n = 3000
    e = spark.range(n).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(9000, 9001), (9001, 9000), (9002, 9002), (9005, 1)], "a long, b long"))
    cores = spark.range(n + 1).union(spark.createDataFrame([(9000,), (9001,), (9002,), (9003,)], "id long"))
    got = {r.id: r.root for r in V.clusters(e, cores).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 9000: 9000, 9001: 9000, 9002: 9002, 9003: 9003}


def test_segments_tile(spark):
    cuts = spark.createDataFrame([("a", t) for t in (1.0, 1.4, 2.0, 3.0, 0.0)] + [("b", 9.0)], "k string, t double")
    s = S.build_segments(cuts, spark.createDataFrame([("a", 3.0), ("b", 3.0)], "k string, duration_sec double"), "k")
    assert [(r.start_sec, r.end_sec) for r in s.where("k = 'a'").orderBy("index").collect()] == [(0.0, 1.0), (1.0, 1.4), (1.4, 2.0), (2.0, 3.0)]
    assert s.where("k = 'b'").count() == 1


def test_sequences(spark):
    d = spark.createDataFrame([("k", c) for c in "abc"], "k string, c string")
    assert "".join(r.c for r in O.bounce(d, ["k"], ["c"]).orderBy("pos").collect()) == "abccbaabc"
    n = spark.range(10).withColumn("k", F.lit(1))
    assert [r.id for r in O.sample_evenly(n, ["k"], ["id"], 3).orderBy("pick").collect()] == [0, 4, 9]
    x = spark.createDataFrame([(1, "x.mov"), (2, "x.mov"), (3, "x.mov"), (4, "x_1.mov")], "i int, n string").withColumn("g", F.lit(0))
    got = [r.unique_name for r in O.disambiguate_names(x, ["g"], "n", ["i"]).orderBy("i").collect()]
    assert got[0] == "x.mov" and got[2:] == ["x_2.mov", "x_1.mov"] and len(set(got)) == 4
    with pytest.raises(ValueError):
        O.index_range(n, "id", "k", 0, 3)


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text("http://early\nvideos\nhttp://v/1\n\nhttp://v/1\n._x\nAUDIOS\nhttp://a/1\nVIDEOS\nhttp://v/2\n")
    assert sorted((r.kind, r.pos, r.url) for r in IO.read_manifest(spark, str(p)).collect()) == [("audio", 1, "http://a/1"), ("video", 1, "http://v/1"), ("video", 2, "http://v/2")]
    j = tmp_path / "r.json"
    j.write_text(json.dumps([{"job_id": "b", "success": True}, {"success": False}, {"job_id": "a", "success": True}]))
    assert [(r.job_id, r._ord) for r in IO.read_job_ids(spark, str(j)).orderBy("_ord").collect()] == [("b", 0), ("a", 1)]


def test_groups(spark):
    v = [("a", [1.0, 0.0]), ("a", [1.0, 0.02]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", [0.1, 1.0]), ("e", [-1.0, -0.2]), ("f", [])]
    d = spark.createDataFrame(v, "clip string, vec array<double>")
    for n in (1, 7):
        got = {r.clip: r.group_id for r in V.group_by_similarity(d.repartition(n), "clip", "vec", 0.05, every=d).collect()}
        assert got == {"a": "face_001", "b": "face_001", "c": "face_002", "d": "face_002", "e": "face_003", "f": "no_face"}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([(f"d{i % 2}/f{i}.mov", float(i), "k", "RUNNING" if i < 5 else "COMPLETED") for i in range(8)], "key string, t double, k string, status string")
    rows.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    counts = M.arrivals(stream, r"\.mov$", F.substring_index("key", "/", 1))
    M.report_when_complete(counts, 8, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    got = {(r.dir, r.n) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {(r.dir, r.n) for r in M.arrivals(rows, r"\.mov$", F.substring_index("key", "/", 1)).collect()}
    q = M.latest_job_state(stream.withColumn("url", F.lit("u")), "k", "t", "status", "url").writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.state for r in spark.table("states").collect()] == ["completed"]


def test_report_against_local_directories(spark, tmp_path):
    rows = spark.createDataFrame([("a/1.mov",), ("a/2.mov",), ("c/1.mov",), ("a/x.txt",)], "key string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    local = spark.createDataFrame([("a", 3), ("b", 1)], "dir string, n long")
    count = lambda d: M.arrivals(d, r"\.mov$", F.substring_index("key", "/", 1))
    want = {("a", 3, 2, 3, True), ("b", 1, 0, 3, True)}
    row = lambda r: (r.dir, r.expected, r.actual, r.total, r.complete)
    assert {row(r) for r in M.monitor_arrivals(count(rows), local, 3).collect()} == want
    assert [row(r) for r in M.monitor_arrivals(count(rows), None, 4).collect()] == [(None, None, None, 3, False)]
    assert row(M.monitor_arrivals(count(rows.limit(0)), local, 1).where("dir = 'b'").first()) == ("b", 1, 0, 0, False)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    M.report_when_complete(count(stream), 3, str(tmp_path / "out"), str(tmp_path / "c"), local).awaitTermination(60)
    assert {row(r) for r in spark.read.json(str(tmp_path / "out")).collect()} == want
    M.report_when_complete(count(stream), 4, str(tmp_path / "none"), str(tmp_path / "c2"), local).awaitTermination(60)
    assert not (tmp_path / "none").exists()


ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_min_gap_stream(spark, tmp_path):
    """Times dealt at random over batches, a batch a file, give what the table gives; what the watermark has passed leaves the state."""
    r = np.random.default_rng(2)
    times = {k: np.round(np.sort(r.uniform(0, 40, 120)), 3).tolist() for k in "ab"}
    rows = [(k, t) for k in "ab" for t in times[k]]
    dealt = r.integers(0, 6, len(rows)).tolist()
    batches = [[x for x, b in zip(rows, dealt, strict=True) if b == k] for k in range(6)]
    src = tmp_path / "in"
    src.mkdir()
    for k, b in enumerate([*batches, [("z", 500.0)], [("z", 900.0)]]):
        (src / f"{k}.csv").write_text("\n".join(f"{key},{t!r}" for key, t in b))
        os.utime(src / f"{k}.csv", (1000 + k, 1000 + k))
    stream = spark.readStream.schema("k string, t double").option("maxFilesPerTrigger", 1).csv(str(src))
    spark.conf.set(*ROCKS)
    try:
        q = M.coalesce_min_gap_stream(stream, "k", "t", 0.33, "60 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset(ROCKS[0])
    got = {}
    for x in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(x.key, []).append(x.t)
    assert {k: sorted(got[k]) for k in "ab"} == {k: _min_gap(times[k], 0.33) for k in "ab"}


def test_arrivals_forget_keys(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(5):
        (src / f"{k}.csv").write_text("\n".join(f"d{i % 2}/{k}-{i}.mov,{1000 * k + i + 1}" for i in [*range(50), *range(20)]))
        os.utime(src / f"{k}.csv", (1000 + k, 1000 + k))
    stream = spark.readStream.schema("key string, at long").option("maxFilesPerTrigger", 1).csv(str(src)).withColumn("ts", F.timestamp_seconds("at"))
    counts = M.arrivals(stream, r"\.mov$", F.substring_index("key", "/", 1), ts="ts", delay="100 seconds")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.dir, r.n) for r in spark.table("arrived").collect()} == {("d0", 125), ("d1", 125)}
    kept = [s.numRowsTotal for p in q.recentProgress for s in p.stateOperators if s.operatorName == "dedupeWithinWatermark"]
    assert max(kept) <= 100 < 250 and kept[-1] < max(kept)


def test_report_once_over_restarts(spark, tmp_path):
    src, out, c = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    src.mkdir()
    stream = lambda: M.arrivals(spark.readStream.schema("key string").csv(str(src)), r"\.mov$", F.substring_index("key", "/", 1))
    (src / "1.csv").write_text("a/1.mov\na/2.mov\n")
    q = M.report_when_complete(stream(), 3, out, c, interval="1 second")
    assert not M.await_report(q, out, spark, 0.5, 4) and q.isActive
    q.stop()  # lost before the report
    (src / "2.csv").write_text("b/1.mov\n")
    q = M.report_when_complete(stream(), 3, out, c, interval="1 second")
    assert M.await_report(q, out, spark, 0.5, 60) and not q.isActive
    first = sorted(map(tuple, spark.read.json(out).collect()))
    (src / "3.csv").write_text("b/2.mov\n")
    q = M.report_when_complete(stream(), 3, out, c)  # started again after it
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.read.json(out).collect())) == first and [r[1:] for r in first] == [("a", 2), ("b", 1)]


def test_lines_of_split_files(spark, tmp_path):
    """Numbers, sections and positions over many splits, across stretches without a header."""
    lines = ["early", "videos", *(f"http://v/{i}" for i in range(3000)), "", "._x", "AUDIOS", *(f"http://a/{i}" for i in range(2000)), "http://a/7", "Videos", *(f"http://v/{i}" for i in range(2990, 3010))]
    (tmp_path / "m.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        d = IO._lines(spark, str(tmp_path / "m.txt"))
        assert d.rdd.getNumPartitions() > 1 and [r.line for r in d.orderBy("pos").collect()] == lines and sorted(r.pos for r in d.collect()) == list(range(len(lines)))
        got = IO.read_manifest(spark, str(tmp_path / "m.txt"))
        assert sorted((r.kind, r.pos, r.url) for r in got.collect()) == sorted([("video", i + 1, f"http://v/{i}") for i in range(3010)] + [("audio", i + 1, f"http://a/{i}") for i in range(2000)])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    t = spark.createDataFrame([("f", i, "h" if i in (3, 40) else None) for i in range(100)], "file string, pos long, h string")
    for rows in (1, 7, 1000):
        got = O.fill_section(t, ["file"], "pos", F.when(F.col("h").isNotNull(), F.col("pos")), rows=rows).orderBy("pos").collect()
        assert [r.kind for r in got] == [None] * 3 + [3] * 37 + [40] * 60


def test_manifest_in_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k, i + 1, f"http://{k}/{i}") for k, n in (("video", 500), ("audio", 300)) for i in range(n)]
        IO.write_manifest(spark.createDataFrame(rows, "kind string, pos long, url string").repartition(6), str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "m").glob("part-*"))
    assert len(parts) > 1 and sorted((r.kind, r.pos, r.url) for r in IO.read_manifest_parts(spark, str(tmp_path / "m")).collect()) == sorted(rows)
    (tmp_path / "one.txt").write_text("".join(p.read_text() for p in parts))
    assert sorted((r.kind, r.pos, r.url) for r in IO.read_manifest(spark, str(tmp_path / "one.txt")).collect()) == sorted(rows)


def test_ordinals(spark):
    d = spark.createDataFrame([(i * 7 % 50, i % 2) for i in range(50)] + [(None, 0)], "v int, g int").repartition(7)
    assert [r.n for r in O.with_ordinal(d, "n", ["v"]).orderBy("v").collect()] == list(range(51))
    assert sorted(r._ord for r in O.with_ordinal(d).collect()) == list(range(51))
    assert O.with_ordinal(d.limit(0)).count() == 0
    got = O.number_within(d, "g", ["v"]).orderBy("g", "v").collect()
    assert [r.n for r in got] == [*range(1, 27), *range(1, 26)]
    assert [r._ord for r in O.limit_by_ordinal(O.with_ordinal(d, order_by=["v"]), 2).orderBy("v").collect()] == [0, 1] and O.limit_by_ordinal(d, None).count() == 51
    t = spark.createDataFrame([(0, "00:00:02:00"), (1, "bad"), (2, "00:00:01:00"), (3, "00:00:01:30")], "_ord int, s string")
    assert [r._ord for r in O.sort_by_timecode(t, "s").collect()] == [1, 3, 2, 0]


def test_upload_and_runs(spark):
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp")
    assert one(spark, X.upload_prefix(F.lit("/a/My clips (1)/"), stamp)) == "My_clips_-1-_202405060708" and one(spark, X.upload_prefix(F.lit(""), stamp)) == "upload_202405060708"
    d = spark.createDataFrame([("h/v10.mov", "video/mp4"), ("h/v2.mov", "video/mp4"), ("h/a1.wav", "audio/wav"), ("h/n.txt", "text/plain")], "url string, mime string")
    assert sorted(tuple(r) for r in P.upload_manifest(d).collect()) == [("audio", 1, "h/a1.wav"), ("video", 1, "h/v2.mov"), ("video", 2, "h/v10.mov")]
    chain = spark.createDataFrame([("f", f"{(i + 1):02d}.mov" if i < 20 else "z.mov", 100 - i if i < 20 else 0) for i in range(21)], "d string, name string, c int")
    plan = {r.name: (r.target, r.status) for r in P.plan_rename(chain, ["d"], "name", "c").collect()}
    assert plan["z.mov"] == ("01.mov", "conflict") and len(plan) == 21 and plan["20.mov"][0] == "02.mov"


def test_long_rename_chain(spark):
    rows = [(f"{i:02d}.mov", i) for i in range(2, 40)]
    plan = {r.name: (r.target, r.status) for r in P.plan_rename(spark.createDataFrame(rows, "name string, c int").withColumn("d", F.lit("f")), ["d"], "name", "c").collect()}
    assert plan == {f"{i:02d}.mov": (f"{i - 1:02d}.mov", "rename") for i in range(2, 40)}


def test_grouped_output(spark, tmp_path):
    d = spark.createDataFrame([("g1", "b"), ("g1", 'a"'), ("g2", "c"), ("g2", None), (None, "d")] + [("g3", f"m{i:04d}") for i in range(2500)], "group_id string, clip string")
    want = {"g1": ['a"', "b"], "g2": ["c"], "g3": [f"m{i:04d}" for i in range(2500)]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        IO.write_groups(d, str(tmp_path / "g"), long_form=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "g").glob("part-*"))
    assert len(parts) > 1 and json.loads("".join(p.read_text() for p in parts)) == want
    IO.write_groups(d.where("group_id is not null and clip is not null"), str(tmp_path / "l"), most=100)
    rows = spark.read.json(str(tmp_path / "l")).orderBy("group_id", "chunk").collect()
    assert max(len(r.members) for r in rows) == 100 and {g: [m for r in rows if r.group_id == g for m in r.members] for g in want} == want
    IO.write_groups(d.limit(0), str(tmp_path / "e"), long_form=False)
    assert spark.read.text(str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("max_dist", [0.1, 0.5, 1.5])
def test_nearest_centroid_by_parents(spark, monkeypatch, max_dist):
    r = np.random.default_rng(8)
    c = np.concatenate([r.normal(0, 1, (200, 6)), np.zeros((1, 6))])
    c = np.concatenate([c, c[:40]])  # ties
    x = np.concatenate([c[r.integers(0, 200, 300)] + r.normal(0, 0.2, (300, 6)), r.normal(0, 1, (100, 6)), np.zeros((2, 6))])
    p = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>").repartition(3)
    g = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "group long, v array<double>").repartition(2)
    row = lambda df: {(r.id, r.group, round(r.dist, 9)) for r in df.collect()}
    want = row(V.nearest_centroid(p, g, "id", "v", max_dist))
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1)[:, None], 1e-300)
    dist = 1 - unit(x) @ unit(c).T
    assert len(want) == (dist.min(1) < max_dist).sum() and all(abs(dist[int(i[1:]), k] - d) < 1e-8 and abs(dist[int(i[1:])].min() - d) < 1e-8 for i, k, d in want)
    monkeypatch.setattr(V, "MAX_BROADCAST_GROUPS", 50)
    monkeypatch.setattr(V, "GROUP_POINTS", 20)
    assert row(V.nearest_centroid(p, g, "id", "v", max_dist)) == want


def test_rename_of_one_large_folder(spark):
    n = 20_000
    d = spark.range(n).select(F.lit("f").alias("d"), F.concat(F.lit("x"), F.lit(n) - F.col("id"), F.lit(".mov")).alias("name"), F.col("id").alias("c")).repartition(6)
    plan = P.plan_rename(d, ["d"], "name", "c")
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()
    got = plan.agg(F.count_distinct("target").alias("k"), F.count_if((F.col("status") == "rename") & (F.col("n") == F.col("c") + 1)).alias("m")).first()
    assert (got.k, got.m) == (n, n)


def test_group_sizes_sorted_distinct_and_attempts(spark):
    d = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("c", 3), ("c", 4), (None, 5), ("no_face", 6), (None, 7)], "g string, k int")
    assert [tuple(r) for r in O.group_sizes(d, "g").collect()] == [("a", 2, True), ("c", 2, True), ("b", 1, True), ("no_face", 3, False)]
    assert [r.g for r in O.sorted_distinct(d.where("g is not null"), "g").collect()] == ["a", "b", "c", "no_face"]
    assert J.max_attempts(d, "g", F.col("k") > 2).first().max_attempts == 2
    assert O.group_sizes(d.limit(0), "g").count() == 0


def test_patterns(spark):
    names = ["/x/clip1.mov", "/x/clip.mov", "/clip1/a.mov", "/x/clip1.MOV", "/x/cl+p1.mov", None]
    d = spark.createDataFrame([(n,) for n in names], "p string")
    got = lambda **how: [r.p for r in d.where(X.match_pattern("p", **how)).collect()]
    assert got(glob="clip?.mov") == names[:1]
    assert got(glob="cl+*.m?v") == names[4:5]
    assert got(regex="clip1") == [names[0], names[2], names[3]]
    assert got(regex="clip1", glob="*.mov") == [names[0], names[2]]
    assert got() == names[:5] + [None]


def test_forest_of_similar_pairs(spark):
    """Copies of one vector make a pair each with all others; a forest of two blocks has fewer rows than vectors, and the same components."""
    rng = np.random.default_rng(3)
    x = np.concatenate((np.repeat(rng.normal(size=(1, 8)), 300, 0), rng.normal(size=(200, 8))))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    every = [(r.a, r.b) for r in V.similar_pairs(d, "id", "v", 0.1).collect()]
    forest = [(r.a, r.b) for r in V.similar_pairs(d, "id", "v", 0.1, pivots=1, spanning=True).collect()]
    assert len(every) >= 300 * 299 // 2 and len(forest) < len(x) and set(forest) <= set(every)
    assert {k for p in every for k in p} == {k for p in forest for k in p}
    near = spark.createDataFrame(forest, "a long, b long"), spark.createDataFrame(every, "a long, b long")
    cores = spark.createDataFrame([(k,) for k in sorted({k for p in every for k in p})], "id long")
    got, want = ({(r.id, r.root) for r in V.clusters(p, cores).collect()} for p in near)
    assert got == want


def test_large_job_tables_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "TASK_ROWS", 100, raising=False)
    d = spark.range(1000).selectExpr("id + 1 as o", "id div 2 as k", "'s3://b/v' as video", "'https://x/a' as audio", "'no' as asd")
    plan = P.plan_jobs(d, "video", "audio", "asd", "o", ["k"])
    out = P.run_jobs(plan, "video", "audio", spark.range(1, 1001, 2).selectExpr("id as csv_row", "'j' as job_id", "cast(null as string) as error"), "m")
    assert plan.rdd.getNumPartitions() == 10 and [r.csv_row for r in plan.orderBy("o").limit(4).collect()] == [1, 1, 3, 3]
    assert out.where("success and job_id = 'j'").count() == 1000
