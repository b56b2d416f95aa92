"""The registered queries over the given tables, each with its DuckDB form in ORACLES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.functions import text as X
from mediaframe.functions import timecode as TC
from mediaframe.operators import jobs as J
from mediaframe.operators import ordered as O
from mediaframe.operators import scenes as S
from mediaframe.operators import similarity as V
from mediaframe.plans import jobs as P
from mediaframe.sources import files as IO
from mediaframe.streaming import monitor as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _place(spark: SparkSession) -> str:
    return O.new_folder(spark, "round-trip")


def _events(spark: SparkSession, d: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", "value", us.alias("us"))


E = "e AS (SELECT event_id, user_id, event_type, value, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS us FROM events)"
#: A frame number below a day at 24 a second, and its timecode.
_FRAME = "(us // 1000000) % 86400 * 24 + event_id % 24"


def _frame() -> F.Column:
    return F.expr("(us div 1000000) % 86400 * 24 + event_id % 24")


def _tc_sql(f: str, fps: str = "24") -> str:
    s = f"(({f}) / ({fps}))"
    return f"printf('%02d:%02d:%02d:%02d', CAST(floor({s} / 3600) AS BIGINT), CAST(floor(({s} % 3600) / 60) AS BIGINT), CAST(floor({s} % 60) AS BIGINT), CAST(floor(CAST({f} AS DOUBLE) % ({fps})) AS BIGINT))"


def _parts_sql(tc: str) -> str:
    return f"(CAST(split_part({tc}, ':', 1) AS BIGINT) * 3600 + CAST(split_part({tc}, ':', 2) AS BIGINT) * 60 + CAST(split_part({tc}, ':', 3) AS BIGINT))"


FILM_SQL = "(24000.0::DOUBLE / 1001)"


@query(f"WITH {E}, f AS (SELECT event_id, {_FRAME} AS frames FROM e) SELECT event_id, frames, {_tc_sql('frames')} AS tc, round(frames / 24.0, 6) AS seconds FROM f")
def timecode_frames(spark, d):
    e = _events(spark, d).select("event_id", TC.frames_to_timecode(_frame()).alias("tc"))
    return e.select("event_id", TC.timecode_to_frames("tc").alias("frames"), "tc", F.round(TC.frames_to_seconds(TC.timecode_to_frames("tc")), 6).alias("seconds"))


@query(f"WITH {E}, f AS (SELECT event_id, {_FRAME} AS f FROM e) SELECT event_id, {_tc_sql('f')} AS tc, {_tc_sql('f', FILM_SQL)} AS converted FROM f")
def timecode_convert_frames(spark, d):
    e = _events(spark, d).select("event_id", TC.frames_to_timecode(_frame()).alias("tc"))
    return e.withColumn("converted", TC.convert_timecode("tc", 24.0, TC.FILM))


@query(f"WITH {E}, f AS (SELECT event_id, {_FRAME} AS f FROM e), g AS (SELECT *, CAST(trunc(f / 24.0::DOUBLE * {FILM_SQL}) AS BIGINT) AS g FROM f) SELECT event_id, {_tc_sql('f')} AS tc, {_tc_sql('g', FILM_SQL)} AS converted FROM g")
def timecode_convert_time(spark, d):
    e = _events(spark, d).select("event_id", TC.frames_to_timecode(_frame()).alias("tc"))
    return e.withColumn("converted", TC.convert_timecode("tc", 24.0, TC.FILM, preserve_frames=False))


def _spots(spark, d):
    bad = F.when(F.col("event_id") % 17 == 0, "").when(F.col("event_id") % 19 == 0, "aa:bb:cc:dd")
    return _events(spark, d).select("event_id", "user_id", "event_type", F.coalesce(bad, TC.frames_to_timecode(_frame())).alias("start"), TC.frames_to_timecode(_frame() + F.col("event_id") % 100).alias("end"), F.lit("x").alias("duration"))


@query(f"""WITH {E}, f AS (SELECT event_id, event_type, {_FRAME} AS f, {_FRAME} + event_id % 100 AS g FROM e),
c AS (SELECT event_id, f, g, {_tc_sql('f', FILM_SQL)} AS a, {_tc_sql('g', FILM_SQL)} AS b FROM f),
x AS (SELECT *, CAST(trunc({_parts_sql('a')} * {FILM_SQL} + CAST(split_part(a, ':', 4) AS BIGINT)) AS BIGINT) AS fa, CAST(trunc({_parts_sql('b')} * {FILM_SQL} + CAST(split_part(b, ':', 4) AS BIGINT)) AS BIGINT) AS fb FROM c)
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '' ELSE a END AS "start", CASE WHEN event_id % 17 = 0 THEN {_tc_sql('g')} ELSE b END AS "end", CASE WHEN event_id % 17 = 0 THEN 'x' ELSE {_tc_sql('fb - fa', FILM_SQL)} END AS duration, event_id % 17 <> 0 AS converted
FROM x WHERE event_id % 17 = 0 OR event_id % 19 <> 0""")
def spots_convert(spark, d):
    return P.convert_spots(_spots(spark, d), 24.0, TC.FILM, "start", "end", "duration").drop("user_id", "event_type")


@query(f"""WITH {E}, f AS (SELECT event_id, user_id, event_type, {_FRAME} AS f, {_FRAME} + event_id % 100 AS g FROM e WHERE event_id % 17 <> 0),
s AS (SELECT *, CASE WHEN event_id % 19 = 0 THEN 'aa:bb:cc:dd' ELSE {_tc_sql('f')} END AS "start", {_tc_sql('g')} AS "end", CASE WHEN event_id % 19 = 0 THEN 0 ELSE f END AS sort_frame FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, "start", "end" ORDER BY sort_frame, event_id) AS k FROM s),
t AS (SELECT *, CASE WHEN k > 1 THEN 'duplicate' WHEN event_id % 19 = 0 THEN 'invalid' ELSE 'planned' END AS status FROM n),
i AS (SELECT *, CASE WHEN status = 'planned' THEN row_number() OVER (PARTITION BY user_id, status ORDER BY sort_frame, event_id) END AS idx, CASE WHEN event_type LIKE '%critical%' THEN 'CRIT' WHEN event_type LIKE '%edge%' THEN 'EDGE' ELSE 'VUB' END AS code FROM t)
SELECT user_id, event_id, status, CAST(idx AS BIGINT) AS idx, code, CASE WHEN event_id % 19 <> 0 THEN g - f END AS frames, CASE WHEN status = 'planned' THEN printf('SHOW_%04d_%s_%s_%s.mov', idx, code, replace("start", ':', '-'), replace("end", ':', '-')) END AS clip FROM i""")
def shots_plan(spark, d):
    s = _spots(spark, d).drop("duration").withColumn("_ord", F.col("event_id"))
    p = P.plan_shots(s, "SHOW", "start", "end", "event_type", "event_type", partition=["user_id"])
    return p.select("user_id", "event_id", "status", F.col("index").cast("long").alias("idx"), "code", "frames", "clip")


def _cuts(spark, d):
    e = _events(spark, d).withColumn("t", F.col("us") / 1e6)
    a = S.score_threshold(e, "user_id", "t", "value", 100.0)
    b = e.where("event_type = 'error'").select("user_id", F.round("t", 6).alias("t")).distinct()
    return a, b


_CUTS = E + ", a AS (SELECT DISTINCT user_id, round(us / 1e6, 6) AS t FROM e WHERE value > 100 AND us >= 0), b AS (SELECT DISTINCT user_id, round(us / 1e6, 6) AS t FROM e WHERE event_type = 'error')"


@query(f"WITH {_CUTS} SELECT * FROM a")
def cuts_threshold(spark, d):
    return _cuts(spark, d)[0]


@query(f"WITH {_CUTS} SELECT * FROM a UNION SELECT * FROM b")
def cuts_union(spark, d):
    return S.union_cuts(*_cuts(spark, d))


_KEPT = _CUTS + """, u AS (SELECT * FROM a UNION SELECT * FROM b), k AS (SELECT user_id, min(t) AS t FROM u GROUP BY user_id
UNION ALL SELECT k.user_id, (SELECT min(u.t) FROM u WHERE u.user_id = k.user_id AND u.t - k.t >= 86400) FROM k WHERE k.t IS NOT NULL)"""


@query(f"WITH RECURSIVE {_KEPT} SELECT user_id, t FROM k WHERE t IS NOT NULL")
def cuts_coalesce(spark, d):
    return S.coalesce_min_gap(S.union_cuts(*_cuts(spark, d)), "user_id", gap=86400.0)


MONTH = 30 * 86400.0
_SEG = _KEPT + f""", dur AS (SELECT DISTINCT user_id, {MONTH}::DOUBLE AS d FROM e), p AS (SELECT user_id, 0.0::DOUBLE AS s FROM dur UNION SELECT user_id, t FROM k WHERE t > 0 AND t < {MONTH}),
q AS (SELECT user_id, s, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s), {MONTH}) AS n FROM p),
seg AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s) AS i, s AS start_sec, n AS end_sec, count(*) OVER (PARTITION BY user_id) AS c FROM q WHERE n - s >= 1e-6)"""


def _segments(spark, d):
    dur = _events(spark, d).select("user_id", F.lit(MONTH).alias("duration_sec")).distinct()
    return S.scene_segments(list(_cuts(spark, d)), dur, "user_id", gap=86400.0)


@query(f"WITH RECURSIVE {_SEG} SELECT user_id, i AS idx, start_sec, end_sec, round(end_sec - start_sec, 6) AS duration_sec, 'vid_' || lpad(CAST(i AS VARCHAR), CAST(greatest(2, length(CAST(c AS VARCHAR))) AS INTEGER), '0') || '.mov' AS video_name FROM seg")
def scene_segments(spark, d):
    s = _segments(spark, d)
    return s.select("user_id", F.col("index").cast("long").alias("idx"), "start_sec", "end_sec", F.round("duration_sec", 6).alias("duration_sec"), "video_name")


_ASSIGN = f"WITH RECURSIVE {_SEG}, pt AS (SELECT event_id, user_id, us / 1e6 AS t FROM e), iv AS (SELECT user_id, i, start_sec, end_sec FROM seg WHERE i % 2 = 1)"


def _assigned(spark, d, how):
    pt = _events(spark, d).select("event_id", "user_id", (F.col("us") / 1e6).alias("t"))
    iv = _segments(spark, d).where("index % 2 = 1").select("user_id", F.col("index").cast("long").alias("idx"), "start_sec", "end_sec")
    return S.assign_to_intervals(pt, iv, "user_id", how=how, width=86400.0)


@query(f"{_ASSIGN} SELECT event_id, pt.user_id, i AS idx FROM pt JOIN iv ON pt.user_id = iv.user_id AND t >= start_sec AND t < end_sec")
def interval_assign(spark, d):
    return _assigned(spark, d, "inner").select("event_id", "user_id", "idx")


@query(f"{_ASSIGN} SELECT event_id, user_id FROM pt WHERE EXISTS (SELECT 1 FROM iv WHERE pt.user_id = iv.user_id AND t >= start_sec AND t < end_sec)")
def interval_assign_semi(spark, d):
    return _assigned(spark, d, "left_semi").select("event_id", "user_id")


@query(f"{_ASSIGN} SELECT event_id, user_id FROM pt WHERE NOT EXISTS (SELECT 1 FROM iv WHERE pt.user_id = iv.user_id AND t >= start_sec AND t < end_sec)")
def interval_assign_anti(spark, d):
    return _assigned(spark, d, "left_anti").select("event_id", "user_id")


def _manifest(spark, d):
    c = _t(spark, d, "conversations").where("role in ('user', 'assistant')")
    kind = F.when(F.col("role") == "user", "video").otherwise("audio")
    return c.select("conv_id", kind.alias("kind"), F.col("turn").alias("pos"), F.concat(F.lit("https://h/"), F.col("conv_id"), F.lit("/"), F.col("turn")).alias("url"))


_PAIRS = """WITH v AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant'),
p AS (SELECT v.conv_id, v.i, v.turn AS vt, a.turn AS at_, count(*) OVER (PARTITION BY v.conv_id) AS n FROM v JOIN a ON v.conv_id = a.conv_id AND v.i = a.i)"""


@query(f"{_PAIRS} SELECT conv_id, i AS idx, 'https://h/' || conv_id || '/' || vt AS video, 'https://h/' || conv_id || '/' || at_ AS audio FROM p")
def manifest_pairs(spark, d):
    m = _manifest(spark, d)
    side = lambda k: m.where(F.col("kind") == k).select("conv_id", "pos", "url")
    return J.positional_pair(side("video"), side("audio"), "conv_id", "pos").select("conv_id", F.col("idx").cast("long").alias("idx"), F.col("url").alias("video"), F.col("right_url").alias("audio"))


@query(f"{_PAIRS} SELECT conv_id, i AS idx, n AS n_pairs, 'out_' || lpad(CAST(i AS VARCHAR), 2, '0') || '.mov' AS output FROM p WHERE i BETWEEN 1 AND least(28, n)")
def pairs_plan(spark, d):
    return P.plan_pairs(_manifest(spark, d), "conv_id").select("conv_id", F.col("idx").cast("long").alias("idx"), F.col("n_pairs").cast("long").alias("n_pairs"), "output")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY text")
def ordered_distinct_docs(spark, d):
    return O.ordered_distinct(_t(spark, d, "documents"), "text", "doc_id").select("doc_id", F.sha2("text", 256).alias("h"))


@query("SELECT doc_id, lang, source, CASE WHEN row_number() OVER (PARTITION BY lang, source, n_chars ORDER BY doc_id) > 1 THEN 'duplicate' END AS status FROM documents")
def first_by_key(spark, d):
    return O.first_by_key(_t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source", "n_chars"], ["doc_id"]).drop("n_chars")


def _jobs_docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("video"), (F.col("doc_id") + 1).cast("string").alias("audio"))


@query("SELECT d.doc_id, CASE WHEN v.doc_id IS NULL AND a.doc_id IS NULL THEN 'video/audio' WHEN v.doc_id IS NULL THEN 'video' WHEN a.doc_id IS NULL THEN 'audio' ELSE '' END AS missing FROM documents d LEFT JOIN labels v ON d.doc_id = v.doc_id LEFT JOIN labels a ON d.doc_id + 1 = a.doc_id")
def inputs_exist(spark, d):
    objects = _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"))
    return J.inputs_exist(_jobs_docs(spark, d), objects, "video", "audio").select("doc_id", "missing")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'skipped' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def skip_existing(spark, d):
    return J.skip_existing(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def pending_jobs(spark, d):
    o = _t(spark, d, "orders")
    return J.pending_jobs(o.select("o_orderkey"), o.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey")


@query("SELECT p_partkey, p_size AS expected, coalesce(n, 0) AS actual, coalesce(n, 0) >= p_size AS complete FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def expected_vs_actual(spark, d):
    return J.expected_vs_actual(_t(spark, d, "part").select("p_partkey", F.col("p_size").alias("expected")), _t(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")


def _outcomes(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "rejected").otherwise("RUNNING")
    url = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("u"), F.col("o_orderkey")))
    return _t(spark, d, "orders").withColumn("o", X.job_outcome(s, url, F.lit(None).cast("string"))).select("o_orderkey", "o_orderpriority", "o.state", "o.url")


_STATE = "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'failed:no_output_url' ELSE 'completed' END WHEN o_orderstatus = 'O' THEN 'failed:REJECTED' ELSE 'pending' END AS state, CASE WHEN o_orderkey % 3 <> 0 THEN 'u' || o_orderkey END AS url FROM orders"


@query(_STATE)
def job_outcomes(spark, d):
    return _outcomes(spark, d)


@query(f"WITH s AS ({_STATE}) SELECT o_orderpriority, count(*) AS total, count(*) FILTER (state = 'completed') AS successful, count(*) FILTER (state LIKE 'failed%') AS failed, count(*) FILTER (state = 'pending') AS skipped FROM s GROUP BY ROLLUP (o_orderpriority)")
def job_summary(spark, d):
    s = F.when(F.col("state") == "completed", "successful").when(F.col("state").startswith("failed"), "failed").otherwise("skipped")
    return O.outcome_summary(_outcomes(spark, d), s, ["o_orderpriority"], rollup=True)


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS attempts, CAST(least(30, pow(2, least(count(*) FILTER (event_type = 'error'), 4))) AS INTEGER) AS wait_sec FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') BETWEEN 1 AND 19 AND NOT bool_or(event_type = 'purchase' AND value > 400)")
def retry_schedule(spark, d):
    done = (F.col("event_type") == "purchase") & (F.col("value") > 400)
    return J.retry_rounds(_t(spark, d, "events"), "user_id", F.col("event_type") == "error", done, 20)


@query("SELECT event_id, CASE WHEN h = 201 THEN 'created' WHEN h = 429 AND a < 6 THEN 'retry' WHEN h >= 500 AND a < 5 THEN 'retry' WHEN h = 400 AND a = 0 THEN 'retry_without_option' ELSE 'fatal' END AS action FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 201 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 400 END AS h, user_id % 8 AS a FROM events)")
def response_actions(spark, d):
    h = F.element_at(F.array(*map(F.lit, (201, 429, 503, 400))), (F.col("event_id") % 4 + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", X.classify_response(h, F.lit("Unknown option"), F.col("user_id") % 8).alias("action"))


@query("SELECT page_id, 'sync' AS model, url AS video, url || '.wav' AS audio, page_id % 2 = 0 AS has_option FROM pages")
def request_payload(spark, d):
    j = _t(spark, d, "pages").select("page_id", X.request_payload("url", F.concat("url", F.lit(".wav")), X.detection_options(F.col("page_id") % 2 == 0), "sync").alias("j"))
    get = lambda p: F.get_json_object("j", p)
    return j.select("page_id", get("$.model").alias("model"), get("$.input[0].url").alias("video"), get("$.input[1].url").alias("audio"), get("$.options.active_speaker_detection.auto_detect").isNotNull().alias("has_option"))


@query("SELECT page_id, 'cut_off' AS sync_mode, 'true' AS occlusion, CASE WHEN page_id % 3 = 0 THEN 'true' END AS speaker, 'out_' || lpad(CAST(page_id AS VARCHAR), greatest(2, length(CAST(page_id AS VARCHAR)))::INTEGER, '0') || '.mov' AS name FROM pages")
def batch_payload(spark, d):
    j = _t(spark, d, "pages").select("page_id", X.request_payload("url", "url", X.batch_options(F.col("page_id") % 3 == 0), "sync", X.numbered_name("out_", "page_id", "mov")).alias("j"))
    get = lambda p: F.get_json_object("j", p)
    return j.select("page_id", get("$.options.sync_mode").alias("sync_mode"), get("$.options.occlusion_detection_enabled").alias("occlusion"), get("$.options.active_speaker").alias("speaker"), get("$.outputFileName").alias("name"))


@query("SELECT o_orderkey, want_pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) JOIN (VALUES (5, 0), (2, 1), (5, 2), (100000000, 3)) w(r, want_pos) ON n = r")
def select_rows(spark, d):
    o = O.with_ordinal(_t(spark, d, "orders").select("o_orderkey"), order_by=["o_orderkey"]).withColumn("n", F.col("_ord") + 1)
    return O.select_rows(o, "n", rows=[5, 2, 5, 100000000]).select("o_orderkey", "want_pos")


@query("SELECT page_id, list_transform(regexp_extract_all(lower(split_part(url, '/', -1)), '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' || lpad(CAST(length(regexp_replace(x, '^0+(.)', '\\1')) AS VARCHAR), 4, '0') || regexp_replace(x, '^0+(.)', '\\1') ELSE x END) AS k FROM pages")
def natural_order(spark, d):
    return _t(spark, d, "pages").select("page_id", X.natural_sort_key(X.basename("url")).alias("k"))


@query("SELECT page_id, regexp_replace(regexp_replace(trim(url || ' (1)'), ' ', '_', 'g'), '[^A-Za-z0-9_\\-]+', '-', 'g') AS slug FROM pages")
def slugs(spark, d):
    return _t(spark, d, "pages").select("page_id", X.slugify(F.concat(F.lit(" "), F.col("url"), F.lit(" (1)"))).alias("slug"))


@query("SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS bucket, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '^[^/]*/?', '') AS key FROM pages")
def uri_parts(spark, d):
    u = X.parse_object_uri(F.regexp_replace("url", "^[a-z]+://", "s3://"))
    return _t(spark, d, "pages").select("page_id", u["bucket"].alias("bucket"), u["key"].alias("key"))


def _names(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("mov", "MP4", "wav", "txt", "flac", "bin"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return _t(spark, d, "documents").select("doc_id", "source", "n_chars", F.concat(F.lit("/in/"), "source", F.lit("/"), F.when(F.col("doc_id") % 10 == 0, "._").otherwise(""), F.lit("clip"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"))


_NAMES = "n AS (SELECT doc_id, source, n_chars, '/in/' || source || '/' || CASE WHEN doc_id % 10 = 0 THEN '._' ELSE '' END || 'clip' || doc_id || '.' || ['mov', 'MP4', 'wav', 'txt', 'flac', 'bin'][doc_id % 6 + 1] AS path, ['mov', 'mp4', 'wav', 'txt', 'flac', 'bin'][doc_id % 6 + 1] AS ext, ['video/quicktime', 'video/mp4', 'audio/wav', 'text/plain', 'audio/flac', 'application/octet-stream'][doc_id % 6 + 1] AS mime FROM documents)"


@query(f"WITH {_NAMES} SELECT mime, count(*) AS n, count(*) FILTER (mime LIKE 'video/%') AS videos FROM n GROUP BY mime")
def mime_counts(spark, d):
    m = _names(spark, d).select(X.mime_type("path").alias("mime"))
    return m.groupBy("mime").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.is_video_mime(F.col("mime"))).alias("videos"))


@query(f"WITH {_NAMES} SELECT ext, count(*) AS n, bool_and(ext IN ('mov', 'mp4')) AS video, bool_and(ext IN ('wav', 'flac')) AS audio FROM n GROUP BY ext")
def ext_counts(spark, d):
    return O.counts_by(_names(spark, d), X.extension("path").alias("ext"), also=[F.bool_and(X.is_video_ext("path")).alias("video"), F.bool_and(X.is_audio_ext("path")).alias("audio")])


@query(f"WITH {_NAMES} SELECT doc_id FROM n WHERE doc_id % 10 <> 0 AND regexp_matches(path, 'clip[0-9]*5')")
def name_filter(spark, d):
    return _names(spark, d).where(~X.is_hidden("path") & X.match_pattern("path", regex="clip[0-9]*5")).select("doc_id")


@query(f"WITH {_NAMES} SELECT doc_id, path FROM n WHERE regexp_matches(split_part(path, '/', -1), '^clip.*[0-9].\\.m.*$')")
def name_glob(spark, d):
    return _names(spark, d).where(X.match_pattern("path", glob="clip*?.m*") & X.match_pattern("path", regex="clip.*[0-9].\\.m[^/]*$")).select("doc_id", "path")


@query("SELECT coalesce(CAST(nullif(label, 0) AS VARCHAR), 'no_face') AS \"group\", count(*) AS n, coalesce(label, 0) <> 0 AS grouped FROM embeddings GROUP BY ALL")
def group_sizes(spark, d):
    return O.group_sizes(_t(spark, d, "embeddings").select(F.nullif("label", F.lit(0)).alias("label")), "label")


@query("SELECT DISTINCT split_part(url, '/', 3) AS host FROM pages")
def hosts_sorted_distinct(spark, d):
    return O.sorted_distinct(_t(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")), "host")


@query("SELECT event_type, CAST(max(n) AS BIGINT) AS max_attempts FROM (SELECT event_type, user_id, count(*) FILTER (value > 50) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def attempts_max(spark, d):
    return J.max_attempts(_t(spark, d, "events"), "user_id", F.col("value") > 50, by=["event_type"])


@query("""SELECT p_partkey, CASE WHEN f LIKE '%flt%' THEN 'pcm_f32le' WHEN b = 24 THEN 'pcm_s24le' WHEN b = 32 AND f LIKE '%s32%' THEN 'pcm_s32le' ELSE 'pcm_s16le' END AS scene,
CASE f WHEN 's16' THEN 'pcm_s16le' WHEN 's32p' THEN 'pcm_s32le' WHEN 'u8' THEN 'pcm_u8' ELSE 'pcm_f32le' END AS chunk, CASE f WHEN 's16' THEN 'pcm_s16le' WHEN 's32p' THEN 'pcm_s32le' WHEN 'fltp' THEN 'pcm_f32le' ELSE 'pcm_s24le' END AS bounce, 'prores_ks:' || CASE WHEN p_partkey % 2 = 0 THEN '2' ELSE '3' END AS video
FROM (SELECT p_partkey, ['s16', 's32p', 'u8', 'fltp'][p_partkey % 4 + 1] AS f, [16, 24, 32][p_partkey % 3 + 1] AS b FROM part)""")
def codec_map(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ("s16", "s32p", "u8", "fltp"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("f"), F.element_at(F.array(*map(F.lit, (16, 24, 32))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("b"))
    c = lambda policy: X.pcm_codec("f", "b", F.lit("pcm_s24le"), policy).alias(policy)
    return p.select("p_partkey", c("scene"), c("chunk"), c("bounce"), X.video_codec_args(F.lit("prores"), F.when(F.col("p_partkey") % 2 == 0, "standard").otherwise("?")).alias("video"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, source, n_chars, CASE WHEN doc_id % 3 = 0 THEN lpad(CAST(doc_id // 3 % 20 AS VARCHAR), 2, '0') || '.mov' ELSE 'c' || doc_id || '.mov' END AS name FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, name, doc_id) AS n FROM (SELECT source, name, min(n_chars) AS n_chars, min(doc_id) AS doc_id FROM d GROUP BY source, name)),
t AS (SELECT *, CASE WHEN n < 10 THEN '0' ELSE '' END || n || '.mov' AS target FROM n),
h AS (SELECT t.*, o.name AS held, o.n AS hn FROM t LEFT JOIN t o ON t.source = o.source AND t.target = o.name),
r AS (SELECT source, name, n, target, CASE WHEN name = target THEN 'same' WHEN held IS NULL THEN 'rename' WHEN hn > n THEN 'conflict' END AS status FROM h WHERE name = target OR held IS NULL OR hn > n
UNION ALL SELECT h.source, h.name, h.n, h.target, CASE r.status WHEN 'rename' THEN 'rename' ELSE 'conflict' END FROM h JOIN r ON h.source = r.source AND h.held = r.name WHERE h.name <> h.target AND h.hn < h.n)
SELECT source, name, target, status FROM r""")
def rename_plan(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.format_string("%02d", F.expr("doc_id div 3 % 20")), F.lit(".mov"))).otherwise(F.concat(F.lit("c"), F.col("doc_id"), F.lit(".mov")))
    inv = _t(spark, d, "documents").select("source", "n_chars", "doc_id", name.alias("name")).groupBy("source", "name").agg(F.min("n_chars").alias("n_chars"), F.min("doc_id").alias("doc_id"))
    return P.plan_rename(inv, ["source"], "name", "n_chars").select("source", "name", "target", "status")


@query("SELECT p_partkey, CASE WHEN k = 0 THEN p_name || '.mov' ELSE p_name || '_' || k || '.mov' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS k FROM part)")
def name_disambiguation(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_brand", F.concat("p_name", F.lit(".mov")).alias("name"))
    return O.disambiguate_names(p, ["p_brand"], "name", ["p_partkey"]).select("p_partkey", "unique_name")


@query(f"WITH {_NAMES} SELECT n.doc_id, 'run_202401010000/' || substring(path, 5) AS key, mime, 'https://h/public/b/run_202401010000/' || substring(path, 5) AS url, CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'skipped' END AS status FROM n LEFT JOIN labels l ON n.doc_id = l.doc_id WHERE n.doc_id % 10 <> 0")
def upload_plan(spark, d):
    n = _names(spark, d)
    have = n.join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(X.remote_key(F.lit("run_202401010000"), X.relative_path("path", "/in"), "preserve").alias("key"))
    return P.plan_upload(n, "path", "/in", "run_202401010000", "https://h", "b", have).select("doc_id", "key", "mime", "url", "status")


@query("SELECT 'src_' || split_part(max(url), '/', 1) || '_' || strftime(max(ts), '%Y%m%d%H%M') AS prefix, source FROM (SELECT source, source || '/x' AS url, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 28 AS INTEGER)) AS ts FROM documents) GROUP BY source")
def upload_prefixes(spark, d):
    ts = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 28 as int))")
    s = _t(spark, d, "documents").withColumn("ts", ts).groupBy("source").agg(F.max("ts").alias("ts"))
    return s.select("source", X.upload_prefix(F.concat(F.lit("/in/src "), "source", F.lit("/")), "ts").alias("prefix"))


_UPLOADED = f"WITH {_NAMES}, u AS (SELECT n.doc_id, source, mime, 'https://h/public/b/up/clip' || n.doc_id || substring(path, length(path) - length(ext)) AS url, CASE WHEN n.doc_id % 9 = 0 THEN 'failed' WHEN l.doc_id IS NULL THEN 'uploaded' ELSE 'skipped' END AS status FROM n LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON n.doc_id = l.doc_id WHERE n.doc_id % 10 <> 0)"


def _uploaded(spark, d):
    n = _names(spark, d)
    have = n.join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(X.remote_key(F.lit("up"), "path").alias("key"))
    plan = P.plan_upload(n, "path", "/in", "up", "https://h", "b", have, "flat", glob="clip*")
    return plan.withColumn("status", F.when(F.col("doc_id") % 9 == 0, "failed").when(F.col("status") == "pending", "uploaded").otherwise(F.col("status")))


@query(f"{_UPLOADED}, m AS (SELECT doc_id, split_part(mime, '/', 1) AS kind, url FROM u WHERE status = 'uploaded' AND split_part(mime, '/', 1) IN ('video', 'audio')) SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS pos, url FROM m")
def upload_manifest(spark, d):
    return P.upload_manifest(_uploaded(spark, d).where("status = 'uploaded'"))


@query(f"{_UPLOADED} SELECT source, count(*) AS total, count(*) FILTER (status = 'uploaded') AS successful, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM u GROUP BY source")
def upload_summary(spark, d):
    return P.upload_summary(_uploaded(spark, d), ["source"])


@query("SELECT d.doc_id, 'jobs/' || d.doc_id || '/result.mov' AS key, l.doc_id IS NOT NULL AS available, 'clip_' || row_number() OVER (ORDER BY d.doc_id) || '.mov' AS local FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def download_plan(spark, d):
    objects = _t(spark, d, "labels").select(F.concat(F.lit("jobs/"), F.col("doc_id"), F.lit("/result.mov")).alias("key"))
    r = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("job"), "source")
    return P.plan_download(r, "job", objects, "jobs", "doc_id", "clip").select("doc_id", "key", "available", "local")


@query("SELECT page_id::VARCHAR AS number, 'b' AS bucket, 'k/' || page_id AS key, page_id % 2 = 0 AS available, 'out/' || page_id || '_final.mov' AS local FROM pages")
def download_list(spark, d):
    p = _t(spark, d, "pages")
    u = X.parse_object_uri(F.concat(F.lit("s3://b/k/"), F.col("page_id")))
    entries = p.select(F.col("page_id").cast("string").alias("number"), u["bucket"].alias("bucket"), u["key"].alias("key"))
    return P.plan_download_list(entries, p.where("page_id % 2 = 0").select(F.concat(F.lit("k/"), F.col("page_id")).alias("key")), "out/", "final")


@query(f"WITH {_NAMES} SELECT path AS key, 'out/' || split_part(path, '/', -1) AS local FROM n WHERE source = 'src1'")
def download_sync(spark, d):
    return P.plan_download_sync(_names(spark, d).select(F.col("path").alias("key")), "/in/src1", "out")


@query("WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, p AS pos FROM c UNION ALL SELECT conv_id, turn, 2 * n + 1 - p FROM c UNION ALL SELECT conv_id, turn, 2 * n + p FROM c")
def bounce_sequence(spark, d):
    return O.bounce(_t(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"]).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"))


@query("WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, i AS pick FROM c, (VALUES (0), (1), (2)) v(i) WHERE p = CASE i WHEN 2 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 2.0)) AS BIGINT) END")
def sample_evenly(spark, d):
    return O.sample_evenly(_t(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 3)


@query("SELECT label, p, round(avg(v), 6) AS v FROM (SELECT label, unnest(range(len(embedding))) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, p")
def mean_vectors(spark, d):
    return O.mean_vector(_t(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("embedding").alias("p", "v")).select("label", F.col("p").cast("long").alias("p"), F.round("v", 6).alias("v"))


_DIST = "1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DIST}, 6) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_DIST} <= 0.6")
def similar_pairs(spark, d):
    return V.similar_pairs(_t(spark, d, "embeddings"), "vec_id", "embedding", 0.6).select("a", "b", F.round("dist", 6).alias("dist"))


def _groups(spark, d):
    return V.group_by_similarity(_t(spark, d, "embeddings"), "vec_id", "embedding", 0.6)


_GROUPS = f"""WITH RECURSIVE pr AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_DIST} <= 0.6),
r AS (SELECT a AS id, a AS root FROM pr UNION SELECT pr.b, r.root FROM r JOIN pr ON r.id = pr.a), c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
mv AS (SELECT root, p, avg(v) AS v FROM (SELECT root, unnest(range(len(embedding))) AS p, unnest(embedding)::DOUBLE AS v FROM c JOIN embeddings ON id = vec_id) GROUP BY root, p), ce AS (SELECT root, list(v ORDER BY p) AS cv FROM mv GROUP BY root),
no AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id NOT IN (SELECT id FROM c)),
ne AS (SELECT vec_id, arg_min(root, (1 - list_cosine_similarity(e, cv), root)) AS root FROM no, ce WHERE 1 - list_cosine_similarity(e, cv) < 1.5 * 0.6 GROUP BY vec_id),
al AS (SELECT id, 0 AS kind, root FROM c UNION ALL SELECT vec_id, 0, root FROM ne UNION ALL SELECT vec_id, 1, vec_id FROM no WHERE vec_id NOT IN (SELECT vec_id FROM ne)),
nm AS (SELECT kind, root, row_number() OVER (ORDER BY kind, root) AS n FROM (SELECT DISTINCT kind, root FROM al)),
gr AS (SELECT id AS vec_id, printf('face_%03d', n) AS group_id FROM al JOIN nm USING (kind, root))"""


@query(f"{_GROUPS} SELECT vec_id, group_id FROM gr")
def similarity_groups(spark, d):
    return _groups(spark, d)


@query(f"{_GROUPS}, s AS (SELECT group_id, count(*) AS n FROM gr GROUP BY 1) SELECT group_id, n, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY vec_id) AS k FROM gr) JOIN s USING (group_id) WHERE k <= 5")
def group_top(spark, d):
    groups = O.kept(_groups(spark, d))
    p = O.preview_top(groups, ["group_id"], ["vec_id"], 5)
    n = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, "group_id").select("group_id", "n", "vec_id")


@query("SELECT label, list(vec_id ORDER BY vec_id) AS members FROM embeddings GROUP BY label")
def groups_collected(spark, d):
    return IO.collect_groups(_t(spark, d, "embeddings"), "label", "vec_id")


@query("SELECT vec_id, CASE WHEN b IS NOT NULL THEN round(1 - list_cosine_similarity(e, b), 5) END AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)")
def content_change(spark, d):
    return S.content_change(_t(spark, d, "embeddings"), "label", "vec_id", "embedding").select("vec_id", F.round("score", 5).alias("score"))


_FPS = ["24", "film", " 24FPS ", "NTSC", "29.97", "pal", "12.5", "24d", "abc", "", "60", "23.976", "59.94", "-5", "1e2", "nan", "inf", "30fps", "50", "25"]


@query(f"SELECT p_partkey, ([24, 24, 24, 30000 / 1001.0, 30000 / 1001.0, 25, 12.5, NULL, NULL, NULL, 60, {FILM_SQL}, 60000 / 1001.0, NULL, 100, NULL, NULL, 30, 50, 25]::DOUBLE[])[p_partkey % 20 + 1] AS fps FROM part")
def fps_parse(spark, d):
    s = F.element_at(F.array(*map(F.lit, _FPS)), (F.col("p_partkey") % 20 + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", TC.parse_fps(s).alias("fps"))


@query(f"WITH {E}, f AS (SELECT event_id, {_FRAME} AS f, {_FRAME} + event_id % 100 - 20 AS g FROM e) SELECT event_id, f AS start_frame, g - f AS frames, round(f / 24.0, 6) AS start_sec, round((g - f) / 24.0, 6) AS duration_sec, round(CAST(trunc((f // 24) * {FILM_SQL} + f % 24) AS BIGINT) / {FILM_SQL}, 5) AS film_start FROM f")
def clip_bounds(spark, d):
    tc = lambda n: TC.frames_to_timecode(n, floor=False)  # noqa: E731  # ends can stand before frame 0
    e = _events(spark, d).select("event_id", tc(_frame()).alias("a"), tc(_frame() + F.col("event_id") % 100 - 20).alias("b"))
    c = TC.clip_bounds("a", "b")
    return e.select("event_id", c["start_frame"].alias("start_frame"), c["frames"].alias("frames"), F.round(c["start_sec"], 6).alias("start_sec"), F.round(c["duration_sec"], 6).alias("duration_sec"), TC.clip_bounds_fractional("a", "b", places=5)["start_sec"].alias("film_start"))


@query("SELECT event_id, printf('%02d:%02d:%06.3f', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s - 3600 * floor(s / 3600)) / 60) AS BIGINT), s - 60 * floor(s / 60)) AS t FROM (SELECT event_id, round(value * 1000, 2) + 0.0001 AS s FROM events)")
def duration_format(spark, d):
    return _t(spark, d, "events").select("event_id", TC.format_duration(F.round(F.col("value") * 1000, 2) + 0.0001).alias("t"))


@query(f"WITH {E}, f AS (SELECT event_id, {_FRAME} AS f FROM e) SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN f / 24.0 ELSE f // 24 END, 6) AS sec FROM f")
def cut_times(spark, d):
    tc = TC.frames_to_timecode(_frame())
    raw = F.when(F.col("event_id") % 2 == 0, tc).otherwise(F.concat(F.substring_index(tc, ":", 3), F.lit(".000")))
    return _events(spark, d).select("event_id", F.round(TC.parse_cut_time(raw, 24.0), 6).alias("sec"))


@query("SELECT url, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY url, page_id) AS n FROM pages")
def rows_numbered(spark, d):
    return O.number_rows(_t(spark, d, "pages").withColumn("host", F.substring_index(F.regexp_replace("url", "^[a-z]+://", ""), "/", 1)), ["host"], ["url", "page_id"]).select("url", F.col("n").cast("long").alias("n"))


@query("SELECT url FROM pages UNION SELECT url || '?x' FROM pages WHERE page_id % 2 = 0")
def listing_union(spark, d):
    p = _t(spark, d, "pages")
    return S.union_cuts(p.select("url"), p.where("page_id % 2 = 0").select(F.concat("url", F.lit("?x")).alias("url")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Missing audio or video URL' WHEN o_orderkey % 5 = 0 THEN 'Invalid S3 URI format' END AS error, o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS success, o_orderpriority LIKE '1%' AS auto_detect FROM orders""")
def jobs_plan(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise("s3://b/v.mov").alias("video"), F.when(F.col("o_orderkey") % 5 == 0, "s3://only").otherwise("https://x/a").alias("audio"), F.when(F.col("o_orderpriority").startswith("1"), " Yes ").otherwise("no").alias("asd"))
    return P.plan_jobs(o, "video", "audio", "asd", "o_orderkey", ["o_orderkey"]).select("o_orderkey", "error", "success", "auto_detect")


_RUN = """WITH r AS (SELECT o_orderkey AS csv_row, CASE WHEN o_orderkey % 7 = 0 THEN 'Missing audio or video URL' WHEN o_orderkey % 5 = 0 THEN 'Invalid S3 URI format' WHEN o_orderkey % 4 = 0 THEN 'No response' WHEN o_orderstatus = 'P' THEN 'refused' END AS error, o_orderpriority LIKE '1%' AS detect FROM orders)"""


def _run(spark, d):
    t = _t(spark, d, "orders")
    o = t.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise("s3://b/v.mov").alias("video"), F.when(F.col("o_orderkey") % 5 == 0, "s3://only").otherwise("https://x/a").alias("audio"), F.when(F.col("o_orderpriority").startswith("1"), " Yes ").otherwise("no").alias("asd"))
    plan = P.plan_jobs(o, "video", "audio", "asd", "o_orderkey", ["o_orderkey"])
    refused = F.col("o_orderstatus") == "P"
    answers = t.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("csv_row"), F.when(~refused, F.concat(F.lit("j"), F.col("o_orderkey"))).alias("job_id"), F.when(refused, "refused").alias("error"))
    return P.run_jobs(plan, "video", "audio", answers, "sync")


@query(f"{_RUN} SELECT csv_row, error IS NULL AS success, CASE WHEN error IS NULL THEN 'https://x/a' END AS audio_s3, CASE WHEN error IS NULL THEN 's3://b/v.mov' END AS video_s3, CASE WHEN error IS NULL THEN 'j' || csv_row END AS job_id, error, CASE WHEN coalesce(error, '') NOT IN ('Missing audio or video URL', 'Invalid S3 URI format') THEN detect END AS detect FROM r")
def jobs_run(spark, d):
    detect = F.get_json_object("payload", "$.options.active_speaker_detection.auto_detect").isNotNull()
    return _run(spark, d).select("csv_row", "success", "audio_s3", "video_s3", "job_id", "error", F.when(F.col("payload").isNotNull(), detect).alias("detect"))


@query(f"{_RUN} SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NOT NULL) AS failed, CAST(0 AS BIGINT) AS skipped FROM r")
def jobs_run_summary(spark, d):
    return P.run_summary(_run(spark, d))


@query("SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS csv_row FROM orders")
def identical_rows(spark, d):
    o = _t(spark, d, "orders").withColumn("_z", F.col("o_orderkey") - 1)
    return O.first_identical_row_no(o, ["o_custkey", "o_orderstatus"], "_z").select("o_orderkey", "csv_row")


@query(f"WITH RECURSIVE {_SEG}, pt AS (SELECT user_id, us / 1e6 AS t FROM e) SELECT seg.user_id, i AS idx, count(t) AS n_points, 'c' || i || '.mov' AS video_out FROM seg LEFT JOIN pt ON pt.user_id = seg.user_id AND t >= start_sec AND t < end_sec GROUP BY ALL")
def chunk_plan(spark, d):
    cuts = _segments(spark, d).select("user_id", F.col("index").cast("long").alias("idx"), F.concat(F.lit("c"), F.col("index")).alias("name"), "start_sec", "end_sec")
    pt = _events(spark, d).select("user_id", (F.col("us") / 1e6).alias("t"))
    return P.plan_chunks(cuts, pt, "user_id", width=86400.0).select("user_id", "idx", "n_points", "video_out")


@query(f"WITH {_NAMES} SELECT n.doc_id, 'clip' || n.doc_id || '_bounced.mov' AS output, CASE WHEN l.doc_id IS NOT NULL THEN 'skipped' WHEN n.doc_id % 4 = 0 THEN 'failed' ELSE 'pending' END AS status FROM n LEFT JOIN labels l ON n.doc_id = l.doc_id WHERE n.doc_id % 10 <> 0")
def derivative_plan(spark, d):
    n = _names(spark, d)
    probe = n.select("path", F.when(F.col("doc_id") % 4 == 0, "").otherwise("prores").alias("codec"), F.lit("HQ").alias("profile"), F.lit("s16").alias("audio_sample_fmt"), F.lit("aac").alias("audio_codec"))
    have = _t(spark, d, "labels").select(F.concat(F.lit("clip"), F.col("doc_id"), F.lit("_bounced.mov")).alias("output"))
    return P.plan_derivatives(n, "path", probe, have).select("doc_id", "output", "status")


@query("SELECT event_type AS dir, count(*) AS n FROM events WHERE CAST(event_id AS VARCHAR) LIKE '%7%' GROUP BY 1")
def arrivals_check(spark, d):
    o = _t(spark, d, "events").select(F.concat("event_type", F.lit("/"), F.col("event_id")).alias("key"))
    return M.arrivals(o.union(o), "/.*7", F.substring_index("key", "/", 1))


@query("WITH c AS (SELECT event_type AS dir, count(*) AS expected, count(*) FILTER (event_id % 3 <> 0 AND event_type <> 'error') AS actual FROM events WHERE CAST(event_id AS VARCHAR) LIKE '%7%' GROUP BY 1) SELECT *, CAST(sum(actual) OVER () AS BIGINT) AS total, sum(actual) OVER () >= 50 AS complete FROM c")
def arrivals_report(spark, d):
    o = _t(spark, d, "events").select("event_id", "event_type", F.concat("event_type", F.lit("/"), F.col("event_id")).alias("key"))
    count = lambda rows: M.arrivals(rows, "/.*7", F.substring_index("key", "/", 1))
    return M.monitor_arrivals(count(o.where("event_id % 3 <> 0 and event_type <> 'error'")), count(o), 50)


@query("WITH p AS (SELECT DISTINCT p_brand, p_size, p_size + 10 AS target FROM part) SELECT p.p_brand, p.p_size, p.target, o.p_size AS holder FROM p LEFT JOIN p o ON p.p_brand = o.p_brand AND p.target = o.p_size")
def name_conflicts(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_size").distinct()
    return J.name_conflicts(p.withColumn("target", F.col("p_size") + 10), p, "target", "p_size", ["p_brand"])


@query("SELECT event_id // 100 AS b, event_type, round(sum(round(value, 2)) OVER (PARTITION BY event_id // 100, event_type ORDER BY event_id), 4) AS total FROM events")
def running_totals(spark, d):
    e = _t(spark, d, "events").select(F.expr("event_id div 100").alias("b"), "event_id", "event_type", F.round("value", 2).alias("v"))
    return O.running_total(e, ["b", "event_type"], ["event_id"], "v").select("b", "event_type", F.round("total", 4).alias("total"))


@query("WITH w AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS so_far, round(sum(n) OVER (PARTITION BY event_type ORDER BY day) * 100.0 / sum(n) OVER (PARTITION BY event_type), 6) AS percent FROM w")
def progress_daily(spark, d):
    from pyspark.sql import Window

    e = M.progress_series(_t(spark, d, "events"), "ts", "1 day", ["event_type"]).select("event_type", F.to_date("w.start").alias("day"), "n")
    s = O.running_total(e, ["event_type"], ["day"], "n", "so_far").withColumn("all", F.sum("n").over(Window.partitionBy("event_type")))
    return s.select("event_type", "day", "n", "so_far", F.round(O.progress(F.col("so_far"), F.col("all")), 6).alias("percent"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed:FAILED' ELSE 'pending' END AS state FROM orders")
def latest_states(spark, d):
    o = _t(spark, d, "orders")
    s = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("QUEUED")
    rows = o.select("o_orderkey", F.lit(1).alias("at"), F.lit("RUNNING").alias("status")).union(o.select("o_orderkey", F.lit(2), s)).union(o.select("o_orderkey", F.lit(3), F.lit("RUNNING")))
    return M.latest_job_state(rows.withColumn("url", F.lit("u")), "o_orderkey", "at", "status", "url").select("o_orderkey", "state")


@query("SELECT vec_id, len(embedding) AS n FROM embeddings")
def vectors_source(spark, d):
    return IO.read_embeddings(_t(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.size("embedding").cast("long").alias("n"))


@query(f"WITH {E} SELECT event_id::VARCHAR AS \"Event Id\", event_type || ', \"x\"' AS \"Event Name\", {_tc_sql(_FRAME)} AS \"Start\" FROM e")
def spots_roundtrip(spark, d):
    e = _events(spark, d).select(F.col("event_id").cast("string").alias("Event Id"), F.concat("event_type", F.lit(', "x"')).alias("Event Name"), TC.frames_to_timecode(_frame()).alias("Start"), F.col("event_id").alias("_ord"))
    IO.write_spots(e, at := _place(spark))
    return IO.read_spots(spark, at).drop("_ord")


@query("SELECT o_orderkey::VARCHAR AS video, o_orderpriority AS audio FROM orders")
def jobs_roundtrip(spark, d):
    _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias(" VIDEO"), F.col("o_orderpriority").alias("Audio ")).write.option("header", True).csv(at := _place(spark))
    return IO.read_jobs(spark, at).drop("_ord")


@query("SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY conv_id, turn) AS pos, url FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'video' ELSE 'audio' END AS kind, 'https://h/' || conv_id || '/' || turn AS url FROM conversations WHERE role IN ('user', 'assistant'))")
def manifest_roundtrip(spark, d):
    m = O.number_within(_manifest(spark, d).withColumnRenamed("pos", "turn"), "kind", ["conv_id", "turn"], "pos")
    IO.write_manifest(m.select("kind", "pos", "url"), at := _place(spark))
    return IO.read_manifest_parts(spark, at)


@query(f"WITH {E} SELECT 'c' || event_id AS name, round(({_FRAME}) / 24.0, 6) AS start_sec, {_tc_sql(_FRAME + ' + 48')} AS end_raw FROM e")
def cuts_roundtrip(spark, d):
    e = _events(spark, d).select(F.concat(F.lit("c"), F.col("event_id"), F.lit("  "), TC.frames_to_timecode(_frame()), F.lit(" "), TC.frames_to_timecode(_frame() + 48)).alias("value"))
    e.union(e.limit(1).select(F.lit("# a note"))).write.text(at := _place(spark))
    return IO.read_cuts(spark, at, 24.0).select("name", F.round("start_sec", 6).alias("start_sec"), "end_raw")


@query("SELECT page_id::VARCHAR AS number, 'b' AS bucket, 'k/' || page_id AS key FROM pages")
def url_list_roundtrip(spark, d):
    p = _t(spark, d, "pages").select(F.concat(F.col("page_id"), F.lit("\ts3://b/k/"), F.col("page_id")).alias("value"))
    p.union(p.select(F.lit("# note"))).write.text(at := _place(spark))
    return IO.read_url_list(spark, at).select("number", "bucket", "key")


@query(f"WITH s AS ({_STATE}) SELECT o_orderkey::VARCHAR AS job_id, state FROM s WHERE o_orderkey % 4 <> 0")
def results_roundtrip(spark, d):
    r = _outcomes(spark, d).select(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey").cast("string")).alias("job_id"), "state")
    IO.write_results(r, at := _place(spark))
    return IO.read_job_ids(spark, at, lines=True).select("job_id", "state")


def _clock_sql(c: str) -> str:
    return f"printf('%02d:%02d:%06.3f', CAST(floor({c} / 3600) AS BIGINT), CAST(floor(({c} - 3600 * floor({c} / 3600)) / 60) AS BIGINT), {c} - 60 * floor({c} / 60))"


@query(f"WITH RECURSIVE {_SEG} SELECT CAST(i AS VARCHAR) AS index, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec, round(end_sec - start_sec, 3) AS duration_sec, {_clock_sql('start_sec')} AS start_tc, {_clock_sql('end_sec')} AS end_tc FROM seg")
def segments_roundtrip(spark, d):
    IO.write_segments(_segments(spark, d), at := _place(spark))
    sec = lambda c: F.col(c).cast("double").alias(c)
    return IO._csv(spark, at).select("index", sec("start_sec"), sec("end_sec"), sec("duration_sec"), "start_tc", "end_tc")


@query("SELECT label AS group_id, vec_id FROM embeddings")
def layout_roundtrip(spark, d):
    IO.write_grouped_layout(_t(spark, d, "embeddings").select(F.col("label").alias("group_id"), "vec_id"), at := _place(spark))
    return spark.read.parquet(at).select("group_id", "vec_id")


@query("SELECT DISTINCT 'group_id=' || label AS dir, true AS filled FROM embeddings")
def file_inventory(spark, d):
    IO.write_grouped_layout(_t(spark, d, "embeddings").select(F.col("label").alias("group_id"), "vec_id"), at := _place(spark))
    files = IO.media_inventory(spark, at, pattern="*.parquet")
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("dir")).agg((F.min("length") > 0).alias("filled"))


@query("SELECT CAST(label AS VARCHAR) AS label, list(vec_id ORDER BY vec_id) AS members FROM embeddings GROUP BY label")
def groups_written(spark, d):
    IO.write_groups(_t(spark, d, "embeddings"), at := _place(spark), "label", "vec_id")
    return spark.read.schema("label string, members array<long>").json(at)


@query("SELECT doc_id FROM documents WHERE source = 'src1'")
def object_listing(spark, d):
    n = _names(spark, d)
    return IO.object_listing(n, "/in/src1", "path").select("doc_id")


@query(f"{_GROUPS} SELECT vec_id, group_id FROM gr UNION ALL SELECT -1 - vec_id, 'no_face' FROM embeddings")
def similarity_groups_every(spark, d):
    """Half of the clips have no vector."""
    v = _t(spark, d, "embeddings")
    every = v.select("vec_id").union(v.select(-1 - F.col("vec_id")))
    return V.group_by_similarity(v, "vec_id", "embedding", 0.6, every=every)


@query(f"WITH {E}, f AS (SELECT event_id, {_FRAME} AS f FROM e) SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN 0 ELSE f END, event_id) - 1 AS place FROM f")
def spots_by_time(spark, d):
    s = _spots(spark, d).withColumn("_ord", F.col("event_id"))
    return O.with_ordinal(s, "place", O.timecode_order("start")).select("event_id", "place")


@query(f"WITH {_NAMES} SELECT doc_id, row_number() OVER (ORDER BY ext, doc_id) - 1 AS place FROM (SELECT doc_id, 'clip' || doc_id || '.' || ext AS name, ext FROM n) WHERE true")
def names_by_number(spark, d):
    """In natural order within an extension: clip2 before clip10."""
    n = _names(spark, d).select("doc_id", X.extension("path").alias("ext"), F.concat(F.lit("clip"), "doc_id").alias("name"))
    return O.with_ordinal(n, "place", ["ext", X.natural_sort_key("name")]).select("doc_id", "place")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'CRIT' WHEN event_id % 3 = 1 AND event_type IN ('click', 'error') THEN 'EDGE' WHEN event_type IN ('click', 'error') AND event_id % 7 = 0 THEN 'CRIT' ELSE 'VUB' END AS code FROM events""")
def shot_codes(spark, d):
    """Codes by the words of a name and a description, in any case; the first keyword counts."""
    e, few = _t(spark, d, "events"), F.col("event_type").isin("click", "error")
    k = F.col("event_id") % 3
    name = F.when(k == 0, "Vub Critical edge").when((k == 1) & few, "EDGE case").otherwise(F.lit("Vub"))
    desc = F.when(few & (k == 2) & (F.col("event_id") % 7 == 0), "a CRITICAL one")
    return e.select("event_id", X.severity_code(name, desc).alias("code"))


@query(f"WITH {_NAMES} SELECT n.doc_id, 'clip' || n.doc_id || '.wav' AS output, CASE n.doc_id % 3 WHEN 0 THEN 'pcm_s16le' WHEN 1 THEN 'pcm_s32le' ELSE 'pcm_u8' END AS pcm, CASE WHEN l.doc_id IS NOT NULL THEN 'skipped' ELSE 'pending' END AS status FROM n LEFT JOIN labels l ON n.doc_id = l.doc_id WHERE n.doc_id % 10 <> 0")
def audio_plan(spark, d):
    """Audio to extract, with the codec that the samples' format asks for."""
    n = _names(spark, d)
    fmt = F.element_at(F.array(*map(F.lit, ("s16", "s32", "u8"))), (F.col("doc_id") % 3 + 1).cast("int"))
    probe = n.select("path", F.lit("h264").alias("codec"), F.lit("").alias("profile"), fmt.alias("audio_sample_fmt"), F.lit("aac").alias("audio_codec"))
    have = _t(spark, d, "labels").select(F.concat(F.lit("clip"), F.col("doc_id"), F.lit(".wav")).alias("output"))
    return P.plan_derivatives(n, "path", probe, have, kind="audio").select("doc_id", "output", "pcm", "status")


@query(f"WITH {_NAMES} SELECT source, count(*) AS files, round(sum(n_chars) / 1048576.0, 6) AS mb, (sum(n_chars) // 60) || 'm ' || lpad(CAST(sum(n_chars) % 60 AS VARCHAR), 2, '0') || 's' AS length, max(n_chars) || 'x' || min(n_chars) AS resolution FROM n GROUP BY source")
def media_summary(spark, d):
    n = _names(spark, d).withColumn("sec", F.col("n_chars") + 0.25 * (F.col("doc_id") % 2))
    return P.media_summary(n, "n_chars", F.floor("sec"), "n_chars", "n_chars", ["source"])
