"""Composite jobs: conversions, clip plans, pairs, uploads, downloads, renames, derived files, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import text as X
from mediaframe.functions import timecode as TC
from mediaframe.operators import jobs as J
from mediaframe.operators import ordered as O
from mediaframe.operators import scenes as S
from mediaframe.sources.files import object_listing


def convert_spots(df: DataFrame, src: float, dst: float, start: str, end: str, duration: str | None = None, preserve_frames: bool = True) -> DataFrame:
    """Rows with both timecodes are converted, rows with a blank one pass as they are, malformed ones go; converted says which."""
    blank = (TC.strip(start) == "") | (TC.strip(end) == "")
    a, b = TC.convert_timecode(start, src, dst, preserve_frames), TC.convert_timecode(end, src, dst, preserve_frames)
    d = df.withColumns({"_a": a, "_b": b, "converted": ~blank}).where(blank | (F.col("_a").isNotNull() & F.col("_b").isNotNull()))
    out = {start: F.when(F.col("converted"), F.col("_a")).otherwise(F.col(start)), end: F.when(F.col("converted"), F.col("_b")).otherwise(F.col(end))}
    if duration and duration in df.columns:
        out[duration] = F.when(F.col("converted"), TC.recompute_duration(F.col("_a"), F.col("_b"), dst)).otherwise(F.col(duration))
    return d.withColumns(out).drop("_a", "_b")


def plan_shots(spots: DataFrame, show: str, start: str, end: str, name: str, desc: str, limit: int | None = None, partition: list | None = None) -> DataFrame:
    """Clips in the order of their start, numbered over those that are neither duplicates nor malformed; without a partition, which must fit a task, over all rows by one sort."""
    p = partition or []
    d = O.limit_by_ordinal(spots, limit).where((TC.strip(start) != "") & (TC.strip(end) != ""))
    d = d.withColumn("sort_frame", F.coalesce(TC.timecode_to_frames(start), F.lit(0)))
    d = O.first_by_key(d, [*p, start, end], ["sort_frame", "_ord"])
    d = d.withColumns(TC.clip_bounds(start, end)).withColumn("status", F.coalesce("status", F.when(F.col("start_frame").isNull() | F.col("end_frame").isNull(), "invalid"), F.lit("planned")))
    ok = F.col("status") == "planned"
    order = [*p, "status"], ["sort_frame", "_ord"], "index"
    d = (O.number_rows(d, *order) if p else O.number_within(d, *order)).withColumn("index", F.when(ok, F.col("index").cast("int")))
    return d.withColumn("code", X.severity_code(name, desc)).withColumn("clip", F.when(ok, X.clip_name(show, "index", "code", F.col(start), F.col(end))))


def plan_pairs(manifest: DataFrame, key: str, start: int = 1, end: int = 28) -> DataFrame:
    """Videos and audios (kind, pos, url) of a key paired by position within the range."""
    side = lambda k: manifest.where(F.col("kind") == k).select(key, "pos", "url")
    pairs = J.positional_pair(side("video"), side("audio"), key, "pos")
    n = pairs.groupBy(key).agg(F.max("idx").alias("n_pairs"))
    out = O.index_range(pairs.join(n, key), "idx", "n_pairs", start, end)
    return out.select(key, "idx", "n_pairs", F.col("url").alias("video"), F.col("right_url").alias("audio"), X.numbered_name("out_", "idx", "mov").alias("output"))


def plan_jobs(rows: DataFrame, video: str, audio: str, asd: str, ordinal: str, identical: list, **which) -> DataFrame:
    """Job rows with the first identical row's number, an error instead of a drop, and the flag."""
    d = O.first_identical_row_no(rows.withColumn("_o", F.col(ordinal) - 1), identical, "_o")
    d = O.select_rows(d, ordinal, **which)
    blank = (TC.strip(video) == "") | (TC.strip(audio) == "")
    bad = lambda c: F.when(F.col(c).startswith("s3://"), X.parse_object_uri(c)["error"])
    error = F.when(blank, "Missing audio or video URL").otherwise(F.coalesce(bad(video), bad(audio)))
    return d.withColumn("error", error).withColumn("success", F.col("error").isNull()).withColumn("auto_detect", X.parse_flag(asd)).drop("_o")


def run_jobs(plan: DataFrame, video: str, audio: str, responses: DataFrame, model: str) -> DataFrame:
    """Records (csv_row, success, audio_s3, video_s3, job_id, error) of planned jobs and the responses (csv_row, job_id, error) to them; what failed has only its error, and a row without a response counts as failed. payload is what was to be asked."""
    ask = X.request_payload(TC.strip(video), TC.strip(audio), X.detection_options(F.col("auto_detect")), model)
    r = responses.select(F.col("csv_row").alias("_row"), "job_id", F.col("error").alias("_refused"))
    rows = plan.count()
    d = O.dealt(plan, rows, "csv_row").join(O.dealt(r, rows, "_row"), F.col("csv_row") == F.col("_row"), "left")
    why = F.coalesce("error", "_refused", F.when(F.col("_row").isNull(), "No response"))
    d = d.select("csv_row", TC.strip(audio).alias("audio_s3"), TC.strip(video).alias("video_s3"), F.coalesce("job_id", F.lit("N/A")).alias("job_id"), why.alias("error"), F.when(F.col("error").isNull(), ask).alias("payload"))
    return J.merge_outcomes(d.where("error is null").drop("error"), d.where("error is not null").select("csv_row", "error", "payload"))


def run_summary(records: DataFrame, by: list | None = None) -> DataFrame:
    return O.outcome_summary(records, F.when(F.col("success"), "successful").otherwise("failed"), by)


def plan_upload(inventory: DataFrame, path: str, base: str, prefix: str | Column, host: str, bucket: str, existing: DataFrame, mode: str = "preserve", on_exists: str = "skipped", **pattern) -> DataFrame:
    """Keys, types, addresses and status of files to upload; prefix is a folder or X.upload_prefix's, pattern as in X.match_pattern."""
    d = inventory.where(~X.is_hidden(path) & X.match_pattern(path, **pattern)).select(path, *[c for c in inventory.columns if c != path]).dropDuplicates([path])
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    d = d.withColumn("key", X.remote_key(prefix, X.relative_path(path, base), mode)).withColumn("mime", X.mime_type(path)).withColumn("url", X.public_url(host, bucket, "key"))
    return J.skip_existing(d, existing, "key", on_exists=on_exists)


def upload_manifest(uploaded: DataFrame) -> DataFrame:
    """(kind, pos, url) of uploaded videos and audios (mime, url), each in natural order of their file names, then of addresses."""
    m = F.col("mime")
    kind = F.when(X.is_video_mime(m), "video").when(X.is_audio_mime(m), "audio")
    d = uploaded.select(kind.alias("kind"), "url", X.natural_sort_key(X.basename("url")).alias("_k")).where("kind is not null")
    return O.number_within(d, "kind", ["_k", "url"], "pos").select("kind", "pos", "url")


def upload_summary(outcomes: DataFrame, by: list | None = None) -> DataFrame:
    """Totals by status: uploaded counts as successful, skipped as skipped, all else as failed."""
    return O.outcome_summary(outcomes, F.when(F.col("status") == "uploaded", "successful").when(F.col("status") == "skipped", "skipped").otherwise("failed"), by)


def _available(plan: DataFrame, objects: DataFrame) -> DataFrame:
    o = objects.select(F.col("key").alias("_k")).where("_k is not null").distinct()
    return plan.join(o, F.col("key") == F.col("_k"), "left").withColumn("available", F.col("_k").isNotNull()).drop("_k")


def plan_download(results: DataFrame, job_id: str, objects: DataFrame, base: str, order: str, name: str = "result") -> DataFrame:
    """Kind json: the result of every job, numbered from 1 over all jobs in order, as name_<n>.mov."""
    d = O.with_ordinal(results, "_at", [order]).withColumn("n", F.col("_at") + 1).drop("_at")
    d = _available(d.withColumn("key", F.concat(F.lit(base.rstrip("/") + "/"), F.col(job_id), F.lit("/result.mov"))), objects)
    return d.withColumn("local", F.concat(F.lit(name + "_"), F.col("n"), F.lit(".mov")))


def plan_download_list(entries: DataFrame, objects: DataFrame, dest: str, suffix: str) -> DataFrame:
    """Kind list: entries (number, bucket, key) of a list of addresses, as dest/<number>_<suffix>.mov."""
    return _available(entries, objects).withColumn("local", F.concat(F.lit(dest.rstrip("/") + "/"), "number", F.lit(f"_{suffix}.mov")))


def plan_download_sync(objects: DataFrame, prefix: str, dest: str) -> DataFrame:
    """Kind sync: all objects below a prefix, at their relative paths below dest."""
    d = object_listing(objects, prefix)
    return d.withColumn("local", F.concat(F.lit(dest.rstrip("/") + "/"), X.relative_path("key", prefix) if prefix else F.col("key")))


def plan_rename(inventory: DataFrame, folder: list, name: str, created: str, exts=X.VIDEO_EXTENSIONS) -> DataFrame:
    """NN.ext by creation time within folder and extension. A target that another file holds is a conflict, unless that file stands earlier in the order and moves away itself; chains settle by rounds. A folder can have any number of files."""
    d = inventory.where(X.is_video_ext(name, exts)).withColumn("ext", X.extension(name))
    d = O.number_within(d, [*folder, "ext"], [created, name]).withColumn("n", F.col("n").cast("int"))
    d = d.withColumn("target", X.numbered_name("", "n", "%s")).withColumn("target", F.replace("target", F.lit("%s"), F.col("ext")))
    d = J.name_conflicts(d, d.select(*folder, name, "n"), "target", name, folder)
    same = F.col(name) == F.col("target")
    state = F.when(same, "same").when(F.col("holder").isNull(), "rename").when(F.col("held_n") > F.col("n"), "conflict").otherwise("open")
    d = O.kept(d.withColumn("status", state))
    at = [F.col(f).eqNullSafe(F.col(f"_at_{f}")) for f in folder]
    while not d.where("status = 'open'").isEmpty():  # the holder's state decides; where that is open too, its own holder is looked at next, so that chains halve
        known = d.select(*[F.col(f).alias(f"_at_{f}") for f in folder], F.col(name).alias("_name"), F.col("status").alias("_state"), F.col("holder").alias("_next"))
        j = d.join(known, [*at, F.col("holder") == F.col("_name")], "left").drop(*[f"_at_{f}" for f in folder])
        is_open = F.col("status") == "open"
        settled = F.when(is_open & F.col("_state").isin("same", "conflict"), "conflict").when(is_open & (F.col("_state") == "rename"), "rename").otherwise(F.col("status"))
        further = F.when(is_open & (F.col("_state") == "open"), F.col("_next")).otherwise(F.col("holder"))
        d = O.kept(j.withColumns({"status": settled, "holder": further}).drop("_name", "_state", "_next"))
    return d.drop("holder", "held_n")


def plan_derivatives(inventory: DataFrame, path: str, probe: DataFrame, existing: DataFrame, kind: str = "bounced", force: bool = False) -> DataFrame:
    """Output names of bounced videos or extracted audio, the codec, and status pending, skipped or failed (no codec known)."""
    d = inventory.where(~X.is_hidden(path, "bounced"))
    name = F.concat(X.stem(path), F.lit("_bounced.mov" if kind == "bounced" else ".wav"))
    d = J.skip_existing(d.withColumn("output", name), existing, "output", force)
    d = d.join(probe.withColumnRenamed(path, "_p"), F.col(path) == F.col("_p"), "left").drop("_p")
    d = d.withColumn("video_codec", X.video_codec_args("codec", "profile")).withColumn("pcm", X.pcm_codec("audio_sample_fmt", F.lit(None).cast("string"), "audio_codec", "bounce" if kind == "bounced" else "chunk"))
    return d.withColumn("status", F.when((F.col("status") == "pending") & (F.coalesce("codec", F.lit("")) == ""), "failed").otherwise(F.col("status")))


def plan_chunks(cuts: DataFrame, points: DataFrame, key: str, audio_only: bool = False, video_only: bool = False, width: float | None = None) -> DataFrame:
    """Outputs of each cut and the number of timeline rows in it; width as in assign_to_intervals."""
    kinds = X.output_kinds(F.lit(audio_only), F.lit(video_only), F.lit(True))
    n = S.assign_to_intervals(points, cuts, key, width=width).groupBy(key, "name").agg(F.count(F.lit(1)).alias("n_points"))
    d = cuts.join(n, [key, "name"], "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))
    out = lambda ok, ext: F.when(ok & (F.col("end_sec") > F.col("start_sec")), F.concat("name", F.lit(ext)))
    return d.withColumn("video_out", out(kinds["create_video"], ".mov")).withColumn("audio_out", out(kinds["create_audio"], ".wav"))


def media_summary(files: DataFrame, size: str | Column, seconds: str | Column, width: str | Column, height: str | Column, by: list) -> DataFrame:
    """For each value of by the number of files, their size in MB, their length as minutes and seconds, and the largest width with the least height."""
    g = files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("_size"), F.sum(seconds).alias("_sec"), F.max(width).alias("_w"), F.min(height).alias("_h"))
    return g.select(*by, "files", F.round(X.size_mb("_size"), 6).alias("mb"), X.min_sec("_sec").alias("length"), X.resolution("_w", "_h").alias("resolution"))
