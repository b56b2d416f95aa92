"""Names, paths, addresses, media kinds and other scalar functions, all as built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaframe.functions.timecode import _c, strip

# Fixed values.
VIDEO_EXTENSIONS = ("mov", "mp4", "avi", "mkv", "m4v")
AUDIO_EXTENSIONS = ("wav", "mp3", "m4a", "aac", "flac")
MIME_TYPES = {
    "mov": "video/quicktime", "mp4": "video/mp4", "m4v": "video/x-m4v", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "wav": "audio/wav", "mp3": "audio/mpeg",
    "m4a": "audio/mp4", "aac": "audio/aac", "flac": "audio/flac", "json": "application/json", "csv": "text/csv", "txt": "text/plain", "html": "text/html", "png": "image/png", "jpg": "image/jpeg",
}
DEFAULT_MIME = "application/octet-stream"
PRORES_PROFILES = {"proxy": "0", "lt": "1", "standard": "2", "hq": "3", "4444": "4", "4444 xq": "5"}


def basename(p: Column | str) -> Column:
    return F.substring_index(_c(p), "/", -1)


def extension(p: Column | str) -> Column:
    """Without its point, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(_c(p), r"\.([^./]+)$", 1))


def stem(p: Column | str) -> Column:
    return F.regexp_replace(basename(p), r"(?<=.)\.[^.]+$", "")


def relative_path(p: Column | str, base: str) -> Column:
    base = base.rstrip("/") + "/"
    return F.when(F.startswith(_c(p), F.lit(base)), F.substring(_c(p), len(base) + 1, 1 << 30)).otherwise(_c(p))


def slugify(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), " ", "_"), r"[^A-Za-z0-9_\-]+", "-")


def natural_sort_key(c: Column | str) -> Column:
    """Runs of digits and other characters; digits compare as numbers, by their length first."""
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    number = lambda d: F.regexp_replace(d, "^0+(?=.)", "")
    return F.transform(runs, lambda d: F.when(d.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(number(d)).cast("string"), 4, "0"), number(d))).otherwise(d))


def parse_object_uri(c: Column | str) -> Column:
    """struct<bucket, key, error> of an s3:// address."""
    rest = F.regexp_extract(_c(c), "^s3://(.*)$", 1)
    ok = F.startswith(_c(c), F.lit("s3://"))
    key = F.regexp_extract(rest, "^[^/]*/(.*)$", 1)
    return F.struct(F.when(ok, F.substring_index(rest, "/", 1)).alias("bucket"), F.when(ok, key).alias("key"), F.when(~F.coalesce(ok, F.lit(False)), F.lit("not an object address")).when(key == "", "Invalid S3 URI format").alias("error"))


def is_video_ext(p: Column | str, exts=VIDEO_EXTENSIONS) -> Column:
    return extension(p).isin(*exts)


def is_audio_ext(p: Column | str, exts=AUDIO_EXTENSIONS) -> Column:
    return extension(p).isin(*exts)


def mime_type(p: Column | str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])[extension(p)], F.lit(DEFAULT_MIME))


def is_video_mime(m: Column) -> Column:
    return m.startswith("video/")


def is_audio_mime(m: Column) -> Column:
    return m.startswith("audio/")


def is_hidden(p: Column | str, mode: str = "all") -> Column:
    """Resource forks (._), with 'all' any name with a leading point, with 'bounced' also outputs of a former run."""
    b = basename(p)
    out = b.startswith("._") if mode == "forks" else b.startswith(".")
    return out | b.endswith("_bounced.mov") if mode == "bounced" else out


def classify_by_keyword(cols: list, rules: list[tuple[str, str]], default: str) -> Column:
    """The code of the first keyword found in the joined columns."""
    t = F.lower(F.concat_ws(" ", *cols))
    out = F.lit(default)
    for word, code in reversed(rules):
        out = F.when(F.contains(t, F.lit(word)), code).otherwise(out)
    return out


def severity_code(name, desc) -> Column:
    return classify_by_keyword([name, desc], [("critical", "CRIT"), ("edge", "EDGE")], "VUB")


def parse_flag(c: Column | str) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("true", "1", "yes", "y"), F.lit(False))


def missing_inputs(has_video: Column, has_audio: Column) -> Column:
    return F.concat_ws("/", F.when(~has_video, "video"), F.when(~has_audio, "audio"))


def pcm_codec(fmt, bits, codec, policy: str) -> Column:
    """The PCM codec for a sample format under one of the policies scene, chunk, bounce."""
    fmt, bits, codec = (F.lower(F.coalesce(_c(x).cast("string"), F.lit(""))) for x in (fmt, bits, codec))
    if policy == "scene":
        return F.when(F.contains(fmt, F.lit("flt")), "pcm_f32le").when(bits == "24", "pcm_s24le").when((bits == "32") & F.contains(fmt, F.lit("s32")), "pcm_s32le").otherwise("pcm_s16le")
    out = F.when(fmt.isin("s16", "s16p"), "pcm_s16le").when(fmt.isin("s24", "s24p"), "pcm_s24le").when(fmt.isin("s32", "s32p"), "pcm_s32le").when(fmt.isin("flt", "fltp"), "pcm_f32le")
    if policy == "bounce":
        return out.when(codec.isin("pcm_s16le", "pcm_s24le", "pcm_s32le", "pcm_f32le"), codec).otherwise("pcm_f32le")
    return out.when(fmt.isin("u8", "u8p"), "pcm_u8").otherwise("pcm_f32le")


def bit_depth(codec: Column) -> Column:
    return F.when(codec == "pcm_u8", "8-bit").when(codec == "pcm_s16le", "16-bit").when(codec == "pcm_s24le", "24-bit").when(codec == "pcm_s32le", "32-bit").otherwise("32-bit float")


def video_codec_args(codec, profile) -> Column:
    p = F.create_map(*[F.lit(x) for kv in PRORES_PROFILES.items() for x in kv])[F.lower(F.coalesce(_c(profile), F.lit("")))]
    return F.when(F.lower(_c(codec)) == "prores", F.concat(F.lit("prores_ks:"), F.coalesce(p, F.lit("3")))).otherwise(_c(codec))


def output_kinds(audio_only: Column, video_only: Column, has_video: Column) -> dict[str, Column]:
    return {"create_video": has_video & ~audio_only, "create_audio": ~video_only | ~has_video}


def job_outcome(status, url, alt) -> Column:
    """struct<state, url>: completed, failed:<why> or pending."""
    s = F.upper(F.coalesce(_c(status), F.lit("")))
    u = F.coalesce(F.nullif(_c(url), F.lit("")), F.nullif(_c(alt), F.lit("")))
    state = F.when((s == "COMPLETED") & u.isNotNull(), "completed").when(s == "COMPLETED", "failed:no_output_url").when(s.isin("FAILED", "REJECTED"), F.concat(F.lit("failed:"), s)).otherwise("pending")
    return F.struct(state.alias("state"), u.alias("url"))


def classify_response(http, body, attempt, storage: bool = False, max_busy: int = 6, max_error: int = 5) -> Column:
    h, a, b = _c(http), _c(attempt), F.lower(F.coalesce(_c(body), F.lit("")))
    if storage:
        return F.when((h >= 200) & (h < 300), "ok").when(h == 409, "conflict").when(a < 4, "retry").otherwise("fatal")
    option = (h == 400) & (F.contains(b, F.lit("active")) | F.contains(b, F.lit("unknown"))) & (a == 0)
    return F.when(h == 201, "created").when((h == 429) & (a < max_busy), "retry").when((h.isNull() | (h >= 500)) & (a < max_error), "retry").when(option, "retry_without_option").otherwise("fatal")


def backoff_seconds(attempt, retry_after=None, kind: str = "request", http=None) -> Column:
    """Seconds to wait: request 2**n up to 30 (or what a 429 asks for), rounds up to 16, storage 1, 2, 4."""
    n = _c(attempt).cast("double")
    if kind == "rounds":
        return F.least(F.lit(30), F.pow(F.lit(2.0), F.least(n, F.lit(4.0))).cast("int"))
    wait = F.pow(F.lit(2.0), n).cast("int") if kind == "storage" else F.least(F.lit(30), F.pow(F.lit(2.0), F.least(n, F.lit(10.0))).cast("int"))
    if retry_after is None:
        return wait
    r = F.when(_c(retry_after).rlike("^[0-9]+$"), _c(retry_after).try_cast("int"))
    return F.coalesce(F.when(_c(http) == 429, r) if http is not None else r, wait)


def detection_options(detect: Column) -> Column:
    """Options of a single request: automatic speaker detection, or none at all."""
    return F.when(detect, F.struct(F.struct(F.lit(True).alias("auto_detect")).alias("active_speaker_detection")))


def batch_options(detect: Column) -> Column:
    """Options of a request of a batch, as they are fixed there; the speaker's only where asked for."""
    return F.struct(F.lit("cut_off").alias("sync_mode"), F.lit(True).alias("occlusion_detection_enabled"), F.when(detect, True).alias("active_speaker"))


def request_payload(video, audio, options: Column, model: str, name=None) -> Column:
    """The JSON of a request; null options are left out."""
    items = F.array(F.struct(F.lit("video").alias("type"), _c(video).alias("url")), F.struct(F.lit("audio").alias("type"), _c(audio).alias("url")))
    fields = [F.lit(model).alias("model"), items.alias("input"), options.alias("options")]
    return F.to_json(F.struct(*fields, *([_c(name).alias("outputFileName")] if name is not None else [])))


def upload_prefix(folder, stamp) -> Column:
    """slug_YYYYMMDDHHMM of a folder's name ('upload' where nothing is left of it) and a time."""
    name = slugify(basename(F.regexp_replace(_c(folder), "/+$", "")))
    return F.concat(F.coalesce(F.nullif(name, F.lit("")), F.lit("upload")), F.lit("_"), F.date_format(_c(stamp), "yyyyMMddHHmm"))


def remote_key(prefix, rel, mode: str = "flat") -> Column:
    return F.regexp_replace(F.concat(_c(prefix), F.lit("/"), basename(rel) if mode == "flat" else _c(rel)), "/{2,}", "/")


def public_url(host: str, bucket: str, key) -> Column:
    return F.concat(F.lit(f"{host.rstrip('/')}/public/{bucket}/"), _c(key))


def sanitize_timecode(tc) -> Column:
    return F.replace(_c(tc), F.lit(":"), F.lit("-"))


def resolution(w, h) -> Column:
    return F.concat(_c(w).cast("string"), F.lit("x"), _c(h).cast("string"))


def size_mb(n) -> Column:
    return _c(n) / F.lit(1024.0 * 1024.0)


def min_sec(sec) -> Column:
    s = F.floor(_c(sec)).cast("bigint")
    return F.format_string("%dm %02ds", F.floor(s / 60).cast("bigint"), F.pmod(s, F.lit(60)))


def clip_name(show: str, index, code, start, end) -> Column:
    return F.when(_c(index).isNotNull(), F.format_string(f"{show}_%04d_%s_%s_%s.mov", _c(index), _c(code), sanitize_timecode(start), sanitize_timecode(end)))


def numbered_name(prefix: str, index, ext: str, width: Column | int = 2) -> Column:
    """prefix, the number filled up to the width (never cut), and the extension."""
    i = _c(index).cast("string")
    return F.concat(F.lit(prefix), F.lpad(i, F.greatest(F.lit(width) if isinstance(width, int) else width, F.length(i)), F.lit("0")), F.lit("." + ext))


def cosine_distance(a, b, guard: float = 1e-10) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = _c(a), _c(b)
    return 1 - dot(a, b) / ((F.sqrt(dot(a, a)) + guard) * (F.sqrt(dot(b, b)) + guard))


def match_pattern(path: Column | str, regex: str | None = None, glob: str | None = None) -> Column:
    """True where the whole path holds the regular expression and the name after its last slash is of the form glob (`*` any characters, `?` one); null never matches."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(True)
    if regex is not None:
        out &= p.rlike(regex)
    if glob is not None:
        form = "".join({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() else "\\" + c) for c in glob)
        out &= F.substring_index(p, "/", -1).rlike(f"(?s)^{form}$")
    return F.coalesce(out, F.lit(False))
