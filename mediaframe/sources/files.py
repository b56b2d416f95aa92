"""Readers and writers of the text formats, file inventories and grouped outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaframe.functions.text import is_hidden
from mediaframe.functions.timecode import parse_cut_time
from mediaframe.operators.ordered import fill_section, kept, number_within, with_ordinal


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) with true line numbers from 0. Files are split; the lines of each split are counted, and a table with a row a split has the lines before it."""
    d = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))
    d = kept(d)
    splits = d.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("_before", F.coalesce(before, F.lit(0)) - F.col("_first")).select(F.col("file").alias("_f"), F.col("_split").alias("_s"), "_before")
    return d.join(splits, (F.col("file") == F.col("_f")) & (F.col("_split") == F.col("_s"))).select("file", (F.col("_id") + F.col("_before")).alias("pos"), "line")


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_spots(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, as they stand in the header, and _ord."""
    d = _csv(spark, path)
    if not d.columns:
        raise ValueError("the event list has no header")
    return with_ordinal(d)


def write_spots(df: DataFrame, path: str) -> None:
    _write_csv(df.orderBy("_ord").drop("_ord"), path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    d = _csv(spark, path)
    return with_ordinal(d.toDF(*[c.strip().lower() for c in d.columns]))


_HEADS = ("VIDEOS", "AUDIOS")


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(file, kind, pos, url) of lines (file, pos, line): sections VIDEOS and AUDIOS in any case, repeated or not; blank lines, lines before a header, hidden names and repeated addresses go. A file of any length is parsed by many tasks."""
    t = F.trim("line")
    head = F.upper(t).isin(*_HEADS)
    d = fill_section(lines.select("file", "pos", "line"), ["file"], "pos", F.when(head, F.lower(F.expr("substring(upper(trim(line)), 1, 5)"))))
    d = d.where(~head & (t != "") & F.col("kind").isNotNull() & ~is_hidden(t, "forks"))
    first = d.select("file", "kind", "pos", t.alias("url")).groupBy("file", "kind", "url").agg(F.min("pos").alias("at"))
    return number_within(first, ["file", "kind"], ["at"], "pos").select("file", "kind", "pos", "url")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(_lines(spark, path))


def write_manifest(df: DataFrame, path: str) -> None:
    """A manifest from (kind, pos, url) as text files whose order by name is that of the lines, so that to put them one after the other gives the manifest; and path/_sections, a line for each section of each file: part, kind, at (its first line's number), pos (the one of that line) and n."""
    rows = df.select(F.when(F.col("kind") == "video", 1).otherwise(4).alias("sec"), F.col("pos").cast("long").alias("pos"), F.col("url").alias("line"))
    heads = df.sparkSession.createDataFrame([(0, 0, "VIDEOS"), (2, 0, ""), (3, 0, "AUDIOS")], "sec int, pos long, line string")
    d = kept(rows.unionByName(heads).repartitionByRange("sec", "pos").sortWithinPartitions("sec", "pos"))
    d.select("line").write.text(path)
    place = F.monotonically_increasing_id()
    d = d.withColumns({"part": F.shiftright(place, 33), "at": place.bitwiseAND((1 << 33) - 1)}).where("sec in (1, 4)")
    d = d.groupBy("part", F.when(F.col("sec") == 1, "video").otherwise("audio").alias("kind")).agg(F.min("at").alias("at"), F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    d.write.json(f"{path}/_sections")


def read_manifest_parts(spark: SparkSession, path: str) -> DataFrame:
    """(kind, pos, url) of a manifest that write_manifest wrote, positions anew from 1: each line by its file's sections, without a look at the lines before."""
    sections = spark.read.schema("part long, kind string, at long, n long").json(f"{path}/_sections").withColumnRenamed("part", "_part")
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    sections = sections.withColumn("before", F.coalesce(before, F.lit(0)))
    lines = _lines(spark, path).withColumn("part", F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")).withColumnRenamed("pos", "line_no")
    d = lines.join(sections, (F.col("part") == F.col("_part")) & (F.col("line_no") >= F.col("at")) & (F.col("line_no") < F.col("at") + F.col("n")))
    return d.select("kind", (F.col("before") + F.col("line_no") - F.col("at") + 1).alias("pos"), F.col("line").alias("url"))


def read_cuts(spark: SparkSession, path: str, fps: float | None = None) -> DataFrame:
    d = _lines(spark, path).where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    part = lambda i: F.regexp_extract("line", r"^\s*(\S+)\s+(\S+)\s+(.*)$", i)
    d = d.select("file", "pos", part(1).alias("name"), part(2).alias("start_raw"), F.trim(part(3)).alias("end_raw")).where("name <> ''")
    return d.withColumns({"start_sec": parse_cut_time("start_raw", fps), "end_sec": parse_cut_time("end_raw", fps)})


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(number, url, bucket, key) of tab-separated lines with an s3:// address."""
    p = F.split("line", "\t")
    d = _lines(spark, path).where(F.size(p) >= 2).select("pos", F.trim(p[0]).alias("number"), F.trim(p[1]).alias("url")).where(F.col("url").startswith("s3://"))
    from mediaframe.functions.text import parse_object_uri

    u = parse_object_uri("url")
    return d.select("pos", "number", "url", u["bucket"].alias("bucket"), u["key"].alias("key"))


def read_job_ids(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows with a job_id of a JSON list or object, or of an object a line as write_results writes them, with _ord."""
    d = spark.read.option("multiLine", not lines).json(path)
    if "job_id" not in d.columns:
        raise ValueError("no job_id in the results")
    return with_ordinal(d.where(F.col("job_id").isNotNull()))


def write_results(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_segments(df: DataFrame, path: str) -> None:
    sec = lambda c: (F.round(F.col(c) * 1000) / 1000).alias(c)  # noqa: E731  # the double's thousandfold is rounded, as in SQL; round(c, 3) rounds its shortest decimal
    _write_csv(df.select("index", sec("start_sec"), sec("end_sec"), "start_tc", "end_tc", sec("duration_sec")), path)


def collect_groups(df: DataFrame, group: str, member: str) -> DataFrame:
    return df.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("members"))


def write_groups(df: DataFrame, path: str, group: str = "group_id", member: str = "clip", long_form: bool = True, most: int | None = None) -> None:
    """One JSON line a group; with most, a line for each so many of its members in order (group, chunk, members), so that a group can be of any size. Or (not long_form) one object of all groups, a line a member in text files whose order by name is that of the lines; null groups and members are left out of it."""
    if long_form and most is None:
        return collect_groups(df, group, member).write.json(path)
    if long_form:
        d = number_within(df.select(group, member), group, [member], "_n").groupBy(group, F.floor((F.col("_n") - 1) / most).alias("chunk"))
        return d.agg(F.array_sort(F.collect_list(member)).alias("members")).write.json(path)
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    d = df.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g is not null and m is not null")
    sizes = d.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    ends = sizes.agg(F.min("g").alias("least"), F.max("g").alias("most"))
    d = kept(number_within(d, "g", ["m"]).join(sizes.withColumnRenamed("g", "_g"), F.col("g") == F.col("_g")))
    begins, stops = F.col("n") == 1, F.col("n") == F.col("size")
    head = F.when(begins, F.concat(F.when(F.col("g") == F.col("least"), "{").otherwise(""), quoted("cast(g as string)"), F.lit(": ["))).otherwise("")
    tail = F.when(~stops, ",").when(F.col("g") == F.col("most"), "]}").otherwise("],")
    d = d.crossJoin(F.broadcast(ends)).select("g", "n", F.concat(head, quoted("m"), tail).alias("value"))
    d.repartitionByRange("g", "n").sortWithinPartitions("g", "n").select("value").write.text(path)


def write_grouped_layout(df: DataFrame, path: str, group: str = "group_id") -> None:
    df.write.partitionBy(group).parquet(path)


def media_inventory(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """Paths, lengths and times of files; contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path", "length", "modificationTime")


def object_listing(inventory: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Objects below a prefix (which gets its last slash); keys that end in a slash are folders and go."""
    prefix = prefix if not prefix or prefix.endswith("/") else prefix + "/"
    return inventory.where(F.col(key).startswith(prefix) & ~F.col(key).endswith("/"))


def read_embeddings(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Vectors in double precision; keys without any keep a null."""
    return df.select(key, F.transform(vec, lambda x: x.cast("double")).alias(vec))
