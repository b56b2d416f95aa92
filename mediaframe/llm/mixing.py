"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

A source is taken in whole passes as often as its target holds its size; the rest of the targets is cut into blocks of
equally many words, which sources get by highest quotients rest / (2k + 1). Documents of a source lie in a seeded order on
a line of words, cut into shards by hash (so that a hot source spreads over many tasks) and these into groups of shards (so
that no apportionment holds more than some thousand rows). A source's blocks are apportioned to its groups and a group's to
its shards the same way, and a shard takes its quota as a seeded, evenly spread choice of its line's blocks. Every sum
stays in integers but for the targets.

Nulls: a null source is a source of its own, last in the order; a null text has size 0; a null doc_id hashes as ''.
Ties in the order are broken by doc_id, size and the text's hash; rows alike in all of these are interchangeable, so reruns
agree in any order of the input. Repeated rows are separate rows. Extra columns don't take part, whatever their names. A
text of any length is counted as a whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.llm._spark import by_merging, checkpointed, row_hash

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources (a row of some numbers each) that are broadcast at most; more are joined by shuffling.
BROADCAST_SOURCES = 1 << 16


def with_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Adds rank and target to rows (source, source_size): weights repeat in the order of sources by code point, null last, and share all of the sizes; a target stops at most times its size and the excess is shared anew by weight.

    The level at which the sharing settles is found in one pass: with sources by size / weight, those up to some point are
    at their limit and the rest share what is left; the right point is the last at which the next source is over its limit.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    one = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = sources.withColumn("rank", F.row_number().over(one) - 1).withColumn("w", w.cast("double"))
    by = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    every = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every),
        "full": F.coalesce(F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "full_w": F.coalesce(F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    })
    level = (F.col("total") - F.lit(most) * F.col("full")) / (F.col("all_w") - F.col("full_w"))
    s = s.withColumn("level", level).withColumn("capped", F.col("w") * level > F.lit(most) * F.col("source_size"))
    free = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("w")).alias("r"), F.col("rank").alias("k"), F.col("level").alias("level")))).over(every)
    s = s.withColumn("free", free)
    target = F.when(F.col("capped"), F.lit(most) * F.col("source_size")).otherwise(F.col("w") * F.col("free.level"))
    return s.select("source", "source_size", "rank", target.cast("double").alias("target"))


def apportion(rows: DataFrame, by: list[str], share: Column, seats: Column, tie: list[str]) -> DataFrame:
    """Adds quota: seats (the same in a group of by) go to rows by the highest quotients share / (2k + 1).

    Each row is given the seats that are certain (its exact share less 2, at least 0); the few left are ranked as
    quotients, of which each row offers four more than its exact share.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    r = rows.withColumns({"_share": share.cast("double"), "_seats": seats.cast("long")})
    r = r.withColumn("_exact", F.coalesce(F.try_divide(F.col("_seats") * F.col("_share"), F.sum("_share").over(group)), F.lit(0.0)))
    r = r.withColumn("_base", F.greatest(F.floor("_exact") - 2, F.lit(0)).cast("long"))
    r = r.withColumn("_left", F.col("_seats") - F.sum("_base").over(group)).withColumn("_id", F.struct(*tie))
    offer = r.where("_share > 0").select(*by, "_id", "_left", F.col("_share"), F.explode(F.sequence(F.col("_base"), F.ceil("_exact") + 3)).alias("_k"))
    order = Window.partitionBy(*by) if by else Window.partitionBy()
    offer = offer.withColumn("_n", F.row_number().over(order.orderBy(F.desc(F.col("_share") / (2 * F.col("_k") + 1)), "_id", "_k")))
    won = offer.where("_n <= _left").groupBy("_id").agg(F.count(F.lit(1)).alias("_won"))
    joined = r.join(won.withColumnRenamed("_id", "_won_id"), F.col("_id").eqNullSafe(F.col("_won_id")), "left")
    return joined.withColumn("quota", F.col("_base") + F.coalesce("_won", F.lit(0))).drop("_share", "_seats", "_exact", "_base", "_left", "_id", "_won", "_won_id")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 64, shard_docs: int = 2048, group: int = 4096, seed: str = "mix-1", row: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the terms (line_start, passes, extra, blocks, turn) by which mixed_texts() cuts the text.

    row: a column, returned too, that breaks further ties in the order. taken never exceeds most times the size. A source's taken words differ from its target by a block or so for each shard.
    """
    own = [row] if row else []
    hashed = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), hashed))
    d = docs.select("doc_id", "source", *own, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    d = checkpointed(d)  # texts are read once
    sources = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = with_targets(sources.select("source", "source_size"), weights, most).join(
        sources.select(F.col("source").alias("s"), F.ceil(F.col("n_docs") / shard_docs).cast("long").alias("shards")), F.col("source").eqNullSafe(F.col("s")))
    s = s.drop("s").withColumn("passes", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    s = apportion(s.withColumn("rest", rest), [], F.col("rest"), F.floor(F.sum("rest").over(Window.partitionBy()) / block + F.lit(0.5)), ["rank"])
    s = checkpointed(s.select(F.col("source").alias("_s"), "source_size", "target", "rank", "shards", "passes", F.col("quota").alias("source_quota")))
    few = F.broadcast(s) if s.count() <= BROADCAST_SOURCES else by_merging(s)
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    d = d.join(few, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("shard", number % F.col("shards"))
    line = Window.partitionBy("rank", "shard").orderBy("key", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("line_end", F.sum("size").over(line)).withColumn("line_start", F.col("line_end") - F.col("size"))
    shards = d.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota")).withColumn("group", F.expr(f"shard div {group}"))
    groups = shards.groupBy("rank", "group").agg(F.sum("shard_size").alias("group_size"), F.first("source_quota").alias("source_quota"))
    groups = apportion(groups, ["rank"], F.col("group_size"), F.col("source_quota"), ["rank", "group"]).select("rank", "group", F.col("quota").alias("group_quota"))
    shards = apportion(shards.join(groups, ["rank", "group"]), ["rank", "group"], F.col("shard_size"), F.col("group_quota"), ["rank", "shard"])
    blocks = F.ceil(F.col("shard_size") / block).cast("long")
    turn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("rank"), F.col("shard"))), 1, 6), 16, 10).cast("long")
    shards = shards.select(F.col("rank").alias("r"), F.col("shard").alias("h"), blocks.alias("blocks"), F.least("quota", blocks).alias("extra"), F.coalesce(F.try_mod(turn, blocks), F.lit(0)).alias("turn"))
    d = d.join(shards, (F.col("rank") == F.col("r")) & (F.col("shard") == F.col("h"))).drop("r", "h")

    def before(x: str) -> Column:  # words of the extra blocks on the line before x
        return F.expr(f"CASE WHEN blocks = 0 THEN 0 ELSE ((({x} div {block}) + turn) * extra div blocks) * {block} + ({x} % {block}) * (((({x} div {block}) + turn + 1) * extra div blocks) - ((({x} div {block}) + turn) * extra div blocks)) END")

    taken = F.col("passes") * F.col("size") + before("line_end") - before("line_start")
    return d.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard", "line_start", "passes", "extra", "blocks", "turn", *own)


def mixed_texts(docs: DataFrame, block: int = 64, **how) -> DataFrame:
    """docs as the mix takes them, the same columns: documents of which nothing is taken go, others hold their whole text once a pass and then the words of their chosen blocks; n_chars follows. Texts taken exactly once stay as they are. Names that begin with `_mx_` are reserved."""
    rows = docs.withColumn("_mx_row", row_hash(docs))
    m = mix(rows, block=block, row="_mx_row", **how).where("taken > 0").select("_mx_row", *(F.col(c).alias(f"_mx_{c}") for c in ("size", "taken", "line_start", "passes", "extra", "blocks", "turn")))
    d = rows.dropDuplicates(["_mx_row"]).join(m, "_mx_row")  # of equal rows each has its own row in m
    more = F.expr("_mx_taken > _mx_passes * _mx_size")
    d = d.withColumn("_mx_words", F.when(more, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)))
    chosen = F.expr(f"filter(_mx_words, (w, i) -> (((_mx_line_start + i) div {block}) + _mx_turn + 1) * _mx_extra div _mx_blocks > (((_mx_line_start + i) div {block}) + _mx_turn) * _mx_extra div _mx_blocks)")
    text = F.concat_ws("\n", F.array_repeat(F.col("text"), F.col("_mx_passes").cast("int")), F.when(more, F.array_join(chosen, " ")))
    out = d.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
