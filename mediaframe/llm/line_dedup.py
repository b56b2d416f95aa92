"""Dropping recurring line templates with a log-template tree of fixed depth, in DataFrame functions only.

A line's tokens are what single blanks separate after trimming (tabs and the like count as blanks); a token with a digit
is a variable field, `<*>`. The tree's path of a line is its number of tokens and its first `depth` tokens. In a leaf, a
token stays in the template if at least `min_docs` lines of the leaf have it at that place; any other becomes `<*>`.
A template recurs if at least `min_docs` documents have it and at least `min_constant` of its tokens are constant; its
lines are dropped wherever they stand. Lines of fewer than `min_tokens` tokens take part if all of their tokens are
constant and they are not blank (without `short` they are left alone). With `keep_first` a template's lines stay in its
document of smallest doc_id (null last, then the smallest key), so that of copies one stays whole.

The tree is never held in one place: leaves, supports and templates are counted by hash-partitioned, partially
aggregated jobs, and only leaves with enough lines go on to the token level. What recurs is written before it is joined
to the lines, so that Spark broadcasts it where it is small and else splits the partitions of frequent keys.

Nulls and ties: a null text has no lines and stays null; an empty text has one empty line, which stays. Rows equal in
doc_id and text count as one document and get the same result; a null doc_id is a value like any other. Other columns
are passed through whatever their names (names that begin with `_ld_` are reserved). An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.llm._spark import checkpointed


def _masked(line: Column) -> Column:
    flat = F.trim(F.translate(line, "\t\x0b\x0c\r", "    "))
    return F.when(flat.rlike("[0-9]"), F.regexp_replace(flat, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(flat)


def _leaf(tokens: Column, depth: int) -> Column:
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, depth))


def recurring_lines(docs: DataFrame, min_docs: int = 8, depth: int = 4, min_tokens: int = 4, min_constant: float = 0.6, short: bool = True, keep_first: bool = False) -> DataFrame:
    """Rows (_ld_k, _ld_drop): the key of a document (hash of doc_id and text) and the places of its lines to drop."""
    order = ["_ld_o"] if keep_first else []
    d = docs.select(F.xxhash64("doc_id", "text").alias("_ld_k"), "text", *(F.col("doc_id").alias(x) for x in order)).where("text is not null")
    lines = d.select("_ld_k", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    toks = lines.select("_ld_k", "pos", F.split(_masked(F.col("line")), " ").alias("t"))
    long_enough = F.size("t") >= min_tokens
    if short:
        long_enough |= ~F.array_contains("t", "<*>") & (F.element_at("t", 1) != "")
    leaf = checkpointed(toks.where(long_enough).select("_ld_k", "pos", _leaf(F.col("t"), depth).alias("leaf")))
    wide = checkpointed(leaf.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf"))
    places = leaf.join(wide, "leaf").groupBy("_ld_k").agg(F.collect_set("pos").alias("at"))
    text = d.join(places, "_ld_k").select("_ld_k", *order, F.split("text", "\n").alias("l"), F.explode("at").alias("pos")).dropDuplicates(["_ld_k", "pos"])
    text = text.withColumn("t", F.split(_masked(F.element_at("l", F.col("pos") + 1)), " "))
    cand = checkpointed(text.select("_ld_k", "pos", *order, _leaf(F.col("t"), depth).alias("leaf"), F.transform("t", lambda x: F.when(x != "<*>", F.xxhash64(x))).alias("t")))
    tokens = cand.select("_ld_k", "pos", "leaf", F.posexplode("t").alias("p", "x"))
    support = tokens.where("x is not null").groupBy("leaf", "p", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    kept = tokens.join(checkpointed(support.select("leaf", "p", "x")), ["leaf", "p", "x"])
    templates = kept.groupBy("_ld_k", "pos").agg(F.first("leaf").alias("leaf"), F.array_sort(F.collect_list(F.struct("p", "x"))).alias("c"))
    size = cand.select(F.col("_ld_k").alias("k2"), F.col("pos").alias("pos2"), F.size("t").alias("n"), *order)
    templates = templates.join(size, (F.col("_ld_k") == F.col("k2")) & (F.col("pos") == F.col("pos2")))
    least = F.when(F.col("n") < min_tokens, F.col("n")).otherwise(F.col("n") * min_constant)
    templates = checkpointed(templates.where(F.size("c") >= least).select("_ld_k", "pos", F.xxhash64("leaf", "c").alias("tpl"), *order))
    first = [F.min(F.struct(F.col(x).isNull(), x, "_ld_k"))["_ld_k"].alias("_ld_first") for x in order]
    often = templates.select("tpl", "_ld_k", *order).distinct().groupBy("tpl").agg(F.count(F.lit(1)).alias("n"), *first).where(F.col("n") >= min_docs).drop("n")
    hits = templates.join(checkpointed(often), "tpl")
    if keep_first:
        hits = hits.where("_ld_k <> _ld_first")
    return hits.groupBy("_ld_k").agg(F.collect_set("pos").alias("_ld_drop"))


def drop_recurring_lines(docs: DataFrame, most: float = 1.0, **how) -> DataFrame:
    """docs, same columns, without the recurring lines, plus _ld_lines and _ld_dropped (counts); n_chars, where there is one, follows.

    A document whose recurring lines hold more than the share `most` of its characters is left as it is: such a document
    is a copy rather than one with boilerplate, and is left to document-level deduplication.
    """
    drop = recurring_lines(docs, **how)
    d = docs.withColumn("_ld_k", F.xxhash64("doc_id", "text")).join(drop, "_ld_k", "left")
    lines = F.split("text", "\n")
    rest = F.filter(lines, lambda x, i: ~F.array_contains("_ld_drop", i))
    text = F.when(F.col("_ld_drop").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    d = d.withColumn("_ld_text", text)
    ok = F.length("_ld_text") >= F.length("text") * (1 - most)
    d = d.withColumn("_ld_drop", F.when(ok, F.col("_ld_drop"))).withColumn("_ld_text", F.when(ok, F.col("_ld_text")).otherwise(F.col("text")))
    d = d.withColumn("_ld_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("_ld_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("_ld_lines")).cast("long"))
    d = d.withColumn("_ld_dropped", F.coalesce(F.size(F.coalesce("_ld_drop", F.array().cast("array<int>"))), F.lit(0)).cast("long"))
    d = d.withColumn("text", F.col("_ld_text"))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns, "_ld_lines", "_ld_dropped")
