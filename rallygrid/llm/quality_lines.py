"""Quality rules with the frequency of lines across a host's documents.

Counts of a text (words, symbols, repeated lines and words) come from array
functions inside its row.  Lines are normalised (A-Z lower-cased, blanks in a row
as one, digits as 0), hashed, and counted by distinct document of their host.  A
line above the limits is removed from all documents of the host but the first
that passes the base rules (the smallest id), so a passage doesn't vanish with
its copies.  A document that
loses too much is depleted and rejected, as is one that fails the base rules.

A line is above the limits in more than ``least`` documents and more than
``share`` percent of the host's documents, and in more than ``most`` documents however large the host is.

Defined results: no text counts as empty (it fails the base rules); a null host
is a host of its own; rows that share an id are one document; rows with a null id
are counted as one document and judged like others; an empty table gives an
empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, ascii_lower, words, written

#: A line is too frequent in more than LEAST documents and more than SHARE percent of the host's, and in more than MOST documents of any host.
LEAST, SHARE, MOST = 20, 1, 1000
#: A document is depleted that keeps fewer words than MIN_WORDS or loses more than LOST percent.
MIN_WORDS, LOST = 50, 50
#: Base rule: more than this percentage of words in repeated windows of three.
REPEATED = 50


def repeated_words(ws: Column) -> Column:
    """Words in windows of three that occur twice or more; ``ws`` must be a stored column.

    Windows are hashed and sorted with their places, so equal ones are neighbours; their places, sorted, cover
    three words each but for what they share with the next.
    """
    windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(
        F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("at"))))
    return F.when(F.size(ws) < 3, F.array().cast("array<struct<h:bigint,at:int>>")).otherwise(windows)


def line_norm(line: Column) -> Column:
    return F.regexp_replace(ascii_lower(F.trim(F.regexp_replace(line, BLANKS, " "))), "[0-9]+", "0")


def base_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row for each document: its counts, hashes of its lines and the words in each line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    step = step.withColumns({"ws": words(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))})
    step = step.withColumns({"windows": repeated_words(F.col("ws"))})
    same = lambda a, i: F.get("windows", i).getField("h") == a.getField("h")
    step = step.withColumn("places", F.array_sort(F.transform(F.filter("windows", lambda a, i: F.coalesce(same(a, i - 1), F.lit(False)) | F.coalesce(same(a, i + 1), F.lit(False))), lambda a: a["at"])))
    cover = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, p: F.struct(
        (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    return step.select(
        "doc_id", "host", F.xxhash64("text").alias("mark"), F.size("ws").cast("long").alias("n_words"), F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        cover.cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(line_norm(x)).alias("h"), F.size(words(x)).alias("n"))).alias("lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def frequent_lines(counted: DataFrame, least: int = LEAST, share: int = SHARE, most: int = MOST) -> DataFrame:
    """Lines above the limits: ``host, h, n_docs, first_doc``."""
    # A row for each line and document, summed on the map side, so that a host or line of any size spreads.
    seen = counted.select("host", "doc_id", (~base_failed()).alias("good"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    once = seen.groupBy("host", "h", "doc_id").agg(F.max("good").alias("good"))
    lines = once.groupBy("host", "h").agg(F.count("*").alias("n_docs"), F.min(F.when(F.col("good"), F.col("doc_id"))).alias("first_doc")).where(F.col("n_docs") > least)
    hosts = counted.groupBy("host").agg(F.countDistinct("doc_id").alias("host_docs"))
    over = lines.join(hosts, lines["host"].eqNullSafe(hosts["host"])).where((F.col("n_docs") * 100 > F.col("host_docs") * share) | (F.col("n_docs") > most))
    return over.select(lines["host"], "h", "n_docs", "first_doc")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = LEAST, share: int = SHARE, most: int = MOST) -> DataFrame:
    """Base counts, ``base_failed``, ``n_lost_words``, ``lost_lines`` (hashes to remove) and ``kept`` for each row."""
    counted = written(base_counts(docs, id_col, text_col, host_col), "counted")
    over = written(frequent_lines(counted, least, share, most), "frequent")
    # Few documents hold such lines: only their line hashes travel, and only by host and line.
    rows = counted.select("doc_id", "host", F.explode("lines").alias("l")).select("doc_id", "host", "l.h", "l.n").distinct()
    hit = rows.join(over.withColumnRenamed("host", "over_host"), F.col("host").eqNullSafe(F.col("over_host")) & (rows["h"] == over["h"])).where(
        ~F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("doc_id", "host", rows["h"].alias("h"))
    lost = hit.groupBy("doc_id", "host").agg(F.collect_set("h").alias("gone")).select(F.col("doc_id").alias("lost_doc"), F.col("host").alias("lost_host"), "gone")
    both = counted.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_doc")) & F.col("host").eqNullSafe(F.col("lost_host")), "left")
    n_lost = F.coalesce(F.aggregate("lines", F.lit(0), lambda s, x: s + F.when(F.array_contains("gone", x["h"]), x["n"]).otherwise(0)), F.lit(0)).cast("long")
    failed = base_failed()
    depleted = (F.col("n_lost_words") > 0) & ((F.col("n_words") - F.col("n_lost_words") < MIN_WORDS) | (100 * F.col("n_lost_words") > LOST * F.col("n_words")))
    return both.withColumn("n_lost_words", F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n_lost)).select(
        "doc_id", "host", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_lost_words",
        F.col("gone").alias("lost_lines"))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose hashes are in ``gone``."""
    left = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(gone, F.xxhash64(line_norm(x)))))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def filtered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` without rejected rows, and without lines above the limits in those kept; other columns stay."""
    told = judge(docs, id_col, text_col, host_col).where("not kept or lost_lines is not null").select(
        F.col("doc_id").alias("_told_id"), F.col("host").alias("_told_host"), F.col("mark").alias("_told_mark"), F.col("kept").alias("_told_kept"), "lost_lines").distinct()
    told = written(told.withColumnRenamed("lost_lines", "_told_lines"), "told")
    text = F.col(text_col)
    same = (F.col(id_col).cast("long").eqNullSafe(F.col("_told_id")) & F.col(host_col).cast("string").eqNullSafe(F.col("_told_host"))
            & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_told_mark")))
    return docs.join(told, same, "left").where(F.coalesce("_told_kept", F.lit(True))).withColumn(text_col, without_lines(text, F.col("_told_lines"))).select(*docs.columns)
