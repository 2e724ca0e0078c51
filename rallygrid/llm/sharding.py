"""Balanced contiguous shards from global prefix sums of sizes.

Documents are put in one global order (id, then size, checksum and place read).
A range exchange gives ordered partitions; only one total for each partition
travels through a window, and each row's prefix sum is its partition's offset
plus a running sum inside the partition.  Cutting the prefix sums at equal
targets gives contiguous shards whose sizes differ by at most one document.

Defined results: no text counts 16 bytes; null ids sort first; repeated rows
each get their own slot; an empty table gives an empty result; a shard stays
empty if one document is larger than a target.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: Bytes that each document costs beside its text.
OVERHEAD = 16


def prefix_sums(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, size, text_crc32, before, place``: bytes and rows that come before each document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("read_at"))
    order = ["doc_id", "size", "text_crc32", "read_at"]
    # Written first: a range exchange samples its input, and must see the same rows when it deals them out.
    sized = written(sized, "sizes")
    part = written(sized.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()), "ranged")
    totals = part.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select("part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("size_before"),
                            F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_before"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (part.withColumns({"run": F.sum("size").over(inside), "nth": F.count("*").over(inside)}).join(offsets, "part")
            .select("doc_id", "size", "text_crc32", (F.col("size_before") + F.col("run") - F.col("size")).alias("before"),
                    (F.col("n_before") + F.col("nth") - 1).alias("place")))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, size, text_crc32, shard, slot``; a document falls where its middle byte falls."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    sums = written(prefix_sums(docs, id_col, text_col), "prefix")
    total = sums.agg(F.max(F.col("before") + F.col("size")).alias("total"))
    cut = sums.crossJoin(F.broadcast(total)).withColumn(  # one row
        "shard", F.least(F.lit(shards - 1), F.floor((2 * F.col("before") + F.col("size")) * shards / (2 * F.col("total")))).cast("int"))
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
