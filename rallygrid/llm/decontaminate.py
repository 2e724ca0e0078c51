"""Benchmark passages in documents by size-partitioned MinHash containment.

An item is sketched by its smallest shingle hashes.  A document that holds at
least 75 % of an item's n shingles misses at most n // 4 of them, so it holds one
of any n // 4 + 1: a sketch of that many minima never misses, however long the
document is.  Items are partitioned by size in powers of two; a partition's
sketches have one length and lie below one ceiling, and a document's shingle is
looked up only in partitions whose ceiling it stays below.  Candidates are
confirmed on the shingles themselves.

Words are lower-cased and cut at ASCII blanks; a shingle is five of them.

Defined results: items and documents without five words match nothing; rows that
share a document id are one document (the best of its texts counts), rows that
share an item id are one item (all its texts' shingles); null ids and null texts
match nothing; an empty table on either side gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words, written

#: Words in a shingle; least percentage of an item's shingles.
WORDS, CONTAINED = 5, 75


def starts(ws: Column) -> Column:
    """Places of the shingles of a word array."""
    return F.when(F.size(ws) >= WORDS, F.sequence(F.lit(0), F.size(ws) - WORDS)).otherwise(F.array().cast("array<int>"))


def hashes(ws: Column) -> Column:
    return F.transform(starts(ws), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WORDS)]))


def shingles(ws: Column) -> Column:
    return F.transform(starts(ws), lambda i: F.array_join(F.slice(ws, i + 1, WORDS), " "))


def item_sketches(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Items with their shingles; sketch rows ``part, ceiling, item_id, h``."""
    ws = items.select(F.col(id_col).cast("long").alias("item_id"), words(F.lower(F.col(text_col))).alias("ws")).where("item_id is not null")
    both = ws.select("item_id", F.explode(F.arrays_zip(shingles(F.col("ws")).alias("s"), hashes(F.col("ws")).alias("h"))).alias("z"))
    # A benchmark item's own shingles make one bounded row.
    whole = written(both.groupBy("item_id").agg(F.collect_set("z.s").alias("shingles"), F.array_sort(F.collect_set("z.h")).alias("hashes")), "items")
    n = F.size("shingles")
    part = F.floor(F.log2(n)).cast("int")
    sketch = whole.select("item_id", part.alias("part"), F.slice("hashes", 1, F.least(n, F.floor(F.pow(F.lit(2.0), part + 1) / 4).cast("int") + 1)).alias("low"))
    ceilings = sketch.groupBy("part").agg(F.max(F.array_max("low")).alias("ceiling"))
    rows = sketch.join(ceilings, "part").select("part", "ceiling", "item_id", F.explode("low").alias("h"))
    return whole.select("item_id", "shingles"), written(rows, "minima")


def candidates(texts: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs ``doc_id, item_id`` that share a minimum."""
    # One row for each size class; a document's hashes pass those ceilings that they stay below.
    parts = sketch.select("part", "ceiling").distinct().agg(F.max("ceiling").alias("highest"), F.collect_list(F.struct("part", "ceiling")).alias("parts"))
    hashed = texts.select("doc_id", hashes(F.col("ws")).alias("hs")).crossJoin(F.broadcast(parts))  # one row of at most 32 classes
    probes = hashed.select("doc_id", "parts", F.explode(F.filter("hs", lambda h: h <= F.col("highest"))).alias("h"))
    found = probes.join(sketch.select("part", "h", "item_id"), "h")
    return found.where(F.exists("parts", lambda p: (p["part"] == F.col("part")) & (F.col("h") <= p["ceiling"]))).select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                 contained: int = CONTAINED) -> DataFrame:
    """Rows ``doc_id, item_id, n_item, n_shared`` where a document holds at least ``contained`` percent of an item's shingles."""
    if contained < CONTAINED:
        raise ValueError(f"sketches are made for at least {CONTAINED} percent")
    whole, sketch = item_sketches(items, item_id_col, item_text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col)).alias("body")).where("doc_id is not null and body is not null")
    pairs = written(candidates(texts.select("doc_id", words(F.col("body")).alias("ws")), sketch), "candidates")
    # One row for each candidate document; the text is cut into shingles once for all its items.
    lists = pairs.join(whole, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shingles")).alias("items"))
    own = texts.join(lists, "doc_id").select("doc_id", "items", words(F.col("body")).alias("ws")).select("doc_id", "items", shingles(F.col("ws")).alias("own"))
    shared = own.select("doc_id", F.explode(F.transform("items", lambda x: F.struct(
        x["item_id"].alias("item_id"), F.size(x["shingles"]).alias("n_item"), F.size(F.array_intersect(x["shingles"], F.col("own"))).alias("n_shared")))).alias("m"))
    best = shared.groupBy("doc_id", "m.item_id").agg(F.first("m.n_item").cast("long").alias("n_item"), F.max("m.n_shared").cast("long").alias("n_shared"))
    return best.where(100 * F.col("n_shared") >= contained * F.col("n_item"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark item; columns stay."""
    hit = written(contaminated(docs, items, id_col, text_col).select(F.col("doc_id").alias("_hit_id")).distinct(), "hit")
    return docs.join(hit, F.col(id_col).cast("long") == F.col("_hit_id"), "left_anti")
