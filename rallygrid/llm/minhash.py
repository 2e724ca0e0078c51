"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of hash groups are computed for each text.  A table's key
joins one group of the first with one of the second, so ``groups ** 2`` tables
cost only ``2 * groups * depth`` minhashes.  With 16 groups of 2 a pair at the
similarity of 0.75 meets in some table except once in 250,000 pairs.

1. Texts with one shingle set are one node, its smallest document.
2. Groups that only one node has are dropped before keys are formed.
3. In each bucket one node (that shares most groups, then the smallest) is
   compared with all others; then what still holds several components is
   opened: pairs across components that lengths, 512 four-bit
   minhashes and counts of shingles don't rule out.  A node's shingles are counted in two parts, those of the most supported
   node near it (its hub) and others that some open node has too; two nodes of one hub share no more than
   the smaller counts of each part.  A text that lost much of what its group has in common can't make up
   for it, so a group of copies costs rows in proportion to its size, and no bucket is capped.
4. Every pair is confirmed on its full shingle sets before it links.

Defined results: no words, no text or no id link with nothing (component: the
document itself); rows that share an id are one document and are linked by any
of its texts; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import map_arrow, written
from .components import components

#: Words in a shingle; groups in each collection; minhashes in a group.
WORDS, GROUPS, DEPTH = 5, 16, 2
HASHES = 2 * GROUPS * DEPTH
#: Four-bit minhashes of nodes that pairs across components are made of, and their least agreement.  A pair at 0.75
#: agrees in 392 (standard deviation 9.6) and falls below the least once in 50 million.
FINE, AGREE = 512, 339
_SEEDS = rolling.mix(np.arange(1, 2 * (HASHES + FINE) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1, 1)
_XOR, _TIMES = _SEEDS[0], _SEEDS[1] | np.uint64(1)


def lowered(text: str) -> bytes:
    return text.encode().lower()  # bytes: A-Z only


def minhashes(shingles: np.ndarray, first: int, end: int) -> np.ndarray:
    """Minima of the hashes from ``first`` to ``end``."""
    low = np.full(end - first, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, ((shingles[None, at:at + 2048] ^ _XOR[first:end]) * _TIMES[first:end]).min(axis=1))
    return low


def fine_bits(shingles: np.ndarray) -> np.ndarray:
    """Four bits of each of FINE minhashes: four longs for every 64 of them, one for each bit."""
    top = (minhashes(shingles, HASHES, HASHES + FINE) >> np.uint64(40)).astype(np.uint8).reshape(-1, 64)
    return np.stack([np.packbits((top >> b) & 1, axis=1).view("<i8")[:, 0] for b in range(4)], axis=1).ravel()


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int = WORDS) -> DataFrame:
    """Rows ``doc_id, n_shingles, digest`` (of the whole set)``, minhash`` (HASHES ints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    s = rolling.shingles(lowered(text or ""), k)
                    top = (minhashes(s, 0, HASHES) >> np.uint64(32)).astype(np.uint32)
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), top.view(np.int32)))
                n, digest, low = zip(*rows, strict=True) if rows else ((),) * 3
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                                  pa.array(low, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "digest", "minhash"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, (
        "doc_id long, n_shingles long, digest binary, minhash array<int>"))


def shared_groups(nodes: DataFrame) -> DataFrame:
    """Rows ``node, n_shingles, support, first, second``: the groups of each collection that other nodes have too."""
    group = F.transform(F.sequence(F.lit(0), F.lit(2 * GROUPS - 1)), lambda g: F.struct(
        (g < GROUPS).alias("is_first"), F.xxhash64(g, *[F.get("minhash", g * DEPTH + d) for d in range(DEPTH)]).alias("key")))
    keys = nodes.select("node", F.explode(group).alias("g")).select("node", "g.is_first", "g.key")
    common = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    kept = keys.join(common, "key").groupBy("node").agg(
        F.sum("n").alias("support"), F.collect_list(F.when(F.col("is_first"), F.col("key"))).alias("first"),
        F.collect_list(F.when(~F.col("is_first"), F.col("key"))).alias("second"))
    return kept.where("size(first) > 0 and size(second) > 0").join(nodes.select("node", "n_shingles"), "node")


def tables(groups: DataFrame) -> DataFrame:
    """Rows ``bucket, node, support, n_shingles``: a key for each pair of a node's groups; those met once are gone."""
    pairs = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a, b))))
    return groups.select(F.explode(pairs).alias("bucket"), "node", "support", "n_shingles")


def near(a: str, b: str) -> Column:
    """Whether set sizes allow the similarity."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * 75)


def agree(a: Column, b: Column) -> Column:
    """Whether enough of the fine minhashes are equal in all their bits."""
    differ = []
    for at in range(0, FINE // 16, 4):
        x = [a[at + i].bitwiseXOR(b[at + i]) for i in range(4)]
        differ.append(F.bit_count(x[0].bitwiseOR(x[1]).bitwiseOR(x[2]).bitwiseOR(x[3])))
    return F.lit(FINE) - sum(differ[1:], differ[0]) >= AGREE


def stars(buckets: DataFrame) -> DataFrame:
    """Pairs of each bucket's most supported node with the others."""
    # The largest support, then the smallest node; one struct so that the maximum aggregates partially.
    top = buckets.groupBy("bucket").agg(F.max(F.struct("support", (-F.col("node")).alias("minus"), "n_shingles")).alias("top"), F.count("*").alias("n")).where("n > 1")
    hub = top.select("bucket", (-F.col("top.minus")).alias("hub"), F.col("top.n_shingles").alias("hub_n"))
    return buckets.join(hub, "bucket").where(F.col("node") != F.col("hub")).where(near("n_shingles", "hub_n")).select(
        F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def solid(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int = WORDS) -> DataFrame:
    """Rows ``node, hub, inner, outer, fine`` of ``nodes`` (``node, hub``): a node's shingles that another of them has too, those that
    its hub has and the others, and its fine minhashes."""
    hubs = nodes.select(F.col("hub").alias("node")).distinct()
    wanted = nodes.select("node", "hub").union(hubs.join(nodes, "node", "left_anti").select("node", F.lit(None).cast("long")))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("body")).where("body is not null").join(wanted, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [rolling.shingles(lowered(t), k) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64())),
                                                  pa.array([fine_bits(s) for s in own], pa.list_(pa.int64()))], names=["node", "hub", "own", "fine"])

    sets = written(map_arrow(texts.select("node", "hub", "body"), run, "node long, hub long, own array<long>, fine array<long>"), "sets")
    each = sets.where("hub is not null").select("node", "hub", F.explode("own").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # Keyed by shingle too, so what a hub has is dealt over all tasks.
    held = sets.join(hubs, "node").select(F.col("node").alias("hub"), F.explode("own").alias("h"), F.lit(True).alias("in_hub"))
    counts = each.join(common, "h").join(held, ["hub", "h"], "left").groupBy("node").agg(F.count("in_hub").alias("inner"), F.count_if(F.col("in_hub").isNull()).alias("outer"))
    return counts.join(sets.select("node", "hub", "fine"), "node")


def across(groups: DataFrame, labels: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs of different components that share a group of the first collection, if no bound rules them out.

    These are all pairs that share a table, and some more.

    A pair shares at most the shingles that each has in common with any node, so two texts that differ from all
    others in their own ways are no pair: members of a group that are too far from each other aren't paired.
    """
    all_keys = groups.select("node", "support", F.explode("first").alias("key"))
    keys = all_keys.join(labels, "node", "left").select("key", "node", "support", F.coalesce("component", "node").alias("component"))
    order = F.struct("support", (-F.col("node")).alias("minus"))  # the largest support, then the smallest node
    mixed = keys.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(order).alias("top")).where("low < high").select("key", "top")
    rows = written(keys.join(mixed, "key").select("key", "node", "component", "top"), "mixed")
    open_nodes = written(rows.groupBy("node").agg((-F.max("top")["minus"]).alias("hub")), "open")
    counts = solid(open_nodes, docs, id_col, text_col).withColumn("solid", F.col("inner") + F.col("outer"))
    able = written(counts.join(groups.select("node", "n_shingles", "first"), "node").where("100 * solid >= 75 * n_shingles"), "solid")
    rows = rows.drop("top").join(able, "node")
    u, v = rows.alias("u"), rows.alias("v")
    low = F.when(F.col("u.hub") == F.col("v.hub"), F.least("u.inner", "v.inner") + F.least("u.outer", "v.outer")).otherwise(F.least("u.solid", "v.solid"))
    meets = (F.col("u.key") == F.col("v.key")) & (F.col("u.node") < F.col("v.node")) & (F.col("u.component") != F.col("v.component"))
    bound = 100 * low >= 75 * (F.col("u.n_shingles") + F.col("v.n_shingles") - low)
    # A pair may share many groups; it comes out of the first of them alone.
    once = F.get(F.array_intersect("u.first", "v.first"), F.lit(0)) == F.col("u.key")
    return u.join(v, meets & near("u.n_shingles", "v.n_shingles") & bound & agree(F.col("u.fine"), F.col("v.fine")) & once).select(
        F.col("u.node").alias("u"), F.col("v.node").alias("v"))


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int = WORDS) -> DataFrame:
    """The pairs ``u, v`` whose full sets have 100 * intersection >= 75 * union."""
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("body")).where("body is not null")
    wide = pairs.join(texts.select(F.col("node").alias("u"), F.col("body").alias("a")), "u").join(
        texts.select(F.col("node").alias("v"), F.col("body").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep, sets = [], {}  # one text meets several others
                for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    x, y = (sets[t] if t in sets else sets.setdefault(t, rolling.shingles(lowered(t), k)) for t in (a, b))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= 75 * (len(x) + len(y) - both) and both > 0)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(wide, run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id``, one for each row of ``docs``."""
    base = written(sketches(docs, id_col, text_col), "sketches")
    # One set, one sketch: any row's will do.
    nodes = written(base.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("minhash").alias("minhash")), "nodes")
    groups = written(shared_groups(nodes), "groups")
    buckets = tables(groups)
    links = written(confirm(stars(buckets), docs, id_col, text_col), "links")
    more = written(confirm(across(groups, components(links), docs, id_col, text_col), docs, id_col, text_col), "links")
    labels = components(links.union(more))
    found = nodes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    own = base.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return own.join(found, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that a near-duplicate of a smaller id stands for; columns stay."""
    gone = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(written(gone, "gone"), F.col(id_col).cast("long") == F.col("_gone_id"), "left_anti")
