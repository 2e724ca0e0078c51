"""Merkle manifest of a dataset: a root hash, and for each row the proof that it belongs to it.

A row's leaf digests its columns, each as its UTF-8 byte count and value, so no two
rows spell alike.  Leaves stand in groups (languages), ascending by id; runs of
``fanout`` nodes become their digest until one, the group's subroot, is left, and
subroots become the root the same way.

Ranks come from a range exchange and one count for each range.  They cut a group
into aligned blocks of a power of ``fanout`` leaves, so that each block's root is
a node of the tree.  Upper levels are a butterfly exchange: in a round, the blocks
below each node swap it with the blocks below its siblings, one to one, and all hash
the parent.  After the last round every block holds the subroot and its own
proof above the block; nothing is sent down.  Where the last subtree is smaller than
its siblings, its blocks take turns in answering.  Then each block proves its leaves.

Defined results: rows of equal id stand in order of their leaves, null ids first; rows that
are equal throughout are leaves of their own; the null group comes first; columns beyond those
named are not digested; an empty table has no rows and no root.
"""
from __future__ import annotations

import hashlib
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, shuffle_partitions, written

#: What a leaf digests, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a block, for fanout 2; at most this many meet in one group.
BLOCK = 4096
#: Rounds of the exchange between two cuts of the lineage.
ROUNDS_APIECE = 8


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelled(value: Column) -> Column:
    """A value's UTF-8 byte count and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[spelled(v) for v in values]), 256)


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank``, each row's place (from 0) in its group, and ``n``, the group's rows.

    ``order`` has to tell all rows apart: equal rows can't be cut into ranges.
    """
    part = written(df.repartitionByRange(shuffle_partitions(df.sparkSession), group, *order).withColumn("part", F.spark_partition_id()), name)
    counts = part.groupBy(F.col(group).alias("g"), F.col("part").alias("p")).agg(F.count("*").alias("k"))
    own = Window.partitionBy("g")  # a row for each range that holds rows of the group
    ahead = own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("g", "p", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("before"), F.sum("k").over(own).alias("n"))
    nth = F.row_number().over(Window.partitionBy("part", group).orderBy(*order)) - 1
    return (part.withColumn("nth", nth).join(counts, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
            .withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "g", "p", "before"))


def levels_up(nodes: list[str], fanout: int, depth: int) -> list[list[str]]:
    """The nodes of a block, level by level, ``depth`` levels up."""
    out = [nodes]
    for _ in range(depth):
        out.append([digest(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def depth_of(n: int, fanout: int, block: int) -> int:
    """Levels from the leaves to the root of a block in a group of ``n`` leaves."""
    depth, width = 0, 1
    while width < min(n, block):
        depth, width = depth + 1, width * fanout
    return depth


def block_size(fanout: int, most: int) -> int:
    size = 1
    while size * fanout <= most:
        size *= fanout
    return size


def _round(state: DataFrame, r: int, fanout: int) -> DataFrame:
    """One round: ``state`` has ``tree, block, blocks`` (of the tree), ``node`` and ``path``."""
    width = fanout ** r
    at, low = F.expr(f"block div {width}"), F.col("block") % width
    nodes = F.expr(f"(blocks + {width - 1}) div {width}")
    below = lambda a: F.least(F.lit(width), F.col("blocks") - a * width)  # noqa: E731  blocks below a node
    first = F.expr(f"block div {width * fanout}") * fanout
    asked = state.withColumns({"active": nodes > 1, "at": at, "low": low, "own": below(at)}).withColumn(
        "to", F.explode(F.when(F.col("active"), F.sequence(first, F.least(first + fanout, nodes) - 1)).otherwise(F.array("at"))))
    takers = (F.when(F.col("to") == F.col("at"), F.array("block"))
              .when(F.col("low") < below(F.col("to")), F.transform(F.sequence("low", below(F.col("to")) - 1, "own"), lambda x: F.col("to") * width + x))
              .otherwise(F.array().cast("array<bigint>")))
    mine = F.col("to") == F.col("at")
    sent = asked.select("tree", "blocks", "active", F.col("at").alias("from"), "node", F.when(mine, F.col("path")).alias("path"),
                        F.when(mine, F.col("at")).alias("at"), F.explode(takers).alias("block"))
    met = sent.groupBy("tree", "block").agg(
        F.max("blocks").alias("blocks"), F.max("active").alias("active"), F.max("at").alias("at"), F.first("path", ignorenulls=True).alias("path"),
        F.sort_array(F.collect_list(F.struct("from", "node"))).alias("run"))  # at most fanout nodes
    text = lambda keep: F.concat_ws("", F.transform(F.filter("run", keep), lambda x: x["node"]))
    step = F.struct(text(lambda x: x["from"] < F.col("at")).alias("left"), text(lambda x: x["from"] > F.col("at")).alias("right"))
    return met.select("tree", "block", "blocks", F.when(F.col("active"), F.sha2(text(lambda x: F.lit(True)), 256)).otherwise(F.col("run")[0]["node"]).alias("node"),
                      F.when(F.col("active"), F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"))


def butterfly(state: DataFrame, fanout: int) -> DataFrame:
    """All rounds over ``tree, block, blocks, node``: ``node`` becomes the tree's root, ``path`` the siblings on the way to it."""
    state = written(state.select("tree", "block", "blocks", "node", F.array().cast("array<struct<left:string,right:string>>").alias("path")), "round")
    most, r = state.agg(F.max("blocks")).first()[0] or 0, 0
    while fanout ** r < most:
        state, r = _round(state, r, fanout), r + 1
        if r % ROUNDS_APIECE == 0 or fanout ** r >= most:
            state = written(state, "round")
    return state


def manifest(leaves: DataFrame, fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """Proofs of rows ``group, id, leaf, claimed``: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``claimed`` is the leaf that a reader of the data works out; ``folded_root`` is the root that follows from it
    and the proof.
    """
    if fanout < 2:
        raise ValueError("a run needs two nodes or more")
    size, spark = block_size(fanout, block), leaves.sparkSession
    ship_package(spark)
    leaves = written(leaves.select("group", "id", "leaf", "claimed", F.monotonically_increasing_id().alias("read_at")), "leaves")
    groups = ranked(leaves.select("group").distinct().withColumn("all", F.lit(0)), "all", ["group"], "groups")
    groups = written(groups.select(F.col("group").alias("g"), F.col("rank").alias("tree"), F.col("n").alias("trees")), "groups")
    rows = ranked(leaves, "group", ["id", "leaf", "read_at"], "ranked").join(groups, F.col("group").eqNullSafe(F.col("g")))
    rows = written(rows.select("tree", F.expr(f"rank div {size}").alias("block"), F.expr(f"(n + {size - 1}) div {size}").alias("blocks"), "n", "rank",
                               "id", "leaf", F.when(F.col("claimed") != F.col("leaf"), F.col("claimed")).alias("claimed")), "placed")

    def root_of(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        top = levels_up(part["leaf"].tolist(), fanout, depth_of(int(part["n"].iloc[0]), fanout, size))[-1][0]
        return pd.DataFrame({"tree": [key[0]], "block": [key[1]], "blocks": [part["blocks"].iloc[0]], "node": [top]})

    roots = rows.select("tree", "block", "blocks", "n", "rank", "leaf").groupBy("tree", "block").applyInPandas(root_of, "tree long, block long, blocks long, node string")
    upper = butterfly(roots, fanout)
    subroots = upper.groupBy("tree").agg(F.first("node").alias("node"))  # every block of a tree holds the same
    top = butterfly(subroots.join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("block"), F.col("trees").alias("blocks"), "node"), fanout)
    top = top.select(F.col("block").alias("tree"), F.col("node").alias("root"), F.col("path").alias("over"))
    upper = upper.join(top, "tree").select("tree", "block", F.col("node").alias("subroot"), "root", F.concat("path", "over").alias("path"))

    def prove(key: tuple[Any, ...], part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part, above = part.sort_values("rank"), above.iloc[0]
        own = levels_up(part["leaf"].tolist(), fanout, depth_of(int(part["n"].iloc[0]), fanout, size))
        path = [(s["left"], s["right"]) for s in above["path"]]
        over, proofs, folded = "".join(a + b for a, b in path), [], []
        for i, claimed in enumerate(part["claimed"].fillna(part["leaf"])):
            steps, at = [], i
            for nodes in own[:-1]:
                low = at - at % fanout
                steps.append(("".join(nodes[low:at]), "".join(nodes[at + 1:low + fanout])))
                at //= fanout
            proofs.append(digest(*[x for s in steps for x in s], over))
            for left, right in steps + path:
                claimed = digest(left, claimed, right)
            folded.append(claimed)
        return pd.DataFrame({"id": part["id"], "leaf": part["leaf"], "subroot": above["subroot"], "root": above["root"], "proof_sha256": proofs, "folded_root": folded})

    rows = rows.select("tree", "block", "n", "rank", "id", "leaf", "claimed").withColumn("id", F.col("id").cast("string"))  # pandas has no null integers
    out = rows.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInPandas(
        prove, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Rows ``group, id, leaf, claimed`` of documents; ``claimed`` has one more in ``n_chars`` where ``tampered`` holds."""
    own = [F.col(c) for c in COLUMNS]
    more = [(F.col(c).cast("decimal(20,0)") + 1).cast("decimal(20,0)") if c == "n_chars" else F.col(c) for c in COLUMNS]
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull()
    return docs.select(F.col("lang").alias("group"), F.col("doc_id").cast("long").alias("id"), leaf(own).alias("leaf"),
                       F.when(changed, leaf(more)).otherwise(F.lit(None)).alias("claimed")).withColumn("claimed", F.coalesce("claimed", "leaf"))


def proofs(docs: DataFrame, fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """The manifest of ``docs`` checked against a copy in which every seventh id, by checksum, is tampered with."""
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 0
    out = manifest(document_leaves(docs, tampered), fanout, block)
    return out.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
