"""Removal of word runs that an earlier document already has, on a de Bruijn graph of the corpus.

Edges are the runs of K words (windows).  An edge that occurs in several
documents is a repeat; its smallest document is its source.

1. ``edges``: windows of a document that share a minimizer (the smallest hashed
   run of MINIMIZER words among theirs) travel together, keyed by it, so equal
   edges meet wherever they stand.  Windows that a smaller document of the same
   block of input already has are settled before the exchange; a passage of a
   third of all documents thus costs a row for each block, not for each copy.
2. ``repeats``: each edge finds its source.  Neighbouring edges that continue
   along the same source without a branch become one piece.
3. ``paths``: pieces of one document that follow each other on the same source
   compact to maximal nonbranching paths.  Each edge carries its source
   coordinate, so one ordered pass does what repeated joins of neighbours would.
4. ``cut``: a join brings paths to the texts of both ends; a path counts only if
   the words at both coordinates are equal (by a digest of the words themselves).

Windows are judged on the input; words under any confirmed path are removed.

Defined results: no text has no words; fewer than K words are never cut; rows
that share an id are not each other's source, and a path is cut from a row only
if that row's own words confirm it; a null id is neither cut nor a source; an
empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rolling
from .common import map_arrow, shuffle_partitions, written

#: Words in a window, and in a minimizer.
K, MINIMIZER = 13, 5
#: Bytes of text whose windows are settled together; rows of one key range resolved together (below 2 ** 16, see ``resolve``).
BLOCK_BYTES, RANGE_ROWS = 8 << 20, 50_000
#: Bytes kept of a window's hash beside its minimizer's eight.
TAG = 6

EDGES = "key long, doc long, start int, n int, src long, src_start int, tags binary"
PIECES = "doc long, start int, n int, src long, src_start int"


def changes(*columns: np.ndarray) -> np.ndarray:
    """True at the first row and where any column differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def batch_of(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[f.split()[0] for f in names.split(", ")])


def block_edges(ids: np.ndarray, texts: list[str], k: int) -> pa.RecordBatch | None:
    """Edges of a block of documents in pieces: of one minimizer while open, of one source once settled."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    hashes, minimizers, places, owners = [], [], [], []
    for d, i in enumerate(order):
        words = rolling.word_hashes(texts[i].encode())[0]
        windows = rolling.run_hashes(words, k)
        if len(windows):
            small = rolling.run_hashes(words, MINIMIZER)
            at = np.lib.stride_tricks.sliding_window_view(small, k - MINIMIZER + 1).argmin(axis=1) + np.arange(len(windows))
            hashes.append(windows)
            minimizers.append((small[at], at))
            places.append(np.arange(len(windows), dtype=np.int32))
            owners.append(np.full(len(windows), d, np.int32))
    if not hashes:
        return None
    window, place, owner = np.concatenate(hashes), np.concatenate(places), np.concatenate(owners)
    minimizer, at = (np.concatenate([m[j] for m in minimizers]) for j in (0, 1))
    by_hash = np.argsort(window, kind="stable")  # within a hash by id and place
    group = np.flatnonzero(changes(window[by_hash]))
    first = np.empty(len(window), np.int64)
    first[by_hash] = np.repeat(by_hash[group], np.diff(np.append(group, len(window))))
    doc, source = ids[owner], ids[owner[first]]
    settled = source < doc
    shift = np.where(settled, place - place[first], 0)
    begin = np.flatnonzero(changes(owner, settled, np.where(settled, owner[first], -1), shift, np.where(settled, 0, at)))
    n = np.diff(np.append(begin, len(window))).astype(np.int32)
    done = settled[begin]
    tags = window.view(np.uint8).reshape(-1, 8)[~settled, :TAG].tobytes()
    ends = np.concatenate([[0], np.cumsum(np.where(done, 0, n) * TAG)]).astype(np.int32)
    key = np.where(done, rolling.mix(doc[begin].astype(np.uint64)), minimizer[begin]).view(np.int64)
    return batch_of(EDGES, pa.array(key), pa.array(doc[begin]), pa.array(place[begin]), pa.array(n), pa.array(source[begin], mask=~done),
                    pa.array(place[first[begin]], mask=~done), pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(tags)]))


def edges(docs: DataFrame, id_col: str, text_col: str, k: int = K) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            low = 0
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK_BYTES)))
                if (out := block_edges(ids[low:high], texts[low:high], k)) is not None:
                    yield out
                low = high

    usable = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    return map_arrow(usable, run, EDGES)


def resolve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pieces along one source, for all rows of some keys; rows stand by key, document and place."""
    rows = rows.combine_chunks()
    col = lambda name, kind: rows.column(name).fill_null(0).to_numpy().astype(kind)
    doc, start, n, src, src_start = (col(c, np.int64) for c in ("doc", "start", "n", "src", "src_start"))
    done = rows.column("src").is_valid().to_numpy(zero_copy_only=False)
    yield pieces(doc[done], start[done], n[done], src[done], src_start[done])
    left = np.flatnonzero(~done)
    if not len(left):
        return
    keys = np.cumsum(changes(col("key", np.int64)[left])).astype(np.uint64)
    tags = np.frombuffer(b"".join(rows.column("tags").take(pa.array(left)).to_pylist()), np.uint8).reshape(-1, TAG)
    wide = np.zeros((len(tags), 8), np.uint8)
    wide[:, :TAG] = tags
    row = np.repeat(np.arange(len(left)), n[left])
    ordinal = np.arange(len(row)) - np.repeat(np.cumsum(n[left]) - n[left], n[left])
    edge = wide.view(np.uint64)[:, 0] | (keys[row] << np.uint64(8 * TAG))  # fewer than 2 ** 16 keys
    by_edge = np.argsort(edge, kind="stable")  # within an edge by document and place
    group = np.flatnonzero(changes(edge[by_edge]))
    first = np.empty(len(edge), np.int64)
    first[by_edge] = np.repeat(by_edge[group], np.diff(np.append(group, len(edge))))
    own, place = doc[left][row], start[left][row] + ordinal
    source, shift = own[first], place - place[first]
    begin = np.flatnonzero(changes(row, source, shift))
    length = np.diff(np.append(begin, len(row)))
    keep = source[begin] < own[begin]
    begin, length = begin[keep], length[keep]
    yield pieces(own[begin], place[begin], length, source[begin], place[first[begin]])


def pieces(doc, start, n, src, src_start) -> pa.RecordBatch:
    return batch_of(PIECES, pa.array(doc, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (start, n)), pa.array(src, pa.int64()),
                    pa.array(src_start.astype(np.int32)))


def repeats(found: DataFrame) -> DataFrame:
    """Pieces whose edges a smaller document has: ``doc, start, n`` (windows)``, src, src_start``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= RANGE_ROWS:
                rows = pa.concat_tables(held)
                keys = rows.column("key").to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                for at in range(0, whole, RANGE_ROWS):
                    low, high = (int(np.searchsorted(keys[:whole], keys[x])) if x < whole else whole for x in (at, at + RANGE_ROWS))
                    if high > low:
                        yield from resolve(rows.slice(low, high - low))
                held = [rows.slice(whole).combine_chunks()]
        if held and (rows := pa.concat_tables(held)).num_rows:
            yield from resolve(rows)

    by_key = found.repartition(shuffle_partitions(found.sparkSession), "key").sortWithinPartitions("key", "doc", "start")
    return map_arrow(by_key, run, PIECES)


def paths(found: DataFrame) -> DataFrame:
    """Maximal nonbranching paths: pieces that follow each other on one source become one."""
    line = Window.partitionBy("doc", "src", F.col("start") - F.col("src_start")).orderBy("start")
    end = F.max(F.col("start") + F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start") <= end, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    spread = found.repartition(shuffle_partitions(found.sparkSession), "doc")
    return spread.withColumn("run", run).groupBy("doc", "src", (F.col("start") - F.col("src_start")).alias("shift"), "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end")).select(
        "doc", "start", (F.col("end") - F.col("start")).alias("n"), "src", (F.col("start") - F.col("shift")).alias("src_start"))


def digest(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def kept_words(words: list[bytes], cuts: list[tuple[int, int]]) -> list[bytes]:
    """Words outside all cuts (first word, end)."""
    if not cuts:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for a, b in cuts:
        gone[min(a, len(words))] += 1
        gone[min(b, len(words))] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


CUTS = "array<struct<start:int,n:int,src:long,src_start:int>>"


def apply_cuts(docs: DataFrame, k: int, keep_text: bool) -> DataFrame:
    """What is left of each text under its ``cuts`` but the ``refused``, with digests of the words at both ends of paths."""
    schema = ("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, own array<struct<start:int,n:int,src:long,src_start:int,digest:long>>, "
              "asked array<struct<start:int,n:int,digest:long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    words = (r["text"] or "").encode().split()
                    refused = {tuple(x.values()) for x in r["refused"] or ()}
                    own = [c | {"digest": digest(words[c["start"]:c["start"] + c["n"] + k - 1])} for c in r["cuts"] or ()]
                    own = [c for c in own if tuple(c.values()) not in refused]
                    kept = kept_words(words, [(c["start"], c["start"] + c["n"] + k - 1) for c in own])
                    left = b" ".join(kept)
                    out.append({"doc_id": r["doc_id"], "n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(left).hexdigest(),
                                "kept": left.decode() if keep_text else None, "own": own,
                                "asked": [a | {"digest": digest(words[a["start"]:a["start"] + a["n"] + k - 1])} for a in r["asks"] or ()]})
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    item = lambda **f: pa.list_(pa.struct([(n, t) for n, t in f.items()]))
    i, q = pa.int32(), pa.int64()
    kinds = pa.schema([("doc_id", q), ("n_words", q), ("n_removed", q), ("kept_sha256", pa.string()), ("kept", pa.string()),
                       ("own", item(start=i, n=i, src=q, src_start=i, digest=q)), ("asked", item(start=i, n=i, digest=q))])
    return map_arrow(docs, run, schema)


def cut(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, k: int = K, keep_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` and the kept words if asked for."""
    # A source is asked for each of its stretches once, however many copies it has.
    asks = found.select(F.col("src").alias("doc"), F.col("src_start").alias("start"), "n").distinct().select("doc", F.lit(None).cast(CUTS[6:-1]).alias("cut"), F.struct("start", "n").alias("ask"))
    ends = found.select("doc", F.struct("start", "n", "src", "src_start").alias("cut"), F.lit(None).cast("struct<start:int,n:int>").alias("ask")).unionByName(asks)
    lists = ends.groupBy("doc").agg(F.collect_list("cut").alias("cuts"), F.collect_list("ask").alias("asks"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    no = F.lit(None).cast("array<struct<start:int,n:int,src:long,src_start:int,digest:long>>")
    first = written(apply_cuts(texts.join(lists, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "cuts", "asks", no.alias("refused")), k, keep_text), "cut")
    own = first.select("doc_id", F.explode("own").alias("c")).select("doc_id", "c.*")
    told = first.select(F.col("doc_id").alias("src"), F.explode("asked").alias("a")).select("src", F.col("a.start").alias("src_start"), F.col("a.n").alias("n"), F.col("a.digest").alias("digest"))
    refused = own.join(told, ["src", "src_start", "n", "digest"], "left_anti").select("doc_id", F.struct("start", "n", "src", "src_start", "digest").alias("c"))
    refused = written(refused.groupBy("doc_id").agg(F.collect_list("c").alias("refused")).withColumnRenamed("doc_id", "doc"), "refused")
    result = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    if refused.isEmpty():
        return first.select(*result)
    again = texts.join(refused, F.col("doc_id") == F.col("doc")).drop("doc").join(lists, F.col("doc_id") == F.col("doc")).select(
        "doc_id", "text", "cuts", F.lit(None).cast("array<struct<start:int,n:int>>").alias("asks"), "refused")
    return first.join(refused, F.col("doc_id") == F.col("doc"), "left_anti").select(*result).unionByName(apply_cuts(again, k, keep_text).select(*result))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, keep_text: bool = False) -> DataFrame:
    """Texts without the word runs that a document with a smaller id has."""
    found = written(paths(written(repeats(edges(docs, id_col, text_col, k)), "pieces")), "paths")
    return cut(docs, found, id_col, text_col, k, keep_text)
