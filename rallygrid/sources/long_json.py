"""Observation documents of any length, read by many tasks.

A document is one JSON object whose ``frames`` list may be gigabytes long.  It is cut into byte ranges.  A first
pass sums up each range as if it began outside a string and as if it began inside one: how many
brackets of before it closes, which ones it leaves open and under which names, and whether it ends inside a string.
Folding a document's sums in order tells each range where it begins.  A second pass then
takes out the frames that begin in the range, reading past its end for the last one, and what
the document says beside its frames.  The frames are parsed by Spark like any JSON.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a range, and bytes before it that may hold the name of its first list.
RANGE_BYTES, CONTEXT = 32 << 20, 4096
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*+("|\\?\Z)|[{}\[\]]', re.S)
_REST_OF_STRING = re.compile(rb'(?:[^"\\]|\\.)*+("|\\?\Z)', re.S)
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*+)"\s*:\s*\Z', re.S)
_SUM = "path string, start long, inside boolean, pops int, opened array<string>, ends_inside boolean"
_FRAME = "path string, start long, end long, text string, closed boolean, header string"


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows ``path, start, end, size``: the byte ranges of all files."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    cut = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    return cut.select("path", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("end"), "size")


def _spread(parts: DataFrame) -> DataFrame:
    """By range, so that one long document is read by many tasks; a given number of partitions isn't coalesced, small as the rows that name ranges are."""
    return parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.open_input_file(inner)


def _begin(before: bytes, data: bytes, inside: bool) -> int:
    """Where the first token outside a string can begin."""
    if not inside:
        return 0
    escaped = (len(before) - len(before.rstrip(b"\\"))) % 2
    return _REST_OF_STRING.match(data, min(escaped, len(data))).end()


def tokens(before: bytes, data: bytes, inside: bool) -> Iterator[tuple[int, int, str | None]]:
    """Brackets outside strings: place, byte, and the name in front of an opening one (None: an item of a list)."""
    at, last = _begin(before, data, inside), 0
    for m in _TOKEN.finditer(data, at):
        byte = data[m.start()]
        if byte == 0x22:
            continue
        name = None
        if byte in b"{[":
            # Between the last bracket and this one stands a name, or nothing of the kind.
            text = data[max(last, m.start() - CONTEXT):m.start()]
            found = _NAME.search(before + text if last == 0 and m.start() < CONTEXT else text)
            name = found.group(1).decode("utf-8", "replace") if found else None
        last = m.end()
        yield m.start(), byte, name


def _ends_inside(before: bytes, data: bytes, inside: bool) -> bool:
    at = 0
    if inside:
        m = _REST_OF_STRING.match(data, min((len(before) - len(before.rstrip(b"\\"))) % 2, len(data)))
        if m.group(1) != b'"':
            return True
        at = m.end()
    last = None
    for last in _TOKEN.finditer(data, at):
        pass
    return last is not None and data[last.start()] == 0x22 and last.group(1) != b'"'


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with _open(row["path"]) as f:
                low = max(0, row["start"] - CONTEXT)
                block = f.read_at(row["end"] - low, low)
            before, data = block[:row["start"] - low], block[row["start"] - low:]
            out = []
            for inside in (False, True):
                pops, opened = 0, []
                for _, byte, name in tokens(before, data, inside):
                    if byte in b"{[":
                        opened.append(chr(byte) + (name or ""))
                    elif opened:
                        opened.pop()
                    else:
                        pops += 1
                out.append((row["path"], row["start"], inside, pops, opened, _ends_inside(before, data, inside)))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "inside", "pops", "opened", "ends_inside"), o)) for o in out], schema=pa.schema([
                ("path", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("pops", pa.int32()), ("opened", pa.list_(pa.string())), ("ends_inside", pa.bool_())]))


def _folded(part: pd.DataFrame) -> pd.DataFrame:
    """Each range's beginning: inside a string or not, and the brackets open there.  A document has a few rows."""
    stack, inside, out = [], False, []
    for start, both in part.sort_values(["start", "inside"]).groupby("start", sort=True):
        out.append((both["path"].iloc[0], start, inside, list(stack)))
        row = both[both["inside"] == inside].iloc[0]
        stack = stack[:max(0, len(stack) - row["pops"])] + list(row["opened"])
        inside = bool(row["ends_inside"])
    out.append((part["path"].iloc[0], -1, inside, list(stack)))  # how the document ends
    return pd.DataFrame(out, columns=["path", "start", "inside", "stack"])


def _frames(list_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("closed", pa.bool_()), ("header", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as f:
                    low = max(0, row["start"] - CONTEXT)
                    block = f.read_at(row["end"] - low, low)
                    before, data = block[:row["start"] - low], block[row["start"] - low:]
                    own, stack, begun, out, header, done = len(data), list(row["stack"]), None, [], [], 0
                    listed = ["{", "[" + list_name]
                    more = len(data)
                    while True:
                        # The range, or with more of the file behind it while its last frame is open.
                        found, stack, begun, header, done = [], list(row["stack"]), None, [], 0
                        for at, byte, name in tokens(before, data, row["inside"]):
                            if at >= own and begun is None:
                                break
                            if byte in b"{[":
                                if stack == listed and byte == 0x7B:
                                    begun = at
                                stack.append(chr(byte) + (name or ""))
                                if stack == listed:
                                    header.append(data[done:at + 1])  # the list's own opening
                            elif stack:
                                if stack == listed:
                                    done = at
                                stack.pop()
                                if stack == listed and begun is not None:
                                    found.append((begun, at + 1, True))
                                    begun = None
                        if begun is None or row["start"] + len(data) >= row["size"]:
                            break
                        more *= 2
                        data = data[:own] + f.read_at(min(more, row["size"] - row["start"] - own), row["start"] + own)
                    if begun is not None:
                        found.append((begun, len(data), False))
                    if stack[:2] != listed and done < own:
                        header.append(data[done:own])
                rest = b"".join(header).decode("utf-8", "replace")
                out = [(row["path"], row["start"] + a, row["start"] + b, data[a:b].decode("utf-8", "replace"), c, None) for a, b, c in found]
                out.append((row["path"], row["start"], row["start"] + own, None, True, rest))
                for k in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out[k:k + 4096]], schema=schema)
    return run


class LongDocuments:
    """The frames, headers and faults of the documents under ``path``."""

    def __init__(self, spark: SparkSession, path: str, frame: T.StructType, list_name: str = "frames", range_bytes: int = RANGE_BYTES):
        self.frame = frame
        parts = ranges(spark, path, range_bytes)
        sums = _spread(parts.select("path", "start", "end")).mapInArrow(_summed, _SUM)
        self.begins = sums.groupBy("path").applyInPandas(_folded, "path string, start long, inside boolean, stack array<string>")
        known = parts.join(self.begins, ["path", "start"])
        self.pieces = _spread(known).mapInArrow(_frames(list_name), _FRAME)

    def frames(self) -> DataFrame:
        """Rows ``path, start, end, f`` (the frame), ``problem``: null, ``unclosed`` or ``malformed``."""
        corrupt = T.StructType([*self.frame.fields, T.StructField("_corrupt", T.StringType())])
        read = F.from_json("text", corrupt, {"columnNameOfCorruptRecord": "_corrupt"})
        rows = self.pieces.where("text is not null").select("path", "start", "end", "closed", read.alias("f"))
        problem = F.when(~F.col("closed"), "unclosed").when(F.col("f._corrupt").isNotNull() | F.col("f").isNull(), "malformed")
        return rows.select("path", "start", "end", F.struct(*[F.col(f"f.{c}").alias(c) for c in self.frame.names]).alias("f"), problem.alias("problem"))

    def headers(self) -> DataFrame:
        """Rows ``path, header``: each document without its frames; its pieces are few and short."""
        piece = F.struct("start", "header")
        found = self.pieces.where("text is null").groupBy("path").agg(F.array_sort(F.collect_list(piece)).alias("h"))
        return found.select("path", F.array_join(F.transform("h", lambda x: x["header"]), "").alias("header"))

    def faults(self) -> DataFrame:
        """Rows ``path, start, end, problem``: byte ranges that are no frames, and documents that end inside a string or an open bracket."""
        broken = self.frames().where("problem is not null").select("path", "start", "end", "problem")
        open_end = self.begins.where((F.col("start") == -1) & (F.col("inside") | (F.size("stack") > 0)))
        return broken.unionByName(open_end.select("path", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit("unbalanced").alias("problem")))
