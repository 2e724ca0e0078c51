"""Byte-level BPE over Arrow batches with the ``tokenizers`` library.

A rank file becomes a vocabulary of printable stand-ins for bytes plus the merge
that builds each token.  ``encode`` gives each text's ids and, if asked, the
character offsets of its tokens; ``decode`` turns ids back into bytes by the
reversed table, so characters that tokens split come together again.

A blank between two other characters always starts a new match of the split
pattern.  So a text is cut there first, and each distinct chunk of a block of
texts is encoded once; a bounded store keeps chunks met before.  Texts with
blanks in a row are encoded whole.

Defined results: no text counts as the empty text, with no tokens and no bytes;
strings of special tokens are ordinary text; rows are kept one for one, repeated
ones too; an id outside the vocabulary fails the job when decoding.
"""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Bounds of a worker's memory: chunks in each of two generations, the longest of them, and characters of text encoded at once.
KEEP_CHUNKS, KEEP_CHARS, BLOCK_CHARS = 200_000, 48, 1 << 20
TWO_BLANKS = re.compile(r"\s\s")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last merge that builds ``token`` from its bytes by lower ranks."""
    parts, top = [bytes([b]) for b in token], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
        if rank >= top:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Codec:
    """One vocabulary in one worker process."""

    def __init__(self, data: bytes, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, sign = read_ranks(data), byte_characters()
        shown = lambda token: "".join(sign[b] for b in token)
        merges = [m for token in sorted(ranks, key=ranks.get) if len(token) > 1 and (m := merge_of(token, ranks))]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=[(shown(a), shown(b)) for a, b in merges],
                                              ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(sign)}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in self.tokenizer.get_vocab().items()}
        self.length_of = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.length_of[i] = len(b)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [[t] if TWO_BLANKS.search(t) else chunks(t) for t in texts]
        known = {c: self.young.get(c) or self.old.get(c) for one in cut for c in one}
        new = [c for c, ids in known.items() if ids is None]
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[c] = np.array(e.ids, "<u4").tobytes()
        if len(self.young) > KEEP_CHUNKS:
            self.young, self.old = {}, self.young
        self.young.update((c, ids) for c, ids in known.items() if len(c) <= KEEP_CHARS)
        return [b"".join(map(known.__getitem__, one)) for one in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token; tokens that share a split character share it here too."""
        ends = np.cumsum(self.length_of[np.frombuffer(ids, "<u4")])
        starts = np.concatenate([ends[:0], np.zeros(min(1, len(ends)), np.int64), ends[:-1]])
        first = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
        return (first[starts] - 1, first[ends - 1]) if len(ends) else (starts, ends)


def chunks(text: str) -> list[str]:
    """A text without two blanks in a row, cut before each space."""
    head, *rest = text.split(" ")
    if rest and not head:  # it starts with the space
        return [" " + c for c in rest]
    if rest and not rest[-1]:  # it ends with a space, which is a match of its own
        return [head, *[" " + c for c in rest]]
    return [head, *[" " + c for c in rest]] if text else []


@lru_cache(maxsize=2)
def codec(data: bytes, pattern: str) -> Codec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
    return Codec(data, pattern)


def blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def vocabulary(path: str | None) -> bytes:
    """A rank file's bytes, read once on the driver; its size is fixed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def split_pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None,
           offsets: bool = False) -> DataFrame:
    """Rows ``doc_id, n_tokens, token_ids`` (little-endian unsigned 32-bit) and with ``offsets`` also ``char_starts, char_ends``."""
    shared, pattern = docs.sparkSession.sparkContext.broadcast(vocabulary(path)), split_pattern(pattern)
    schema = "doc_id long, n_tokens long, token_ids binary" + (", char_starts array<int>, char_ends array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            at, texts = 0, batch.column(1).to_pylist()
            for block in blocks(texts):
                ids = own.encode(block)
                columns = [batch.column(0).slice(at, len(block)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if offsets:
                    pairs = [own.offsets(t, x) for t, x in zip(block, ids, strict=True)]
                    columns += [pa.array([p[k].astype(np.int32) for p in pairs], pa.list_(pa.int32())) for k in (0, 1)]
                at += len(block)
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), run, schema)


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows of ``encode`` with the bytes that their ids stand for, in column ``decoded``."""
    shared, pattern = tokens.sparkSession.sparkContext.broadcast(vocabulary(path)), split_pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([own.decode(x) for x in part.column(2).to_pylist()], pa.binary())],
                                                 names=["doc_id", "n_tokens", "token_ids", "decoded"])

    return map_arrow(tokens.select("doc_id", "n_tokens", "token_ids"), run, "doc_id long, n_tokens long, token_ids binary, decoded binary")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode, decode, and digest both: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    both = decode(encode(docs, path=path), path)
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
