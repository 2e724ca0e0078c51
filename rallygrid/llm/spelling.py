"""Spelling variants of a corpus's words, found by a bidirectional FM-index.

Words that differ by one inserted, deleted or replaced code point share their left
or their right half with each other's: whichever half the error isn't in matches exactly.  The search
scheme has one search for each half.  Each starts at the delimiter next to its half, matches the
half exactly, and extends across the other half to the far delimiter, allowing one error; a pattern
is an interval of suffix ranks all along.  The left half grows to the right, over the ranks of the reversed
vocabulary text, the right half to the left, over those of the text itself.

The vocabulary is dealt out by halves: a word goes to the halves that a word of its own length or one beside
could ask for (two for each side), a search to the half that it matches exactly, so
each task indexes its own part of the vocabulary and answers the searches that came with it.  A half
that more than ``PART`` words share is dealt over several tasks, and its searches go to each of them.

Words are counted in the JVM with partial sums.  Variants then point at their most frequent near
word; roots follow by doubling.

Defined results: no text has no words; a null id writes as nothing in the checksum; repeated rows count again;
ties of frequency go to the smallest word in code-point order; an empty table gives no words.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, map_arrow, shuffle_partitions, written

#: Letters that words are made of.
LETTERS = r"A-Za-zÀ-ÿ"
#: A word has at least this many code points and occurrences.
LENGTH, COUNT = 6, 5
#: A form occurs at least this many times as often as its variant.
RATIO = 5
#: One run in so many loses a letter, by its checksum.
DAMAGED = 199
#: Rows of the vocabulary that a task indexes, about.
PART = 1 << 16
#: Code points of the searches that are carried on side by side.
SIDE_BY_SIDE = 1 << 17
#: Up to this width an interval's next letters are read off its rows, beyond it each letter is tried.
NARROW = 64


class FMIndex:
    """Suffix ranks of ``$word$word...$`` read as a ring; words are distinct.

    Ranks are right for patterns as long as the longest word with one more letter and both delimiters.
    """

    def __init__(self, words: list[str]):
        text = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), np.uint32)
        self.letters, codes = np.unique(text, return_inverse=True)  # the delimiter is 0
        codes = codes.astype(np.int64)
        n, reach = len(codes), max(map(len, words)) + 3
        rank, span = codes, 1
        order = np.argsort(codes, kind="stable")
        while span < reach:
            pair = rank * (n + 1) + np.roll(rank, -span)
            order = np.argsort(pair, kind="stable")
            step = np.ones(n, np.int64)
            step[0], step[1:] = 0, pair[order[1:]] != pair[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            span *= 2
            if rank[order[-1]] == n - 1:
                break
        self.n, self.order = n, order
        self.before = codes[order - 1]  # the Burrows-Wheeler transform
        self.keys = np.sort(self.before * (n + 1) + np.arange(n))
        self.word_at = np.cumsum(codes == 0) - 1

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Letters of equally long words as numbers; those that the text doesn't have match nothing."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at, len(self.letters))

    def extend(self, letter, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more letter in front."""
        base = letter * np.int64(self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All letters that go on from each interval: its place, the letter, the new interval."""
        width, sigma = high - low, len(self.letters)
        few = np.flatnonzero(width <= NARROW)
        many = np.flatnonzero(width > NARROW)
        place = np.repeat(few, width[few])
        rows = np.arange(len(place)) - np.repeat(np.cumsum(width[few]) - width[few], width[few]) + low[place]
        found = np.unique(place * sigma + self.before[rows])
        found = np.concatenate([found, (many[:, None] * sigma + np.arange(sigma)).ravel()])
        place, letter = found // sigma, found % sigma
        place, letter = place[letter > 0], letter[letter > 0]  # no error is at a delimiter
        below, above = self.extend(letter, low[place], high[place])
        some = above > below
        return place[some], letter[some], below[some], above[some]

    def near(self, codes: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (search, word) one error apart, after ``exact`` letters without one; a pair may come twice."""
        m, length = codes.shape
        who = np.arange(m)
        low, high = self.extend(np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, self.n))
        erring = [np.zeros(0, np.int64)] * 3
        for j in range(length + 1):
            letters = codes[:, j] if j < length else np.zeros(m, np.int64)
            added = []
            if j >= exact:
                place, letter, below, above = self.children(low, high)
                inserted = who[place], below, above
                if j < length:
                    other = letter != letters[who[place]]
                    added = [tuple(x[other] for x in inserted), (who, low, high)]  # replaced, deleted
                erring = [np.concatenate(x) for x in zip(erring, inserted)]
                low2, high2 = self.extend(letters[erring[0]], erring[1], erring[2])
                some = high2 > low2
                erring = [erring[0][some], low2[some], high2[some]]
            if j < length:
                low, high = self.extend(letters[who], low, high)
                some = high > low
                who, low, high = who[some], low[some], high[some]
            erring = [np.concatenate(x) for x in zip(erring, *added)] if added else erring
        return erring[0], self.word_at[self.order[erring[1]]]  # distinct words: one row each


def answers(words: list[str], asked: list[str], side: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (in ``asked``, in ``words``) one error apart, the half at ``side`` exact."""
    turn = (lambda w: w[::-1]) if side == "left" else (lambda w: w)  # patterns grow to the front
    index = FMIndex([turn(w) for w in words])
    lengths = np.array([len(w) for w in asked])
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        apiece = max(1, SIDE_BY_SIDE // int(length))
        exact = length // 2 if side == "left" else length - length // 2
        for at in range(0, len(own), apiece):
            some = own[at:at + apiece]
            pair = index.near(index.codes([turn(asked[i])[::-1] for i in some]), int(exact))
            if len(pair[0]):
                yield some[pair[0]], pair[1]


def halves(side: str) -> tuple[Column, Column]:
    """The half that a word's search matches exactly, and the halves of all searches that could find the word."""
    n = F.length("word")
    of = lambda k: F.substring(F.col("word"), F.lit(1), F.floor(k / 2).cast("int")) if side == "left" else F.right(F.col("word"), (k - F.floor(k / 2)).cast("int"))
    return of(n), F.array_distinct(F.array(of(n), of(n + 1), of(F.greatest(n - 1, F.lit(LENGTH)))))


def near_words(words: DataFrame) -> DataFrame:
    """Rows ``word, near, n`` (of the near word): all ordered pairs of ``words`` (``word, n``, distinct) one error apart; a pair may come twice."""
    spark, total = words.sparkSession, words.count()
    rows = []
    for side in ("left", "right"):
        asks, holds = halves(side)
        rows += [words.select("word", "n", F.lit(side).alias("side"), F.explode(holds).alias("half"), F.lit(False).alias("asks")),
                 words.select("word", "n", F.lit(side).alias("side"), asks.alias("half"), F.lit(True).alias("asks"))]
    rows = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    large = rows.where(~F.col("asks")).groupBy("side", "half").count().where(F.col("count") > PART)
    large = written(large.select(F.col("side").alias("s"), F.col("half").alias("h"), F.ceil(F.col("count") / PART).alias("pieces")), "large")
    rows = rows.join(large, (F.col("side") == F.col("s")) & (F.col("half") == F.col("h")), "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    piece = F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("pieces"))))
    parts = max(shuffle_partitions(spark), 4 * total // PART + 1)
    dealt = rows.select("side", "asks", "word", "n", "half", F.explode(piece).alias("piece")).repartition(parts, "side", "half", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # PART rows or so, and the searches among them
        if not held:
            return
        table = pa.Table.from_batches(held)
        own, asks, text, counts = np.array(table["side"]), np.array(table["asks"]), table["word"].to_numpy(), np.array(table["n"])
        for side in ("left", "right"):
            held, first = np.unique(text[(own == side) & ~asks].astype(object), return_index=True)
            asked = text[(own == side) & asks]
            if not len(held) or not len(asked):
                continue
            n = counts[(own == side) & ~asks][first]
            for a, b in answers(list(held), list(asked), side):
                yield pa.RecordBatch.from_arrays([pa.array(asked[a], pa.string()), pa.array(held[b], pa.string()), pa.array(n[b], pa.int64())], names=["word", "near", "n"])

    return map_arrow(dealt.select("side", "asks", "word", "n"), run, "word string, near string, n long")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = COUNT, damaged: int = DAMAGED) -> DataFrame:
    """Rows ``word, n``: words of all texts, after one run in ``damaged`` has lost a letter."""
    runs = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("ahead"),
                       F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))).alias("run"))
    plain = runs.select("ahead", F.when(F.col("run").rlike(r"[À-Þ]"), ascii_lower(F.col("run"))).otherwise(F.lower("run")).alias("run"))
    marked = plain.select("run", F.crc32(F.encode(F.concat("ahead", "run"), "utf-8")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = marked.select(F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def roots(forms: DataFrame) -> DataFrame:
    """``word, form`` with ``root``: the last word that forms lead to.  Each round follows twice as many."""
    at = written(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        nxt = written(at.join(up, "root").select("word", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots")
        at = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return forms.join(at, "word")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Rows ``word, form, root, n, n_near, form_n`` of ``words`` (``word, n``)."""
    words = written(words.select("word", "n"), "words")
    near = written(near_words(words), "near")
    pairs = near.repartition("word").groupBy("word", "near").agg(F.max("n").alias("n"))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    both = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    forms = written(both.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return variants(vocabulary(docs, id_col, text_col))
