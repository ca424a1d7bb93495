"""Phrase collocations from vertical positional inverted lists.

Texts are cut into blocks of documents. A block holds, for each phrase in it, the sorted list of positions at which the phrase
begins: first for single words, then level by level for the phrases that are frequent in the whole table. A position is that
of a word in its block; a piece's end takes a position of its own, so no phrase reaches over it. Word lists are extended as they
are: rare words hold so few of all positions that leaving them out would cost more than it saves.

To extend phrases by a word, a block merge-joins the list of each phrase with the lists of the words that stand behind it:
positions of all lists are brought into one order, where a phrase's next entry is the one at the following position if that is
itself frequent (the last words of a frequent phrase are a frequent phrase). The length of the joined list is the number of
occurrences in the block; lengths are summed over blocks, and where the sum reaches LEAST, each block that has the phrase
gets it back and builds its list. So a block is sent only phrases of its own, and nothing that grows with the table is
broadcast or held in one task; a common phrase costs a row for each block. Lists are bucketed by block on disk and never move:
what is shuffled are the phrases of blocks, with their counts there and back.

Counts are exact. A part of a frequent phrase is frequent, so the counts that a phrase's score needs are among those found.

A-Z are lower-cased. Pieces end at `[.,;:!?\\x0A-\\x0D]`, words are `[^\\x20\\x09]+`. Null texts are empty, a null lang is `und`.
Rows that are repeated count again; no other columns are read; a table without words gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexspark.llm.shared import bucketed, dropped, given_back, staged

LEAST, LONGEST, TOP = 100, 5, 2000
BLOCK = 1 << 20  # words and piece ends of a block; a longer document is cut at a piece's end
GAP = b"\xff"  # no byte of UTF-8
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", GAP * 10 + b" ")
#: positions are differences of neighbours, byte by byte of all
LISTS = "block long, lang string, phrases string, counts binary, positions binary"


def listed(block: int, lang: str, phrases: str, counts: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """A row of LISTS."""
    steps = np.diff(positions, prepend=0).astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.RecordBatch.from_pydict({"block": [block], "lang": [lang], "phrases": [phrases], "counts": [counts.astype(np.int32).tobytes()], "positions": [steps]})


class Block:
    """Words of texts in one language, to be turned into lists."""

    def __init__(self):
        self.names: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.names[GAP]  # 0

    def add(self, text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Take a text; gives the lists of what was taken whenever that is enough for a block."""
        words = text.encode("utf-8", "surrogatepass").lower().translate(ENDS).replace(GAP, b" \xff ").split()
        at = 0
        while at < len(words):
            part = words[at : at + BLOCK]
            if at + BLOCK < len(words):  # cut where a piece ends: here, or else at the next end
                stop = next((i for i in range(len(part) - 1, -1, -1) if part[i] == GAP), None)
                stop = next((i for i in range(len(part), len(words) - at) if words[at + i] == GAP), len(words) - at - 1) if stop is None else stop
                part = words[at : at + stop + 1]
            at += len(part)
            ids = np.fromiter(map(self.names.__getitem__, part), np.int32, len(part))
            self.parts += [ids, np.zeros(1, np.int32)]
            self.size += len(part) + 1
            if self.size >= BLOCK:
                yield from self.lists()

    def lists(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Words, the lengths of their lists, and the lists one behind the other."""
        if len(self.names) > 1:
            ids = np.concatenate(self.parts)
            order = np.argsort(ids, kind="stable")
            counts = np.bincount(ids, minlength=len(self.names))
            names = list(self.names)
            yield b"\n".join(names[1:]).decode("utf-8", "surrogatepass"), counts[1:], order[counts[0] :]
        self.__init__()


def word_lists(docs: DataFrame) -> DataFrame:
    """LISTS of single words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, Block] = {}
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    for lists in blocks.setdefault(lang, Block()).add(text):
                        yield listed(next(number), lang, *lists)
            while sum(b.size for b in blocks.values()) > 2 * BLOCK:  # many languages: the largest block ends early
                lang = max(blocks, key=lambda k: blocks[k].size)
                for lists in blocks.pop(lang).lists():
                    yield listed(next(number), lang, *lists)
        for lang, block in blocks.items():
            for lists in block.lists():
                yield listed(next(number), lang, *lists)
        blocks.clear()
        given_back()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(build, LISTS)


def unpacked(row: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    steps = np.ascontiguousarray(np.frombuffer(row["positions"], np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    return row["phrases"].split("\n"), np.frombuffer(row["counts"], np.int32), np.cumsum(steps, dtype=np.int64)


class Joined:
    """The lists of a block merge-joined with those of the words behind."""

    def __init__(self, row: dict):
        self.phrases, counts, positions = unpacked(row)
        order = np.argsort(positions, kind="stable")
        self.at, ids = positions[order], np.repeat(np.arange(len(counts)), counts)[order]
        next_to = np.flatnonzero(self.at[1:] == self.at[:-1] + 1)
        self.at = self.at[next_to]
        self.pairs, self.which, self.counts = np.unique(ids[next_to] * len(counts) + ids[next_to + 1], return_inverse=True, return_counts=True)

    def names(self) -> list[str]:
        """The extended phrases, in the order of pairs."""
        last = [p[p.rfind(" ") + 1 :] for p in self.phrases]
        first, second = np.divmod(self.pairs, max(1, len(self.phrases)))
        return [f"{self.phrases[i]} {last[j]}" for i, j in zip(first.tolist(), second.tolist())]


COUNTS = "block long, lang string, phrase string, n long"


def counts_of(block: int, lang: str, phrases: list[str], n: np.ndarray) -> pa.RecordBatch:
    same = lambda value, kind: pa.repeat(pa.scalar(value, kind), len(phrases))
    return pa.RecordBatch.from_arrays([same(block, pa.int64()), same(lang, pa.string()), pa.array(phrases, pa.string()), pa.array(n, pa.int64())], ["block", "lang", "phrase", "n"])


def words_counted(lists: DataFrame) -> DataFrame:
    """COUNTS of all lists."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield counts_of(r["block"], r["lang"], r["phrases"].split("\n"), np.frombuffer(r["counts"], np.int32))

    return lists.select("block", "lang", "phrases", "counts").mapInArrow(count, COUNTS)


def all_words(lists: DataFrame) -> DataFrame:
    """(lang, n) with the number of all words of word lists."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(c, np.int32).sum(dtype=np.int64)) for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n, pa.int64())], ["lang", "n"])

    return lists.select("lang", "counts").mapInArrow(count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def extensions_counted(lists: DataFrame) -> DataFrame:
    """COUNTS of the phrases that have one word more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                joined = Joined(r)
                yield counts_of(r["block"], r["lang"], joined.names(), joined.counts)
        given_back()

    return lists.mapInArrow(count, COUNTS)


def extended(lists: DataFrame, chosen: DataFrame) -> DataFrame:
    """LISTS of the phrases with one word more that chosen (block, wanted) names."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                wanted, joined = set(r["wanted"].split("\n")), Joined(r)
                names = joined.names()
                keep = np.fromiter((x in wanted for x in names), bool, len(names))
                positions = joined.at[np.argsort(joined.which, kind="stable")][np.repeat(keep, joined.counts)]
                yield listed(r["block"], r["lang"], "\n".join(itertools.compress(names, keep)), joined.counts[keep], positions)
        given_back()

    return lists.join(chosen, "block").mapInArrow(build, LISTS)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to `longest` words with f >= least, and (lang, n) with all words."""
    lists = bucketed(word_lists(docs), "block", "word_lists")
    totals = staged(all_words(lists), "totals")
    words = words_counted(lists).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    levels = [staged(words, "words", release=True)]
    for k in range(2, longest + 1):
        f = F.sum("n").over(Window.partitionBy("lang", "phrase"))
        rows = staged(extensions_counted(lists).withColumn("f", f).filter(F.col("f") >= least).select("block", "lang", "phrase", "f"), "frequent", release=True)
        levels.append(rows)
        if k < longest:
            chosen = rows.groupBy("block").agg(F.array_join(F.collect_list("phrase"), "\n").alias("wanted"))
            after = bucketed(extended(lists, chosen), "block", "lists")
            dropped(lists)
            lists = after
    each = [rows.select("lang", "phrase", F.lit(k + 1).alias("k"), "f").distinct() for k, rows in enumerate(levels)]
    out = staged(functools.reduce(DataFrame.unionByName, each), "phrases")
    dropped(lists, *levels)
    return out, totals


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in exact arithmetic."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (whole(a) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(23,0)") * whole(n), whole(left) * whole(right))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language."""
    phrases, totals = frequent_phrases(docs, least, longest)
    parts = phrases.select("lang", "phrase", "f")
    longer = phrases.filter("k > 2").withColumn("w", F.split("phrase", " "))
    # a phrase inside a longer one that is as frequent is inside one with a word more that is as frequent
    inner = [F.array_join(F.slice("w", at, F.col("k") - 1), " ") for at in (1, 2)]
    covered = longer.select("lang", F.explode(F.array(*inner)).alias("phrase"), "f").distinct()
    own = phrases.filter("k > 1").join(covered, ["lang", "phrase", "f"], "left_anti")
    cuts = own.select("lang", "phrase", F.col("f").alias("a"), "k", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = F.min(F.struct("score", "cut", "l", "r", "n")).alias("x")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "x.n", "x.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
