"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A byte-level BPE never merges across pre-tokens, so a document's count is a sum over them. The tree's leaves are blocks
of pre-tokens with their lengths and counts; inner nodes hold sums of both. An edit finds its blocks by descending the
character sums, splits and encodes again only from the last pre-token that the edit can't have changed to the first
boundary after it where old and new boundaries meet, and updates the sums above the touched leaves.

Edits are (start, stop, new text) in code points of the text as it is when their turn comes; positions outside it are
moved to its ends, a stop before the start means an insertion, null new text deletes. Null texts are empty ones with
count 0; repeated rows are documents of their own; an empty table gives an empty result; other columns are not touched.
Each document is one row's work, without a shuffle in `counted`; `updated` joins stored trees with edits by doc_id.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters past its end that the choice of a pre-token can depend on: a space run looks at the space it leaves and
#: the character after it, an apostrophe at two letters.
LOOK = 2
BLOCK = 64
CACHE = 400_000
EDITS = "array<struct<start:bigint,stop:bigint,new:string>>"
STATE = "struct<blocks:array<struct<text:string,lens:array<int>,counts:array<int>>>,chars:array<bigint>,tokens:array<bigint>>"
RESULT = "n_tokens long, n_tokens_edited long, n_pretokens long, n_reencoded long, n_chars_edited long, edited string"


class Counter:
    """Counts of pre-tokens under a rank file; a bounded number is remembered."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        got = list(map(self.known.get, pieces))
        if None in got:
            if len(self.known) > CACHE:
                self.known.clear()
            for i, n in enumerate(got):
                if n is None:
                    piece = pieces[i]
                    if (n := self.known.get(piece)) is None:
                        n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
                    got[i] = n
        return got


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class Tree:
    def __init__(self, counter: Counter, text: str = ""):
        self.counter, self.reencoded = counter, 0
        pieces = counter.split(text)
        self.build(pieces, counter.counts(pieces))

    def build(self, pieces: list[str], counts: list[int]) -> None:
        cuts = range(0, max(1, len(pieces)), BLOCK)
        self.pieces = [pieces[i : i + BLOCK] for i in cuts]
        self.counts = [counts[i : i + BLOCK] for i in cuts]
        self.grow()

    def grow(self) -> None:
        """Sums of all nodes: the root is 1, the children of i are 2 i and 2 i + 1."""
        self.size = 1 << (len(self.pieces) - 1).bit_length()
        self.chars, self.tokens = (np.zeros(2 * self.size, np.int64) for _ in range(2))
        leaves = slice(self.size, self.size + len(self.pieces))
        self.chars[leaves] = [sum(map(len, p)) for p in self.pieces]
        self.tokens[leaves] = [sum(c) for c in self.counts]
        for sums in (self.chars, self.tokens):
            low = self.size
            while low > 1:
                sums[low // 2 : low] = sums[low : 2 * low].reshape(-1, 2).sum(1)
                low //= 2

    def refresh(self, block: int) -> None:
        i = block + self.size
        self.chars[i], self.tokens[i] = sum(map(len, self.pieces[block])), sum(self.counts[block])
        while i := i // 2:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def block_at(self, at: int) -> tuple[int, int]:
        """The block that holds character `at` (the last one for the end of the text), and where it starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start, i = start + int(self.chars[i]), i + 1
        return i - self.size, start

    def text(self) -> str:
        return "".join(p for block in self.pieces for p in block)

    def __len__(self) -> int:
        return int(self.chars[1])

    def edit(self, start: int, stop: int, new: str) -> None:
        start = min(max(start, 0), len(self))
        stop = min(max(stop, start), len(self))
        first, begin = self.block_at(max(0, start - LOOK - 1))
        while first and begin > start - LOOK:
            first -= 1
            begin -= int(self.chars[first + self.size])
        keep, at = 0, begin  # pre-tokens of the first block that the edit can't have changed
        for p in self.pieces[first]:
            if at + len(p) + LOOK > start:
                break
            keep, at = keep + 1, at + len(p)
        last = max(first, self.block_at(stop)[0])
        while True:
            old = [p for b in range(first, last + 1) for p in self.pieces[b]][keep:]
            whole = last == len(self.pieces) - 1
            before = "".join(old)
            after = before[: start - at] + new + before[stop - at :]
            pieces = self.counter.split(after)
            # Old boundaries past the edit, in the new text's places, and how many old pre-tokens come before them.
            moved, meet, place = len(after) - len(before), {}, at
            for i, p in enumerate(old):
                if place >= stop:
                    meet[place - at + moved] = i
                place += len(p)
            if whole:
                meet[len(after)] = len(old)
            place = 0
            for n, p in enumerate([*pieces, ""]):
                if place in meet and place >= start - at + len(new) and (whole or place + len(p) + LOOK <= len(after)):
                    break
                place += len(p)
            else:
                last = min(last + 1, len(self.pieces) - 1)
                continue
            break
        rest = meet[place]
        fresh = pieces[:n]
        self.reencoded += n
        counts = [c for b in range(first, last + 1) for c in self.counts[b]][keep:]
        self.replace(first, last, self.pieces[first][:keep] + fresh + old[rest:], self.counts[first][:keep] + self.counter.counts(fresh) + counts[rest:])

    def replace(self, first: int, last: int, pieces: list[str], counts: list[int]) -> None:
        """The touched blocks take the new pre-tokens; the tree is laid out anew only when they no longer fit."""
        blocks = last - first + 1
        if len(pieces) > 4 * BLOCK * blocks:
            cuts = range(0, len(pieces), BLOCK)
            self.pieces[first : last + 1] = [pieces[i : i + BLOCK] for i in cuts]
            self.counts[first : last + 1] = [counts[i : i + BLOCK] for i in cuts]
            return self.grow()
        share = -(-len(pieces) // blocks)
        for k in range(blocks):
            part = slice(k * share, (k + 1) * share)
            self.pieces[first + k], self.counts[first + k] = pieces[part], counts[part]
            self.refresh(first + k)

    def stored(self) -> dict:
        blocks = [{"text": "".join(p), "lens": [len(x) for x in p], "counts": c} for p, c in zip(self.pieces, self.counts)]
        return {"blocks": blocks, "chars": self.chars.tolist(), "tokens": self.tokens.tolist()}

    @classmethod
    def load(cls, counter: Counter, state: dict) -> Tree:
        self = cls.__new__(cls)
        self.counter, self.reencoded, self.pieces, self.counts = counter, 0, [], []
        for b in state["blocks"]:
            ends = np.cumsum(np.asarray(b["lens"], np.int64)).tolist()
            self.pieces.append([b["text"][i:j] for i, j in zip([0, *ends], ends)])
            self.counts.append([int(c) for c in b["counts"]])
        self.chars, self.tokens = (np.array(state[k], np.int64) for k in ("chars", "tokens"))
        self.size = len(self.chars) // 2
        return self


def apply(tree: Tree, edits: Iterable[dict] | None) -> Tree:
    for e in edits if edits is not None else ():
        tree.edit(int(e["start"] or 0), int(e["stop"] or 0), e["new"] or "")
    return tree


def counted(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text, edits as EDITS, ...) with a struct column `counts` (fields of RESULT), which replaces one of that name; all
    other columns stay."""

    @F.pandas_udf(RESULT)
    def counts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for texts, edits in batches:
            rows = []
            for text, script in zip(texts, edits):
                tree = Tree(c, text if isinstance(text, str) else "")
                before, pieces = int(tree.tokens[1]), sum(map(len, tree.pieces))
                apply(tree, script)
                rows.append((before, int(tree.tokens[1]), pieces, tree.reencoded, len(tree), tree.text()))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return docs.withColumn("counts", counts("text", "edits"))


def trees(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, tree as STATE, n_tokens): what to keep for later edits."""

    @F.pandas_udf(STATE)
    def tree(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for texts in batches:
            yield pd.DataFrame([Tree(c, t if isinstance(t, str) else "").stored() for t in texts], columns=["blocks", "chars", "tokens"])

    return docs.select("doc_id", tree("text").alias("tree")).withColumn("n_tokens", F.col("tree.tokens")[1])


def updated(stored: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """Stored trees after edits (doc_id, ord, start, stop, new), applied by ord; documents without edits pass
    unchanged. The edits of one document go to its row, as each depends on those before it."""
    order = F.array_sort(F.collect_list(F.struct("ord", "start", "stop", "new")))
    scripts = edits.groupBy("doc_id").agg(F.transform(order, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["new"].alias("new"))).alias("edits"))

    @F.pandas_udf(STATE)
    def edited(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for states, script in batches:
            rows = [apply(Tree.load(c, s), e).stored() for s, e in zip(states.to_dict("records"), script)]
            yield pd.DataFrame(rows, columns=["blocks", "chars", "tokens"])

    both = stored.join(scripts, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("edits").isNull(), F.col("tree")).otherwise(edited("tree", "edits")).alias("tree")).withColumn("n_tokens", F.col("tree.tokens")[1])
