"""SentencePiece encoding and decoding with a given model: batched numpy Viterbi.

Distinct words of a batch are grouped by length and advance together, one character at a time. The hashes of all
substrings probe the sorted hashes of the pieces; at each position a vectorised maximum over the sums of the candidate
lengths stores the backpointer. A unigram model's pieces add their scores and pairs nothing. A BPE model's scores are merge
ranks, not log probabilities, so its pieces add nothing and its pairs add 0, or minus infinity if merging would not leave
them apart (see `admissible`): of the candidates that end at a place exactly one has a finite sum, and the path of the
maximum is exactly what the model encodes.

Texts are normalised as the model says (identity with space written as U+2581 and a leading one added); unknown
characters fall back to byte pieces where the model has them, to its unknown piece where not.

Each row is handled alone, without a shuffle; workers keep a bounded cache of words. Null texts give null ids and empty
ones an empty array; repeated rows give equal results; an empty table gives an empty one; other columns are not
touched. Very long texts, even without a space, take time and memory in proportion to their length.
"""

from __future__ import annotations

import functools
import itertools
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexspark.llm.shared import given_back

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)
NONE, UNKNOWN = -1, -2
CELLS = 1 << 16  # characters that advance together
TEXT = 1 << 21  # characters of texts whose words are looked up together
CACHE = 160_000  # words in each of two generations that a worker remembers
BITS, PAIR_BITS = 18, 20  # of the tables that hashes and pairs are looked up in first
FAR = np.int64(1) << np.int64(40)


class Model:
    """Pieces of a model file, their hashes in sorted order and, for BPE, how each is merged."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that keep texts as they are can be used")
        kinds = proto.ModelProto.SentencePiece
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.bpe = m.trainer_spec.model_type == proto.TrainerSpec.BPE
        normal = [(i, p.piece, p.score) for i, p in enumerate(m.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        unknown = next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        self.setup(normal, len(m.pieces), byte, unknown, {i for i, p in enumerate(m.pieces) if p.type == kinds.CONTROL})

    @classmethod
    def of(cls, pieces: dict[str, float], bpe: bool = False) -> Model:
        """From pieces and scores: ids count from 1 in the given order, 0 is the unknown piece."""
        self = cls.__new__(cls)
        self.prefix, self.bpe = True, bpe
        self.setup([(i + 1, p, s) for i, (p, s) in enumerate(pieces.items())], len(pieces) + 1, {}, 0, set())
        return self

    def setup(self, normal: list[tuple[int, str, float]], size: int, byte: dict[int, int], unknown: int, silent: set[int]) -> None:
        self.byte, self.unknown = byte, unknown
        self.longest = max(len(p) for _, p, _ in normal)
        self.powers = np.cumprod(np.r_[np.uint64(1), np.repeat(BASE, 2 * self.longest)], dtype=np.uint64)
        self.text = {i: p for i, p, _ in normal}
        self.score = np.zeros(size)
        self.hash = np.zeros(size, np.uint64)
        self.chars = np.zeros(size, np.int64)
        for i, p, s in normal:
            h = 0
            for c in p:
                h = (h * int(BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
            self.score[i], self.hash[i], self.chars[i] = s, h, len(p)
        ids = np.array([i for i, _, _ in normal], np.int32)
        keys = self.hash[ids] * MIX + self.chars[ids].astype(np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        #: The one key with some leading bits, -1 for none, -2 where several keys have them and a search is needed.
        slots = (self.keys >> np.uint64(64 - BITS)).astype(np.int64)
        self.slots = np.full(1 << BITS, NONE, np.int32)
        self.slots[slots] = np.arange(len(slots))
        self.slots[slots[np.flatnonzero(slots[1:] == slots[:-1])]] = UNKNOWN
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        self.usable = np.ones(size, bool)
        if self.bpe:
            self.trees(normal, size)
        #: What a piece adds to a path; index UNKNOWN, the last but one, is an unknown character.
        self.gain = np.zeros(size + 2)
        if not self.bpe:
            self.gain[:size], self.gain[UNKNOWN] = self.score, self.score.min() - 10
        #: Where a word surely ends: before a run of spaces, unless a piece reaches over that.
        joined = any(re.search(f"[^{SPACE}]{SPACE}", p) for _, p, _ in normal)
        #: Marks that no piece has after a letter: a word surely ends before them.
        self.ends = "".join(c for c in string.punctuation if not any(re.search(rf"[^\W\d_]{re.escape(c)}", p) for _, p, _ in normal))
        self.simple = not joined and not any("\n" in p for _, p, _ in normal)
        self.units = re.compile(r"(?s).+" if joined else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        #: Words without such marks; what stands before the marks at a word's end; those, and all other words; what is left.
        ends = re.escape(self.ends)
        marks = f"[{ends}]++(?![^ \n])" if ends else "(?!)"
        self.fast = re.compile(rf" ?[^ \n{ends}]++(?![^ \n])| ?[^ \n]*[^\W\d_](?={marks})| ?[^ \n]+|\n| ")
        raw = [b""] * size
        for i, p, _ in normal:
            raw[i] = p.encode()
        for b, i in byte.items():
            raw[i] = bytes([b])
        if unknown not in silent:
            raw[unknown] = " ⁇ ".encode()
        self.raw = raw
        #: Pairs asked for before, by a slot of their key; a newer pair takes the slot.
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_good = np.zeros(1 << PAIR_BITS, bool)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def find(self, hashes: np.ndarray, length) -> np.ndarray:
        """Ids of the pieces with these hashes and lengths, NONE where there is none."""
        keys = hashes * MIX + np.asarray(length, np.uint64)
        at = self.slots[keys >> np.uint64(64 - BITS)]
        out = np.full(keys.shape, NONE, np.int64)
        likely = np.nonzero(at != NONE)
        some, at = keys[likely], at[likely]
        many = np.flatnonzero(at == UNKNOWN)
        at[many] = np.minimum(np.searchsorted(self.keys, some[many]), len(self.keys) - 1)
        out[likely] = np.where(self.keys[at] == some, self.ids[at], NONE)
        return out

    # How BPE merges a piece, from its own characters: the last merge's halves, and what lies along its two edges.
    def trees(self, normal: list[tuple[int, str, float]], size: int) -> None:
        by_text = {p: (i, s) for i, p, s in normal}
        halves: dict[int, tuple[int, int]] = {}
        for i, p, _ in normal:
            parts, last = list(p), None
            while len(parts) > 1:
                best = max(((by_text[a + b][1], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in by_text), default=None)
                if best is None:
                    break
                k = -best[1]
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [last[0] + last[1]]
            if len(parts) > 1 or last and not (last[0] in by_text and last[1] in by_text):
                self.usable[i] = False
            elif last:
                halves[i] = (by_text[last[0]][0], by_text[last[1]][0])
        rank = np.where(self.chars == 1, -1, np.round(-self.score)).astype(np.int64)
        if any(rank[i] < max(rank[a], rank[b]) for i, (a, b) in halves.items()):
            raise ValueError("a piece is merged before its halves")

        def edge(side: int) -> np.ndarray:
            """For each piece the ids along one edge, from the whole inwards; NONE after the last."""
            out = np.full((size, self.longest), NONE, np.int32)
            for i, _, _ in normal:
                at, x = 0, i
                while True:
                    out[i, at], at = x, at + 1
                    if x not in halves:
                        break
                    x = halves[x][side]
            return out[:, : int((out != NONE).sum(1).max())]

        self.left, self.right, self.rank = edge(0), edge(1), rank

    def admissible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a and b ends with a and b. It doesn't if at some time an x on a's right
        edge and a y on b's left edge lie side by side and join to a piece that ranks before what either would become.
        Of equal ranks the leftmost merges first, which is a's own before the join, and the join before b's own."""
        good = np.ones(len(a), bool)
        for i in range(self.right.shape[1]):
            x = self.right[a, i]
            if (x == NONE).all():
                break
            x_ends = self.rank[self.right[a, i - 1]] if i else np.full(len(a), FAR)
            for j in range(self.left.shape[1]):
                y = self.left[b, j]
                if (y == NONE).all():
                    break
                y_ends = self.rank[self.left[b, j - 1]] if j else np.full(len(b), FAR)
                at = np.flatnonzero(good & (x != NONE) & (y != NONE) & (self.rank[x] <= y_ends) & (self.rank[y] < x_ends))
                if not len(at):
                    continue
                xs, ys = x[at], y[at]
                both = self.find(self.hash[xs] * self.powers[self.chars[ys]] + self.hash[ys], self.chars[xs] + self.chars[ys])
                rank = np.where(both == NONE, FAR, self.rank[both])
                good[at[(rank < x_ends[at]) & (rank <= y_ends[at]) & (both != NONE)]] = False
        return good

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """admissible(), remembered by pair."""
        pairs = a * np.int64(len(self.hash)) + b
        slots = (pairs.astype(np.uint64) * MIX >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        good = self.pair_good[slots]
        new = np.flatnonzero(self.pair_keys[slots] != pairs)
        if len(new):
            fresh, back = np.unique(pairs[new], return_inverse=True)
            good[new] = self.admissible(*np.divmod(fresh, len(self.hash)))[back]
            self.pair_keys[slots[new]] = pairs[new]
            self.pair_good[slots[new]] = good[new]
        return good

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) for words of one length, given as code points: what ends at each position on the best path."""
        n, length = words.shape
        sums = np.zeros((n, length + 1), np.uint64)
        for i in range(length):
            sums[:, i + 1] = sums[:, i] * BASE + words[:, i].astype(np.uint64)
        found = []  # (end, word, length, id) of all candidates
        for l in range(1, min(self.longest, length) + 1):
            ids = self.find(sums[:, l:] - sums[:, :-l] * self.powers[l], l)
            good = self.usable[ids] & (ids != NONE)
            if l == 1:
                ids, good = np.where(good, ids, UNKNOWN), np.ones_like(good)
            w, start = np.nonzero(good)
            found.append((start + l, w, np.full(len(w), l), ids[w, start]))
        end, word, size, piece = map(np.concatenate, zip(*found))
        order = np.argsort(end, kind="stable")
        word, size, piece = word[order], size[order], piece[order]
        steps = np.searchsorted(end[order], np.arange(1, length + 2))
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((n, length + 1), NONE, np.int32)
        sizes = np.zeros((n, length + 1), np.int32)
        for i in range(1, length + 1):
            part = slice(steps[i - 1], steps[i])
            w, l, ids = word[part], size[part], piece[part]
            total = best[w, i - l] + self.gain[ids] + self.pair_gain(last[w, i - l], ids)
            finite = np.flatnonzero(total > -np.inf)
            up = finite[np.argsort(total[finite], kind="stable")]  # of a word's candidates the greatest comes last
            w, l, ids = w[up], l[up], ids[up]
            best[w, i], last[w, i], sizes[w, i] = total[up], ids, l
        return last, sizes

    def pair_gain(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What piece b adds to a path that ends with a, besides its own score. Unknown characters join nothing; NONE is the
        beginning."""
        out = np.zeros(len(a))
        if self.bpe:
            both = np.flatnonzero((a >= 0) & (b >= 0))
            out[both] = np.where(self.allowed(a[both], b[both]), 0.0, -np.inf)
        return out

    def fallback(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def learn(self, words: list[str]) -> None:
        """Encode words and remember their ids as bytes."""
        for length, group in itertools.groupby(sorted(words, key=len), key=len):
            group = list(group)
            step = max(1, CELLS // length)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                joined = "".join(part).replace(" ", SPACE)
                codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                last, size = self.viterbi(codes)
                rows = np.arange(len(part))
                ids = np.full((len(part), length), NONE, np.int32)
                to, strange = np.full(len(part), length), np.zeros(len(part), bool)
                for column in range(length - 1, -1, -1):  # back along the pointers, all words at once
                    piece = np.where(to > 0, last[rows, to], NONE)
                    strange |= piece == UNKNOWN
                    ids[:, column] = piece
                    to = to - size[rows, to]
                    if not to.any():
                        break
                flat = ids[ids != NONE].tobytes()
                ends = (4 * np.cumsum((ids != NONE).sum(1))).tolist()
                for word, a, b in zip(part, [0, *ends], ends):
                    self.cache[word] = flat[a:b]
                for i in np.flatnonzero(strange).tolist():
                    out, k, word = [], length, part[i].replace(" ", SPACE)
                    while k:
                        out.append([int(last[i, k])] if last[i, k] >= 0 else self.fallback(word[k - 1]))
                        k -= int(size[i, k])
                    self.cache[part[i]] = np.array([x for o in reversed(out) for x in o], np.int32).tobytes()

    def normal(self, text: str) -> str:
        return ((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else ""

    def cut(self, text: str) -> list[str]:
        """The units of a text. Where single spaces part its words and no piece has a line's end, splitting at both,
        and before marks after a word, gives the same, faster, and finds more words again."""
        if not self.simple or not self.prefix or not text or text[0] == " " or "  " in text or SPACE in text:
            return self.units.findall(self.normal(text))
        return self.fast.findall(f" {text}")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; about TEXT characters of them are in work at a time."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= TEXT:
                out += self.encode_part(part)
                part, size = [], 0
        return out + self.encode_part(part)

    def encode_part(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(t) for t in texts]
        units = set(itertools.chain.from_iterable(cut))
        known = self.cache
        new = [u for u in units if u not in known]
        if len(known) + len(new) > CACHE:  # words of this part stay
            self.older, self.cache = known, {u: known[u] for u in units if u in known}
            known = self.cache
        if new:
            older = self.older
            known.update({u: older[u] for u in new if u in older})
            self.learn([u for u in new if u not in known])
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), np.int32) for x in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, U+2581 as space, the added leading space dropped."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode(text: Column, path: str) -> Column:
    """Ids of a text column under the model file at path, which every executor must have."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model(path)
        for texts in batches:
            have = [t if isinstance(t, str) else "" for t in texts]
            yield pd.Series([x if isinstance(t, str) else None for x, t in zip(m.encode(have), texts)], dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model(path)
        for rows in batches:
            yield pd.Series([None if r is None else m.decode(np.asarray(r, np.int32)) for r in rows], dtype=object)

    return text(ids)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) for each row of docs; round_trip: decoding gives the text again, with
    spaces for U+2581."""

    @F.pandas_udf("n_tokens long, ids array<int>, round_trip boolean")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for texts in batches:
            null = [not isinstance(t, str) for t in texts]
            have = ["" if n else t for t, n in zip(texts, null)]
            ids = m.encode(have)
            given_back()
            same = [None if n else m.decode(i) == t.replace(SPACE, " ") for i, t, n in zip(ids, have, null)]
            yield pd.DataFrame({"n_tokens": [len(i) for i in ids], "ids": pd.Series([None if n else i for i, n in zip(ids, null)], dtype=object), "round_trip": pd.Series(same, dtype=object)})

    return docs.select("doc_id", both(F.col(text)).alias("got")).select("doc_id", "got.*")
