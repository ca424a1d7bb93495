"""Exact repeats of 50 bytes or more across documents, found with enhanced suffix arrays over the parts that can repeat.

A suffix array of everything doesn't fit a cluster's tasks, so suffixes are dealt to tasks such that equal strings of 50
bytes always meet. Of each such string the least 28-byte gram (by hash) is its anchor: the choice depends on the string
alone, and so does the place of the gram in it. (1) Texts are packed into buckets; copies in one bucket are one text of its
smallest doc_id. (2) Anchors are exchanged as packed hashes; an anchor that two texts have is reported back to them.
(3) Each text sends the contexts of those anchors: the bytes of all windows of 50 that have the anchor. Equal contexts
collapse to their smallest document, in the sending task and again where they meet. (4) There the suffixes of all contexts
of an anchor are sorted, common prefixes taken, and a stack scan of the intervals keeps those of 50 bytes or more before
which different bytes stand (maximal repeats), with all their occurrences; each removes what it covers in every document but the
smallest. A repeat longer than a context comes out as overlapping groups, joined again in the text.

An anchor with very many different contexts (the rim of a hot passage) is split by the longer prefixes of its suffixes: each
task scans the part that it holds, and only the first occurrence of each 50-byte prefix goes on to meet those of the other
parts. Every exchange is packed by slots of about `unit` bytes of text, streamed slot by slot, and what is held of a slot is
combined whenever it exceeds a limit, so memory follows neither the input nor its hottest string.

Later copies of a whole text of 50 bytes or more go as a whole. Matches never cross documents, overlaps count, and all is
judged on the input. Null texts are empty and stay; a null doc_id is neither smaller nor larger than any, so its row stays
whole and removes nothing; rows with one doc_id don't remove from each other; an empty table gives an empty result; other
columns are not read. Very long texts are handled in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexspark.llm.near_dedup import mixed
from codexspark.llm.shared import dropped, staged

LONG = 50  # bytes of a repeat
GRAM = 28  # bytes of an anchor: longer ones are shared by chance less often, shorter ones are fewer
SIDE = LONG - GRAM  # bytes that a window can have on either side of its anchor
SPAN = SIDE + 1  # grams in a window
BLOCK = 1 << 15  # windows that are looked at together
CHUNK = 1 << 20  # bytes of texts in a pack
ID = np.uint64(24)  # bits of a text's number in its bucket
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
LOW, TAG = np.uint64(0xFFFF), np.uint64(16)
HOTS, FLAGS, COVERS, ANCHORS, CONTEXTS, WINDOWS, PACKS = range(7)
#: One packet of an exchange: arrays for one slot. `batch` and `ids` name texts, the other fields are as its kind needs.
PACKET = "kind int, slot long, batch long, ids binary, docs binary, keys binary, tags binary, places binary, sizes binary, data binary"
COLUMNS = [c.split()[0] for c in PACKET.split(", ")]
ZSTD = zstandard.ZstdCompressor(level=1)
UNZSTD = zstandard.ZstdDecompressor()


@dataclass(frozen=True)
class Limits:
    """What tasks hold at a time; results don't depend on it."""

    unit: int = 16 << 20  # bytes of text in a bucket, and whose anchors meet at a time
    held: int = 1 << 20  # contexts that are held before they are combined
    flags: int = 1 << 22  # anchors, flags or spans
    sent: int = 1 << 18  # contexts that a text's task combines before it sends them
    hot: int = 1 << 10  # different contexts of an anchor in such a part above which its suffixes are dealt by prefix
    texts: int = 1 << 16  # texts whose anchors are looked at together


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hashes of all grams, built from those of 1, 2, 4, ... bytes."""
    have, length, out, size = x.astype(np.uint64) + np.uint64(1), 1, None, 0
    for bit in range(GRAM.bit_length()):
        if GRAM >> bit & 1:
            if out is None:
                out, size = have, length
            else:
                n = len(x) - size - length + 1
                out, size = have[:n] * power(size) + out[length : length + n], size + length
        if GRAM >> bit > 1:
            have = have[:-length] * power(length) + have[length:]
            length *= 2
    return out * MIX


def runs(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, last, place, hash) for each run of windows of bytes x that have one anchor."""
    n, found = len(x) - LONG + 1, []
    for at in range(0, n, BLOCK):
        h = gram_hashes(x[at : min(n, at + BLOCK) + LONG - 1])
        least, width = (h & ~LOW) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: len(h) - SPAN + 1], least[SPAN - width :])
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        place = (least[first] & LOW).astype(np.int64)
        found.append((first + at, np.r_[first[1:], len(least)] - 1 + at, place + at, h[place]))
    first, last, place, h = map(np.concatenate, zip(*found))
    return first, last, place, mixed(h)


def slices(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts of LONG bytes or more as (number, where the slice begins, bytes), about CHUNK bytes at a time. Slices of a long
    text overlap by a window less a byte."""
    group, held = [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) - LONG + 1, CHUNK):
            piece = t[a : a + CHUNK + LONG - 1]
            if group and held + len(piece) > CHUNK:
                yield group
                group, held = [], 0
            group.append((i, a, piece))
            held += len(piece)
    if group:
        yield group


def anchored(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(bytes, slice, first, last, place, hash): the runs of slices; the last two count in the joined bytes."""
    sizes = np.array([len(b) for _, _, b in group])
    starts = np.cumsum(sizes) - sizes
    x = np.frombuffer(b"".join(b for _, _, b in group), np.uint8)
    first, last, place, h = runs(x)
    own = np.searchsorted(starts, place, "right") - 1
    first, last = np.maximum(first, starts[own]), np.minimum(last, starts[own] + sizes[own] - LONG)
    good = first <= last
    return x, own[good], first[good], last[good], place[good], h[good]


# Arrays at rest.
def zipped(data: bytes) -> bytes:
    return ZSTD.compress(data)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return zipped(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def widened(data, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(UNZSTD.decompress(bytes(data)), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def steps(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return squeezed(np.diff(x, prepend=x.dtype.type(0)))


def sums(data, kind) -> np.ndarray:
    return np.cumsum(widened(data, kind), dtype=kind)


def packets(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(c) for c in COLUMNS] for r in rows], columns=COLUMNS).astype({"kind": "int32", "slot": "int64"}).astype({"batch": "Int64"})


def cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    if not len(x):
        return []
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return list(zip(at.tolist(), [*at[1:].tolist(), len(x)]))


def unit_of(tags: np.ndarray, units: int) -> np.ndarray:
    """The slot in which 64-bit tags meet; it ascends with them."""
    return ((tags >> np.uint64(32)) * np.uint64(units) >> np.uint64(32)).astype(np.int64)


def by_slot(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    return rows.repartition(parts, "slot").sortWithinPartitions("slot", "kind", *order)


def encoded(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


# 1: packs of distinct texts.
def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """(slot, key, doc, text) of (doc_id, text): copies collapse to the smallest doc_id, as far as a task meets them."""
    docs = docs.filter("doc_id is not null and octet_length(text) >= 50").select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list] = {}
        size = 0

        def out() -> pd.DataFrame:
            keys = list(held)
            heads = np.array([int.from_bytes(k[:4], "big") for k in keys], np.int64)
            return pd.DataFrame({"slot": heads * buckets >> 32, "key": keys, "doc": [v[0] for v in held.values()], "text": [v[1] for v in held.values()]})

        for b in batches:
            for doc, key, text in zip(b["doc_id"].tolist(), b["key"], b["text"]):
                have = held.get(key)
                if have is None:
                    held[key] = [doc, text]
                    size += len(text)
                elif doc < have[0]:
                    have[0] = doc
            if size >= 4 * CHUNK:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    return docs.mapInPandas(collapse, "slot long, key binary, doc long, text string")


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """PACKS of the texts of bucketed(): (slot, ids, docs, keys, sizes, data), about CHUNK bytes each, numbered in their slot."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, number, last = None, 0, None
        texts, docs, keys, size = [], [], [], 0

        def out() -> pd.DataFrame:
            ids = np.arange(number - len(texts), number, dtype=np.uint32)
            sizes = np.array([len(t) for t in texts], np.uint32)
            return packets([{"kind": PACKS, "slot": slot, "ids": ids.tobytes(), "docs": np.array(docs, np.int64).tobytes(), "keys": b"".join(keys), "sizes": sizes.tobytes(), "data": zipped(b"".join(texts))}])

        for b in batches:
            for s, key, doc, text in zip(b["slot"].tolist(), b["key"], b["doc"].tolist(), b["text"]):
                if (s, key) == last:
                    continue  # a later copy
                data = encoded(text)
                if texts and (s != slot or size + len(data) > CHUNK):
                    yield out()
                    texts, docs, keys, size = [], [], [], 0
                if s != slot:
                    slot, number = s, 0
                texts.append(data)
                docs.append(doc)
                keys.append(bytes(key))
                size, number, last = size + len(data), number + 1, (s, key)
        if texts:
            yield out()

    return rows.repartition(parts, "slot").sortWithinPartitions("slot", "key", "doc").mapInPandas(pack, PACKET)


def unpacked(r) -> tuple[list[bytes], np.ndarray]:
    """(texts, ids) of a pack."""
    data, ends = UNZSTD.decompress(bytes(r.data)), np.cumsum(np.frombuffer(bytes(r.sizes), np.uint32), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)], np.frombuffer(bytes(r.ids), np.uint32)


# 2: anchors that several texts have.
def flag_rows(who: np.ndarray, tags: np.ndarray) -> list[dict]:
    """FLAGS for the buckets of texts `who`."""
    order = np.lexsort((tags, who))
    who, tags = who[order], tags[order]
    bucket, ids = (who >> ID).astype(np.int64), (who & np.uint64((1 << 24) - 1)).astype(np.uint32)
    return [{"kind": FLAGS, "slot": int(bucket[i]), "ids": steps(ids[i:j]), "tags": squeezed(tags[i:j])} for i, j in cuts(bucket)]


def sent_anchors(packs: DataFrame, units: int, limits: Limits) -> DataFrame:
    """ANCHORS for the units where they meet, as the first 48 bits of their hashes. What two texts of a batch share is
    flagged at once, and one of them speaks for the batch, so a hot anchor sends one entry a batch."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, texts, numbers, size = None, [], [], 0

        def out() -> pd.DataFrame:
            codes = [(h & ~LOW) | np.array([i for i, _, _ in g], np.uint64)[own] for g in slices(texts) for _, own, _, _, _, h in [anchored(g)]]
            codes = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
            tags, ids = codes >> TAG << TAG, np.concatenate(numbers)[codes & LOW]
            new = np.r_[True, tags[1:] != tags[:-1]] if len(tags) else np.zeros(0, bool)
            many = ~new | ~np.r_[new[1:], True] if len(tags) else new
            rows = flag_rows(np.uint64(bucket) << ID | ids[many], tags[many])
            tags, ids = tags[new], ids[new].astype(np.uint32)
            unit = unit_of(tags, units)
            rows += [{"kind": ANCHORS, "slot": int(unit[i]), "batch": bucket, "ids": squeezed(ids[i:j]), "tags": steps(tags[i:j] >> TAG)} for i, j in cuts(unit)]
            return packets(rows)

        for b in batches:
            for r in b.itertuples(index=False):
                if texts and (r.slot != bucket or size >= limits.unit or len(texts) + len(r.ids) // 4 > limits.texts):
                    yield out()
                    texts, numbers, size = [], [], 0
                more, ids = unpacked(r)
                bucket = r.slot
                texts += more
                numbers.append(ids.astype(np.uint64))
                size += sum(map(len, more))
        if texts:
            yield out()

    return packs.mapInPandas(send, PACKET)


def shared_anchors(rows: DataFrame, parts: int, limits: Limits) -> DataFrame:
    """FLAGS: of each text the anchors that another text may have too."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, tags, who, many, n = None, [], [], [], 0

        def settle() -> list[dict]:
            """Flags of what is held; one entry of each anchor stays, which knows whether others had it."""
            nonlocal tags, who, many, n
            t, w, m = map(np.concatenate, (tags, who, many))
            order = np.argsort(t)
            t, w, m = t[order], w[order], m[order]
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            least = np.minimum.reduceat(w, starts)
            several = (least != np.maximum.reduceat(w, starts)) | np.logical_or.reduceat(m, starts)
            flagged = np.repeat(several, np.diff(np.r_[starts, len(t)]))
            tags, who, many, n = [t[starts]], [least], [several], len(starts)
            return flag_rows(w[flagged], t[flagged])

        for b in batches:
            for r in b.itertuples(index=False):
                if r.kind != ANCHORS:
                    continue
                if n and (r.slot != slot or n > limits.flags and len(tags) > 1):
                    yield packets(settle())
                if r.slot != slot:
                    slot, tags, who, many, n = r.slot, [], [], [], 0
                t = sums(r.tags, np.uint64) << TAG
                tags.append(t)
                who.append(np.uint64(r.batch) << ID | widened(r.ids, np.uint32))
                many.append(np.zeros(len(t), bool))
                n += len(t)
            passed = b[b["kind"] == FLAGS]
            if len(passed):
                yield passed
        if n:
            yield packets(settle())

    return by_slot(rows, parts).mapInPandas(meet, PACKET)


# 3: contexts.
@dataclass
class Contexts:
    """Windows of texts that share an anchor: its hash, its place, the bytes before and after it, zeros beyond them."""

    tag: np.ndarray
    who: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    left: np.ndarray
    right: np.ndarray
    side: np.ndarray

    def __len__(self) -> int:
        return len(self.tag)

    def __getitem__(self, at) -> Contexts:
        return Contexts(*(getattr(self, f.name)[at] for f in fields(self)))

    @classmethod
    def joined(cls, parts: list[Contexts]) -> Contexts:
        return cls(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)))

    def inside(self) -> np.ndarray:
        """Which of the bytes of `side` belong to a context."""
        at = np.arange(SIDE, dtype=np.uint8)
        return np.concatenate([at >= SIDE - self.left[:, None], at < self.right[:, None]], axis=1)

    def names(self) -> np.ndarray:
        """A hash of each context."""
        n = len(self)
        x = np.zeros((n, 48), np.uint8)
        x[:, : 2 * SIDE], x[:, 44], x[:, 45] = self.side, self.left, self.right
        out = self.tag
        for column, factor in zip(x.view(np.uint64).T, range(3, 15, 2)):
            out = mixed(out * power(factor) + column)
        return out


def cut_contexts(group: list[tuple[int, int, bytes]], wanted: np.ndarray, base: int, ids: np.ndarray, docs: np.ndarray, bucket: int) -> Contexts:
    """Contexts of the flagged anchors of slices; wanted has (number of the text from base on, tag) as codes in order."""
    x, own, first, last, place, h = anchored(group)
    text = np.array([i for i, _, _ in group])[own]
    code = (ids[text].astype(np.uint64) - np.uint64(base)) << np.uint64(48) | h >> TAG
    at = np.minimum(np.searchsorted(wanted, code), max(0, len(wanted) - 1))
    keep = np.flatnonzero(wanted[at] == code) if len(wanted) else np.zeros(0, np.int64)
    own, first, last, place, text = own[keep], first[keep], last[keep], place[keep], text[keep]
    starts = np.cumsum([0, *[len(b) for _, _, b in group]])[:-1]
    move = np.array([a for _, a, _ in group]) - starts
    pad = np.zeros(SIDE, np.uint8)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, x, pad]), 2 * SIDE + GRAM)[place]
    left, right = (place - first).astype(np.uint8), (last + SIDE - place).astype(np.uint8)
    side = np.concatenate([around[:, :SIDE], around[:, SIDE + GRAM :]], axis=1)
    out = Contexts(h[keep], np.uint64(bucket) << ID | ids[text].astype(np.uint64), docs[text], place + move[own], left, right, side)
    side[~out.inside()] = 0
    return out


def combined(c: Contexts) -> tuple[Contexts, Contexts]:
    """(first, late): equal contexts of larger documents are late."""
    name = c.names()
    order = np.argsort(name)
    starts = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
    if len(starts) == len(name):
        return c[order], c[:0]
    c = c[order]
    late = c.doc > np.repeat(np.minimum.reduceat(c.doc, starts), np.diff(np.r_[starts, len(c)]))
    return c[~late], c[late]


# 4: suffix arrays and the intervals of common prefixes.
def suffixes(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, prefix) of each window of each context: start counts from SIDE bytes before the anchor, prefix is a
    hash of the window's 50 bytes."""
    side = np.ascontiguousarray(c.side.T)
    ends = np.zeros((2 * SIDE + 1, len(c)), np.uint64)
    for i in range(2 * SIDE):
        ends[i + 1] = ends[i] * np.uint64(BASE) + side[i]
    # A window that starts at s has the anchor and the SIDE bytes of `side` from s on.
    inner = ends[SIDE:] - ends[: SPAN] * power(SIDE)
    start, context = np.nonzero((np.arange(SPAN)[:, None] >= SIDE - c.left.astype(np.int64)) & (np.arange(SPAN)[:, None] <= c.right.astype(np.int64)))
    return context, start, mixed(mixed(inner[start, context] * MIX + start.astype(np.uint64)) ^ c.tag[context])


def grouped(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, size) of runs of equal values."""
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(ids)])


def intervals(prefix: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the nodes of the common-prefix interval tree with at least so long a prefix, each
    after its children: a stack holds the open intervals."""
    open_: list[tuple[int, int]] = []
    for i, p in enumerate([*prefix, 0]):
        begin = i - 1
        while open_ and open_[-1][0] > p:
            size, begin = open_.pop()
            yield size, begin, i - 1
        if p >= least and (not open_ or open_[-1][0] < p):
            open_.append((p, begin))


def maximal_repeats(c: Contexts) -> Iterator[tuple[np.ndarray, ...]]:
    """(group, length, context, start) arrays: all occurrences of each maximal repeat of 50 bytes or more in contexts, which
    can't be extended by one byte on either side in all of them. Suffixes are in the order of a hash of their first 50 bytes
    and then of their bytes: only equal ones have to be neighbours."""
    context, start, prefix = suffixes(c)
    order = np.argsort(prefix)
    starts, sizes = grouped(prefix[order])
    # Only prefixes of several documents before which different bytes stand lead to maximal repeats that matter.
    before = np.where(start > SIDE - c.left[context].astype(np.int64), c.side[context, np.maximum(start - 1, 0)].astype(np.int64), -1 - np.arange(len(start)))
    spread = lambda v: np.minimum.reduceat(v, starts) < np.maximum.reduceat(v, starts)
    good = (sizes > 1) & spread(c.doc[context[order]]) & spread(before[order]) if len(order) else np.zeros(0, bool)
    order = order[np.repeat(good, sizes)]
    if not len(order):
        return
    context, start, prefix, before = context[order], start[order], prefix[order], before[order]
    starts, sizes = grouped(prefix)
    tails = np.zeros((len(c), 3 * SIDE + 2), np.uint8)
    tails[:, : 2 * SIDE] = c.side
    tail = np.lib.stride_tricks.sliding_window_view(tails.reshape(-1), 24)[context * tails.shape[1] + SIDE + start]
    order = np.lexsort((*tail.copy().view(">u8").astype(np.uint64).T[::-1], np.repeat(np.arange(len(starts)), sizes)))
    context, start, before, tail = context[order], start[order], before[order], tail[order]
    left = c.right[context].astype(np.int64) - start  # bytes after the window
    differ = tail[1:] != tail[:-1]
    same = np.where(differ.any(1), differ.argmax(1), 24)
    common = LONG + np.r_[0, np.minimum(same, np.minimum(left[1:], left[:-1]))]
    common[starts] = 0
    # Groups of two have one interval, no stack is needed.
    two = starts[sizes == 2]
    if len(two):
        both = (two[:, None] + np.arange(2)).reshape(-1)
        yield np.repeat(two, 2), np.repeat(common[two + 1], 2), context[both], start[both]
    rest = np.flatnonzero(np.repeat(sizes > 2, sizes))
    changes = np.cumsum(np.r_[0, before[1:] != before[:-1]])
    found = [(size, a, b) for size, a, b in intervals(common[rest].tolist(), LONG)]
    if found:
        size, a, b = np.array(found).T
        a, b = rest[a], rest[b]  # an interval lies in one group, so its places have no gaps
        keep = changes[b] > changes[a]
        size, a, b = size[keep], a[keep], b[keep]
        for at in range(0, len(a), 1 << 14):
            part = slice(at, at + (1 << 14))
            many = b[part] - a[part] + 1
            group = np.repeat(np.arange(len(many)), many)
            at_ = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a[part], many)
            yield np.repeat(-1 - at - np.arange(len(many)), many), size[part][group], context[at_], start[at_]


def late_windows(c: Contexts) -> np.ndarray:
    """Which windows (by start) of each context repeat one of a smaller document."""
    edges = np.zeros((len(c), SPAN + 1), np.int32)
    for group, size, context, start in maximal_repeats(c):
        starts, sizes = grouped(group)
        doc = c.doc[context]
        late = doc > np.repeat(np.minimum.reduceat(doc, starts), sizes)
        np.add.at(edges, (context[late], start[late]), 1)
        np.add.at(edges, (context[late], start[late] + size[late] - LONG + 1), -1)
    return np.cumsum(edges, axis=1)[:, :SPAN] > 0


def several(c: Contexts) -> Contexts:
    """Contexts of anchors that have more than one, in more than one document."""
    order = np.argsort(c.tag)
    starts, sizes = grouped(c.tag[order])
    if not len(order):
        return c
    doc = c.doc[order]
    good = (sizes > 1) & (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))
    return c[order[np.repeat(good, sizes)]]


# What tasks send on.
def cover_rows(who: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[dict]:
    """COVERS: spans that go, for the buckets of their texts."""
    order = np.lexsort((start, who))
    who, start, stop = who[order], start[order], stop[order]
    bucket, ids = (who >> ID).astype(np.int64), (who & np.uint64((1 << 24) - 1)).astype(np.uint32)
    return [{"kind": COVERS, "slot": int(bucket[i]), "ids": steps(ids[i:j]), "places": squeezed(start[i:j].astype(np.uint32)), "sizes": squeezed((stop - start)[i:j].astype(np.uint32))} for i, j in cuts(bucket)]


def whole_covers(c: Contexts) -> list[dict]:
    return cover_rows(c.who, c.place - c.left, c.place + GRAM + c.right)


def scanned(c: Contexts) -> tuple[list[dict], np.ndarray]:
    """(COVERS of the windows that the interval trees find late, mask of those)."""
    late = late_windows(c)
    edge = np.diff(np.pad(late, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (at, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    origin = c.place[at] - SIDE
    return cover_rows(c.who[at], origin + a, origin + b - 1 + LONG), late


def dealt_windows(c: Contexts, units: int) -> list[dict]:
    """COVERS of what is late among these contexts, and WINDOWS for the others: the first of each 50-byte prefix, dealt by it."""
    if not len(c):
        return []
    rows, late = scanned(c)
    context, start, prefix = suffixes(c)
    keep = np.flatnonzero(~late[context, start])
    keep = keep[np.argsort(prefix[keep])]
    context, start, prefix = context[keep], start[keep], prefix[keep]
    unit, bucket = unit_of(prefix, units), (c.who[context] >> ID).astype(np.int64)
    order = np.lexsort((bucket, unit))
    context, start, prefix, unit, bucket = context[order], start[order], prefix[order], unit[order], bucket[order]
    ids = (c.who[context] & np.uint64((1 << 24) - 1)).astype(np.uint32)
    place = (c.place[context] - SIDE + start).astype(np.uint32)
    for i, j in cuts(unit * (1 << 32) + bucket):
        rows.append({"kind": WINDOWS, "slot": int(unit[i]), "batch": int(bucket[i]), "ids": squeezed(ids[i:j]), "docs": squeezed(c.doc[context[i:j]]), "tags": steps(prefix[i:j]), "places": squeezed(place[i:j])})
    return rows


def context_rows(c: Contexts, units: int) -> list[dict]:
    """CONTEXTS of one bucket for the units where their anchors meet."""
    c = c[np.argsort(c.tag)]
    unit, rows = unit_of(c.tag, units), []
    for i, j in cuts(unit):
        part = c[i:j]
        ids = (part.who & np.uint64((1 << 24) - 1)).astype(np.uint32)
        names, which = np.unique(ids, return_inverse=True)
        docs = np.zeros(len(names), np.int64)
        docs[which] = part.doc
        rows.append({
            "kind": CONTEXTS, "slot": int(unit[i]), "batch": int(part.who[0] >> ID), "ids": steps(names), "docs": squeezed(docs), "keys": squeezed(which.astype(np.uint32)), "tags": steps(part.tag),
            "places": squeezed(part.place.astype(np.uint32)), "sizes": squeezed(part.left.astype(np.uint16) << np.uint16(8) | part.right), "data": zipped(part.side[part.inside()].tobytes()),
        })
    return rows


def contexts_in(r) -> Contexts:
    """Contexts of a packet."""
    which, ids, docs = widened(r.keys, np.uint32), sums(r.ids, np.uint32), widened(r.docs, np.int64)
    sizes = widened(r.sizes, np.uint16)
    left, right = (sizes >> np.uint16(8)).astype(np.uint8), sizes.astype(np.uint8)
    out = Contexts(sums(r.tags, np.uint64), np.uint64(r.batch) << ID | ids[which].astype(np.uint64), docs[which], widened(r.places, np.uint32).astype(np.int64), left, right, np.zeros((len(which), 2 * SIDE), np.uint8))
    out.side[out.inside()] = np.frombuffer(UNZSTD.decompress(bytes(r.data)), np.uint8)
    return out


def hot_rows(tags: np.ndarray, units: int) -> list[dict]:
    tags = np.unique(tags)
    unit = unit_of(tags, units)
    return [{"kind": HOTS, "slot": int(unit[i]), "tags": steps(tags[i:j])} for i, j in cuts(unit)]


def sent_contexts(rows: DataFrame, units: int, parts: int, limits: Limits) -> DataFrame:
    """CONTEXTS, COVERS, WINDOWS and HOTS from the FLAGS and PACKS of each bucket."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held, n, flags, size = None, [], 0, [], 0

        def sorted_flags() -> None:
            nonlocal flags, size
            ids, tags = map(np.concatenate, zip(*flags)) if flags else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
            order = np.lexsort((tags, ids))
            ids, tags = ids[order], tags[order]
            new = np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])] if len(ids) else np.zeros(0, bool)
            flags, size = [(ids[new], tags[new])], int(new.sum())

        def out() -> pd.DataFrame:
            nonlocal held, n
            first, late = combined(Contexts.joined(held))
            tags, counts = np.unique(first.tag, return_counts=True)
            hot = tags[counts > limits.hot]
            is_hot = np.isin(first.tag, hot)
            held, n = [], 0
            return packets(whole_covers(late) + hot_rows(hot, units) + dealt_windows(first[is_hot], units) + context_rows(first[~is_hot], units))

        for b in batches:
            for r in b.itertuples(index=False):
                if r.slot != bucket:
                    if n:
                        yield out()
                    bucket, flags, size = r.slot, [], 0
                if r.kind == FLAGS:
                    flags.append((sums(r.ids, np.uint32).astype(np.uint64), widened(r.tags, np.uint64)))
                    size += len(flags[-1][0])
                    if size > limits.flags and len(flags) > 1:
                        sorted_flags()
                    continue
                if len(flags) != 1:
                    sorted_flags()
                own = np.frombuffer(bytes(r.ids), np.uint32)
                a, z = np.searchsorted(flags[0][0], [own[0], own[-1] + 1])
                if a == z:
                    continue
                wanted = (flags[0][0][a:z] - np.uint64(own[0])) << np.uint64(48) | flags[0][1][a:z] >> TAG
                texts, ids = unpacked(r)
                docs = np.frombuffer(bytes(r.docs), np.int64)
                for g in slices(texts):
                    c = cut_contexts(g, wanted, int(own[0]), ids, docs, bucket)
                    if len(c):
                        held.append(c)
                        n += len(c)
                    if n > limits.sent:
                        yield out()
        if n:
            yield out()

    return by_slot(rows, parts).mapInPandas(send, PACKET)


def resolved(rows: DataFrame, units: int, parts: int, limits: Limits) -> DataFrame:
    """COVERS and WINDOWS from the CONTEXTS that meet in each unit; what is for others passes through."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, held, n, hot = None, [], 0, np.zeros(0, np.uint64)

        def settle(end: bool) -> pd.DataFrame:
            """At the end of a unit all is resolved. Before, the anchors with most contexts are dealt on by prefix, until half
            of what may be held is left."""
            nonlocal held, n, hot
            first, late = combined(Contexts.joined(held))
            rows = whole_covers(late)
            if not end:
                tags, counts = np.unique(first.tag, return_counts=True)
                order = np.argsort(-counts)
                over = np.cumsum(counts[order][::-1])[::-1] > limits.held // 2
                hot = np.union1d(hot, tags[order][over])
            is_hot = np.isin(first.tag, hot)
            rows += dealt_windows(first[is_hot], units)
            rest = first[~is_hot]
            if end:
                rest = several(rest)
                rows += scanned(rest)[0] if len(rest) else []
                held, n = [], 0
            else:
                held, n = [rest], len(rest)
            return packets(rows)

        for b in batches:
            for r in b.itertuples(index=False):
                if r.kind not in (HOTS, CONTEXTS):
                    continue
                if r.slot != slot:
                    if n:
                        yield settle(True)
                    slot, hot = r.slot, np.zeros(0, np.uint64)
                if r.kind == HOTS:
                    hot = np.union1d(hot, sums(r.tags, np.uint64))
                    continue
                held.append(contexts_in(r))
                n += len(held[-1])
                if n > limits.held:
                    yield settle(False)
            passed = b[b["kind"].isin([COVERS, WINDOWS])]
            if len(passed):
                yield passed
        if n:
            yield settle(True)

    return by_slot(rows, parts).mapInPandas(scan, PACKET)


def late_prefixes(rows: DataFrame, parts: int, limits: Limits) -> DataFrame:
    """COVERS of the WINDOWS that repeat one of a smaller document."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, held, n = None, [], 0

        def settle() -> pd.DataFrame:
            nonlocal held, n
            tags, who, docs, place = map(np.concatenate, zip(*held))
            order = np.argsort(tags)
            tags, who, docs, place = tags[order], who[order], docs[order], place[order]
            starts, sizes = grouped(tags)
            late = docs > np.repeat(np.minimum.reduceat(docs, starts), sizes)
            held = [(tags[~late], who[~late], docs[~late], place[~late])]
            n = len(held[0][0])
            return packets(cover_rows(who[late], place[late], place[late] + LONG))

        for b in batches:
            for r in b.itertuples(index=False):
                if n and (r.slot != slot or n > limits.held and len(held) > 1):
                    yield settle()
                if r.slot != slot:
                    slot, held, n = r.slot, [], 0
                held.append((sums(r.tags, np.uint64), np.uint64(r.batch) << ID | widened(r.ids, np.uint32).astype(np.uint64), widened(r.docs, np.int64), widened(r.places, np.uint32).astype(np.int64)))
                n += len(held[-1][0])
        if n:
            yield settle()

    return by_slot(rows, parts).mapInPandas(meet, PACKET)


# 5: what is left.
def united(ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of texts joined where they touch, by text and place."""
    order = np.lexsort((start, ids))
    ids, start, stop = ids[order], start[order], stop[order]
    reach = np.maximum.accumulate(ids << 33 | stop)
    new = np.flatnonzero(np.r_[True, (ids[1:] << 33 | start[1:]) > reach[:-1]]) if len(ids) else np.zeros(0, np.int64)
    return ids[new], start[new], (reach & ((1 << 33) - 1))[np.r_[new[1:] - 1, len(ids) - 1]] if len(ids) else stop


def cleaned(rows: DataFrame, parts: int, limits: Limits) -> DataFrame:
    """(key, doc, n_removed, n_spans, kept_sha256, kept) for each text, from the COVERS and PACKS of each bucket; kept
    is null where nothing goes."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, spans, n = None, [], 0

        def join() -> None:
            nonlocal spans, n
            spans = [united(*map(np.concatenate, zip(*spans)))] if spans else [tuple(np.zeros(0, np.int64) for _ in range(3))]
            n = len(spans[0][0])

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.slot != bucket:
                    bucket, spans, n = r.slot, [], 0
                if r.kind == COVERS:
                    start = widened(r.places, np.uint32).astype(np.int64)
                    spans.append((sums(r.ids, np.uint32).astype(np.int64), start, start + widened(r.sizes, np.uint32)))
                    n += len(start)
                    if n > limits.flags and len(spans) > 1:
                        join()
                    continue
                if len(spans) != 1:
                    join()
                texts, ids = unpacked(r)
                of, start, stop = spans[0]
                edges = np.searchsorted(of, np.r_[ids, ids[-1] + 1].astype(np.int64))
                keys, docs = bytes(r.keys), np.frombuffer(bytes(r.docs), np.int64)
                for i, t in enumerate(texts):
                    a, z = edges[i], edges[i + 1]
                    kept = None
                    if z > a:
                        gaps = zip([0, *stop[a:z].tolist()], [*start[a:z].tolist(), len(t)])
                        kept = b"".join([t[p:q] for p, q in gaps])
                    out.append((keys[16 * i : 16 * i + 16], docs[i], 0 if kept is None else len(t) - len(kept), z - a, None if kept is None else hashlib.sha256(kept).hexdigest(), kept))
            if out:
                yield pd.DataFrame(out, columns=["key", "doc", "n_removed", "n_spans", "kept_sha256", "kept"])

    return by_slot(rows, parts).mapInPandas(clean, "key binary, doc long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def joined_spans(rows: DataFrame, parts: int, limits: Limits) -> DataFrame:
    """COVERS, one or a few packets for each bucket."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, spans, n = None, [], 0

        def out() -> pd.DataFrame:
            ids, start, stop = united(*map(np.concatenate, zip(*spans)))
            return packets(cover_rows(np.uint64(bucket) << ID | ids.astype(np.uint64), start, stop))

        for b in batches:
            for r in b.itertuples(index=False):
                if spans and (r.slot != bucket or n > limits.flags):
                    yield out()
                    spans, n = [], 0
                bucket, start = r.slot, widened(r.places, np.uint32).astype(np.int64)
                spans.append((sums(r.ids, np.uint32).astype(np.int64), start, start + widened(r.sizes, np.uint32)))
                n += len(start)
        if spans:
            yield out()

    return by_slot(rows, parts).mapInPandas(join, PACKET)


def removed(docs: DataFrame, with_text: bool = False, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs, and what is left as `kept` (binary) if
    asked for."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(1, -(-total // limits.unit))
    packs = staged(packed(bucketed(docs, units), parts), "packs", release=True)
    flags = staged(shared_anchors(sent_anchors(packs, units, limits), parts, limits), "flags", release=True)
    found = staged(resolved(sent_contexts(packs.unionByName(flags), units, parts, limits), units, parts, limits), "found", release=True)
    dropped(flags)
    covers = found.filter(F.col("kind") == COVERS).unionByName(late_prefixes(found.filter(F.col("kind") == WINDOWS), parts, limits))
    covers = staged(joined_spans(covers, parts, limits), "covers", release=True)
    dropped(found)
    result = cleaned(packs.unionByName(covers), parts, limits)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(text)).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"), *([text.cast("binary").alias("whole")] if with_text else []))
    rows = rows.join(result if with_text else result.drop("kept"), "key", "left")
    whole = (F.col("doc_id") > F.col("doc")) & (F.col("n_bytes") >= LONG)  # a later copy
    free = F.col("doc_id").isNull()
    pick = lambda gone, part, none: F.when(free, none).when(whole, gone).otherwise(F.coalesce(part, none))
    out = [
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
    ]
    if with_text:
        out.append(pick(F.lit("").cast("binary"), F.col("kept"), F.col("whole")).alias("kept"))
    return rows.select("doc_id", "n_bytes", *out)
