"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets collapse into one class first, so a group of copies costs one row however large it is.
Class representatives are signed (128 minima) and banded (32 bands of 4: a pair at 0.75 is missed with probability 5e-6).
Candidates of a band are held together batch by batch of their signatures and dropped once the posterior probability of
0.75 or more falls below MISS; survivors are verified on their full shingle sets. Components come from confirmed links.

No bucket's pairs are written out. First each bucket is a star around its smallest id, which joins large groups at once.
Only buckets that then still hold several components are looked into again: members of the largest one are dealt over
chunks, the others meet every chunk, and signatures are compared inside the task. One round lets each member name one
partner in another component; the last confirms all pairs that are left, in the task where they meet first, so that no
link between different texts is lost.

A bucket whose other members are too many for that (texts that share boilerplate, but are not alike) is split by finer keys:
sets at 0.75 share one of the first quarter (and one) of their shingles in any common order, here from rare to frequent, so
each member goes to the buckets of those instead, where boilerplate comes last. That loses no pair. What is still
too large after that is dealt over a grid of chunks of which a task sees two.

A shingle set has the distinct runs of five words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased), or the whole of fewer words.
Texts without words, null ones too, are linked with nothing; a null doc_id has no component and is kept; rows that repeat
a doc_id count as one document with all their links; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexspark.llm.shared import dropped, given_back, staged

SIZE, NEAR = 5, 0.75
ROWS, BANDS = 4, 32
MINIMA = ROWS * BANDS
BATCH = 16  # signature bytes compared at a time
MISS = 1e-6
CHUNK = 512  # members of a bucket (long texts count more) that are dealt to one task
HEAVY = 4096  # shingles that count as a member
SLOTS = 20  # bits of the table of shingle frequencies: 2 ** 20 counters at most reach the driver
WORDS = 200_000  # word hashes that a worker remembers
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


RANDOM = np.random.default_rng(7)
PLACES = RANDOM.integers(1, 1 << 63, SIZE, np.uint64) | np.uint64(1)
FACTORS = RANDOM.integers(1, 1 << 63, MINIMA, np.uint64) | np.uint64(1)
SHIFTS = RANDOM.integers(1, 1 << 63, MINIMA, np.uint64)


class Shingles:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of a text's shingles."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > WORDS:
                self.known.clear()
            for i, h in enumerate(found):
                if h is None:
                    found[i] = self.known[words[i]] = xxhash.xxh64_intdigest(words[i])
        h = np.array(found, np.uint64)
        if len(h) < SIZE:
            return mixed((h * PLACES[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
        n = len(h) - SIZE + 1
        return np.unique(mixed(functools.reduce(np.add, (h[i : i + n] * PLACES[i] for i in range(SIZE)))))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, MASK)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        out = np.minimum(out, (part[None, :] * FACTORS[:, None] + SHIFTS[:, None]).min(1))
    return out >> np.uint64(16)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sig): digest names the shingle set, null for an empty one."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, salt = Shingles(), np.arange(1, BANDS + 1, dtype=np.uint64) * PLACES[0]
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(text if isinstance(text, str) else None)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                m = minima(s)
                bands = mixed(functools.reduce(lambda a, b: mixed(a) + b, m.reshape(BANDS, ROWS).T, salt))
                rows.append((len(s), xxhash.xxh128_hexdigest(s.tobytes()), bands.view(np.int64), (mixed(m) & np.uint64(255)).astype(np.uint8).tobytes()))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "bands", "sig"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out
        del shingles
        given_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(sign, "doc_id long, n_shingles long, digest string, bands array<long>, sig binary")


@functools.cache
def least_matches(miss: float = MISS) -> np.ndarray:
    """For each batch the matching bytes under which a resemblance of NEAR or more has a posterior below `miss`. A byte
    matches by resemblance or, one time in 256, by chance; the prior is flat."""
    p = np.linspace(0, 1, 2001)
    q, out = p + (1 - p) / 256, []
    for n in range(BATCH, MINIMA + 1, BATCH):
        with np.errstate(divide="ignore"):
            logs = np.array([float(np.log(float(comb(n, m)))) for m in range(n + 1)])[:, None] + np.arange(n + 1)[:, None] * np.log(q) + (n - np.arange(n + 1)[:, None]) * np.log(np.maximum(1 - q, 1e-300))
        like = np.exp(logs)
        out.append(int(np.argmax(like[:, p >= NEAR].sum(1) / like.sum(1) >= miss)))
    return np.array(out)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (rows of bytes) survive; sizes alone rule out some."""
    alive = np.flatnonzero(100 * np.minimum(na, nb) >= 75 * np.maximum(na, nb))
    matches = np.zeros(len(alive), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches += (a[alive, part] == b[alive, part]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(-1, MINIMA)


def pruned(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of which the signatures don't rule out a link."""
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("rep").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("n_shingles").alias(f"n_{side}")), side)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                keep = likely(signatures(p["sig_a"]), signatures(p["sig_b"]), p["n_a"].to_numpy(), p["n_b"].to_numpy())
                yield p[["a", "b"]].iloc[keep]

    return pairs.mapInPandas(prune, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets resemble each other enough."""
    for side in "ba":
        pairs = pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, last = Shingles(), (None, None)
        for p in batches:
            keep = []
            for x, y in zip(p["text_a"], p["text_b"]):
                if x is not last[0]:
                    last = (x, shingles(x))
                s, t = last[1], shingles(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= 75 * (len(s) + len(t) - both))
            yield p[["a", "b"]][np.array(keep, bool)]
        given_back()

    return pairs.mapInPandas(confirm, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): large-star and small-star steps until nothing changes. Sums of
    a node's neighbours are combined before they are shuffled, and joins with them can be split, so hubs do no harm."""
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "large-star")
        dropped(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small-star")
        dropped(large)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def weighed(members: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, rep, component, n_shingles, outside, weight, inner) for members of buckets that hold several components: the
    weights of the whole bucket and of all outside its largest component."""
    own = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").join(reps.select("rep", "n_shingles"), "rep")
    own = own.withColumn("component", F.coalesce("component", "rep"))
    parts = own.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(1 + F.col("n_shingles") / HEAVY).alias("w"))
    major = F.max(F.struct("w", "component"))
    open_ = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("w").alias("weight"), (F.sum("w") - major["w"]).alias("outside"), major["component"].alias("major")).filter("parts > 1")
    return own.join(open_.drop("parts"), "key").withColumn("inner", F.col("component") == F.col("major")).drop("major")


def dealt(members: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cell, rep, component, inner, grid, home, n_shingles, sig, bands) for buckets (key, rep) that hold several
    components. A bucket's largest component is dealt over chunks (inner), the other members go to every chunk; if those are
    more than a chunk, all members go to the cells of a grid in which their chunk meets another."""
    own = weighed(members, reps, labels).join(reps.select("rep", "sig", "bands"), "rep")
    chunks, grid = F.ceil(F.col("weight") / CHUNK).cast("long"), F.col("outside") > CHUNK
    home = F.pmod(F.xxhash64("rep"), chunks)
    every = F.sequence(F.lit(0).cast("long"), chunks - 1)
    cells = F.when(grid, F.transform(every, lambda k: F.least(k, home) * chunks + F.greatest(k, home))).when(F.col("inner"), F.array(home)).otherwise(every)
    return own.select("key", "rep", "component", "n_shingles", "sig", "bands", "inner", grid.alias("grid"), home.alias("home"), F.explode(cells).alias("cell"))


class Group:
    """One cell of a bucket: which members may be linked across components."""

    def __init__(self, rows: pd.DataFrame):
        self.rep, self.part, self.n, self.home = (rows[c].to_numpy() for c in ("rep", "component", "n_shingles", "home"))
        self.sig, self.bands = signatures(rows["sig"]), np.stack(rows["bands"].to_numpy())
        inner, key = rows["inner"].to_numpy(), rows["key"].iloc[0]
        self.outer = np.flatnonzero(~inner)
        self.across = bool(rows["grid"].iloc[0]) and self.home.min() != self.home.max()
        #: So that each pair meets in one cell only.
        self.meets = np.ones(len(rows), bool) if rows["grid"].iloc[0] else inner | (self.home == rows["cell"].to_numpy())
        at = np.flatnonzero(self.bands[0] == key)
        self.band = int(at[0]) if len(at) else 0  # 0: a finer key, which no band has

    def partners(self, i: int) -> np.ndarray:
        """Members of other components that the signatures allow, if this is the first bucket that both are in."""
        j = np.flatnonzero(self.meets & (self.part != self.part[i]) & ((self.home != self.home[i]) | (not self.across)))
        j = j[likely(np.broadcast_to(self.sig[i], (len(j), MINIMA)), self.sig[j], np.full(len(j), self.n[i]), self.n[j])]
        return j[(self.bands[j, : self.band] != self.bands[i, : self.band]).all(1)]


def rare_first(pool: DataFrame) -> DataFrame:
    """(rep, key): keys of the first n - ceil(0.75 n) + 1 shingles of each text of pool (rep, text), in the order of how often
    the slot of their hash occurs in pool, then of the hash. Two sets at 0.75 or more share one of them, whatever the order;
    this one keeps what many texts have for last."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, sums = Shingles(), np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(sums, shingles(text) >> np.uint64(64 - SLOTS), 1)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"slot": at, "n": sums[at]})

    often = np.zeros(1 << SLOTS, np.int64)
    found = pool.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    often[found["slot"].to_numpy()] = found["n"].to_numpy()

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for batch in batches:
            reps, keys = [], []
            for rep, text in zip(batch["rep"].tolist(), batch["text"]):
                s = shingles(text)
                first = s[np.lexsort((s, often[s >> np.uint64(64 - SLOTS)]))][: len(s) - (3 * len(s) + 3) // 4 + 1]
                reps.append(np.full(len(first), rep))
                keys.append(mixed(first + PLACES[1]).view(np.int64))
            yield pd.DataFrame({"rep": np.concatenate(reps), "key": np.concatenate(keys)}) if reps else pd.DataFrame({"rep": [], "key": []}, dtype="int64")

    return pool.mapInPandas(name, "rep long, key long")


def by_group(rows: DataFrame, work, result: str) -> DataFrame:
    """work(rows of one key and cell) for each of them, in one pass over sorted partitions."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key, cell = batch["key"].to_numpy(), batch["cell"].to_numpy()
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1]
            for i, j in zip(cuts, cuts[1:]):
                yield from work(batch.iloc[i:j])
            rest = batch.iloc[cuts[-1] :] if len(batch) else None
        if rest is not None and len(rest):
            yield from work(rest)
        given_back()

    return rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInPandas(walk, result)


def one_each(groups: DataFrame) -> DataFrame:
    """Likely pairs (a, b): each member names one partner of another component."""

    def work(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        g = Group(rows)
        for i in g.outer.tolist():
            j = g.partners(i)
            if len(j):
                a, b = np.minimum(g.rep[i], g.rep[j]), np.maximum(g.rep[i], g.rep[j])
                pick = mixed(a.astype(np.uint64) * PLACES[1] + b.astype(np.uint64) * PLACES[2]).argmin()
                yield pd.DataFrame({"a": a[pick : pick + 1], "b": b[pick : pick + 1]})

    return by_group(groups, work, "a long, b long").distinct()


def all_left(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that are left in any group. Members with a likely partner fetch their text; pairs are then confirmed
    where they meet, so what is exchanged grows with the members, not with their pairs."""
    columns = "key long, rep long, component long, n_shingles long, sig binary, bands array<long>, inner boolean, grid boolean, home long, cell long"

    def needed(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        g, used = Group(rows), np.zeros(len(rows), bool)
        for i in g.outer.tolist():
            j = g.partners(i)
            used[j] = True
            used[i] |= len(j) > 0
        if used.any():
            yield rows[used][[c.split()[0] for c in columns.split(", ")]]

    def confirm(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        g, shingles, up, links = Group(rows), Shingles(), {}, []
        sets = [shingles(t) for t in rows["text"]]

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for i in g.outer.tolist():
            for j in g.partners(i).tolist():
                x, y = root(g.part[i]), root(g.part[j])
                if x != y:  # else linked already
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        up[max(x, y)] = min(x, y)
                        links.append((min(g.rep[i], g.rep[j]), max(g.rep[i], g.rep[j])))
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])

    rows = staged(by_group(groups, needed, columns), "left")
    return by_group(rows.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep"), confirm, "a long, b long").distinct()


def buckets(keys: DataFrame) -> DataFrame:
    """(key, rep, center) of (key, rep) where a key has several members; center is the smallest."""
    live = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("center")).filter("n > 1")
    return staged(keys.join(live, "key").select("key", "rep", "center"), "buckets", release=True)


def starred(members: DataFrame, reps: DataFrame, texts: DataFrame, tried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tried, links): pairs of each bucket's members with its center, and those of them that are links."""
    stars = members.filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    if tried is not None:
        stars = stars.join(tried, ["a", "b"], "left_anti")
    new = staged(pruned(stars, reps), "tried")
    return new, staged(confirmed(new, texts), "confirmed", release=True)


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) with more links (a, b)."""
    return labels if links.isEmpty() else components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, labels): rows (doc_id, n_shingles, digest), classes (digest, rep), labels (node, component)."""
    rows = staged(signed(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sig")).alias("first")
    reps = staged(rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(first).select("digest", "first.*"), "classes", release=True)
    members = buckets(reps.select("rep", F.explode("bands").alias("key")))
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(involved, "doc_id"), "texts", release=True)
    tried, links = starred(members, reps, texts)
    labels = components(links)
    hot = staged(weighed(members, reps, labels).filter(F.col("outside") > CHUNK).select("key", "rep"), "hot")
    if not hot.isEmpty():
        pool = staged(texts.select(F.col("doc_id").alias("rep"), "text").join(hot.select("rep").distinct(), "rep"), "hot-texts", release=True)
        fine = buckets(rare_first(pool))
        more, links = starred(fine, reps, texts, tried)
        labels, tried = extended(labels, links), tried.unionByName(more)
        members = members.join(hot.select("key").distinct(), "key", "left_anti").unionByName(fine)
    for left in (False, True):
        groups = dealt(members.select("key", "rep"), reps, labels)
        new = all_left(groups, texts) if left else confirmed(staged(one_each(groups).join(tried, ["a", "b"], "left_anti"), "tried"), texts)
        labels = extended(labels, staged(new, "confirmed", release=True))
    dropped(texts)
    return rows.select("doc_id", "n_shingles", "digest"), reps.select("digest", "rep"), labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    rows, classes, labels = linked(docs)
    classes = classes.join(labels, classes["rep"] == labels["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = rows.join(classes, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component (or have no id)."""
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
