"""Embedding near-duplicates by randomised-rotation binary codes.

Vectors are compared when label and length are equal. Equal vectors of a label collapse into one class first, so exact copies
cost one row. A class's vector is normalised and turned by a random rotation; its code is the sign of each coordinate, that
is the vertex of the cube (scaled to length 1) nearest to it. Stored with the code are its correction factor f, the inner
product of vector and vertex, and the turned vector at 8 bits a coordinate. For two vectors x and y, <vertex x, y> / f(x)
estimates <x, y> without bias; its standard error is at most sqrt((1 - f^2) / (f^2 (D - 1))). A pair is computed exactly from
its vectors if both estimates, each with ERRORS standard errors added, reach NEAR. A second bound holds always: the angle
between vertex x and y is at most that between vertex x and x plus the link's. The higher of the two limits decides.

Candidates meet in hash tables: a key is `bits` signs of further random directions, tables are so many that a pair at NEAR is in
no common bucket with a probability below MISS; both follow from the number of vectors of the largest label. A bucket that is
larger than CHUNK is dealt over a grid of chunks, two in a task. First only codes are exchanged; members with a likely partner
then fetch their vectors and meet again. A pair counts in the first table in which it meets. A task sums links and joins
components of its own pairs, and writes one row for each member; no pairs are written.

Links are certain, since each is computed in double precision; a link is missed with a probability below MISS. What is exchanged
grows with the vectors and tables, but a group of M vectors that are near to one bucket key, and yet all different, is
compared pair by pair in M * M / CHUNK^2 tasks: the number of links asked for is exact.

Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows with a null label. Rows that
repeat a vec_id are vectors of their own, which only links join. A null vec_id has no links and no component and is kept.
Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexspark.llm.near_dedup import components
from codexspark.llm.shared import dropped, given_back, staged
from codexspark.llm.vectors import matrices

NEAR = 0.98
MISS = 1e-6
ERRORS = 6.0
FILL = 512  # vectors of the largest label that share a bucket if they lie at random
CHUNK = 1024  # members of a bucket that are dealt to one task
MOST_BITS = 31
AT_ONCE = 1 << 15  # pairs that are computed together
MEMBERS = "rep long, n long, code binary, factor float, turned binary, step float, keys binary"


@functools.cache
def rotation(size: int, number: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([11, size, number]).standard_normal((size, size)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def tables_of(largest: int) -> tuple[int, int]:
    """(bits, tables) for so many vectors in one label."""
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, largest) / FILL))))
    together = (1 - math.acos(NEAR) / math.pi) ** bits
    return bits, 1 if together == 1 else math.ceil(math.log(MISS) / math.log(1 - together))


def named(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, size, digest, embedding): digest names the vector, null for those that link with nothing."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [None] * len(batch), [None] * len(batch)
            for rows, values in matrices(batch.column("embedding")):
                for i, v in zip(rows.tolist(), values + 0.0):  # no negative zeros
                    if v.any():
                        sizes[i], digests[i] = len(v), xxhash.xxh128_digest(v.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], [*batch.schema.names, "size", "digest"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(name, f"vec_id long, label {kinds['label']}, embedding {kinds['embedding']}, size int, digest binary")
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    return out.withColumn("digest", F.when(usable, F.col("digest")))


def unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """MEMBERS with label and size, for classes (rep, n, label, embedding)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, values in matrices(batch.column("embedding")):
                size = values.shape[1]
                turns = max(1, -(-tables * bits // size))
                x = unit(values)
                turned = [x @ rotation(size, r).T for r in range(turns)]
                signs = np.concatenate(turned, 1)[:, : tables * bits] > 0
                keys = (signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits))).astype(np.int32)
                step = np.abs(turned[0]).max(1) / 127
                out = batch.take(pa.array(rows)).select(["rep", "n", "label"]).to_pandas()
                out["size"] = np.full(len(out), size, np.int32)
                out["code"] = [c.tobytes() for c in np.packbits(turned[0] > 0, axis=1)]
                out["factor"] = (np.abs(turned[0]).sum(1) / math.sqrt(size)).astype(np.float32)
                out["turned"] = [t.tobytes() for t in np.rint(turned[0] / step[:, None]).astype(np.int8)]
                out["step"] = step.astype(np.float32)
                out["keys"] = [k.tobytes() for k in keys]
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("rep", "n", "label", "embedding").mapInArrow(encode, f"rep long, n long, label {label}, size int, code binary, factor float, turned binary, step float, keys binary")


def dealt(codes: DataFrame, tables: int) -> DataFrame:
    """MEMBERS with (bucket, tab, cell, home): a member stands in its bucket of each table, once for each cell that it meets."""
    key = F.substring("keys", 4 * F.col("tab") + 1, 4)
    rows = codes.withColumn("tab", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    rows = rows.withColumn("bucket", F.concat_ws(":", F.col("label").cast("string"), "size", "tab", F.hex(key))).drop("label", "size")
    large = rows.groupBy("bucket").agg(F.count("*").alias("m")).filter(F.col("m") > CHUNK)
    rows = rows.join(staged(large, "large-buckets"), "bucket", "left")
    chunks = F.coalesce(F.ceil(F.col("m") / CHUNK), F.lit(1)).cast("long")
    home = F.pmod(F.xxhash64("rep"), chunks)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda k: F.least(k, home) * chunks + F.greatest(k, home))
    return rows.withColumn("home", home).withColumn("cell", F.explode(cells)).drop("m")


def limits(factor: np.ndarray, size: int) -> np.ndarray:
    """Least inner product of a vector's vertex with another vector that may be linked with it."""
    factor = np.minimum(factor.astype(np.float64), 1)
    rest = np.sqrt(1 - factor * factor)
    estimated = NEAR * factor - ERRORS * rest / math.sqrt(max(1, size - 1)) if size > 1 else np.full(len(factor), -2.0)
    certain = np.cos(np.minimum(math.pi, np.arccos(factor) + math.acos(NEAR)))
    return np.maximum(estimated, certain)


def likely(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of members of one cell that the codes allow and that meet here first."""
    turned = np.frombuffer(b"".join(rows["turned"]), np.int8).reshape(len(rows), -1)
    size, step = turned.shape[1], rows["step"].to_numpy(np.float32)
    turned = turned.astype(np.float32) * step[:, None]
    signs = np.unpackbits(np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1), axis=1, count=size).astype(np.float32)
    inner = (signs * 2 - 1) @ turned.T / np.float32(math.sqrt(size))
    slack = step * (0.5 * math.sqrt(size)) + 1e-4  # of rounding to 8 bits and of single precision
    able = inner + slack[None, :] >= limits(rows["factor"].to_numpy(), size)[:, None].astype(np.float32)
    able &= able.T
    home = rows["home"].to_numpy()
    if home.min() != home.max():  # each chunk has a cell of its own
        able &= home[:, None] != home[None, :]
    i, j = np.nonzero(np.triu(able, 1))
    tab = rows["tab"].iloc[0]
    if tab and len(i):
        keys = np.frombuffer(b"".join(rows["keys"]), np.int32).reshape(len(rows), -1)[:, :tab]
        first = np.concatenate([(keys[i[a : a + AT_ONCE]] != keys[j[a : a + AT_ONCE]]).all(1) for a in range(0, len(i), AT_ONCE)])
        i, j = i[first], j[first]
    return i, j


def by_cell(rows: DataFrame, work, result: str) -> DataFrame:
    """work(members of one bucket and cell) for each of them, in one pass over sorted partitions."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            bucket, cell = batch["bucket"].to_numpy(), batch["cell"].to_numpy()
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                part = batch.iloc[a:b]
                if held and len(part) and (held[0]["bucket"].iloc[0], held[0]["cell"].iloc[0]) != (part["bucket"].iloc[0], part["cell"].iloc[0]):
                    if sum(map(len, held)) > 1:
                        yield from work(pd.concat(held, ignore_index=True))
                    held = []
                held += [part] if len(part) else []
        if sum(map(len, held)) > 1:
            yield from work(pd.concat(held, ignore_index=True))
        given_back()

    return rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInPandas(walk, result)


def with_partners(members: DataFrame) -> DataFrame:
    """(bucket, tab, cell, home, rep) of members with a likely partner."""

    def work(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        i, j = likely(rows)
        if len(i):
            yield rows.loc[np.unique(np.concatenate([i, j])), ["bucket", "tab", "cell", "home", "rep"]]

    return by_cell(members, work, "bucket string, tab int, cell long, home long, rep long")


def cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(1))
    parts = [np.einsum("nd,nd->n", x[a], x[b]) / (norms[a] * norms[b]) for a, b in ((i[k : k + AT_ONCE], j[k : k + AT_ONCE]) for k in range(0, len(i), AT_ONCE))]
    return np.concatenate(parts) if parts else np.zeros(0)


def links_of(members: DataFrame) -> DataFrame:
    """(rep, root, links): for each cell its members that have links, the smallest member reachable by the cell's links, and
    how many vectors they are linked with here. Members have vectors."""

    def work(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        i, j = likely(rows)
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        near = cosines(x, i, j) >= NEAR
        i, j = i[near], j[near]
        if not len(i):
            return
        rep, n = rows["rep"].to_numpy(), rows["n"].to_numpy()
        links, root = np.zeros(len(rows), np.int64), rep.copy()
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        while True:
            least = np.minimum(root[i], root[j])
            if (root[i] == least).all() and (root[j] == least).all():
                break
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
        used = links > 0
        yield pd.DataFrame({"rep": rep[used], "root": root[used], "links": links[used]})

    return by_cell(members, work, "rep long, root long, links long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    rows = staged(named(vectors), "named")
    first = F.min(F.struct("vec_id", "embedding")).alias("first")
    classes = rows.filter("digest is not null").groupBy("label", "size", "digest").agg(first, F.count("*").alias("n"))
    classes = staged(classes.select("label", "size", "digest", "n", "first.*").withColumn("rep", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label", "size").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    bits, tables = tables_of(largest)
    codes = staged(coded(classes, bits, tables), "codes")
    near = staged(with_partners(dealt(codes, tables)), "partners", release=True)
    own = codes.drop("label", "size").join(classes.select("rep", "embedding"), "rep")
    found = staged(links_of(near.join(own, "rep")), "links", release=True)
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    done = classes.select("label", "digest", "rep", "vec_id", "n").join(sums, "rep", "left").join(labels, "rep", "left")
    done = staged(done.withColumn("component", F.coalesce("component", "rep")), "done", release=True)
    least = done.groupBy("component").agg(F.min("vec_id").alias("least"))
    done = done.join(least, "component").select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least")
    out = rows.select("vec_id", "label", "digest").join(done, ["label", "digest"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    dropped(near)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
