"""Compression of vectors to one byte for each of their parts, with codebooks by integer k-means and exponion search.

Components become floor(1024 x), vectors are cut into PARTS equal parts, and each part position has a codebook of up to 256
entries, at first those parts of the vectors with the smallest ids. A round assigns every part to its nearest entry and puts
each used entry at the floor of its parts' mean; after the last round parts are assigned once more.

Assignment is exponion search. It starts at the entry that the part had before and walks that entry's list of all entries,
sorted by their distance from it. With u the part's distance to its old entry and v to the best one so far, an entry further
than u + v from the old one is further than v from the part, so the walk ends there; v shrinks on the way. All distances are
exact integers, the bound is rounded up, and of equally near entries the one with the lower index is taken, so the result is
that of a full scan.

A round is one pass that writes vectors and codes at rest and one that sums them where they lie; only the sums of the codebooks
(PARTS x 256 entries) reach the driver and only codebooks go to the tasks, however many rows there are. A lost executor
costs the tasks of one pass.

Rows whose vector is null or holds null or non-finite components are left out; other columns are not read. A null vec_id is
kept and comes last in the choice of first entries; equal ids are ordered by their vectors; equal vectors are entries of
their own, of which the lower is used. Fewer than 256 vectors give as many entries. Vectors shorter than the longest, and all
where the length is no multiple of PARTS, are filled up with zeros. Components are held within +-limit(length), about 2 ** 27
for 64 of them, so that no squared distance passes 64 bits. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexspark.llm.shared import dropped, staged
from codexspark.llm.vectors import gathered, matrices

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
STEP = 32  # entries of a list that are looked at together
TOGETHER = 32 << 20  # bytes of vectors that are assigned together


def limit(length: int) -> int:
    """Largest component for which a squared distance of so many components stays below 2 ** 62 and a component fits 32 bits."""
    return min(math.isqrt((1 << 62) // max(1, length)) // 2, (1 << 31) - 1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of y, exactly."""
    most = max((int(np.abs(m).max()) if m.size else 0 for m in (x, y)), default=0)
    if x.shape[1] * most * most < 1 << 52:  # then each partial sum is an integer that double precision holds
        products = (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    else:
        products = x @ y.T
    return (x * x).sum(1)[:, None] - 2 * products + (y * y).sum(1)[None, :]


class Codebook:
    """The entries of one part position (rows of integers), and for each its list of all entries by their distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = squared(entries, entries)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1).astype(np.float64)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for rows of x, of which `start` names the entry they had."""
        best, near = start.astype(np.int64), ((x - self.entries[start]) ** 2).sum(1)
        by = np.argsort(start, kind="stable")
        for live in np.split(by, np.flatnonzero(np.diff(start[by])) + 1) if len(by) else []:
            order, gaps = self.order[start[live[0]]], self.gaps[start[live[0]]]
            first = np.sqrt(near[live].astype(np.float64))
            for at in range(0, len(order), STEP):
                radius = (first + np.sqrt(near[live].astype(np.float64))) ** 2 * (1 + 1e-9) + 1
                inside = gaps[at] <= radius
                live, first = live[inside], first[inside]
                if not len(live):
                    break
                block = order[at : at + STEP]
                d = squared(x[live], self.entries[block])
                least = d.min(1)
                index = np.where(d == least[:, None], block, len(order)).min(1)
                better = (least < near[live]) | ((least == near[live]) & (index < best[live]))
                best[live[better]], near[live[better]] = index[better], least[better]
        return best, near


def integers(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, ints) of the rows that are kept, and how many components each has; ints are packed 32-bit numbers."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    length = max(0, -(-longest // PARTS) * PARTS)
    most = limit(length)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ints = [np.zeros(0, np.int64)], []
            for rows, values in matrices(batch.column("embedding")):
                whole = np.zeros((len(rows), length), np.int32)
                whole[:, : values.shape[1]] = np.clip(np.floor(values * SCALE), -most, most)
                at.append(rows)
                ints += [row.tobytes() for row in whole]
            kept = batch.take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array(ints, pa.binary())], ["vec_id", "label", "ints"])

    label = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    return rows.mapInArrow(pack, f"vec_id long, label {label}, ints binary"), length


def unpacked(column: pd.Series, length: int) -> np.ndarray:
    """(parts, rows, components) as 64-bit integers."""
    return np.frombuffer(b"".join(column), np.int32).astype(np.int64).reshape(len(column), PARTS, length // PARTS).transpose(1, 0, 2)


def assigned(rows: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """rows (vec_id, label, ints, codes) with new codes and their error; codes are bytes, at first null."""
    label = rows.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [Codebook(b) for b in books]
        for batch in gathered(batches, max(1, TOGETHER // (8 * max(1, length)))):
            x = unpacked(batch["ints"], length)
            before = np.frombuffer(b"".join(bytes(PARTS) if c is None else c for c in batch["codes"]), np.uint8).reshape(-1, PARTS)
            found = [own[p].nearest(x[p], before[:, p]) for p in range(PARTS)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            out = batch[["vec_id", "label", "ints"]].copy()
            out["codes"] = [c.tobytes() for c in codes]
            out["error"] = np.sum([f[1] for f in found], 0)
            yield out

    return rows.select("vec_id", "label", "ints", "codes").mapInPandas(assign, f"vec_id long, label {label}, ints binary, codes binary, error long")


def sums(rows: DataFrame, length: int) -> DataFrame:
    """(part, entry, n, total): how many parts an entry has, and the sum of each of their components. Each task sends a row for
    an entry at most."""
    width = length // PARTS

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), object)
        for batch in gathered(batches, max(1, TOGETHER // (8 * max(1, length)))):
            x = unpacked(batch["ints"], length)
            codes = np.frombuffer(b"".join(batch["codes"]), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                by = np.argsort(codes[:, p], kind="stable")
                used, first, many = np.unique(codes[by, p], return_index=True, return_counts=True)
                n[p, used] += many
                if width:
                    total[p, used] += np.add.reduceat(x[p, by], first).astype(object)
        part, entry = np.nonzero(n)
        yield pd.DataFrame({"part": part, "entry": entry, "n": n[part, entry], "total": [[str(v) for v in total[p, e]] for p, e in zip(part, entry)]})

    each = rows.mapInPandas(add, "part long, entry long, n long, total array<string>").select("part", "entry", "n", F.posexplode_outer("total").alias("at", "v"))
    return each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("total"))


def moved(books: list[np.ndarray], rows: DataFrame, length: int) -> list[np.ndarray]:
    """Codebooks whose used entries are at the floor of their parts' means."""
    books = [b.copy() for b in books]
    for r in sums(rows, length).filter("at is not null").collect():  # PARTS x ENTRIES x components at most
        books[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books


def compressed(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, error) for each vector that is kept, and the codebooks, one for each part position."""
    ints, length = integers(vectors)
    rows = staged(ints.withColumn("codes", F.lit(None).cast("binary")), "vectors")
    first = rows.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).toPandas()
    books = list(unpacked(first["ints"].map(bytes), length))
    for step in range(ROUNDS + 1 if len(first) else 0):
        if step:
            books = moved(books, rows, length)
        after = staged(assigned(rows, books, length), "codes")
        dropped(rows)
        rows = after
    if not len(first):
        rows = rows.withColumn("error", F.lit(None).cast("long"))
    return rows.select("vec_id", "label", "codes", "error"), books


def printed(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def decompressed(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows with `restored`, the vector that codes stand for."""

    @F.pandas_udf("array<double>")
    def restore(codes: pd.Series) -> pd.Series:
        c = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, PARTS)
        return pd.Series(list(np.concatenate([b[c[:, p]] for p, b in enumerate(books)], 1) / SCALE))

    return rows.withColumn("restored", restore("codes"))


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the error of all rows with the same label (nulls together); null where it passes 64 bits."""
    by = staged(rows.groupBy(F.col("label").alias("__label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return rows.join(by, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
