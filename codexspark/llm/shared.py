"""What the operators of this subpackage share: reading, staging, words and small numeric helpers."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexspark.sources import staging
from codexspark.sources.staging import shared_dir, staged

#: White space of every word pattern here: a word is `[^\x20\x09-\x0D]+`. bytes.split() cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches handed to Python by rows and bytes, so that very long texts can't fill a worker. This is a
    setting of the session: it holds for all queries after this one, and changes no results."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(rows: DataFrame, column: str, label: str) -> DataFrame:
    """rows at rest like staged() ones, but in buckets by a column, as many as Spark's shuffle partitions: a join on the column
    reads them where they lie and shuffles its other side only."""
    spark = rows.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    out.staged_path, out.staged_table = path, name
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged and bucketed tables that no later result is computed from."""
    staging.dropped(*tables)
    for rows in tables:
        if hasattr(rows, "staged_table"):
            rows.sparkSession.sql(f"DROP TABLE IF EXISTS {rows.staged_table}")


def given_back() -> None:
    """Hand memory that is free again to the system: a Python worker lives on, and the stages after this one share its
    executor. Does nothing where the C library can't."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row: a lambda's argument is bound, never inlined again."""
    return F.transform(F.array(value), body)[0]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, prior: float = 1.0) -> tuple[list[float], list[float]]:
    """Knots (x, rate) of the increasing step function nearest to y by x, found by pooling adjacent violators; each
    block stands at its mean, drawn a little (by `prior` rows) towards the overall rate, so that few rows never give 0
    or 1."""
    weight = np.ones(len(x)) if weight is None else weight
    order = np.argsort(x, kind="stable")
    xs, first = np.unique(x[order], return_index=True)
    sums = [np.add.reduceat((v * weight)[order], first) if len(first) else np.zeros(0) for v in (x, y, np.ones(len(x)))]
    blocks: list[list[float]] = []
    for a, b, n in zip(*(s.tolist() for s in sums)):
        blocks.append([a, b, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top)]
    rate = sum(b[1] for b in blocks) / max(1.0, sum(b[2] for b in blocks))
    rates = np.maximum.accumulate([(b[1] + prior * rate) / (b[2] + prior) for b in blocks]) if blocks else np.zeros(0)
    return [b[0] / b[2] for b in blocks], rates.tolist()


def interpolated(value: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear between knots, flat beyond them."""
    if not xs:
        return F.lit(0.5)
    ax, ay = F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))

    def at(i: Column) -> Column:
        x0, y0, x1, y1 = (F.get(a, j) for j in (i - 1, i) for a in (ax, ay))
        return F.when(i == 0, F.lit(ys[0])).when(i == len(xs), F.lit(ys[-1])).otherwise(y0 + (y1 - y0) * (value - x0) / (x1 - x0))

    return let(F.size(F.filter(ax, lambda x: x <= value)), at)
