"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

Each text becomes a few statistics (lengths, character classes, repetition, compression). Random Fourier features
approximate a Gaussian kernel over them; tasks sum the normal equations of their rows, fold by fold, so the driver adds a
few fixed-size matrices and solves. Scores of the folds left out feed an isotonic regression, which makes them rates.

Labels are learned only from rows that are not held out, at most MOST_ROWS of them (a hash picks them). Texts are read
once and never shuffled; statistics are staged as a narrow table.

Null and empty texts have statistics of zero and are scored like any other; repeated rows get equal scores; conflicting
labels of one id count as 1; without labels of both kinds scores are 0.5; an empty table gives an empty result; labels,
lang, source and doc_id are no inputs, nor is any other column.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexspark.llm.shared import interpolated, isotonic, staged
from codexspark.llm.toxicity import held_out, training_labels

MOST_ROWS = 60_000
FEATURES, RIDGE, FOLDS, SEED = 256, 1.0, 4, 20240517
TASKS = 16  # that sum normal equations of the labelled rows
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "long_words", "short_words", "distinct_words", "top_word",
    "same_as_last", "distinct_pairs", "log_lines", "same_lines", "words_a_line", "upper", "digits", "signs", "stops", "other_marks",
    "high_bytes", "spaces", "byte_entropy", "packed", "marked_words", "capital_words",
)
SIGNS, STOPS = b"#*$%&|<>{}[]\\^~@=_+/", b".!?,;:"


def classes() -> np.ndarray:
    """Of each byte: upper, digit, sign, stop, other mark, high, space."""
    out = np.zeros((256, 7))
    for b in range(256):
        c = chr(b)
        out[b] = [65 <= b <= 90, 48 <= b <= 57, b in SIGNS, b in STOPS, b < 128 and not c.isalnum() and not c.isspace() and b not in SIGNS and b not in STOPS, b >= 128, b < 128 and c.isspace()]
    return out


CLASSES = classes()


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, nb = len(words), len(data)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = byte[byte > 0] / nb
    upper, digits, signs, stops, other, high, spaces = (byte @ CLASSES / nb).tolist()
    pairs = len(set(zip(words, words[1:])))
    marked = sum(c * (w[-1] in SIGNS or w[-2:] in (b"!!", b"??")) for w, c in counts.items())
    capital = sum(c * w.isupper() for w, c in counts.items())
    return [
        math.log1p(nb), math.log1p(n), float(sizes.mean()), float(sizes.std()), float((sizes > 14).mean()), float((sizes < 3).mean()),
        len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, pairs / max(1, n - 1), math.log1p(len(lines)),
        1 - len(set(lines)) / len(lines), n / len(lines) / 20, upper, digits, signs, stops, other, high, spaces,
        float(-(share * np.log2(share)).sum()), len(zlib.compress(data, 1)) / (nb + 20), marked / n, capital / n,
    ]


def waves(d: int, features: int = FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases for a kernel whose width grows with the root of the number of statistics."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(d, features)) / (0.7 * math.sqrt(d)), rng.uniform(0, 2 * math.pi, features)


class Kernel:
    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w, self.b = waves(len(mean))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.c_[math.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))]


def fold_sums(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """(Z'Z, Z'y) for each fold: TASKS rows of fixed size reach the driver."""
    d = FEATURES + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((FOLDS, d, d + 1))
        for batch in batches:
            z, y = kernel(np.stack(batch["stats"].to_numpy())), batch["y"].to_numpy(float)
            for k in range(FOLDS):
                own = batch["fold"].to_numpy() == k
                out[k, :, :d] += z[own].T @ z[own]
                out[k, :, d] += z[own].T @ y[own]
        yield pd.DataFrame({"sums": [out.tobytes()]})

    total = np.zeros((FOLDS, d, d + 1))
    for (part,) in rows.coalesce(TASKS).mapInPandas(sums, "sums binary").toLocalIterator():
        total += np.frombuffer(bytes(part)).reshape(total.shape)
    return total[:, :, :d], total[:, :, d]


def with_statistics(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t if isinstance(t, str) else None) for t in texts], dtype=object)

    return docs.select("doc_id", stats("text").alias("stats"))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    rows = staged(with_statistics(docs), "quality-stats")
    train = F.broadcast(staged(training_labels(labels, "quality", folds, fold, most_rows), "quality-train"))
    own = rows.join(train, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    own = staged(own.select("stats", "y", "fold"), "quality-rows")
    kinds = own.select(F.min("y"), F.max("y")).first()
    raw, knots = F.lit(0.0), ([], [])
    if kinds[0] != kinds[1]:
        each = [f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(len(STATISTICS))]
        moments = np.array(own.agg(*[m.alias(f"m{i}") for i, m in enumerate(each)]).first(), float)
        kernel = Kernel(*np.split(moments, 2))
        a, b = fold_sums(own, kernel)
        ridge = RIDGE * np.diag([*[1.0] * FEATURES, 1e-6])
        solve = lambda k: np.linalg.solve(a.sum(0) - (a[k] if k is not None else 0) + ridge, b.sum(0) - (b[k] if k is not None else 0))
        weights, left_out = solve(None), np.stack([solve(k) for k in range(FOLDS)])

        @F.pandas_udf("double")
        def ridge_score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for stats, part in batches:
                z = kernel(np.stack(stats.to_numpy()))
                which = part.to_numpy()
                yield pd.Series(np.where(which < 0, z @ weights, (z * left_out[np.maximum(which, 0)]).sum(1)))

        got = own.select("y", ridge_score("stats", "fold").alias("raw")).toPandas()  # most_rows pairs of numbers
        knots = isotonic(got["raw"].to_numpy(), got["y"].to_numpy(float))
        raw = ridge_score("stats", F.lit(-1))
    scored = rows.select("doc_id", raw.alias("raw"))
    order = F.least(F.greatest(F.col("raw"), F.lit(0.0)), F.lit(1.0))  # equal rates keep the order of the raw scores
    score = 0.98 * interpolated(F.col("raw"), *knots) + 0.02 * order if knots[0] else F.lit(0.5)
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), score.alias("score")).select(
        "*", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted")
    )
