"""Quality rules: compression bands.

Zstandard ratios of the whole document and of fixed chunks are held against limits for their length. A ratio below
its band means repetition, above it text that hardly compresses (random strings, encoded data). The limits come from the
table itself, without labels: one pass takes the median and the upper quartile of the ratios of all texts in each class of
length (half octaves of bytes), and the band reaches a few times their distance to either side. A class's limits are drawn
towards fixed wide ones by PRIOR rows, so few rows decide little. The second pass judges each row alone: no shuffle of texts,
memory bounded by the Arrow batch and one text.

Nulls and empty texts have no words and fail the base rule; ties and repeated rows are judged alike, each row alone;
an empty table gives an empty result; extra columns never meet the operator, which reads doc_id and text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, base_failed boolean, kept boolean"
)


#: (up to so many bytes, lowest ratio, highest ratio) before a table is looked at: short texts carry the frame's overhead and
#: less context, so their band lies higher.
WIDE = ((256, 0.40, 1.60), (1024, 0.32, 0.95), (4096, 0.27, 0.80), (float("inf"), 0.22, 0.72))
PRIOR = 20  # rows that the fixed limits count as
DOWN, UP = 4.0, 6.0  # reach of a band, in distances from the median to the upper quartile
LEAST_DOWN, LEAST_UP = 0.06, 0.25  # and at least, in parts of the median


@dataclass(frozen=True)
class Bands:
    limits: tuple[tuple[float, float, float], ...] = WIDE
    chunk: int = 4096
    #: A document fails if more than this share of its chunks lie outside their band on one side.
    chunk_share: float = 0.34
    level: int = 3

    def of(self, n: int) -> tuple[float, float]:
        return next((low, high) for most, low, high in self.limits if n <= most)


def length_class(n: int) -> int:
    """Half octaves of bytes: class c has those above 2 ** (c / 2), up to 2 ** ((c + 1) / 2)."""
    return int(np.ceil(2 * np.log2(n))) - 1


def fitted_bands(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> Bands:
    """Bands from the ratios of all texts of a table; the driver sees three numbers for each class of length."""

    @F.pandas_udf("class int, ratio double")
    def ratios(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        zstd = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        for texts in batches:
            data = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
            yield pd.DataFrame({"class": [length_class(len(x)) if x else None for x in data], "ratio": [len(zstd.compress(x)) / len(x) if x else None for x in data]}).astype({"class": "Int32", "ratio": "float64"})

    found = docs.filter(F.length(text) > 0).select(ratios(F.col(text)).alias("r")).select("r.*")
    found = found.groupBy("class").agg(F.count("*").alias("n"), F.percentile_approx("ratio", [0.5, 0.75], 10_000).alias("q"))
    limits = []
    for row in sorted(found.collect(), key=lambda r: r["class"]):
        (middle, upper), most = row["q"], 2 ** ((row["class"] + 1) / 2)
        down, up = max(DOWN * (upper - middle), LEAST_DOWN * middle), max(UP * (upper - middle), LEAST_UP * middle)
        low, high = bands.of(most)
        share = row["n"] / (row["n"] + PRIOR)
        limits += [(2 ** (row["class"] / 2), *bands.of(most)), (most, share * (middle - down) + (1 - share) * low, share * (middle + up) + (1 - share) * high)]
    gaps = {m: (m, a, b) for m, a, b in reversed([*limits, *bands.limits])}  # a class's own limits come before the fixed ones
    return replace(bands, limits=tuple(gaps[m] for m in sorted(gaps)))


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words (a power of two) found twice or more in the text. Windows are
    named exactly by doubling: ids of halves make ids of wholes, so no hash can collide."""
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    step = 1
    while step < window:
        keys = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        names, ids = np.unique(keys, return_inverse=True)
        if len(names) == len(ids):
            return 0
        step *= 2
    again = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def judge(text: str | None, bands: Bands, zstd: zstandard.ZstdCompressor) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n_words = len(words)
    gaps = sum(data.count(c) for c in b" \t\n\x0b\x0c\r")
    word_chars = len(text or "") - gaps
    symbols = sum(data.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = repeat_words(words)
    base_failed = n_words < 20 or 100 * repeated > 30 * n_words
    packed = lambda b: len(zstd.compress(b)) / len(b)
    ratio, chunks, low, high, fits = None, 0, 0, 0, True
    if data:
        ratio = packed(data)
        least, most = bands.of(len(data))
        fits = least <= ratio <= most
        if len(data) > bands.chunk:
            for at in range(0, len(data), bands.chunk):
                part = data[at : at + bands.chunk]
                (least, most), r = bands.of(len(part)), packed(part)
                chunks, low, high = chunks + 1, low + (r < least), high + (r > most)
            fits = fits and max(low, high) <= bands.chunk_share * chunks
    return n_words, word_chars, symbols, len(lines) - len(set(lines)), repeated, ratio, chunks, low, high, base_failed, fits and not base_failed


def quality_rules(docs: DataFrame, text: str = "text", bands: Bands = Bands(), out: str = "rules") -> DataFrame:
    """docs with a struct column (fields of RESULT) for every row; `out` names it, in case docs has a `rules`."""

    @F.pandas_udf(RESULT)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        zstd = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        for texts in batches:
            rows = [judge(t if isinstance(t, str) else None, bands, zstd) for t in texts]
            yield pd.DataFrame(rows, columns=names)

    return docs.withColumn(out, rules(F.col(text)))


def filter_quality(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """The rows of docs that pass, with their own columns only; the bands are the table's own if none are given."""
    return quality_rules(docs, "text", bands or fitted_bands(docs), "__rules").filter("__rules.kept").drop("__rules")
