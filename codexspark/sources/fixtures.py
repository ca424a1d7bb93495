"""Containers made from driver tables, for queries and tests: text is cut into records, encoded, and assembled."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from codexspark.functions.binary import be, let
from codexspark.functions.codecs import RECORD, by_row, lz, lz_record
from codexspark.sources import writer

NO_TAGS = "array<struct<tag:int,data:binary>>"
#: A dictionary for every fixture: all bytes, then pairs of frequent letters as phrases of two codes, nine bits a code.
PAIRS = [bytes(p) for p in itertools.product(b" etaonirshldcumf", repeat=2)]


def packed(codes: list[int]) -> bytes:
    bits = "".join(format(511 - c, "09b") for c in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bits) // 8), "big")


def huff_record() -> bytes:
    """Every code has nine bits: the first byte doesn't end it, so the search by least codes is used."""
    table1 = b"".join((9).to_bytes(4, "big") for _ in range(256))
    table2 = b"".join(((0 if n == 9 else (1 << n)) & 0xFFFFFFFF).to_bytes(4, "big") + ((511 if n == 9 else (1 << n) - 1) & 0xFFFFFFFF).to_bytes(4, "big") for n in range(1, 33))
    return b"HUFF" + (24).to_bytes(4, "big") + (24).to_bytes(4, "big") + (24 + 1024).to_bytes(4, "big") + bytes(8) + table1 + table2


def cdic_record() -> bytes:
    phrases = [bytes((i,)) for i in range(256)] + [packed([p[0], p[1]]) for p in PAIRS]
    at, offsets, body = 2 * len(phrases), b"", b""
    for i, p in enumerate(phrases):
        offsets += (at + len(body)).to_bytes(2, "big")
        body += (len(p) | (0x8000 if i < 256 else 0)).to_bytes(2, "big") + p
    return b"CDIC" + (16).to_bytes(4, "big") + len(phrases).to_bytes(4, "big") + (9).to_bytes(4, "big") + offsets + body


PLACES = {p: 256 + i for i, p in enumerate(PAIRS)}


def huff(b: bytes) -> bytes:
    codes, i = [], 0
    while i < len(b):
        pair = PLACES.get(b[i : i + 2])
        codes.append(b[i] if pair is None else pair)
        i += 1 if pair is None else 2
    return packed(codes)


huff_encoded = by_row(huff)


def cut(code):
    """A text's pieces of RECORD bytes, each coded."""

    @F.pandas_udf(ArrayType(BinaryType()))
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([[code(bytes(t[i : i + RECORD])) for i in range(0, max(len(t), 1), RECORD)] for t in texts], dtype=object)

    return each.asNondeterministic()  # called once for each row


lz_records, huff_records = cut(lz), cut(huff)


def text_records(docs: DataFrame, size: int = RECORD) -> DataFrame:
    """(doc_id, seq from 1, chunk) of (doc_id, text): pieces of so many bytes, which may split a character."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.ceil(F.length("bytes") / size).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))
    rows = docs.select("doc_id", data.alias("bytes")).select("doc_id", F.posexplode(F.when(n > 0, pieces).otherwise(F.array(F.lit(b"")))).alias("seq", "chunk"))
    return rows.withColumn("seq", F.col("seq") + 1)


def n_text_records(text: str = "text") -> Column:
    """Records that a text is cut into; an empty one has one."""
    return F.greatest(F.ceil(F.length(F.encode(F.coalesce(text, F.lit("")), "UTF-8")) / RECORD).cast("int"), F.lit(1))


def record0(n_bytes: Column, n: Column, compression: int, values: dict[str, Column] | None, tags: Column | None, name: Column | None, newer: bool) -> Column:
    known = {"text_encoding": F.lit(65001), "version": F.lit(6), "uid": F.coalesce(F.col("doc_id"), F.lit(0)), "document_type": F.lit(2), "image_index": n + 1}
    if compression == 17480:
        known |= {"huff_rec_index": n + 1, "huff_rec_count": F.lit(2), "image_index": n + 3}
    tags = F.array().cast(NO_TAGS) if tags is None else tags
    full = F.encode(F.coalesce(name, F.lit("")) if name is not None else F.lit(""), "UTF-8")
    return writer.record0_bytes(F.lit(compression), n_bytes, n, known | (values or {}), tags, full, newer=newer)


def records(docs: DataFrame, compression: int = 1, values: dict[str, Column] | None = None, tags: Column | None = None, name: Column | None = None, newer: bool = False) -> DataFrame:
    """(doc_id, seq, data) for containers of (doc_id, text, ...): record 0, text, dictionary records for 17480."""
    coded = {1: lambda c: c, 2: lz_record, 17480: huff_encoded}[compression]
    texts = text_records(docs).select("doc_id", "seq", coded(F.col("chunk")).alias("data"))
    n_bytes = F.length(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    n = F.greatest(F.ceil(n_bytes / RECORD).cast("int"), F.lit(1))
    zero = docs.select("doc_id", F.lit(0).alias("seq"), record0(n_bytes, n, compression, values, tags, name, newer).alias("data"))
    out = zero.unionByName(texts)
    if compression == 17480:
        for k, data in enumerate((huff_record(), cdic_record())):
            out = out.unionByName(docs.select("doc_id", (n + 1 + k).alias("seq"), F.lit(data).alias("data")))
    return out


def record_array(text: str | Column = "text", compression: int = 1, values: dict[str, Column] | None = None, tags: Column | None = None, name: Column | None = None, newer: bool = False) -> Column:
    """The records of a document's container as records() has them, in the document's own row: array<binary>."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.greatest(F.ceil(F.length(data) / RECORD).cast("int"), F.lit(1))
    starts = lambda d: F.sequence(F.lit(0), F.greatest(F.ceil(F.length(d) / RECORD).cast("int"), F.lit(1)) - 1)
    plain = lambda d: let(d, lambda d: F.transform(starts(d), lambda i: F.substring(d, i * RECORD + 1, F.lit(RECORD))))
    pieces = {1: plain, 2: lz_records, 17480: huff_records}[compression](data)
    rest = [F.array(F.lit(huff_record()), F.lit(cdic_record()))] if compression == 17480 else []
    return F.concat(F.array(record0(F.length(data), n, compression, values, tags, name, newer)), pieces, *rest)


def packed_records(docs: DataFrame, records: Column, name: Column) -> DataFrame:
    """(doc_id, content) of documents whose records are array<binary>."""
    own = docs.select("doc_id", name.alias("name"), records.alias("_data"))
    return writer.packed(own.select("doc_id", "name", F.transform("_data", lambda d: F.struct(F.lit(0).alias("attributes"), d.alias("data"))).alias("records")))


def containers(docs: DataFrame, compression: int = 1, **more) -> DataFrame:
    """(doc_id, content), each put together in its document's row."""
    return packed_records(docs, record_array(compression=compression, **more), F.concat(F.lit("doc_"), F.col("doc_id")))


def tag(number: int, value: Column) -> Column:
    """A metadata entry with a string value."""
    return F.struct(F.lit(number).alias("tag"), F.encode(value, "UTF-8").alias("data"))


def number_tag(number: int, value: Column) -> Column:
    return F.struct(F.lit(number).alias("tag"), be(value, 4).alias("data"))
