"""Containers from tables.

A container is its records in order after a header and a directory whose offsets are running sums. Records that are rows are joined
with an ordered binary aggregate (`assembled`); those that lie in their document's own row are put together there (`packed`).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from codexspark.functions.binary import NOTSET, be
from codexspark.sources.containers import FIELDS, NEWER

PALM_TIME = 1700000000


def exth_bytes(rows: Column) -> Column:
    """A tag list from array<struct<tag, data>>, padded to four bytes."""
    body = F.aggregate(rows, F.lit(b""), lambda a, r: F.concat(a, be(r["tag"], 4), be(F.length(r["data"]) + 8, 4), r["data"]))
    pad = F.unhex(F.repeat(F.lit("00"), F.pmod(-F.length(body), F.lit(4))))
    return F.when(F.size(rows) > 0, F.concat(F.lit(b"EXTH"), be(F.length(body) + 12, 4), be(F.size(rows), 4), body, pad)).otherwise(F.lit(b""))


def header_bytes(values: dict[str, Column], newer: bool = False, length: int = 264) -> Column:
    """The long header: fields without a value are NOTSET, bytes between fields 0."""
    layout = {at: (n, w) for n, at, w in FIELDS if n != "header_magic" and not (newer and n in ("first_text_index", "last_text_index"))}
    if newer:
        layout |= {at: (n, w) for n, at, w in NEWER}
    out, at = [F.lit(b"MOBI"), be(length, 4)], 24
    while at < 16 + length:
        name, width = layout.get(at, (None, min(2, 16 + length - at)))
        default = 0 if name is None or name in ("exth_flags", "extra_flags", "drm_count", "drm_size", "drm_flags") else NOTSET if width == 4 else 0
        out.append(be(values.get(name, F.lit(default)), width))
        at += width
    return F.concat(*out)


def record0_bytes(compression: Column, text_length: Column, n_records: Column, values: dict[str, Column], tags: Column, full_name: Column, record_size: int = 4096, newer: bool = False) -> Column:
    """Record 0: short header, long header, tag list, full name, padding."""
    list_ = exth_bytes(tags)
    values = values | {
        "full_name_offset": F.lit(16 + 264) + F.length(list_),
        "full_name_length": F.length(full_name),
        "exth_flags": F.when(F.size(tags) > 0, 0x40).otherwise(0),
    }
    short = F.concat(be(compression, 2), be(0, 2), be(text_length, 4), be(n_records, 2), be(record_size, 2), be(0, 2), be(0, 2))
    return F.concat(short, header_bytes(values, newer), list_, full_name, F.unhex(F.repeat(F.lit("00"), 64)))


#: Fields between a container's name and its kind, and behind its creator: (column, bytes, value if names has no such column).
BEFORE = (("attributes", 2, 0), ("pdb_version", 2, 0), ("created_raw", 4, PALM_TIME), ("modified_raw", 4, PALM_TIME), ("backed_up_raw", 4, 0), ("mod_num", 4, 0), ("appinfo_offset", 4, 0), ("sortinfo_offset", 4, 0))


def head_bytes(names: DataFrame, kind: str = "BOOK", creator: str = "MOBI") -> tuple[Column, list[str]]:
    """The 78 bytes before the directory, from `name`, `count` and those columns that names has, and which these are."""
    name = F.rpad(F.coalesce("name", F.lit("")), 31, "\0")
    own = [c for c in (*(n for n, _, _ in BEFORE), "type", "creator", "pdb_uid", "next_rec") if c in names.columns]
    field = lambda c, default, width: be(F.coalesce(F.col(c), default) if c in own else default, width)
    four = lambda c, default: F.encode(F.rpad(F.coalesce(F.col(c), F.lit(default)) if c in own else F.lit(default), 4, "\0"), "ISO-8859-1")
    return F.concat(
        F.encode(F.concat(name, F.lit("\0")), "ISO-8859-1"), *[field(c, F.lit(v), w) for c, w, v in BEFORE],
        four("type", kind), four("creator", creator), field("pdb_uid", 2 * F.col("count"), 4), field("next_rec", F.lit(0), 4), be(F.col("count"), 2),
    ), own


def assembled(records: DataFrame, names: DataFrame, kind: str = "BOOK", creator: str = "MOBI") -> DataFrame:
    """(doc_id, content) from records (doc_id, seq, data[, attributes]) and (doc_id, name): numbers are given anew by seq, record
    uids are twice the number; a name stays as it is, up to 31 bytes. Where names are headers that were read (pdb_headers), their times, attributes, kind and uid stay."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    rows = records.withColumn("n", F.row_number().over(order) - 1)
    before = F.coalesce(F.sum(F.length("data")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("count", F.count("*").over(Window.partitionBy("doc_id")))
    attributes = F.coalesce("attributes", F.lit(0)) if "attributes" in records.columns else 0
    entry = F.concat(be(80 + 8 * F.col("count") + F.col("before"), 4), be(attributes, 1), be(2 * F.col("n"), 3))
    rows = rows.withColumn("entry", entry)
    body = rows.groupBy("doc_id").agg(
        F.first("count").alias("count"),
        F.expr("listagg(entry) within group (order by n)").alias("directory"),
        F.expr("listagg(data) within group (order by n)").alias("body"),
    )
    head, own = head_bytes(names, kind, creator)
    return body.join(names.select("doc_id", "name", *own), "doc_id", "left").select("doc_id", F.concat(head, F.col("directory"), be(0, 2), F.col("body")).alias("content"))


Records = list[tuple[int, bytes]]


def put_together(head: bytes, records: Records) -> bytes:
    """A container of records (attributes, data) in order; their uids are twice their number."""
    at, directory = 80 + 8 * len(records), []
    for i, (attributes, data) in enumerate(records):
        directory.append(at.to_bytes(4, "big") + bytes([attributes]) + (2 * i).to_bytes(3, "big"))
        at += len(data)
    return b"".join([head[:76], len(records).to_bytes(2, "big"), *directory, bytes(2), *(data for _, data in records)])


@F.pandas_udf(BinaryType())
def _packed(head: pd.Series, records: pd.Series) -> pd.Series:
    out = []
    for h, x in zip(head, records):
        own = [] if h is None or x is None else [(r["attributes"] or 0, bytes(r["data"])) for r in x]
        out.append(put_together(bytes(h), own) if 0 < len(own) <= 0xFFFF else None)
    return pd.Series(out, dtype=object)


_packed = _packed.asNondeterministic()  # called once for each row


def packed(rows: DataFrame, kind: str = "BOOK", creator: str = "MOBI") -> DataFrame:
    """assembled() of documents (doc_id, name, records array<struct<attributes, data>>), with the columns of headers that were read if
    there are any: a container is put together in its own row, and no record is shuffled. Without records, or with more than a
    directory numbers, content is null."""
    own = rows.withColumn("count", F.size("records"))
    return own.select("doc_id", _packed(head_bytes(rows, kind, creator)[0], F.col("records").cast("array<struct<attributes:int,data:binary>>")).alias("content"))
