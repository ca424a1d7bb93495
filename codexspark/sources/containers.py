"""Containers as tables: file scan, headers, record directory, metadata records, sections.

Everything is computed inside one row (the container) with higher-order functions and exploded afterwards, so slicing
never shuffles payloads. A bad container gets a status and null fields; it never fails the job.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from codexspark.functions.binary import NOTSET, container_time, first_value, latin, let, part, u8, u16, u24, u32

#: Name, offset from the start of record 0, width (fixed values of the format).
FIELDS = (
    ("header_magic", 16, 4), ("header_length", 20, 4), ("document_type", 24, 4), ("text_encoding", 28, 4), ("uid", 32, 4), ("version", 36, 4),
    ("orth_index", 40, 4), ("infl_index", 44, 4), ("names_index", 48, 4), ("keys_index", 52, 4), ("extra0_index", 56, 4), ("extra1_index", 60, 4),
    ("extra2_index", 64, 4), ("extra3_index", 68, 4), ("extra4_index", 72, 4), ("extra5_index", 76, 4), ("non_text_index", 80, 4),
    ("full_name_offset", 84, 4), ("full_name_length", 88, 4), ("locale", 92, 4), ("dict_input_lang", 96, 4), ("dict_output_lang", 100, 4),
    ("min_version", 104, 4), ("image_index", 108, 4), ("huff_rec_index", 112, 4), ("huff_rec_count", 116, 4), ("datp_rec_index", 120, 4),
    ("datp_rec_count", 124, 4), ("exth_flags", 128, 4), ("unknown6", 164, 4), ("drm_offset", 168, 4), ("drm_count", 172, 4), ("drm_size", 176, 4),
    ("drm_flags", 180, 4), ("first_text_index", 192, 2), ("last_text_index", 194, 2), ("fdst_section_count", 196, 4), ("fcis_index", 200, 4),
    ("fcis_count", 204, 4), ("flis_index", 208, 4), ("flis_count", 212, 4), ("unknown10", 216, 4), ("unknown11", 220, 4), ("srcs_index", 224, 4),
    ("srcs_count", 228, 4), ("unknown12", 232, 4), ("unknown13", 236, 4), ("extra_flags", 242, 2), ("ncx_index", 244, 4), ("unknown14", 248, 4),
    ("unknown15", 252, 4), ("datp_index", 256, 4), ("unknown16", 260, 4), ("unknown17", 264, 4), ("unknown18", 268, 4), ("unknown19", 272, 4),
    ("unknown20", 276, 4),
)
#: Fields that share a place with others in the newer layout.
NEWER = (("fdst_index", 192, 4), ("fragment_index", 248, 4), ("skeleton_index", 252, 4), ("guide_index", 260, 4))
COMPRESSIONS = (1, 2, 17480)
LONGEST_NAME, MOST_EXTH = 1024, 1024


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content, doc_id) of the files below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("doc_id", F.xxhash64("path"))


def container_status(content: Column) -> Column:
    kind, count = latin(part(content, 60, 4)), u16(content, 76)
    return F.when(count.isNull(), "DATA_CORRUPT").when(~kind.isin("BOOK", "TEXt"), "FILE_UNSUPPORTED").when(count == 0, "DATA_CORRUPT").otherwise("SUCCESS")


def pdb_columns(c: Column) -> list[Column]:
    """status, name and the other fields of a container's header."""
    kind, count = latin(part(c, 60, 4)), u16(c, 76)
    times = {n: u32(c, at) for n, at in (("created", 36), ("modified", 40), ("backed_up", 44))}
    return [
        container_status(c).alias("status"), latin(part(c, 0, 32)).alias("name"), u16(c, 32).alias("attributes"), u16(c, 34).alias("pdb_version"),
        *[t.alias(f"{n}_raw") for n, t in times.items()], *[container_time(t).alias(n) for n, t in times.items()],
        u32(c, 48).alias("mod_num"), u32(c, 52).alias("appinfo_offset"), u32(c, 56).alias("sortinfo_offset"),
        kind.alias("type"), latin(part(c, 64, 4)).alias("creator"), u32(c, 68).alias("pdb_uid"), u32(c, 72).alias("next_rec"), count.alias("rec_count"),
    ]


def pdb_headers(containers: DataFrame) -> DataFrame:
    """(doc_id, status, name, ...) of (doc_id, content)."""
    return containers.select("doc_id", *pdb_columns(F.col("content")))


def records(containers: DataFrame, first: Column | int = 0, stop: Column | None = None) -> DataFrame:
    """(doc_id, seq, offset, size, attributes, rec_uid, data); size is null where the directory is out of order. With `first`
    (and `stop`) only the records from there on (before it), counted from there."""
    first = (first if isinstance(first, Column) else F.lit(first)).cast("long")
    c, n = F.col("content"), F.coalesce(u16(F.col("content"), 76), F.lit(0)).cast("long")
    n = n if stop is None else F.least(n, stop.cast("long") + 1)  # one more, where the last record ends
    entry = lambda i: F.struct(u32(c, 78 + 8 * i).alias("offset"), u8(c, 82 + 8 * i).alias("attributes"), u24(c, 83 + 8 * i).alias("rec_uid"))
    numbers = F.when(n > first, F.sequence(first, n - 1)).otherwise(F.array().cast("array<bigint>"))
    last = F.lit(1 << 40) if stop is None else stop.cast("long") - first
    rows = containers.select("doc_id", "content", last.alias("last"), F.transform(numbers, entry).alias("dir"))
    rows = rows.select("doc_id", "content", "last", F.expr("transform(dir, (e, i) -> struct(e.offset as offset, e.attributes as attributes, e.rec_uid as rec_uid, coalesce(get(dir, i + 1).offset, length(content)) - e.offset as size))").alias("dir"))
    rows = rows.select("doc_id", "content", "last", F.posexplode("dir").alias("seq", "e")).filter("seq < last")
    data = part(F.col("content"), F.col("e.offset"), F.col("e.size"))
    size = F.when(F.col("e.size") >= 0, F.col("e.size"))
    return rows.select("doc_id", "seq", "e.offset", size.alias("size"), "e.attributes", "e.rec_uid", F.when(size.isNotNull(), data).alias("data"))


def record_at(content: Column, number: Column | int, most: int | None = None) -> Column:
    """A record of a container (of it the first `most` bytes at most), from two entries of its directory; null where there is
    no such record."""
    number = (number if isinstance(number, Column) else F.lit(number)).cast("long")

    def cut(i: Column) -> Column:
        n = u16(content, 76)
        stop = F.when(i + 1 < n, u32(content, 86 + 8 * i)).otherwise(F.length(content).cast("long"))
        span = F.when((i >= 0) & (i < n), F.struct(u32(content, 78 + 8 * i).alias("start"), stop.alias("stop")))
        return let(span, lambda e: F.when(e["stop"] >= e["start"], part(content, e["start"], e["stop"] - e["start"] if most is None else F.least(e["stop"] - e["start"], F.lit(most)))))

    return let(number, cut)


def record0_of(content: Column) -> Column:
    """Record 0 of a container."""
    return record_at(content, 0)


def first_records(containers: DataFrame) -> DataFrame:
    """(doc_id, seq, data) of record 0 alone, for what needs no others: nothing is exploded."""
    return containers.filter(u16(F.col("content"), 76) > 0).select("doc_id", F.lit(0).alias("seq"), record0_of(F.col("content")).alias("data"))


def record0(recs: DataFrame, base: Column | int = 0) -> DataFrame:
    """The 16 bytes before the long header: (doc_id, part_status, compression, text_length, ...)."""
    d = F.col("data")
    kind = u16(d, 0)
    status = F.when(kind.isin(*COMPRESSIONS), "SUCCESS").otherwise("DATA_CORRUPT")
    return recs.filter(F.col("seq") == base).select(
        "doc_id", F.coalesce(status, F.lit("DATA_CORRUPT")).alias("part_status"), kind.alias("compression"), u32(d, 4).alias("text_length"),
        u16(d, 8).alias("text_record_count"), u16(d, 10).alias("text_record_size"), u16(d, 12).alias("encryption"), u16(d, 14).alias("unknown1"), "data",
    )


def headers(recs: DataFrame, base: Column | int = 0) -> DataFrame:
    """record0() with the long header's fields. A field exists where the declared length reaches it (0 counts as 24);
    NOTSET in a field that exists stays as it is. full_name is raw bytes."""
    d, there, length, newer = (F.col(c) for c in ("data", "has_header", "_length", "_newer"))
    declared = u32(d, 20)
    rows = record0(recs, base).withColumn("has_header", F.coalesce(part(d, 16, 4) == F.lit(b"MOBI"), F.lit(False)))
    rows = rows.withColumn("_length", F.when(there, F.when(declared == 0, 24).otherwise(declared))).withColumn("_newer", F.coalesce((length >= 0xE4) & (u32(d, 36) == 8), F.lit(False)))
    field = lambda at, width: F.when(length + 16 >= at + width, (u32 if width == 4 else u16)(d, at))
    shared = {at for _, at, _ in NEWER}
    own = [F.when(~newer, field(at, w)).alias(n) if at in shared or n == "last_text_index" else field(at, w).alias(n) for n, at, w in FIELDS if n not in ("header_magic", "header_length")]
    own += [F.when(newer, field(at, w)).alias(n) for n, at, w in NEWER]
    rows = rows.select("*", F.when(length.isNotNull(), declared).alias("header_length"), *own).drop("_length", "_newer")
    name_size = F.col("full_name_length")
    return rows.withColumn("full_name", F.when((name_size > 0) & (name_size <= LONGEST_NAME), part(d, F.col("full_name_offset"), name_size)))


def tag_list(data: bytes, start: int) -> list[tuple[int, bytes]]:
    """(tag, data) of the list that begins at `start` of record 0. Entries without data are skipped; one that reaches beyond the
    list drops the whole list."""
    number = lambda at: int.from_bytes(data[at : at + 4], "big")
    count, end, at = number(start + 8), min(start + number(start + 4), len(data)), start + 12
    if data[start : start + 4] != b"EXTH" or at > len(data) or not 1 <= count <= MOST_EXTH:
        return []
    rows = []
    for _ in range(count):
        size = number(at + 4) if at + 8 <= end else 0
        if size < 8 or at + size > end:
            return []
        if size > 8:
            rows.append((number(at), data[at + 8 : at + size]))
        at += size
    return rows


@F.pandas_udf(ArrayType(StructType().add("tag", IntegerType()).add("data", BinaryType())))
def listed_tags(data: pd.Series, start: pd.Series) -> pd.Series:
    return pd.Series([tag_list(bytes(d), int(s)) for d, s in zip(data, start)], dtype=object)


def exth(heads: DataFrame) -> DataFrame:
    """(doc_id, ord, tag, data): the tag list after the long header, read in one walk of record 0."""
    d, start = F.col("data"), F.col("header_length") + 16
    rows = heads.filter(d.isNotNull() & start.isNotNull() & F.col("exth_flags").bitwiseAND(0x40).cast("boolean"))
    return rows.select("doc_id", F.posexplode(listed_tags(d, start)).alias("ord", "e")).select("doc_id", "ord", "e.tag", "e.data")


def sections(recs: DataFrame, heads: DataFrame, base: Column | int = 0) -> DataFrame:
    """(doc_id, section, start, stop) of the flow table, where its count is the header's and over 1. The newer format names
    the table's record; versions 4 to 7 keep its number in the place of the last text record."""
    old = F.when(F.col("version").between(4, 7) & (F.col("last_text_index") != 0xFFFF), F.col("last_text_index"))
    at = F.coalesce(F.when(F.col("fdst_index") != NOTSET, F.col("fdst_index")), old)
    at = heads.filter(at.isNotNull() & (F.col("fdst_section_count") > 1)).select("doc_id", at.alias("seq"), "fdst_section_count")
    own = recs.withColumn("seq", F.col("seq").cast("long")).join(at, ["doc_id", "seq"])
    return section_rows(own.select("doc_id", F.col("fdst_section_count").alias("n"), "data"))


def section_rows(tables: DataFrame) -> DataFrame:
    """(doc_id, section, start, stop) of flow tables (doc_id, n, data)."""
    d, n = F.col("data"), F.col("n")
    pair = lambda i: F.struct(u32(d, 12 + 8 * i).alias("start"), u32(d, 16 + 8 * i).alias("stop"))
    own = tables.filter((part(d, 0, 4) == F.lit(b"FDST")) & (u32(d, 4) == 12) & (u32(d, 8) == n))
    return own.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), pair)).alias("section", "e")).select("doc_id", "section", "e.start", "e.stop")


def halves(recs: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, half, base_seq): a hybrid has a second record 0 after the BOUNDARY record that tag 121 points behind."""
    mark = tags.filter("tag = 121").groupBy("doc_id").agg(F.min_by(first_value(F.col("data")), "ord").alias("base_seq"))
    bound = recs.filter(F.substring("data", 1, 8) == F.lit(b"BOUNDARY")).select("doc_id", (F.col("seq") + 1).cast("long").alias("base_seq"))
    newer = mark.join(bound, ["doc_id", "base_seq"], "left_semi").select("doc_id", F.lit("newer").alias("half"), "base_seq")
    return recs.filter("seq = 0").select("doc_id", F.lit("older").alias("half"), F.lit(0).cast("long").alias("base_seq")).unionByName(newer)
