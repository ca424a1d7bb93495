"""Edits of containers as rewrites of their record table: cut, insert and delete ranges, write record 0
anew. Numbers are given again by a window over the keys; payloads are carried, never looked into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexspark.functions.binary import be, let
from codexspark.sources.writer import exth_bytes


def renumbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `seq` counted from 0 in the order of by."""
    order = Window.partitionBy("doc_id").orderBy(*by)
    return rows.withColumn("_seq", (F.row_number().over(order) - 1).cast("int")).drop("seq", *[c for c in by if c != "seq"]).withColumnRenamed("_seq", "seq")


def extracted(recs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The records of ranges (doc_id, first, count), counted from 0."""
    own = recs.join(ranges.select("doc_id", "first", "count"), "doc_id").filter((F.col("seq") >= F.col("first")) & (F.col("seq") < F.col("first") + F.col("count")))
    return renumbered(own.drop("first", "count"), ["seq"])


def deleted(recs: DataFrame, ranges: DataFrame) -> DataFrame:
    """recs without the ranges (doc_id, first, count), of which a document may have several."""
    gone = recs.select("doc_id", "seq").join(ranges.select("doc_id", "first", "count"), "doc_id").filter((F.col("seq") >= F.col("first")) & (F.col("seq") < F.col("first") + F.col("count")))
    return renumbered(recs.join(gone.select("doc_id", "seq").distinct(), ["doc_id", "seq"], "left_anti"), ["seq"])


def inserted(recs: DataFrame, new: DataFrame, places: DataFrame) -> DataFrame:
    """recs with those of new before the record at places (doc_id, at); without a place they go to the end."""
    own = recs.withColumn("_k", F.col("seq").cast("long")).withColumn("_side", F.lit(1)).withColumn("_n", F.lit(0))
    other = new.join(places.select("doc_id", "at"), "doc_id", "left").withColumn("_k", F.coalesce(F.col("at"), F.lit(1 << 40)).cast("long"))
    other = other.withColumn("_side", F.lit(0)).withColumn("_n", F.col("seq")).drop("at")
    return renumbered(own.unionByName(other, allowMissingColumns=True), ["_k", "_side", "_n"])


def overlaid(data: Column, at: int, value: Column, width: int = 4) -> Column:
    """data with a big-endian number written over it."""
    return let(F.struct(data.alias("d"), value.alias("v")), lambda x: F.when(F.length(x["d"]) >= at + width, F.overlay(x["d"], be(x["v"], width), F.lit(at + 1), F.lit(width))).otherwise(x["d"]))


def with_tags(record0: DataFrame, tags: DataFrame) -> DataFrame:
    """record0 (doc_id, data, header_length, full_name, ...) with `data` written anew for tags (doc_id, ord, tag, data):
    headers, the tag list, the full name and its place."""
    lists = tags.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tag", "data"))), lambda t: F.struct(t["tag"].alias("tag"), t["data"].alias("data"))).alias("_tags"))
    rows = record0.join(lists, "doc_id", "left").withColumn("_tags", F.coalesce("_tags", F.array().cast("array<struct<tag:int,data:binary>>")))
    end = (F.col("header_length") + 16).cast("int")
    head, list_, name = F.substring(F.col("data"), F.lit(1), end), exth_bytes(F.col("_tags")), F.coalesce("full_name", F.lit(b""))
    head = overlaid(overlaid(head, 84, end + F.length(list_)), 88, F.length(name))
    flags = F.col("exth_flags").bitwiseAND(F.lit(0xFFFFFFBF).cast("long")) + F.when(F.size("_tags") > 0, 0x40).otherwise(0)
    head = F.when(F.col("exth_flags").isNotNull(), overlaid(head, 128, flags)).otherwise(head)
    return rows.withColumn("data", F.concat(head, list_, name, F.unhex(F.repeat(F.lit("00"), 64)))).drop("_tags")
