"""Scalar functions on driver tables: numbers, dates, charsets, entities, attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexspark.functions import binary as B
from codexspark.functions import text as T
from codexspark.operators import metadata, predicates, resources
from codexspark.plans.registry import query, table
from codexspark.sources import fixtures


@query("SELECT o_orderkey, upper(lpad(list_aggregate(list_transform(range(0, 6), lambda i: substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', ((o_orderkey // (32 ** (5 - i))::BIGINT) % 32 + 1)::INT, 1)), 'string_agg', ''), 6, '0')) AS coded, o_orderkey AS decoded FROM orders")
def base32(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = B.to_base32(F.col("o_orderkey"), 6)
    return table(spark, sf_dir, "orders").select("o_orderkey", coded.alias("coded")).withColumn("decoded", B.base32(F.col("coded")))


@query("SELECT event_id, v AS value, (CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 ELSE 4 END)::BIGINT AS size FROM (SELECT event_id, (event_id * 7919) % 268435456 AS v FROM events)")
def varlen_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 7-bit groups, there and back."""
    rows = table(spark, sf_dir, "events").select("event_id", B.encoded_varlen((F.col("event_id") * 7919) % (1 << 28)).alias("data"))
    got = B.varlen(F.col("data"), 0)
    return rows.select("event_id", got["value"].alias("value"), got["size"].cast("long").alias("size"))


@query("SELECT event_id, user_id, bit_count((user_id & 255)::INT)::BIGINT AS bits, (user_id & 255) AS low FROM events")
def bit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("user_id").bitwiseAND(255)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.bit_count(low).cast("long").alias("bits"), low.alias("low"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def container_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times counted from 1904, as containers keep them, read back."""
    seconds = F.unix_timestamp(F.date_trunc("second", "ts"))
    rows = table(spark, sf_dir, "events").select("event_id", seconds.alias("seconds"), (seconds + B.EPOCH_1904).alias("raw"))
    return rows.select("event_id", "seconds", F.date_format(B.container_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("SELECT o_orderkey, md5(o_orderpriority || ' — €' || (o_orderkey % 10)) AS text_md5, length(o_orderpriority || ' — €' || (o_orderkey % 10))::BIGINT AS n_bytes FROM orders")
def cp1252_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("o_orderpriority", F.lit(" — €"), (F.col("o_orderkey") % 10).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", T.encode_text(text, F.lit(1252)).alias("data"))
    return rows.select("o_orderkey", F.md5(T.decode_text("data", F.lit(1252))).alias("text_md5"), F.length("data").cast("long").alias("n_bytes"))


_ENTITY_SQL = "html"
for _name, _char in sorted(T.CHARACTERS.items(), key=lambda x: x[0] == "amp"):
    _ENTITY_SQL = f"replace({_ENTITY_SQL}, '&{_name};', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, md5({_ENTITY_SQL}) AS text_md5 FROM pages")
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.decode_entities(F.col("html"))).alias("text_md5"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, chr((32 + l_partkey % 95)::INT) || '€' AS shown FROM lineitem")
def numeric_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.concat(F.lit("&#"), (32 + F.col("l_partkey") % 95).cast("string"), F.lit(";&#x20ac;"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), T.numeric_entities(coded).alias("shown"))


@query("SELECT p_partkey, chr((161 + p_partkey % 8000)::INT) AS letter FROM part")
def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.character((161 + F.col("p_partkey") % 8000).cast("long")).alias("letter"))


@query("SELECT doc_id, lang, CASE WHEN lang IN ('de', 'en', 'es', 'fr', 'it', 'ja', 'nl', 'pt', 'ru', 'zh') THEN lang END AS locale FROM documents")
def locale_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages to locale numbers and back; unknown ones have no name."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return metadata.with_locale(metadata.with_locale_number(rows, "lang")).drop("locale_no")


@query("""WITH l(i, locale_no, locale, back) AS (VALUES (0, 0, 'neutral', 0), (1, 9, 'en', 9), (2, 1033, 'en-us', 1033), (3, 2057, 'en-gb', 2057), (4, 9225, 'en', 9), (5, 21513, NULL, 0), (6, 5121, 'ar-dz', 5121), (7, 2049, 'ar', 1),
 (8, 4122, 'sr', 0), (9, 87, 'x-kok', 87), (10, 97, 'ne', 0), (11, 20490, 'es-pr', 20490), (12, 2115, 'uz-uz', 2115), (13, 40, NULL, 0), (14, 98, 'fy', 98))
SELECT p_partkey, l.locale_no::BIGINT AS locale_no, l.locale, l.back::BIGINT AS back FROM part JOIN l ON p_partkey % 15 = l.i""")
def locale_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of languages and regions to names, and the names back to numbers."""
    numbers = F.array(*[F.lit(n).cast("long") for n in (0, 9, 1033, 2057, 9225, 21513, 5121, 2049, 4122, 87, 97, 20490, 2115, 40, 98)])
    rows = metadata.with_locale(table(spark, sf_dir, "part").select("p_partkey", F.get(numbers, (F.col("p_partkey") % 15).cast("int")).alias("locale_no")))
    rows = rows.withColumnRenamed("locale_no", "number")
    return metadata.with_locale_number(rows).select("p_partkey", F.col("number").alias("locale_no"), "locale", F.col("locale_no").alias("back"))


@query("""SELECT p_partkey, (CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size < 24 THEN 2 WHEN p_size % 9 <= 1 THEN 1
  WHEN (p_size % 9 > 2 AND p_size * 6 < 116) OR (p_size % 9 > 3 AND p_size * 6 < 208) OR (p_size % 9 > 5 AND p_size * 6 < 228) THEN 4294967295
  ELSE p_size % 9 END)::BIGINT AS version FROM part""")
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived version of headers with made-up lengths and versions."""
    size = F.col("p_size")
    length = F.when(size < 24, size).otherwise(size * 6)
    return table(spark, sf_dir, "part").select("p_partkey", predicates.file_version(size % 5 != 0, length, size % 9).alias("version"))


@query("""SELECT doc_id, ['JPG', 'GIF', 'PNG', 'FONT', 'BREAK', 'AUDIO', 'VIDEO', 'BMP', 'UNKNOWN'][(doc_id % 9 + 1)::INT] AS kind FROM documents""")
def type_by_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of records by their first bytes."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    starts = [b"\xff\xd8\xff\xe0", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"FONT", b"BOUNDARY", b"AUDI", b"VIDE", None, b"none"]
    size = F.length(text) + 6
    little = F.concat(*[B.be(F.shiftright(size, 8 * i).bitwiseAND(255), 1) for i in range(4)])
    no = F.col("doc_id") % 9
    head = F.coalesce(*[F.when(no == i, F.lit(s)) for i, s in enumerate(starts) if s is not None], F.concat(F.lit(b"BM"), little))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, text).alias("data")).select("doc_id", resources.magic(F.col("data")).alias("kind"))


@query("SELECT page_id, u.ord::BIGINT - 1 AS ord, u.value AS value FROM (SELECT page_id, unnest(list_zip(v, range(1, len(v) + 1))) AS z FROM (SELECT page_id, regexp_extract_all(html, '[\\s\"]href=\"([^\"]{0,150})\"', 1) AS v FROM pages)) t, LATERAL (SELECT z[1] AS value, z[2] AS ord) u")
def attr_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.attribute_values(F.col("html"), "href")).alias("ord", "value"))
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), "value")


@query("SELECT page_id, md5(regexp_replace(html, '(<[^>]*?)\\bclass=\"[^\"]*\"', '\\1', 'g')) AS html_md5 FROM pages")
def strip_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.without_attribute(F.col("html"), "class")).alias("html_md5"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) > 50")
def index_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag's value from nested tag arrays; the events' properties serve as tags."""
    from codexspark.operators.index import tag_value

    k = F.get_json_object("props", "$.k").cast("long")
    tags = F.array(F.struct(F.lit(1).alias("tagid"), F.array(F.lit(0).cast("long")).alias("values")), F.struct(F.lit(7).alias("tagid"), F.array(k, k).alias("values")))
    return table(spark, sf_dir, "events").select("event_id", tag_value(tags, 7, 1).alias("k")).filter("k > 50")


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ceil(greatest(strlen(coalesce(text, '')), 1) / 4096.0)::BIGINT AS n_records FROM documents")
def reassemble_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into records and joined again with an ordered binary aggregate."""
    rows = fixtures.text_records(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = rows.groupBy("doc_id").agg(F.expr("listagg(chunk) within group (order by seq)").alias("data"), F.count("*").alias("n_records"))
    return joined.select("doc_id", F.md5("data").alias("text_md5"), F.length("data").cast("long").alias("n_bytes"), "n_records")
