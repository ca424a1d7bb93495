"""Metadata of documents: tags decoded, joined and pivoted, named getters with their fallbacks, and edits.

Tags are a tall table (doc_id, ord, tag, data); every edit is a relational rewrite of that table and of the headers, so
edits of a whole collection are one plan. Sets of tags to add, set or delete are tables too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexspark.functions.binary import be, first_value
from codexspark.functions.text import decode_entities, decode_text, encode_text

#: Tag: (kind, name). Fixed values of the format.
TAGS = {
    1: ("string", "DRM server id"), 2: ("string", "DRM commerce id"), 3: ("string", "DRM e-book base id"), 99: ("string", "own title"), 100: ("string", "author"), 101: ("string", "publisher"),
    102: ("string", "imprint"), 103: ("string", "description"), 104: ("string", "isbn"), 105: ("string", "subject"), 106: ("string", "publishdate"), 107: ("string", "review"),
    108: ("string", "contributor"), 109: ("string", "copyright"), 110: ("string", "subject code"), 111: ("string", "type"), 112: ("string", "source"), 113: ("string", "asin"),
    114: ("string", "version"), 115: ("numeric", "sample"), 116: ("numeric", "start reading"), 117: ("string", "adult"), 118: ("string", "price"), 119: ("string", "currency"),
    121: ("numeric", "newer half"), 122: ("string", "fixed layout"), 123: ("string", "book type"), 124: ("string", "orientation lock"), 125: ("numeric", "resources"),
    126: ("string", "original resolution"), 127: ("string", "zero gutter"), 128: ("string", "zero margin"), 129: ("string", "cover uri"), 131: ("numeric", "resource record offset"),
    132: ("string", "region magnification"), 200: ("string", "dictionary short name"), 201: ("numeric", "cover offset"), 202: ("numeric", "thumbnail offset"), 203: ("numeric", "has fake cover"),
    204: ("numeric", "creator software"), 205: ("numeric", "creator major"), 206: ("numeric", "creator minor"), 207: ("numeric", "creator build"), 208: ("string", "watermark"), 209: ("binary", "tamper keys"),
    300: ("binary", "font signature"), 401: ("numeric", "clipping limit"), 402: ("numeric", "publisher limit"), 403: ("binary", "unknown 403"), 404: ("numeric", "text to speech disabled"),
    405: ("numeric", "read for free"), 406: ("binary", "rental"), 407: ("binary", "unknown 407"), 450: ("binary", "unknown 450"), 451: ("binary", "unknown 451"), 452: ("binary", "unknown 452"), 453: ("binary", "unknown 453"),
    501: ("string", "document type"), 502: ("string", "last update"), 503: ("string", "title"), 504: ("string", "asin"), 508: ("string", "title key"), 517: ("string", "author key"), 522: ("string", "publisher key"),
    524: ("string", "language"), 525: ("string", "writing mode"), 526: ("string", "creator string"), 527: ("string", "page direction"), 528: ("string", "override fonts"), 529: ("string", "source description"),
    531: ("string", "dictionary input language"), 532: ("string", "dictionary output language"), 534: ("string", "input source"), 535: ("string", "creator build revision"),
}
#: Named fields that can be read, added, set and deleted.
FIELDS = {
    "title": 503, "author": 100, "subject": 105, "publisher": 101, "publishdate": 106, "description": 103, "imprint": 102, "contributor": 108, "review": 107, "copyright": 109, "isbn": 104,
    "asin": 113, "language": 524,
}
#: Languages by number (fixed values of the format).
LANGUAGES = {
    0: "neutral", 1: "ar", 2: "bg", 3: "ca", 4: "zh", 5: "cs", 6: "da", 7: "de", 8: "el", 9: "en", 10: "es", 11: "fi", 12: "fr", 13: "he", 14: "hu", 15: "is", 16: "it", 17: "ja", 18: "ko", 19: "nl",
    20: "no", 21: "pl", 22: "pt", 23: "rm", 24: "ro", 25: "ru", 26: "hr", 27: "sk", 28: "sq", 29: "sv", 30: "th", 31: "tr", 32: "ur", 33: "id", 34: "uk", 35: "be", 36: "sl", 37: "et", 38: "lv", 39: "lt",
    41: "fa", 42: "vi", 43: "hy", 44: "az", 45: "eu", 46: "sb", 47: "mk", 48: "sx", 49: "ts", 50: "tn", 52: "xh", 53: "zu", 54: "af", 55: "ka", 56: "fo", 57: "hi", 58: "mt", 59: "sz", 60: "ga",
    62: "ms", 63: "kk", 65: "sw", 67: "uz", 68: "tt", 69: "bn", 70: "pa", 71: "gu", 72: "or", 73: "ta", 74: "te", 75: "kn", 76: "ml", 77: "as", 78: "mr", 79: "sa", 82: "cy", 83: "gl", 87: "x-kok", 97: "ne", 98: "fy",
}
#: Locales of a language by its regions from 1 on (fixed values of the format).
REGIONS = {
    1: ["ar-sa", "ar", "ar-eg", "ar", "ar-dz", "ar-ma", "ar-tn", "ar-om", "ar-ye", "ar-sy", "ar-jo", "ar-lb", "ar-kw", "ar-ae", "ar-bh", "ar-qa"],
    4: ["zh-tw", "zh-cn", "zh-hk", "zh-sg"],
    7: ["de-de", "de-ch", "de-at", "de-lu", "de-li"],
    9: ["en-us", "en-gb", "en-au", "en-ca", "en-nz", "en-ie", "en-za", "en-jm", "en", "en-bz", "en-tt", "en-zw", "en-ph"],
    10: ["es-es", "es-mx", "es", "es-gt", "es-cr", "es-pa", "es-do", "es-ve", "es-co", "es-pe", "es-ar", "es-ec", "es-cl", "es-uy", "es-py", "es-bo", "es-sv", "es-hn", "es-ni", "es-pr"],
    12: ["fr-fr", "fr-be", "fr-ca", "fr-ch", "fr-lu", "fr-mc"],
    16: ["it-it", "it-ch"],
    19: ["nl-nl", "nl-be"],
    22: ["pt-br", "pt-pt"],
    26: ["sr", "sr", "sr", "sr"],
    29: ["sv-se", "sv-fi"],
    67: ["uz", "uz-uz"],
    82: ["cy-gb"],
    83: ["gl-es"],
}
CREATORS = {1: "mobigen", 2: "mobipocket creator", 200: "kindlegen", 201: "kindlegen", 202: "kindlegen"}


def tag_table(spark) -> DataFrame:
    return spark.createDataFrame([(t, *v) for t, v in TAGS.items()], "tag int, kind string, tag_name string")


def locale_table(spark) -> DataFrame:
    """(language_no, region_no, locale): region 0 is the language alone."""
    rows = [(n, 0, name) for n, name in LANGUAGES.items()] + [(n, r, name) for n, names in REGIONS.items() for r, name in enumerate(names, 1)]
    return spark.createDataFrame(rows, "language_no int, region_no int, locale string")


def with_locale(rows: DataFrame, number: str = "locale_no") -> DataFrame:
    """rows with `locale`, by the low byte (language) and the next ones (region, in fours); null where the format names no
    such region. A null number gives null."""
    n = F.col(number)
    names = locale_table(rows.sparkSession).select(F.col("language_no").alias("_l"), F.col("region_no").alias("_r"), "locale")
    out = rows.drop("locale").withColumn("_l", n.bitwiseAND(255).cast("int")).withColumn("_r", F.floor(F.shiftright(n, 8) / 4).cast("int"))
    return out.join(F.broadcast(names), ["_l", "_r"], "left").drop("_l", "_r")


def with_locale_number(rows: DataFrame, name: str = "locale") -> DataFrame:
    """rows with `locale_no` of a name like en-GB, in any case. Its first two letters choose the language (the lowest number
    that begins so), the whole name the lowest region of it, else region 0; 0 where no language begins so."""
    names, text = locale_table(rows.sparkSession), F.lower(F.col(name))
    first = names.filter("region_no = 0").groupBy(F.substring("locale", 1, 2).alias("_y")).agg(F.min("language_no").alias("_language"))
    exact = names.groupBy(F.col("language_no").alias("_language"), F.col("locale").alias("_x")).agg(F.min("region_no").alias("_region"))
    out = rows.withColumn("_x", text).withColumn("_y", F.substring(text, 1, 2)).join(F.broadcast(first), "_y", "left").join(F.broadcast(exact), ["_language", "_x"], "left")
    number = F.col("_language") + F.shiftleft(F.coalesce("_region", F.lit(0)) * 4, 8)
    return out.withColumn("locale_no", F.coalesce(number, F.lit(0)).cast("long")).drop("_x", "_y", "_language", "_region")


def decoded_tags(tags: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, ord, tag, tag_name, kind, value): strings under the document's charset with entities decoded, numbers in
    decimal, binary tags and unknown ones in hex."""
    coded = tags.join(heads.select("doc_id", "text_encoding"), "doc_id", "left").join(F.broadcast(tag_table(tags.sparkSession)), "tag", "left")
    text = decode_entities(decode_text("data", F.coalesce("text_encoding", F.lit(1252))))
    value = F.when(F.col("kind") == "string", text).when(F.col("kind") == "numeric", first_value(F.col("data")).cast("string")).otherwise(F.hex("data"))
    return coded.select("doc_id", "ord", "tag", "tag_name", "kind", value.alias("value"))


def joined(decoded: DataFrame) -> DataFrame:
    """(doc_id, tag, value): all values of a tag in order, joined with '; '."""
    return decoded.groupBy("doc_id", "tag").agg(F.expr("listagg(value, '; ') within group (order by ord)").alias("value"))


def fields(decoded: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each of documents (doc_id) with a column for each named field; null where it has no such tag."""
    wanted = decoded.filter(F.col("tag").isin(*FIELDS.values()))
    value = lambda t: F.expr(f"listagg(case when tag = {t} then value end, '; ') within group (order by ord)")
    wide = wanted.groupBy("doc_id").agg(*[value(t).alias(name) for name, t in FIELDS.items()])
    return documents.select("doc_id").join(wide, "doc_id", "left")


def summary(containers: DataFrame, heads: DataFrame, decoded: DataFrame) -> DataFrame:
    """Named fields with fallbacks: title is its tag, the full name or the container's name; language its tag or the
    header's locale. containers has (doc_id, name)."""
    base = containers.select("doc_id", "name").join(heads.select("doc_id", "full_name", "text_encoding", F.col("locale").alias("locale_no")), "doc_id", "left")
    base = with_locale(base).withColumnRenamed("locale", "_locale")
    full = F.when(F.length("full_name") > 0, decode_text("full_name", F.coalesce("text_encoding", F.lit(1252))))
    base = base.withColumn("_full", full).drop("full_name", "locale_no")
    out = base.join(fields(decoded, containers), "doc_id", "left")
    return out.withColumn("title", F.coalesce("title", "_full", "name")).withColumn("language", F.coalesce("language", "_locale")).drop("_full", "_locale", "text_encoding")


def creator(decoded: DataFrame) -> DataFrame:
    """(doc_id, creator): software and version from the tags 204 to 207."""
    number = lambda t: F.min(F.when(F.col("tag") == t, F.col("value").cast("long")))
    own = decoded.filter(F.col("tag").between(204, 207)).groupBy("doc_id").agg(*[number(t).alias(f"t{t}") for t in range(204, 208)])
    name = F.coalesce(*[F.when(F.col("t204") == k, v) for k, v in CREATORS.items()], F.lit("unknown"))
    return own.select("doc_id", F.concat(name, F.lit(" "), F.concat_ws(".", *[F.coalesce(F.col(f"t{t}"), F.lit(0)).cast("string") for t in (205, 206, 207)])).alias("creator"))


def field_values(header_rows: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, field, value): header fields as rows, those that a header doesn't reach left out."""
    wide = header_rows.select("doc_id", *[F.col(n).cast("long").alias(n) for n in names])
    return wide.unpivot(["doc_id"], names, "field", "value").filter("value is not null")


def value_bytes(value: Column, kind: Column, code: Column) -> Column:
    """A new tag's bytes: numbers as four big-endian bytes, text in the document's charset."""
    return F.when(kind == "numeric", be(F.coalesce(value.try_cast("long"), F.lit(0).cast("long")), 4)).otherwise(encode_text(value, code))


def _coded(rows: DataFrame, heads: DataFrame, value: str) -> DataFrame:
    """rows with `data`, a column of theirs in the charset of each document's header."""
    codes = heads.select("doc_id", F.coalesce("text_encoding", F.lit(1252)).alias("_code"))
    return rows.join(codes, "doc_id", "left").withColumn("data", encode_text(value, F.coalesce("_code", F.lit(1252)))).drop("_code")


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """tags and those of new (doc_id, tag, data[, ord]) behind them; an empty value is refused (left out)."""
    last = tags.groupBy("doc_id").agg(F.max("ord").alias("last"))
    order = F.col("ord") if "ord" in new.columns else F.col("tag")
    rows = new.filter(F.length("data") > 0).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "tag", "data")))
    rows = rows.join(last, "doc_id", "left").select("doc_id", (F.coalesce("last", F.lit(-1)) + F.col("place")).cast("int").alias("ord"), F.col("tag").cast("int").alias("tag"), "data")
    return tags.select("doc_id", "ord", "tag", "data").unionByName(rows)


def delete_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    """tags without those of gone (doc_id, tag)."""
    return tags.join(gone.select("doc_id", F.col("tag").cast("int").alias("tag")).distinct(), ["doc_id", "tag"], "left_anti").select("doc_id", "ord", "tag", "data")


def set_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Tags of new replace all of the same document and number."""
    return add_tags(delete_tags(tags, new), new)


def container_name(title: Column) -> Column:
    """What a title leaves in the container's 32-byte name."""
    return F.substring(F.regexp_replace(title, "[^0-9A-Za-z]", "_"), 1, 31)


def set_titles(tags: DataFrame, heads: DataFrame, names: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags, heads, names) after titles (doc_id, title): the tag, the full name and the container's name follow; a null
    title deletes the tag and blanks the full name."""
    titles = _coded(titles.select("doc_id", "title"), heads, "title")
    new = titles.select("doc_id", F.lit(FIELDS["title"]).alias("tag"), "data")
    own = titles.select("doc_id", "title", F.col("data").alias("_name"), F.lit(True).alias("touched"))
    heads = heads.join(own, "doc_id", "left").withColumn("full_name", F.when(F.col("touched"), F.coalesce("_name", F.lit(b""))).otherwise(F.col("full_name"))).drop("_name")
    named = names.join(own.drop("_name"), "doc_id", "left").withColumn("name", F.when(F.col("title").isNotNull(), container_name(F.col("title"))).otherwise(F.col("name")))
    return set_tags(tags, new), heads.drop("title", "touched"), named.drop("title", "touched")


def set_languages(tags: DataFrame, heads: DataFrame, languages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, heads) after languages (doc_id, language): the tag and the header's locale follow; a null language deletes
    the tag and zeroes the locale."""
    new = _coded(languages.select("doc_id", "language"), heads, "language").select("doc_id", F.lit(FIELDS["language"]).alias("tag"), "data")
    numbers = with_locale_number(languages.select("doc_id", "language"), "language").select("doc_id", F.col("locale_no").alias("_no"))
    heads = heads.join(numbers, "doc_id", "left").withColumn("locale", F.coalesce("_no", "locale")).drop("_no")
    return set_tags(tags, new), heads


def apply_actions(tags: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions (doc_id, step, action add|set|delete, tag, data) folded in order of step: a tag's last set or delete of a
    document clears what came before, and what is added from then on stays. One pass however many actions there are."""
    by_tag = Window.partitionBy("doc_id", "tag")
    clear = F.max(F.when(F.col("action").isin("set", "delete"), F.col("step"))).over(by_tag)
    rows = actions.withColumn("clear", clear)
    kept = delete_tags(tags, rows.filter("clear is not null"))
    new = rows.filter("action <> 'delete' and step >= coalesce(clear, step)").select("doc_id", "tag", "data", F.col("step").alias("ord"))
    return add_tags(kept, new)
