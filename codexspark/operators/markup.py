"""Markup of documents: flows, parts from skeletons and fragments, links, anchors and insertions.

Offsets are byte offsets of the text before any change of charset, so markup stays binary here. Links are found in one
pass by a small scanner, resolved as tables with joins, and put back by one splice of each part; the nearest anchor after
a place is a window over places and anchors together, not an inequality join.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from codexspark.functions.binary import base32
from codexspark.functions.text import LONGEST_VALUE

FOUND = "array<struct<start:bigint,stop:bigint,value:string>>"
#: A tag of markup, or a block of a style sheet.
TAG = rb"<[^<>]*>"
BLOCK = rb"\{[^{}]*\}"
FILEPOS = rb"filepos=\"?0*([0-9]{1,10})\"?"
RECINDEX = rb"((?:hi|lo)?recindex=\"?0*[0-9]{1,10}\"?)"
KINDLE = rb"[\"'(]?(kindle:(?:pos:fid:[0-9A-V]+:off:[0-9A-V]+|flow:[0-9A-V]+(?:\?mime=[^\"')\s>]*)?|embed:[0-9A-V]+(?:\?mime=[^\"')\s>]*)?))[\"')]?"
ANCHOR = rb"\s(?:id|name)=\"([^\"]{0,%d})\"" % LONGEST_VALUE
ID, NAME = (rb"\s%s=\"([^\"]{0,%d})\"" % (attribute, LONGEST_VALUE) for attribute in (b"id", b"name"))
AID = rb"\said=\"([^\"]{0,%d})\"" % LONGEST_VALUE


def finder(pattern: bytes, within: bytes = TAG):
    """A function of a binary column: array<struct<start, stop, value>> of the pattern's matches inside tags, in order;
    start and stop are 0-based byte offsets, value is the pattern's first group. Null for null."""
    inner, outer = re.compile(pattern), re.compile(within)

    def one(data) -> list[dict] | None:
        if data is None:
            return None
        b = bytes(data)
        return [
            {"start": m.start() + t.start(), "stop": m.end() + t.start(), "value": m[1].decode("utf-8", "replace")}
            for t in outer.finditer(b)
            for m in inner.finditer(t[0])
        ]

    @F.pandas_udf(FOUND)
    def find(data: pd.Series) -> pd.Series:
        return pd.Series([one(d) for d in data], dtype=object)

    return find


def spliced(data: bytes, edits) -> bytes:
    """data with edits (start, stop, value) in its own offsets; at one place in order of arrival. One that begins inside
    a replaced span, or beyond the end, is left out."""
    out, at = [], 0
    for e in sorted(edits, key=lambda e: (e["start"], e["stop"] > e["start"])):
        start, stop = e["start"], e["stop"]
        if at <= start <= stop <= len(data):
            out += data[at:start], bytes(e["value"])
            at = stop
    return b"".join([*out, data[at:]])


@F.pandas_udf(BinaryType())
def splice(data: pd.Series, edits: pd.Series) -> pd.Series:
    """A part's bytes with array<struct<start, stop, value binary>> applied; null edits change nothing."""
    return pd.Series([None if d is None else bytes(d) if e is None else spliced(bytes(d), e) for d, e in zip(data, edits)], dtype=object)


def flows(text: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, status, uid, data): a document's text by sections (doc_id, section, start, stop), or whole where it has
    none. A section outside the text fails its document."""
    cuts = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "start", "stop"))).alias("cuts"))
    rows = text.select("doc_id", "text").join(cuts, "doc_id", "left")
    bad = F.coalesce(F.exists("cuts", lambda c: (c["start"] > c["stop"]) | (c["stop"] > F.length("text"))), F.lit(False))
    whole = F.array(F.struct(F.lit(0).alias("section"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("stop")))
    rows = rows.withColumn("bad", bad).withColumn("cuts", F.when(F.col("bad"), None).otherwise(F.coalesce("cuts", whole)))
    rows = rows.select("doc_id", F.when(F.col("bad"), "DATA_CORRUPT").otherwise("SUCCESS").alias("status"), "text", F.explode_outer("cuts").alias("c"))
    data = F.substring(F.col("text"), (F.col("c.start") + 1).cast("int"), (F.col("c.stop") - F.col("c.start")).cast("int"))
    return rows.select("doc_id", "status", F.col("c.section").alias("uid"), data.alias("data"))


def flow_kinds(flow_rows: DataFrame, newer: bool = True, decimal: bool = False) -> DataFrame:
    """flows with `kind`: the first is HTML, others what the first one's links to them say (ids in base 32), else
    UNKNOWN; all are HTML in the older format. With `decimal` a flow looks for its number in four decimal digits, as some
    readers do, and so finds another flow's link from 10 on."""
    if not newer:
        return flow_rows.withColumn("kind", F.lit("HTML"))
    found = flow_rows.filter("uid = 0").select("doc_id", F.explode(F.regexp_extract_all(F.decode("data", "ISO-8859-1"), F.lit(r"kindle:(flow:[0-9A-V]+\?mime=[a-z0-9+/.-]+)"), F.lit(1))).alias("raw"))
    parts = found.select("doc_id", F.regexp_extract("raw", "flow:([0-9A-V]+)", 1).alias("fid"), F.regexp_extract("raw", "mime=(.*)", 1).alias("media"))
    kind = F.when(F.col("media") == "text/css", "CSS").when(F.col("media") == "image/svg+xml", "SVG").when(F.col("media").contains("html"), "HTML")
    number = F.when(F.col("fid").rlike("^[0-9]{4}$"), F.col("fid")).cast("int") if decimal else base32(F.col("fid")).cast("int")
    parts = parts.select("doc_id", number.alias("uid"), kind.alias("said")).filter("said is not null and uid is not null").groupBy("doc_id", "uid").agg(F.min("said").alias("said"))
    return flow_rows.join(parts, ["doc_id", "uid"], "left").withColumn("kind", F.when(F.col("uid") == 0, "HTML").otherwise(F.coalesce("said", F.lit("UNKNOWN")))).drop("said")


def markup_parts(text: DataFrame, skeletons: DataFrame, fragments: DataFrame) -> DataFrame:
    """(doc_id, uid, status, data) from the text (doc_id, text), skeletons (doc_id, entry_no, position, length,
    n_fragments) and fragments (doc_id, entry_no, insert_at, file_nr, length).

    The text holds each skeleton and its fragments one after the other. A fragment goes in at its place less the start
    of its part, at most at the end, each into what the ones before it left. Only numbers are shuffled; the text meets
    them once by document."""
    order = Window.partitionBy("doc_id").orderBy("entry_no")
    own = fragments.groupBy("doc_id", F.col("file_nr").alias("entry_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("entry_no").alias("no"), "insert_at", "length"))).alias("own"))
    rows = skeletons.join(own, ["doc_id", "entry_no"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<no:int,insert_at:bigint,length:bigint>>")))
    rows = rows.withColumn("total", F.col("length") + F.aggregate("own", F.lit(0).cast("long"), lambda a, f: a + f["length"]))
    rows = rows.withColumn("start", F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("total"))
    plans = rows.groupBy("doc_id").agg(F.collect_list(F.struct("entry_no", "start", "length", "total", "own", "n_fragments")).alias("plans"))
    each = text.join(plans, "doc_id").select("doc_id", "text", F.explode("plans").alias("p"))
    cut = lambda at, n: F.substring(F.col("text"), (at + 1).cast("int"), n.cast("int"))

    def insert(acc: Column, f: Column) -> Column:
        at = F.least(F.greatest(f["insert_at"] - F.col("p.start"), F.lit(0).cast("long")), F.length(acc["data"]).cast("long"))
        data = F.concat(F.substring(acc["data"], F.lit(1), at.cast("int")), cut(acc["next"], f["length"]), F.substring(acc["data"], (at + 1).cast("int"), F.length(acc["data"])))
        return F.struct((acc["next"] + f["length"]).alias("next"), data.alias("data"))

    first = F.struct((F.col("p.start") + F.col("p.length")).alias("next"), cut(F.col("p.start"), F.col("p.length")).alias("data"))
    data = F.aggregate("p.own", first, insert, lambda acc: acc["data"])
    good = (F.size("p.own") == F.col("p.n_fragments")) & (F.col("p.start") + F.col("p.total") <= F.length("text"))
    status = F.when(good, "SUCCESS").otherwise("DATA_CORRUPT")
    return each.select("doc_id", F.col("p.entry_no").alias("uid"), status.alias("status"), F.when(status == "SUCCESS", data).alias("data"))


def places(links: DataFrame, fragments: DataFrame, part_starts: DataFrame) -> DataFrame:
    """links (doc_id, fid, off, ...) with `file_nr` and `at`, the byte offset in that part: the fragment's place less
    its part's start, plus off. Null where there is no such fragment. part_starts is (doc_id, file_nr, start)."""
    frag = fragments.select("doc_id", F.col("entry_no").cast("long").alias("fid"), "file_nr", "insert_at")
    out = links.join(frag, ["doc_id", "fid"], "left").join(part_starts.select("doc_id", "file_nr", "start"), ["doc_id", "file_nr"], "left")
    return out.withColumn("at", F.col("insert_at") - F.col("start") + F.col("off")).drop("insert_at", "start")


def next_anchors(targets: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """targets (keys, at, ...) with `anchor`, the value of the first of anchors (keys, at, value) at or after each. Both
    are laid in one line by place and read backwards, so the cost is one sort however many fall together."""
    extra = [c for c in targets.columns if c not in (*keys, "at")]
    own = targets.select(*keys, "at", F.lit(1).alias("_t"), F.lit(None).cast("string").alias("_v"), F.struct(*[F.col(c) for c in extra]).alias("_e") if extra else F.lit(None).alias("_e"))
    other = anchors.select(*keys, "at", F.lit(0).alias("_t"), F.col("value").alias("_v"), F.lit(None).cast(own.schema["_e"].dataType).alias("_e"))
    line = Window.partitionBy(*keys).orderBy(F.col("at").desc(), "_t").rowsBetween(Window.unboundedPreceding, 0)
    out = own.unionByName(other).withColumn("anchor", F.last("_v", ignorenulls=True).over(line)).filter("_t = 1")
    return out.select(*keys, "at", *[F.col(f"_e.{c}").alias(c) for c in extra], "anchor")


def anchors_by_kind(targets: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """targets (keys doc_id and file_nr, at, ...) with `id_anchor` and `name_anchor`, the first of either attribute in parts (doc_id, uid, data)
    at or after each."""
    for name, pattern in (("id_anchor", ID), ("name_anchor", NAME)):
        own = anchors(parts, pattern).select("doc_id", F.col("uid").cast("long").alias("file_nr"), "at", "value")
        targets = next_anchors(targets, own, keys).withColumnRenamed("anchor", name)
    return targets


def preferred_anchors(links: DataFrame, keys: list[str], order: str) -> DataFrame:
    """links (id_anchor, name_anchor, ...) with `anchor`: the id until a link finds a name alone, then the name until one finds
    an id alone, and so on, by `order` within keys. A link that finds both or neither changes nothing and one that finds
    one kind sets the preference whatever it was, so the state is the last such link's kind: one window, no walk."""
    only = F.when(F.col("id_anchor").isNotNull() & F.col("name_anchor").isNull(), "id").when(F.col("name_anchor").isNotNull() & F.col("id_anchor").isNull(), "name")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last(only, ignorenulls=True).over(before), F.lit("id"))
    out = links.withColumn("_state", state)
    return out.withColumn("anchor", F.when(F.col("_state") == "id", F.coalesce("id_anchor", "name_anchor")).otherwise(F.coalesce("name_anchor", "id_anchor"))).drop("_state")


def anchors(parts: DataFrame, pattern: bytes = ANCHOR) -> DataFrame:
    """(doc_id, uid, at, value): id and name attributes (or others by pattern) of parts with their offsets."""
    rows = parts.select("doc_id", "uid", F.explode(finder(pattern)("data")).alias("f"))
    return rows.select("doc_id", "uid", F.col("f.start").alias("at"), F.col("f.value").alias("value"))


def kindle_links(parts: DataFrame, style: bool = False) -> DataFrame:
    """(doc_id, uid, start, stop, raw, kind, fid, off): links of the newer format inside tags (or blocks of a style
    sheet). start and stop span the link itself, not its quotes."""
    rows = parts.select("doc_id", "uid", F.explode(finder(KINDLE, BLOCK if style else TAG)("data")).alias("f"))
    raw, size = F.col("f.value"), F.length(F.col("f.value"))
    lead = F.col("f.stop") - F.col("f.start") - size  # quotes that the pattern took along
    start = F.col("f.start") + F.when(lead > 0, 1).otherwise(0)
    kind = F.regexp_extract(raw, "^kindle:(pos|flow|embed):", 1)
    number = lambda p: base32(F.regexp_extract(raw, p, 1))
    fid = F.when(kind == "pos", number(":fid:([0-9A-V]+)")).otherwise(number("^kindle:[a-z]+:([0-9A-V]+)"))
    return rows.select("doc_id", "uid", start.alias("start"), (start + size).alias("stop"), raw.alias("raw"), kind.alias("kind"), fid.alias("fid"), F.when(kind == "pos", number(":off:([0-9A-V]+)")).alias("off"))


def resolved_links(links: DataFrame, located: DataFrame, flow_names: DataFrame, resource_names: DataFrame) -> DataFrame:
    """links with `target`, null where nothing is there: positions by located (doc_id, fid, off, file_nr and anchor, or id_anchor and
    name_anchor, of which a part's links prefer one), flows by (doc_id, uid, file_name), resources by the same with
    numbers from 1."""
    found = [c for c in ("anchor", "id_anchor", "name_anchor") if c in located.columns]
    spot = located.select("doc_id", F.lit("pos").alias("kind"), "fid", "off", "file_nr", *found).distinct()
    flow = flow_names.select("doc_id", F.lit("flow").alias("kind"), F.col("uid").cast("long").alias("fid"), F.col("file_name").alias("t2"))
    res = resource_names.select("doc_id", F.lit("embed").alias("kind"), (F.col("uid") + 1).cast("long").alias("fid"), F.col("file_name").alias("t3"))
    out = links.join(spot, ["doc_id", "kind", "fid", "off"], "left").join(flow, ["doc_id", "kind", "fid"], "left").join(res, ["doc_id", "kind", "fid"], "left")
    if "id_anchor" in found:
        out = preferred_anchors(out, ["doc_id", "uid"], "start")
    place = F.concat(F.format_string("part%05d.html", F.col("file_nr").cast("long")), F.when(F.col("off") > 0, F.concat(F.lit("#"), F.coalesce("anchor", F.lit("")))).otherwise(""))
    return out.withColumn("target", F.coalesce(F.when(F.col("file_nr").isNotNull(), place), "t2", "t3")).drop("t2", "t3", "file_nr", "anchor", "id_anchor", "name_anchor")


def broken_positions(links: DataFrame, located: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id) of documents with a link to a position that isn't there: no such fragment or part, or a place beyond the part's
    end. Links that are too short to hold a position are none. located has `at`, parts (doc_id, uid, data)."""
    sizes = parts.select("doc_id", F.col("uid").cast("long").alias("file_nr"), F.length("data").alias("size"))
    spot = located.select("doc_id", "fid", "off", "file_nr", "at").distinct().join(sizes, ["doc_id", "file_nr"], "left")
    there = spot.filter("at between 0 and size").select("doc_id", "fid", "off")
    pos = links.filter(F.col("raw").rlike("^kindle:pos:fid:[0-9A-V]{4}:off:[0-9A-V]{10}"))
    lost = pos.filter("fid is null or off is null").select("doc_id").unionByName(pos.join(there, ["doc_id", "fid", "off"], "left_anti").select("doc_id"))
    return lost.distinct()


def with_links(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (doc_id, uid, data, ...) with the targets of links (doc_id, uid, start, stop, target) written in; links
    without a target stay as they are."""
    edits = links.filter("target is not null").groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list(F.struct("start", "stop", F.encode("target", "UTF-8").alias("value")))).alias("_edits"))
    return parts.join(edits, ["doc_id", "uid"], "left").withColumn("data", splice("data", "_edits")).drop("_edits")


def old_links(text: DataFrame) -> DataFrame:
    """text (doc_id, text) with `links` and `images`: filepos and recindex attributes inside tags, of the older format.
    Offsets of 0 and those above 32 bits are no targets."""
    rows = text.withColumn("links", finder(FILEPOS)("text")).withColumn("images", finder(RECINDEX)("text"))
    return rows.withColumn("links", F.filter("links", lambda f: f["value"].cast("long").between(1, 0xFFFFFFFF)))


def link_targets(found: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """(doc_id, targets): sorted distinct offsets of old_links() and of a table of contents (doc_id, filepos)."""
    rows = found.select("doc_id", F.explode(F.transform("links", lambda f: f["value"].cast("long"))).alias("at"))
    if toc is not None:
        rows = rows.unionByName(toc.filter("filepos between 1 and 4294967295").select("doc_id", F.col("filepos").cast("long").alias("at")))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("targets"))


def old_markup(text: DataFrame, resource_names: DataFrame, toc: DataFrame | None = None, inserts: DataFrame | None = None) -> DataFrame:
    """(doc_id, data): the older format's text with links and images rewritten, an anchor at each target, and inserts
    (doc_id, start, ord, value binary), such as dictionary entries. Images are numbered from 1; 0 and those without a
    resource stay. Edits are rows of a table until each text meets its own."""
    found = old_links(text)
    spot = lambda rows, start, stop, rank, no, value: rows.select("doc_id", start.cast("long").alias("start"), F.lit(rank).alias("rank"), no.cast("long").alias("no"), stop.cast("long").alias("stop"), value.alias("value"))
    links = found.select("doc_id", F.explode("links").alias("f"))
    href = F.encode(F.concat(F.lit('href="#'), F.lpad(F.col("f.value"), 10, "0"), F.lit('"')), "UTF-8")
    images = found.select("doc_id", F.explode("images").alias("f")).withColumn("number", F.regexp_extract("f.value", "([0-9]+)", 1).cast("long"))
    images = images.join(resource_names.select("doc_id", (F.col("uid") + 1).cast("long").alias("number"), "file_name"), ["doc_id", "number"])
    source = F.encode(F.concat(F.lit('src="'), "file_name", F.lit('"')), "UTF-8")
    marks = link_targets(found, toc).select("doc_id", F.explode("targets").alias("at"))
    mark = F.encode(F.concat(F.lit('<a id="'), F.lpad(F.col("at").cast("string"), 10, "0"), F.lit('"></a>')), "UTF-8")
    edits = spot(marks, F.col("at"), F.col("at"), 0, F.lit(0), mark)
    edits = edits.unionByName(spot(links, F.col("f.start"), F.col("f.stop"), 2, F.lit(0), href)).unionByName(spot(images, F.col("f.start"), F.col("f.stop"), 2, F.lit(0), source))
    if inserts is not None:
        edits = edits.unionByName(spot(inserts, F.col("start"), F.col("start"), 1, F.col("ord"), F.col("value")))
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "no", "stop", "value"))).alias("edits"))
    return text.select("doc_id", "text").join(lists, "doc_id", "left").select("doc_id", splice("text", "edits").alias("data"))


def stripped(parts: DataFrame, newer: bool = True) -> DataFrame:
    """HTML parts of the newer format without their aid attributes; white space before them stays."""
    if not newer:
        return parts
    clean = F.pandas_udf(lambda data: data.map(lambda d: None if d is None else re.sub(TAG, lambda t: re.sub(rb"(?<=\s)aid=\"[^\"]*\"", b"", t[0]), bytes(d))), BinaryType())
    return parts.withColumn("data", clean("data"))
