"""Containers written anew in their own row.

An edit is a fold over a container's records where they lie: it is taken apart by its directory, changed step by step, and put
together again with new offsets. Payloads are neither exploded nor shuffled, and what no step touches (name, times, record
attributes, unknown fields) stays as it is. Metadata is edited in both halves of a hybrid, in the charset of each, and a hybrid is taken apart into two documents.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from codexspark.functions.binary import NOTSET
from codexspark.operators.metadata import FIELDS, LANGUAGES, REGIONS, TAGS
from codexspark.sources.containers import LONGEST_NAME, tag_list
from codexspark.sources.reader import header_field, newer_base
from codexspark.sources.writer import Records, put_together

STEPS = "array<struct<action:string,at:bigint,count:bigint,data:array<binary>>>"
ACTIONS = "array<struct<action:string,tag:int,value:string>>"
TITLE, LANGUAGE = FIELDS["title"], FIELDS["language"]


def taken_apart(content: bytes) -> tuple[bytes, Records] | None:
    """(the 78 bytes before the directory, (attributes, data) of each record), or None for a damaged directory."""
    count = int.from_bytes(content[76:78], "big")
    if len(content) < 78 + 8 * count or not count:
        return None
    starts = [int.from_bytes(content[78 + 8 * i : 82 + 8 * i], "big") for i in range(count)] + [len(content)]
    if any(not 0 <= a <= b <= len(content) for a, b in zip(starts, starts[1:])):
        return None
    return content[:78], [(content[82 + 8 * i], content[a:b]) for i, (a, b) in enumerate(zip(starts, starts[1:]))]


def with_steps(content: bytes, steps: list[dict]) -> bytes | None:
    """Steps in order: `delete` and `extract` take `count` records from `at` on, `insert` puts data before `at` (at the end if null),
    `replace` puts the first of data in the place of record `at`. Places beyond the end change nothing."""
    parts = taken_apart(content)
    if parts is None:
        return None
    head, records = parts
    for s in steps:
        at, count, new = s["at"], s["count"] or 0, [(0, bytes(d)) for d in s["data"] or []]
        at = len(records) if at is None else max(0, at)
        if s["action"] == "delete":
            records = records[:at] + records[at + count :]
        elif s["action"] == "extract":
            records = records[at : at + count]
        elif s["action"] == "insert":
            records = records[:at] + new + records[at:]
        elif s["action"] == "replace" and at < len(records) and new:
            records = [*records[:at], (records[at][0], new[0][1]), *records[at + 1 :]]
    return put_together(head, records) if 0 < len(records) <= 0xFFFF else None


def locale_number(name: str) -> int:
    """As metadata.with_locale_number: the lowest language that begins like the name, its lowest region of that name, or 0."""
    name = name.lower()
    language = min((n for n, own in LANGUAGES.items() if own[:2] == name[:2]), default=None)
    if language is None:
        return 0
    region = 0 if LANGUAGES[language] == name else next((r for r, own in enumerate(REGIONS.get(language, ()), 1) if own == name), 0)
    return language + (region * 4 << 8)


def with_actions(zero: bytes, actions: list[dict]) -> bytes:
    """Record 0 after actions (add|set|delete, tag, value) in order: tags, full name and locale. Text goes into the charset of the
    header, what that lacks becomes a question mark; an empty value is refused. Without a long header nothing changes."""
    number = lambda at: int.from_bytes(zero[at : at + 4], "big")
    length = number(20)
    if zero[16:20] != b"MOBI" or length < 116 or len(zero) < length + 16:  # a shorter header has no flags for a list
        return zero
    charset = "utf-8" if number(28) == 65001 else "cp1252"
    flags = number(128)
    tags = tag_list(zero, length + 16) if flags & 0x40 else []
    name = zero[number(84) : number(84) + number(88)] if number(88) not in (0, NOTSET) else b""
    locale = number(92)
    for a in actions:
        tag, value = a["tag"], a["value"] or ""
        kind = TAGS.get(tag, ("string",))[0]
        data = (int(value) if value.strip().isdigit() else 0).to_bytes(4, "big") if kind == "numeric" else value.encode(charset, "replace")
        if a["action"] in ("set", "delete"):
            tags = [(t, d) for t, d in tags if t != tag]
        if a["action"] != "delete" and data:
            tags.append((tag, data))
        if tag == TITLE:
            name = b"" if a["action"] == "delete" else data
        elif tag == LANGUAGE:
            locale = 0 if a["action"] == "delete" else locale_number(value)
    return with_list(zero, tags, name, {92: locale, 128: flags})


def with_list(zero: bytes, tags: list[tuple[int, bytes]], name: bytes, fields: dict[int, int]) -> bytes:
    """Record 0 with other tags, full name and fields (by their places, flags at 128 among them)."""
    body = b"".join(t.to_bytes(4, "big") + (len(d) + 8).to_bytes(4, "big") + d for t, d in tags)
    listed = b"EXTH" + (len(body) + 12).to_bytes(4, "big") + len(tags).to_bytes(4, "big") + body + bytes(-len(body) % 4) if tags else b""
    end = int.from_bytes(zero[20:24], "big") + 16
    head = bytearray(zero[:end])
    for at, value in (fields | {84: end + len(listed), 88: len(name), 128: fields[128] & 0xFFFFFFBF | (0x40 if tags else 0)}).items():
        if at + 4 <= len(head):
            head[at : at + 4] = value.to_bytes(4, "big")
    return bytes(head) + listed + name + bytes(64)


def container_name(title: str) -> bytes:
    return re.sub("[^0-9A-Za-z]", "_", title).encode()[:31].ljust(32, b"\0")


def with_metadata(content: bytes, actions: list[dict]) -> bytes | None:
    """A container after actions on each of its halves; a title also names the container."""
    parts = taken_apart(content)
    if parts is None:
        return None
    head, records = parts
    for base in {0, newer_base(content) or 0}:
        records[base] = (records[base][0], with_actions(records[base][1], actions))
    titles = [a["value"] for a in actions if a["tag"] == TITLE and a["action"] != "delete" and a["value"]]
    return put_together(container_name(titles[-1]) + head[32:] if titles else head, records)


def read_zero(zero: bytes) -> tuple[list[tuple[int, bytes]], bytes]:
    """(tags, full name) of a record 0."""
    number = lambda at: int.from_bytes(zero[at : at + 4], "big")
    tags = tag_list(zero, number(20) + 16) if (header_field(zero, "exth_flags") or 0) & 0x40 else []
    size = header_field(zero, "full_name_length") or 0
    name = zero[number(84) : number(84) + size] if 0 < size <= LONGEST_NAME else b""
    return tags, name if len(name) == size else b""


def older_version(records: Records, base: int) -> Records:
    """A hybrid's records without its newer half: all from the boundary on but the last record, and embedded sources; fonts and resource
    lists are cut to their first four bytes. Record 0 no longer points to what went."""
    zero = records[0][1]
    field = lambda name: header_field(zero, name)
    image, sources, many = field("image_index"), field("srcs_index"), field("srcs_count") or 0
    rows = []
    for i, (attributes, data) in enumerate(records):
        gone = i >= base - 1 and i < len(records) - 1 or i and sources is not None and sources <= i < sources + many
        stub = image is not None and i >= image and data[:4] in (b"FONT", b"RESC")
        if not gone:
            rows.append((attributes, data[:4] if stub else data))
    tags, name = read_zero(zero)
    tags = [(t, b"\xff\xff\xff\xff" if t == 121 and len(d) == 4 else d) for t, d in tags if t != 129]
    fields = {128: int.from_bytes(zero[128:132], "big") & 0x7FF} | ({224: NOTSET, 228: 0} if sources is not None and field("srcs_count") is not None else {})
    return [(rows[0][0], with_list(zero, tags, name, fields)), *rows[1:]]


def newer_version(records: Records, base: int) -> Records | None:
    """A hybrid's newer half with the older one's resources moved in front of its own, and what points behind them moved too; a start
    of reading beyond the text goes. None where counts of resources (tag 125) or first resources are missing."""
    old, zero = records[0][1], records[base][1]
    old_at, new_at = header_field(old, "image_index"), header_field(zero, "image_index")
    tags, name = read_zero(zero)
    counts = [next((int.from_bytes(d[:4], "big") for t, d in own if t == 125), None) for own in (read_zero(old)[0], tags)]
    if None in (old_at, new_at, *counts):
        return None
    own, moved, new_at = records[base:], records[old_at : min(old_at + counts[0], base)], max(new_at, 1)
    number = lambda at, width=4: int.from_bytes(zero[at : at + width], "big")
    fields = {at: number(at) + counts[0] for at in (192, 200, 208, 256, 120) if at + 4 <= len(zero) and number(at) < NOTSET - counts[0]}
    own_tags = []
    for t, d in tags:
        value = int.from_bytes(d[:4], "big")
        if t != 116 or value <= number(8, 2):
            own_tags.append((t, (value + counts[0] & NOTSET).to_bytes(4, "big") if t == 125 and len(d) == 4 else d))
    new_zero = with_list(zero, own_tags, name, fields | {128: number(128) & 0x7FF | 0x800})
    return [(own[0][0], new_zero), *own[1:new_at], *moved, *own[new_at:]]


@F.pandas_udf(StructType().add("halves", LongType()).add("older", BinaryType()).add("newer", BinaryType()))
def _versions(content: pd.Series) -> pd.DataFrame:
    out = []
    for c in content:
        parts = None if c is None else taken_apart(bytes(c))
        base = None if parts is None else newer_base(bytes(c))
        if base is None:
            out.append((None if parts is None else 1, None, None))
            continue
        both = older_version(parts[1], base), newer_version(parts[1], base)
        out.append((2, *(put_together(parts[0], r) if r and len(r) <= 0xFFFF else None for r in both)))
    return pd.DataFrame(out, columns=["halves", "older", "newer"]).astype({"halves": "Int64", "older": object, "newer": object})


def versions(files: DataFrame) -> DataFrame:
    """(doc_id, halves, older, newer): how many versions a container holds, and both versions of a hybrid as containers of their own."""
    return files.select("doc_id", _versions.asNondeterministic()("content").alias("v")).select("doc_id", "v.*")


def _applied(change):
    @F.pandas_udf(BinaryType())
    def apply(content: pd.Series, steps: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else change(bytes(c), [] if s is None else list(s)) for c, s in zip(content, steps)], dtype=object)

    return apply


_stepped, _edited = _applied(with_steps), _applied(with_metadata)


def step(action: str, at: Column | None = None, count: Column | int = 0, data: Column | None = None) -> Column:
    """One of the steps of rewritten()."""
    count = count if isinstance(count, Column) else F.lit(count)
    return F.struct(F.lit(action).alias("action"), (F.lit(None) if at is None else at).cast("long").alias("at"), count.cast("long").alias("count"), (F.lit(None) if data is None else data).cast("array<binary>").alias("data"))


def action(kind: str, tag: int, value: Column | None = None) -> Column:
    """One of the actions of edited()."""
    return F.struct(F.lit(kind).alias("action"), F.lit(tag).cast("int").alias("tag"), (F.lit(None) if value is None else value).cast("string").alias("value"))


def stepped(content: Column, *steps: Column) -> Column:
    """A container after steps; null where the directory is damaged or no record is left."""
    return _stepped(content, F.array(*steps).cast(STEPS))


def rewritten(files: DataFrame, *steps: Column) -> DataFrame:
    """(doc_id, content) after steps, which may use any column of files."""
    return files.select("doc_id", stepped(F.col("content"), *steps).alias("content"))


def edited(files: DataFrame, *actions: Column) -> DataFrame:
    """(doc_id, content) after actions on the metadata of all halves."""
    return files.select("doc_id", _edited("content", F.array(*actions).cast(ACTIONS)).alias("content"))
