"""Predicates and derived limits of documents, as columns over headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexspark.functions.binary import NOTSET

LONGEST_TEXT, RECORD = 0x0FFFFFFF, 4096
#: Least header length of versions above each number (fixed values of the format).
LEAST_LENGTH = ((2, 0x74), (3, 0xD0), (5, 0xE4))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_set(field: Column | str) -> Column:
    """The field is there and used."""
    return F.coalesce(col(field) != NOTSET, F.lit(False))


def is_mobipocket(type_: Column | str = "type", creator: Column | str = "creator") -> Column:
    return (col(type_) == "BOOK") & (col(creator) == "MOBI")


def is_plain_reader(type_: Column | str = "type", creator: Column | str = "creator") -> Column:
    return (col(type_) == "TEXt") & (col(creator) == "REAd")


def is_encrypted(encryption: Column | str = "encryption", type_: Column | str = "type", creator: Column | str = "creator") -> Column:
    return (is_mobipocket(type_, creator) | is_plain_reader(type_, creator)) & col(encryption).isin(1, 2)


def is_dictionary(version: Column | str = "version", orth: Column | str = "orth_index") -> Column:
    return (col(version) < 8) & is_set(orth)


def is_newer(version: Column | str = "version") -> Column:
    return F.coalesce(col(version) >= 8, F.lit(False))


def is_replica(compression: Column | str = "compression", record1: Column | str = "record1") -> Column:
    return (col(compression) == 1) & (F.substring(col(record1), 1, 4) == F.lit(b"%MOP"))


def has_flow_table(version: Column | str, count: Column | str, new_index: Column | str, old_index: Column | str | None = None) -> Column:
    """The newer format names its flow table itself; the older one, after version 3, keeps the number in the place of the
    last text record."""
    newer = (col(version) >= 8) & is_set(new_index)
    older = F.lit(False) if old_index is None else col(version).between(4, 7) & (col(old_index) != 0xFFFF) & (col(count) > 1)
    return F.coalesce(newer | older, F.lit(False))


def file_version(has_header: Column | str, header_length: Column | str, version: Column | str) -> Column:
    """1 without a long header, 2 for a very short one, NOTSET where it is too short for what it claims."""
    n, v = col(header_length), F.coalesce(col(version), F.lit(1))
    short = F.lit(False)
    for above, least in LEAST_LENGTH:
        short = short | ((v > above) & (n < least))
    return F.when(~col(has_header) | n.isNull(), 1).when(n < 0x18, 2).when(v <= 1, 1).when(short, NOTSET).otherwise(v).cast("long")


def text_record_limit(version: Column | str, declared: Column | str, n_records: Column | str, text_length: Column | str) -> Column:
    """Decoded bytes of a text record: 4096 or what is declared if that is more; twice 4096 in old documents whose text
    is longer than all its records could be."""
    least = F.greatest(F.coalesce(col(declared), F.lit(0)), F.lit(RECORD))
    total = least * col(n_records)
    old = (col(version) <= 3) & (total <= LONGEST_TEXT) & (col(text_length) > total)
    return F.when(old, 2 * RECORD).otherwise(least).cast("long")


def text_limit(version: Column | str, record_limit: Column | str, n_records: Column | str, text_length: Column | str) -> Column:
    """Most bytes of a document's text; null where there are no records or it is more than any text may have."""
    total = (col(record_limit) * col(n_records)).cast("long")
    total = F.when(col(version) <= 3, F.greatest(total, col(text_length))).otherwise(total)
    return F.when((col(n_records) > 0) & (total <= LONGEST_TEXT), total)


def first_resource(own: Column | str, older: Column | str | None = None) -> Column:
    """The first resource record: a hybrid's halves share that of the older one."""
    return col(own) if older is None else F.coalesce(F.when(is_set(older), col(older)), col(own))

