"""Hand-written vectors, round trips and damage for the byte helpers; none of these needs Spark."""

import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from codexspark.functions import codecs
from codexspark.operators import index
from codexspark.operators.dictionary import inflected
from codexspark.operators.markup import spliced
from codexspark.sources import fixtures


def test_lz_vectors():
    assert codecs.unlz(b"abc") == b"abc"
    assert codecs.unlz(b"\x03\x80\x81\x82") == b"\x80\x81\x82"
    assert codecs.unlz(b"a\xe1") == b"a a"
    assert codecs.unlz(b"abc" + (0x8000 | 3 << 3 | 0).to_bytes(2, "big")) == b"abcabc"
    assert codecs.unlz(b"a" + (0x8000 | 1 << 3 | 7).to_bytes(2, "big")) == b"a" * 11
    assert codecs.unlz(b"\x00") == b"\x00"


def test_lz_damage():
    assert codecs.unlz(b"\x80") is None  # cut pair
    assert codecs.unlz(b"a\x80\x28") is None  # before the start
    assert codecs.unlz(b"\x05ab") is None  # cut copy
    assert codecs.unlz(b"x" * 9000) is None  # longer than the record may be
    assert codecs.unlz(b"x" * 9000, 9000) == b"x" * 9000


@given(st.binary(max_size=4096))
def test_lz_round_trip(data):
    assert codecs.unlz(codecs.lz(data)) == data


@given(st.binary(max_size=300), st.integers(0, 300))
def test_lz_any_input_ends(data, cut):
    codecs.unlz(codecs.lz(data)[:cut])
    codecs.unlz(data)


@given(st.binary(max_size=600))
def test_huffman_round_trip(data):
    place = {p: 256 + i for i, p in enumerate(fixtures.PAIRS)}
    codes, i = [], 0
    while i < len(data):
        pair = place.get(data[i : i + 2])
        codes.append(data[i] if pair is None else pair)
        i += 1 if pair is None else 2
    assert codecs.unhuff([fixtures.packed(codes)], fixtures.huff_record(), [fixtures.cdic_record()]) == [data]


def test_huffman_damage():
    assert codecs.unhuff([fixtures.packed([97, 98])] * 2, fixtures.huff_record(), [fixtures.cdic_record()], 1) == [None, None]
    assert codecs.unhuff([b"x"], b"HUFX", [fixtures.cdic_record()]) == [None]
    assert codecs.unhuff([b"x"], fixtures.huff_record()[:40], [fixtures.cdic_record()]) == [None]


def test_trailing_entries():
    assert codecs.trailing(b"text.\x82", 2) == 2
    assert codecs.trailing(b"text\x00", 1) == 1
    assert codecs.trailing(b"tex\x01\x02\x03", 1) == 4
    assert codecs.trailing(b"", 1) is None
    assert codecs.trailing(b"\x82", 2) is None  # a number never takes the first byte
    assert codecs.trailing(b"text", 0) == 0


def test_font():
    body = zlib.compress(b"OTTOfont")
    head = b"FONT" + b"".join(x.to_bytes(4, "big") for x in (8, 1, 24, 0, 0))
    assert codecs.font(head + body) == b"OTTOfont"
    assert codecs.font(head + body[:-3]) is None
    assert codecs.font(b"FONT") is None
    assert codecs.font(head.replace((8).to_bytes(4, "big"), (9).to_bytes(4, "big"), 1) + body) is None


def test_inflection_rules():
    assert inflected(b"walk", b"\x02s") == b"walks"
    assert inflected(b"walk", b"\x02de") == b"walked"
    assert inflected(b"walk", b"\x01un") == b"unwalk"
    assert inflected(b"city", b"\x03y\x02sei") == b"cities"
    assert inflected(b"geben", b"\x04g") == b"eben"
    assert inflected(b"city", b"\x03x") is None
    assert inflected(b"", b"\x03x") is None
    assert inflected(b"abcd", b"\x0c\x01") == b"abcd"
    assert inflected(b"word", b"") == b"word"


def test_index_round_trip_and_damage():
    schema = [(1, 1, 1, 0), (6, 2, 2, 0), (42, 1, 12, 0), (0, 0, 0, 1)]
    rows = [(b"one", [[300], [5, 70000], [1, 2]]), (b"two", [[], [], []]), (b"", [[0], [1, 2], [7]])]
    records = index.encode(rows, schema, 1)
    got = index.decode(records)
    assert [e["label"] for e in got] == [b"one", b"two", b""]
    assert got[0]["tags"] == [{"tagid": 1, "values": [300]}, {"tagid": 6, "values": [5, 70000]}, {"tagid": 42, "values": [1, 2]}]
    assert got[1]["tags"] == []
    for k, whole in enumerate(records):
        for n in range(len(whole)):
            cut = list(records)
            cut[k] = whole[:n]
            index.decode(cut)  # a status or entries, never an error
    assert index.decode([b"INDX"]) is None
    assert index.decode([]) is None


def plain_tags(data, at, end, controls, schema):
    """Tags of one entry, value by value."""

    def value_at(at):
        value = 0
        for i in range(at, min(at + 4, end)):
            value = value << 7 | data[i] & 127
            if data[i] & 128:
                return value, i + 1
        return value, min(at + 4, end)

    wanted, byte = [], at
    at += controls
    for tag, each, mask, ends in schema:
        byte += bool(ends)
        bits = 0 if ends else data[byte] & mask
        if bits and bits == mask and mask.bit_count() > 1:
            size, at = value_at(at)
            wanted.append((tag, None, size))
        elif bits:
            wanted.append((tag, each * (bits // (mask & -mask)), None))
    out = []
    for tag, count, size in wanted:
        values, start = [], at
        while (len(values) < count if size is None else at - start < size) and len(values) < index.MOST_VALUES and at < end:
            value, at = value_at(at)
            values.append(value)
        out.append({"tagid": tag, "values": values})
    return out


def plain_decode(records):
    """An index entry by entry; None where it is damaged."""
    try:
        meta, out = records[0], []
        controls, schema = index.schema_of(meta)
        table = index.label_table(meta)
        if meta[:4] != b"INDX":
            return None
        for data in records[1 : 1 + index.number(meta, 24)]:
            stop, count = index.number(data, 20), index.number(data, 24)
            if data[:4] != b"INDX" or data[stop : stop + 4] != b"IDXT" or count > index.MOST_ENTRIES:
                return None
            starts = [index.number(data, stop + 4 + 2 * i, 2) for i in range(count)]
            for a, b in zip(starts, [*starts[1:], stop]):
                size = data[a]
                if b <= a or size > b - a or b > len(data):
                    return None
                label = data[a + 1 : a + 1 + size]
                label = index.ordered_label(label, *table) if table else index.label_of(label, index.number(meta, 48) > 0)
                out.append({"entry_no": len(out), "label": label, "tags": plain_tags(data, a + 1 + size, b, controls, schema)})
        return out if len(out) == index.number(meta, 36) else None
    except (ValueError, IndexError):
        return None


@pytest.mark.parametrize("at_once", (300, index.AT_ONCE))
def test_columns_equal_entries_one_by_one(monkeypatch, at_once):
    """Whole and damaged indexes of several schemas, with and without tables of labels, decoded together."""
    monkeypatch.setattr(index, "AT_ONCE", at_once)
    rng, groups = random.Random(7), []
    schemas = [[(1, 1, 1, 0), (2, 2, 6, 0), (3, 1, 0x30, 0), (0, 0, 0, 1), (5, 1, 0xFF, 0), (0, 0, 0, 1)], [(6, 2, 3, 0), (0, 0, 0, 1)]]
    for _ in range(400):
        schema = rng.choice(schemas)
        several = lambda n, top: [rng.randrange(top) for _ in range(n)]
        tags = lambda: [several(rng.randrange(2), 1 << 27), several(2 * rng.randrange(3), 300), several(rng.randrange(3), 9), several(rng.choice((0, 3, 120)), 9)] if schema is schemas[0] else [several(2 * rng.randrange(3), 1 << 20)]
        rows = [(bytes(several(rng.randrange(9), 256)), tags()) for _ in range(rng.randrange(6))]
        table = [several(rng.choice((3, 200)), 65536), rng.random() < 0.5] if rng.random() < 0.4 else []
        records = [bytearray(r) for r in index.encode(rows, schema, sum(r[3] for r in schema), *table)]
        for _ in range(rng.choice((0, 0, 1, 1, 3))):
            own = rng.choice(records)
            own[rng.randrange(len(own))] = rng.choice((0, 255, rng.randrange(256)))
        groups.append([bytes(r) for r in records])
    groups += [None, [], [b"INDX"]]
    wanted = [plain_decode(g) if g else None for g in groups]
    assert index.decoded(groups).to_pylist() == wanted
    assert sum(w is None for w in wanted) > 20 and sum(bool(w) for w in wanted) > 100
    assert len(index.decoded([])) == 0


def test_labels():
    assert index.label_of(b"\x01EB\x00\x05s\x01aB\x02", True) == "Œ".encode("cp1252") + b"B?" + "ß".encode("cp1252") + b"?aB?"
    assert index.label_of(b"\x01a", False) == b"\x01a"
    assert index.ordered_label(bytes((0, 1, 9, 0xE9)), [0x41, 0x20AC]) == "A€\té".encode()
    assert index.ordered_label(b"\x00\x00\x20\xac\x00\x01\x00", [0x41, 0], wide=True) == "A€\ufffd".encode()
    assert index.ordered_label(bytes((0, 1, 2, 1, 3, 4, 3)), [1, 0x45, 0x41, 0xD83D, 0xDE00]) == "ŒAE😀\ufffd".encode()
    assert index.ordered_label(bytes((0, 1)), [2, 0x45]) == "\ufffdE".encode()
    assert len(index.ordered_label(bytes(500), [0x20AC])) == 999 and index.ordered_label(b"", [65]) == b""


def test_label_tables_and_damage():
    schema = [(1, 1, 1, 0), (0, 0, 0, 1)]
    for wide in (False, True):
        label = bytes((0, 1)) if not wide else bytes((0, 0, 0, 1))
        meta, data = index.encode([(label, [[7]])], schema, 1, [0x3B1, 0x3B2], wide)
        assert [e["label"].decode() for e in index.decode([meta, data])] == ["αβ"]
        assert index.decode([meta[:-1], data]) is None
        assert index.decode([meta[:-5], data])[0]["label"] == label.replace(b"\0", b"?")  # its units reach beyond the record: no table
        assert index.decode([meta[:100], data]) is None


def test_splice():
    edit = lambda a, b, v: {"start": a, "stop": b, "value": v}
    assert spliced(b"abcdef", [edit(2, 4, b"X"), edit(2, 2, b"("), edit(4, 4, b")"), edit(3, 3, b"lost"), edit(6, 6, b"."), edit(9, 9, b"?")]) == b"ab(X)ef."
    assert spliced(b"", []) == b""


def test_phrases_that_name_each_other_twice_stop_at_the_limit():
    phrases = [fixtures.packed([i + 1, i + 1]) for i in range(20)] + [b"boom"]
    at, offsets, body = 2 * len(phrases), b"", b""
    for i, p in enumerate(phrases):
        offsets += (at + len(body)).to_bytes(2, "big")
        body += (len(p) | (0x8000 if i == 20 else 0)).to_bytes(2, "big") + p
    cdic = b"CDIC" + (16).to_bytes(4, "big") + len(phrases).to_bytes(4, "big") + (9).to_bytes(4, "big") + offsets + body
    assert codecs.unhuff([fixtures.packed([0]), fixtures.packed([18])], fixtures.huff_record(), [cdic]) == [None, b"boom" * 4]
    assert codecs.unhuff([fixtures.packed([20])] * 2, fixtures.huff_record(), [cdic[:40]]) == [None, None]


def test_fonts_inflate_no_further_than_declared():
    body = zlib.compress(bytes(1 << 20))
    head = b"FONT" + b"".join(n.to_bytes(4, "big") for n in (8, 1, 24, 0, 24))
    assert codecs.font(head + body) is None


@pytest.mark.parametrize("flags, tail, kept", [(0, b"", 4), (1, b"\xc3\x01", 4), (2, b"zz\x83", 4), (6, b"y\x82zz\x83", 4), (7, b"\x00y\x82zz\x83", 4)])
def test_trailing_entries_of_all_flags(flags, tail, kept):
    assert len(b"text" + tail) - codecs.trailing(b"text" + tail, flags) == kept


def test_equal_records_are_decoded_once():
    """In either compression; what is too long for its limit stays damage, whichever limit came first."""
    body = b"lorem " * 10922
    coded = codecs.lz(body)
    assert codecs.unlz(coded, 65535) == body and codecs.unlz(bytes(bytearray(coded)), 65535) is codecs.unlz(coded, 65535)
    assert codecs.unlz(coded, 4096) is None and codecs.unlz(coded, 65535) == body
    huff, cdic, record = fixtures.huff_record(), fixtures.cdic_record(), fixtures.packed([104, 105])
    first, second = codecs.unhuff([record, bytes(bytearray(record))], huff, [cdic], 4096)
    assert first == b"hi" and first is second
    assert codecs.unhuff([record], huff, [cdic], 1) == [None]
