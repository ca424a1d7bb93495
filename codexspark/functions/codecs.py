"""Byte codecs of single records: small helpers behind Arrow-batched functions. A bad record gives null, never an error."""

from __future__ import annotations

import functools
import re
import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType

RECORD = 4096
DEPTH = 20
DICTIONARY = 64 << 20  # bytes of all phrases of a document that are held
FONT = 50 << 20  # bytes of a font
SAME, LARGEST = 32, 0xFFFF  # records whose text a worker remembers, and the bytes of one


#: One step of LZ text: a run of bytes that stand for themselves, a space and a character, a reference, or 1 to 8 copied bytes.
STEP = re.compile(rb"(?s)[\x00\x09-\x7f]+|[\xc0-\xff]|[\x80-\xbf].|" + b"|".join(rb"%c.{%d}" % (n, n) for n in range(1, 9)))
SPACED = {c: bytes((32, c ^ 0x80)) for c in range(0xC0, 0x100)}


def unlz(data: bytes, most: int = RECORD) -> bytes | None:
    """PalmDOC LZ77: 1-8 copy so many bytes, 9-7F and 0 stand for themselves, 80-BF refer back, C0-FF are a space and a
    character. Null where a step is cut or there is more than `most`. Equal records of a worker are decoded once."""
    return unlz_same(data, most) if len(data) <= LARGEST else unlz_one(data, most)


def unlz_one(data: bytes, most: int) -> bytes | None:
    all_steps = STEP.findall(data)
    if sum(map(len, all_steps)) != len(data):
        return None
    out = bytearray()  # at most five times as long as data
    for step in all_steps:
        c = step[0]
        if c >= 0xC0:
            out += SPACED[c]
        elif c >= 0x80:
            pair = (c << 8 | step[1]) & 0x3FFF
            back, size = pair >> 3, (pair & 7) + 3
            if not 0 < back <= len(out):
                return None
            start = len(out) - back
            out += out[start : start + size] if size <= back else (out[start:] * -(-size // back))[:size]
        elif 0 < c < 9:
            out += step[1:]
        else:
            out += step
    return bytes(out) if len(out) <= most else None


unlz_same = functools.lru_cache(maxsize=SAME)(unlz_one)


def lz(data: bytes) -> bytes:
    """A greedy encoder: the latest place of the next three bytes is tried."""
    out, seen, i = bytearray(), {}, 0
    while i < len(data):
        back = seen.get(data[i : i + 3])
        if back is not None and i - back <= 2047 and i + 3 <= len(data):
            size = 3
            while size < 10 and i + size < len(data) and data[back + size] == data[i + size]:
                size += 1
            pair = 0x8000 | (i - back) << 3 | size - 3
            out += bytes((pair >> 8, pair & 255))
        elif data[i] == 32 and i + 1 < len(data) and 0x40 <= data[i + 1] < 0x80:
            size = 2
            out.append(data[i + 1] ^ 0x80)
        elif data[i] == 0 or 9 <= data[i] < 0x80:
            size = 1
            out.append(data[i])
        else:
            size = 1
            while size < 8 and i + size < len(data) and not (data[i + size] == 0 or 9 <= data[i + size] < 0x80):
                size += 1
            out += bytes((size,)) + data[i : i + size]
        for k in range(i, i + size):
            seen[data[k : k + 3]] = k
        i += size
    return bytes(out)


def trailing(data: bytes, flags: int) -> int | None:
    """Bytes after the text of a record: an entry for each of flag bits 15 to 1, sized by a number at its end, then up to
    four bytes of a split character."""
    end = len(data)
    for bit in range(15, 0, -1):
        if flags >> bit & 1:
            size, shift, at = 0, 0, end
            while shift < 28:
                at -= 1
                if at <= 0:
                    return None
                size |= (data[at] & 127) << shift
                shift += 7
                if data[at] & 128:
                    break
            end -= size
            if size == 0 or end < 0:
                return None
    if flags & 1:
        if end < 1:
            return None
        end -= (data[end - 1] & 3) + 1
    return len(data) - end if end >= 0 else None


class Huffman:
    """Codes and phrases of one document, from its HUFF and CDIC records. Output is counted: a record or phrase that exceeds
    its limit, and phrases of more than DICTIONARY bytes together, are an error and not a matter of memory."""

    def __init__(self, huff: bytes, cdics: list[bytes]):
        if huff[:4] != b"HUFF" or len(huff) < 24 or any(c[:4] != b"CDIC" or len(c) < 16 for c in cdics) or not 0 < len(cdics) <= 1024:
            raise ValueError("no dictionary")
        word = lambda b, at: int.from_bytes(b[at : at + 4], "big")
        at1, at2 = word(huff, 8), word(huff, 12)
        if at1 + 1024 > len(huff) or at2 + 256 > len(huff):
            raise ValueError("tables beyond the record")
        self.short = [(e & 31, e >> 7 & 1, e >> 8) for e in (word(huff, at1 + 4 * i) for i in range(256))]
        self.least = [0, *[word(huff, at2 + 8 * i) << (31 - i) for i in range(32)]]
        self.most = [0, *[(word(huff, at2 + 8 * i + 4) + 1 << (31 - i)) - 1 for i in range(32)]]
        self.phrases: list[tuple[bytes, bool]] = []
        count = word(cdics[0], 8)
        for c in cdics:
            bits = word(c, 12)
            if bits > 16:
                raise ValueError("code length")
            for i in range(min(1 << bits, count - len(self.phrases))):
                start = 16 + int.from_bytes(c[16 + 2 * i : 18 + 2 * i], "big")
                head = int.from_bytes(c[start : start + 2], "big")
                if start + 2 + (head & 0x7FFF) > len(c):
                    raise ValueError("phrase beyond the record")
                self.phrases.append((c[start + 2 : start + 2 + (head & 0x7FFF)], head >= 0x8000))
        self.known: dict[int, bytes] = {}
        self.held = 0
        self.same: dict[tuple[bytes, int], bytes] = {}
        #: What codes of up to 16 bits stand for, by their first 16 bits: (bits, phrase).
        self.first: dict[int, tuple[int, int]] = {}

    def code(self, window: int) -> tuple[int, int]:
        """(bits, phrase) of the code that 32 bits begin with."""
        size, ends, most = self.short[window >> 24]
        if ends:
            most = (most + 1 << (32 - size)) - 1
        else:
            while window < self.least[size]:
                size += 1
            most = self.most[size]
        if not size:
            raise ValueError("code of no bits")
        got = size, (most - window) >> (32 - size)
        if size <= 16:
            self.first[window >> 16] = got
        return got

    def __call__(self, data: bytes, limit: int, depth: int = 0) -> bytes:
        if depth > DEPTH:
            raise ValueError("too deep")
        out, total, buffer, have, left = [], 0, 0, 0, 8 * len(data)
        words = iter(struct.unpack(f">{len(data) // 4 + 2}I", data + bytes(8 - len(data) % 4)))
        known, first = self.known, self.first
        while left > 0:
            if have < 32:
                buffer = (buffer & (1 << have) - 1) << 32 | next(words)
                have += 32
            window = buffer >> (have - 32) & 0xFFFFFFFF
            size, i = first.get(window >> 16) or self.code(window)
            left -= size
            have -= size
            if left < 0:
                break
            part = known.get(i)
            if part is None:
                part = self.phrase(i, limit, depth)
            total += len(part)
            if total > limit:
                raise ValueError("more than a record may hold")
            out.append(part)
        return b"".join(out)

    def record(self, data: bytes, limit: int) -> bytes:
        """A record's text; equal ones are decoded once."""
        if len(data) > LARGEST:
            return self(data, limit)
        found = self.same.get((data, limit))
        if found is None:
            found = self(data, limit)
            if len(self.same) >= SAME:
                self.same.pop(next(iter(self.same)))
            self.same[data, limit] = found
        return found

    def phrase(self, i: int, limit: int, depth: int) -> bytes:
        if i < 0:
            raise ValueError("no such phrase")
        data, plain = self.phrases[i]
        found = self.known[i] = data if plain else self(data, limit, depth + 1)
        self.held += len(found)
        if self.held > DICTIONARY:
            raise ValueError("more phrases than a dictionary may hold")
        return found


@functools.lru_cache(maxsize=4)
def shared(huff: bytes, cdics: tuple[bytes, ...]) -> Huffman:
    """One decoder, with its phrases, for all documents of a worker that have the same dictionary."""
    return Huffman(huff, list(cdics))


def unhuff(records: list[bytes], huff: bytes, cdics: list[bytes], limit: int = RECORD) -> list[bytes | None]:
    """Text of each record; null for one that is damaged or longer than `limit`."""
    try:
        decode = shared(huff, tuple(cdics))
    except (ValueError, IndexError):
        return [None] * len(records)
    if decode.held > DICTIONARY // 2:  # what other documents have left in it is no part of this one's bound
        shared.cache_clear()
        decode = shared(huff, tuple(cdics))
    before = decode.held
    out: list[bytes | None] = []
    for r in records:
        try:
            out.append(decode.record(r, limit))
        except (ValueError, IndexError):
            if before and decode.held > DICTIONARY:
                shared.cache_clear()
                return unhuff(records, huff, cdics, limit)
            out.append(None)
    return out


def font(data: bytes) -> bytes | None:
    """A FONT record's font: 24-byte header, first bytes masked with a key (flag 2), deflated (flag 1). No more is inflated
    than its header says, nor than FONT."""
    if len(data) < 24 or data[:4] != b"FONT":
        return None
    size, flags, at, key_size, key_at = (int.from_bytes(data[i : i + 4], "big") for i in (4, 8, 12, 16, 20))
    if size > FONT:
        return None
    body = bytearray(data[at:])
    if flags & 2 and key_size:
        key = data[key_at : key_at + key_size]
        if len(key) < key_size:
            return None
        for i in range(min(len(body), 52 * key_size)):
            body[i] ^= key[i % key_size]
    try:
        stream = zlib.decompressobj()
        out = stream.decompress(bytes(body), size + 1) if flags & 1 else bytes(body)
    except zlib.error:
        return None
    return out if len(out) == size and (stream.eof or not flags & 1) else None


def by_row(fn, result: DataType = BinaryType()):
    """fn over the columns' values, null where a value is null. fn itself gives null for what is damaged."""

    @F.pandas_udf(result)
    def each(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns)
        return pd.Series([None if any(v is None for v in r) else fn(*[bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else v for v in r]) for r in rows], dtype=object)

    return each


unlz_record = by_row(lambda b, limit: unlz(b, int(limit)))
lz_record = by_row(lz)
trailing_size = by_row(lambda b, flags: trailing(b, int(flags)), LongType())
font_data = by_row(font)
without_zeros = by_row(lambda b: b.replace(b"\0", b""))
