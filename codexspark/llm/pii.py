"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Four base kinds (email, ip, card, phone) follow fixed patterns and always stay. The method adds kinds whose score,
after checksum and context, reaches a threshold: bank accounts (mod 97), short card numbers (Luhn), social security
numbers and keyed secrets. Offsets are code points, end exclusive.

Every pattern is written so that a scan is linear in the text. Each row is handled alone, in one pass: null and empty
texts have no spans, repeated rows give the same spans, an empty table an empty result; other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "pan", "ssn", "secret")
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits, as the one before it took the whole run; saying so keeps scans linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_/+-]{20,}+")

#: kind: (score of a confirmed match, words that raise it, words that lower it)
CONTEXT = {
    "iban": (0.80, ("iban", "account", "bank", "konto", "compte", "cuenta"), ()),
    "pan": (0.45, ("card", "visa", "amex", "credit", "karte", "carte", "tarjeta"), ("order", "isbn", "part", "version")),
    "ssn": (0.50, ("ssn", "social", "security", "taxpayer"), ("order", "part", "version")),
    "secret": (0.35, ("token", "secret", "password", "passwd", "apikey", "api_key", "key"), ("sha", "commit", "digest", "checksum")),
}
NEAR, RAISE, LOWER, THRESHOLD = 32, 0.30, 0.25, 0.60
WORD = re.compile(r"[a-z_]+")


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return (sum(map(int, digits[-1::-2])) + sum(int(twice[int(d)]) for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @: the local part is the run that ends there."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        run = text[done:at]
        start = done + len(run.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = at = domain.end()
        else:
            done = at = at + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def score(kind: str, text: str, start: int, end: int) -> float:
    """Of a confirmed match, moved by the words around it; words inside it don't count."""
    own, up, down = CONTEXT[kind]
    near = {*WORD.findall(text[max(0, start - NEAR) : start].lower()), *WORD.findall(text[end : end + NEAR].lower())}
    return min(1.0, own + RAISE * any(w in near for w in up)) - LOWER * any(w in near for w in down)


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, each up to its last group end that the checksum confirms: words behind it may look like groups."""
    at = 0
    while m := IBAN.search(text, at):
        start, at = m.start(), m.start() + 4
        for end in [m.end(), *(start + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]:
            account = text[start:end].replace(" ", "")
            if 15 <= len(account) <= 34 and mod97(account):
                yield start, end
                at = end
                break


def added_spans(text: str) -> list[tuple[str, int, int, float]]:
    found = [("iban", a, b) for a, b in accounts(text)]
    found += [("pan", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 15 and luhn(d)]
    found += [("ssn", *m.span()) for m in SSN.finditer(text)]
    taken = [(a, b) for _, a, b in found]  # what a checksum names is no secret as well
    found += [("secret", *m.span()) for m in SECRET.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, b in taken)]
    return [(k, a, b, round(s, 4)) for k, a, b in found if (s := score(k, text, a, b)) >= THRESHOLD]


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """Base spans (score 1) and added ones, by kind as listed, then start."""
    if not text:
        return []
    return [(k, a, b, 1.0) for k, a, b in base_spans(text)] + added_spans(text)


def pii_spans(text: Column) -> Column:
    """Spans of a text column, as SPAN."""

    @F.pandas_udf(SPAN)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t if isinstance(t, str) else None)] for t in texts], dtype=object)

    return spans(text)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the leftmost, then longest, names it."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with personal data masked in the text; its length column, if there is one, follows the text."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t) if isinstance(t, str) else None for t in texts], dtype=object)

    out = docs.withColumn(text, masked(F.col(text)))
    return out.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType)) if length in docs.columns else out
