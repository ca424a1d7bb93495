"""Toxicity: noisy-channel deobfuscation, then scoring of the restored text.

Disguised tokens (leetspeak, letters set apart, repeated letters, marks inside words) become lattices of letters in which
each mark or space is kept as a boundary or dropped. Viterbi finds the most likely words under a character language model
(trigrams counted over every document, mixed with those of the lexicon) in which words of the lexicon are likelier; each
word on the best path is looked up. A walk of the lexicon's beginnings leaves out only tokens that no path can spell an
entry from. The lexicon holds words, with their accents, that speak for label 1: for each word of toxic training texts the
count of distinct words before it (copies of a text add nothing) against the number of other training texts that have it. A
word that is no entry counts as restored if it is one without its accents; the lattice spells entries without accents. Full
width letters, letters of other scripts that look like Latin ones inside a Latin word, and signs without width are put right first.
A small logistic model turns a document's hits, plain and restored, into a score.

Labels are learned only from the rows that `held_out` leaves, at most MOST_ROWS of them (a hash picks them; the tables of
ids and words that go to every task are bounded by that: an entry needs several contexts in those rows). Everything else covers all documents, in passes
without a shuffle of texts.

Null and empty texts have no hits and get the base score; repeated rows get equal scores; conflicting labels of one id
count as 1; without labels of both kinds every score is 0.5; an empty table gives an empty result; other columns
(lang, source, clashing names) are never read.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexspark.llm.shared import interpolated, isotonic, staged

MOST_ROWS = 60_000  # labelled rows that are learned from
FLUSH = 200_000  # entries that a task counts before it hands them on
LEAST, WEIGHT, SURE = 3, 1.5, 1.64  # an entry's contexts, its weight, and the standard errors taken off that
STEMS = range(4, 9)  # letters of a beginning
LONGEST = 40  # letters of a token that can be a word
WORDS = re.compile(r"[^\W\d_]+")
#: Letters that a sign can stand for, cheapest first (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "¡": "i"}
#: Signs that may be put between letters.
MARKS = set(".,-_*~'`^/\\:;") | set(" \t\n\r")
KEPT, LISTED = -0.5, 1.2  # log odds of a mark kept as a boundary, and of each letter of an entry
SIGNS = re.escape("".join(sorted({*LEET, *MARKS} - set(" \t\n\r"))))
LAST = {*LEET} - {"!", "("}
DIGITS, APARTS = (re.escape("".join(sorted(x))) for x in (LEET, MARKS))
#: Signs together, and a letter three times. A token is disguised where signs stand among letters, at its start or end ("!" and
#: "(" at an end are punctuation), or where a letter stands three times.
SIGN_RUN, THRICE = re.compile(rf"[{SIGNS}]++"), re.compile(r"([a-z])\1\1")
TOKEN = re.compile(rf"[a-z{SIGNS}]++")
#: Three or more single letters with marks between.
APART = re.compile(rf"(?<![a-z0-9])[a-z{DIGITS}](?:[{APARTS}]++[a-z{DIGITS}](?![a-z0-9])){{2,}}+")
#: Plain contractions, which would read as other words without their mark (he'll).
SHORT = re.compile(r"(?:i|you|he|she|it|we|they|who|that|there|what|how|where)'(?:ll|re|ve|[sdm])|[a-z]+n't")
RUN = re.compile(r"(.)\1{3,}", re.S)
MARK_RUN = re.compile(rf"([{APARTS}]{{2}})[{APARTS}]+")
#: Most signs that an entry's letter takes up in a token: itself three times, and two marks.
SPREAD = 5
REPEATED = re.compile(r"([a-z])\1+")
COMBINING = re.compile("[\u0300-\u036f]+")
#: Letters with accents, and the plain ones.
PLAIN = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()}
#: Signs without width, and letters that look like Latin ones (fixed values).
NO_WIDTH = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")
ALIKE = str.maketrans("\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u0501\u04bb\u03b1\u03bf\u03b9\u03c1\u03bd\u0131\u0261", "aeopcyxijsdhaoipvig")
LIKE = re.compile(f"[{''.join(map(chr, ALIKE))}]")
MIXED = re.compile(f"(?=[a-z]*[{''.join(map(chr, ALIKE))}])(?=[{''.join(map(chr, ALIKE))}]*[a-z])[a-z{''.join(map(chr, ALIKE))}]+")
ACCENTED = re.compile(f"[{''.join(PLAIN)}]")
FEATURES = ("top", "total", "hits", "restored")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def training_labels(labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """(doc_id, y), at most about `most` rows, picked by a hash."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = own.count()
    if n > most:
        own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return own


def composed(text: str) -> str:
    """The text in lower case, its letters composed and in the forms that words are looked up in."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", NO_WIDTH.sub("", text))
    text = text.lower()
    return text if text.isascii() or not LIKE.search(text) else MIXED.sub(lambda m: m[0].translate(ALIKE), text)


def folded(text: str) -> str:
    """The text without accents on Latin letters."""
    if text.isascii():
        return text
    return COMBINING.sub("", ACCENTED.sub(lambda m: PLAIN[m[0]], text))


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts; 0 is the edge of a word, 1 to 26 are a to z."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letter = np.zeros(256, np.int64)
        for i in range(26):
            letter[ord("a") + i] = letter[ord("A") + i] = i + 1
        sums = np.zeros(27**3, np.int64)
        for batch in batches:
            for t in batch["text"]:
                if t:
                    x = letter[np.frombuffer(f"  {folded(t)}  ".encode("utf-8", "surrogatepass"), np.uint8)]
                    sums += np.bincount(x[:-2] * 729 + x[1:-1] * 27 + x[2:], minlength=27**3)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"gram": at, "n": sums[at]})

    out = np.zeros(27**3)
    for gram, n in docs.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = n  # 19,683 rows at most
    return out


def model_of(counts: np.ndarray, lexicon: dict[str, float]) -> np.ndarray:
    """log P(c | a, b): the corpus and the lexicon in equal parts, each smoothed by its bigrams."""
    own = np.zeros(27**3)
    for word in lexicon:
        x = [0, 0, *[ord(c) - 96 if "a" <= c <= "z" else 0 for c in word], 0]
        for a, b, c in zip(x, x[1:], x[2:] if word[-1] != "*" else x[2:-2]):
            own[a * 729 + b * 27 + c] += 1

    def smooth(n: np.ndarray) -> np.ndarray:
        tri, bi = n.reshape(27, 27, 27), n.reshape(27, 27, 27).sum(0)
        low = (bi + 0.1) / (bi.sum(1, keepdims=True) + 2.7)
        return (tri + 2 * low[None]) / (tri.sum(2, keepdims=True) + 2)

    return np.log(0.5 * smooth(counts) + 0.5 * smooth(own))


@functools.cache
def letters(c: str) -> list[tuple[str, float]]:
    """What a sign can stand for, with its log odds."""
    return [(c, 0.0)] if "a" <= c <= "z" else [(x, -0.7 - 0.3 * k) for k, x in enumerate(LEET.get(c, ""))]


@functools.cache
def droppable(c: str) -> bool:
    """Whether a sign that is no mark can be nothing at all."""
    return c not in MARKS and (c in "!|+(" or not letters(c))


def decode(token: str, lm: np.ndarray, lexicon: dict[str, float] | None = None, prefixes: frozenset[str] = frozenset()) -> str:
    """The most likely words behind a disguised token. At each sign the lattice has the letters it can stand for, nothing
    or a boundary if it is a mark, and nothing if it repeats the letter before; a path's cost adds those steps to the
    model's. A state is the last two letters and how the word so far stands in the lexicon: a beginning of an entry, True
    behind a stem that counted, or None."""
    lexicon = lexicon or {}
    paths = {(0, 0, ""): (0.0, "")}
    for c in token.lower():
        step: dict[tuple, tuple[float, str]] = {}

        def offer(state: tuple, score: float, words: str) -> None:
            if state not in step or score > step[state][0]:
                step[state] = (score, words)

        options, mark, drop = letters(c), c in MARKS, droppable(c)
        for (a, b, node), (score, words) in paths.items():
            for x, cost in options:
                i, own, more = ord(x) - 96, node, 0.0
                if isinstance(node, str):
                    if f"{node}*" in lexicon:
                        own, more = True, LISTED * len(node)
                    else:
                        own = node + x if node + x in prefixes else None
                offer((b, i, own), score + cost + more + lm[a, b, i], words + x)
                if i == b:
                    offer((a, b, node), score - 1.2, words)
            if mark:
                offer((a, b, node), score - 0.5, words)
                if b:
                    offer((b, 0, ""), score + KEPT + lm[a, b, 0] + LISTED * (len(node) if node in lexicon else 0), f"{words} ")
            elif drop:
                offer((a, b, node), score - 2.5, words)
        paths = step
        if not paths:
            return ""
    return max((score + lm[a, b, 0] + LISTED * (len(node) if node in lexicon else 0), words) for (a, b, node), (score, words) in paths.items())[1].strip()


def spelled(token: str, start: int, lexicon: dict[str, float], prefixes: frozenset[str]) -> bool:
    """Whether any path from there spells an entry, to its end or beyond it."""
    live = {""}
    for c in token[start:]:
        options, stay, step = letters(c), c in MARKS or droppable(c), set()
        for p in live:
            for x, _ in options:
                q = p + x
                if q in prefixes:
                    if q in lexicon or f"{q}*" in lexicon:
                        return True
                    step.add(q)
                if p and p[-1] == x:
                    step.add(p)
            if stay:
                step.add(p)
        if not step:
            return False
        live = step
    return False


def marked(text: str) -> Iterator[int]:
    """Places in tokens that are spelled with signs or repeat a letter, in order for each kind."""
    for m in SIGN_RUN.finditer(text):
        a, b = m.span()
        before, after = a > 0 and "a" <= text[a - 1] <= "z", "a" <= text[b : b + 1] <= "z"
        if before and (after or text[a] in LAST) or after and text[b - 1] in LEET:
            yield a
    letters = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if ((letters[2:] == letters[1:-1]) & (letters[2:] == letters[:-2]) & (letters[2:] > 96)).any():
        yield from (m.start() for m in THRICE.finditer(text))


def disguised(text: str) -> set[str]:
    """Tokens of a lower-case text that may hide a word: spelled with signs, or letters set apart."""
    out, done = set(), 0
    for at in sorted(marked(text)):
        if at < done:
            continue
        i = at
        while i > done and TOKEN.match(text, i - 1, i):
            i -= 1
        done = TOKEN.match(text, i).end()
        out.add(text[i:done])
    out.update(m[0] for m in APART.finditer(text))
    return {t for t in out if not SHORT.fullmatch(t.strip(".,-_*~'`^/\\:;!("))}


def entries(word: str) -> list[str]:
    """What a word can be in the lexicon as: itself and its beginnings."""
    return [word, *[f"{word[:n]}*" for n in STEMS if n < len(word)]]


class Scorer:
    def __init__(self, lexicon: dict[str, float], lm: np.ndarray):
        self.lexicon, self.lm = lexicon, lm
        self.spelt: dict[str, float] = {}  # what the lattice spells
        for entry, weight in lexicon.items():
            self.spelt[folded(entry)] = max(weight, self.spelt.get(folded(entry), 0.0))
        self.prefixes = frozenset(e[:n] for w in self.spelt for e in [w.rstrip("*")] for n in range(1, len(e) + 1))
        self.window = SPREAD * max([1, *(len(w.rstrip("*")) for w in self.spelt)])
        self.heads = {e[:3] for e in lexicon}
        self.weight, self.spelt_weight = self.weigher(lexicon), self.weigher(self.spelt)
        self.tight = {REPEATED.sub(r"\1", e) for e in self.spelt}
        short = functools.lru_cache(maxsize=100_000)(self.decoded)
        self.restore = lambda token: short(token) if len(token) <= 2 * LONGEST else self.decoded(token)
        self.single = functools.lru_cache(maxsize=100_000)(self.untied)

    @staticmethod
    def weigher(lexicon: dict[str, float]):
        """The highest weight of an entry that a word is or begins with, 0 for none."""
        return functools.lru_cache(maxsize=200_000)(lambda word: max((lexicon.get(e, 0.0) for e in entries(word)), default=0.0))

    def decoded(self, token: str) -> frozenset[str]:
        """Words with a weight behind a token. Long tokens are read in a window from each place where an entry may start;
        with runs shortened, none takes up more than a window."""
        token = MARK_RUN.sub(r"\1", RUN.sub(r"\1\1\1", token))
        starts = (i for i, c in enumerate(token) if c not in MARKS and (not i or token[i - 1] in MARKS))
        hits = (i for i in starts if spelled(token[: i + self.window], i, self.spelt, self.prefixes))
        if len(token) <= self.window:
            windows = [token] if next(hits, None) is not None else []
        else:
            windows = (token[i : i + self.window] for i in hits)
        return frozenset(w for t in windows for w in decode(t, self.lm, self.spelt, self.prefixes).split() if self.spelt_weight(w))

    def untied(self, word: str) -> frozenset[str]:
        """Entries behind a plain word without accents that has repeated letters."""
        tight = REPEATED.sub(r"\1", word) if len(word) <= LONGEST else word
        if len(tight) == len(word) or tight not in self.tight and not any(f"{tight[:n]}*" in self.tight for n in range(1, STEMS[-1] + 1)):
            return frozenset()
        return self.decoded(word)

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Highest weight, sum of weights, number of hits and of those restored, by distinct word."""
        if not text or not self.lexicon:
            return 0.0, 0.0, 0.0, 0.0
        text = composed(text)
        words, heads = set(WORDS.findall(text)), self.heads
        hidden = {w for t in disguised(folded(text)) for w in self.restore(t)}
        own = list(words)
        joined = " ".join(own)
        flat = folded(joined)  # word for word
        # An entry has three letters at least: few words begin like one.
        found = {w: x for w in own if w[:3] in heads and (x := self.weight(w))}
        done, plain = set(found), own
        if flat != joined:
            plain = flat.split(" ")
            accented = {p for w, p in zip(own, plain) if p != w and p[:3] in heads and w not in found and self.weight(p)}
            hidden |= accented
            done |= accented | {folded(w) for w in found}
        signs = np.frombuffer(flat.encode("utf-8", "surrogatepass"), np.uint8)
        twice = np.flatnonzero((signs[1:] == signs[:-1]) & (signs[1:] > 96) & (signs[1:] < 123))
        for k in np.unique(np.cumsum(signs == 32)[twice]).tolist():  # words with a letter twice in a row
            if plain[k] not in done:
                hidden |= self.single(plain[k])
        found = list(found.values())
        more = [self.spelt_weight(w) for w in hidden - words]
        weights = sorted([*found, *more], reverse=True)
        return (weights[0] if weights else 0.0), sum(weights[:8]), float(len(weights)), float(len(more))


def lexicon_of(texts: DataFrame) -> dict[str, float]:
    """Entry: weight, from training texts (text, y)."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = set()
            for t in batch["text"]:
                words = WORDS.findall(composed(t)) if t else []
                seen.update((w, b) for w, b in zip(words, ["", *words]) if 3 <= len(w) <= LONGEST)
            yield pd.DataFrame(sorted(seen), columns=["word", "before"]).astype(object)

    toxic = texts.filter("y = 1").select("text").mapInPandas(pairs, "word string, before string").distinct()
    stems = F.expr(f"transform(filter(sequence({STEMS[0]}, {STEMS[-1]}), n -> n < length(word)), n -> concat(left(word, n), '*'))")
    contexts = toxic.groupBy("word").agg(F.count("*").alias("n")).select(F.explode(F.concat(F.array("word"), stems)).alias("word"), "n")
    found = contexts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)

    def ordinary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counter()
        for batch in batches:
            for t in batch["text"]:
                words = set(WORDS.findall(composed(t))) if t else ()
                counts.update({e for w in words if len(w) <= LONGEST for e in entries(w)})
                if len(counts) > FLUSH:
                    yield pd.DataFrame([*counts.items()], columns=["word", "b"])
                    counts.clear()
        yield pd.DataFrame([*counts.items()], columns=["word", "b"]).astype({"word": object, "b": "int64"})

    sizes = dict(texts.groupBy("y").count().collect())
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return {}
    other = texts.filter("y = 0").select("text").mapInPandas(ordinary, "word string, b long").groupBy("word").agg(F.sum("b").alias("b"))
    a, b = F.col("n") + 0.5, F.coalesce("b", F.lit(0)) + 0.5
    # Lower bound of the log odds: few contexts, or few other texts to tell from, count less.
    weight = F.log(a / (n_toxic + 1)) - F.log(b / (n_other + 1)) - SURE * F.sqrt(1 / a + 1 / b)
    rows = found.join(other, "word", "left").select("word", F.round(weight, 6).alias("weight"), (weight > WEIGHT).alias("kept")).filter("kept")
    return dict(sorted(((r.word, r.weight) for r in rows.collect()), key=lambda p: (-p[1], p[0])))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic model, intercept first, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w += move
        if np.abs(move).max() < 1e-9:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, top, total, hits, restored) for each row of docs."""
    docs = docs.select("doc_id", "text")
    train = F.broadcast(staged(training_labels(labels, "toxic", folds, fold, most_rows), "toxic-train"))
    texts = staged(docs.join(train, "doc_id").select("doc_id", "text", "y"), "toxic-texts")
    lexicon = lexicon_of(texts)
    lm = model_of(trigrams(docs), {folded(e): 0.0 for e in lexicon})

    @F.pandas_udf(", ".join(f"{f} double" for f in FEATURES))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon, lm)
        for batch in batches:
            yield pd.DataFrame([scorer.features(t if isinstance(t, str) else None) for t in batch], columns=FEATURES)

    rows = texts.select("y", features("text").alias("f")).select("y", "f.*").toPandas()  # most_rows of a few numbers
    x, y = rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy(float)
    w = logistic(x, y) if len(set(y)) == 2 else np.zeros(1 + len(FEATURES))
    line = sum((F.col(f"f.{c}") * float(k) for c, k in zip(FEATURES, w[1:])), F.lit(float(w[0])))
    knots = isotonic(np.c_[np.ones(len(x)), x] @ w, y) if len(set(y)) == 2 else ([], [])
    scored = docs.select("doc_id", features("text").alias("f")).withColumn("line", line)
    # The calibrated rate, with a little of the line itself so that equal rates keep their order.
    score = 0.99 * interpolated(F.col("line"), *knots) + 0.01 / (1 + F.exp(-F.col("line")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        "f.*",
    )
