"""Operators on vectors and phrases against brute force: nulls, non-finite and zero vectors, ties, repeated rows, hot groups."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codexspark.llm import collocations, embedding_dedup, queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, codes binary, n long, component long"


def rows_of(vectors, labels, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return [(i, None if v is None else [None if x is None else float(x) for x in v], k, "r", b"c", 1, 2) for i, v, k in zip(ids, vectors, labels)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    out = list(rng.standard_normal((500, 16)))
    out += [centre + rng.standard_normal(16) * s for s in rng.uniform(0, 0.25, 120)]
    out += [centre] * 15 + [3 * centre] * 3 + [-centre, np.zeros(16), None, [], [*centre[:15], None], [*centre[:15], math.nan], [*centre[:15], math.inf], centre[:8], centre[:8] * 2]
    labels = [i % 3 for i in range(500)] + [7] * (len(out) - 500)
    out += [centre] * 3
    labels += [None, None, 8]
    return rows_of(out, labels, [3 * i + 1 for i in range(len(out))])


def plain_links(rows):
    """(vec_id, n_links, component_id, kept)"""
    good = [r[1] is not None and len(r[1]) > 0 and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1]) and r[2] is not None and r[0] is not None for r in rows]
    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if g else None for r, g in zip(rows, good)]
    near = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = None if r[0] is None else min(rows[j][0] for j in seen)
        out.append((r[0], len(near[i]), least, r[0] is None or r[0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("fill, chunk", [(512, 1024), (16, 1024), (64, 20)])
def test_links_match_brute_force(spark, vectors, monkeypatch, fill, chunk):
    monkeypatch.setattr(embedding_dedup, "FILL", fill)  # many tables
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)  # buckets dealt over a grid
    rows = [*vectors, (None, vectors[500][1], 7, "r", b"c", 1, 2)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_links(rows)


def test_chains_and_repeated_ids(spark):
    turn = [[math.cos(t), math.sin(t)] for t in np.arange(0, 3, 0.15)]
    rows = rows_of([*turn, turn[0], [5.0, 0.0], [0.0, -1.0]], [1] * (len(turn) + 3), [*range(10, 10 + len(turn)), 10, 4, 10])
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == plain_links(rows)
    assert {r[2] for r in got} == {4, 10}  # the chain holds together, the last row is alone


def test_tables_follow_the_number_of_vectors():
    assert embedding_dedup.tables_of(0) == embedding_dedup.tables_of(512) == (0, 1)  # one bucket: nothing can be missed
    for n in (10**4, 10**7, 10**10):
        bits, tables = embedding_dedup.tables_of(n)
        assert 256 < n / 2**bits <= 512 and (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables <= 1e-6


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10**6))
def test_limits_hold_for_every_linked_pair(size, seed):
    rng = np.random.default_rng(seed)
    x = embedding_dedup.unit(rng.standard_normal((30, size)))
    off = rng.standard_normal((30, size))
    off -= (off * x).sum(1, keepdims=True) * x
    norm = np.linalg.norm(off, axis=1, keepdims=True)
    y = x if size == 1 else x * 0.98 + off / norm * math.sqrt(1 - 0.98**2)
    turned = x @ embedding_dedup.rotation(size, 0).T
    vertex = np.where(turned > 0, 1, -1) / math.sqrt(size)
    factor = np.abs(turned).sum(1) / math.sqrt(size)
    inner = (vertex * (y @ embedding_dedup.rotation(size, 0).T)).sum(1)
    assert (inner >= embedding_dedup.limits(factor, size) - 1e-9).all()


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x, y = embedding_dedup.unit(rng.standard_normal((2, 64)))
    errors = []
    for number in range(400):
        turned, other = (embedding_dedup.rotation(64, number) @ v for v in (x, y))
        factor = np.abs(turned).sum() / 8
        errors.append(((np.where(turned > 0, 1, -1) / 8) @ other / factor - x @ y) / math.sqrt((1 - factor**2) / (factor**2 * 63)))
    assert abs(np.mean(errors)) < 0.15 and np.std(errors) < 1.2 and np.abs(errors).max() < 6


# 12
def plain_codes(rows):
    kept = sorted((r for r in rows if r[1] is not None and None not in r[1] and all(map(math.isfinite, r[1]))), key=lambda r: (r[0] is None, r[0] or 0, [np.float32(x) for x in r[1]]))
    length = -(-max(len(r[1]) for r in kept) // 4) * 4
    most = vector_codes.limit(length)
    whole = [[max(-most, min(most, math.floor(1024 * float(np.float32(x))))) for x in r[1]] + [0] * (length - len(r[1])) for r in kept]
    w = length // 4
    books = [[v[p * w : p * w + w] for v in whole[:256]] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for step in range(5):
        codes = [[nearest(v[p * w : p * w + w], books[p]) for p in range(4)] for v in whole]
        if step < 4:
            for p in range(4):
                parts = defaultdict(list)
                for v, c in zip(whole, codes):
                    parts[c[p][1]].append(v[p * w : p * w + w])
                for e, own in parts.items():
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    return [(r[0], r[2], bytes(i for _, i in c).hex(), sum(d for d, _ in c)) for r, c in zip(kept, codes)], ",".join(str(x) for b in books for e in b for x in e)


@pytest.mark.parametrize("many", [40, 420])
def test_codes_match_a_full_scan(spark, vectors, many):
    rows = [r for r in vectors if r[1] is None or len(r[1]) != 8][-many:] + [(None, vectors[3][1], 1, "r", b"", 0, 0), vectors[7], vectors[7]]
    want, entries = plain_codes(rows)
    got, books = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3))
    key = lambda x: repr(x)
    assert sorted(((r["vec_id"], r["label"], bytes(r["codes"]).hex(), r["error"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert vector_codes.printed(books) == hashlib.sha256(entries.encode()).hexdigest()
    errors = defaultdict(int)
    for _, label, _, error in want:
        errors[label] += error
    assert {(r["label"], r["label_error"]) for r in vector_codes.with_label_errors(got).collect()} == set(errors.items())


def test_codes_of_large_uneven_and_few_vectors(spark):
    rows = rows_of([[3e38, -3e38, 1.5, 0.0, 7.25], [1.0, 2.0], [], [-2e5, 1e5, 3.0, 4.0, 5.0]], [1, None, 1, 1], [5, 4, 9, None])
    want, entries = plain_codes(rows)
    got, books = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r["vec_id"], r["label"], bytes(r["codes"]).hex(), r["error"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert vector_codes.printed(books) == hashlib.sha256(entries.encode()).hexdigest()
    back = vector_codes.decompressed(got, books).filter("vec_id = 4").first()["restored"]
    assert back[:2] == [1.0, 2.0] and len(back) == 8


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(1, 5), st.integers(0, 10**6), st.sampled_from([3, 40, 2000, 1 << 28]))
def test_exponion_search_equals_a_full_scan(entries, width, seed, spread):
    rng = np.random.default_rng(seed)
    book = rng.integers(-spread, spread, (entries, width))
    x, start = rng.integers(-spread, spread, (200, width)), rng.integers(0, entries, 200)
    best, near = vector_codes.Codebook(book).nearest(x, start)
    d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (near == d.min(1)).all()


def test_exponion_search_looks_at_few_entries(monkeypatch):
    rng = np.random.default_rng(1)
    book = rng.integers(-1000, 1000, (256, 2))
    x = rng.integers(-1000, 1000, (3000, 2))
    full = vector_codes.Codebook(book)
    best, _ = full.nearest(x, np.zeros(3000, np.int64))
    seen, real = [], vector_codes.squared
    monkeypatch.setattr(vector_codes, "squared", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    assert (full.nearest(x, best)[0] == best).all()
    assert sum(seen) < 0.3 * 3000 * 256


# 13
def plain_phrases(rows, least, longest, top):
    found, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = lang if lang is not None else "und", (text or "").translate({i: i + 32 for i in range(65, 91)})
        for end in ".,;:!?\x0a\x0b\x0c\x0d":
            text = text.replace(end, "\0.\0")
        for piece in text.split("\0.\0"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                found[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in found.items():
        inside = {g: n for g, n in f.items() if n >= least}
        ranked = []
        for p, a in inside.items():
            longer = [g for g, n in inside.items() if len(g) > len(p) and n >= a and any(g[i : i + len(p)] == p for i in range(len(g) - len(p) + 1))]
            if len(p) > 1 and not longer:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


TEXTS = [None, "", " \t\n", "one", "A b c. a B c! a b c d e f; a b c d e f", "a b\ta b,a b a b a b", "É é x é x é X", "word " * 400, "a b c d e f\n" * 30, "x.y.z " * 50, "\x1c q \x1c q r\x85 s"]


@pytest.mark.parametrize("block", [1 << 20, 40, 3])
def test_phrases_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    rng = random.Random(2)
    rows = [(lang, t) for t in TEXTS for lang in ("en", None, "und", "")]
    rows += [(rng.choice(["en", "de"]), " ".join(rng.choice(["the", "of", "new", "york", "Times", "a.", "b,"]) for _ in range(rng.randint(0, 90)))) for _ in range(60)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, text string, phrases string, block long, n long").repartition(3)
    for least, longest, top in ((4, 5, 2000), (10, 3, 7)):
        got = collocations.collocations(docs, least, longest, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, longest, top)


def test_scores_pass_64_bits(spark):
    row = spark.createDataFrame([(10**13, 9 * 10**13, 10**12, 3 * 10**12)], "a long, n long, l long, r long")
    big = row.select(collocations.score(row["a"], row["n"], row["l"], row["r"]).alias("s")).first()["s"]
    assert big == 1000 * 10**13 * 9 * 10**13 // (10**12 * 3 * 10**12)


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_vector_codes"])
def test_sql_gives_the_same(spark, vectors, tmp_path, name):
    path = str(tmp_path)
    kept = [r for r in vectors if r[1] is None or len(r[1]) == 16]
    spark.createDataFrame(kept, SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, path)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
