"""The ten operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty
tables and clashing extra columns."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexspark.llm import fingerprints, mixing, near_dedup, pieces, pii, quality_classifier, quality_rules, repeats, token_counts, toxicity
from codexspark.llm.queries import tokenizer_file

PIECES, RANKS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rules string, kept boolean, rep long, key string"


def words(rng, n):
    return " ".join("".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = words(rng, 120)
    passage = words(rng, 70)
    texts = [None, "", " \n\t ", "one", "one two three", base, base, base + " tail", base.upper(), passage + " " + words(rng, 40)]
    texts += [words(rng, 60) + " " + passage + " " + words(rng, 30), "spam spam " * 300, words(rng, 30_000), "é漢🙂 " * 40, "x" * 5000]
    edited = base.split()
    for k in range(12):
        edited = [*edited]
        edited[rng.randrange(len(edited))] = f"w{k}"
        texts.append(" ".join(edited))
    texts += [words(rng, rng.randint(5, 200)) for _ in range(25)]
    out = [(i * 3 + 1, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "r", True, 5, "k") for i, t in enumerate(texts)]
    return [*out, out[5], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def result(df):
    return [r.asDict() for r in df.collect()]


# 1
def plain_removed(rows):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, b in texts:
        if i is not None:
            for k in range(len(b) - 49):
                w = b[k : k + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    gone[k : k + 50] = True
        left = bytes(c for c, g in zip(b, gone) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


TIGHT = repeats.Limits(unit=20_000, held=60, flags=500, sent=300, hot=2, texts=7)


@pytest.mark.parametrize("limits", [repeats.Limits(), repeats.Limits(unit=30_000), TIGHT])
def test_repeats_match_brute_force(docs, rows, limits):
    got = sorted(map(tuple, repeats.removed(docs, limits=limits).collect()), key=str)
    assert got == plain_removed(rows)


def test_hot_passages_match_brute_force(spark):
    """Two passages in most texts, between words of their own, so their rims have a different context in each."""
    rng = random.Random(5)
    parts = [words(rng, 14), words(rng, 30)]
    texts = [f"{words(rng, rng.randint(0, 12))} {rng.choice(parts)} {words(rng, rng.randint(0, 12))} {rng.choice(parts)}{'!' * rng.randint(0, 60)}" for _ in range(400)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, repeats.removed(docs, limits=TIGHT).collect()), key=str)
    assert got == plain_removed(rows)


def test_what_is_left_is_given_as_bytes(docs, rows):
    for r in repeats.removed(docs, with_text=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_repeats_of_nothing(none):
    assert repeats.removed(none).collect() == []


def plain_maximal(texts, least):
    found = {}
    for t, x in enumerate(texts):
        for i in range(len(x)):
            for j in range(i + least, len(x) + 1):
                found.setdefault(x[i:j], []).append((t, i))
    out = set()
    for s, at in found.items():
        before = {texts[t][i - 1] if i else (t, i) for t, i in at}
        after = {texts[t][i + len(s)] if i + len(s) < len(texts[t]) else (t, i) for t, i in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            out.add((len(s), tuple(sorted(at))))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=22), st.text("ab", max_size=22)).filter(lambda p: len(p[0] + p[1]) >= 22), min_size=1, max_size=6, unique=True))
def test_maximal_repeats_are_all_found(sides):
    gram = b"0123456789" * 2 + b"01234567"
    pad = np.zeros((len(sides), 44), np.uint8)
    for i, (x, y) in enumerate(sides):
        pad[i, 22 - len(x) : 22], pad[i, 22 : 22 + len(y)] = list(x.encode()), list(y.encode())
    left, right = (np.array([len(p[k]) for p in sides], np.uint8) for k in (0, 1))
    at = np.arange(len(sides))
    c = repeats.Contexts(np.full(len(sides), 7, np.uint64), at.astype(np.uint64), at, at + 100, left, right, pad)
    got = set()
    for group, size, context, start in repeats.maximal_repeats(c):
        for g in set(group.tolist()):
            of = group == g
            begin = start[of] - (22 - left[context[of]].astype(int))
            if len(set(c.side[i, s - 1] if s > 22 - left[i] else -1 - i for i, s in zip(context[of].tolist(), start[of].tolist()))) > 1:
                got.add((int(size[of][0]), tuple(sorted(zip(context[of].tolist(), begin.tolist())))))
    assert got == plain_maximal([x.encode() + gram + y.encode() for x, y in sides], 50)


# 2
def test_pieces_equal_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    m = pieces.model(PIECES)
    rng = random.Random(2)
    texts = ["", "   ", " hello  world\n\tfoo é 漢字 ", "a" * 4000, "\n\n x", "🙂🙂"] + ["".join(rng.choice(" aehtno\n") for _ in range(80)) for _ in range(500)]
    for text, ids in zip(texts, m.encode(texts)):
        assert ids.tolist() == lib.encode(text)
        assert m.decode(ids) == text


def test_of_the_candidates_at_a_place_one_has_a_finite_sum():
    m = pieces.model(PIECES)
    rng = random.Random(9)
    rows = ["▁" + "".join(rng.choice("abdehilnorst.,") for _ in range(11)) for _ in range(300)]
    codes = np.array([[ord(c) for c in w] for w in rows], np.uint32)
    last, sizes = m.viterbi(codes)
    by_text = {p: i for i, p in m.text.items() if m.usable[i]}
    for w, text in enumerate(rows):
        for end in range(1, 13):
            ends = [(by_text[text[a:end]], a) for a in range(end) if text[a:end] in by_text]
            sums = [m.pair_gain(last[w, a : a + 1].astype(int), np.array([i]))[0] if a else 0.0 for i, a in ends]
            assert [i for (i, _), x in zip(ends, sums) if x == 0] == [last[w, end]]


def test_unigram_viterbi_is_the_best_path():
    rng = random.Random(4)
    vocabulary = {p: -rng.uniform(1, 9) for p in {"▁", *"abc", *("".join(rng.choice("▁abc") for _ in range(rng.randint(2, 4))) for _ in range(40))}}
    m = pieces.Model.of(vocabulary)
    for _ in range(200):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 9)))
        best = {0: 0.0}
        whole = "▁" + text.replace(" ", "▁")
        for j in range(1, len(whole) + 1):
            best[j] = max(best[i] + vocabulary[whole[i:j]] for i in range(max(0, j - 4), j) if whole[i:j] in vocabulary)
        ids = m.encode([text])[0].tolist()
        assert abs(sum(m.score[i] for i in ids) - best[len(whole)]) < 1e-9
        assert "".join(m.text[i] for i in ids) == whole


def test_pieces_edges(docs, none):
    got = result(pieces.encoded(docs, PIECES))
    assert all(r["round_trip"] in (True, None) and (r["ids"] is None) == (r["round_trip"] is None) for r in got)
    assert pieces.encoded(none, PIECES).collect() == []


# 3
def test_mix_reaches_targets(spark):
    rng = random.Random(5)
    data = [(i, words(rng, rng.randint(1, 20)), rng.choice(["b", "a", "c", "c", "c", "é", None])) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = result(mixing.mix_sources(df))
    budget, sizes = 1.5 * sum(len(t.split()) for _, t, _ in data), {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left, total = budget - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r["size"] == len(data[r["doc_id"]][1].split()) and 0 <= r["copies"] <= 2
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in order) and sum(taken.values()) <= budget
    assert sorted(map(str, got)) == sorted(map(str, result(mixing.mix_sources(df.repartition(7)))))
    copies = {r["doc_id"]: r["copies"] for r in got}
    again = [r["doc_id"] for r in result(mixing.mixed(df))]
    assert all(again.count(i) == n for i, n in copies.items())


def test_mix_edges(docs, none):
    assert len(result(mixing.mix_sources(docs))) == docs.count()
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_sources(none).collect() == [] and mixing.mixed(none).collect() == []


# 4
@settings(max_examples=150, deadline=None)
@given(st.text("ab '\n\tsre1.é漢", max_size=400), st.lists(st.tuples(st.integers(-3, 420), st.integers(-3, 420), st.text(" a'st\n2", max_size=30)), max_size=5))
def test_edited_counts_equal_a_recount(text, edits):
    c = token_counts.counter(RANKS)
    tree = token_counts.Tree(c, text)
    for a, b, new in edits:
        tree.edit(a, b, new)
        a = min(max(a, 0), len(text))
        b = min(max(b, a), len(text))
        text = text[:a] + new + text[b:]
        assert tree.text() == text
        assert int(tree.tokens[1]) == len(c.encoding.encode_ordinary(text))
        assert [p for block in tree.pieces for p in block] == c.split(text)


def test_edits_touch_little(spark):
    text = words(random.Random(3), 20_000)
    tree = token_counts.Tree(token_counts.counter(RANKS), text)
    tree.edit(50_000, 50_003, "zz")
    assert tree.reencoded < 10


def test_stored_trees_take_edits(spark, docs, none):
    c = token_counts.counter(RANKS)
    some = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    edits = spark.createDataFrame([(16, 1, 3, 9, "new words"), (16, 0, 0, 0, "start "), (4, 0, 5, 1, None)], "doc_id long, ord int, start long, stop long, new string")
    before = {r["doc_id"]: r for r in result(token_counts.trees(some, RANKS))}
    after = {r["doc_id"]: r["n_tokens"] for r in result(token_counts.updated(token_counts.trees(some, RANKS), edits, RANKS))}
    texts = {r["doc_id"]: r["text"] or "" for r in result(some)}
    assert all(before[i]["n_tokens"] == len(c.encoding.encode_ordinary(t)) for i, t in texts.items())
    t = "start " + texts[16]
    texts[16] = t[:3] + "new words" + t[9:]
    assert after == {i: len(c.encoding.encode_ordinary(t)) for i, t in texts.items()}
    assert token_counts.trees(none, RANKS).collect() == []


# 5
def plain_components(rows):
    def shingles(t):
        w = [x for x in ((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).encode().split()]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    nodes = [(i, shingles(t)) for i, t, *_ in rows]
    up = {i: i for i, _ in nodes}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, s) in enumerate(nodes):
        for j, t in nodes[:x]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return sorted(((i, len(s), None if i is None else root(i), True if i is None else root(i) == i) for i, s in nodes), key=str)


@pytest.mark.parametrize("chunk", [2048, 3])
def test_near_duplicates_match_brute_force(docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=str) == plain_components(rows)


@pytest.mark.parametrize("share", [50, 80])
def test_texts_with_common_boilerplate_match_brute_force(spark, monkeypatch, share):
    """Most texts share words but are not alike; a few are. Their buckets are far larger than a chunk."""
    monkeypatch.setattr(near_dedup, "CHUNK", 12)
    rng = random.Random(share)
    common = words(rng, share)
    texts = [f"{common} {words(rng, 100 - share)}" for _ in range(150)]
    for i in range(0, 60, 3):
        w = texts[i].split()
        w[rng.randrange(100)] = "edited"
        texts.append(" ".join(w))
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)


def test_near_duplicate_chains(spark):
    rng = random.Random(8)
    chain, rows = [f"w{i}" for i in range(100)], []
    for k in range(40):  # each is near the one before, the ends are far apart
        rows.append((500 - k, " ".join(chain)))
        chain = chain[4:] + [f"n{k}{j}" for j in range(4)]
    rng.shuffle(rows)
    got = sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain_components(rows)


def test_near_duplicates_of_nothing(none):
    assert near_dedup.near_duplicates(none).collect() == [] and near_dedup.deduplicated(none).collect() == []


# 6 and 7
def labelled(spark):
    rng, data, labels = random.Random(6), [], []
    bad = ["grumbald", "snorfling", "vexatrix"]
    for i in range(400):
        text, low, rude = words(rng, 80), i % 4 == 0, i % 5 == 0
        text = ("rep rep " * 60 + text) if low else text
        data.append((i, text + (" " + rng.choice(bad) + " " + words(rng, 5) if rude else "")))
        labels.append((i, int(not low), int(rude)))
    data += [(1000, words(rng, 60) + " grumb@ld vex@tr1x"), (1001, words(rng, 60) + " s.n.o.r.f.l.i.n.g"), (1002, words(rng, 60) + " v e x a t r i x"), (1003, words(rng, 60) + " vexxxatrix"), (1004, None), (1005, "")]
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier_holds_out(spark, none):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in result(quality_classifier.quality(docs, labels))}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    out = [(r["predicted"], int(i % 4 != 0)) for i, r in got.items() if r["held_out"] and i < 400]
    assert len(out) > 50 and sum(p == y for p, y in out) / len(out) > 0.95
    assert quality_classifier.quality(none, labels).collect() == []
    assert all(r["score"] == 0.5 for r in result(quality_classifier.quality(docs, labels.filter("doc_id < 0"))))


def test_toxicity_holds_out_and_restores(spark, none):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in result(toxicity.toxicity(docs, labels))}
    out = [(r["predicted"], int(i % 5 == 0)) for i, r in got.items() if r["held_out"] and i < 400]
    assert len(out) > 40 and sum(p == y for p, y in out) / len(out) > 0.95
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003)] == [1, 1, 1, 1]
    assert got[1004]["predicted"] == got[1005]["predicted"] == 0
    assert toxicity.toxicity(none, labels).collect() == []


def test_decoding_restores_words():
    lexicon = {"moron": 5.0, "idiot": 5.0, "stupid": 5.0, "trash": 5.0}
    lm = toxicity.model_of(np.zeros(27**3), lexicon)
    for token, word in (("m0r0n", "moron"), ("1d10t", "idiot"), ("s t u p i d", "stupid"), ("tr@@@sh", "trash"), ("m.o.r.o.n", "moron"), ("moooroon", "moron"), ("$tup!d", "stupid")):
        assert toxicity.decode(token, lm) == word


def all_paths(token, lm, lexicon, prefixes):
    """(score, words) of every path of a token's lattice, none left out for another."""
    ends = []

    def walk(i, a, b, node, score, words):
        listed = toxicity.LISTED * (len(node) if node in lexicon else 0) if isinstance(node, str) else 0
        if i == len(token):
            ends.append((score + lm[a, b, 0] + listed, words.strip()))
            return
        c = token[i]
        for x, cost in toxicity.letters(c):
            k, own, more = ord(x) - 96, node, 0.0
            if isinstance(node, str):
                own, more = (True, toxicity.LISTED * len(node)) if f"{node}*" in lexicon else (node + x if node + x in prefixes else None, 0.0)
            walk(i + 1, b, k, own, score + cost + more + lm[a, b, k], words + x)
            if k == b:
                walk(i + 1, a, b, node, score - 1.2, words)
        if c in toxicity.MARKS:
            walk(i + 1, a, b, node, score - 0.5, words)
            if b:
                walk(i + 1, b, 0, "", score + toxicity.KEPT + lm[a, b, 0] + listed, f"{words} ")
        elif toxicity.droppable(c):
            walk(i + 1, a, b, node, score - 2.5, words)

    walk(0, 0, 0, "", 0.0, "")
    return ends


@settings(max_examples=300, deadline=None)
@given(st.text("abi1!@. -o0", min_size=1, max_size=7), st.integers(0, 50))
def test_decoding_takes_the_best_of_all_paths(token, seed):
    lexicon = {"abi": 3.0, "bab": 2.0, "ba*": 2.0, "oi": 1.0}
    prefixes = frozenset(e.rstrip("*")[:n] for e in lexicon for n in range(1, len(e) + 1))
    lm = toxicity.model_of(np.random.default_rng(seed).integers(0, 30, 27**3).astype(float), lexicon)
    ends = all_paths(token, lm, lexicon, prefixes)
    got = toxicity.decode(token, lm, lexicon, prefixes)
    assert (not ends and got == "") or max(s for s, w in ends if w == got) >= max(s for s, _ in ends) - 1e-9


def test_accents_tell_words_apart():
    lexicon = {"r\u00e9eux*": 4.0, "stupid": 5.0}
    scorer = toxicity.Scorer(lexicon, toxicity.model_of(np.zeros(27**3), {toxicity.folded(e): 0.0 for e in lexicon}))
    assert scorer.features("R\u00c9EUXPA")[0] == scorer.features("re\u0301euxpa")[0] == 4.0
    assert scorer.features("reeuxpa reeux")[2] == 0
    assert scorer.features("st\u00fcpid")[3] == 1


def test_every_disguise_reaches_the_lattice():
    lexicon = {"moron": 5.0, "idiot": 5.0, "stupid": 5.0, "dumb": 5.0, "ugh": 5.0}
    plain = "he is a man and so are you but this is not an offer of the day it was at the end " * 50
    letter = np.zeros(256, np.int64)
    letter[97:123] = range(1, 27)
    x = letter[np.frombuffer(plain.encode(), np.uint8)]
    scorer = toxicity.Scorer(lexicon, toxicity.model_of(np.bincount(x[:-2] * 729 + x[1:-1] * 27 + x[2:], minlength=27**3).astype(float), lexicon))
    for text, n in (
        ("is a s t u p i d man", 1), ("y o u i d i o t", 1), ("s t u p i d m o r o n", 2), ("d u m b.", 1), ("u g h", 1), ("st/upid", 1), ("s,t,u,p,i,d", 1),
        ("stuupid", 1), ("st\u00fap!d", 1), ("stu\u0301p!d", 1), ("x" * 60 + "/" + "st*pid.".replace("*", "@").replace("@", "u*"), 1), ("nice-day," * 12 + "m0ron," + "good-day," * 12, 1),
        ("s    t  .. u\n\np \t i    d", 1), ("st\u200bup\u00adid", 0), ("\uff53\uff54\uff55\uff50\uff49\uff44", 0), ("\u0455tup\u0456d", 0), ("m._-~.0._-~.r._-~.0._-~.n", 1),
        ("nice-day," * 30 + "s--..--t--..--u--..--p--..--!--..--d", 1), ("m" * 9 + "..o" * 3 + "r" * 9 + "0" * 9 + "n" * 9, 1), ("\u0441\u0442\u0443\u043f\u0438\u0434", 0),
        ("he'll offer 1, 2, 3 and 4. and/or the end", 0), ("s" * 5000, 0), ("a-" * 5000, 0), ("0" * 200_000, 0), ("a" + "-" * 200_000, 0),
    ):
        assert scorer.features(text)[3] == n, text[:60]
    assert scorer.features("st\u00fapid")[2] == 1
    for text in ("st\u200bup\u00adid", "\uff53\uff54\uff55\uff50\uff49\uff44", "\u0455tup\u0456d"):  # put right before any lattice
        assert scorer.features(text)[0] == 5.0


def test_rare_toxic_words_stay_in_the_lexicon(spark):
    rng, common = random.Random(8), [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    texts = [(" ".join(rng.choice(common) for _ in range(10)), 0) for _ in range(2000)]
    rare = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6000)]
    texts += [(" ".join(f"{rng.choice(common)} {w}" for w in rare[k::20] for _ in range(6)), 1) for k in range(20)]
    lexicon = toxicity.lexicon_of(spark.createDataFrame(texts, "text string, y int").repartition(4))
    assert all(w in lexicon for w in rare)


# 8
def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints_of_edits(docs, rows):
    from codexspark.llm.fingerprints import printed, resemblance

    got = fingerprints.tail_edits(docs).withColumns({"p": printed(F.col("print")), "near": resemblance(F.col("print"), F.col("edited_print"))})
    got = sorted(((r["doc_id"], r["text"], r["edited"], r["n_chars"], r["near"], r["p"]) for r in result(got) if r["doc_id"] is not None))
    own = sorted((i, t or "") for i, t, *_ in rows if i is not None)
    prints = {}
    for k, (i, text, edited, n, near, print_) in enumerate(got):
        after = own[(k + 1) % len(own)][1]
        cut = len(text) // 4
        assert (i, text) == own[k] and n == len(text) and edited == text[: len(text) - cut] + after[:cut]
        a, b = shingles(text), shingles(edited)
        assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
        assert prints.setdefault(text, print_) == print_
    assert fingerprints.tail_edits(docs.filter("false")).collect() == []


def test_sketches_merge(spark):
    rng = random.Random(9)
    parts = [(k % 2, words(rng, 400)) for k in range(6)]
    df = spark.createDataFrame(parts, "g int, text string").select("g", fingerprints.sketch(F.col("text")).alias("s"))
    own = {r["g"]: r["s"] for r in result(fingerprints.merge_by(df, ["g"], "s"))}
    each = {g: sorted({h for r in result(df) if r["g"] == g for h in r["s"]})[: fingerprints.K] for g in (0, 1)}
    assert own == each


# 9
def plain_rules(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines, seen, same = (t or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            same += x in seen
            seen.add(x)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    marked = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)} if len(grams) < 3000 else set()
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), same, len(marked)


def test_quality_rules_match_brute_force(docs, rows, none):
    got = result(quality_rules.quality_rules(docs.drop("rules"), bands=quality_rules.fitted_bands(docs)).select("doc_id", "text", "rules.*"))
    for r in got:
        n, chars, symbols, same, again = plain_rules(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, same, again)
        assert r["base_failed"] == (n < 20 or 100 * again > 30 * n) and not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in result(quality_rules.filter_quality(docs))}
    assert 16 in kept and rows[11][0] not in kept and rows[14][0] not in kept
    assert quality_rules.filter_quality(docs).columns == docs.columns
    assert quality_rules.filter_quality(none).collect() == []


def test_bands_come_from_the_table(spark, docs, none):
    import zstandard

    rng = random.Random(6)
    texts = [words(rng, rng.randint(60, 500)) for _ in range(400)]
    junk = [" ".join(rng.choice(texts[0].split()[:12]) for _ in range(300)) for _ in range(10)]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts + junk)] + [(None, None, "x"), (1, "", "x")], "doc_id long, text string, rules string").repartition(3)
    bands = quality_rules.fitted_bands(table)
    zstd = zstandard.ZstdCompressor(level=3, write_content_size=False)
    ratios = {}
    for t in texts + junk:
        n = len(t.encode())
        c = next(c for c in range(60) if n <= 2 ** ((c + 1) / 2))
        ratios.setdefault(c, []).append((n, len(zstd.compress(t.encode())) / n))
    for c, found in ratios.items():
        middle, upper = np.quantile([r for _, r in found], [0.5, 0.75], method="inverted_cdf")
        low, high = quality_rules.Bands().of(2 ** ((c + 1) / 2))
        share = len(found) / (len(found) + quality_rules.PRIOR)
        want = share * (middle - max(4 * (upper - middle), 0.06 * middle)) + (1 - share) * low, share * (middle + max(6 * (upper - middle), 0.25 * middle)) + (1 - share) * high
        assert all(bands.of(n) == pytest.approx(want) for n, _ in found)
    kept = {r.text for r in quality_rules.filter_quality(table).collect()}
    assert not kept & set(junk) and len(kept) >= 395
    assert quality_rules.fitted_bands(none) == quality_rules.Bands()


def test_incompressible_text_fails():
    import base64
    import zstandard

    noise = base64.b64encode(random.Random(1).randbytes(9000)).decode()
    text = " ".join(noise[i : i + 40] for i in range(0, len(noise), 40))
    zstd = zstandard.ZstdCompressor(level=3)
    assert not quality_rules.judge(text, quality_rules.Bands(), zstd)[-1]


# 10
def plain_base(t):
    import re

    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(only(m[0])) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "é", " ", "-", "+1", "(803)", "555-0123", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "999.1.1.1", "1", "22", "%", "_x"]), max_size=14))
def test_base_spans_match_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_base(text)


def test_added_spans_and_masks(docs, none):
    text = 'IBAN DE89370400440532013000 and token = "5f367f08b1a810c7777ad785b0be42018bfcbf49", my ssn 123-45-6789'
    assert [k for k, *_ in pii.spans_of(text)] == ["iban", "ssn", "secret"]
    assert pii.spans_of("DE89370400440532013001 commit 5f367f08b1a810c7777ad785b0be42018bfcbf49 order 123-45-6789") == []
    assert pii.redacted("mail a@b.co now") == "mail [EMAIL] now"
    assert pii.redact(docs).columns == docs.columns and pii.redact(none).collect() == []


def test_long_secrets_and_accounts_before_words():
    key = "aB3/" * 75
    assert pii.redacted(f"api_key={key} end") == "api_key=[SECRET] end"
    for account, tail in (("AT61 1904 3002 3457 3201", " BIC"), ("AT61 1904 3002 3457 3201", " 1234 X"), ("DE89 3704 0044 0532 0130 00", " BANK")):
        assert pii.redacted(f"konto {account}{tail}") == f"konto [IBAN]{tail}"
    assert pii.redacted("AT61 1904 3002 3457 3201 DE89 3704 0044 0532 0130 00") == "[IBAN] [IBAN]"
    assert pii.redacted("AB12 AT61 1904 3002 3457 3201 BIC") == "AB12 [IBAN] BIC"
    for text in ("AB12 " * 60_000, "-" * 300_000, "aB3/" * 75_000):
        pii.spans_of(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+1" * 100_000, "a@" * 100_000, "1.2." * 80_000):
        pii.spans_of(text)
