"""The registered queries as they are, over a small folder of tables: the contract's columns against plain Python or SQL, with
nulls, empty, short and long texts, ties and repeated rows; and over empty tables."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from codexspark.llm import queries, token_counts
from tests.llm.test_operators import RANKS, plain_base, plain_rules, result, words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    base = words(rng, 150)
    texts = [None, "", " \n ", "one", "a b c d", base, base, f"{base} and more", base.upper(), "mail x.y@ex.org or 10.0.0.1, card 4111 1111 1111 1111, call +49 30 1234567 " + words(rng, 30)]
    texts += ["spam spam " * 200, words(rng, 20_000), "é漢🙂 " * 60, "y" * 3000, "line one\nline one\n" + words(rng, 40)]
    texts += [words(rng, rng.randint(20, 120)) + (" vileword1 scum" if i % 3 == 0 else "") for i in range(60)]
    rows = [(7 * i + 2, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], rows[20]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(len(t or "") > 200), int("vileword1" in (t or ""))) for i, t, *_ in rows if i % 4]
    spark.createDataFrame([*labels, (9, 0, 1), (None, 1, 1)], LABELS).write.parquet(f"{path}/labels.parquet")
    return path, rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], EMBEDDINGS).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op3_mix_sources", "op5_near_dedup", "op13_collocations"])
def test_sql_gives_the_same(spark, folder, name):
    path = f"{folder[0]}/single-{name}"  # the statements take a doc_id for one row
    spark.createDataFrame(folder[1][:-2], DOCUMENTS).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, path)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_op2_counts_and_round_trips(spark, folder):
    got = result(queries.op2_pieces(spark, folder[0]))
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in folder[1])
    assert all((r["ids"] is None and r["n_tokens"] == 0) if r["round_trip"] is None else r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_op4_counts_equal_a_recount(spark, folder):
    c = token_counts.counter(RANKS)
    texts = {r[0]: r[1] or "" for r in folder[1]}
    got = result(queries.op4_token_counts(spark, folder[0]))
    assert len(got) == len(folder[1])
    for r in got:
        t = texts[r["doc_id"]]
        n = len(t)
        assert r["n_tokens"] == len(c.encoding.encode_ordinary(t))
        for a, b, new in ((n // 2, n // 2 + n // 20, "in other words, it's 42"), (n // 4, n // 4, " we'll see "), (n - n // 50, n + 1000, "")):
            t = t[:a] + new + t[b:]
        assert (r["n_tokens_edited"], r["n_chars_edited"], r["edited_sha256"]) == (len(c.encoding.encode_ordinary(t)), len(t), sha(t))
        assert r["n_reencoded"] <= r["n_pretokens"] + 40


@pytest.mark.parametrize("name, folds, fold, label, cut", [("op6_quality_classifier", 4, 2, "quality", 0.7), ("op7_toxicity", 5, 0, "toxic", 0.5)])
def test_scores_keep_to_their_contract(spark, folder, name, folds, fold, label, cut):
    got = result(queries.QUERIES[name](spark, folder[0]))
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in folder[1])
    by_text, texts = {}, {r[0]: r[1] or "" for r in folder[1]}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        assert by_text.setdefault(texts[r["doc_id"]], r["score"]) == r["score"]


def test_labels_of_held_out_rows_change_no_score(spark, folder, tmp_path):
    path = f"{tmp_path}/turned"
    spark.read.parquet(f"{folder[0]}/documents.parquet").write.parquet(f"{path}/documents.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder[0]}/labels.parquet").collect()]
    held = lambda i, folds, fold: zlib.crc32(str(i).encode()) % folds == fold
    turned = [(i, 1 - q if i and held(i, 4, 2) else q, 1 - t if i and held(i, 5, 0) else t) for i, q, t in rows]
    spark.createDataFrame(turned, LABELS).write.parquet(f"{path}/labels.parquet")
    for name in ("op6_quality_classifier", "op7_toxicity"):
        one, two = ({r["doc_id"]: r["score"] for r in result(queries.QUERIES[name](spark, p))} for p in (folder[0], path))
        assert one == pytest.approx(two)


def test_op8_edits_and_prints(spark, folder):
    rows = sorted({(i, t or "") for i, t, *_ in folder[1]})
    after = {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    texts, prints = dict(rows), {}
    repeated = {folder[1][9][0], folder[1][20][0]}  # a row that occurs twice is followed by itself
    for r in result(queries.op8_fingerprints(spark, folder[0])):
        t = texts[r["doc_id"]]
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        if r["doc_id"] not in repeated:
            q = len(t) // 4
            edited = t[: len(t) - q] + after[r["doc_id"]][:q]
            assert r["edited_sha256"] == sha(edited)
            assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert (r["near_edited"] == 1) >= (r["fingerprint"] == r["edited_fingerprint"])


def test_op9_counts_and_verdicts(spark, folder):
    texts = {r[0]: r[1] for r in folder[1]}
    for r in result(queries.op9_quality_rules(spark, folder[0])):
        counts = plain_rules(texts[r["doc_id"]])
        n, again = counts[0], counts[-1]
        if n < 3000:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
            assert r["base_failed"] == (n < 20 or 100 * again > 30 * n)
        assert not (r["base_failed"] and r["kept"])


def test_op10_spans(spark, folder):
    texts = {r[0]: r[1] or "" for r in folder[1]}
    for r in result(queries.op10_pii(spark, folder[0])):
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        spans = set(filter(None, r["spans"].split(",")))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= spans and all(re.fullmatch(r"[a-z_]+:\d+:\d+", s) for s in spans)
