"""run() against the operators' plain forms on a small table."""

import random

import corpus_pipeline
from codexspark.llm import pii, quality_rules
from tests.llm.test_operators import plain_components, words


def test_pipeline_keeps_what_plain_code_keeps(spark, tmp_path):
    import zstandard

    rng = random.Random(12)
    base = words(rng, 150)
    texts = [words(rng, rng.randint(30, 90)) for _ in range(60)] + [base, base, base + " more", "spam " * 200, None, "", "mail x.y@ex.org " + words(rng, 40)]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    zstd = zstandard.ZstdCompressor(level=3, write_content_size=False)
    bands = quality_rules.fitted_bands(docs)
    kept = [r for r in rows if quality_rules.judge(r[1], bands, zstd)[-1]]
    one = {i for i, _, _, k in plain_components(kept) if k}
    own = {i: pii.redacted(t) for i, t, *_ in kept if i in one}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= own.keys() and all(r.round_trip for r in got)
    counts = {i: sum(r.doc_id == i for r in got) for i in own}
    assert set(counts.values()) <= {0, 1, 2}
    sizes = {i: len(t.split()) for i, t in own.items()}
    taken, budget = sum(counts[i] * sizes[i] for i in own), 1.5 * sum(sizes.values())
    assert budget - 4 * 90 <= taken <= budget


def test_stages_keep_the_columns(spark, tmp_path):
    rows = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, rules int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, str(tmp_path)).columns == rows.columns


def test_every_stage_takes_an_empty_table_and_null_sources(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    assert all(stage(spark, none, str(tmp_path)).collect() == [] for _, stage in corpus_pipeline.STAGES)
    rng = random.Random(3)
    rows = [(i, words(rng, 60), None, None if i % 2 else "s", 400) for i in range(30)] + [(99, None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.round_trip for r in got) and {r.doc_id % 2 for r in got} == {0, 1}
