"""The classifiers' parts against plain forms: normal equations, pooling, the kernel; and columns whose names clash."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codexspark.llm import quality_classifier, shared, token_counts, toxicity
from tests.llm.test_operators import RANKS, labelled, result


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 1)), min_size=1, max_size=14))
def test_isotonic_is_the_largest_least_mean(pairs):
    """Without a prior, the rate at a value is max over lower ends of min over upper ends of the mean between them."""
    x, y = (np.array(v, float) for v in zip(*pairs))
    xs, rates = shared.isotonic(x, y, prior=0.0)
    values = sorted(set(x.tolist()))
    mean = lambda a, b: y[(x >= a) & (x <= b)].mean()
    want = [max(min(mean(a, b) for b in values if b >= v) for a in values if a <= v) for v in values]
    assert rates == sorted(rates) and xs == sorted(xs)
    assert sorted(set(np.round(rates, 9))) == sorted(set(np.round(want, 9)))


def test_waves_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(4)
    kernel = quality_classifier.Kernel(np.zeros(6), np.ones(6))
    x = rng.normal(size=(40, 6))
    z = kernel(x)[:, :-1]
    width = 0.7 * math.sqrt(6)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-d / (2 * width**2))).mean() < 0.06


def test_normal_equations_are_those_of_all_rows(spark):
    rng = np.random.default_rng(9)
    stats, y, fold = rng.normal(size=(300, 5)), rng.integers(0, 2, 300), rng.integers(0, quality_classifier.FOLDS, 300)
    rows = spark.createDataFrame([(s.tolist(), int(a), int(f)) for s, a, f in zip(stats, y, fold)], "stats array<double>, y int, fold int").repartition(7)
    kernel = quality_classifier.Kernel(stats.mean(0), stats.std(0))
    a, b = quality_classifier.fold_sums(rows, kernel)
    z = kernel(stats)
    for k in range(quality_classifier.FOLDS):
        own = fold == k
        assert np.allclose(a[k], z[own].T @ z[own]) and np.allclose(b[k], z[own].T @ y[own])


@pytest.mark.parametrize("score", [quality_classifier.quality, toxicity.toxicity])
def test_other_columns_are_not_read(spark, score):
    docs, labels = labelled(spark)
    docs, labels = docs.filter("doc_id < 60 or doc_id >= 1000"), labels.filter("doc_id < 60")
    extra = docs.selectExpr("*", "1 as stats", "'x' as f", "0 as y", "7 as fold", "true as held_out", "0.5 as score", "'en' as lang")
    more = labels.selectExpr("*", "'t' as text", "1 as y")
    assert sorted(map(repr, result(score(extra, more)))) == sorted(map(repr, result(score(docs, labels))))


def test_counts_replace_a_column_of_their_name(spark):
    """`edits` is read and `counts` is written; every other column stays."""
    docs = spark.createDataFrame([(1, "one two", 5, "x")], "doc_id long, text string, counts int, text_ string")
    edits = "cast(array(named_struct('start', 0L, 'stop', 3L, 'new', 'six')) as array<struct<start:bigint,stop:bigint,new:string>>)"
    got = token_counts.counted(docs.selectExpr("*", f"{edits} as edits"), RANKS).first()
    assert got.text_ == "x" and got.counts.n_tokens == 2 and got.counts.edited == "six two"
