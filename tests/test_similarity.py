import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import similarity as S
from claimloom.functions.vector import cosine


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_length_is_that_of_the_table(a, b):
    assert S.common_length(a, b) == brute_common(a, b)


def test_known_scores():
    assert S.ratio("hypothyroidism", "hyperthyroidism") == pytest.approx(89.655, abs=1e-3)
    assert S.sorted_ratio("hashimoto thyroiditis", "thyroiditis hashimoto's") == pytest.approx(95.4545, abs=1e-3)
    assert S.set_ratio("a b c", "c b a d") == 100
    assert S.composite_ratio("", "x") == 0 and S.ratio("", "") == 100


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", max_size=10), st.text("ab ", max_size=10))
def test_scores_are_symmetric_and_bounded(a, b):
    for f in (S.ratio, S.sorted_ratio, S.set_ratio, S.composite_ratio):
        assert 0 <= f(a, b) <= 100 and f(a, b) == pytest.approx(f(b, a))


def test_the_cheap_bound_never_refuses_a_true_pair(rows):
    words = ["goitre", "goiters", "nodular goitre", "nodular goiter", "thyroid", "thyroids", "xyz", ""]
    df = rows("a string, b string", *((x, y) for x in words for y in words))
    for r in df.withColumn("may", S.may_reach(F.col("a"), F.col("b"), 80)).withColumn("s", S.ratio_score("a", "b")).collect():
        assert r["may"] or r["s"] < 80


def test_cosine(rows):
    df = rows("a array<float>, b array<float>", ([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0]))
    assert [r[0] for r in df.select(F.round(cosine(F.col("a"), F.col("b")), 6)).collect()] == [0.707107, 0.0, None]
