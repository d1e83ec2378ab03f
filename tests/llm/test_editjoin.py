import random

import pytest
from pyspark.sql import functions as F

from claimloom.llm import canonical

TERM = "term_id long, entity_type string, canonical string, aliases array<string>"
RECORD = "record_id long, canonical_name string, entity_type string, aliases array<string>, surface_forms array<string>"


def test_a_misspelt_name_is_found_however_frequent_its_words_are(rows):
    terms = rows(TERM, (1, "Disease", "Autoimmune Thyroiditis", None))
    many = [(i, f"autoimmune {c}{d}axelom", None, None, None) for i, (c, d) in enumerate((c, d) for c in "bdfgk" for d in "aeiou")]
    many += [(100 + i, f"{c}{d}axelom thyroiditis", None, None, None) for i, (c, d) in enumerate((c, d) for c in "bdfgk" for d in "aeiou")]
    records = rows(RECORD, *many, (500, "Autoimune Thyroidtis", None, None, None), (501, "Autoimmune Thyroiditis", None, None, None))
    got = {r["record_id"]: r["term_id"] for r in canonical.map_to_terms(records, terms).collect()}
    assert {k for k, v in got.items() if v == 1} == {500, 501}


def typo(word, n):
    for _ in range(n):
        i = random.randrange(len(word) + 1)
        word = random.choice([word[:i] + random.choice("abc ") + word[i:], word[:i] + word[i + 1 :], word[:i] + random.choice("abc") + word[i + 1 :]])
    return " ".join(word.split())


@pytest.mark.parametrize("seed", range(2))
def test_the_typing_join_loses_no_pair(rows, seed):
    from claimloom.llm.editjoin import typing_join
    from claimloom.llm.names import grams, same_but_for_typing

    random.seed(seed)
    bases = ["".join(random.choices("abc", k=random.randrange(5, 16))) for _ in range(25)] + ["abababab", "ü😀abcdefg", "hyperabcab", "ab 12 abcab"]
    keys = {typo(b, random.randrange(4)) for b in bases for _ in range(8)} | {b[: random.randrange(4, len(b) + 1)] for b in bases} | set(bases)
    df = rows("k string", *((k,) for k in sorted(keys)), (None,), ("",), ("x" * 3000,))
    half = rows("k string", *((k,) for k in sorted(keys)[::2]), (None,), ("",))

    def brute(a, b):
        pairs = a.where("k <> ''").crossJoin(b.where("k <> ''").withColumnRenamed("k", "m")).where(same_but_for_typing(F.col("k"), F.col("m"))).withColumn("a", grams(F.col("k"))).withColumn("b", grams(F.col("m")))
        return pairs.withColumn("j", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).where("j >= 0.2")

    flat = lambda df: sorted((x, y, round(j, 9)) for x, y, j in df.collect())
    want = flat(brute(half, df).select("k", "m", "j"))
    assert len(want) > len(keys) and flat(typing_join(half, df, "k", "0.2")) == want
    assert flat(typing_join(df, None, "k", "0.2")) == flat(brute(df, df).where("k < m").select("k", "m", "j"))


def test_names_that_share_their_words_only_are_not_compared(rows, monkeypatch):
    from claimloom.llm import editjoin

    random.seed(3)
    keys = sorted({f"{''.join(random.choices('abcdefghiklmnoprstuvwx', k=9))} deficiency syndrome" for _ in range(150)})
    monkeypatch.setattr(editjoin, "same_but_for_typing", lambda *_: F.lit(True))
    compared = editjoin.typing_join(rows("k string", *((k,) for k in keys), (f"{keys[0]}x",)), None, "k", "0.0").count()
    assert 1 <= compared < len(keys)  # of more than 11 000 pairs that share two segments


def test_shorter_prefixes_lose_no_pair_that_differs_by_typing(rows):
    from claimloom.llm import setjoin
    from claimloom.llm.names import gram_set, same_but_for_typing

    random.seed(4)
    bases = ["".join(random.choices("abcd", k=random.randrange(6, 24))) for _ in range(40)]
    keys = sorted({typo(b, random.randrange(4)) for b in bases for _ in range(8)} | {b[: random.randrange(4, len(b) + 1)] for b in bases for _ in range(3)} | set(bases))
    df = rows("k string", *((k,) for k in keys)).withColumn("t", gram_set(F.col("k")))
    half = df.where(F.col("k").isin(keys[::2]))
    flat = lambda **lost: sorted((x, y) for x, y, _ in setjoin.jaccard_join(half, df, "k", "t", "0.4", also=same_but_for_typing, **lost).collect())
    want = flat()
    assert len(want) > len(keys) and flat(lost=(6, 1)) == want
    assert len(flat(lost=(0, 0))) < len(want)
