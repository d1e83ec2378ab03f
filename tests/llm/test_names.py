import random
import string

import pytest
from pyspark.sql import functions as F

from claimloom.llm import canonical, names, setjoin


@pytest.mark.parametrize(
    ("written", "key"),
    [
        ("Goitre, Kaefesdral Nodular", "kaefesdral nodular goitre"), ("known FRHA1.", "frha1"), ("patients with Hyperletrivhoism", "hyperletrivhoism"), ("X Deficiency Type III [sic]", "x deficiency type 3"),
        ("Signaling Pathwaies", "signalling pathway"), ("Floviovrein α", "floviovrein alpha"), ("Piоrmostisеllа", "piormostisella"), ("Thöwex", "thowex"), ("SARF4*", "sarf4"), ("  ", ""), ("", ""), ("the", "the"), (None, None), ("Anti‐X Ab", "anti x antibody"),
    ],
)
def test_keys(written, key):
    assert names.match_key(written) == key


def test_variants_are_told_apart(rows):
    pairs = [("anti xalin igg", "anti xalin igm", False), ("xala deficiency type 1", "xala deficiency type 2", False), ("hypokalism", "hyperkalism", False), ("abcd12345 gene", "abcd12345 gene", True), ("ktcm7", "ktcm8", False), ("nodular goitre", "nodulra goitre", True), ("nodular goitre", "nodular goi", True), ("qaq", "qaqs", False), ("nodular goitre", "tubular goitre", False)]
    df = rows("a string, b string, same boolean", *pairs)
    assert all(r["same"] == r["got"] for r in df.withColumn("got", names.same_but_for_typing(F.col("a"), F.col("b"))).collect())


def brute(left, right, t, own):
    out = {}
    for i, (k, a) in enumerate(left):
        for j, (m, b) in enumerate(right):
            a_, b_ = set(a or []) - {None}, set(b or []) - {None}
            if k is None or m is None or not a_ or not b_ or (own and k >= m):
                continue
            s = len(a_ & b_) / len(a_ | b_)
            if s >= t - 1e-12:
                out[k, m] = s
    return out


@pytest.mark.parametrize("t", ["0.2", "0.5", "0.8", "1"])
@pytest.mark.parametrize("also", [None, lambda a, b: F.lit(True)])
def test_the_similarity_join_loses_no_pair(rows, t, also):
    random.seed(int(float(t) * 10))
    make = lambda n: [(f"k{i}", random.choices(string.ascii_lowercase[:12], k=random.randrange(0, 9))) for i in range(n)] + [(f"n{n}", None), (None, ["a"]), (f"m{n}", ["a", None, "a"])]
    left, right = make(30), make(31)
    df = lambda x: rows("k string, s array<string>, k2 string", *((*r, "x") for r in x))
    got = {(r["left_key"], r["right_key"]): r["jaccard"] for r in setjoin.jaccard_join(df(left), df(right), "k", "s", t, also).collect()}
    assert got == pytest.approx(brute(left, right, float(t), False))
    got = {(r["left_key"], r["right_key"]): r["jaccard"] for r in setjoin.jaccard_join(df(left), None, "k", "s", t, also).collect()}
    assert got == pytest.approx(brute(left, left, float(t), True))


def test_the_similarity_join_of_empty_tables(rows):
    empty = rows("k string, s array<string>", ("a", ["x"])).limit(0)
    assert setjoin.jaccard_join(empty, empty, "k", "s", "0.5").count() == 0
    with pytest.raises(ValueError):
        setjoin.jaccard_join(empty, empty, "k", "s", "0")


TERM = "term_id long, entity_type string, canonical string, aliases array<string>"
RECORD = "record_id long, canonical_name string, entity_type string, aliases array<string>, surface_forms array<string>, term_id string"


@pytest.fixture
def terms(rows):
    return rows(TERM, (1, "Gene", "KTCM2", ["Xalum Receptor Gene"]), (2, "Disease", "Kaefesdral Nodular Goitre", ["KNG"]), (3, "Marker", "Serum Halbase", ["KNG", None]), (4, "Disease", "Xala Deficiency Type 1", None), (None, "Disease", "Nothing", None))


def test_records_are_led_to_their_entries(rows, terms):
    index = rows("form string, canonical_name string", ("zd-12", "KAEFESDRAL nodular goitre"), ("lost", "Outside"), ("void", None), (None, "KTCM2"))
    records = rows(
        RECORD,
        (1, "Kaefesdral Nodulra Goitre", "Disease", None, None, "clash"), (2, "study drug", "Gene", ["ktcm2 "], ["study drug"], ""), (3, "KNG", "marker", [], [], ""), (4, "KNG", None, [], [], ""), (5, "ktcm7", "Gene", [], [], ""), (6, None, "Gene", None, None, ""),
        (7, " ", "Gene", [], ["Xalum receptor gene"], ""), (8, "ZD-12", None, None, None, ""), (9, "lost", None, ["KTCM2"], None, ""), (10, "Xala Deficiency Type 2", "Disease", None, None, ""), (11, "x" * 50_000, None, None, None, ""), (12, "marker b", None, None, None, ""), (None, "KTCM2", None, None, None, ""),
    )
    got = {r["record_id"]: (r["term_id"], r["status"]) for r in canonical.map_to_terms(records, terms, index).collect()}
    assert got == {
        1: (2, "matched"), 2: (1, "matched"), 3: (3, "matched"), 4: (None, "ambiguous"), 5: (None, "unmatched"), 6: (None, "unnamed"), 7: (1, "matched"), 8: (2, "matched"), 9: (None, "unmatched"), 10: (None, "unmatched"), 11: (None, "unmatched"), 12: (None, "unnamed"),
    }


def test_an_empty_list_and_an_empty_registry(rows, terms):
    records = rows(RECORD, (1, "KTCM2", "Gene", None, None, ""))
    assert [r["status"] for r in canonical.map_to_terms(records, terms.limit(0)).collect()] == ["unmatched"]
    assert canonical.map_to_terms(records.limit(0), terms).count() == 0


def test_redelivered_records_count_once(rows):
    df = rows("record_id long, updated_at timestamp_ntz, canonical_name string, key_properties map<string,string>").withColumn("updated_at", F.current_timestamp()) if False else rows("record_id long, updated_at string, canonical_name string, key_properties map<string,string>", (1, "2024-02", "new", {}), (1, "2024-01", "old", {}), (1, "2024-02", "new", {}), (2, None, "x", None), (None, "2024", "y", {}))
    assert sorted((r["record_id"], r["canonical_name"]) for r in canonical.current_registry(df).collect()) == [(1, "new"), (2, "x")]
