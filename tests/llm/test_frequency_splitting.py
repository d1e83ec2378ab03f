import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.llm import frequency as Q
from claimloom.llm import splitting as S


def test_name_values():
    assert Q.name_value("  État   DE \n") == "état de"
    assert Q.name_value(" ") is None and Q.name_value(None) is None and Q.name_value("") is None


@pytest.mark.parametrize("salts", [1, 7])
def test_counts_are_those_of_sets(rows, salts):
    random.seed(salts)
    data = [(random.choice([None, "hot", "hot", "hot", "a", "b"]), random.choice([None, 1, 2, 3, 4, 5])) for _ in range(400)]
    got = {r["t"]: (r["occurrences"], r["records"]) for r in Q.term_frequencies(rows("t string, r int, _w string", *((*x, "clash") for x in data)), "t", "r", salts=salts).collect()}
    assert got == {t: (sum(x[0] == t for x in data), len({x[1] for x in data if x[0] == t} - {None})) for t in {x[0] for x in data} - {None}}
    assert Q.term_frequencies(rows("t string, r int", ("a", 1)).limit(0), "t", "r").count() == 0


def test_rows_of_a_hot_term_without_a_record_are_spread(rows):
    df = rows("t string, r int", *(("hot", None) for _ in range(200)), ("hot", 1)).repartition(4)
    got = Q.term_frequencies(df, "t", "r").collect()
    assert [tuple(r) for r in got] == [("hot", 201, 1)]


def test_marks(rows):
    df = rows("canonical_name string, paper_ids array<int>", ("A", [1, 1, None]), (" a", [1]), ("B", list(range(2, 30))), ("C", None), ("D", []), (None, [50]), ("E", [2, 3]), ("x" * 100_000, [1, 2]))
    got = {r["name_value"]: (r["n_records"], r["n_papers"], r["mark"]) for r in Q.marked_names(df).collect()}
    assert got["a"] == (2, 1, "rare") and got["b"] == (1, 28, "common") and got["c"] == (1, 0, None) and got["d"] == (1, 0, None) and got["e"] == (1, 2, None) and len(got) == 6


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.data())
def test_the_range_maximum_is_the_rightmost_greatest(values, data):
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a, len(values) - 1))
    got = S.RangeMaximum(np.array(values), len(values)).query(a, b)
    top = max(values[a : b + 1])
    assert got == max(i for i in range(a, b + 1) if values[i] == top)


def random_text(n, seed):
    random.seed(seed)
    return "".join(f"W{i}{random.choice(['', '', '', '.', ',', '!'])}{random.choice([' ', ' ', '  ', chr(10), chr(10) * 2, chr(0xA0)])}" for i in range(n))


@pytest.mark.parametrize("n", [0, 1, 40, 41, 100, 1000])
@pytest.mark.parametrize("overlap", [0, 8, 19])
def test_pieces_cover_the_text_and_share_the_overlap(n, overlap):
    text = random_text(n, n)
    plan = S.split_plan(text, 40, overlap)
    words = text.split()
    if n <= 40:
        assert plan == [(0, len(text), 0, n)]
        return
    for i, (start, length, first, count) in enumerate(plan):
        piece = text[start : start + length]
        assert piece.split() == words[first : first + count] and count <= 40 and piece == piece.strip()
        if i:
            assert first + overlap == plan[i - 1][2] + plan[i - 1][3]
    assert plan[0][2] == 0 and plan[-1][2] + plan[-1][3] == n
    rebuilt = words[: plan[0][3]]
    for _, _, first, count in plan[1:]:
        rebuilt += words[first + overlap : first + count]
    assert rebuilt == words


def test_cuts_fall_on_the_strongest_boundary():
    text = " ".join(f"a{i}" for i in range(30)) + "\n\n" + " ".join(f"b{i}" for i in range(5)) + ". " + " ".join(f"C{i}" for i in range(20))
    assert S.split_plan(text, 40, 0)[0][3] == 30
    assert S.split_plan("x " * 100, 40, 0)[0][3] == 40  # no boundary: full pieces
    cf = " ".join(f"a{i}" for i in range(25)) + " cf. Other words. " + " ".join(f"b{i}" for i in range(40))
    assert S.split_plan(cf, 40, 0)[0][3] == 28
    assert S.split_plan(None) == [] and S.split_plan("") == [(0, 0, 0, 0)]
    long = "y" * 200_000
    assert [p[3] for p in S.split_plan(" ".join([long] * 50), 40, 0)] == [40, 10]


def test_chunks(rows):
    two = "alpha " * 450
    df = rows(
        "point_id long, paper_id int, section_name string, section_type string, chunk_filename string, window_index int, window_count int, text string, loaded_at string, piece string",
        (1000000, 1, "3. RESULTS:", "RESULTS", "0-3._results.md", 0, 1, two, "2", "clash"), (1000000, 1, "3. RESULTS", "RESULTS", "0-3._results.md", 0, 1, "short", "1", ""), (1001000, 1, None, None, "1-patient_flow.md", 0, 9, "b c", "1", ""), (1001001, 1, " ", None, "1-patient_flow.md", 1, 9, "c d", "1", ""),
        (1002000, 1, None, None, None, 0, 1, None, "1", ""), (1003000, 1, "x", None, None, 0, 1, "", None, ""), (None, 1, "x", None, None, 0, 1, "a", "1", ""),
    )
    got = {(r["point_id"], r["piece"]): r for r in S.split_chunks(df).collect()}
    assert len(got) == 6
    assert [got[1000000, i]["words"] for i in (0, 1)] == [400, 130] and got[1000000, 1]["window_index"] == 1 and got[1000000, 1]["window_count"] == 2 and got[1000000, 0]["section_name"] == "Results"
    assert got[1001001, 0]["window_index"] == 1 and got[1001001, 0]["window_count"] == 2 and got[1001001, 0]["section_name"] == "Patient Flow"
    assert got[1002000, 0]["text"] is None and got[1002000, 0]["section_name"] is None and got[1003000, 0]["text"] == ""
    assert [(r["point_id"], r["pieces"], r["words"]) for r in S.oversized_points(df).collect()] == [(1000000, 2, 450)]
    assert S.split_chunks(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.plan_column("text", 80, 80)
    assert F.col("x") is not None
