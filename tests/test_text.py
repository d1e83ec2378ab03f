import math
import re

import pytest
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as T
from claimloom.operators import sections


def brute_windows(text, size=400, stride=320):
    w = text.split()
    out, at = [], 0
    while True:
        out.append(" ".join(w[at : at + size]))
        if at + size >= len(w):
            return out
        at += stride


@pytest.mark.parametrize("n", [0, 1, 399, 400, 401, 720, 721, 2000])
def test_windows_are_those_of_a_loop(rows, n):
    text = " \n".join(f"w{i}" for i in range(n))
    got = rows("t string", (text,)).select(T.windows(F.col("t"))).first()[0]
    assert got == brute_windows(text)


def brute_spans(question):
    tokens = re.findall(r"[A-Za-z0-9']+", question)
    out = []
    for n in range(1, 6):
        for i in range(len(tokens) - n + 1):
            w = tokens[i : i + n]
            if all(x.lower() in config.STOPWORDS for x in w) or (n == 1 and len(w[0]) < 3):
                continue
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("question", ["", "of the", "What is the role of TSH in Graves' disease?", "a b c d e f g"])
def test_ngrams_are_those_of_a_loop(rows, question):
    got = rows("q string", (question,)).select(T.ngrams(F.col("q"))).first()[0]
    assert [g["span"] for g in got] == brute_spans(question)


def test_section_types_names_and_skips(rows):
    df = rows("s string", ("3-2._materials_and_methods_entities",), ("1-abstract",), ("4-outcome_measures",), ("7-references",), ("8-appendix_a",), ("2-bibliography",), (None,))
    got = df.select(T.registry_section(F.col("s")), T.rich_section(F.regexp_replace("s", r"^\d+-", "")), T.section_display(F.col("s")), T.is_skipped_section(F.concat("s", F.lit(".md")))).collect()
    assert [r[0] for r in got][:3] == ["METHODS", "ABSTRACT", "OTHER"]
    assert [r[1] for r in got][:3] == ["METHODS", "ABSTRACT", "RESULTS"]
    assert got[0][2] == "2. materials and methods"
    assert [r[3] for r in got] == [False, False, False, True, True, False, None]


def test_responses_are_cleaned_and_parsed(rows):
    df = rows("r string", ('<think>x\n{"no": 1}</think>\n```json\n{"a": 1}\n```',), ('{"a": 2}',), ("```json\n{broken\n```",), ("",), (None,))
    assert [r[0] for r in df.select(F.get_json_object(T.response_json(F.col("r")), "$.a")).collect()] == ["1", "2", None, None, None]
    meta = rows("r string", ('<thinking>a </thinking>```json\nnoise {"metadata": {"doi": "x"}}\n```',), ('{"doi": "y"}',), ("nothing",))
    assert [r[0] for r in meta.select(F.get_json_object(T.metadata_json(F.col("r")), "$.doi")).collect()] == ["x", "y", None]


def test_chunk_text_and_natural_order(rows):
    text = "Header: 2. Results\n" + "=" * 50 + "\n\nBody = text"
    assert rows("t string", (text,)).select(T.chunk_header(F.col("t")), T.chunk_body(F.col("t"))).first()[:] == ("2. Results", "Body = text")
    names = rows("n string", ("10-a.md",), ("2-b.md",), ("x.md",), ("2-10.md",)).orderBy(T.natural_key(F.col("n")), "n")
    assert [r[0] for r in names.collect()] == ["x.md", "2-b.md", "2-10.md", "10-a.md"]


def test_structure_attaches_subheaders_to_their_header(rows):
    lines = ["    * orphan", "* Title:", "* Methods | Design", "    * Patients", "    * Labs:", "* Supplementary Data", "* Appendix A Extra tables", "", "plain"]
    df = rows("paper_id int, pos int, line string", *((1, i, x) for i, x in enumerate(lines)))
    got = sections.parse_structure(sections.clean_lines(df)).orderBy("header_no").collect()
    assert [(r["header"], r["subheaders"]) for r in got] == [("Title", []), ("Methods. Design", ["Patients", "Labs"]), ("Appendix A", [])]


def test_sections_end_at_the_next_header_and_batches_count(rows):
    df = rows("paper_id int, pos int, header string", (1, 1, "Intro"), (1, 2, "Results"), (1, 3, "References"), (2, 1, "Only"))
    got = {(r["paper_id"], r["header"]): (r["section_no"], r["next_header"]) for r in sections.section_ends(df).collect()}
    assert got == {(1, "Intro"): (1, "Results"), (1, "Results"): (2, "References"), (2, "Only"): (1, None)}
    batches = sections.batches(rows("id int", *((i,) for i in range(1, 24))), "id").collect()
    assert all(r["batch"] == math.ceil(r["id"] / 10) for r in batches)
