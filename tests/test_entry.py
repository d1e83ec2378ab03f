"""Every query against its SQL, at the smallest size."""

import importlib.util
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from claimloom import config
from claimloom.functions.similarity import composite_ratio, ratio

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    other = con.sql(entry.oracle_sql()[name])
    assert sorted(other.columns) == columns
    want = sorted(tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_resembling_names_are_those_of_all_pairs(spark, con):
    names = con.sql("SELECT canonical, min(term_id) FROM canonical_terms GROUP BY 1 ORDER BY 2").fetchall()
    shield = {p.lower() for p in config.PROTECTED_NAMES}
    names = [n for n, _ in names if n.lower() not in shield]
    words = [" ".join(sorted(n.split())) for n in names]
    want = {}
    for i, a in enumerate(words):
        for j in range(i + 1, len(words)):
            if 200 * min(len(a), len(words[j])) >= config.MERGE_SCORE * (len(a) + len(words[j])) and (score := ratio(a, words[j])) >= config.MERGE_SCORE:
                want[frozenset((names[i], names[j]))] = round(score, 6)
    got = {frozenset((r["early"], r["late"])): r["score"] for r in entry.queries()["token_sort_pairs"](spark, DATA).collect()}
    assert want and got == pytest.approx(want)


def test_entities_are_those_of_the_sequential_merge(spark, con):
    rows = con.sql("""SELECT arg_min(trim(canonical_name), mention_id), min(mention_id) FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY loaded_at DESC) AS nth FROM entity_mentions)
      WHERE nth = 1 AND trim(canonical_name) <> '' GROUP BY lower(trim(canonical_name)) ORDER BY 2""").fetchall()
    shield = {p.lower() for p in config.PROTECTED_NAMES}
    want, leaders = {}, []
    for name, _ in rows:
        free = name.lower() not in shield
        scores = [(ratio(" ".join(sorted(name.split())), " ".join(sorted(x.split()))), -i, x) for i, x in enumerate(leaders) if free and x.lower() not in shield]
        best = max(scores, default=(0, 0, None))
        want[name] = best[2] if best[0] >= config.MERGE_SCORE else name
        if want[name] == name:
            leaders.append(name)
    assert {r["name"]: r["leader"] for r in entry.queries()["entity_resolution"](spark, DATA).collect()} == want


def test_entities_of_the_question_are_those_of_all_spans_and_names(spark, con):
    from claimloom.queries import QUESTION

    tokens = re.findall(r"[A-Za-z0-9']+", QUESTION)
    spans = [" ".join(tokens[i : i + n]) for n in range(1, 6) for i in range(len(tokens) - n + 1)]
    stop = set(config.STOPWORDS)
    spans = [s for s in spans if any(w.lower() not in stop for w in s.split()) and (" " in s or len(s) >= config.UNIGRAM_LETTERS)]
    best = {}
    for canonical, aliases in con.sql("SELECT canonical, any_value(aliases ORDER BY term_id) FROM canonical_terms GROUP BY canonical").fetchall():
        for name in [canonical, *(aliases or [])]:
            need = math.ceil(len(re.findall(r"[A-Za-z0-9']+", name)) * config.MATCH_COVERAGE)
            score = ratio if len(name) < 5 else composite_ratio
            for s in spans:
                if len(s.split()) >= need:
                    best[canonical] = max(best.get(canonical, 0), score(s.lower(), name.lower()))
    want = sorted(((round(-s, 6), n) for n, s in best.items() if s >= config.MATCH_SCORE))[: config.MATCH_TOP]
    got = sorted((-r["score"], r["canonical_name"]) for r in entry.queries()["span_match"](spark, DATA).collect())
    assert got == [(pytest.approx(s), n) for s, n in want]


def test_the_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_imports_the_training_data_operators():
    root = os.path.dirname(importlib.util.find_spec("claimloom").origin)
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "claimloom.llm" not in open(os.path.join(folder, n)).read()
