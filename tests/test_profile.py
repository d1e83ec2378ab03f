import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import evaluation, profile, render


def test_quantiles_and_summary(rows):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    df = rows("x int", *((v,) for v in values))
    got = {r["p"]: r["value"] for r in profile.percentiles(df, "x").collect()}
    assert got == {p: int(np.percentile(values, p)) for p in (25, 50, 75, 90, 95, 99)}
    d = profile.describe(df, "x").first()
    assert (d["count"], d["min"], d["max"]) == (8, 1, 9) and d["std"] == pytest.approx(np.std(values, ddof=1))


def test_histogram_holds_the_greatest_value_in_its_last_bin(rows):
    df = rows("x int", *((v,) for v in [0, 1, 5, 10, 10]), (None,))
    assert {r["bin"]: r["n"] for r in profile.histogram(df, "x", 5).collect()} == {1: 2, 3: 1, 5: 2}
    assert {r["bin"]: r["n"] for r in profile.histogram(rows("x int", (2,), (2,)), "x", 5).collect()} == {1: 2}
    assert profile.histogram(df.limit(0), "x", 5).count() == 0


def test_shares_and_distributions(rows):
    df = rows("c array<string>, doi string", (["a", "a", None], "x"), (["a", "b"], "null"), (None, ""), ([], None))
    assert {r["v"]: (r["n"], r["share"]) for r in profile.exploded_counts(df, "c", "v").collect()} == {"a": (2, 50.0), "b": (1, 25.0)}
    assert {r["items"]: r["n"] for r in profile.size_distribution(df, "c").collect()} == {"3": 1, "2": 1, "0": 2}
    assert profile.coverage(df, "doi").first()[:2] == (1, 4)
    assert {r[0]: r[1] for r in profile.null_counts(df).collect()} == {"c": 1, "doi": 1}
    sweep = profile.threshold_sweep(rows("x int", (900,), (100,)), "x", [800, 2000]).collect()
    assert [(r["threshold"], r["n"], r["total"]) for r in sweep] == [(800, 1, 900), (2000, 0, 0)]


def test_evaluation(rows):
    scores = rows("id int, metric string, score double", *((1, m, 0.5) for m in evaluation.config.JUDGE_METRICS), (2, "FaithfulnessMetric", 1.0), (2, "AnswerRelevancyMetric", None))
    assert {r["id"]: r["overall"] for r in evaluation.wide_scores(scores).collect()} == {1: 0.5, 2: None}
    assert {r["metric"]: r["mean"] for r in evaluation.metric_means(scores).collect()}["FaithfulnessMetric"] == 0.75
    total = {r["k"]: r["n"] for r in evaluation.usage_totals(rows("k string, n long", ("a", 1), ("b", 2)), "k", "n").collect()}
    assert total == {"a": 1, "b": 2, "TOTAL": 3}
    judged = evaluation.judged(rows("id int, answer string", (1, "x"), (2, " "), (3, "y")), rows("id int, answer string", (1, "g")))
    assert [r["id"] for r in judged.collect()] == [1]


def test_rendering(rows):
    ev = "array<struct<evidence_text:string,paper_id:int,study_design:string,paper_year:string,section_type:string>>"
    df = rows(f"rank int, source_name string, relation_type string, target_name string, certainty_max string, paper_count int, evidence_list {ev}", (2, "A", "r", "B", "high", 2, [(" said ", 1, "rct", None, "RESULTS")]), (1, "C", "r", "D", None, 0, None))
    got = render.direct_blocks(df).orderBy("rank").collect()
    assert got[0]["block"] == "[G1] C -> r -> D\n     Certainty: ? | Papers: 0\n\n"
    assert got[1]["block"] == "[G2] A -> r -> B\n     Certainty: high | Papers: 2\n     - [P1, rct, ?] [RESULTS] said\n\n"
    text = render.joined_blocks(render.direct_blocks(df))
    whole = render.prompt("Why?", text, text, {"A": "x"}).first()[0]
    assert whole.startswith("## QUESTION\nWhy?\n\n## OPTIONS\nA: x") and whole.index("[G1]") < whole.index("[G2]")
    chain = rows(f"rank int, bridge_name string, {', '.join(f'{p}_{c} string' for p in ('c1', 'c2') for c in ('source_name', 'relation_type', 'target_name', 'certainty_max', 'paper_count'))}, c1_evidence_list {ev}, c2_evidence_list {ev}", (1, "M", "A", "r", "M", "high", "1", "M", "s", "B", "low", "2", None, None))
    assert render.chain_blocks(chain, 3).first()["block"].startswith("[G4] CHAIN: A -> r -> M -> s -> B\n     Bridge: M\n     [G4.1] A -> r -> M\n")
    line = rows("e array<string>, r array<string>", (["A", "B", "C"], ["x", "y"])).select(render.chain_text(F.col("e"), F.col("r"))).first()[0]
    assert line == "A --[x]--> B --[y]--> C"
