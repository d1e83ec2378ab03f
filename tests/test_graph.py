import itertools
import random

from pyspark.sql import functions as F

from claimloom.operators import graph, ranking
from claimloom.plans import retrieval

CLAIM = "claim_signature string, source_name string, relation_type string, target_name string, n_positive long, n_negative long, n_hypothetical long, n_uncertain long, n_mixed long"


def claim(s, t, pos=1, unc=0):
    return (f"{s}|r|{t}", s, "r", t, pos, 0, 0, unc, 0)


def test_edges_leave_out_what_is_unreachable(rows):
    claims = rows(CLAIM, claim("A", "B"), claim("A", "C", 0, 3), claim("A", "Z"), claim("B", "B"))
    entities = rows("canonical_name string", ("A",), ("B",), ("C",))
    assert {r["claim_signature"] for r in graph.target_edges(claims, entities).collect()} == {"A|r|B", "A|r|C", "B|r|B"}
    assert {r["claim_signature"] for r in graph.polarity_edges(claims, entities).collect()} == {"A|r|B", "A|r|Z", "B|r|B"}
    assert {r["claim_signature"] for r in graph.one_hop(claims, ["B", "C"], []).collect()} == {"A|r|B", "B|r|B"}
    assert graph.one_hop(claims, ["B"], ["B"]).count() == 0 and graph.one_hop(claims, [], []).count() == 0
    assert {r["claim_signature"] for r in graph.generic_specific(claims, ["A", "B"], ["B"]).collect()} == {"A|r|B"}
    assert graph.duplicate_keys(claims.unionAll(claims.limit(1)), "claim_signature").count() == 1


def test_chains_are_those_of_a_double_loop(rows, spark):
    random.seed(4)
    names = list("ABCDEFG")
    edges = {(random.choice(names), random.choice(names)) for _ in range(30)}
    claims = rows(CLAIM, *(claim(s, t) for s, t in edges))
    matched, generic = ["A", "B", "G"], ["G"]
    pairs = graph.anchor_pairs(spark.createDataFrame(list(enumerate(matched)), "pos int, name string"), generic)
    assert {tuple(r) for r in pairs.collect()} == {("A", "B"), ("A", "G"), ("B", "G")}
    want = set()
    for a, b in itertools.chain(*(((x, y), (y, x)) for x, y in (("A", "B"), ("A", "G"), ("B", "G")))):
        want |= {f"{a}|r|{m}>>{m}|r|{b}" for m in names if (a, m) in edges and (m, b) in edges and m not in (a, b) and m not in generic}
    assert {r["path_signature"] for r in graph.two_hop(claims, pairs, ["relation_type"], generic).collect()} == want
    assert {r["path_signature"] for r in graph.two_hop(claims, pairs, [], generic, most_pairs=0).collect()} == want


def test_evidence_needs_its_paper_and_is_ordered_by_section(rows):
    ev = rows("claim_signature string, evidence_id int, evidence_text string, paper_id int, section_type string", ("c", 1, "m", 1, "METHODS"), ("c", 2, "r", 1, "RESULTS"), ("c", 3, "gone", 9, "RESULTS"), ("c", 4, "", 1, "RESULTS"), ("c", 5, "u", 1, "odd"), ("d", 6, "x", 9, None))
    papers = rows("paper_id int, study_design string, published_year string", (1, "rct", "2020"))
    got = {r["claim_signature"]: [e["evidence_text"] for e in r["evidence_list"]] for r in graph.evidence_lists(ev, papers, 9).collect()}
    assert got == {"c": ["r", "u", "m"]} and graph.ranked_evidence(ev, papers).count() == 3
    assert [len(r["evidence_list"]) for r in graph.evidence_lists(ev, papers, 2).collect()] == [2]
    assert {r[0]: r[1] for r in graph.section_best(ev).collect()} == {"c": 1.0}


PATH = "path_signature string, length int, entities array<string>, quality double, hybrid double, both_ends boolean"


def brute_quota(paths, a=4, b=4, n=8):
    key = lambda p: (not p[5], -p[4], p[0])
    one, two = sorted((p for p in paths if p[1] == 1), key=key), sorted((p for p in paths if p[1] == 2), key=key)
    x, y = one[:a], two[:b]
    y = two[: len(y) + max(0, a - len(x))]
    x = one[: len(x) + max(0, b - len(y))]
    return [p[0] for p in sorted(x + y, key=lambda p: (-p[4], p[0]))[:n]]


def test_quotas_are_those_of_the_steps(rows):
    random.seed(1)
    for n1, n2 in ((0, 0), (1, 9), (9, 1), (3, 5), (4, 4), (6, 2), (0, 10), (10, 10)):
        paths = [(f"p{k}{i}", k, ["A", "B"], 1.0, round(random.random(), 2), random.random() < 0.5) for k, n in ((1, n1), (2, n2)) for i in range(n)]
        got = ranking.quotas(rows(PATH, *paths)).orderBy("rank").collect()
        assert [r["path_signature"] for r in got] == brute_quota(paths)


def brute_filter(paths, specific, matched, most, bucket, chains):
    best = lambda ps: sorted(ps, key=lambda p: (-p[3], p[0]))
    kept = {p[0] for p in best([p for p in paths if p[1] == 2])[:chains]}
    kept |= {p[0] for p in paths if p[1] == 1 and set(p[2]) <= set(specific)}
    for e in specific:
        kept |= {p[0] for p in best([p for p in paths if e in p[2] and e in matched])[:bucket]}
    for p in best(paths):
        if len(kept) >= most:
            break
        kept.add(p[0])
    return kept


def test_the_pre_filter_is_that_of_the_buckets(rows):
    random.seed(2)
    names = list("ABCDEF")
    paths = [(f"p{i}", n, random.sample(names, n + 1), round(random.random(), 2), 0.0, False) for i in range(60) for n in [random.choice([1, 2])]]
    df = rows(PATH, *paths)
    for specific, most in ((["A", "B"], 20), (["A"], 5), ([], 10), (["A", "B", "C"], 40)):
        got = {r["path_signature"] for r in ranking.pre_filter(df, specific, names, most, 3, 4).collect()}
        assert got == brute_filter(paths, specific, names, most, 3, 4)


def test_quality_defaults(rows):
    df = rows("c string, p int, s double, w double", ("high", 3, 1.0, 1.0), (None, None, None, None), ("odd", 3, 0.0, None))
    got = [round(r[0], 6) for r in df.select(ranking.claim_quality(F.col("c"), F.col("p"), F.col("s"), F.col("w"))).collect()]
    assert got == [1.386294, 0.0, round(0.2 * 1.3862943611 * 0.4 * 0.4, 6)]


def test_entities_are_matched_by_spans(spark, rows):
    entities = rows("canonical_name string, aliases array<string>", ("Nodular Goitre", ["NG"]), ("Thyroid Lymphoma", None), ("Follicular Carcinoma of the Thyroid Gland", []))
    found = retrieval.match_entities(retrieval.spans(spark, "Does nodular goiter lead to thyroid lymphoma?"), entities)
    assert [r[0] for r in found.collect()] == ["Thyroid Lymphoma", "Nodular Goitre"]
    assert retrieval.match_entities(retrieval.spans(spark, "of the"), entities).count() == 0
