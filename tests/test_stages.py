import types

import pytest

from claimloom import config, lineage, providers
from claimloom.functions import similarity
from claimloom.operators import registry
from claimloom.plans import answer, embedding, extraction
from claimloom.sources import sinks


def echo(*refuse):
    class Echo:  # local, so that it travels to the workers by value
        def complete(self, requests):
            return [None if r in refuse else r.upper() for r in requests]

    return Echo()


def test_a_model_is_chosen_by_its_tag(rows):
    models = providers.Models({"loud": ("loud-1", echo()), "mute": ("mute-1", echo("b"))})
    df = rows("k int, tag string, request string", (1, "loud", "a"), (2, "mute", "b"), (3, "other", "c"), (4, None, "d"), (5, "loud", None))
    assert {r["k"]: r["response"] for r in providers.completed_by_tag(df, "request", "tag", models).collect()} == {1: "A", 2: None, 3: None, 4: None, 5: None}
    assert models.name("mute") == "mute-1"
    with pytest.raises(KeyError):
        models.provider("other")


def test_a_refused_request_is_asked_otherwise_once(rows):
    df = rows("k int, request string, other string", (1, "a", "x"), (2, "b", "y"), (3, "b", "b"), (4, "a", None))
    got = {r["k"]: r["response"] for r in providers.completed_or_alternate(df, "request", "other", echo("b")).collect()}
    assert got == {1: "A", 2: "Y", 3: None, 4: "A"}


def test_first_pages(rows):
    df = rows("stem string, content binary", ("1", b"page"), ("2", b" "), ("3", b""), ("4", b"bad"))

    def reader(content):
        if content == b"bad":
            raise ValueError
        return content.decode()

    assert {r["stem"]: r["first_page"] for r in providers.first_pages(df, reader).collect()} == {"1": "page", "2": None, "3": None, "4": None}


def test_a_case_that_the_judge_fails_on_has_no_score(rows):
    class Picky(providers.SharedWords):
        def score(self, metric, cases):
            if any(c["answer"] == "boom" for c in cases):
                raise ValueError
            return super().score(metric, cases)

    df = rows("id int, question string, answer string, expected string, context string", (1, "a b", "a c", "c", "c d"), (2, "a", "boom", "x", "y"), (3, "q", "q", "e", None))
    got = {(r["id"], r["metric"]): (r["score"], r["success"]) for r in providers.judged_scores(df, "id", Picky(), config.JUDGE_METRICS, wait=0).collect()}
    assert got[1, "AnswerRelevancyMetric"] == (0.5, False) and got[1, "ContextualRecallMetric"] == (1.0, True) and got[1, "FaithfulnessMetric"] == (0.5, False)
    assert got[2, "AnswerRelevancyMetric"] == (None, None) and got[3, "FaithfulnessMetric"] == (None, None) and got[3, "AnswerRelevancyMetric"] == (1.0, True)


def test_vectors_are_made_for_what_is_new_or_changed(spark, rows, tmp_path):
    path = str(tmp_path / "v")
    make = lambda *data: rows("k int, text string", *data)
    one = providers.HashedWords(8)
    assert embedding.backfill(make((1, "a"), (2, "b"), (3, None), (4, "")), "k", path, one) == {"seen": 4, "embedded": 2}
    assert embedding.backfill(make((1, "a"), (2, "c"), (5, "d")), "k", path, one) == {"seen": 3, "embedded": 2}
    assert embedding.backfill(make((1, "z"), (6, "e")), "k", path, one, again=False) == {"seen": 2, "embedded": 1}
    assert embedding.backfill(make((1, "a")), "k", path, one) == {"seen": 1, "embedded": 0}
    now = {r["k"]: (r["text"], len(r["embedding"])) for r in sinks.current_vectors(spark.read.parquet(path), "k").collect()}
    assert now == {1: ("a", 8), 2: ("c", 8), 5: ("d", 8), 6: ("e", 8)}
    assert embedding.backfill(make().limit(0), "k", str(tmp_path / "none"), one) == {"seen": 0, "embedded": 0}


def test_the_collections_of_a_build(rows, tmp_path):
    tables = {
        "points": rows("point_id long, text string", (1, "x y")), "papers": rows("paper_id int, title string, purpose_of_work string, study_design string, published_year string", (1, "t", "", None, None)),
        "evidence": rows("evidence_id string, claim_signature string, evidence_text string, paper_id int, section_type string", ("e", "a|r|b", "said", 1, "RESULTS")), "claims": rows("claim_signature string, source_name string, relation_type string, target_name string", ("a|r|b", "a", "r", "b"), ("a|r|c", "a", "r", "c")),
    }
    texts = {r["claim_signature"]: r["text"] for r in embedding.claim_texts(tables["claims"], tables["evidence"], tables["papers"]).collect()}
    assert texts == {"a|r|b": "a r b. said", "a|r|c": "a r c"}
    got = embedding.collections(tables.get, providers.HashedWords(8), str(tmp_path))
    assert {k: v["embedded"] for k, v in got.items()} == {"chunks": 1, "papers": 1, "evidence": 1, "claims": 2}
    assert all(v["embedded"] == 0 for v in embedding.collections(tables.get, providers.HashedWords(8), str(tmp_path)).values())


def test_tables_and_figures_are_parsed_and_kept(spark, rows, tmp_path):
    df = rows("paper_id int, response string", (1, '```json\n[{"table_id": 1, "caption": "c", "groups": ["a", "b"]}, {"table_id": 2}]\n```'), (2, "[]"), (3, "{broken"), (4, None), (5, "null"))
    got = extraction.items(df, "tables")
    assert sorted((r["paper_id"], r["table_id"], r["caption"]) for r in got.collect()) == [(1, 1, "c"), (1, 2, None)]
    assert sorted(r["paper_id"] for r in extraction.unparsed(df, "figures").collect()) == [3, 4]
    asked = rows("paper_id int, request string", (1, "[]"), (2, '[{"FIGURE_ID": 7}]'.lower()))

    class Same:
        def complete(self, requests):
            return requests

    assert [tuple(r) for r in extraction.extracted(asked, rows("paper_id int", (1,)), "figures", Same()).select("paper_id", "figure_id").collect()] == [(2, 7)]
    for _ in range(2):
        sinks.write_items(got, str(tmp_path / "items"), "tables")
    assert spark.read.json(str(tmp_path / "items")).where("kind = 'tables'").count() == 2


def test_parts_structures_times_and_evaluations_are_written(spark, rows, tmp_path):
    for part in (1, 2, 2):
        sinks.append_part(rows("paper_id string", (str(part),)), str(tmp_path / "meta"), part)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "meta")).collect()) == [("1", 1), ("2", 2), ("2", 2)]
    lines = rows("kind string, paper_id int, pos int, line string", ("raw", 1, 2, "* B"), ("raw", 1, 1, "* A"), ("corrected", 1, 1, "* A"))
    sinks.write_structures(lines, str(tmp_path / "structure"))
    back = spark.read.text(str(tmp_path / "structure"), wholetext=True).collect()
    assert sorted((r["kind"], r["value"].strip()) for r in back) == [("corrected", "* A"), ("raw", "* A\n* B")]
    report = sinks.timing_lines(rows("paper_id int, nth int, section string, seconds double", (1, 2, "b", 0.25), (1, 1, "a", 1.5))).first()["report"]
    assert report.startswith("## Paper 1: 1.8 s") and report.index("| 1 | a | 1.5 |") < report.index("| 2 | b | 0.")
    for score in (0.1, 0.2):
        sinks.write_evaluation(rows("system string, id string, score double", ("x", "q", score)), str(tmp_path / "eval"))
    sinks.write_evaluation(rows("system string, id string, score double", ("y", "q", 0.3)), str(tmp_path / "eval"))
    assert sorted((r["system"], r["score"]) for r in spark.read.json(str(tmp_path / "eval")).collect()) == [("x", 0.2), ("y", 0.3)]


def test_answers_are_taken_out_of_responses(rows):
    class Fixed:
        def complete(self, requests):
            return [f"so: <answer>\n{r[-1]} </answer>" if r != "free" else " plain " for r in requests]

    got = {r["prompt"]: r["answer"] for r in answer.answered(rows("prompt string", ("pick B",), ("free",)), Fixed()).collect()}
    assert got == {"pick B": "B", "free": "plain"}


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [
        ("this is a test", "this is a test!", 96.55), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95.0), ("fuzzy was a bear but not a dog", "fuzzy was a bear", 90.0), ("abcd", "abcd", 100.0), ("abcd", "", 0.0), ("level tsh", "serum tsh and its level over time", 85.5), ("tsh", "xxtshxx yyyyyyy", 90.0),
        ("tsh", "serum tsh concentration in blood", 60.0), ("aaaa bbbb", "cccc", 0.0),
    ],
)
def test_the_composite_score(a, b, score):
    assert similarity.composite_ratio(a, b) == pytest.approx(score, abs=0.01) == similarity.composite_ratio(b, a)


def test_stretches_at_either_end_may_be_shorter():
    assert similarity.partial_ratio("abcd", "cdxxxxxx") == pytest.approx(200 * 2 / 6) and similarity.partial_ratio("abcd", "xxxxxxab") == pytest.approx(200 * 2 / 6)
    assert similarity.partial_words_ratio("b a", "c a x") == 100 and similarity.set_ratio(" ", "a") == 0


def test_relations_are_checked_against_the_vocabulary(spark, rows):
    d, h, s = "Diseases & Conditions", "Hormones, Biomarkers & Antibodies", "Study"
    data = [("diagnosed_by", d, h, "allowed"), ("diagnosed_by", h, d, "direction"), ("diagnosed_by", d, d, "ends"), ("made_up", d, h, "relation"), (None, d, h, "relation"), ("diagnosed_by", None, h, "untyped"), ("diagnosed_by", " ", h, "untyped"), ("associated_with", d.upper() + " ", h, "allowed"), ("associated_with", d, s, "ends"), ("compared_with", "Treatments & Management", "Study Groups", "ends")]
    df = rows("relation_type string, source_type string, target_type string, want string", *data)
    got = registry.checked_relations(df, registry.relation_ends(spark)).collect()
    assert len(got) == len(data) and all(r["verdict"] == r["want"] for r in got)
    assert {r for r, _, _ in config.relation_ends()} == set(config.RELATION_TYPES)
    sections = rows("relation_type string, section_type string", ("diagnosed_by", "METHODS"), ("treated_with", "METHODS"), ("treated_with", "RESULTS"), ("treated_with", None), (None, "METHODS"))
    assert sorted(map(tuple, registry.section_relations(sections).fillna("-").collect())) == [("diagnosed_by", "METHODS"), ("treated_with", "-"), ("treated_with", "RESULTS")]


def test_leaders_of_a_long_chain(spark, rows):
    n = 12
    names = rows("name string, seq int", *((f"n{i:02d}", i) for i in range(n)), ("alone", n))
    pairs = rows("early string, late string, score double", *((f"n{i:02d}", f"n{i + 1:02d}", 90.0) for i in range(n - 1)))
    got = {r["name"]: r["leader"] for r in registry.greedy_leaders(names, pairs).collect()}
    assert got == {"alone": "alone"} | {f"n{i:02d}": f"n{i - i % 2:02d}" for i in range(n)}


def test_a_cluster_needs_a_checkpoint_folder(monkeypatch):
    def session(master, named, of_session=None):
        where = []
        context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: where[0] if where else None, setCheckpointDir=where.append, getConf=lambda: types.SimpleNamespace(get=lambda _: named))
        return types.SimpleNamespace(sparkSession=types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda _, __: of_session)))

    assert lineage.checkpoint_dir(session("spark://x:7077", "/shared")) == "/shared"
    assert lineage.checkpoint_dir(session("spark://x:7077", None, "/session")) == "/session"
    assert "claimloom-" in lineage.checkpoint_dir(session("local[4]", None))
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            lineage.checkpoint_dir(session(master, None))


def test_rows_that_differ_in_a_map_only_are_told_apart_by_it(spark, rows):
    from claimloom.sources.tables import current_rows

    data = [(1, {"a": "x"}, 5), (1, {"a": "y"}, 5), (1, {"b": None}, 5)]
    first = [current_rows(rows("k int, m map<string,string>, t int", *d), "k", "t").first()["m"] for d in (data, data[::-1])]
    assert first[0] == first[1]
    assert current_rows(rows("k int, t int", (None, 1), (2, None)), "k", "t").count() == 1


def test_batches_run_over_all_ranges(rows):
    df = rows("id int, v string", *((i, "x") for i in range(97)), (None, "n")).repartition(5)
    from claimloom.operators import sections

    got = sorted(((-1 if r["id"] is None else r["id"]), r["batch"]) for r in sections.batches(df, "id", size=10).collect())
    assert got == [(i - 1, i // 10 + 1) for i in range(98)]


def test_a_parsed_null_overwrites_and_a_missing_field_does_not(rows):
    from claimloom.operators import upsert

    defaults = rows("k int, a string, b string", (1, "x", "y"), (2, "x", "y"), (3, "x", "y"))
    parsed = rows("k int, a string, b string, fields array<string>", (1, None, None, ["a"]), (2, "z", None, ["a", "b"]))
    assert {r["k"]: (r["a"], r["b"]) for r in upsert.overlay(defaults, parsed, "k").collect()} == {1: (None, "y"), 2: ("z", None), 3: ("x", "y")}


def test_answers_of_systems_and_names_of_model_files(spark, rows, tmp_path):
    import json

    from pyspark.sql import functions as F

    from claimloom.functions import text as T
    from claimloom.operators import render
    from claimloom.sources import files

    claim = {"source_name": "a", "relation_type": "r", "target_name": "b", "evidence_list": [{"evidence_text": "said", "paper_id": 3, "paper_year": "2020", "section_type": "RESULTS"}]}
    item = {"id": "q1", "question": "?", "answer": "x", "latency_seconds": 1.5, "context": {"vector_chunks": [{"paper_id": "3", "section_name": "s", "text": "t"}], "graph_paths": [{"claims": [claim, claim]}]}}
    (tmp_path / "c.json").write_text(json.dumps([item, {"id": "q2"}], indent=1))
    got = files.candidate_answers(spark, str(tmp_path / "c.json"))
    assert sorted((r["id"], r["answer"]) for r in got.collect()) == [("q1", "x"), ("q2", None)]
    paths = got.select(F.col("id").alias("path_signature"), F.explode("context.graph_paths").alias("p")).select("path_signature", "p.claims")
    assert [r["line"] for r in render.context_lines(paths).collect()] == ["(a) -[r]-> (b)\nEvidence (Paper 3, 2020, RESULTS): said"] * 2
    assert rows("m string", ("org/model:7b",)).select(T.model_file(F.col("m"))).first()[0] == "org_model_7b.json"


def test_a_prompt_has_its_claims_chains_and_passages(rows):
    claims = rows("claim_signature string, source_name string, relation_type string, target_name string, certainty_max string, paper_count int", ("a|r|b", "a", "r", "b", "high", 2), ("b|s|c", "b", "s", "c", None, None))
    evidence = rows("claim_signature string, evidence_id int, evidence_text string, paper_id int, section_type string", ("a|r|b", 1, "said", 7, "RESULTS"), ("b|s|c", 2, "told", 8, None))
    papers = rows("paper_id int, study_design string, published_year string", (7, "rct", "2020"))
    final = rows("path_signature string, length int, rank int", ("a|r|b", 1, 2), ("a|r|b>>b|s|c", 2, 1))
    found = rows("rank int, paper_id int, section_type string, section_name string, text string", (1, 7, "RESULTS", "Results", " words "))
    text = answer.answer_prompt("why?", final, claims, evidence, papers, found, {"A": "yes", "B": "no"}).first()[0]
    assert text.startswith("## QUESTION\nwhy?\n\n## OPTIONS\nA: yes\nB: no\n\n## GRAPH EVIDENCE\n[G1] a -> r -> b\n     Certainty: high | Papers: 2\n     - [P7, rct, 2020] [RESULTS] said\n\n[G2] CHAIN: a -> r -> b -> s -> c\n     Bridge: b\n     [G2.1] a -> r -> b\n")
    assert "     [G2.2] b -> s -> c\n          Certainty: ? | Papers: ?\n\n" in text and "[V1] Paper P7 | RESULTS | Results\n     Cite as: [V1 (P7)]\n     words\n" in text and "told" not in text
    nothing = answer.answer_prompt("why?", final.limit(0), claims, evidence, papers, found.limit(0)).first()[0]
    assert nothing == "## QUESTION\nwhy?\n\n## GRAPH EVIDENCE\n\n## PASSAGES\n\n## ANSWER\nAnswer from the evidence above and cite it inline by its labels."


@pytest.mark.parametrize("seed", range(3))
def test_scores_from_a_least_one_on_are_those_of_all(seed):
    import random

    random.seed(seed)
    word = lambda: "".join(random.choices("abcde", k=random.randrange(1, 7)))
    for _ in range(4000):
        a, b = (" ".join(word() for _ in range(random.randrange(1, 5))) for _ in "ab")
        whole, some = similarity.composite_ratio(a, b), similarity.composite_ratio(a, b, 70)
        assert some == whole or (some == 0 and whole < 70)
