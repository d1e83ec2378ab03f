from claimloom.operators import sections
from claimloom.plans import build


def inputs(rows):
    entity = "canonical_name string, entity_type string, surface_form string, aliases array<string>, key_properties map<string,string>, paper_id int, section_type string, seq long"
    relation = "source_name string, source_type string, relation_type string, target_name string, target_type string, polarity string, certainty string, paper_id int, evidence string, section_type string, seq long"
    return (
        rows(entity, ("Nodular Goitre", "D", "NG", ["NG"], {}, 1, "RESULTS", 1), ("Nodular Goitres", "D", "goitres", [], {}, 2, "RESULTS", 2), ("Xalase", "M", "x", None, None, 1, None, 3), (None, "M", "x", None, None, 1, None, 4)),
        rows(relation, ("ng", "D", "r", "Xalase", "M", "positive", "high", 1, "said", "RESULTS", 1), ("Nodular Goitre", "D", "r", "xalase", "M", "negative", "low", 2, "", "RESULTS", 2), ("Nobody", "D", "r", "Xalase", "M", "positive", "low", 2, "e", "RESULTS", 3), ("", "D", "r", "Xalase", "M", None, None, 2, "e", "RESULTS", 4)),
        rows("paper_id int, study_design string", (1, "rct"), (2, None)),
        rows("paper_id int, chunk_idx int, header string, body string", (1, 0, "Results", "a " * 500), (1, 1, "Methods", "")),
    )


def test_a_build_makes_its_tables_and_resumes(spark, rows, tmp_path):
    plan = build.stages(*inputs(rows))
    log = build.run(spark, plan, str(tmp_path))
    assert {r["stage"]: (r["status"], r["rows"]) for r in log} == {"papers": ("built", 2), "entities": ("built", 2), "forms": ("built", 5), "relations": ("built", 4), "claims": ("built", 2), "evidence": ("built", 2), "target_edges": ("built", 1), "polarity_edges": ("built", 2), "points": ("built", 2)}
    claim = spark.read.parquet(f"{tmp_path}/claims.parquet").where("source_name = 'Nodular Goitre'").first()
    assert (claim["n_positive"], claim["n_negative"], claim["paper_ids"], claim["study_weight_max"], claim["certainty_max"]) == (1, 1, [1, 2], 0.9, "high")
    assert {r["status"] for r in build.run(spark, plan, str(tmp_path))} == {"skipped"}


def test_sections_without_content_give_the_full_text(rows):
    docs = rows("paper_id int, text string", (1, "Title\nIntro\nabc\nResults\ndef\nReferences\nx"), (2, "only text"))
    headers = rows("paper_id int, pos int, header string", (1, 1, "Intro"), (1, 2, "Results"), (1, 3, "References"), (2, 1, "References"))
    cut = sections.full_text_fallback(docs, headers)
    got = {(r["paper_id"], r["header"]): r["body"].strip() for r in sections.section_bodies(docs, cut).collect()}
    assert got == {(1, "Intro"): "abc", (1, "Results"): "def", (2, "Full Text"): "only text"}


def test_a_build_with_vectors_answers_a_question(spark, rows, tmp_path):
    from claimloom.operators import evaluation
    from claimloom.plans import answer
    from claimloom.providers import HashedWords

    mentions, relations, _, chunks = inputs(rows)
    papers = rows("paper_id int, study_design string, published_year string, title string, purpose_of_work string", (1, "rct", "2020", "Goitre", "To see"), (2, None, None, "Other", ""))
    plan, one = build.stages(mentions, relations, papers, chunks), HashedWords(16)
    log = build.run(spark, plan, str(tmp_path), embedder=one)
    assert {r["stage"]: r["rows"] for r in log if "vectors" in r["stage"]} == {"chunks_vectors": 2, "papers_vectors": 2, "evidence_vectors": 2, "claims_vectors": 2}
    assert {r["status"] for r in build.run(spark, plan, str(tmp_path), embedder=one)} == {"skipped"}
    assert evaluation.run_summary(build.log_rows(spark, log)).first()["failed"] == 0
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    claims = read("claims").join(read("claims_vectors").drop("text", "version"), "claim_signature")
    points = read("points").join(read("chunks_vectors").drop("text", "version"), "point_id")
    text = answer.ask("How is Nodular Goitre treated?", read("entities"), claims, read("evidence"), read("papers"), points, one).first()["prompt"]
    assert "[G1] Nodular Goitre -> r -> Xalase" in text and "[V1] Paper P1 | RESULTS | Results" in text and "[P1, rct, 2020] [RESULTS] said" in text
