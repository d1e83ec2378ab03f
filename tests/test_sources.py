import json

from pyspark.sql import functions as F

from claimloom import providers
from claimloom.functions import registration
from claimloom.sources import files, sinks
from claimloom.streaming import ingest


def test_chunk_and_pdf_files(spark, tmp_path):
    (tmp_path / "12").mkdir()
    (tmp_path / "12/2-3._results.md").write_bytes(b"Header: 3. Results\n" + b"=" * 50 + b"\n\nBody \xff text\n")
    (tmp_path / "12/9-references.md").write_text("Header: References\n")
    row = files.chunk_files(spark, str(tmp_path)).collect()
    assert len(row) == 1 and (row[0]["paper_id"], row[0]["chunk_idx"], row[0]["header"], row[0]["section_type"]) == (12, 2, "3. Results", "RESULTS")
    assert row[0]["body"].startswith("Body ") and row[0]["body"].endswith(" text")
    for name in ("10.pdf", "9.PDF", "x2.pdf", "note.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    assert [r["stem"] for r in files.pdf_files(spark, str(tmp_path)).collect()] == ["x2", "9", "10"]
    assert [r["stem"] for r in files.pdf_files(spark, str(tmp_path), numeric=True).collect()] == ["9", "10"]


def test_json_files(spark, tmp_path):
    (tmp_path / "3").mkdir()
    one = {"entities": [{"entity_type": "Gene", "canonical_name": "TG", "aliases": ["a"], "key_properties": {"k": "v", "n": None}}]}
    (tmp_path / "3/1-abstract_entities.json").write_text(json.dumps(one))
    (tmp_path / "3/2-results_entities.json").write_text(json.dumps([one], indent=2))
    (tmp_path / "3/4-x_entities.json").write_text("{broken")
    rel = {"relations": [{"relation_type": "r", "source_entity": {"canonical_name": "A"}, "target_entity": {"canonical_name": "B"}, "claim_polarity": "negative"}, {"relation_type": "r", "source_entity": "A", "target_entity": {"canonical_name": "B"}}]}
    (tmp_path / "3/1-abstract_relations.json").write_text(json.dumps(rel))
    got = files.entity_files(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r["paper_id"], r["section_type"], r["canonical_name"], r["key_properties"]) for r in got] == [(3, "ABSTRACT", "TG", {"k": "v", "n": None}), (3, "RESULTS", "TG", {"k": "v", "n": None})]
    assert [r["file"] for r in files.bad_files(spark, str(tmp_path), "*_entities.json", "entities", files.ENTITY).collect()] == ["4-x_entities.json"]
    assert [(r["source_name"], r["polarity"]) for r in files.relation_files(spark, str(tmp_path)).orderBy("seq").collect()] == [("A", "negative"), (None, None)]
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/a.json").write_text(json.dumps({"papers": [{"paper_id": "1", "title": "old", "keyword-page": 2}, {"paper_id": "2"}]}))
    (tmp_path / "meta/b.json").write_text(json.dumps({"papers": [{"paper_id": "1", "title": "new"}]}, indent=2))
    assert {r["paper_id"]: r["title"] for r in files.metadata_files(spark, str(tmp_path / "meta")).collect()} == {"1": "new", "2": None}
    (tmp_path / "q.json").write_text(json.dumps([{"question": "?", "options": {"A": "x"}, "answer": "x", "answer_idx": "A"}]))
    q = files.question_file(spark, str(tmp_path / "q.json")).first()
    assert q["options"][q["answer_idx"]] == q["answer"]
    (tmp_path / "t.json").write_text(json.dumps({"answers": [{"id": 1, "answer": "g"}]}))
    assert files.ground_truth(spark, str(tmp_path / "t.json")).first()["answer"] == "g"


def test_sinks(spark, rows, tmp_path):
    path = str(tmp_path / "papers")
    sinks.write_upsert(rows("k int, v string, t int", (1, "a", 1), (2, "b", 1)), path, "k", "t")
    sinks.write_upsert(rows("k int, v string, t int", (2, "c", 2)), path, "k", "t")
    sinks.append_new(rows("k int, v string, t int", (2, "z", 3), (3, "d", 3), (3, "d", 3)), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.write_parsed(rows("raw string, p string", ("x", None), ("y", "1")), "p", str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == spark.read.json(str(tmp_path / "bad")).count() == 1


def test_streams_append_what_is_new_and_resume(spark, rows, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    data = rows("id long, ts timestamp_ntz, kind string, value double", *((i, None, "a", 1.0) for i in range(5))).withColumn("ts", F.lit("2024-01-01 00:10:00").cast("timestamp_ntz"))
    for batch in (data, data.unionAll(data.withColumn("id", F.col("id") + 5))):
        batch.write.mode("append").parquet(source)
        ingest.append_new_stream(ingest.file_stream(spark, source, data.schema), target, "id", check).awaitTermination()
    assert spark.read.parquet(target).count() == 10
    stream = ingest.distinct_events(ingest.file_stream(spark, source, data.schema), "id", "ts")
    query = stream.writeStream.format("memory").queryName("seen").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("seen").count() == 10
    counts = ingest.windowed_counts(data, "ts", "kind", "value").collect()
    assert [(r["kind"], r["n"], r["total"]) for r in counts] == [("a", 5, 5.0)]
    assert ingest.sessions(data, "ts", "kind").first()["n"] == 5


def test_providers(rows):
    calls = []

    class Flaky:
        def complete(self, requests):
            if not calls:
                calls.append(1)
                raise OSError
            return [r.upper() for r in requests]

    assert providers.with_retries(Flaky().complete, ["a"], wait=0) == ["A"]
    df = rows("r string", ("a",), (None,)).coalesce(1)
    assert [r[0] for r in df.select(providers.completed("r", Flaky(), wait=0)).collect()] == ["A", None]
    v = [r[0] for r in rows("t string", ("thyroid gland",), ("gland thyroid",), (None,)).select(providers.embedded("t", providers.HashedWords(16))).collect()]
    assert v[0] == v[1] and len(v[0]) == 16 and v[2] is None
    fixed = rows("r string, a string, b string", ("1", "x", ""), ("2", "x", "y"))
    assert [r[0] for r in fixed.select(providers.corrected(fixed, "a", "b")).collect()] == ["x", "y"]
    assert providers.replayed(fixed, rows("r string, response string", ("1", "ok")), "r").where("response = 'ok'").count() == 1


def test_functions_for_sql(spark):
    registration.register(spark)
    assert spark.sql("SELECT word_count(' a  b '), cosine(array(1D, 0D), array(1D, 1D)), claim_signature('a', 'r', 'b'), name_ratio('ab', 'ab')").first()[:] == (2, 1 / 2**0.5, "a|r|b", 100.0)
    assert [r["text"] for r in spark.sql("SELECT * FROM word_windows('a b c d e', 3, 2)").collect()] == ["a b c", "c d e"]
    assert spark.sql("SELECT * FROM token_spans('a b', 2)").count() == 3
