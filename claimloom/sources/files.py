"""Files of the extraction stages: PDFs, chunk files, JSON of entities, relations, metadata, questions and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import chunk_body, chunk_header, is_skipped_section, natural_key, registry_section

ENTITY = "struct<entity_type:string,surface_form:string,canonical_name:string,normalized:boolean,aliases:array<string>,key_properties:map<string,string>,evidence:string>"
END = "struct<entity_type:string,canonical_name:string>"
RELATION = f"struct<relation_type:string,source_entity:{END},target_entity:{END},key_properties:map<string,string>,evidence:string,claim_polarity:string,claim_certainty:string,section_type:string>"
PAPER = "struct<paper_id:string,doi:string,title:string,published_year:string,author_list:array<string>,countries:array<string>,purpose_of_work:string,keywords:array<string>,study_design:string,pages:int,`keyword-page`:int,tables:int,figures:int>"
TABLE = "struct<table_id:int,table_type:string,section_label:string,caption:string,population:string,groups:array<string>,variables:array<string>,key_findings:array<string>,model_adjustments:array<string>>"
FIGURE = "struct<figure_id:int,figure_type:string,section_label:string,caption:string,population:string,outcome:string,groups:array<string>,key_findings:array<string>>"
QUESTION = "question string, options map<string,string>, answer string, answer_idx string, id string, split string, explanation string, link string, meta_info string"
CHUNK = "struct<paper_id:string,section_name:string,text:string>"
EVIDENCE = "struct<evidence_text:string,paper_id:int,paper_year:string,section_type:string>"
PATH = f"struct<claims:array<struct<source_name:string,relation_type:string,target_name:string,evidence_list:array<{EVIDENCE}>>>>"
CANDIDATE = f"id string, category string, question string, reasoning string, answer string, latency_seconds double, context struct<vector_chunks:array<{CHUNK}>,graph_paths:array<{PATH}>>"
TRUTH = "struct<id:string,category:string,question:string,sources:array<string>,answer:string>"


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def pdf_files(spark: SparkSession, directory: str, numeric: bool = False) -> DataFrame:
    """``path``, ``stem``, ``content`` of the PDFs of a folder, in natural order of their names; with ``numeric``, those named by a number, in its order."""
    rows = spark.read.format("binaryFile").load(directory).where(F.lower("path").endswith(".pdf")).select("path", _stem(F.col("path")).alias("stem"), "content")
    if numeric:
        return rows.where(F.col("stem").rlike(r"^\d+$")).orderBy(F.col("stem").cast("bigint"))
    return rows.orderBy(natural_key(F.regexp_extract("path", r"([^/]+)$", 1)), "stem")


def chunk_files(spark: SparkSession, directory: str) -> DataFrame:
    """``paper_id``, ``chunk_idx``, ``file``, ``header``, ``section_type``, ``body`` of the chunk files <paper>/<index>-<name>.md, without references and appendices. Invalid UTF-8 is replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(directory)
    text = F.decode(F.col("content"), "utf-8") if spark.conf.get("spark.sql.legacy.codingErrorAction", "false") == "true" else F.validate_utf8(F.make_valid_utf8(F.col("content").cast("string")))
    rows = raw.select(F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).cast("int").alias("paper_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), text.alias("text"))
    rows = rows.where(~is_skipped_section(F.col("file")))
    return rows.select("paper_id", F.expr("try_cast(regexp_extract(file, '^(\\\\d+)-', 1) AS int)").alias("chunk_idx"), "file", chunk_header(F.col("text")).alias("header"), registry_section(F.regexp_replace("file", r"\.md$", "")).alias("section_type"), chunk_body(F.col("text")).alias("body"))


def _json_texts(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(directory, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.select(F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).cast("int").alias("paper_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "value")


def _tolerant(value: Column, field: str, kind: str) -> Column:
    """The array under ``field`` of an object, or of the first object of an array; null where the text doesn't parse."""
    whole = f"struct<{field}:array<{kind}>>"
    return F.coalesce(F.from_json(value, whole)[field], F.from_json(value, f"array<{whole}>")[0][field])


def entity_files(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each entity mention of the *_entities.json files, in the order of papers, files and mentions (``seq`` within the file). Files that don't parse give no row: see ``bad_files``."""
    rows = _json_texts(spark, directory, "*_entities.json")
    each = rows.select("paper_id", "file", F.posexplode(_tolerant(F.col("value"), "entities", ENTITY)).alias("seq", "e"))
    return each.select("paper_id", "file", registry_section(F.regexp_replace("file", r"\.json$", "")).alias("section_type"), "seq", "e.*")


def relation_files(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each relation mention of the *_relations.json files."""
    rows = _json_texts(spark, directory, "*_relations.json")
    each = rows.select("paper_id", "file", F.posexplode(_tolerant(F.col("value"), "relations", RELATION)).alias("seq", "r"))
    return each.select(
        "paper_id", "seq", F.col("r.source_entity.canonical_name").alias("source_name"), F.col("r.source_entity.entity_type").alias("source_type"), "r.relation_type", F.col("r.target_entity.canonical_name").alias("target_name"),
        F.col("r.target_entity.entity_type").alias("target_type"), F.col("r.claim_polarity").alias("polarity"), F.col("r.claim_certainty").alias("certainty"), "r.evidence", registry_section(F.regexp_replace("file", r"\.json$", "")).alias("section_type"),
    )


def bad_files(spark: SparkSession, directory: str, pattern: str, field: str, kind: str) -> DataFrame:
    """``paper_id``, ``file``, ``value`` of the files that don't parse, for quarantine."""
    return _json_texts(spark, directory, pattern).where(_tolerant(F.col("value"), field, kind).isNull())


def metadata_files(spark: SparkSession, directory: str, pattern: str = "*.json") -> DataFrame:
    """One row for each paper of files {"papers": [..]}; a paper in several files comes from the last by name."""
    raw = spark.read.option("pathGlobFilter", pattern).text(directory, wholetext=True).select("value", F.col("_metadata.file_name").alias("_file"))
    rows = raw.select("_file", F.posexplode(F.from_json("value", f"struct<papers:array<{PAPER}>>")["papers"]).alias("_at", "p")).select("_file", "_at", "p.*")
    from claimloom.operators.registry import first_rows

    return first_rows(rows, "paper_id", F.desc("_file"), F.desc("_at")).drop("_file", "_at")


def question_file(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice questions of a JSON array."""
    return spark.read.option("multiLine", "true").schema(QUESTION).json(path)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Expected answers of a file {"answers": [..]}."""
    return spark.read.option("multiLine", "true").schema(f"answers array<{TRUTH}>").json(path).select(F.inline("answers"))


def candidate_answers(spark: SparkSession, path: str) -> DataFrame:
    """A system's answers with their retrieval context."""
    return spark.read.option("multiLine", "true").schema(CANDIDATE).json(path)
