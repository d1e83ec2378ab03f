"""The queries of this subpackage on the tables of a data directory, and their SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import canonical, frequency, mixture, neighbours, packing, residue, splitting, survivors
from claimloom.llm.tokens import VOCABULARY, token_count
from claimloom.sources.tables import current_rows, table

#: Parameters of the queries.
DIMENSIONS, NEIGHBOURS, SIMILAR = 64, 10, 0.9


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return canonical.current_registry(table(spark, d, "entity_registry"))


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every current registry record with its entry, or why it has none."""
    return canonical.map_to_terms(_registry(spark, d), table(spark, d, "canonical_terms"), table(spark, d, "forms_index"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The records that denote an entry."""
    return p1_terms(spark, d).where("status = 'matched'").select("record_id", "term_id")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The names without an entry, why, and how many records have them."""
    return canonical.unmatched_names(_registry(spark, d), p1_terms(spark, d))


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    records = _registry(spark, d)
    return records, survivors.entity_keys(records, table(spark, d, "canonical_terms"), table(spark, d, "forms_index"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records of one build and entity, with their group's survivor."""
    records, keys = _keys(spark, d)
    return survivors.duplicate_pairs(records, keys, survivors.best_records(records, keys))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group."""
    best = survivors.best_records(*_keys(spark, d))
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return best.select("build_id", "entity_key", "survivor_id", "n_records", "canonical_name", "entity_type", flat(F.col("key_properties")).alias("key_properties"), F.array_join("paper_ids", ",").alias("paper_ids"), "layers")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct name with its records and papers."""
    return frequency.marked_names(_registry(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The names too rare or too common."""
    return p3_counts(spark, d).where("mark IS NOT NULL").select("name_value", "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The points whose text is cut."""
    return splitting.oversized_points(table(spark, d, "vector_chunks")).select("point_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all points."""
    return splitting.split_chunks(table(spark, d, "vector_chunks"))


def _neighbours(spark: SparkSession, d: str, least: float | None = None) -> DataFrame:
    claims = table(spark, d, "claims").select("claim_id", "embedding", "embedded_at").where(neighbours.usable("embedding", DIMENSIONS))
    return neighbours.nearest(current_rows(claims, "claim_id", "embedded_at"), "claim_id", "embedding", DIMENSIONS, NEIGHBOURS, least=least)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of claims with a cosine of at least 0.9."""
    return neighbours.similar_pairs(_neighbours(spark, d, SIMILAR), "claim_id", SIMILAR)


def p5_knn(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar other claims of every claim."""
    return _neighbours(spark, d).select("claim_id", "neighbour", "rank", F.round("cosine", 6).alias("cosine"))


def _sized(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *columns, token_count("text", VOCABULARY).alias("n_tokens"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document in a container of each capacity."""
    return packing.pack(_sized(spark, d), table(spark, d, "pack_specs"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p6_pack(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture, with their copies."""
    return mixture.mix(_sized(spark, d, "source"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixture.share_report(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with residue in place of content."""
    return residue.residue(table(spark, d, "documents").select("doc_id", "source", "text")).where("residue IS NOT NULL").select("doc_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without them."""
    kept = residue.residue(table(spark, d, "documents")).where("residue IS NULL")
    return kept.select("doc_id", "source", "lang", F.length("text").alias("n_chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_survivors, p3_found, p3_counts, p4_found, p4_pieces, p5_found, p5_knn, p6_pack, p6_fill, p7_mix, p7_shares, p8_found, p8_clean)}

# White space as Unicode has it, for the engine that runs the SQL.
_WHITE = r"\t\n\x0b\x0c\r \x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NAMES = rf"""
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY updated_at DESC) AS nth FROM entity_registry) WHERE nth = 1),
named AS (SELECT record_id, paper_ids, trim(regexp_replace(lower(nfc_normalize(canonical_name)), '[{_WHITE}]+', ' ', 'g')) AS name_value FROM cur),
total AS (SELECT count(DISTINCT p) AS n FROM (SELECT unnest(paper_ids) AS p FROM cur)),
papers AS (SELECT name_value, count(DISTINCT p) AS n FROM (SELECT name_value, unnest(paper_ids) AS p FROM named) GROUP BY name_value),
counted AS (SELECT name_value, count(*) AS n_records FROM named WHERE name_value <> '' GROUP BY name_value),
marked AS (SELECT c.name_value, c.n_records, coalesce(p.n, 0) AS n_papers,
  CASE WHEN coalesce(p.n, 0) > 0.1 * total.n THEN 'common' WHEN p.n = 1 THEN 'rare' END AS mark FROM counted c LEFT JOIN papers p USING (name_value), total)
"""
_PAIRS = """
WITH good AS (SELECT claim_id, embedding::DOUBLE[] AS v, embedded_at FROM claims WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
cur AS (SELECT claim_id, v::DOUBLE[64] AS v FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY embedded_at DESC) AS nth FROM good) WHERE nth = 1)
"""
SQL = {
    "p3_counts": _NAMES + "SELECT name_value, n_records::BIGINT AS n_records, n_papers::BIGINT AS n_papers, mark FROM marked",
    "p3_found": _NAMES + "SELECT name_value, mark FROM marked WHERE mark IS NOT NULL",
    "p4_found": rf"SELECT point_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY loaded_at DESC) AS nth FROM vector_chunks) WHERE nth = 1 AND len(regexp_extract_all(text, '[^{_WHITE}]+')) > 400",
    "p5_found": _PAIRS + "SELECT a.claim_id AS claim_id_a, b.claim_id AS claim_id_b FROM cur a JOIN cur b ON a.claim_id < b.claim_id WHERE array_cosine_similarity(a.v, b.v) >= 0.9",
    "p5_knn": _PAIRS
    + ", ranked AS (SELECT a.claim_id, b.claim_id AS neighbour, array_cosine_similarity(a.v, b.v) AS c, row_number() OVER (PARTITION BY a.claim_id ORDER BY round(array_cosine_similarity(a.v, b.v), 12) DESC, b.claim_id) AS nth FROM cur a JOIN cur b ON a.claim_id <> b.claim_id) SELECT claim_id, neighbour, nth::INTEGER AS rank, round(c, 6) AS cosine FROM ranked WHERE nth <= 10",
}
