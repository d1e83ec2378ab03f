"""All queries of the engine's core. Their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom import config, providers
from claimloom.functions import text as T
from claimloom.functions.vector import cosine
from claimloom.lineage import cut
from claimloom.operators import evaluation, graph, profile, ranking, registry, render, search, sections, upsert
from claimloom.oracle import SQL  # noqa: F401
from claimloom.plans import answer, embedding, extraction, retrieval, views
from claimloom.sources.tables import current_rows, table
from claimloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: What the graph queries ask about, and which of it is generic. The query vector is the embedding with vec_id 0.
NAMES = ["Rirsemflav Neck Swelling", "Hurlohi Neck Swelling", "Skuvdaewis Signalling Pathway", "Autoimmune Thyroiditis"]
GENERIC = ["Autoimmune Thyroiditis"]
QUESTION = "How does Rirsemflav Neck Swelling relate to Hurlohi Neck Swelling and the Skuvdaewis Signalling Pathway in Autoimmune Thyroiditis?"
FLAGSHIP = "hybrid_rank"
#: What the entity registry reads of a mention.
MENTION = ("canonical_name", "entity_type", "surface_form", "aliases", "key_properties", "paper_id", "section_type")


def query(f: Query) -> Query:
    """Register a query under its name."""
    QUERIES[f.__name__] = f
    return f


def rounded(c: Column | str) -> Column:
    """Six decimals, for comparison across engines."""
    return F.round(c, 6)


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = views.weighted_claims(spark, d, views.claims(spark, d, "embedding"))
    return retrieval.scored_claims(rows, views.evidence(spark, d, rows), _query_vector(spark, d))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The weighted claims that the question's entities touch, found once, and their evidence."""
    rows = cut(views.weighted_claims(spark, d, graph.touching(views.claims(spark, d, "embedding"), NAMES)))
    return rows, views.evidence(spark, d, rows)


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.candidate_paths(retrieval.question_claims(*_asked(spark, d), NAMES, _query_vector(spark, d)), NAMES, GENERIC)


def _stem(c: str = "chunk_filename") -> Column:
    return F.regexp_replace(c, r"\.[^.]*$", "")


# --- claim and entity registries


@query
def claim_registry_agg(spark: SparkSession, d: str) -> DataFrame:
    """A1, A1a-e: claims of relation mentions."""
    rows = registry.claim_registry(views.relation_mentions(spark, d))
    return rows.select("claim_signature", "source_type", "target_type", *(f"n_{p}" for p in config.POLARITIES), "certainty_max", "paper_count", "mentions", "evidence_count")


@query
def certainty_max(spark: SparkSession, d: str) -> DataFrame:
    """A1b over the claims of a relation and target."""
    rank = T.weight(F.col("certainty_max"), config.CERTAINTY_RANKS, -1)
    rows = views.claims(spark, d).groupBy("relation_type", "target_name").agg(F.max_by("certainty_max", F.struct(rank, -F.col("claim_id"))).alias("certainty_max"), F.count("*").alias("claims"))
    return rows


@query
def claim_first_type(spark: SparkSession, d: str) -> DataFrame:
    """A1e, A2b: the type that an entity has in its first mention."""
    rows = views.mentions(spark, d, "canonical_name", "entity_type").where(T.stripped(F.coalesce("canonical_name", F.lit(""))) != "")
    return rows.groupBy(F.lower(T.stripped("canonical_name")).alias("name")).agg(F.min_by(F.coalesce("entity_type", F.lit("")), "seq").alias("entity_type"), F.count("*").alias("mentions"))


@query
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    """A1d, K7: distinct evidence with stable ids, counted by claim."""
    rows = registry.evidence_rows(views.relation_mentions(spark, d))
    return rows.groupBy("claim_signature").agg(F.count("*").alias("evidence"), F.countDistinct("evidence_id").alias("ids"), F.min("evidence_id").alias("least_id"))


@query
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    """Entities of mentions."""
    rows = registry.entity_registry(views.mentions(spark, d, *MENTION))
    return rows.select("canonical_name", "entity_type", F.size("aliases").alias("aliases"), "filled_properties", F.array_join("paper_ids", ",").alias("paper_ids"), F.array_join("section_types", ",").alias("section_types"), F.size("surface_forms").alias("surface_forms"), "mentions")


@query
def forms_collision(spark: SparkSession, d: str) -> DataFrame:
    """A3: the entity that each form stands for."""
    return registry.forms_index(registry.entity_registry(views.mentions(spark, d, *MENTION)))


@query
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Claims with both ends led to canonical names."""
    forms = table(spark, d, "forms_index").where("form IS NOT NULL").groupBy("form").agg(F.max("canonical_name").alias("canonical_name"))
    rows = views.claims(spark, d).select("claim_id", F.col("source_name").alias("source_as_written"), "source_name", "target_name")
    return registry.resolve_names(rows, forms, "source_name", "target_name")


@query
def protected_aliases(spark: SparkSession, d: str) -> DataFrame:
    """aliases of the reference list without protected names of other entries; here genes are protected."""
    rows = table(spark, d, "canonical_terms")
    genes = [r[0] for r in rows.where("entity_type = 'Gene'").select("canonical").limit(10_001).collect()]
    if len(genes) > 10_000:
        raise ValueError("too many protected names for a literal list")
    return rows.select("term_id", F.array_join(registry.safe_aliases(F.col("aliases"), F.col("canonical"), genes), "|").alias("aliases"))


@query
def claim_paper_weight(spark: SparkSession, d: str) -> DataFrame:
    """The best study weight of each claim."""
    return views.weighted_claims(spark, d).select("claim_id", "study_weight_max")


@query
def malformed_relations(spark: SparkSession, d: str) -> DataFrame:
    """well- and malformed claims by relation."""
    ok = registry.is_well_formed("source_name", "relation_type", "target_name")
    return table(spark, d, "claims").groupBy("relation_type").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("malformed"))


@query
def relation_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """Claims by whether their relation is known, and whether a methods section may hold it."""
    rows = views.claims(spark, d)
    return rows.groupBy(F.col("relation_type").isin(config.RELATION_TYPES).alias("known"), F.col("relation_type").isin(config.METHODS_RELATIONS).alias("in_methods")).agg(F.count("*").alias("claims"))


@query
def relation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """F32: claims by whether the vocabulary allows their relation between the types of their ends, which the reference list gives."""
    types = table(spark, d, "canonical_terms").groupBy(F.col("canonical").alias("_name")).agg(F.min("entity_type").alias("_type"))
    end = lambda side: types.select(F.col("_name").alias(f"{side}_name"), F.col("_type").alias(f"{side}_type"))
    rows = views.claims(spark, d).select("source_name", "relation_type", "target_name").join(end("source"), "source_name", "left").join(end("target"), "target_name", "left")
    return registry.checked_relations(rows, registry.relation_ends(spark)).groupBy("relation_type", "verdict").agg(F.count("*").alias("claims"))


@query
def methods_relations(spark: SparkSession, d: str) -> DataFrame:
    """evidence by relation and section, without what a methods section may not hold."""
    rows = views.evidence(spark, d).join(views.claims(spark, d).select("claim_signature", "relation_type"), "claim_signature")
    return registry.section_relations(rows).groupBy("relation_type", "section_type").agg(F.count("*").alias("evidence"))


@query
def ontology_join(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with the entry of their name and type."""
    rows = registry.enriched(views.mentions(spark, d, "canonical_name", "entity_type"), table(spark, d, "canonical_terms"))
    return rows.select("mention_id", "ontology")


@query
def entity_lists(spark: SparkSession, d: str) -> DataFrame:
    """the entities of every paper as a list, in the order of their mentions."""
    rows = views.mentions(spark, d, "paper_id", "canonical_name", "entity_type")
    items = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("mention_id", "canonical_name", "entity_type"))).alias("e"))
    return items.select("paper_id", F.md5(render.entity_list(F.col("e"))).alias("digest"))


# --- names


@query
def token_sort_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Canonical names that resemble each other."""
    names = table(spark, d, "canonical_terms").select(F.col("canonical").alias("name"), F.col("term_id").alias("seq")).dropDuplicates(["name"])
    return registry.fuzzy_pairs(names).select("early", "late", rounded("score").alias("score"))


@query
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The greedy merge of mention names, in order of their first mention."""
    rows = views.mentions(spark, d, "canonical_name").where(T.stripped(F.coalesce("canonical_name", F.lit(""))) != "").select(T.stripped("canonical_name").alias("name"), "seq")
    names = rows.groupBy(F.lower("name").alias("_key")).agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq")).drop("_key")
    return registry.greedy_leaders(names, registry.fuzzy_pairs(names))


@query
def span_match(spark: SparkSession, d: str) -> DataFrame:
    """The entities a question names."""
    found = retrieval.match_entities(retrieval.spans(spark, QUESTION), views.entities(spark, d))
    return found.select("canonical_name", rounded("score").alias("score"))


@query
def ngram_spans(spark: SparkSession, d: str) -> DataFrame:
    """The distinct n-grams of every paper title, with how many titles hold them."""
    rows = views.papers(spark, d, "title").where("title IS NOT NULL").select("paper_id", F.explode(T.ngrams(F.col("title"))).alias("g"))
    return rows.groupBy(F.lower("g.span").alias("span")).agg(F.countDistinct("paper_id").alias("papers"), F.max("g.n").alias("n"))


# --- graph


@query
def constraint_check(spark: SparkSession, d: str) -> DataFrame:
    """K1: keys that break uniqueness, by table, as delivered."""
    check = lambda name, key: graph.duplicate_keys(table(spark, d, name), key).agg(F.count("*").alias("broken_keys"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).select(F.lit(name).alias("table_name"), "broken_keys", "rows")
    return check("papers", "paper_id").unionByName(check("claims", "claim_id")).unionByName(check("canonical_terms", "term_id")).unionByName(check("entity_mentions", "mention_id"))


@query
def target_edges(spark: SparkSession, d: str) -> DataFrame:
    """K5: claims whose both ends are on the reference list."""
    return graph.target_edges(views.claims(spark, d), views.entities(spark, d))


@query
def polarity_edges(spark: SparkSession, d: str) -> DataFrame:
    """K6: edges by polarity."""
    return graph.polarity_edges(views.claims(spark, d), views.entities(spark, d))


@query
def evidence_edges(spark: SparkSession, d: str) -> DataFrame:
    """K7: evidence with its claim and paper."""
    rows = views.evidence(spark, d)
    return rows.join(views.papers(spark, d, "paper_id"), "paper_id", "left_semi").select("claim_signature", "evidence_id", "paper_id")


@query
def onehop_specific(spark: SparkSession, d: str) -> DataFrame:
    """Direct claims of the named entities."""
    return graph.one_hop(views.claims(spark, d), NAMES, GENERIC).select("claim_signature", "source_name", "target_name", F.coalesce("paper_count", F.lit(0)).alias("paper_count"))


@query
def onehop_generic_specific(spark: SparkSession, d: str) -> DataFrame:
    """Direct claims between specific and generic ones."""
    return graph.generic_specific(views.claims(spark, d), NAMES, GENERIC).select("claim_signature")


@query
def evidence_join(spark: SparkSession, d: str) -> DataFrame:
    """All claims with their evidence lists, the best two as text."""
    lists = graph.evidence_lists(views.evidence(spark, d), views.papers(spark, d, "study_design", "published_year"), config.EVIDENCE_PER_CLAIM)
    rows = views.claims(spark, d).join(lists, "claim_signature", "left")
    return rows.select("claim_signature", F.coalesce(F.size("evidence_list"), F.lit(0)).alias("n"), F.coalesce(F.array_join(F.col("evidence_list.evidence_text"), " / "), F.lit("")).alias("texts"))


@query
def anchored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of matched entities."""
    return graph.anchor_pairs(retrieval.literal_names(spark, NAMES), GENERIC)


@query
def twohop_paths(spark: SparkSession, d: str) -> DataFrame:
    """Chains between every two matched entities."""
    pairs = anchored_pairs(spark, d)
    return graph.two_hop(views.claims(spark, d), pairs, ["relation_type"], GENERIC).select("path_signature", "source_name", "bridge_name", "target_name")


@query
def merge_paths(spark: SparkSession, d: str) -> DataFrame:
    """Direct paths and chains, with their anchors."""
    return _paths(spark, d).select("path_signature", "length", F.array_join(ranking.anchors(F.col("entities"), NAMES), "|").alias("anchors"))


@query
def hop_counts(spark: SparkSession, d: str) -> DataFrame:
    """Paths by length."""
    return evaluation.hop_counts(_paths(spark, d))


@query
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """Claims in and out of every entity, over the whole graph."""
    alive = graph.reachable(views.claims(spark, d))
    ends = alive.select(F.col("source_name").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(alive.select("target_name", F.lit(0), F.lit(1)))
    return ends.groupBy("name").agg(F.sum("o").alias("claims_out"), F.sum("i").alias("claims_in"))


# --- ranking


@query
def claim_quality(spark: SparkSession, d: str) -> DataFrame:
    """The quality of every claim."""
    return _scored(spark, d).select("claim_signature", rounded("quality").alias("quality"))


@query
def path_quality(spark: SparkSession, d: str) -> DataFrame:
    """A5, F16: the quality of every path."""
    return _paths(spark, d).select("path_signature", rounded("quality").alias("quality"))


@query
def quality_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """The candidates for re-ranking."""
    rows = ranking.pre_filter(cut(_paths(spark, d)), [n for n in NAMES if n not in GENERIC], NAMES)
    return rows.select("path_signature", rounded("quality").alias("quality"))


@query
def entity_bucket_topk(spark: SparkSession, d: str) -> DataFrame:
    """W11 over the whole graph: the best five claims of every entity."""
    rows = _scored(spark, d).select("claim_signature", rounded("quality").alias("quality"), F.explode(F.array_distinct(F.array("source_name", "target_name"))).alias("entity"))
    window = Window.partitionBy("entity").orderBy(F.desc("quality"), "claim_signature")
    return rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= config.BUCKET)


@query
def quota_spill(spark: SparkSession, d: str) -> DataFrame:
    """Quotas with spill-over, by quality."""
    rows = _paths(spark, d).withColumn("score", rounded("quality")).withColumn("both_ends", ranking.has_both_ends(F.col("entities"), NAMES))
    return ranking.quotas(rows, "score").select("path_signature", "length", "score", "rank")


@query
def evidence_topk(spark: SparkSession, d: str) -> DataFrame:
    """The two best evidences of every claim."""
    lists = graph.evidence_lists(views.evidence(spark, d), views.papers(spark, d, "study_design", "published_year"), config.EVIDENCE_PER_CLAIM)
    return lists.select("claim_signature", F.inline("evidence_list")).select("claim_signature", F.col("_nth").alias("place"), "paper_id", "section_type", "evidence_text")


@query
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: final paths of the question."""
    final = retrieval.final_paths(*_asked(spark, d), NAMES, _query_vector(spark, d), GENERIC)
    return final.select("rank", "path_signature", "length", rounded("hybrid").alias("hybrid"), rounded("quality").alias("quality"))


# --- vectors


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight embeddings nearest to the query."""
    rows = search.nearest_to(table(spark, d, "embeddings"), "embedding", _query_vector(spark, d), "vec_id")
    return rows.select("vec_id", rounded("score").alias("score"))


@query
def vector_check(spark: SparkSession, d: str) -> DataFrame:
    """K8: claims without a sound vector."""
    return search.wrong_vectors(table(spark, d, "claims"), "embedding", 64).groupBy(F.coalesce(F.size("embedding"), F.lit(-1)).alias("length")).agg(F.count("*").alias("rows"))


@query
def cosine_matrix_label(spark: SparkSession, d: str) -> DataFrame:
    """the cosine of every embedding to the query, averaged by label."""
    spoken = F.array(*(F.lit(float(x)) for x in _query_vector(spark, d)))
    return table(spark, d, "embeddings").withColumn("c", cosine(F.col("embedding"), spoken)).groupBy("label").agg(rounded(F.avg("c")).alias("mean"), rounded(F.max("c")).alias("greatest"), F.count("*").alias("n"))


@query
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    """what of a paper is embedded."""
    return views.papers(spark, d, "purpose_of_work", "title").select("paper_id", T.or_default(F.col("purpose_of_work"), F.coalesce("title", F.lit(""))).alias("embed_text"))


@query
def claim_texts(spark: SparkSession, d: str) -> DataFrame:
    """the text of every claim, with its two first evidences."""
    lists = graph.evidence_lists(views.evidence(spark, d), views.papers(spark, d, "study_design", "published_year"), 2)
    rows = views.claims(spark, d).join(lists, "claim_signature", "left")
    head = F.concat_ws(" ", "source_name", "relation_type", "target_name")
    return rows.select("claim_signature", F.concat_ws(". ", head, F.array_join(F.col("evidence_list.evidence_text"), ". ")).alias("claim_text"))


@query
def reembed_changed(spark: SparkSession, d: str) -> DataFrame:
    """chunks whose text differs from their earliest delivery, so that they have to be embedded again."""
    rows = table(spark, d, "vector_chunks").select("point_id", "text", "loaded_at")
    first = registry.first_rows(rows, "point_id", F.col("loaded_at"), F.col("text").asc_nulls_first())
    last = registry.first_rows(rows, "point_id", F.desc("loaded_at"), F.col("text").asc_nulls_last())
    return upsert.changed_texts(last, first, "point_id", "text").select("point_id")


# --- text


@query
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """The word windows of every document."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("window_index", "window"))
    return rows.select("doc_id", "window_index", T.word_count(F.col("window")).alias("words"), F.md5("window").alias("digest"))


@query
def whole_window_ids(spark: SparkSession, d: str) -> DataFrame:
    """Window counts and point ids of every section, also of those that an earlier run cut."""
    rows = sections.whole_sections(views.chunks(spark, d, "paper_id", "text")).select("paper_id", "chunk_idx", T.windows(F.col("text")).alias("w"))
    each = rows.select("paper_id", "chunk_idx", F.size("w").alias("window_count"), F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("window_index"))
    return each.select((F.col("paper_id").cast("long") * 1000000 + F.col("chunk_idx") * 1000 + F.col("window_index")).alias("point_id"), "window_index", "window_count")


@query
def section_type_registry(spark: SparkSession, d: str) -> DataFrame:
    """section types and names of chunk files."""
    rows = views.chunks(spark, d, "chunk_filename").where("chunk_filename IS NOT NULL")
    return rows.select("point_id", T.registry_section(_stem()).alias("section"), T.section_display(_stem()).alias("display"))


@query
def section_type_rich(spark: SparkSession, d: str) -> DataFrame:
    """section types of headers, by the longer list."""
    rows = views.chunks(spark, d, "section_name").where("section_name IS NOT NULL")
    return rows.groupBy(T.rich_section(F.col("section_name")).alias("section"), T.registry_section(F.col("section_name")).alias("narrow")).agg(F.count("*").alias("n"))


@query
def skip_sections(spark: SparkSession, d: str) -> DataFrame:
    """Which chunk files are skipped, and their safe names."""
    rows = views.chunks(spark, d, "chunk_filename", "section_name").where("chunk_filename IS NOT NULL")
    return rows.select("point_id", T.is_skipped_section(F.col("chunk_filename")).alias("skipped"), F.coalesce(T.is_content_section(F.col("section_name")), F.lit(True)).alias("content"), T.safe_filename(F.coalesce("section_name", F.lit(""))).alias("safe_name"))


def _structure(spark: SparkSession, d: str) -> DataFrame:
    rows = views.chunks(spark, d, "paper_id", "section_name", "section_type").where("section_name IS NOT NULL")
    name = F.regexp_replace(T.stripped("section_name"), r"[\s*]+", " ")
    mark = F.when(F.col("section_type") == "OTHER", "    * ").otherwise("* ")
    return rows.select("paper_id", F.col("point_id").alias("pos"), F.concat(mark, name).alias("line"))


@query
def structure_parse(spark: SparkSession, d: str) -> DataFrame:
    """Headers and subheaders; sections of type OTHER count as subheaders."""
    rows = sections.parse_structure(sections.clean_lines(_structure(spark, d)))
    return rows.select("paper_id", F.col("header_no").cast("long").alias("header_no"), "header", F.array_join("subheaders", "|").alias("subheaders"))


@query
def next_header(spark: SparkSession, d: str) -> DataFrame:
    """Where sections end."""
    rows = views.chunks(spark, d, "paper_id", "section_name").where("section_name IS NOT NULL").select("paper_id", F.col("point_id").alias("pos"), T.stripped("section_name").alias("header"))
    return sections.section_ends(rows)


@query
def batch_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Papers in batches of ten."""
    return sections.batches(views.papers(spark, d, "paper_id").select("paper_id"), "paper_id")


@query
def think_strip_parse(spark: SparkSession, d: str) -> DataFrame:
    """Responses built of claims, parsed again."""
    rows = views.claims(spark, d).select("claim_id", F.concat(F.lit("<think>a\nb</think>\n```json\n"), F.to_json(F.struct("relation_type", "paper_count")), F.lit("\n```")).alias("r"), F.concat(F.lit("<thinking>x </thinking>```json {\"metadata\": "), F.to_json(F.struct("claim_id", "target_name")), F.lit("}```")).alias("m"))
    return rows.select("claim_id", F.get_json_object(T.response_json(F.col("r")), "$.relation_type").alias("relation_type"), F.get_json_object(T.metadata_json(F.col("m")), "$.target_name").alias("target_name"))


@query
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """the properties of events, parsed."""
    rows = table(spark, d, "events")
    return rows.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count_if(F.try_parse_json("props").isNull()).alias("bad"), F.count("*").alias("n"))


@query
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Chunk files in natural order of their names, within their paper."""
    rows = views.chunks(spark, d, "paper_id", "chunk_filename").where("chunk_filename IS NOT NULL").select("paper_id", "point_id", "chunk_filename")
    window = Window.partitionBy("paper_id").orderBy(T.natural_key(F.col("chunk_filename")), "chunk_filename", "point_id")
    return rows.select("point_id", F.row_number().over(window).alias("place"))


# --- profiles


@query
def chunk_profile(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of every chunk."""
    return _profile(spark, d)


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.chunk_profile(views.chunks(spark, d, "paper_id", "chunk_filename", "text"))


@query
def describe_words(spark: SparkSession, d: str) -> DataFrame:
    """Summary of the sizes."""
    rows = profile.describe(_profile(spark, d), "word_count", "char_count", "line_count")
    return rows.select("column_name", "count", *(rounded(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")))


@query
def sections_per_paper(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each paper, and whether it has one only."""
    rows = profile.group_sizes(views.chunks(spark, d, "paper_id"), "paper_id")
    return rows.withColumn("single", F.col("n") == 1)


@query
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return profile.percentiles(_profile(spark, d), "word_count")


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    rows = profile.threshold_sweep(_profile(spark, d), "word_count")
    return rows.select("threshold", "n", rounded("n_share").alias("n_share"), "total", rounded("total_share").alias("total_share"))


@query
def value_counts_top25(spark: SparkSession, d: str) -> DataFrame:
    """The 25 most frequent section names."""
    return profile.value_counts(_profile(spark, d).where("section IS NOT NULL"), F.col("section"), "section", top=25)


@query
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    """50 bins of word counts."""
    return profile.histogram(_profile(spark, d), "word_count", 50)


@query
def longest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The 20 longest chunks."""
    return _profile(spark, d).orderBy(F.desc("word_count"), "point_id").limit(20).select("point_id", "word_count")


@query
def stub_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that are stubs or very long."""
    return _profile(spark, d).where("word_count < 30 OR word_count > 2500").select("point_id", "word_count")


@query
def papers_per_year(spark: SparkSession, d: str) -> DataFrame:
    """Papers by year, with shares."""
    rows = profile.value_counts(views.papers(spark, d, "published_year"), T.stripped("published_year"), "year", share=True)
    return rows.select("year", "n", rounded("share").alias("share"))


@query
def paper_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of pages, tables and figures."""
    return profile.range_of(views.papers(spark, d, "pages", "n_tables", "n_figures"), "pages", "n_tables", "n_figures")


@query
def keyword_categories(spark: SparkSession, d: str) -> DataFrame:
    """papers by number of tables, in four categories."""
    c = F.col("n_tables")
    kind = F.when(c.isNull() | (c == 0), "none").when(c == 1, "one").when(c == 2, "two").otherwise("more")
    return profile.value_counts(views.papers(spark, d, "n_tables"), kind, "category")


@query
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    """Nulls of every column."""
    return profile.null_counts(table(spark, d, "papers"))


@query
def doi_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    rows = profile.coverage(views.papers(spark, d, "doi"), "doi")
    return rows.select("filled", "rows", rounded("share").alias("share"))


@query
def explode_counts(spark: SparkSession, d: str) -> DataFrame:
    """Papers by country."""
    return profile.exploded_counts(views.papers(spark, d, "countries"), "countries", "country").select("country", "n", rounded("share").alias("share"))


@query
def list_size_dist(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of countries."""
    return profile.size_distribution(views.papers(spark, d, "countries"), "countries")


@query
def design_weights(spark: SparkSession, d: str) -> DataFrame:
    """Papers by design, with its weight."""
    design = T.or_default(F.col("study_design"), "other")
    return views.papers(spark, d, "study_design").groupBy(design.alias("design")).agg(F.count("*").alias("n"), F.max(T.weight(design, config.DESIGN_WEIGHTS, config.UNKNOWN_DESIGN)).alias("weight"))


# --- stored tables, evaluation, rendering


@query
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """K2-K4: the papers of the first half of deliveries, overlaid by the rest."""
    rows = table(spark, d, "papers").select("paper_id", "title", "pages", "ingested_at")
    even = F.col("pages") % 2 == 0
    stored = registry.first_rows(rows.where(even), "paper_id", F.desc("ingested_at"), F.col("title"))
    return upsert.upsert(stored, rows.where(~even | F.col("pages").isNull()), "paper_id", "ingested_at").select("paper_id", "pages")


@query
def whole_skip_existing(spark: SparkSession, d: str) -> DataFrame:
    """The windows of whole sections that are not stored yet."""
    return upsert.new_rows(whole_window_ids(spark, d), table(spark, d, "vector_chunks"), "point_id")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in scores: a claim's polarity shares as four metrics, null where it has no count."""
    total = F.col("n_positive") + F.col("n_negative") + F.col("n_hypothetical") + F.col("n_uncertain") + F.col("n_mixed")
    share = [F.when(total > 0, F.col(f"n_{p}") / total) for p in config.EDGE_POLARITIES] + [F.when(F.col("certainty_max").isNotNull(), T.weight(F.col("certainty_max"), config.CERTAINTY_WEIGHTS, 0.2))]
    items = F.array(*(F.struct(F.lit(m).alias("metric"), s.alias("score")) for m, s in zip(config.JUDGE_METRICS, share)))
    return views.claims(spark, d).select(F.col("claim_id").alias("id"), F.inline(items))


@query
def eval_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the metrics."""
    return evaluation.metric_means(_scores(spark, d)).select("metric", rounded("mean").alias("mean"), "n")


@query
def ragas_row(spark: SparkSession, d: str) -> DataFrame:
    """The mean of an item's four metrics."""
    return evaluation.wide_scores(_scores(spark, d)).select("id", rounded("overall").alias("overall"))


@query
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Claims as answers, scored against their first paper's title by the words they share, without retrieval context."""
    rows = views.claims(spark, d, "embedding_text")
    truth = views.papers(spark, d, "title").select(F.col("paper_id").alias("id"), F.col("title").alias("expected"))
    cases = rows.select("claim_id", F.element_at("paper_ids", 1).alias("id"), F.concat_ws(" ", "source_name", "target_name").alias("question"), F.col("embedding_text").alias("answer"), F.col("embedding_text").alias("context")).join(truth, "id")
    scored = providers.judged_scores(cases, "claim_id", providers.SharedWords(), [*config.JUDGE_METRICS, "ContextualRelevancyMetric"])
    return scored.select("claim_id", "metric", rounded("score").alias("score"), "success")


@query
def claim_backfill(spark: SparkSession, d: str) -> DataFrame:
    """The claims whose text is not the stored one, embedded again; here by hashed words, so only the length of the vector is compared."""
    rows = views.claims(spark, d, "embedding_text")
    texts = embedding.claim_texts(rows, views.evidence(spark, d), views.papers(spark, d, "study_design", "published_year"))
    todo = upsert.changed_texts(texts, rows.select("claim_signature", F.col("embedding_text").alias("text")), "claim_signature", "text")
    return embedding.with_vectors(todo, "claim_signature", providers.HashedWords()).select("claim_signature", F.size("embedding").alias("dimensions"))


@query
def table_items(spark: SparkSession, d: str) -> DataFrame:
    """Tables of papers, parsed from responses; here a response lists as many as n_tables says, under the paper's title."""
    rows = views.papers(spark, d, "n_tables", "title")
    listed = F.transform(F.sequence(F.lit(1), F.col("n_tables")), lambda i: F.struct(i.alias("table_id"), F.col("title").alias("caption"), F.array(F.col("title")).alias("groups")))
    text = F.concat(F.lit("```json\n"), F.to_json(F.when(F.col("n_tables") > 0, listed).otherwise(F.array().cast("array<struct<table_id:int,caption:string,groups:array<string>>>"))), F.lit("\n```"))
    return extraction.items(rows.select("paper_id", text.alias("response")), "tables").select("paper_id", "table_id", "caption", F.size("groups").alias("groups"))


@query
def eval_join(spark: SparkSession, d: str) -> DataFrame:
    """Claims as candidates, papers as their truth."""
    candidates = views.claims(spark, d, "embedding_text").select(F.element_at("paper_ids", 1).alias("id"), F.col("embedding_text").alias("answer"), "claim_id")
    truth = views.papers(spark, d, "title").select(F.col("paper_id").alias("id"), F.coalesce("title", F.lit("")).alias("answer"))
    return evaluation.judged(candidates, truth).select("claim_id", "expected_answer")


@query
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Sums by event type and in total."""
    rows = table(spark, d, "events").select("event_type", F.lit(1).cast("long").alias("calls"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return evaluation.usage_totals(rows, "event_type", "calls", "tokens")


@query
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Events as runs."""
    rows = table(spark, d, "events").select(F.col("value").alias("total_time_s"), (F.col("user_id") % 512).alias("ram_mb"), (F.col("event_type") != "error").alias("success"))
    out = evaluation.run_summary(rows)
    return out.select("runs", "failed", F.round("total_s", 3).alias("total_s"), rounded("mean_s").alias("mean_s"), "most_mb")


def _final_direct(spark: SparkSession, d: str) -> DataFrame:
    rows, said = _asked(spark, d)
    ranked = retrieval.final_paths(rows, said, NAMES, _query_vector(spark, d), GENERIC).where("length = 1").select(F.col("path_signature").alias("claim_signature"), "rank")
    lists = graph.evidence_lists(said, views.papers(spark, d, "study_design", "published_year"), config.EVIDENCE_PER_CLAIM)
    return ranked.join(rows, "claim_signature").join(lists, "claim_signature", "left")


@query
def prompt_graph_block(spark: SparkSession, d: str) -> DataFrame:
    """The direct claims of the answer as text."""
    return render.direct_blocks(_final_direct(spark, d)).select("label", "block")


@query
def prompt_vector_block(spark: SparkSession, d: str) -> DataFrame:
    """The longest eight chunks as passages."""
    rows = views.chunks(spark, d, "paper_id", "section_type", "section_name", "text").withColumn("n", F.length("text")).orderBy(F.desc("n"), "point_id").limit(8).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "point_id")))
    return render.passage_blocks(rows).select("label", F.md5("block").alias("digest"))


def _vectored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a stand-in vector: the embedding whose vec_id is the point_id modulo the number of embeddings."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    rows = views.chunks(spark, d, "paper_id", "section_type", "section_name", "text").join(F.broadcast(vectors.agg(F.count("*").alias("_n"))))
    return rows.withColumn("vec_id", F.col("point_id") % F.col("_n")).join(vectors, "vec_id").drop("_n", "vec_id")


def _final(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The question's final paths (at most eight, written once), and what their blocks are made of."""
    rows, said = _asked(spark, d)
    final = cut(retrieval.final_paths(rows, said, NAMES, _query_vector(spark, d), GENERIC).select("path_signature", "length", "rank"))
    return final, rows, said, views.papers(spark, d, "study_design", "published_year")


@query
def passages_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight chunks nearest to the question as passages; chunks have stand-in vectors."""
    rows = answer.passages(_vectored_chunks(spark, d), _query_vector(spark, d))
    return render.passage_blocks(rows).select("label", "point_id", rounded("score").alias("score"), F.md5("block").alias("digest"))


@query
def chain_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The chains of the answer as text, numbered after the direct claims."""
    return answer.blocks(*_final(spark, d))[1].select("label", "block")


@query
def answer_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The whole prompt of the question: direct claims, chains, passages."""
    found = answer.passages(_vectored_chunks(spark, d), _query_vector(spark, d))
    return answer.answer_prompt(QUESTION, *_final(spark, d), found).select(F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


@query
def chain_strings(spark: SparkSession, d: str) -> DataFrame:
    """Every path as a line."""
    return _paths(spark, d).select("path_signature", render.chain_text(F.col("entities"), F.col("relations")).alias("line"))


@query
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of every claim as judge context, counted and digested."""
    said = graph.ranked_evidence(views.evidence(spark, d), views.papers(spark, d, "study_design", "published_year"))
    rows = said.join(views.claims(spark, d).select("claim_signature", "source_name", "relation_type", "target_name"), "claim_signature")
    line = render.context_line(*(F.col(c) for c in ("source_name", "relation_type", "target_name", "paper_id", "paper_year", "section_type", "evidence_text")))
    return rows.select(F.col("claim_signature").alias("path_signature"), (F.col("_nth") - 1).alias("evidence_no"), F.md5(line).alias("digest"))


@query
def vocabulary_render(spark: SparkSession, d: str) -> DataFrame:
    """the reference list as text, by type."""
    return render.vocabulary_lines(table(spark, d, "canonical_terms")).select("entity_type", F.md5("lines").alias("digest"))


# --- additions: event time


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of events by type."""
    rows = ingest.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users, by a gap of 30 minutes."""
    return ingest.sessions(table(spark, d, "events"), "ts", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))
