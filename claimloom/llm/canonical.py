"""Leading free-entered names to the entries of a reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.lineage import cut
from claimloom.llm.names import gram_set, is_generic, match_keys, same_but_for_typing
from claimloom.llm.setjoin import jaccard_join
from claimloom.sources.tables import current_rows

#: Least Jaccard similarity of the 3-gram sets of a name and a reference form. Two letters that changed places leave it in names of ten letters or more, two replaced apart in names of fourteen or more, four cut off in names of nine or more.
SIMILARITY = "0.4"


def reference_forms(terms: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``form_key``, ``term_id``, ``term_type``: every known form of every entry, once.

    ``terms`` has term_id, entity_type, canonical, aliases. ``index`` has form, canonical_name; its rows whose name is no
    entry's canonical form, or null, lead nowhere and give no form.
    """
    base = terms.where("term_id IS NOT NULL").select("term_id", F.lower(F.trim("entity_type")).alias("term_type"), F.col("canonical").alias("_canonical"), F.coalesce("aliases", F.array().cast("array<string>")).alias("_aliases"))
    own = base.select("term_id", "term_type", F.explode(F.concat(F.array("_canonical"), "_aliases")).alias("_form")).select("term_id", "term_type", match_keys("_form").alias("form_key"))
    if index is not None:
        names = base.select("term_id", "term_type", match_keys("_canonical").alias("_to"))
        led = index.where("form IS NOT NULL AND canonical_name IS NOT NULL").select(match_keys("form").alias("form_key"), match_keys("canonical_name").alias("_to"))
        own = own.unionByName(led.join(names, "_to").select("term_id", "term_type", "form_key"))
    return own.where("form_key <> ''").distinct()


def name_evidence(records: DataFrame, key: str = "record_id") -> DataFrame:
    """The forms that speak for each record: ``key``, ``form_key``, ``source`` (name, surface, alias), ``record_type``.

    A name that denotes something speaks alone; for blank and generic names ("study drug") the surface forms and aliases speak.
    """
    arrays = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    tag = lambda c, s: F.transform(arrays(c), lambda x: F.struct(F.lit(s).alias("source"), x.alias("form")))
    forms = F.concat(F.array(F.struct(F.lit("name").alias("source"), F.col("canonical_name").alias("form"))), tag("surface_forms", "surface"), tag("aliases", "alias"))
    rows = records.select(key, F.nullif(F.lower(F.trim("entity_type")), F.lit("")).alias("record_type"), F.explode(F.array_distinct(forms)).alias("_f"))
    keyed = rows.select(key, "record_type", "_f.source", match_keys("_f.form").alias("form_key")).where("form_key <> ''")
    keyed = keyed.where(~is_generic(F.col("form_key"))).distinct()
    named = F.max((F.col("source") == "name").cast("int")).over(Window.partitionBy(key))
    return keyed.withColumn("_named", named).where("_named = 0 OR source = 'name'").drop("_named")


def closest_terms(keys: DataFrame, forms: DataFrame, similarity: str = SIMILARITY) -> DataFrame:
    """For each distinct ``form_key`` of ``keys`` the entries behind its closest reference forms: ``form_key``, ``term_id``, ``term_type``, ``jaccard``, ``edits``.

    A set-similarity join by rare prefixes finds all forms of at least ``similarity``; of these, forms count that differ from the key by typing only.
    Two edits change at most six 3-grams of either, a cut end leaves all but the last of the shorter one.
    The highest similarity wins, then the least number of edits; entries that share the best form, or tie, all stay.
    """
    forms = cut(forms)
    sets = lambda df: df.select("form_key").distinct().withColumn("_grams", gram_set(F.col("form_key")))
    good = jaccard_join(sets(keys), sets(forms), "form_key", "_grams", similarity, also=same_but_for_typing, lost=(6, 1)).withColumn("edits", F.levenshtein("left_key", "right_key"))
    rank = F.rank().over(Window.partitionBy("left_key").orderBy(F.desc("jaccard"), "edits"))
    best = good.withColumn("_rank", rank).where("_rank = 1").select(F.col("left_key").alias("form_key"), F.col("right_key").alias("_form"), "jaccard", "edits")
    return best.join(forms.withColumnRenamed("form_key", "_form"), "_form").groupBy("form_key", "term_id").agg(F.first("term_type").alias("term_type"), F.max("jaccard").alias("jaccard"), F.min("edits").alias("edits"))


def map_to_terms(records: DataFrame, terms: DataFrame, index: DataFrame | None = None, key: str = "record_id", similarity: str = SIMILARITY, evidence: DataFrame | None = None) -> DataFrame:
    """One row for each record (current rows; ``key`` unique, rows with a null key left out): ``key``, ``term_id``, ``matched_form``, ``jaccard``, ``status``.

    status: ``matched``; ``ambiguous`` where the best evidence fits several entries and the type does not decide (term_id null);
    ``unmatched`` where no entry is close enough; ``unnamed`` where neither name nor forms denote anything. Surface forms count
    twice, aliases once, an entry of the record's own type is preferred among the best; nothing is dropped, so ``status`` reports the rest.
    ``evidence`` may hand over a computed name_evidence. Other columns of ``records``, whatever their names, do not matter. An empty list leaves every record unmatched.
    """
    keep = [key, "canonical_name", "entity_type", "aliases", "surface_forms"]
    records = records.where(F.col(key).isNotNull()).select(*keep)
    evidence = cut(name_evidence(records, key)) if evidence is None else evidence
    found = closest_terms(evidence, reference_forms(terms, index), similarity)
    weight = F.when(F.col("source") == "alias", 1).otherwise(2)
    votes = evidence.join(found, "form_key").groupBy(key, "term_id").agg(
        F.sum(weight).alias("_votes"), F.max(F.col("term_type").eqNullSafe(F.col("record_type")).cast("int")).alias("_typed"), F.max_by("form_key", "jaccard").alias("matched_form"), F.max("jaccard").alias("jaccard")
    )
    top = Window.partitionBy(key)
    best = votes.withColumn("_rank", F.rank().over(top.orderBy(F.desc("_votes"), F.desc("_typed"), F.desc("jaccard")))).where("_rank = 1").withColumn("_ties", F.count("*").over(top))
    chosen = best.groupBy(key).agg(*(F.when(F.max("_ties") == 1, F.first(c)).alias(c) for c in ("term_id", "matched_form", "jaccard")), F.max("_ties").alias("_ties"))
    spoken = evidence.select(key).distinct().withColumn("_spoken", F.lit(True))
    status = F.when(F.col("_ties") == 1, "matched").when(F.col("_ties") > 1, "ambiguous").when(F.col("_spoken"), "unmatched").otherwise("unnamed")
    return records.select(key).join(spoken, key, "left").join(chosen, key, "left").select(key, "term_id", "matched_form", "jaccard", status.alias("status"))


def unmatched_names(records: DataFrame, mapped: DataFrame, key: str = "record_id") -> DataFrame:
    """The report of what has no entry: ``canonical_name`` as it is written (null where a record has none), ``status`` (why), ``records``, ``first_record``."""
    left = mapped.where("status <> 'matched'").select(key, "status").join(records.where(F.col(key).isNotNull()).select(key, "canonical_name"), key)
    return left.groupBy("canonical_name", "status").agg(F.count("*").alias("records"), F.min(key).alias("first_record"))


def current_registry(registry: DataFrame) -> DataFrame:
    """The current rows of an entity registry."""
    return current_rows(registry, "record_id", "updated_at")
