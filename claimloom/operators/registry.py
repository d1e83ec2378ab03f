"""Entity and claim registries from mentions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as T
from claimloom.functions.similarity import may_reach, sorted_score, sorted_words
from claimloom.functions.text import or_default, stripped, weight
from claimloom.lineage import cut


def resolve_names(rows: DataFrame, forms: DataFrame, *columns: str) -> DataFrame:
    """``rows`` whose name ``columns`` are led to the canonical name of their lower-case form, unchanged where there is none. ``forms`` has form (unique), canonical_name."""
    for c in columns:
        index = forms.select(F.col("form").alias("_form"), F.col("canonical_name").alias("_canonical"))
        rows = rows.join(index, F.lower(c) == F.col("_form"), "left").withColumn(c, F.coalesce("_canonical", c)).drop("_form", "_canonical")
    return rows


def enriched(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """``entities`` with ``ontology``: the least term_id of the reference entries (term_id, canonical, entity_type) of their canonical_name and type, null where there is none."""
    known = terms.groupBy(F.col("canonical").alias("_canonical"), F.col("entity_type").alias("_type")).agg(F.min("term_id").alias("ontology"))
    return entities.join(known, (F.col("canonical_name") == F.col("_canonical")) & (F.col("entity_type") == F.col("_type")), "left").drop("_canonical", "_type")


def is_well_formed(source: str, relation: str, target: str) -> Column:
    """Whether a relation mention has both ends and a type."""
    filled = lambda c: F.coalesce(stripped(c), F.lit("")) != ""
    return filled(source) & filled(relation) & filled(target)


def relation_ends(spark: SparkSession) -> DataFrame:
    """``relation_type``, ``source_type``, ``target_type`` (lower case): what the vocabulary allows; a fixed table of under a thousand rows."""
    item = lambda r: F.struct(F.lit(r[0]).alias("relation_type"), F.lit(r[1].lower()).alias("source_type"), F.lit(r[2].lower()).alias("target_type"))
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*map(item, config.relation_ends()))))


def checked_relations(mentions: DataFrame, ends: DataFrame) -> DataFrame:
    """``mentions`` (relation_type, source_type, target_type) with ``verdict``: ``allowed``; ``direction`` where only the reverse is allowed; ``ends`` where neither is;
    ``relation`` for one that is not in the vocabulary, or null; ``untyped`` where an end's type is missing. Types are compared without regard to case. ``ends`` is the fixed table, so it is broadcast."""
    key = lambda c: F.lower(T.stripped(c))
    typed = mentions.withColumn("_s", F.nullif(key("source_type"), F.lit(""))).withColumn("_t", F.nullif(key("target_type"), F.lit("")))
    some = lambda a, b, flag: F.broadcast(ends.select(F.col("relation_type").alias("_r"), F.col("source_type").alias(a), F.col("target_type").alias(b), F.lit(True).alias(flag)))
    there = typed.join(some("_a", "_b", "_there"), (F.col("relation_type") == F.col("_r")) & (F.col("_s") == F.col("_a")) & (F.col("_t") == F.col("_b")), "left").drop("_r", "_a", "_b")
    back = there.join(some("_a", "_b", "_back"), (F.col("relation_type") == F.col("_r")) & (F.col("_t") == F.col("_a")) & (F.col("_s") == F.col("_b")), "left").drop("_r", "_a", "_b")
    known = F.coalesce(F.col("relation_type").isin(config.RELATION_TYPES), F.lit(False))
    verdict = F.when(~known, "relation").when(F.col("_s").isNull() | F.col("_t").isNull(), "untyped").when(F.col("_there"), "allowed").when(F.col("_back"), "direction").otherwise("ends")
    return back.withColumn("verdict", verdict).drop("_s", "_t", "_there", "_back")


def section_relations(mentions: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """The mentions that their section may hold: in METHODS only the ``allowed`` relations, elsewhere all."""
    few = F.col("relation_type").isin(config.METHODS_RELATIONS if allowed is None else allowed)
    return mentions.where(F.coalesce(F.col("section_type") != "METHODS", F.lit(True)) | F.coalesce(few, F.lit(False)))


def claim_registry(mentions: DataFrame) -> DataFrame:
    """Claims of relation mentions: one row for each signature source|relation|target.

    ``mentions`` has source_name, source_type, relation_type, target_name, target_type, polarity, certainty, paper_id, evidence, section_type and
    ``seq``, the order of mentions. Malformed mentions are left out; a missing polarity is positive, a missing certainty moderate, an unknown
    polarity counts nowhere; types come from the first mention, of equal certainties too; blank evidence is no evidence.
    """
    good = mentions.where(is_well_formed("source_name", "relation_type", "target_name"))
    spoken = stripped(F.coalesce("evidence", F.lit(""))) != ""
    rows = good.select(
        stripped("source_name").alias("source_name"), stripped("relation_type").alias("relation_type"), stripped("target_name").alias("target_name"), "source_type", "target_type",
        F.coalesce("polarity", F.lit("positive")).alias("polarity"), F.coalesce("certainty", F.lit("moderate")).alias("certainty"), "paper_id", spoken.cast("long").alias("_spoken"), "seq",
    )
    # Strings as aggregates would need a sort of all mentions; as keys of counts and least positions they are hashed, and few kinds are left of them. Papers are
    # as many as mentions, so they know their signature by two hashes and move without its words.
    key, kind = ["source_name", "relation_type", "target_name"], ["source_type", "target_type", "polarity", "certainty"]
    same = [F.xxhash64(*key).alias("_a"), F.xxhash64(F.lit(1), *key).alias("_b")]
    kinds = rows.groupBy(*key, *kind).agg(F.count("*").alias("_n"), F.sum("_spoken").alias("_spoken"), F.min("seq").alias("seq"))
    papers = rows.where("paper_id IS NOT NULL").select(*same, "paper_id").distinct().groupBy("_a", "_b").agg(F.count("*").alias("paper_count"))
    rank = weight(F.col("certainty"), config.CERTAINTY_RANKS, -1)
    counts = [F.sum(F.when(F.col("polarity") == p, F.col("_n")).otherwise(0)).alias(f"n_{p}") for p in config.POLARITIES]
    claims = kinds.groupBy(*key).agg(
        *counts, F.max_by("certainty", F.struct(rank, -F.col("seq"))).alias("certainty_max"), F.sum("_n").alias("mentions"), F.sum("_spoken").alias("evidence_count"),
        F.min_by("source_type", "seq").alias("source_type"), F.min_by("target_type", "seq").alias("target_type"),
    ).select("*", *same)
    counted = claims.join(papers, ["_a", "_b"], "left").drop("_a", "_b")
    return counted.withColumn("paper_count", F.coalesce("paper_count", F.lit(0).cast("long"))).withColumn("claim_signature", F.concat_ws("|", *key))


def evidence_rows(mentions: DataFrame) -> DataFrame:
    """The evidence of claims: one row for each distinct non-blank evidence of a signature, with a stable id."""
    sig = F.concat_ws("|", stripped("source_name"), stripped("relation_type"), stripped("target_name"))
    text = stripped("evidence")
    rows = mentions.where(is_well_formed("source_name", "relation_type", "target_name") & (F.coalesce(text, F.lit("")) != ""))
    return rows.select(sig.alias("claim_signature"), text.alias("evidence_text"), "paper_id", "section_type", "polarity", "certainty").distinct().withColumn("evidence_id", F.md5(F.concat_ws("|", "claim_signature", "paper_id", "section_type", "polarity", "certainty", "evidence_text")))


def safe_aliases(aliases: Column, canonical: Column, protected: list[str] | None = None) -> Column:
    """Aliases without nulls, blanks and protected names of other entities."""
    names = [p.lower() for p in (config.PROTECTED_NAMES if protected is None else protected)]
    return F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != "") & (~F.lower(a).isin(names) | (F.lower(a) == F.lower(canonical))))


def entity_registry(mentions: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """Entities of mentions: one row for each canonical name without regard to case.

    ``mentions`` has canonical_name, entity_type, surface_form, aliases, key_properties (map), paper_id, section_type, ``seq``. The name and type are those of the
    first mention; arrays are distinct and ascending; key_properties come from the mention that fills most, the first of equals.
    Mentions with a blank name are left out.
    """
    name = stripped("canonical_name")
    rows = mentions.where(F.coalesce(name, F.lit("")) != "").withColumn("_name", name).withColumn("_key", F.lower("_name"))
    filled = F.coalesce(F.size(F.filter(F.map_values("key_properties"), lambda v: v.isNotNull())), F.lit(0))
    rows = rows.withColumn("_filled", F.when(F.col("key_properties").isNull(), 0).otherwise(filled))
    # Aliases are made distinct before they are gathered, so an entity with very many mentions holds its distinct aliases only.
    alias = rows.select("_key", F.explode(safe_aliases(F.col("aliases"), F.col("_name"), protected)).alias("_a")).distinct().groupBy("_key").agg(F.array_sort(F.collect_list("_a")).alias("aliases"))
    merged = rows.groupBy("_key").agg(
        F.min_by("_name", "seq").alias("canonical_name"), F.min_by("entity_type", "seq").alias("entity_type"),
        F.max_by("key_properties", F.struct("_filled", -F.col("seq"))).alias("key_properties"), F.max("_filled").alias("filled_properties"),
        F.array_sort(F.collect_set("paper_id")).alias("paper_ids"), F.array_sort(F.collect_set("section_type")).alias("section_types"),
        F.array_sort(F.collect_set(F.nullif("surface_form", F.lit("")))).alias("surface_forms"), F.count("*").alias("mentions"), F.min("seq").alias("seq"),
    )
    return merged.join(alias, "_key", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).drop("_key")


def forms_index(registry: DataFrame) -> DataFrame:
    """``form``, ``canonical_name``, ``contenders``: every lower-case form and the entity it stands for: of several the one with most papers, then the earliest entry."""
    every = F.concat(F.array("canonical_name"), "aliases", "surface_forms")
    rows = registry.select("canonical_name", F.size("paper_ids").alias("_papers"), "seq", F.explode(F.array_distinct(F.transform(every, lambda f: F.lower(f)))).alias("form")).where("form <> ''")
    best = F.struct("_papers", -F.col("seq"))
    return rows.groupBy("form").agg(F.max_by("canonical_name", best).alias("canonical_name"), F.count("*").alias("contenders"))


def fuzzy_pairs(names: DataFrame, score: float = config.MERGE_SCORE, protected: list[str] | None = None) -> DataFrame:
    """``early``, ``late``, ``score``: pairs of distinct names (columns name, seq) whose word-order-free ratio reaches ``score`` (at least 85), earlier one first.

    Candidates share a rare q-gram: a ratio r leaves at most (1 - r/100) x summed length insertions and deletions, which spoil a bounded number of a name's q-grams, so
    two names meet among one more of the rarest of either. Short names meet at 2-grams, longer ones at 3-grams, those between at both.
    Lengths, presence of bigrams and the edit distance are checked in the JVM before the score. Protected names pair with none.
    """
    if not 85 <= score <= 100:
        raise ValueError("score must be 85 to 100")
    shield = [p.lower() for p in (config.PROTECTED_NAMES if protected is None else protected)]
    rows = names.where(~F.lower("name").isin(shield)).select("name", "seq", sorted_words(F.col("name")).alias("_w"))
    grams = lambda q: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_w") - q + 1, F.lit(1))), lambda i: F.substring(F.col("_w"), i, q)))
    # Presence of bigrams in 128 bits: an insertion or deletion changes at most three bigrams, hence three bits.
    place = lambda g: F.pmod(F.xxhash64(g), F.lit(128))
    bits = lambda low: F.aggregate("_g", F.lit(0).cast("long"), lambda b, g: F.when((place(g) < 64) == F.lit(low), b.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(g), F.lit(64)).cast("int")))).otherwise(b))
    kept = ["name", "seq", "_w", "_b", "_c"]
    rows = cut(rows.withColumn("_g", grams(2)).withColumn("_b", bits(True)).withColumn("_c", bits(False)).drop("_g"))
    # Of a name of n letters, d deletions and e insertions with d + e <= part * (2n - d + e) spoil at most q * d + (q - 1) * e q-grams.
    part = (100 - score) / 100
    spoilt = lambda q: 2 * part * max(q / (1 + part), (q - 1) / (1 - part))
    long = math.ceil(3 / (1 - spoilt(3)))  # from here on a 3-gram of a partner's survives
    short = math.ceil(long * (1 + part) / (1 - part))  # no partner of a name below ``long`` is longer

    def prefix(some: DataFrame, q: int) -> DataFrame:
        each = some.select("name", F.explode(grams(q)).alias("_t"))
        counts = each.groupBy("_t").agg(F.count("*").alias("_n"))
        ordered = each.join(counts, "_t").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_o"))
        first = F.floor(F.length("_w") * spoilt(q) + 1e-9).cast("int") + 1
        return some.join(ordered, "name").select(*kept, F.explode(F.slice(F.col("_o._t"), 1, first)).alias("_p"))

    met = prefix(rows.where(F.length("_w") <= short), 2).unionByName(prefix(rows.where(F.length("_w") >= long), 3))
    a, b = (met.select(*(F.col(c).alias(f"{side}_{c}") for c in kept), "_p") for side in "ab")
    changed = F.bit_count(F.col("a__b").bitwiseXOR(F.col("b__b"))) + F.bit_count(F.col("a__c").bitwiseXOR(F.col("b__c")))
    alike = changed <= 3 * F.floor((F.length("a__w") + F.length("b__w")) * (100 - score) / 100 + 1e-9)
    pairs = a.join(b, "_p").where("a_seq < b_seq").where(alike).where(may_reach(F.col("a__w"), F.col("b__w"), score)).select("a_name", "b_name").distinct()
    scored = pairs.withColumn("score", sorted_score("a_name", "b_name"))
    return scored.where(F.col("score") >= score).select(F.col("a_name").alias("early"), F.col("b_name").alias("late"), "score")


def greedy_leaders(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """``name``, ``leader``: the result of taking names in order of seq, each joining its best-scoring earlier leader (the earliest of equals) or leading itself.

    Rounds of the lexicographically first maximal independent set: a name follows as soon as an earlier neighbour leads, and leads once all earlier neighbours
    follow. Every round settles the earliest open names at least, so it ends, however long a chain of dependent names is; only names with an earlier
    neighbour take part, and only pairs whose later name is open are kept for the next round. Each round is written to the checkpoint folder.
    """
    pairs = cut(pairs)
    follows = pairs.select(F.col("late").alias("name")).distinct()
    settled = [names.join(follows, "name", "left_anti").select("name", F.lit(True).alias("leads"))]  # no earlier neighbour
    open_pairs = cut(pairs.select("early", "late").join(settled[0].select(F.col("name").alias("early"), "leads"), "early", "left"))
    while True:
        seen = open_pairs.groupBy(F.col("late").alias("name")).agg(F.max(F.coalesce("leads", F.lit(False)).cast("int")).alias("_any"), F.count_if(F.col("leads").isNull()).alias("_open"))
        done = cut(seen.where("_any = 1 OR _open = 0").select("name", (F.col("_any") == 0).alias("leads")))
        if done.isEmpty():
            break
        settled.append(done)
        if len(settled) > 20:
            settled = [cut(reduce(DataFrame.unionByName, settled))]
        rest = open_pairs.join(done.select(F.col("name").alias("late")), "late", "left_anti")
        news = done.select(F.col("name").alias("early"), F.col("leads").alias("_l"))
        open_pairs = cut(rest.join(news, "early", "left").select("early", "late", F.coalesce("leads", "_l").alias("leads")))
    state = reduce(DataFrame.unionByName, settled)
    lead = state.where("leads").join(names.select("name", F.col("seq").alias("_s")), "name").select(F.col("name").alias("early"), "_s")
    best = pairs.join(lead, "early").groupBy(F.col("late").alias("name")).agg(F.max_by("early", F.struct("score", -F.col("_s"))).alias("_to"))
    return state.join(best, "name", "left").select("name", F.when(F.col("leads"), F.col("name")).otherwise(F.col("_to")).alias("leader"))


def paper_weights(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """``claims`` with ``study_weight_max``: the best study-design weight of their paper_ids; an unknown paper, and no paper, weighs 0.4.

    ``claims`` needs claim_id, paper_ids. ``papers`` has paper_id int (unique), study_design.
    """
    design = weight(or_default(F.col("study_design"), "other"), config.DESIGN_WEIGHTS, config.UNKNOWN_DESIGN)
    found = claims.select("claim_id", F.explode("paper_ids").alias("paper_id")).join(papers.select("paper_id", design.alias("_w")), "paper_id", "left")
    best = found.groupBy("claim_id").agg(F.max(F.coalesce("_w", F.lit(config.UNKNOWN_DESIGN))).alias("_best"))
    return claims.join(best, "claim_id", "left").withColumn("study_weight_max", F.coalesce("_best", F.lit(config.UNKNOWN_DESIGN))).drop("_best")


def first_rows(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    window = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")
