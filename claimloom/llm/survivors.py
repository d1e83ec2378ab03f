"""One surviving record for each group of records that denote one entity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.lineage import cut
from claimloom.llm.canonical import map_to_terms, name_evidence
from claimloom.llm.editjoin import typing_join
from claimloom.llm.names import is_generic, match_keys

#: Least Jaccard similarity of the 3-grams of the words of two unlisted names that differ by typing only.
SIMILARITY = "0.2"

#: Points of a group that are layered in one array, and points of a block of larger groups.
MOST_POINTS, BLOCK_POINTS = 256, 20_000

# Wordings for "not known", "not given", "to come".
EMPTY_WORDINGS = (
    r"n\.? ?/? ?a\.?|#n/a|nan|none|nil|null|undefined|empty|blank|unknown|unk\.?|not known|missing|unspecified|unstated|unreported|unrecorded|undisclosed|undetermined|unavailable|pending|awaited"
    r"|tb[acd]|to be (?:added|announced|completed|confirmed|decided|defined|determined|supplied)|to (?:come|follow)|coming soon|todo"
    r"|not (?:yet )?(?:available|applicable|assessed|described|determined|disclosed|documented|given|mentioned|provided|recorded|reported|specified|stated|supplied)|none (?:given|reported|stated)"
    r"|no (?:data|info|information|value)(?: (?:available|given))?|(?:data|information) (?:not available|unavailable|missing|pending)"
    r"|k\. ?a\.?|keine angaben?|unbekannt|nicht (?:bekannt|angegeben|verfügbar|berichtet)|folgt"
    r"|inconnue?|non (?:connue?|disponible|précisée?|renseignée?|communiquée?)|à (?:compléter|venir)"
    r"|desconocid[oa]|no (?:conocido|consta|disponible|especificado|indicado|informado)|sin datos?|por (?:determinar|confirmar)|s/d"
    r"|[\s.?!_/*–—−-]+|…"
)


def tells_something(value: Column) -> Column:
    """Whether a property's value is filled: not null, not blank, no wording for "not known, not given, to come"."""
    said = F.trim(F.regexp_replace(F.lower(value), r"(?U)[\s()\[\]\"']+", " "))
    return value.isNotNull() & (said != "") & ~said.rlike(rf"(?U)^(?:{EMPTY_WORDINGS})$")


def filled_properties(properties: Column) -> Column:
    """The entries of a map whose values tell something; null gives an empty map."""
    return F.map_filter(F.coalesce(properties, F.create_map().cast("map<string,string>")), lambda k, v: tells_something(v))


def followed(parents: DataFrame, key: str, to: str) -> DataFrame:
    """``key``, ``to``: where the steps from every key end. A key that leads to itself is an end; there must be no other circle."""
    at = cut(parents.select(key, to))
    while True:
        step = at.join(at.select(F.col(key).alias(to), F.col(to).alias("_next")), to)
        further = cut(step.select(key, F.col("_next").alias(to), (F.col("_next") != F.col(to)).alias("_moved")))
        at = further.select(key, to)
        if further.where("_moved").isEmpty():
            return at


def connected(links: DataFrame, group: str) -> DataFrame:
    """``group``, ``node``, ``least``: every node of the links ``a`` - ``b`` of a group, with the least node that links lead to from it, however many.

    In each round a node takes the least label around it, then the label that one has, so long chains need few rounds.
    """
    both = cut(links.select(group, F.col("a").alias("node"), F.col("b").alias("_other")).unionByName(links.select(group, F.col("b").alias("node"), F.col("a").alias("_other"))).distinct())
    labels = cut(both.select(group, "node").distinct().withColumn("least", F.col("node")))
    while not labels.isEmpty():
        near = both.join(labels.select(group, F.col("node").alias("_other"), F.col("least").alias("_near")), [group, "_other"]).groupBy(group, "node").agg(F.min("_near").alias("_near"))
        nearer = labels.join(near, [group, "node"]).select(group, "node", F.col("least").alias("_was"), F.least("least", "_near").alias("_to"))
        jumped = cut(nearer.join(nearer.select(group, F.col("node").alias("_to"), F.col("_to").alias("least")), [group, "_to"]).select(group, "node", "least", (F.col("least") != F.col("_was")).alias("_moved")))
        labels = jumped.select(group, "node", "least")
        if jumped.where("_moved").isEmpty():
            break
    return labels


def entity_keys(records: DataFrame, terms: DataFrame, index: DataFrame | None = None, similarity: str = SIMILARITY) -> DataFrame:
    """``record_id``, ``entity_key``, ``exact`` of every current record whose forms denote an entity.

    Records led to a reference entry get the entry's key. The other names are compared with each other, over all builds, by
    an exact edit join: a name that differs by typing only from a more frequent one takes that one's key, and so on to the end, so typing
    errors meet at the common spelling even where a build lacks it. Within a build, names that differ by typing only, and all that they are so linked with,
    get one key, the most frequent of theirs. ``exact`` says whether the record's form is the key's own spelling.
    Records without any denoting form, and those whose evidence is ambiguous, get no row: they are no one's duplicate.
    """
    evidence = cut(name_evidence(records))
    mapped = cut(map_to_terms(records, terms, index, evidence=evidence))
    known = mapped.where("status = 'matched'").select("record_id", F.concat(F.lit("term:"), "term_id").alias("entity_key"), (F.col("jaccard") == 1).alias("exact"))
    rank = F.when(F.col("source") == "name", 0).when(F.col("source") == "surface", 1).otherwise(2)
    other = evidence.join(mapped.where("status = 'unmatched'"), "record_id", "left_semi").groupBy("record_id").agg(F.min_by("form_key", F.struct(rank, "form_key")).alias("form_key"))
    counts = cut(other.groupBy("form_key").agg(F.count("*").alias("_n")))
    pairs = cut(typing_join(counts, None, "form_key", similarity))
    both = pairs.select(F.col("left_key").alias("form_key"), F.col("right_key").alias("_to")).unionByName(pairs.select(F.col("right_key").alias("form_key"), F.col("left_key").alias("_to")))
    n = counts.select(F.col("form_key").alias("_to"), F.col("_n").alias("_m"))
    above = both.join(n, "_to").join(counts.select("form_key", "_n"), "form_key").where("_m > _n OR (_m = _n AND _to < form_key)")
    parents = counts.select("form_key").join(above.groupBy("form_key").agg(F.max_by("_to", F.struct(F.col("_m"), F.col("_to"))).alias("_to")), "form_key", "left").select("form_key", F.coalesce("_to", "form_key").alias("_to"))
    roots = followed(parents, "form_key", "_to")  # parents are more frequent, or before it of equals, so there is no circle
    own = cut(other.join(records.select("record_id", "build_id"), "record_id").join(roots, "form_key").join(n, "_to").withColumn("_node", F.struct((-F.col("_m")).alias("less"), F.col("_to").alias("key"))))
    ends = own.select("build_id", "form_key", "_node").distinct()
    end = lambda side, name: ends.select("build_id", F.col("form_key").alias(side), F.col("_node").alias(name))
    links = pairs.join(end("left_key", "a"), "left_key").join(end("right_key", "b"), ["build_id", "right_key"]).where("a <> b").select("build_id", "a", "b")
    one = connected(links, "build_id").select("build_id", F.col("node").alias("_node"), "least")
    named = own.join(one, ["build_id", "_node"], "left").withColumn("_key", F.coalesce("least", "_node")["key"])
    unknown = named.select("record_id", F.concat(F.lit("name:"), "_key").alias("entity_key"), (F.col("form_key") == F.col("_key")).alias("exact"))
    return known.unionByName(unknown)


def rated(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Records with an entity (their other columns, whatever their names, left out), with ``_filled`` (filled properties), ``completeness``, ``recency`` and ``trust``.

    trust is 0 to 3: one point each for a name that denotes something, a form spelt as the entity's own, and a given type.
    """
    own = dict.fromkeys(["record_id", "build_id", "canonical_name", "entity_type", "key_properties", "paper_ids", "updated_at"])
    full = records.select(*own).join(keys.select("record_id", "entity_key", "exact"), "record_id").withColumn("_filled", filled_properties(F.col("key_properties"))).withColumn("_name_key", match_keys("canonical_name"))
    named = (F.coalesce("_name_key", F.lit("")) != "") & ~is_generic(F.coalesce("_name_key", F.lit("")))
    trust = named.cast("int") + F.col("exact").cast("int") + (F.trim(F.coalesce("entity_type", F.lit(""))) != "").cast("int")
    return full.withColumn("completeness", F.size("_filled")).withColumn("recency", F.col("updated_at")).withColumn("trust", trust).withColumn("_named", named)


def _axis(c: str, kind: T.DataType) -> Column:
    """An axis as a number in which a null is the least."""
    number = F.unix_micros(F.col(c).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(c)
    return F.coalesce(number.cast("double"), F.lit(float("-inf")))


def dominance_layers(rows: DataFrame, group: list[str], axes: list[str], identity: str, along: str | None = None, most: int = MOST_POINTS, block: int = BLOCK_POINTS) -> DataFrame:
    """``group``, ``identity`` and ``layer`` (1 = Pareto-undominated) over the descending ``axes`` (numbers or times); null values are the least.

    A record's layer is 1 + the highest layer among all records of its group that dominate it: at least equal on all axes, better on one.
    Records at one point have one layer, so layers are computed over distinct points. Up to ``most`` points of a group are layered in one array;
    larger groups are cut along the axis ``along`` (the one with most values; the others should have few) into blocks of about ``block`` points, so no group is one task's work.
    """
    along = along or axes[0]
    cells = [a for a in axes if a != along]
    place = [f"_{i}" for i in range(len(axes))]
    at = rows.select(*group, identity, *(_axis(a, rows.schema[a].dataType).alias(p) for a, p in zip([along, *cells], place)))
    points = cut(at.select(*group, *place).distinct())
    sizes = points.groupBy(*group).agg(F.count("*").alias("_n"))
    large = cut(sizes.where(F.col("_n") > most))
    if large.isEmpty():
        layered = _layered(points, group, place)
    else:
        same = all_of([F.col(f"p.{g}").eqNullSafe(F.col(f"q.{g}")) for g in group])
        small = points.alias("p").join(large.alias("q"), same, "left_anti")
        layered = _layered(small, group, place).unionByName(_layered_in_blocks(points, large, group, place, block))
    both = all_of([F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*group, *place)])
    return at.alias("r").join(layered.alias("l"), both).select(*(F.col(f"r.{g}").alias(g) for g in group), F.col(f"r.{identity}").alias(identity), F.col("l.layer").alias("layer"))


def _layered(points: DataFrame, group: list[str], place: list[str]) -> DataFrame:
    """The points with their layer, each group in an array; going down the first coordinates, a point's dominators come before it."""
    kind = ", ".join(f"{f}:double" for f in place)
    none = F.array().cast(f"array<struct<{kind},layer:int>>")
    beats = lambda x, y: all_of([x[f] >= y[f] for f in place])  # noqa: E731  (points are distinct)
    step = lambda done, x: F.array_append(done, F.struct(*(x[f].alias(f) for f in place), (1 + F.coalesce(F.array_max(F.transform(F.filter(done, lambda y: beats(y, x)), lambda y: y["layer"])), F.lit(0))).alias("layer")))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct(*place))))
    each = points.groupBy(*group).agg(ordered.alias("_rows")).select(*group, F.explode(F.aggregate("_rows", none, step)).alias("_r"))
    return each.select(*group, *(F.col(f"_r.{f}").alias(f) for f in place), F.col("_r.layer").alias("layer"))


def chain_step(points: np.ndarray, cells: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The layers of ``points`` (in descending order of their coordinates; the first is not of the cell), one row for each start of ``best``.

    ``best`` [start, cell] is the highest layer seen in each cell, counted from each start (-inf: not reached); it is updated.
    """
    covers = [np.flatnonzero((cells >= c).all(axis=1)) for c in cells]
    which = {tuple(c): i for i, c in enumerate(cells)}
    out = np.empty((len(points), len(best)))
    for i, p in enumerate(points):
        v = which[tuple(p[1:])]
        out[i] = 1 + best[:, covers[v]].max(axis=1)
        best[:, v] = np.maximum(best[:, v], out[i])
    return out


def _layered_in_blocks(points: DataFrame, large: DataFrame, group: list[str], place: list[str], block: int) -> DataFrame:
    """The points of ``large`` groups with their layer, in three steps over blocks along the first coordinate, highest first.

    Each block finds how much it lengthens chains from each cell to each other cell; a group's blocks, which are few, hand the highest layers on from one to the
    next; then each block layers its points from what it was handed.
    """
    fields = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    keys = ", ".join(f"{g} {fields[g]}" for g in group)
    same = all_of([F.col(f"p.{g}").eqNullSafe(F.col(f"q.{g}")) for g in group])
    parts = 1024
    mine = points.alias("p").join(large.alias("q"), same).select("p.*", F.col("_n"))
    cuts = mine.groupBy(*group).agg(F.percentile_approx("_0", F.array(*(F.lit(i / parts) for i in range(1, parts)))).alias("_cuts"), F.max("_n").alias("_m"), F.collect_set(F.array(*place[1:])).alias("_cells"))
    step = F.greatest(F.lit(1), F.floor(F.lit(parts) / F.ceil(F.col("_m") / block))).cast("int")
    cuts = cut(cuts.select(*group, F.array_distinct(F.filter("_cuts", lambda x, i: (i + 1) % step == 0)).alias("_cuts"), "_cells"))
    placed = cut(points.alias("p").join(cuts.alias("q"), same).select("p.*", F.size(F.filter("_cuts", lambda x: x > F.col("_0"))).alias("_block")))
    listed = cuts.select(*group, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_block"), "_cells")
    by = [*group, "_block"]

    def sorted_points(pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[place].to_numpy(dtype=float)
        return x[np.lexsort(tuple(-x[:, j] for j in range(x.shape[1] - 1, -1, -1)))]

    def grid(meta: pd.DataFrame) -> np.ndarray:
        return np.array(sorted(map(tuple, meta["_cells"].iat[0])), dtype=float).reshape(-1, len(place) - 1)

    def lengthened(pdf: pd.DataFrame, meta: pd.DataFrame) -> pd.DataFrame:
        cells = grid(meta)
        best = np.full((len(cells) + 1, len(cells)), -np.inf)
        best[np.arange(len(cells)), np.arange(len(cells))] = 0
        start = np.full((len(cells) + 1, 1), -np.inf)
        start[-1] = 0  # the last start is a chain that begins in the block
        grown = np.hstack([best, start])
        free = np.vstack([cells, np.full((1, cells.shape[1]), np.inf)])  # covered by every point
        chain_step(sorted_points(pdf), free, grown)
        return meta[by].assign(grown=[grown[:, :-1].ravel().tolist()])

    grown = placed.groupBy(*by).cogroup(listed.groupBy(*by)).applyInPandas(lengthened, f"{keys}, _block int, grown array<double>")

    def handed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        n = int((np.sqrt(1 + 4 * len(pdf["grown"].iat[0])) - 1) / 2)
        state, states = np.full(n, -np.inf), []
        for g in pdf["grown"]:
            states.append(state.tolist())
            m = np.asarray(g, dtype=float).reshape(n + 1, n)
            state = np.maximum((state[:, None] + m[:-1]).max(axis=0), m[-1])
        return pdf[by].assign(state=states)

    states = cut(grown).groupBy(*group).applyInPandas(handed, f"{keys}, _block int, state array<double>")
    told = states.alias("p").join(listed.alias("q"), all_of([F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by])).select("p.*", "_cells")

    def layers(pdf: pd.DataFrame, meta: pd.DataFrame) -> pd.DataFrame:
        x, cells = sorted_points(pdf), grid(meta)
        best = np.hstack([np.asarray(meta["state"].iat[0], dtype=float)[None, :], np.zeros((1, 1))])
        free = np.vstack([cells, np.full((1, cells.shape[1]), np.inf)])
        out = pd.DataFrame(x, columns=place).assign(layer=chain_step(x, free, best)[:, 0].astype(int))
        for g in group:
            out[g] = meta[g].iat[0]
        return out[[*group, *place, "layer"]]

    return placed.groupBy(*by).cogroup(told.groupBy(*by)).applyInPandas(layers, f"{keys}, {', '.join(f'{f} double' for f in place)}, layer int")


def all_of(conditions: list[Column]) -> Column:
    """The conjunction of some conditions."""
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def best_records(records: DataFrame, keys: DataFrame, group: tuple[str, ...] = ("build_id", "entity_key")) -> DataFrame:
    """One row for each group: the survivor, and the best values the group offers, field by field.

    Columns: the group, ``survivor_id``, ``n_records``, ``canonical_name``, ``entity_type``, ``key_properties`` (filled ones only),
    ``paper_ids`` (all, ascending, without nulls and repeats), ``layers``. Layers are computed over all records of a group. The survivor is the best of the first layer, the
    undominated records, by completeness, recency, trust and lowest record_id in this order. Every field takes the value of the lowest dominance layer
    that fills it, in a layer by the same policy; for name and type the most trusted record of the layer comes first. A group without any name or type has null there.
    ``record_id`` must be unique.
    """
    group = list(group)
    rows = cut(rated(records, keys).select(*group, "record_id", "canonical_name", "entity_type", "_filled", "paper_ids", "completeness", "recency", "trust", "_named"))
    papers = rows.select(*group, F.explode("paper_ids").alias("_p")).where("_p IS NOT NULL").distinct().groupBy(*group).agg(F.array_sort(F.collect_list("_p")).alias("paper_ids"))
    layers = dominance_layers(rows, group, ["completeness", "recency", "trust"], "record_id", along="recency")
    ranked = rows.drop("paper_ids").join(layers.select("record_id", "layer"), "record_id").withColumn("_order", F.struct("layer", -F.col("completeness"), -F.coalesce(F.unix_micros(F.col("recency").cast("timestamp")), F.lit(-(1 << 62))), -F.col("trust"), "record_id"))
    values = ranked.select(*group, "_order", F.explode("_filled").alias("_k", "_v")).groupBy(*group, "_k").agg(F.min_by("_v", "_order").alias("_v"))
    properties = values.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("key_properties"))
    one = lambda c, when: F.min_by(F.when(when, F.col(c)), F.when(when, F.struct("layer", -F.col("trust"), "_order")))
    first = F.col("layer") == 1
    heads = ranked.groupBy(*group).agg(
        F.min_by(F.when(first, F.col("record_id")), F.when(first, F.col("_order"))).alias("survivor_id"), F.count("*").alias("n_records"), one("canonical_name", F.col("_named")).alias("canonical_name"),
        one("entity_type", F.trim("entity_type") != "").alias("entity_type"), F.max("layer").alias("layers"),
    )
    out = heads.join(properties, group, "left").join(papers, group, "left")
    return out.select(*group, "survivor_id", "n_records", "canonical_name", "entity_type", F.coalesce("key_properties", F.create_map().cast("map<string,string>")).alias("key_properties"), F.coalesce("paper_ids", F.array().cast("array<int>")).alias("paper_ids"), "layers")


def duplicate_pairs(records: DataFrame, keys: DataFrame, survivors: DataFrame) -> DataFrame:
    """``record_id_a`` < ``record_id_b``, ``survivor_id``: the pairs of records of one build and entity.

    This lists all pairs because its result is defined so; ``best_records`` and ``entity_keys`` hold the same groups in one row a record.
    """
    member = records.select("record_id", "build_id").join(keys.select("record_id", "entity_key"), "record_id")
    a, b = member.withColumnRenamed("record_id", "record_id_a"), member.withColumnRenamed("record_id", "record_id_b")
    pairs = a.join(b, ["build_id", "entity_key"]).where("record_id_a < record_id_b")
    return pairs.join(survivors.select("build_id", "entity_key", "survivor_id"), ["build_id", "entity_key"]).select("record_id_a", "record_id_b", "survivor_id")
