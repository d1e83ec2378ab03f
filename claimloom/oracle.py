"""The SQL that gives the rows of the core's queries on the same parquet tables, in DuckDB's dialect."""

from __future__ import annotations

from claimloom import config

_q = lambda names: ", ".join("'" + n.replace("'", "''") + "'" for n in names)
_case = lambda c, weights, default: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {default} END"

_NAMES = ["Rirsemflav Neck Swelling", "Hurlohi Neck Swelling", "Skuvdaewis Signalling Pathway", "Autoimmune Thyroiditis"]
_GENERIC = ["Autoimmune Thyroiditis"]
_SPECIFIC = [n for n in _NAMES if n not in _GENERIC]
_QUESTION = "How does Rirsemflav Neck Swelling relate to Hurlohi Neck Swelling and the Skuvdaewis Signalling Pathway in Autoimmune Thyroiditis?"
_WORD = r"[^\t\n\x0b\x0c\r \x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SPACE = _WORD.replace("[^", "[")
_strip = lambda c: f"regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g')"
_count = lambda p: f"coalesce(polarity_counts['{p}'], 0)::BIGINT AS n_{p}"

# Views that several queries share; a query names those it needs, in this order.
_VIEWS = {
    "papers_v": "SELECT * EXCLUDE (paper_id, nth), try_cast(paper_id AS INTEGER) AS paper_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC) AS nth FROM papers WHERE paper_id IS NOT NULL) WHERE nth = 1 AND try_cast(paper_id AS INTEGER) IS NOT NULL",
    "current_v": "SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY (embedding IS NULL), embedded_at DESC) AS nth FROM claims WHERE claim_id IS NOT NULL) WHERE nth = 1",
    "claims_v": f"SELECT * EXCLUDE (k), {', '.join(_count(p) for p in config.POLARITIES)} FROM (SELECT *, row_number() OVER (PARTITION BY claim_signature ORDER BY claim_id DESC) AS k FROM current_v WHERE claim_signature IS NOT NULL) WHERE k = 1",
    "alive_v": "SELECT * FROM claims_v WHERE n_positive + n_negative + n_hypothetical > 0",
    "mentions_v": "SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY loaded_at DESC) AS nth FROM entity_mentions WHERE mention_id IS NOT NULL) WHERE nth = 1",
    "chunks_v": "SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY loaded_at DESC) AS nth FROM vector_chunks WHERE point_id IS NOT NULL) WHERE nth = 1",
    "profile_v": rf"SELECT point_id, paper_id, lower(regexp_replace(regexp_replace(regexp_replace(chunk_filename, '\.[^.]*$', ''), '^\d+-', ''), '^[\d._\s]+', '')) AS section, len(regexp_extract_all(text, '{_WORD}')) AS word_count, length(text) AS char_count, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM chunks_v",
    "links_v": "SELECT claim_signature, lower(source_name) AS name, unnest(list_distinct(paper_ids)) AS paper_id FROM claims_v",
    "evidence_v": f"SELECT l.claim_signature, m.mention_id AS evidence_id, {_strip('m.evidence')} AS evidence_text, m.paper_id, m.section_type FROM links_v l JOIN mentions_v m ON lower(m.canonical_name) = l.name AND m.paper_id = l.paper_id WHERE {_strip('m.evidence')} <> ''",
    "listed_v": f"SELECT e.*, p.study_design, p.published_year, row_number() OVER (PARTITION BY claim_signature ORDER BY {_case('e.section_type', config.SECTION_WEIGHTS, 0.4)} DESC, e.paper_id, e.evidence_id) AS nth FROM evidence_v e JOIN papers_v p USING (paper_id)",
    "weights_v": f"SELECT c.claim_id, max(coalesce({_case('''coalesce(nullif(p.study_design, ''), 'other')''', config.DESIGN_WEIGHTS, 0.4)}, 0.4)) AS w FROM (SELECT claim_id, unnest(paper_ids) AS paper_id FROM claims_v) c LEFT JOIN papers_v p USING (paper_id) GROUP BY c.claim_id",
    "query_v": "SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0",
    "section_v": f"SELECT claim_signature, max({_case('section_type', config.SECTION_WEIGHTS, 0.4)}) AS w FROM evidence_v WHERE section_type <> '' GROUP BY claim_signature",
    "scored_v": f"""SELECT c.*, coalesce(w.w, 0.4)::DOUBLE AS study_weight_max,
      ({_case("c.certainty_max", config.CERTAINTY_WEIGHTS, 0.2)})::DOUBLE * ln(1 + coalesce(c.paper_count, 0)) * coalesce(w.w, 0.4)::DOUBLE * coalesce(s.w, 0.4)::DOUBLE AS quality,
      CASE WHEN len(c.embedding) = 64 THEN coalesce(CASE WHEN isnan(list_cosine_similarity(c.embedding::DOUBLE[], q.q)) THEN 0 ELSE list_cosine_similarity(c.embedding::DOUBLE[], q.q) END, 0) ELSE 0 END AS cosine
      FROM claims_v c LEFT JOIN weights_v w USING (claim_id) LEFT JOIN section_v s USING (claim_signature), query_v q""",
    "live_v": "SELECT * FROM scored_v WHERE n_positive + n_negative + n_hypothetical > 0",
    "pairs_v": f"SELECT a.n AS s, b.n AS e FROM (SELECT unnest([{_q(_NAMES)}]) AS n, generate_subscripts([{_q(_NAMES)}], 1) AS i) a JOIN (SELECT unnest([{_q(_NAMES)}]) AS n, generate_subscripts([{_q(_NAMES)}], 1) AS i) b ON a.n NOT IN ({_q(_GENERIC)}) AND (b.n IN ({_q(_GENERIC)}) OR a.i < b.i)",
    "both_v": "SELECT s, e FROM pairs_v UNION SELECT e, s FROM pairs_v",
    "direct_v": f"SELECT claim_signature AS path_signature, 1 AS length, [source_name, target_name] AS entities, [relation_type] AS relations, quality, cosine FROM live_v WHERE source_name IN ({_q(_SPECIFIC)}) OR target_name IN ({_q(_SPECIFIC)})",
    "chains_v": f"SELECT DISTINCT a.claim_signature || '>>' || b.claim_signature AS path_signature, 2 AS length, [a.source_name, a.target_name, b.target_name] AS entities, [a.relation_type, b.relation_type] AS relations, a.quality * b.quality AS quality, (a.cosine + b.cosine) / 2 AS cosine FROM live_v a JOIN live_v b ON a.target_name = b.source_name JOIN both_v p ON a.source_name = p.s AND b.target_name = p.e WHERE a.target_name NOT IN ({_q(_GENERIC)}) AND a.target_name <> p.s AND a.target_name <> p.e",
    "paths_v": "SELECT * FROM direct_v UNION ALL SELECT * FROM chains_v",
    "anchored_v": f"SELECT *, list_filter(entities, lambda x: list_contains([{_q(_NAMES)}], x)) AS anchors, list_contains([{_q(_NAMES)}], entities[1]) AND list_contains([{_q(_NAMES)}], entities[-1]) AS both_ends FROM paths_v",
    "places_v": "SELECT *, row_number() OVER (PARTITION BY length ORDER BY quality DESC, path_signature) AS by_length FROM anchored_v",
    "buckets_v": f"SELECT DISTINCT path_signature FROM (SELECT path_signature, row_number() OVER (PARTITION BY a ORDER BY quality DESC, path_signature) AS n FROM (SELECT DISTINCT path_signature, quality, unnest(anchors) AS a FROM anchored_v) WHERE a IN ({_q(_SPECIFIC)})) WHERE n <= 5",
    "kept_v": f"SELECT *, (length = 2 AND by_length <= 10) OR (length = 1 AND len(list_filter(entities, lambda x: NOT list_contains([{_q(_SPECIFIC)}], x))) = 0) OR path_signature IN (SELECT path_signature FROM buckets_v) AS kept FROM places_v",
    "filled_v": "SELECT *, row_number() OVER (PARTITION BY kept ORDER BY quality DESC, path_signature) AS place, greatest(0, 40 - sum(kept::INTEGER) OVER ()) AS free FROM kept_v",
    "chosen_v": "SELECT * FROM filled_v WHERE kept OR place <= free",
    "vectored_v": "SELECT c.*, e.embedding FROM chunks_v c JOIN embeddings e ON e.vec_id = c.point_id % (SELECT count(*) FROM embeddings)",
    "nearest_v": "SELECT *, row_number() OVER (ORDER BY score DESC, point_id) AS k FROM (SELECT v.*, list_cosine_similarity(v.embedding::DOUBLE[], q.q) AS score FROM vectored_v v, query_v q) QUALIFY k <= 8",
    "words_v": f"SELECT *, lag(w) OVER (PARTITION BY paper_id, chunk_idx ORDER BY point_id) AS earlier FROM (SELECT paper_id, point_id, point_id % 1000000 // 1000 AS chunk_idx, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM chunks_v)",
    "whole_v": "SELECT paper_id, chunk_idx, greatest(0, ceil((sum(len(w) - CASE WHEN len(earlier) >= 80 AND earlier[-80:] = w[1:80] THEN 80 ELSE 0 END) - 400) / 320.0))::BIGINT + 1 AS n FROM words_v GROUP BY ALL",
    "ids_v": "SELECT paper_id::BIGINT * 1000000 + chunk_idx * 1000 + i AS point_id, i::INTEGER AS window_index, n::INTEGER AS window_count FROM (SELECT *, unnest(range(0, n)) AS i FROM whole_v)",
    "relations_v": """SELECT l_orderkey AS paper_id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_quantity > 45 THEN 'uncertain' WHEN l_returnflag = 'A' THEN 'positive' WHEN l_returnflag = 'R' THEN 'negative' ELSE 'hypothetical' END AS polarity,
      CASE WHEN l_discount < 0.03 THEN 'high' WHEN l_discount < 0.07 THEN 'moderate' ELSE 'low' END AS certainty, (['RESULTS', 'ABSTRACT', 'CONCLUSION', 'DISCUSSION', 'INTRODUCTION', 'METHODS', 'OTHER'])[l_linenumber % 7 + 1] AS section_type,
      CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE 'order ' || l_orderkey || ' line ' || l_linenumber END AS evidence, unnest([{'s': cn.n_name, 'st': 'nation', 'r': 'ordered', 't': p_brand, 'tt': 'brand'}, {'s': p_brand, 'st': 'brand', 'r': 'is_a_type_of', 't': p_type, 'tt': 'type'}, {'s': p_type, 'st': 'type', 'r': 'supplied_by', 't': sn.n_name, 'tt': 'nation'}]) AS e
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey""",
    "named_v": f"SELECT *, {_strip('canonical_name')} AS name, lower({_strip('canonical_name')}) AS key FROM mentions_v WHERE {_strip('canonical_name')} <> ''",
    "entities_v": f"""SELECT key, arg_min(name, mention_id) AS canonical_name, nullif(arg_min(coalesce(entity_type, chr(1)), mention_id), chr(1)) AS entity_type, list_sort(list_distinct(list_filter(flatten(list(aliases)), lambda x: x IS NOT NULL AND x <> '' AND (lower(x) = key OR NOT list_contains([{_q([p.lower() for p in config.PROTECTED_NAMES])}], lower(x)))))) AS aliases,
      max(CASE WHEN key_properties IS NULL THEN 0 ELSE len(list_filter(map_values(key_properties), lambda x: x IS NOT NULL)) END) AS filled, list_sort(list_distinct(list(paper_id))) AS paper_ids, list_sort(list_distinct(list(section_type))) AS section_types, list_sort(list_distinct(list(nullif(surface_form, '')))) AS surface_forms, count(*) AS mentions, min(mention_id) AS seq FROM named_v GROUP BY key""",
    "scores_v": "SELECT claim_id AS id, unnest([{'metric': 'AnswerRelevancyMetric', 'score': CASE WHEN t > 0 THEN n_positive / t END}, {'metric': 'FaithfulnessMetric', 'score': CASE WHEN t > 0 THEN n_negative / t END}, {'metric': 'ContextualPrecisionMetric', 'score': CASE WHEN t > 0 THEN n_hypothetical / t END}, {'metric': 'ContextualRecallMetric', 'score': CASE certainty_max WHEN 'high' THEN 1.0::DOUBLE WHEN 'moderate' THEN 0.6::DOUBLE WHEN 'low' THEN 0.2::DOUBLE ELSE CASE WHEN certainty_max IS NOT NULL THEN 0.2::DOUBLE END END}]) AS s FROM (SELECT *, (n_positive + n_negative + n_hypothetical + n_uncertain + n_mixed)::DOUBLE AS t FROM claims_v)",
}
_NEEDS = {
    "claims_v": ["current_v"], "alive_v": ["claims_v"], "profile_v": ["chunks_v"], "links_v": ["claims_v"], "evidence_v": ["links_v", "mentions_v"], "listed_v": ["evidence_v", "papers_v"], "weights_v": ["claims_v", "papers_v"], "section_v": ["evidence_v"],
    "scored_v": ["weights_v", "section_v", "query_v"], "live_v": ["scored_v"], "both_v": ["pairs_v"], "direct_v": ["live_v"], "chains_v": ["live_v", "both_v"], "paths_v": ["direct_v", "chains_v"], "anchored_v": ["paths_v"], "places_v": ["anchored_v"],
    "buckets_v": ["anchored_v"], "kept_v": ["places_v", "buckets_v"], "vectored_v": ["chunks_v"], "nearest_v": ["vectored_v", "query_v"], "words_v": ["chunks_v"], "whole_v": ["words_v"], "ids_v": ["whole_v"], "filled_v": ["kept_v"], "chosen_v": ["filled_v"], "named_v": ["mentions_v"], "entities_v": ["named_v"], "scores_v": ["claims_v"],
}


def _sql(body: str) -> str:
    """A query with the views it needs in front."""
    wanted: set[str] = set()
    todo = [v for v in _VIEWS if v in body]
    while todo:
        v = todo.pop()
        if v not in wanted:
            wanted.add(v)
            todo += _NEEDS.get(v, [])
    views = ", ".join(f"{v} AS ({_VIEWS[v]})" for v in _VIEWS if v in wanted)
    return f"WITH {views} {body}" if views else body


_rich = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(h, '{k}')" for k in keys) + f" THEN '{label}'" for label, keys in config.RICH_SECTIONS) + " ELSE 'OTHER' END"
_narrow = "CASE " + " ".join(f"WHEN contains(s, '{k}') THEN '{label}'" for k, label in config.REGISTRY_SECTIONS) + " ELSE 'OTHER' END"
_stem = r"regexp_replace(regexp_replace(chunk_filename, '\.[^.]*$', ''), '_(entities|relations)$', '')"
_sizes = "SELECT '{c}' AS column_name, count({c}) AS \"count\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, max({c})::DOUBLE AS max FROM profile_v"
_dup = "SELECT '{t}' AS table_name, count(*) AS broken_keys, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT {k}, count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1 OR {k} IS NULL)"
_quota = lambda score: f"""SELECT path_signature, length, score, row_number() OVER (ORDER BY score DESC, path_signature)::INTEGER AS rank FROM (
  SELECT *, least(n1, 4) + least(n1 - least(n1, 4), greatest(0, 4 - p2)) AS p1 FROM (SELECT *, least(n2, 4 + (4 - least(n1, 4))) AS p2 FROM (
  SELECT *, {score} AS score, row_number() OVER (PARTITION BY length ORDER BY both_ends DESC, {score} DESC, path_signature) AS n, count(*) FILTER (WHERE length = 1) OVER () AS n1, count(*) FILTER (WHERE length = 2) OVER () AS n2 FROM {{source}})))
  WHERE CASE length WHEN 1 THEN n <= p1 ELSE n <= p2 END ORDER BY score DESC, path_signature LIMIT 8"""  # noqa: E731
_final = _quota("cosine").format(source="chosen_v")
_block = lambda c, label, indent: f"'{indent}' || {label} || ' ' || {c}.source_name || ' -> ' || {c}.relation_type || ' -> ' || {c}.target_name || chr(10) || '{indent}     Certainty: ' || coalesce({c}.certainty_max, '?') || ' | Papers: ' || coalesce({c}.paper_count::VARCHAR, '?') || chr(10) || coalesce({c}.ev{len(indent)}, '')"
_passage = "'[V' || k || '] Paper P' || coalesce(paper_id::VARCHAR, '?') || ' | ' || coalesce(section_type, '?') || ' | ' || coalesce(section_name, '') || chr(10) || '     Cite as: [V' || k || ' (P' || coalesce(paper_id::VARCHAR, '?') || ')]' || chr(10) || '     ' || trim(coalesce(text, '')) || chr(10) || chr(10)"
_evidence_text = "'- [P' || coalesce(paper_id::VARCHAR, '?') || ', ' || coalesce(study_design, '?') || ', ' || coalesce(published_year, '?') || '] [' || coalesce(section_type, '?') || '] ' || evidence_text || chr(10)"
_listed = f"SELECT claim_signature, string_agg('     ' || {_evidence_text}, '' ORDER BY nth) AS ev0, string_agg('          ' || {_evidence_text}, '' ORDER BY nth) AS ev5 FROM listed_v WHERE nth <= 2 GROUP BY claim_signature"
_told = f"(SELECT c.*, e.ev0, e.ev5 FROM claims_v c LEFT JOIN ({_listed}) e USING (claim_signature))"
_direct = f"(SELECT rank, '[G' || row_number() OVER (ORDER BY rank) || ']' AS label, {_block('c', "('[G' || row_number() OVER (ORDER BY rank) || ']')", '')} || chr(10) AS block FROM ({_final}) f JOIN {_told} c ON c.claim_signature = f.path_signature WHERE f.length = 1)"
_chains = f"""(SELECT rank, label, label || ' CHAIN: ' || a.source_name || ' -> ' || a.relation_type || ' -> ' || a.target_name || ' -> ' || b.relation_type || ' -> ' || b.target_name || chr(10) || '     Bridge: ' || a.target_name || chr(10)
  || {_block('a', "(rtrim(label, ']') || '.1]')", '     ')} || {_block('b', "(rtrim(label, ']') || '.2]')", '     ')} || chr(10) AS block
  FROM (SELECT *, '[G' || (row_number() OVER (ORDER BY rank) + (SELECT count(*) FROM ({_final}) WHERE length = 1)) || ']' AS label FROM ({_final}) WHERE length = 2) f JOIN {_told} a ON a.claim_signature = split_part(path_signature, '>>', 1) JOIN {_told} b ON b.claim_signature = split_part(path_signature, '>>', 2))"""

SQL = {
    "claim_registry_agg": _sql("""SELECT e.s || '|' || e.r || '|' || e.t AS claim_signature, e.st AS source_type, e.tt AS target_type, count(*) FILTER (WHERE polarity = 'positive') AS n_positive, count(*) FILTER (WHERE polarity = 'negative') AS n_negative, count(*) FILTER (WHERE polarity = 'hypothetical') AS n_hypothetical,
      count(*) FILTER (WHERE polarity = 'uncertain') AS n_uncertain, count(*) FILTER (WHERE polarity = 'mixed') AS n_mixed, (['low', 'moderate', 'high'])[max(CASE certainty WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END)] AS certainty_max, count(DISTINCT paper_id) AS paper_count, count(*) AS mentions, count(*) FILTER (WHERE evidence <> '') AS evidence_count FROM relations_v GROUP BY ALL"""),
    "certainty_max": _sql("SELECT relation_type, target_name, arg_max(coalesce(certainty_max, '\u0000'), (CASE certainty_max WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 WHEN 'low' THEN 0 ELSE -1 END, -claim_id)) AS c, count(*) AS claims FROM claims_v GROUP BY ALL").replace("SELECT relation_type, target_name, arg_max", "SELECT relation_type, target_name, nullif(c, '\u0000') AS certainty_max, claims FROM (SELECT relation_type, target_name, arg_max") + ")",
    "claim_first_type": _sql("SELECT key AS name, arg_min(coalesce(entity_type, ''), mention_id) AS entity_type, count(*) AS mentions FROM named_v GROUP BY key"),
    "evidence_ids": _sql("SELECT claim_signature, count(*) AS evidence, count(DISTINCT id) AS ids, min(id) AS least_id FROM (SELECT DISTINCT e.s || '|' || e.r || '|' || e.t AS claim_signature, md5(concat_ws('|', e.s || '|' || e.r || '|' || e.t, paper_id, section_type, polarity, certainty, evidence)) AS id FROM relations_v WHERE evidence <> '') GROUP BY claim_signature"),
    "entity_merge": _sql("SELECT canonical_name, entity_type, len(aliases)::INTEGER AS aliases, filled::INTEGER AS filled_properties, array_to_string(paper_ids, ',') AS paper_ids, array_to_string(section_types, ',') AS section_types, len(surface_forms)::INTEGER AS surface_forms, mentions FROM entities_v"),
    "forms_collision": _sql("SELECT form, arg_max(canonical_name, (len(paper_ids), -seq)) AS canonical_name, count(*) AS contenders FROM (SELECT canonical_name, paper_ids, seq, unnest(list_distinct(list_transform(list_concat([canonical_name], aliases, surface_forms), lambda x: lower(x)))) AS form FROM entities_v) WHERE form <> '' GROUP BY form"),
    "name_resolution": _sql("SELECT c.claim_id, c.source_name AS source_as_written, coalesce(a.n, c.source_name) AS source_name, coalesce(b.n, c.target_name) AS target_name FROM claims_v c LEFT JOIN (SELECT form, max(canonical_name) AS n FROM forms_index GROUP BY form) a ON a.form = lower(c.source_name) LEFT JOIN (SELECT form, max(canonical_name) AS n FROM forms_index GROUP BY form) b ON b.form = lower(c.target_name)"),
    "protected_aliases": "SELECT term_id, array_to_string(list_filter(aliases, lambda a: a IS NOT NULL AND a <> '' AND (lower(a) = lower(canonical) OR NOT list_contains(g, lower(a)))), '|') AS aliases FROM canonical_terms, (SELECT list(lower(canonical)) AS g FROM canonical_terms WHERE entity_type = 'Gene')",
    "claim_paper_weight": _sql("SELECT c.claim_id, coalesce(w.w, 0.4)::DOUBLE AS study_weight_max FROM claims_v c LEFT JOIN weights_v w USING (claim_id)"),
    "malformed_relations": "SELECT relation_type, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS malformed FROM (SELECT *, coalesce(trim(source_name) <> '' AND trim(relation_type) <> '' AND trim(target_name) <> '', false) AS ok FROM claims) GROUP BY relation_type",
    "relation_whitelist": _sql(f"SELECT relation_type IN ({_q(config.RELATION_TYPES)}) AS known, relation_type IN ({_q(config.METHODS_RELATIONS)}) AS in_methods, count(*) AS claims FROM claims_v GROUP BY ALL"),
    "ngram_spans": _sql(f"SELECT lower(array_to_string(w, ' ')) AS span, count(DISTINCT paper_id) AS papers, max(n)::INTEGER AS n FROM (SELECT paper_id, n, t[i:i + n - 1] AS w FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT paper_id, regexp_extract_all(title, '[A-Za-z0-9'']+') AS t FROM papers_v WHERE title IS NOT NULL), (SELECT unnest([1, 2, 3, 4, 5]) AS n))) WHERE len(list_filter(w, lambda x: NOT list_contains([{_q(config.STOPWORDS)}], lower(x)))) > 0 AND (n > 1 OR length(w[1]) >= 3) GROUP BY 1"),
    "constraint_check": " UNION ALL ".join(_dup.format(t=t, k=k) for t, k in (("papers", "paper_id"), ("claims", "claim_id"), ("canonical_terms", "term_id"), ("entity_mentions", "mention_id"))),
    "target_edges": _sql("SELECT claim_signature, target_name AS canonical_name FROM claims_v WHERE source_name IN (SELECT canonical FROM canonical_terms) AND target_name IN (SELECT canonical FROM canonical_terms)"),
    "polarity_edges": _sql("SELECT source_name AS canonical_name, claim_signature, p.polarity, p.n FROM (SELECT source_name, claim_signature, unnest([{'polarity': 'positive', 'n': n_positive}, {'polarity': 'negative', 'n': n_negative}, {'polarity': 'hypothetical', 'n': n_hypothetical}]) AS p FROM claims_v) WHERE p.n > 0 AND source_name IN (SELECT canonical FROM canonical_terms)"),
    "evidence_edges": _sql("SELECT claim_signature, evidence_id, paper_id FROM evidence_v WHERE paper_id IN (SELECT paper_id FROM papers_v)"),
    "onehop_specific": _sql(f"SELECT claim_signature, source_name, target_name, coalesce(paper_count, 0) AS paper_count FROM alive_v WHERE source_name IN ({_q(_SPECIFIC)}) OR target_name IN ({_q(_SPECIFIC)})"),
    "onehop_generic_specific": _sql(f"SELECT claim_signature FROM alive_v WHERE (source_name IN ({_q(_SPECIFIC)}) AND target_name IN ({_q(_GENERIC)})) OR (source_name IN ({_q(_GENERIC)}) AND target_name IN ({_q(_SPECIFIC)}))"),
    "evidence_join": _sql("SELECT c.claim_signature, count(e.evidence_id)::INTEGER AS n, coalesce(string_agg(e.evidence_text, ' / ' ORDER BY e.nth), '') AS texts FROM claims_v c LEFT JOIN (SELECT * FROM listed_v WHERE nth <= 2) e USING (claim_signature) GROUP BY c.claim_signature"),
    "anchored_pairs": _sql('SELECT s AS start, e AS "end" FROM pairs_v'),
    "twohop_paths": _sql("SELECT path_signature, entities[1] AS source_name, entities[2] AS bridge_name, entities[3] AS target_name FROM chains_v"),
    "merge_paths": _sql("SELECT path_signature, length, array_to_string(anchors, '|') AS anchors FROM anchored_v"),
    "hop_counts": _sql("SELECT count(*) FILTER (WHERE length = 1) AS direct, count(*) FILTER (WHERE length = 2) AS chains FROM paths_v"),
    "graph_summary": _sql("SELECT name, sum(o)::BIGINT AS claims_out, sum(i)::BIGINT AS claims_in FROM (SELECT source_name AS name, 1 AS o, 0 AS i FROM alive_v UNION ALL SELECT target_name, 0, 1 FROM alive_v) GROUP BY name"),
    "claim_quality": _sql("SELECT claim_signature, round(quality, 6) AS quality FROM scored_v"),
    "path_quality": _sql("SELECT path_signature, round(quality, 6) AS quality FROM paths_v"),
    "quality_prefilter": _sql("SELECT path_signature, round(quality, 6) AS quality FROM chosen_v"),
    "entity_bucket_topk": _sql("SELECT claim_signature, quality, entity, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY quality DESC, claim_signature) AS place FROM (SELECT claim_signature, round(quality, 6) AS quality, unnest(list_distinct([source_name, target_name])) AS entity FROM scored_v)) WHERE place <= 5"),
    "quota_spill": _sql(_quota("round(quality, 6)").format(source="anchored_v")),
    "evidence_topk": _sql("SELECT claim_signature, nth::INTEGER AS place, paper_id, section_type, evidence_text FROM listed_v WHERE nth <= 2"),
    "hybrid_rank": _sql("SELECT rank, path_signature, length, round(score, 6) AS hybrid, round(c.quality, 6) AS quality FROM (" + _quota("cosine").format(source="chosen_v") + ") JOIN chosen_v c USING (path_signature, length)"),
    "vector_topk": _sql("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, query_v ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 8"),
    "vector_check": "SELECT coalesce(len(embedding), -1)::INTEGER AS length, count(*) AS rows FROM claims WHERE embedding IS NULL OR len(embedding) <> 64 GROUP BY 1",
    "cosine_matrix_label": _sql("SELECT label, round(avg(list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS mean, round(max(list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS greatest, count(*) AS n FROM embeddings, query_v GROUP BY label"),
    "embed_text": _sql("SELECT paper_id, coalesce(nullif(purpose_of_work, ''), title, '') AS embed_text FROM papers_v"),
    "claim_texts": _sql("SELECT c.claim_signature, c.source_name || ' ' || c.relation_type || ' ' || c.target_name || coalesce('. ' || string_agg(e.evidence_text, '. ' ORDER BY e.nth), '') AS claim_text FROM claims_v c LEFT JOIN (SELECT * FROM listed_v WHERE nth <= 2) e USING (claim_signature) GROUP BY c.claim_signature, c.source_name, c.relation_type, c.target_name"),
    "reembed_changed": "SELECT point_id FROM (SELECT point_id, first_value(text) OVER (PARTITION BY point_id ORDER BY loaded_at, text NULLS FIRST) AS a, first_value(text) OVER (PARTITION BY point_id ORDER BY loaded_at DESC, text NULLS LAST) AS b, row_number() OVER (PARTITION BY point_id) AS k FROM vector_chunks) WHERE k = 1 AND a IS DISTINCT FROM b",
    "sliding_windows": rf"SELECT doc_id, (first / 320)::INTEGER AS window_index, len(w[first + 1:first + 400])::INTEGER AS words, md5(array_to_string(w[first + 1:first + 400], ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 400) / 320.0))::BIGINT * 320 + 1, 320)) AS first FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents))",
    "section_type_registry": _sql(rf"SELECT point_id, {_narrow} AS section, display FROM (SELECT point_id, lower(regexp_replace(regexp_replace({_stem}, '^\d+-', ''), '^[\d.]+_?', '')) AS s, trim(replace(regexp_replace({_stem}, '^\d+-', ''), '_', ' '), ' .') AS display FROM chunks_v WHERE chunk_filename IS NOT NULL)"),
    "section_type_rich": _sql(rf"SELECT {_rich} AS section, {_narrow} AS narrow, count(*) AS n FROM (SELECT lower(trim(regexp_replace(section_name, '^[\d.\s]+', ''))) AS h, lower(regexp_replace(regexp_replace(regexp_replace(section_name, '_(entities|relations)$', ''), '^\d+-', ''), '^[\d.]+_?', '')) AS s FROM chunks_v WHERE section_name IS NOT NULL) GROUP BY ALL"),
    "skip_sections": _sql(rf"SELECT point_id, regexp_matches(regexp_replace(lower(regexp_replace(regexp_replace(chunk_filename, '\.[^.]*$', ''), '^[^-]*-', '')), '^[\d._\s]+', ''), '^(references|appendix)(_.*)?$') AS skipped, coalesce(lower(trim(section_name)) NOT IN ({_q(config.NO_CONTENT_SECTIONS)}), true) AS content, regexp_replace(coalesce(section_name, ''), '[\\/*?:\"<>|]', '_', 'g') AS safe_name FROM chunks_v WHERE chunk_filename IS NOT NULL"),
    "structure_parse": _sql(r"""SELECT paper_id, no::BIGINT AS header_no, max(name) FILTER (WHERE h) AS header, coalesce(string_agg(name, '|' ORDER BY point_id) FILTER (WHERE NOT h), '') AS subheaders FROM (
      SELECT *, sum(h::INTEGER) OVER (PARTITION BY paper_id ORDER BY point_id ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT paper_id, point_id, section_type IS DISTINCT FROM 'OTHER' AS h, regexp_replace(regexp_replace(trim(replace(regexp_replace(trim(section_name), '[\s*]+', ' ', 'g'), ' | ', '. ')), '\*+$', ''), ':+$', '') AS name FROM chunks_v WHERE section_name IS NOT NULL)) WHERE no > 0 GROUP BY paper_id, no"""),
    "next_header": _sql(f"SELECT paper_id, pos, header, next_header, row_number() OVER (PARTITION BY paper_id ORDER BY pos)::INTEGER AS section_no FROM (SELECT paper_id, point_id AS pos, {_strip('section_name')} AS header, lead({_strip('section_name')}) OVER (PARTITION BY paper_id ORDER BY point_id) AS next_header FROM chunks_v WHERE section_name IS NOT NULL) WHERE lower(trim(header)) NOT IN ({_q(config.NO_CONTENT_SECTIONS)})"),
    "batch_numbering": _sql("SELECT paper_id, ceil(row_number() OVER (ORDER BY paper_id) / 10.0)::INTEGER AS batch FROM papers_v"),
    "think_strip_parse": _sql("SELECT claim_id, relation_type, target_name FROM claims_v"),
    "json_roundtrip": "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k, count(*) FILTER (WHERE NOT json_valid(props)) AS bad, count(*) AS n FROM events GROUP BY event_type",
    "natural_order": _sql(r"SELECT point_id, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN len(r) > 0 THEN r ELSE [0]::HUGEINT[] END, chunk_filename, point_id)::INTEGER AS place FROM (SELECT *, list_transform(regexp_extract_all(chunk_filename, '\d+'), lambda x: x::HUGEINT) AS r FROM chunks_v WHERE chunk_filename IS NOT NULL)"),
    "chunk_profile": _sql("SELECT point_id, paper_id, section, word_count::INTEGER AS word_count, char_count::INTEGER AS char_count, line_count::INTEGER AS line_count FROM profile_v"),
    "describe_words": _sql(" UNION ALL ".join(_sizes.format(c=c) for c in ("word_count", "char_count", "line_count"))),
    "sections_per_paper": _sql("SELECT paper_id, count(*) AS n, count(*) = 1 AS single FROM chunks_v GROUP BY paper_id"),
    "percentiles": _sql(" UNION ALL ".join(f"SELECT {p} AS p, floor(quantile_cont(word_count::DOUBLE, {p / 100}))::BIGINT AS value FROM profile_v" for p in config.PERCENTILES)),
    "threshold_sweep": _sql(" UNION ALL ".join(f"SELECT {t} AS threshold, count(*) FILTER (WHERE word_count > {t}) AS n, round(count(*) FILTER (WHERE word_count > {t}) * 100.0::DOUBLE / count(*), 6) AS n_share, coalesce(sum(word_count) FILTER (WHERE word_count > {t}), 0)::BIGINT AS total, round(coalesce(sum(word_count) FILTER (WHERE word_count > {t}), 0) * 100.0::DOUBLE / sum(word_count), 6) AS total_share FROM profile_v" for t in config.LENGTH_THRESHOLDS)),
    "value_counts_top25": _sql("SELECT section, count(*) AS n FROM profile_v WHERE section IS NOT NULL GROUP BY section ORDER BY n DESC, section LIMIT 25"),
    "histogram_bins": _sql("SELECT least(50, floor((word_count - lo) / (hi - lo)::DOUBLE * 50) + 1)::INTEGER AS bin, count(*) AS n FROM profile_v, (SELECT min(word_count) AS lo, max(word_count) AS hi FROM profile_v) WHERE word_count IS NOT NULL GROUP BY 1"),
    "longest_chunks": _sql("SELECT point_id, word_count::INTEGER AS word_count FROM profile_v ORDER BY word_count DESC, point_id LIMIT 20"),
    "stub_chunks": _sql("SELECT point_id, word_count::INTEGER AS word_count FROM profile_v WHERE word_count < 30 OR word_count > 2500"),
    "papers_per_year": _sql("SELECT " + _strip("published_year") + " AS year, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM papers_v GROUP BY 1"),
    "paper_ranges": _sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::BIGINT AS least, max({c})::BIGINT AS greatest, (max({c}) - min({c}))::BIGINT AS span FROM papers_v" for c in ("pages", "n_tables", "n_figures"))),
    "keyword_categories": _sql("SELECT CASE WHEN n_tables IS NULL OR n_tables = 0 THEN 'none' WHEN n_tables = 1 THEN 'one' WHEN n_tables = 2 THEN 'two' ELSE 'more' END AS category, count(*) AS n FROM papers_v GROUP BY 1"),
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM papers" for c in "paper_id doi title published_year author_list countries purpose_of_work keywords study_design pages n_tables n_figures ingested_at".split()),
    "doi_coverage": _sql("SELECT count(*) FILTER (WHERE ok) AS filled, count(*) AS rows, round(count(*) FILTER (WHERE ok) * 100.0::DOUBLE / count(*), 6) AS share FROM (SELECT coalesce(lower(trim(doi)), '') NOT IN ('', 'null') AS ok FROM papers_v)"),
    "explode_counts": _sql("SELECT country, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM papers_v), 6) AS share FROM (SELECT unnest(list_distinct(countries)) AS country FROM papers_v) WHERE country IS NOT NULL GROUP BY country"),
    "list_size_dist": _sql("SELECT CASE WHEN k >= 4 THEN '4+' ELSE k::VARCHAR END AS items, count(*) AS n FROM (SELECT coalesce(len(countries), 0) AS k FROM papers_v) GROUP BY 1"),
    "design_weights": _sql(f"SELECT design, count(*) AS n, max({_case('design', config.DESIGN_WEIGHTS, 0.4)})::DOUBLE AS weight FROM (SELECT coalesce(nullif(study_design, ''), 'other') AS design FROM papers_v) GROUP BY design"),
    "upsert_last_wins": "WITH s AS (SELECT paper_id, pages FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC, title NULLS FIRST) AS k FROM papers WHERE pages % 2 = 0) WHERE k = 1), i AS (SELECT paper_id, pages FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC) AS k FROM papers WHERE pages % 2 <> 0 OR pages IS NULL) WHERE k = 1) SELECT * FROM i UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.paper_id = s.paper_id)",
    "whole_window_ids": _sql("SELECT * FROM ids_v"),
    "whole_skip_existing": _sql("SELECT * FROM ids_v s WHERE NOT EXISTS (SELECT 1 FROM vector_chunks v WHERE v.point_id = s.point_id)"),
    "relation_verdicts": _sql(f"""SELECT relation_type, CASE WHEN relation_type IN ({_q(config.RELATION_TYPES)}) IS NOT TRUE THEN 'relation' WHEN st IS NULL OR tt IS NULL THEN 'untyped' WHEN list_contains(w, lower(relation_type || '|' || st || '|' || tt)) THEN 'allowed' WHEN list_contains(w, lower(relation_type || '|' || tt || '|' || st)) THEN 'direction' ELSE 'ends' END AS verdict, count(*) AS claims
      FROM (SELECT c.relation_type, nullif(trim(a.t), '') AS st, nullif(trim(b.t), '') AS tt FROM claims_v c LEFT JOIN (SELECT canonical, min(entity_type) AS t FROM canonical_terms GROUP BY 1) a ON a.canonical = c.source_name LEFT JOIN (SELECT canonical, min(entity_type) AS t FROM canonical_terms GROUP BY 1) b ON b.canonical = c.target_name), (SELECT [{_q("|".join(r).lower() for r in config.relation_ends())}] AS w) GROUP BY ALL"""),
    "methods_relations": _sql(f"SELECT relation_type, section_type, count(*) AS evidence FROM evidence_v JOIN (SELECT claim_signature, relation_type FROM claims_v) USING (claim_signature) WHERE section_type IS DISTINCT FROM 'METHODS' OR relation_type IN ({_q(config.METHODS_RELATIONS)}) GROUP BY ALL"),
    "ontology_join": _sql("SELECT m.mention_id, t.ontology FROM mentions_v m LEFT JOIN (SELECT canonical, entity_type, min(term_id) AS ontology FROM canonical_terms GROUP BY ALL) t ON t.canonical = m.canonical_name AND t.entity_type = m.entity_type"),
    "entity_lists": _sql("SELECT paper_id, md5(string_agg('- ' || coalesce(canonical_name, '?') || ' (' || coalesce(entity_type, '?') || ')', chr(10) ORDER BY mention_id)) AS digest FROM mentions_v GROUP BY paper_id"),
    "passages_topk": _sql(f"SELECT '[V' || k || ']' AS label, point_id, round(score, 6) AS score, md5({_passage}) AS digest FROM nearest_v"),
    "chain_blocks": _sql("SELECT label, block FROM " + _chains),
    "answer_prompt": _sql(f"""SELECT length(p)::INTEGER AS n_chars, md5(p) AS digest FROM (SELECT '## QUESTION' || chr(10) || '{_QUESTION}' || chr(10) || chr(10) || '## GRAPH EVIDENCE' || chr(10) || coalesce((SELECT string_agg(block, '' ORDER BY rank) FROM {_direct}), '') || coalesce((SELECT string_agg(block, '' ORDER BY rank) FROM {_chains}), '')
      || chr(10) || '## PASSAGES' || chr(10) || coalesce((SELECT string_agg({_passage}, '' ORDER BY k) FROM nearest_v), '') || chr(10) || '## ANSWER' || chr(10) || 'Answer from the evidence above and cite it inline by its labels.' AS p)"""),
    "judge_scores": _sql("""SELECT claim_id, m.metric AS metric, round(s, 6) AS score, s >= 0.7 AS success FROM (SELECT *, CASE WHEN m.b IS NOT NULL AND len(m.a) > 0 THEN len(list_intersect(m.a, m.b)) / len(m.a)::DOUBLE END AS s FROM (SELECT claim_id, unnest([
      {'metric': 'AnswerRelevancyMetric', 'a': q, 'b': c}, {'metric': 'FaithfulnessMetric', 'a': c, 'b': c}, {'metric': 'ContextualPrecisionMetric', 'a': c, 'b': e}, {'metric': 'ContextualRecallMetric', 'a': e, 'b': c}, {'metric': 'ContextualRelevancyMetric', 'a': q, 'b': c}]) AS m FROM (
      SELECT claim_id, """ + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN list_distinct(regexp_extract_all(lower({c}), '{_WORD}')) END AS {n}" for c, n in (("concat_ws(' ', source_name, target_name)", "q"), ("embedding_text", "c"), ("p.title", "e"))) + """ FROM claims_v c JOIN papers_v p ON p.paper_id = c.paper_ids[1])))"""),
    "claim_backfill": _sql("SELECT claim_signature, 64 AS dimensions FROM (SELECT c.claim_signature, c.embedding_text, c.source_name || ' ' || c.relation_type || ' ' || c.target_name || coalesce('. ' || string_agg(e.evidence_text, '. ' ORDER BY e.nth), '') AS text FROM claims_v c LEFT JOIN (SELECT * FROM listed_v WHERE nth <= 2) e USING (claim_signature) GROUP BY c.claim_signature, c.embedding_text, c.source_name, c.relation_type, c.target_name) WHERE text IS DISTINCT FROM embedding_text AND text <> ''"),
    "table_items": _sql("SELECT paper_id, i::INTEGER AS table_id, title AS caption, 1 AS groups FROM (SELECT *, unnest(range(1, n_tables + 1)) AS i FROM papers_v WHERE n_tables > 0)"),
    "eval_means": _sql("SELECT s.metric AS metric, round(avg(s.score), 6) AS mean, count(s.score) AS n FROM scores_v GROUP BY 1"),
    "ragas_row": _sql("SELECT id, round(CASE WHEN count(s.score) = 4 THEN sum(s.score) / 4 END, 6) AS overall FROM scores_v GROUP BY id"),
    "eval_join": _sql("SELECT c.claim_id, coalesce(p.title, '') AS expected_answer FROM claims_v c JOIN papers_v p ON p.paper_id = c.paper_ids[1] WHERE trim(c.embedding_text) <> ''"),
    "usage_rollup": "SELECT CASE WHEN grouping(event_type) = 1 THEN 'TOTAL' ELSE event_type END AS event_type, count(*) AS calls, sum((props->>'$.k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY ROLLUP (event_type)",
    "run_metrics": "SELECT count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, round(sum(value), 3) AS total_s, round(avg(value), 6) AS mean_s, max(user_id % 512) AS most_mb FROM events",
    "prompt_graph_block": _sql("""SELECT label, '' || label || ' ' || source_name || ' -> ' || relation_type || ' -> ' || target_name || chr(10) || '     Certainty: ' || coalesce(certainty_max, '?') || ' | Papers: ' || coalesce(paper_count::VARCHAR, '?') || chr(10) || coalesce(ev, '') || chr(10) AS block FROM (
      SELECT '[G' || row_number() OVER (ORDER BY f.rank) || ']' AS label, c.*, e.ev FROM (""" + _quota("cosine").format(source="chosen_v") + f""") f JOIN claims_v c ON c.claim_signature = f.path_signature LEFT JOIN (SELECT claim_signature, string_agg('     ' || {_evidence_text}, '' ORDER BY nth) AS ev FROM listed_v WHERE nth <= 2 GROUP BY claim_signature) e USING (claim_signature) WHERE f.length = 1)"""),
    "prompt_vector_block": _sql("SELECT '[V' || k || ']' AS label, md5('[V' || k || '] Paper P' || coalesce(paper_id::VARCHAR, '?') || ' | ' || coalesce(section_type, '?') || ' | ' || coalesce(section_name, '') || chr(10) || '     Cite as: [V' || k || ' (P' || coalesce(paper_id::VARCHAR, '?') || ')]' || chr(10) || '     ' || trim(coalesce(text, '')) || chr(10) || chr(10)) AS digest FROM (SELECT *, row_number() OVER (ORDER BY length(text) DESC, point_id) AS k FROM chunks_v) WHERE k <= 8"),
    "chain_strings": _sql("SELECT path_signature, entities[1] || ' --[' || relations[1] || ']--> ' || entities[2] || CASE WHEN length = 2 THEN ' --[' || relations[2] || ']--> ' || entities[3] ELSE '' END AS line FROM paths_v"),
    "context_lines": _sql("SELECT claim_signature AS path_signature, (nth - 1)::INTEGER AS evidence_no, md5('(' || source_name || ') -[' || relation_type || ']-> (' || target_name || ')' || chr(10) || 'Evidence (Paper ' || paper_id || ', ' || coalesce(published_year, '?') || ', ' || coalesce(section_type, '?') || '): ' || evidence_text) AS digest FROM listed_v JOIN (SELECT claim_signature, source_name, relation_type, target_name FROM claims_v) USING (claim_signature)"),
    "vocabulary_render": "SELECT entity_type, md5(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT entity_type, '- ' || canonical || CASE WHEN len(aliases) > 0 THEN ' (' || array_to_string(aliases, ', ') || ')' ELSE '' END AS line FROM canonical_terms) GROUP BY entity_type",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "SELECT user_id, sum(fresh)::BIGINT AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events) GROUP BY user_id",
}
