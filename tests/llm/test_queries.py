"""What the queries without SQL must hold, on the smallest tables."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimloom.llm import queries as Q
from claimloom.sources.tables import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_every_record_is_matched_or_reported(spark):
    status = Counter()
    for r in Q.p1_unmatched(spark, DATA).collect():
        status[r["status"]] += r["records"]
    records = Q._registry(spark, DATA).count()
    assert sum(status.values()) + Q.p1_found(spark, DATA).count() == records and set(status) <= {"unmatched", "unnamed", "ambiguous"}


def test_pairs_are_those_of_the_survivors_groups(spark):
    best = {r["survivor_id"]: r["n_records"] for r in Q.p2_survivors(spark, DATA).collect()}
    pairs = Counter(r["survivor_id"] for r in Q.p2_found(spark, DATA).collect())
    assert pairs == {s: n * (n - 1) // 2 for s, n in best.items() if n > 1}
    assert sum(best.values()) <= Q._registry(spark, DATA).count()


def test_pieces_cover_their_texts(spark):
    chunks = table(spark, DATA, "vector_chunks").select("point_id", "text", "loaded_at").collect()
    current = {}
    for r in sorted(chunks, key=lambda r: r["loaded_at"]):
        current[r["point_id"]] = r["text"]
    pieces, sections = defaultdict(list), defaultdict(list)
    for r in Q.p4_pieces(spark, DATA).collect():
        pieces[r["point_id"]].append(r)
        sections[r["point_id"] // 1000].append(r)
    assert set(pieces) == set(current)
    for point, text in current.items():
        words = (text or "").split()
        mine = sorted(pieces[point], key=lambda r: r["piece"])
        assert mine[0]["first_word"] == 0 and mine[-1]["first_word"] + mine[-1]["words"] == len(words)
        for r in mine:
            assert r["words"] <= 400 and (r["text"] or "").split() == words[r["first_word"] : r["first_word"] + r["words"]]
        for a, b in zip(mine, mine[1:]):
            assert a["first_word"] + a["words"] - b["first_word"] == 80
    for rows in sections.values():
        rows.sort(key=lambda r: (r["point_id"], r["piece"]))
        assert [r["window_index"] for r in rows] == list(range(len(rows))) and {r["window_count"] for r in rows} == {len(rows)}


def test_containers_hold_every_token_once(spark):
    sizes = {r["doc_id"]: r["n_tokens"] for r in Q._sized(spark, DATA).collect()}
    specs = {r["spec_id"]: r["capacity_tokens"] for r in table(spark, DATA, "pack_specs").collect()}
    load, whole, pieces = Counter(), Counter(), Counter()
    for r in Q.p6_pack(spark, DATA).collect():
        load[r["spec_id"], r["container"]] += r["size"]
        whole[r["spec_id"], r["doc_id"]] += r["size"]
        pieces[r["spec_id"], r["doc_id"]] += 1
    assert all(n <= specs[s] for (s, _), n in load.items())
    for s, capacity in specs.items():
        for doc, n in sizes.items():
            if n:
                assert whole[s, doc] == n and (pieces[s, doc] == 1 or n > capacity)
    for s, capacity in specs.items():
        used = sum(1 for k in load if k[0] == s)
        assert used <= 1.5 * -(-sum(sizes.values()) // capacity) + 3


def test_the_mixture_keeps_repeats_and_shares(spark):
    targets = {r["source"]: r for r in table(spark, DATA, "mix_targets").collect()}
    mixed = Q.p7_mix(spark, DATA).collect()
    assert mixed and len({r["doc_id"] for r in mixed}) == len(mixed)
    assert all(1 <= r["copies"] <= targets[r["source"]]["max_repeats"] for r in mixed)
    tokens = Counter()
    for r in mixed:
        tokens[r["source"]] += r["copies"] * r["n_tokens"]
    live = sum(targets[s]["target_share"] for s in tokens)
    most = max(r["n_tokens"] or 0 for r in Q._sized(spark, DATA).collect())  # the record that is rounded last may be left out
    for s, n in tokens.items():
        assert abs(n - sum(tokens.values()) * targets[s]["target_share"] / live) <= 2 * most
    shares = {r["source"]: r["share"] for r in Q.p7_shares(spark, DATA).collect()}
    assert sum(shares.values()) == pytest.approx(1)


def test_found_and_clean_documents_are_all_documents(spark):
    found = {r["doc_id"] for r in Q.p8_found(spark, DATA).collect()}
    clean = {r["doc_id"] for r in Q.p8_clean(spark, DATA).collect()}
    assert found and not found & clean and found | clean == {r["doc_id"] for r in table(spark, DATA, "documents").select(F.col("doc_id")).collect()}
