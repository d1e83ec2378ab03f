import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimloom.llm import mixture as M
from claimloom.llm import packing as P


def test_best_fit_takes_the_fullest_bin_that_fits():
    p = P.BestFit(10, 2)
    assert [p.put(s) for s in (6, 7, 3, 4)] == [0, 1, 1, 0]
    p = P.BestFit(10, 2)
    assert [p.put(s) for s in (6, 7, 8, 3)] == [0, 1, 2, 0]  # 8 fits nowhere: the bin with 3 free closes, so 3 goes to the bin with 4
    assert dict(p.unfilled()) == {0: 9, 2: 8}


@pytest.mark.parametrize("per_packer", [40, 10_000])
def test_every_token_is_packed_once_and_no_container_overflows(rows, per_packer):
    random.seed(3)
    items = [(i, random.choice([1, 5, 30, 99, 100, 101, 250, 1000])) for i in range(300)] + [(1000, 0), (1001, None), (None, 5)]
    df = rows("doc_id long, n_tokens long, size string", *((*x, "clash") for x in items))
    specs = rows("spec_id int, capacity_tokens int", (1, 100), (2, 1000), (2, 1000), (3, 0), (None, 5), (4, None))
    packed = P.pack(df, specs, bins=8, per_packer=per_packer).collect()
    fill, pieces = Counter(), defaultdict(list)
    for r in packed:
        fill[r["spec_id"], r["container"]] += r["size"]
        pieces[r["spec_id"], r["doc_id"]].append((r["first"], r["size"]))
    assert {s for s, _ in fill} == {1, 2}
    for (spec, _), n in fill.items():
        assert n <= {1: 100, 2: 1000}[spec]
    for spec, capacity in ((1, 100), (2, 1000)):
        for i, n in items:
            got = sorted(pieces.get((spec, i), []))
            if i is None or not n:
                assert got == []
                continue
            assert sum(s for _, s in got) == n and len(got) == -(-n // capacity)
            assert all(a + s == b for (a, s), (b, _) in zip(got, got[1:]))
    report = {r["spec_id"]: r for r in P.fill_report(P.pack(df, specs, bins=8, per_packer=per_packer)).collect()}
    assert report[2]["tokens"] == sum(n for i, n in items if i is not None and n) and report[2]["unused_share"] < 0.05
    assert P.container_order(P.pack(df, specs, bins=8)).where("slot < 0").count() == 0


def test_packing_nothing(rows):
    df = rows("doc_id long, n_tokens long", (1, 5))
    specs = rows("spec_id int, capacity_tokens int", (1, 100))
    assert P.pack(df.limit(0), specs).count() == 0 and P.pack(df, specs.limit(0)).count() == 0


def test_pivotal_rounding_keeps_the_mass_and_the_means():
    random_ = np.random.default_rng(1)
    sizes, chances = random_.integers(1, 50, 40).astype(float), random_.random(40)
    sums, total = np.zeros(40), (sizes * chances).sum()
    for _ in range(3000):
        out, carry = M.pivotal(sizes, chances, random_.random(40))
        assert (sizes * out).sum() == pytest.approx(total)
        assert all(out[i] in (0, 1) for i in range(40) if i != carry)
        sums += out
    assert np.abs(sums / 3000 - chances).max() < 0.05


DOC = "doc_id long, source string, n_tokens long, copies string"


def documents(n=600):
    random.seed(9)
    out = [(i, random.choice(["big", "Big ", "small_one", "Small One", "third", None]), random.randrange(1, 40), "clash") for i in range(n)]
    return out + [(n, "big", None, ""), (n + 1, "big", 0, ""), (None, "big", 5, ""), (n + 2, "no target", 5, ""), (n + 3, "big", 300, "")]


@pytest.mark.parametrize("per_cell", [10, 100_000])
def test_shares_are_met_within_a_record(rows, per_cell):
    df = rows(DOC, *documents())
    targets = rows("source string, target_share double, max_repeats int", ("big", 0.5, 1), ("small_one", 0.3, 4), ("third", 0.2, 3), ("absent", 0.0, 2), (None, 0.1, 2))
    mixed = M.mix(df, targets, per_cell=per_cell, fan=3)
    got = mixed.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and all(1 <= r["copies"] <= {"big": 1, "small_one": 4, "third": 3}[r["source"]] for r in got)
    tokens = Counter()
    for r in got:
        tokens[r["source"]] += r["copies"] * r["n_tokens"]
    total = sum(tokens.values())
    for source, share, largest in (("big", 0.5, 300), ("small_one", 0.3, 40), ("third", 0.2, 40)):
        assert abs(tokens[source] - share * total) <= 2 * largest
    again = M.mix(df.repartition(3), targets, per_cell=per_cell, fan=3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    report = {r["source"]: r for r in M.share_report(mixed, targets).collect()}
    assert report["absent"]["tokens"] == 0 and report["big"]["share"] == pytest.approx(tokens["big"] / total)


def test_a_source_without_records_and_empty_tables(rows):
    df = rows(DOC, *documents(100))
    targets = rows("source string, target_share double, max_repeats int", ("big", 0.5, 1), ("gone", 0.5, 1))
    assert {r["source"] for r in M.mix(df, targets).collect()} == {"big"}
    assert M.mix(df.limit(0), targets).count() == 0 and M.mix(df, targets.limit(0)).count() == 0
    assert {r["source"]: r["tokens"] for r in M.share_report(M.mix(df.limit(0), targets), targets).collect()} == {"big": 0, "gone": 0}
    total, copies = M.shares_within_reach({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 4)})
    assert total == 80 and copies == {"a": 0.4, "b": 4.0}


def test_a_wanted_total_is_kept_or_the_largest_in_reach(rows):
    df = rows(DOC, *documents())
    targets = rows("source string, target_share double, max_repeats int", ("big", 0.5, 1), ("small_one", 0.3, 4), ("third", 0.2, 3))
    size = lambda **k: sum(r["copies"] * r["n_tokens"] for r in M.mix(df, targets, **k).collect())
    largest = size()
    assert abs(size(total=largest // 3) - largest // 3) <= 300 + 40 + 40 and size(total=10 * largest) == largest
    assert M.shares_within_reach({"a": 100}, {"a": (1.0, 2)}, 30) == (30.0, {"a": 0.3})
