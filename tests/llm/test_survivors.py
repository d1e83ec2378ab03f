import datetime
import random

import pytest
from pyspark.sql import functions as F

from claimloom.llm import survivors as S

AT = datetime.datetime
REC = "record_id long, build_id long, canonical_name string, entity_type string, aliases array<string>, key_properties map<string,string>, paper_ids array<int>, surface_forms array<string>, updated_at timestamp"
TERM = "term_id long, entity_type string, canonical string, aliases array<string>"


@pytest.mark.parametrize("value", [None, "", "  ", "n/a", "N/A", "NaN", "None", "null", "Unknown", "missing", "not reported", "not stated", "not available", "unspecified", "?", "-", "—", "TBD", "k. A.", "to be confirmed", "(unknown)", "nicht bekannt", "...", "no data"])
def test_wordings_for_nothing(rows, value):
    assert not rows("v string", (value,)).select(S.tells_something(F.col("v"))).first()[0]


@pytest.mark.parametrize("value", ["0", "no", "negative", "absent", "nonspecific", "mild", "4q21", "n = 3", "II", "unknown primary"])
def test_values_that_tell_something(rows, value):
    assert rows("v string", (value,)).select(S.tells_something(F.col("v"))).first()[0]


def brute_layers(points):
    left, out, n = dict(points), {}, 1
    key = lambda p: tuple((x is not None, x) for x in p)
    better = lambda p, q: all((a[0], a[1] or 0) >= (b[0], b[1] or 0) for a, b in zip(key(p), key(q))) and key(p) != key(q)
    while left:
        front = {i for i, p in left.items() if not any(better(q, p) for q in left.values())}
        out |= dict.fromkeys(front, n)
        left = {i: p for i, p in left.items() if i not in front}
        n += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_layers_are_those_of_peeling(rows, seed):
    random.seed(seed)
    points = [(i, tuple(random.choice([None, 1, 2, 3]) for _ in range(3))) for i in range(40)]
    df = rows("g int, id int, a int, b int, c int", *((i % 2, i, *p) for i, p in points))
    want = {**brute_layers([x for x in points if x[0] % 2 == 0]), **brute_layers([x for x in points if x[0] % 2])}
    for most in (256, 5) if seed < 2 else (256,):  # in one array, and in blocks
        got = {r["id"]: r["layer"] for r in S.dominance_layers(df, ["g"], ["a", "b", "c"], "id", along="b", most=most, block=2).collect()}
        assert got == want


def test_layers_of_a_large_group_are_those_of_one_array(rows):
    random.seed(9)
    points = [(0, i, random.randrange(400), random.randrange(4), random.randrange(3)) for i in range(700)] + [(None, 1000 + i, i, 1, 1) for i in range(3)]
    df = rows("g int, id int, a int, b int, c int", *points)
    layers = lambda **k: sorted(tuple(r) for r in S.dominance_layers(df, ["g"], ["b", "a", "c"], "id", along="a", **k).select("id", "layer").collect())
    assert layers(most=600, block=60) == layers(most=10_000)


@pytest.fixture
def registry(rows):
    return rows(
        REC,
        (1, 0, "Nodular Goitre", "D", None, {"a": "x", "b": "n/a", "c": None}, [3, 1, None, 3], None, AT(2024, 1, 1)), (2, 0, "nodular goitres", None, None, {"b": "y", "c": "z"}, [2], None, AT(2023, 1, 1)), (3, 0, "study drug", "D", ["NG"], {"d": "w"}, None, None, AT(2025, 1, 1)),
        (4, 0, "Out Of List", "D", None, None, [9], None, None), (5, 0, "Out Of Lits", "D", None, {}, [9], None, AT(2024, 1, 1)), (6, 1, "out of list", "", None, {}, [], None, AT(2024, 1, 1)), (7, 0, None, None, None, None, None, None, None), (8, 0, "marker b", None, [], None, None, [], None),
    )


def test_pairs_survivors_and_best_values(rows, registry):
    terms = rows(TERM, (1, "D", "Nodular Goitre", ["NG"]))
    keys = S.entity_keys(registry, terms)
    best = S.best_records(registry, keys)
    assert {tuple(r) for r in S.duplicate_pairs(registry, keys, best).collect()} == {(1, 2, 2), (1, 3, 2), (2, 3, 2), (4, 5, 5)}
    got = {(r["build_id"], r["entity_key"]): r for r in best.collect()}
    one = got[0, "term:1"]
    assert (one["survivor_id"], one["n_records"], one["canonical_name"], one["entity_type"]) == (2, 3, "Nodular Goitre", "D")
    assert one["key_properties"] == {"a": "x", "b": "y", "c": "z", "d": "w"} and one["paper_ids"] == [1, 2, 3]
    assert set(got) == {(0, "term:1"), (0, "name:out of list"), (1, "name:out of list")}
    assert got[1, "name:out of list"]["entity_type"] is None and got[1, "name:out of list"]["key_properties"] == {}


def test_each_of_a_hot_group_has_its_layer(rows):
    many = [(i, 0, "Nodular Goitre", "D", None, {"a": str(i)}, [i], None, AT(2024, 1, 1) + datetime.timedelta(hours=i)) for i in range(300)]
    df = rows(REC, *many)
    keys = S.entity_keys(df, rows(TERM, (1, "D", "Nodular Goitre", None)))
    best = S.best_records(df, keys).collect()
    assert len(best) == 1 and best[0]["survivor_id"] == 299 and best[0]["layers"] == 300 and best[0]["key_properties"] == {"a": "299"} and len(best[0]["paper_ids"]) == 300


def test_records_without_a_value_of_their_own_still_place_others_in_layers(rows):
    at = lambda h: AT(2024, 1, 1) + datetime.timedelta(hours=h)
    own = [(1, "D", {"a": "1", "b": "1", "c": "1"}, at(10)), (2, "D", {"a": "2", "b": "2", "c": "2"}, at(9)), (3, None, {"d": "3", "e": "3"}, at(8)), (4, "D", {"d": "4"}, at(9.5))]
    df = rows(REC, *((i, 0, "Nodular Goitre", kind, None, p, None, None, t) for i, kind, p, t in own))
    best = S.best_records(df, S.entity_keys(df, rows(TERM, (1, "D", "Nodular Goitre", None)))).collect()
    assert len(best) == 1 and best[0]["survivor_id"] == 1 and best[0]["layers"] == 3
    assert best[0]["key_properties"] == {"a": "1", "b": "1", "c": "1", "d": "4", "e": "3"}


@pytest.mark.parametrize("most", [256, 4])
def test_best_records_are_those_of_peeling(rows, monkeypatch, most):
    monkeypatch.setattr(S.dominance_layers, "__defaults__", (None, most, 3))
    random.seed(most)
    own = [(i, random.choice(["D", None, ""]), {k: f"{k}{i}" for k in random.sample("abcde", random.randrange(5))}, random.choice([None, *(AT(2024, 1, h) for h in range(1, 9))])) for i in range(40)]
    df = rows(REC, *((i, i % 2, "Nodular Goitre", kind, None, p, None, None, t) for i, kind, p, t in own))
    best = S.best_records(df, S.entity_keys(df, rows(TERM, (1, "D", "Nodular Goitre", None))))
    for r in best.collect():
        mine = [x for x in own if x[0] % 2 == r["build_id"]]
        layer = brute_layers([(i, (len(p), t and t.day, 3 if kind else 2)) for i, kind, p, t in mine])
        order = sorted(mine, key=lambda x: (layer[x[0]], -len(x[2]), -(x[3].day if x[3] else 0), -(3 if x[1] else 2), x[0]))
        assert (r["survivor_id"], r["layers"], r["n_records"]) == (order[0][0], max(layer.values()), 20)
        assert r["key_properties"] == {k: next(x[2][k] for x in order if k in x[2]) for k in "abcde" if any(k in x[2] for x in mine)}


def test_columns_of_clashing_names_do_not_matter(rows, registry):
    terms = rows(TERM, (1, "D", "Nodular Goitre", ["NG"]))
    clash = registry
    for c in ("entity_key", "exact", "layer", "completeness", "recency", "trust", "_filled", "_0", "survivor_id", "term_id", "form_key", "_named"):
        clash = clash.withColumn(c, F.lit("clash"))
    plain = lambda df: sorted(map(str, df.collect()))
    keys = S.entity_keys(clash, terms)
    assert plain(S.best_records(clash, keys)) == plain(S.best_records(registry, S.entity_keys(registry, terms)))


def test_empty(rows, registry):
    keys = S.entity_keys(registry.limit(0), rows(TERM, (1, "D", "Nodular Goitre", None)))
    assert S.best_records(registry.limit(0), keys).count() == 0
