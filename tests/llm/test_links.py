import datetime

from claimloom.llm import survivors as S

REC = "record_id long, build_id long, canonical_name string, entity_type string, aliases array<string>, key_properties map<string,string>, paper_ids array<int>, surface_forms array<string>, updated_at timestamp"
TERM = "term_id long, entity_type string, canonical string, aliases array<string>"


def groups(rows, *named):
    records = rows(REC, *((i, b, name, None, None, None, None, None, datetime.datetime(2024, 1, 1)) for i, b, name in named))
    out = {}
    for r in S.entity_keys(records, rows(TERM, (1, "D", "Nodular Goitre", None))).collect():
        out.setdefault(r["entity_key"], set()).add(r["record_id"])
    return out


def test_both_partners_of_a_name_are_of_its_group(rows):
    got = groups(rows, (1, 0, "wosefxto lymphoma"), (2, 0, "wosfexto lymphoma"), (3, 0, "wosfexto lymph"), (4, 0, "borvgamo blockade"))
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [4]]


def test_a_long_chain_is_one_group(rows):
    got = groups(rows, *((i, 0, "b" * 2 * i + "a" * (24 - 2 * i)) for i in range(13)))
    assert list(got.values()) == [set(range(13))]


def test_the_most_frequent_spelling_is_the_key_and_links_of_another_build_join_no_groups(rows):
    chain = ["a" * 24, "bb" + "a" * 22, "bbbb" + "a" * 20]
    got = groups(rows, (1, 0, chain[0]), (2, 0, chain[2]), (3, 1, chain[0]), (4, 1, chain[2]), (5, 1, chain[1]), (6, 1, chain[0]), (7, None, chain[0]))
    assert got == {"name:" + chain[0]: {1, 3, 4, 5, 6, 7}, "name:" + chain[2]: {2}}
    links = rows("g int, a int, b int", (1, 5, 3), (1, 3, 4), (1, 8, 9), (2, 5, 9), (2, 1, 2))
    assert {tuple(r) for r in S.connected(links, "g").collect()} == {(1, 3, 3), (1, 4, 3), (1, 5, 3), (1, 8, 8), (1, 9, 8), (2, 5, 5), (2, 9, 5), (2, 1, 1), (2, 2, 1)}
