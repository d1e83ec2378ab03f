import os

import numpy as np
import pytest

from claimloom.llm import neighbours as N


def brute(data, k):
    good = [(i, np.array(v, dtype=float)) for i, v in data if i is not None and v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    s = np.round(x @ x.T, 9)
    return {i: [ids[j] for j in sorted((j for j in range(len(ids)) if j != n), key=lambda j: (-s[n, j], ids[j]))[:k]] for n, i in enumerate(ids)}


DIM = 8


def table(rows, data):
    return rows(f"id long, v array<float>, rep string", *((i, v, "clash") for i, v in data))


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


def test_few_vectors_are_searched_exactly_and_unusable_ones_left_out(rows):
    random = np.random.default_rng(1)
    data = [(i, random.normal(size=DIM).astype("float32").tolist()) for i in range(60)]
    data += [(100, None), (101, [1.0]), (102, [0.0] * DIM), (103, [float("nan")] + [1.0] * (DIM - 1)), (104, [None] + [1.0] * (DIM - 1)), (105, [float("inf")] * DIM), (None, data[0][1]), (106, [x * 2.0**-60 for x in data[1][1]])]
    assert results(N.nearest(table(rows, data), "id", "v", DIM, 5)) == brute(data, 5)


def test_equal_vectors_are_neighbours_and_ties_go_to_the_lower_id(rows):
    random = np.random.default_rng(2)
    same, other = random.normal(size=DIM).astype("float32").tolist(), random.normal(size=DIM).astype("float32").tolist()
    data = [(i, same) for i in range(20)] + [(i, other) for i in range(20, 23)] + [(30, random.normal(size=DIM).astype("float32").tolist())]
    assert results(N.nearest(table(rows, data), "id", "v", DIM, 4)) == brute(data, 4)
    pairs = N.similar_pairs(N.nearest(table(rows, data[20:]), "id", "v", DIM, 4), "id", 0.999)
    assert {tuple(r) for r in pairs.collect()} == {(20, 21), (20, 22), (21, 22)}


def test_one_and_no_vector(rows):
    assert N.nearest(table(rows, [(1, [1.0] * DIM)]), "id", "v", DIM).count() == 0
    assert N.nearest(table(rows, [(1, None)]), "id", "v", DIM).count() == 0


def clustered(n, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(40, DIM))
    return (centres[random.integers(0, 40, n)] + 0.3 * random.normal(size=(n, DIM))).astype("float32")


def test_learned_parts_reach_the_recall(rows):
    x = clustered(3000, 3)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got = results(N.nearest(table(rows, data), "id", "v", DIM, 10, part_rows=300, fit_rows=1500, recall=0.95))
    want = brute(data, 10)
    assert set(got) == set(want)
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.9


def test_parts_that_outgrow_a_task_are_searched_in_blocks(rows, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 50)
    monkeypatch.setattr(N, "QUERY_ROWS", 70)
    data = [(i, v.tolist()) for i, v in enumerate(clustered(400, 4))]
    assert results(N.nearest(table(rows, data), "id", "v", DIM, 6)) == brute(data, 6)


@pytest.mark.parametrize(("part_rows", "fan", "depth"), [(300, 16, 1), (100, 6, 2), (100, 4, 3)])
def test_parts_grow_with_the_vectors_and_every_vector_is_indexed(rows, part_rows, fan, depth):
    assert N._tree(-(-3000 // part_rows), fan)[0] == depth
    x = clustered(3000, 7)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[0].tolist()) for i in range(5)]
    got = results(N.nearest(table(rows, data), "id", "v", DIM, 10, part_rows=part_rows, fit_rows=1500, recall=0.97, fan=fan, siblings=2))
    want = brute(data, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.9
    pairs = lambda near: {(i, j) for i, v in near.items() for j in v[:1]}
    assert len(pairs(got) & pairs(want)) >= 0.97 * len(pairs(want))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_pairs_of_the_query_are_those_of_its_sql_with_many_parts(spark, monkeypatch):
    import duckdb

    from claimloom.llm import queries as Q

    d = "/root/testdata/sf0.01"
    monkeypatch.setattr(N.nearest, "__defaults__", (10, 64, 1000, N.RECALL, 6, 2))
    assert N._tree(-(-1019 // 64), 6) == (2, 4)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW claims AS SELECT * FROM '{d}/claims.parquet'")
    want = set(con.sql(Q.SQL["p5_found"]).fetchall())
    assert want and {tuple(r) for r in Q.p5_found(spark, d).select("claim_id_a", "claim_id_b").collect()} == want


def test_parts_are_balanced():
    x = N._unit(clustered(2000, 5))
    label = N.balanced_parts(x, N.neighbour_graph(x, 10), 10)
    assert np.bincount(label).max() <= 2000 / 10 * 1.05 + 1 and len(np.unique(label)) == 10
    router = N.learn_router(x, 10)
    assert 1 <= router.probes <= 10 and router.recall >= 0.9
    assert N.learn_router(x[:10], 1).probes == 1


@pytest.mark.parametrize("k", [1, 3])
def test_the_graph_of_a_sample(k):
    x = N._unit(clustered(50, 6))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    graph = N.neighbour_graph(x, k)
    assert all(set(graph[i]) == set(np.argsort(-s[i])[:k]) for i in range(50))


def test_vectors_are_not_copied_to_disk_for_their_probes(spark):
    from pathlib import Path

    dim, n = 64, 3000
    x = np.random.default_rng(11).normal(size=(n, dim)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").cache()
    df.count()
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def used():
        files = blocks.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size())) + sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    before = used()
    graph = N.nearest(df, "id", "v", dim, 10, part_rows=100, fit_rows=1500, recall=0.97, fan=6, siblings=2)
    assert used() - before < 4 * x.nbytes
    assert not list(folder.glob("vectors-*")) and graph.count() == 10 * n


@pytest.mark.parametrize(("part_rows", "depth"), [(4000, 1), (100, 2)])
def test_all_similar_pairs_are_found_however_many_a_vector_has(rows, part_rows, depth):
    random = np.random.default_rng(12)
    x = random.normal(size=(1500, DIM))
    x = np.vstack([x, x[:300] + 0.05 * random.normal(size=(300, DIM)), x[0] + 0.01 * random.normal(size=(20, DIM)), np.repeat(x[1:2], 20, axis=0)]).astype("float32")
    unit = N._unit(x)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(np.round(unit @ unit.T, 12) >= 0.98, 1)))}
    graph = N.nearest(table(rows, [(i, v.tolist()) for i, v in enumerate(x)]), "id", "v", DIM, 10, part_rows=part_rows, fit_rows=1500, fan=6, siblings=2, least=0.98)
    got = {tuple(r) for r in N.similar_pairs(graph, "id", 0.98).collect()}
    assert N._tree(-(-len(x) // part_rows), 6)[0] == depth and got <= want
    assert got == want if part_rows == 4000 else len(got) >= 0.999 * len(want)
