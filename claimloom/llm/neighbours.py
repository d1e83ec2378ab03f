"""The k most similar vectors of every vector, by learned partitions of a neighbour graph."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.lineage import cut, released
from claimloom.llm.shelf import Kept, Shelf

#: Vectors per part, most vectors that one router is learned from, aimed-at recall of routing, most index rows and queries of a task.
PART_ROWS, FIT_ROWS, RECALL, BLOCK_ROWS, QUERY_ROWS = 2_048, 20_000, 0.96, 32_768, 131_072
#: Most parts that one router tells apart (more parts are reached through a tree of routers), and neighbouring parts that share a task.
FAN, SIBLINGS = 256, 8


def usable(vector: str, dimensions: int) -> Column:
    """Whether a vector has ``dimensions`` finite numbers, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large and small numbers stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _top(queries: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and single-precision products of the k best rows for each query, in blocks, unordered; -inf where fewer reach ``least``, if that is given.

    The k-th best of every fourth product is a floor that the k-th best of all cannot lie under; only the products above it are compared further.
    """
    n = len(rows)
    k = min(k, n)
    where, value = np.empty((len(queries), k), dtype=np.int64), np.empty((len(queries), k), dtype=np.float32)
    flat = np.ascontiguousarray(rows.T, dtype=np.float32)
    step, stride = max(1, 2_000_000 // max(1, n)), 4 if n >= 32 * k else 1
    for i in range(0, len(queries), step) if k else ():
        products = queries[i : i + step].astype(np.float32) @ flat
        if least is not None and np.isfinite(least[i : i + step]).all():
            floor = least[i : i + step]
        else:
            some = np.ascontiguousarray(products[:, ::stride])
            floor = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k]
        flat_at = np.flatnonzero((products >= floor[:, None]).ravel())
        at = flat_at // n
        counts = np.bincount(at, minlength=len(products))
        slot = np.arange(len(at)) - (counts.cumsum() - counts)[at]
        most = max(k, counts.max())
        kept, column = np.full((len(products), most), -np.inf, dtype=np.float32), np.zeros((len(products), most), dtype=np.int64)
        kept[at, slot], column[at, slot] = products.ravel()[flat_at], flat_at - at * n
        best = np.argpartition(kept, kept.shape[1] - k, axis=1)[:, kept.shape[1] - k :]
        where[i : i + step], value[i : i + step] = np.take_along_axis(column, best, axis=1), np.take_along_axis(kept, best, axis=1)
    return where, value


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Exact k nearest others of each row of a sample of unit vectors."""
    where, value = _top(x, x, min(k + 1, len(x)))
    value = np.where(where == np.arange(len(x))[:, None], -np.inf, value)
    order = np.argsort(-value, axis=1)[:, : min(k, len(x) - 1)]
    return np.take_along_axis(where, order, axis=1)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.05, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """A part for each node of the graph, of about equal sizes: bisection along principal directions, then moves that cut fewer edges.

    A node moves to the part that most of its neighbours (either way) lie in, as long as that part stays within ``slack`` of the mean size.
    """
    label = np.zeros(len(x), dtype=np.int64)
    work = [(np.arange(len(x)), 0, parts)]
    while work:
        nodes, first, count = work.pop()
        if count == 1:
            label[nodes] = first
            continue
        centred = x[nodes] - x[nodes].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        half = count // 2
        order = nodes[np.argsort(centred @ direction, kind="stable")]
        at = len(nodes) * half // count
        work += [(order[:at], first, half), (order[at:], first + half, count - half)]
    n, most = len(x), int(np.ceil(len(x) / parts * slack))
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    sizes, random = np.bincount(label, minlength=parts), np.random.default_rng(seed)
    for _ in range(rounds):
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (source, label[target]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moved = 0
        for i in random.permutation(np.flatnonzero(gain > 0)):
            if sizes[best[i]] < most and sizes[label[i]] > 1:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < n * 0.002:
            break
    return label


@dataclass
class Router:
    """A small network from a unit vector to scores of the parts, and how many parts a query probes."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    recall: float
    load: np.ndarray  # share of the vectors that lie in each part
    asked: np.ndarray  # share of the vectors that ask in each part

    @property
    def parts(self) -> int:
        """The number of parts."""
        return len(self.b2)

    def ranked(self, x: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` most probable parts of each row, best first."""
        scores = np.maximum(x.astype(np.float32) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        best = np.argpartition(-scores, min(most, self.parts) - 1, axis=1)[:, :most]
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, axis=1), axis=1, kind="stable"), axis=1)

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the parts' probabilities for each row."""
        scores = np.maximum(x.astype(np.float32) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def learn_router(x: np.ndarray, parts: int, k: int = 10, recall: float = RECALL, hidden: int = 128, epochs: int = 30, seed: int = 5) -> Router:
    """Partition the neighbour graph of a sample, learn to route to its parts, and choose the probes on held-out queries.

    Targets are soft: the parts of a vector and of its neighbours. A tenth of the sample is held out of the learning; the probes are the fewest with which
    ``recall`` of the held-out vectors' neighbours lie in a probed part, every vector lying where the router puts it first.
    """
    dim = x.shape[1]
    if parts <= 1 or len(x) < 4 * parts:
        return Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 1, 1.0, np.ones(1), np.ones(1))
    random = np.random.default_rng(seed)
    order = random.permutation(len(x))
    held, fit = order[: len(x) // 10], np.sort(order[len(x) // 10 :])
    graph = neighbour_graph(x[fit], k)
    label = balanced_parts(x[fit], graph, parts, seed=seed)
    goal = np.zeros((len(fit), parts), dtype=np.float32)
    rows = np.arange(len(fit))
    goal[rows, label] = 1
    np.add.at(goal, (np.repeat(rows, graph.shape[1]), label[graph.ravel()]), 1 / graph.shape[1])
    goal /= goal.sum(axis=1, keepdims=True)
    weights = [(random.standard_normal((dim, hidden)) / np.sqrt(dim)).astype(np.float32) * 4, np.zeros(hidden, np.float32), (random.standard_normal((hidden, parts)) / np.sqrt(hidden)).astype(np.float32), np.zeros(parts, np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    inputs, step = x[fit].astype(np.float32), 0
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs) + 0.0003
        for batch in np.array_split(random.permutation(len(fit)), max(1, len(fit) // 256)):
            a, y = inputs[batch], goal[batch]
            z = a @ weights[0] + weights[1]
            h = np.maximum(z, 0)
            scores = h @ weights[2] + weights[3]
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            off = (scores / scores.sum(axis=1, keepdims=True) - y) / len(batch)
            back = (off @ weights[2].T) * (z > 0)
            step += 1
            for i, g in enumerate((a.T @ back, back.sum(axis=0), h.T @ off, off.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    router = Router(*weights, probes=parts, recall=1.0, load=np.empty(0), asked=np.empty(0))
    near, _ = _top(x[held], x[fit], k)
    home = router.ranked(x[fit], 1)[:, 0]
    ranks = router.ranked(x[held], parts)
    place = np.empty_like(ranks)
    np.put_along_axis(place, ranks, np.arange(parts)[None, :].repeat(len(held), 0), axis=1)
    reached = np.take_along_axis(place, home[near], axis=1)
    share = np.bincount(reached.ravel(), minlength=parts).cumsum() / reached.size
    router.probes = int(np.searchsorted(share, min(recall, share[-1])) + 1)
    router.recall = float(share[min(router.probes, parts) - 1])
    all_ranked = router.ranked(x, router.probes)
    router.load, router.asked = np.bincount(all_ranked[:, 0], minlength=parts) / len(x), np.bincount(all_ranked.ravel(), minlength=parts) / len(x)
    return router


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def _identical(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key``, ``rep`` of the vectors that others equal exactly: rep is the least key among the equals. Only hashes are shuffled."""
    h = vectors.select(key, F.xxhash64(vector).alias("_h"), F.xxhash64(F.lit(1), vector).alias("_g"))
    classes = h.groupBy("_h", "_g").agg(F.min(key).alias("rep"), F.count("*").alias("_n")).where("_n > 1")
    return h.join(classes, ["_h", "_g"]).select(key, "rep")


def _tree(leaves: int, fan: int) -> tuple[int, int]:
    """Depth of the tree of routers, and parts of each router."""
    depth, reach = 1, fan
    while reach < leaves:
        depth, reach = depth + 1, reach * fan
    return depth, max(1, int(np.ceil(leaves ** (1 / depth) - 1e-9)))


def nearest(vectors: DataFrame, key: str, vector: str, dimensions: int, k: int = 10, part_rows: int = PART_ROWS, fit_rows: int = FIT_ROWS, recall: float = RECALL, fan: int = FAN, siblings: int = SIBLINGS, *, least: float | None = None) -> DataFrame:
    """``key``, ``neighbour``, ``cosine``, ``rank`` (1..k): the k most similar others of every usable vector.

    ``key`` must be a unique integer. Unusable vectors (null, wrong length, null, infinite or not-a-number entries, all zero) neither ask nor answer. Ties go to the lower key.
    There is one part for ``part_rows`` vectors, however many there are: a router tells up to ``fan`` parts apart, and beyond that each part has a router of its own, and so on.
    A router is learned from at most ``fit_rows`` vectors of its part; every vector is indexed in its most
    probable part and asks its most probable parts, as many as the aimed-at ``recall`` needs; candidates are reranked in double precision.
    A vector is written once, with its part, to files in the checkpoint folder, ``siblings`` neighbouring parts to a file. The vectors of a piece of a file ask together, in one task,
    which reads the parts that they probe from the files; so no vector is copied for its probes, and the files are gone when this returns.
    Vectors that are exactly equal are searched once, by their least key, and the results given to all. Parts that
    outgrow a task are read in blocks, so nothing is capped. With few vectors all lie in one part and the search is exact.

    With ``least``, all others with a cosine of at least that, however many, in place of the k most similar. A vector then asks the most probable parts of the whole tree, as many as ``_enough`` says;
    a pair may be found from one side only (see ``similar_pairs``).
    """
    rows = cut(released(vectors.where(F.col(key).isNotNull() & usable(vector, dimensions)).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))))
    same = cut(released(_identical(rows, "id", "v")))
    few = _hinted(same.count())
    copies = same.where("id <> rep")
    single = rows.join(few(copies.select("id")), "id", "left_anti")
    count = rows.count() - copies.count()
    depth, parts = _tree(max(1, -(-count // part_rows)), fan)
    sample = np.empty((0, dimensions))
    if parts > 1:
        chosen = single.where(_sampled(min(1.0, 1.1 * fit_rows / count), 3)).orderBy("id").limit(fit_rows)
        sample = _unit(_matrix(chosen.select("v").toArrow()["v"], dimensions))
    router = learn_router(sample, parts, k, recall ** (1 / depth))
    shelf = Shelf.beside(rows)
    try:
        index = _Index(shelf, dimensions, depth, parts, [pa.table({"node": pa.array([0], pa.int64()), "file": [shelf.put(pickle.dumps(vars(router)))]})])
        segments = _shelved(single, index, router, count, siblings if depth == 1 else 1)
        for _ in range(2, depth + 1):
            segments = _divided(rows.sparkSession, index, segments, k, fit_rows, recall ** (1 / depth))
        most = None if least is None else _enough(sample, index.reader(), depth, parts, least)
        found = cut(_searched(rows.sparkSession, index, segments, k, max(1, min(QUERY_ROWS, siblings * part_rows)), rows.schema["id"].dataType.simpleString(), least, most))
    finally:
        shelf.remove()
    return _spread(found, same, k if least is None else None, key, few)


def _hinted(rows: int) -> Callable[[DataFrame], DataFrame]:
    """A hint to broadcast what comes of so many rows of keys, if that is little; other joins are left to adaptive execution, which shuffles both sides before it knows."""
    return F.broadcast if rows <= BLOCK_ROWS else lambda df: df


def _sampled(share: float, salt: int) -> Column:
    """A share of the rows, by a hash of their id."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30))


#: A run of vectors of one node in a file of ``rows`` vectors.
SEGMENT = "node bigint, file string, rows bigint, start bigint, held bigint"


@dataclass
class _Index:
    """The shelf of the vectors, and the files of the routers of each level by node."""

    shelf: Shelf
    dim: int
    depth: int
    parts: int
    routers: list[pa.Table]

    def reader(self) -> Callable[[int, int], Router]:
        """The router of a level and node, for one task. A node without vectors of its own has a single part."""
        kept, single = Kept(self.shelf), learn_router(np.empty((0, self.dim)), 1)
        names = [dict(zip(t.column("node").to_pylist(), t.column("file").to_pylist())) for t in self.routers]
        return lambda level, node: Router(**kept[names[level][node]]) if node in names[level] else single

    def kept(self) -> _Index:
        """The same with its lists of routers on the shelf, to be sent to tasks."""
        return _Sent(self.shelf, self.dim, self.depth, self.parts, [self.shelf.put_table(t) for t in self.routers])


class _Sent(_Index):
    """An index whose lists of routers are files."""

    def reader(self) -> Callable[[int, int], Router]:
        return _Index(self.shelf, self.dim, self.depth, self.parts, [self.shelf.table(t) for t in self.routers]).reader()


def _runs(node: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Node, first and last row but one of each run of equal nodes."""
    edges = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.empty(0, dtype=np.int64)
    return zip(node[edges].tolist(), edges.tolist(), np.append(edges[1:], len(node)).tolist())


def _filed(shelf: Shelf, ids: np.ndarray, x: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Vectors in the order of their nodes put in a file; its segments."""
    name, runs = shelf.put_vectors(ids, x), list(_runs(node))
    n = len(runs)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in runs], pa.int64()), pa.array([name] * n), pa.array([len(ids)] * n, pa.int64()), pa.array([a for _, a, _ in runs], pa.int64()), pa.array([b - a for _, a, b in runs], pa.int64())],
        names=["node", "file", "rows", "start", "held"],
    )


def _shelved(single: DataFrame, index: _Index, router: Router, count: int, siblings: int) -> pa.Table:
    """Every vector written to the shelf, in files of ``siblings`` neighbouring nodes of the first router; the segments. Files of many vectors are split by a hash of the key."""
    shelf, dim = index.shelf, index.dim
    salts = np.maximum(1, np.ceil(np.add.reduceat(router.load, np.arange(0, router.parts, siblings)) * count / BLOCK_ROWS)).astype(np.uint64)
    most = BLOCK_ROWS

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").cast(pa.int64())
                node = router.ranked(_unit(_matrix(batch.column("v"), dim)), 1)[:, 0].astype(np.int64)
                cell = node // siblings
                salt = (ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % salts[cell]
                yield pa.RecordBatch.from_arrays([ids, batch.column("v"), pa.array(node), pa.array(cell << 32 | salt.astype(np.int64))], names=["id", "v", "node", "cell"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, of = [], 0, -1
        file = lambda: _filed(shelf, *(np.concatenate(c) for c in zip(*waiting)))
        for batch in batches:
            ids, node, x = batch.column("id").to_numpy(), batch.column("node").to_numpy(), _matrix(batch.column("v"), dim)
            for cell, a, b in _runs(batch.column("cell").to_numpy()):
                for i in range(a, b, most):
                    j = min(b, i + most)
                    if waiting and (cell != of or held + j - i > most):
                        yield file()
                        waiting, held = [], 0
                    waiting.append((ids[i:j], x[i:j], node[i:j]))
                    held, of = held + j - i, cell
        if waiting:
            yield file()

    ordered = single.mapInArrow(routed, "id bigint, v array<float>, node bigint, cell bigint").repartition("cell").sortWithinPartitions("cell", "node", "id")
    return released(ordered.mapInArrow(written, SEGMENT)).toArrow().sort_by([("node", "ascending"), ("file", "ascending"), ("start", "ascending")])


def _units(spark: SparkSession, count: int) -> DataFrame:
    """The numbers of ``count`` pieces of work, each in a task of its own."""
    return spark.range(0, count, 1, max(1, count))


def _of(segments: pa.Table) -> dict[str, np.ndarray]:
    return {c: segments.column(c).to_numpy(zero_copy_only=False) for c in segments.column_names}


def _divided(spark: SparkSession, index: _Index, segments: pa.Table, k: int, fit_rows: int, recall: float) -> pa.Table:
    """The next level of the tree: a router learned for each node, and the vectors of each file put in the order of the parts that it leads to; the new segments."""
    shelf, dim, parts, level = index.shelf, index.dim, index.parts, len(index.routers)
    listed = shelf.put_table(segments)

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _of(shelf.table(listed))
        nodes = np.unique(s["node"])
        for node in (nodes[i] for batch in batches for i in batch.column(0).to_pylist()):
            own = [(s["file"][i], int(s["rows"][i]), int(s["start"][i]), int(s["held"][i])) for i in np.flatnonzero(s["node"] == node)]
            ids = np.concatenate([shelf.vectors(*o, dim)[0] for o in own])
            chosen = np.zeros(len(ids), dtype=bool)
            chosen[np.argsort(ids)[np.random.default_rng(7).permutation(len(ids))[:fit_rows]]] = True
            first = np.cumsum([0, *(o[3] for o in own)])
            x = np.concatenate([shelf.vectors(*o, dim)[1][chosen[a : a + o[3]]] for o, a in zip(own, first)])[np.argsort(ids[chosen])]
            router = learn_router(_unit(x), parts, k, recall)
            yield pa.RecordBatch.from_arrays([pa.array([int(node)], pa.int64()), pa.array([shelf.put(pickle.dumps(vars(router)))])], names=["node", "file"])

    index.routers.append(_units(spark, len(np.unique(segments.column("node").to_numpy()))).mapInArrow(learnt, "node bigint, file string").toArrow())
    sent, files = index.kept(), sorted(set(segments.column("file").to_pylist()))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, router = _of(shelf.table(listed)), sent.reader()
        names = np.unique(s["file"].astype(str))
        for name in (names[i] for batch in batches for i in batch.column(0).to_pylist()):
            at = [i for i in np.flatnonzero(s["file"] == name)]
            ids, x = shelf.vectors(str(name), int(s["rows"][at[0]]), 0, int(s["rows"][at[0]]), dim)
            node = np.empty(len(ids), dtype=np.int64)
            for i in at:
                a, b, of = int(s["start"][i]), int(s["start"][i] + s["held"][i]), int(s["node"][i])
                node[a:b] = of * parts + router(level, of).ranked(_unit(x[a:b]), 1)[:, 0]
            order = np.lexsort((ids, node))
            yield _filed(shelf, ids[order], x[order], node[order])

    out = _units(spark, len(files)).mapInArrow(moved, SEGMENT).toArrow().sort_by([("node", "ascending"), ("file", "ascending"), ("start", "ascending")])
    shelf.drop(files)
    return out


def _probed(x: np.ndarray, router: Callable[[int, int], Router], depth: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vector probes which part, ordered by part: on each level a vector goes on to the most probable parts of every node that it has come to."""
    asker, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for level in range(depth):
        asked, reached = [], []
        for of, a, b in _runs(node):
            here = router(level, of)
            ranked = here.ranked(x[asker[a:b]], min(here.probes, here.parts))
            asked.append(np.repeat(asker[a:b], ranked.shape[1]))
            reached.append((of * parts + ranked).ravel())
        asker, node = np.concatenate(asked), np.concatenate(reached)
        order = np.argsort(node, kind="stable")
        asker, node = asker[order], node[order]
    return asker, node


def _likely(x: np.ndarray, router: Callable[[int, int], Router], depth: int, parts: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vector probes which part, ordered by part: the ``most`` parts of the whole tree that are the most probable, as many nodes being followed on each level."""
    askers, nodes = [], []
    for begin in range(0, len(x), 2048):
        asker, node = np.arange(begin, min(begin + 2048, len(x))), np.zeros(min(2048, len(x) - begin), dtype=np.int64)
        score = np.zeros(len(asker), dtype=np.float32)
        for level in range(depth):
            asked, reached, scored = [], [], []
            for of, a, b in _runs(node):
                logs = router(level, of).logs(x[asker[a:b]])
                best = np.argpartition(-logs, min(most, logs.shape[1]) - 1, axis=1)[:, :most]
                asked.append(np.repeat(asker[a:b], best.shape[1]))
                reached.append((of * parts + best).ravel())
                scored.append((score[a:b, None] + np.take_along_axis(logs, best, axis=1)).ravel())
            asker, node, score = np.concatenate(asked), np.concatenate(reached), np.concatenate(scored)
            order = np.lexsort((-score, asker))
            counts = np.bincount(asker - begin)
            order = order[np.arange(len(order)) - np.repeat(counts.cumsum() - counts, counts) < most]
            order = order[np.argsort(node[order], kind="stable")]
            asker, node, score = asker[order], node[order], score[order]
        askers.append(asker)
        nodes.append(node)
    asker, node = np.concatenate(askers), np.concatenate(nodes)
    order = np.argsort(node, kind="stable")
    return asker[order], node[order]


def _enough(sample: np.ndarray, router: Callable[[int, int], Router], depth: int, parts: int, least: float, missed: float = 2e-4, seed: int = 5) -> int:
    """How many parts a vector must ask for pairs of cosine ``least``: of pairs drawn so, a sampled vector and one in a random direction from it, all but a share of ``missed`` are found from either side.

    These are the hardest pairs, as closer ones lie in one part more often.
    """
    if parts == 1 or not len(sample):
        return 1
    random = np.random.default_rng(seed)
    x = sample[random.permutation(len(sample))[:5_000]]
    away = random.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = least * x + np.sqrt(1 - least * least) * away / np.sqrt((away * away).sum(axis=1, keepdims=True))
    homes = []
    for z in (x, y):
        asker, node = _likely(z, router, depth, parts, 1)
        homes.append(node[np.argsort(asker)])
    most = 1
    while most < parts**depth:
        met = np.zeros(len(x), dtype=bool)
        for z, home in ((x, homes[1]), (y, homes[0])):
            asker, node = _likely(z, router, depth, parts, most)
            met[asker[node == home[asker]]] = True
        if met.mean() >= 1 - missed:
            break
        most = int(np.ceil(most * 1.3))
    return most


def _searched(spark: SparkSession, index: _Index, segments: pa.Table, k: int, unit: int, kind: str, least: float | None, probes: int | None) -> DataFrame:
    """``id``, ``near``, ``d``: at most k others, best first, or all with a cosine of ``least``, and their negative cosines. A task takes ``unit`` neighbouring vectors and reads the parts that they probe one after another."""
    dim, most, sent = index.dim, BLOCK_ROWS, index.kept()
    s = _of(segments)
    sizes = dict(zip(s["file"].tolist(), s["rows"].tolist()))
    pieces = [(f, n, a, min(unit, n - a)) for f, n in sorted(sizes.items()) for a in range(0, n, unit)]
    listed = index.shelf.put_table(segments)
    wanted = index.shelf.put_table(pa.table({"file": pa.array([p[0] for p in pieces], pa.string()), **{c: pa.array([p[i] for p in pieces], pa.int64()) for i, c in enumerate(("rows", "start", "held"), 1)}}))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, w, router = _of(sent.shelf.table(listed)), _of(sent.shelf.table(wanted)), sent.reader()
        for i in (i for batch in batches for i in batch.column(0).to_pylist()):
            piece = (str(w["file"][i]), int(w["rows"][i]), int(w["start"][i]), int(w["held"][i]))
            home = s["node"][(s["file"] == piece[0]) & (s["start"] < piece[2] + piece[3]) & (s["start"] + s["held"] > piece[2])]
            yield _answered(sent, piece, s, home, router, k, most) if least is None else _alike(sent, piece, s, router, least, probes, most)

    return _units(spark, len(pieces)).mapInArrow(searched, "id bigint, near array<bigint>, d array<double>").withColumn("id", F.col("id").cast(kind)).withColumn("near", F.col("near").cast(f"array<{kind}>"))


def _blocks(segments: dict[str, np.ndarray], of: int, most: int) -> Iterator[tuple[str, int, int, int]]:
    """The pieces of files that hold a part, of at most ``most`` vectors."""
    for j in range(*np.searchsorted(segments["node"], [of, of + 1])):
        start, end = int(segments["start"][j]), int(segments["start"][j] + segments["held"][j])
        for begin in range(start, end, most):
            yield str(segments["file"][j]), int(segments["rows"][j]), begin, min(most, end - begin)


def _alike(index: _Index, piece: tuple[str, int, int, int], segments: dict[str, np.ndarray], router: Callable[[int, int], Router], least: float, probes: int, most: int) -> pa.RecordBatch:
    """The others with a cosine of at least ``least`` in the parts that the vectors of a piece of a file probe."""
    ids, x = index.shelf.vectors(*piece, index.dim)
    x = _unit(x)
    flat = x.astype(np.float32)
    asker, part = _likely(flat, router, index.depth, index.parts, probes)
    found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
    for of, a, b in _runs(part):
        rows = asker[a:b]
        for block in _blocks(segments, of, most):
            keys, y = index.shelf.vectors(*block, index.dim)
            y = _unit(y)
            turned, step = np.ascontiguousarray(y.T, dtype=np.float32), max(1, 2_000_000 // len(y))
            for i in range(0, len(rows), step):
                at = np.flatnonzero((flat[rows[i : i + step]] @ turned).ravel() >= least - 1e-5)
                own, other = rows[i + at // len(y)], at % len(y)
                exact = np.round(np.einsum("nd,nd->n", x[own], y[other]), 12)
                good = (exact >= least) & (keys[other] != ids[own])
                found.append((own[good], keys[other][good], -exact[good]))
    own, near, d = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((near, d, own))
    offsets = pa.array(np.append(0, np.bincount(own, minlength=len(ids)).cumsum()).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(near[order])), pa.ListArray.from_arrays(offsets, pa.array(d[order]))], names=["id", "near", "d"])


def _answered(index: _Index, piece: tuple[str, int, int, int], segments: dict[str, np.ndarray], home: np.ndarray, router: Callable[[int, int], Router], k: int, most: int) -> pa.RecordBatch:
    """The neighbours of the vectors of a piece of a file. Their own parts come first, so that what they hold keeps most rows of the others from being compared further."""
    shelf, dim, width = index.shelf, index.dim, k + 9
    ids, x = shelf.vectors(*piece, dim)
    x = _unit(x)
    flat = x.astype(np.float32)
    asker, part = _probed(flat, router, index.depth, index.parts)
    at, value = np.zeros((len(ids), width), dtype=np.int64), np.full((len(ids), width), -np.inf, dtype=np.float32)
    blocks, seen = [], 0
    for of, a, b in sorted(_runs(part), key=lambda run: run[0] not in home):
        for block in _blocks(segments, of, most):
            rows = asker[a:b]
            where, near = _top(flat[rows], _unit(shelf.vectors(*block, dim)[1]), width, value[rows].min(axis=1))
            some = np.isfinite(near).any(axis=1)
            rows = rows[some]
            both, gain = np.hstack([at[rows], seen + where[some]]), np.hstack([value[rows], near[some]])
            best = np.argpartition(-gain, width - 1, axis=1)[:, :width]
            at[rows], value[rows] = np.take_along_axis(both, best, axis=1), np.take_along_axis(gain, best, axis=1)
            blocks.append((seen, block))
            seen += block[3]
    real = np.isfinite(value)
    near, exact = np.zeros(at.shape, dtype=np.int64), np.full(at.shape, -np.inf)
    asks, slot = np.nonzero(real)
    places = at[asks, slot]
    order = np.argsort(places, kind="stable")
    asks, slot, places = asks[order], slot[order], places[order]
    for begin, block in blocks:
        lo, hi = np.searchsorted(places, [begin, begin + block[3]])
        if lo < hi:
            keys, y = shelf.vectors(*block, dim)
            y, own = _unit(y), places[lo:hi] - begin
            near[asks[lo:hi], slot[lo:hi]] = keys[own]
            exact[asks[lo:hi], slot[lo:hi]] = np.einsum("nd,nd->n", x[asks[lo:hi]], y[own])
    exact = np.where(real & (near != ids[:, None]), np.round(exact, 12), -np.inf)  # so that what ties on paper ties here
    order = np.lexsort((near, -exact), axis=1)[:, :k]
    near, exact = np.take_along_axis(near, order, axis=1), np.take_along_axis(exact, order, axis=1)
    real = np.isfinite(exact)
    offsets = pa.array(np.concatenate([[0], real.sum(axis=1).cumsum()]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(near[real])), pa.ListArray.from_arrays(offsets, pa.array(-exact[real]))], names=["id", "near", "d"])


def _spread(found: DataFrame, same: DataFrame, k: int | None, key: str, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of representatives given to all equal vectors, who are also each other's neighbours; the first k, or all if that is null."""
    firsts = lambda df, by, *order: df if k is None else df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k + 1)
    first = firsts(same, "rep", "id")
    members = cut(first.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("members")))
    plain = found.select("id", F.explode(F.arrays_zip("d", "near")).alias("_p")).select("id", F.col("_p.d").alias("d"), F.col("_p.near").alias("to"))
    grown = plain.join(few(members.withColumnRenamed("rep", "to")), "to", "left").select("id", "d", F.explode(F.coalesce("members", F.array("to"))).alias("to"))
    own = members.select(F.col("rep").alias("id"), F.lit(-1.0).alias("d"), F.explode("members").alias("to"))
    best = firsts(grown.unionByName(own), "id", "d", "to")
    lone = best.join(few(members.select(F.col("rep").alias("id"))), "id", "left_anti").select(F.col("id").alias("_for"), "d", "to")
    many = best.join(few(same.select(F.col("id").alias("_for"), F.col("rep").alias("id"))), "id").select("_for", "d", "to")
    rank = F.row_number().over(Window.partitionBy("_for").orderBy("d", "to"))
    out = lone.unionByName(many).where("_for <> to").withColumn("rank", rank)
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.select(F.col("_for").alias(key), F.col("to").alias("neighbour"), (-F.col("d")).alias("cosine"), "rank")


def similar_pairs(graph: DataFrame, key: str, least: float) -> DataFrame:
    """``<key>_a`` < ``<key>_b``: the pairs of a neighbour graph, found from either side, with a cosine of at least ``least``."""
    ends = graph.where(F.col("cosine") >= least).select(F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b"))
    return ends.distinct()
