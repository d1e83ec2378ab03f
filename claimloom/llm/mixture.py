"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.lineage import cut

#: Records that one rounding task takes, residuals that one merging task takes, targets that may be read to the driver.
RECORDS, FAN, TARGETS = 500_000, 64, 10_000


def source_key(source: str) -> Column:
    """A source however it is written; null for null and blank."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(F.regexp_replace(source, r"(?U)[\s_-]+", " "))), " ", "_"), F.lit(""))


def pivotal(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal dependent rounding: (chances afterwards, place of the one still fractional or -1).

    Two fractional chances at a time exchange mass (size x chance), up or down at random so that each keeps its mean, until one of
    them is 0 or 1; the other goes on. The sum of size x chance stays as it was.
    """
    out, carry = chances.astype(float).copy(), -1
    for j in range(len(out)):
        if not 0 < out[j] < 1:
            continue
        if carry < 0:
            carry = j
            continue
        a, b = sizes[carry], sizes[j]
        x, y = a * out[carry], b * out[j]
        up, down = min(a - x, y), min(x, b - y)
        d = up if draws[j] * (up + down) < down else -down
        if d > 0:
            full, empty = a - x <= y, y <= a - x
        else:
            full, empty = b - y <= x, x <= b - y
        p, q = (x + d) / a, (y - d) / b
        if d > 0:
            p, q = (1.0 if full else p), (0.0 if empty else q)
        else:
            p, q = (0.0 if empty else p), (1.0 if full else q)
        out[carry], out[j] = p, q
        carry = carry if 0 < p < 1 else j if 0 < q < 1 else -1
    return out, carry


def _rounded(batches: Iterator[pd.DataFrame], last: bool) -> Iterator[pd.DataFrame]:
    """Rows in the order of their cells; within a cell a single fractional chance remains, or none if ``last``."""
    held: pd.DataFrame | None = None
    for batch in batches:
        for cell, part in batch.groupby("cell", sort=False):
            if held is not None and held["cell"].iat[0] == cell:
                part = pd.concat([held, part])
            elif held is not None:
                yield _settled(held, last)
            held = None
            chances, carry = pivotal(part["n_tokens"].to_numpy(), part["chance"].to_numpy(), part["draw"].to_numpy())
            part = part.assign(chance=chances)
            if carry < 0:
                yield part
            else:
                yield part.iloc[np.arange(len(part)) != carry]
                held = part.iloc[[carry]]
    if held is not None:
        yield _settled(held, last)


def _settled(row: pd.DataFrame, last: bool) -> pd.DataFrame:
    return row.assign(chance=(row["draw"] < row["chance"]).astype(float)) if last else row


def shares_within_reach(totals: dict[str, int], targets: dict[str, tuple[float, int]], wanted: float | None = None) -> tuple[float, dict[str, float]]:
    """The total that all shares reach within their repeats, and each source's mean copies of a record: the ``wanted`` total, or the largest possible where that is less or none is wanted.

    Sources without tokens cannot contribute; the other shares then keep their proportions.
    """
    live = {s: (share, most) for s, (share, most) in targets.items() if share > 0 and most > 0 and totals.get(s, 0) > 0}
    whole = sum(share for share, _ in live.values())
    if not live:
        return 0.0, {}
    total = min(most * totals[s] * whole / share for s, (share, most) in live.items())
    total = total if wanted is None else min(total, float(wanted))
    return total, {s: min(float(most), total * share / whole / totals[s]) for s, (share, most) in live.items()}


def mix(records: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 11, per_cell: int = RECORDS, fan: int = FAN, total: float | None = None) -> DataFrame:
    """``key``, ``source``, ``n_tokens``, ``copies``: every record that the mixture uses, with how often.

    ``targets`` has source, target_share, max_repeats. The mixture has ``total`` size, or, where that is not given or out of reach, is the largest whose sources all have their share; within a source every record has the
    same mean number of copies. Whole copies are given to all; the fraction left is rounded by pivotal sampling
    that keeps the source's sum of tokens: in cells of about ``per_cell`` records, then over the cells' residuals in a tree of fan-in ``fan``,
    so a source misses its share by one record at most. Records with a null key, no size or a source without target are not used.
    The same ``seed`` gives the same mixture, however the input is partitioned.
    """
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select(source_key("source"), "target_share", "max_repeats").limit(TARGETS + 1).collect()
    if len(wanted) > TARGETS:
        raise ValueError(f"more than {TARGETS} targets")
    goals = {r[0]: (float(r[1]), int(r[2])) for r in wanted if r[0]}
    rows = cut(records.where(F.col(key).isNotNull() & (F.col(size) > 0)).select(key, source_key(source).alias("source"), F.col(size).cast("long").alias("n_tokens")).where(F.col("source").isin(list(goals))))
    found = {r[0]: (r[1], r[2]) for r in rows.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}
    _, copies = shares_within_reach({s: t for s, (t, _) in found.items()}, goals, total)
    cells = max([1, *(-(-n // per_cell) for s, (_, n) in found.items() if s in copies)])
    mean = F.coalesce(*(F.when(F.col("source") == s, F.lit(c)) for s, c in copies.items()), F.lit(0.0)) if copies else F.lit(0.0)
    uniform = lambda *x: (F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    whole = F.floor(F.col("mean") + 1e-9)
    chance = F.col("mean") - F.col("whole")
    rows = rows.withColumn("mean", mean).where("mean > 0").withColumn("whole", whole).withColumn("chance", F.when(chance < 1e-9, 0.0).otherwise(chance)).withColumn("order", F.xxhash64(F.lit(seed), key)).withColumn("draw", uniform(F.col(key), F.lit(1)))
    rows = rows.withColumn("node", F.pmod(F.col("order"), F.lit(cells)))
    done = rows.where("chance = 0").select(key, "source", "n_tokens", F.col("whole").cast("int").alias("copies"))
    open_rows = rows.where("chance > 0").drop("mean")
    level = 0
    while True:
        last = cells == 1
        cell = F.concat_ws("#", "source", "node")
        sorted_rows = open_rows.withColumn("cell", cell).repartition("cell").sortWithinPartitions("cell", "order", key)
        schema = ", ".join(f"`{c}` {t}" for c, t in sorted_rows.dtypes)
        out = cut(sorted_rows.mapInPandas(lambda it, last=last: _rounded(it, last), schema))
        decided = out.where("chance IN (0, 1)")
        done = done.unionByName(decided.select(key, "source", "n_tokens", (F.col("whole") + F.col("chance")).cast("int").alias("copies")))
        if last:
            return done.where("copies > 0")
        level += 1
        cells = -(-cells // fan)
        open_rows = out.where("chance > 0 AND chance < 1").drop("cell").withColumn("node", F.floor(F.col("node") / fan)).withColumn("draw", uniform(F.col(key), F.lit(1 + level)))


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``records``, ``uses``, ``most_uses``, ``tokens``, ``share``, ``target_share``: what the mixture reached; a target without records has zeros."""
    got = mixed.groupBy("source").agg(F.count("*").alias("records"), F.sum("copies").alias("uses"), F.max("copies").alias("most_uses"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    total = got.agg(F.sum("tokens").alias("_all"))
    goal = targets.where("source IS NOT NULL").groupBy(source_key("source").alias("source")).agg(F.max("target_share").alias("target_share"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return goal.join(got, "source", "left").join(F.broadcast(total)).select("source", *(zero(c) for c in ("records", "uses", "most_uses", "tokens")), (F.coalesce("tokens", F.lit(0)) / F.greatest(F.coalesce("_all", F.lit(0)), F.lit(1))).alias("share"), "target_share")
