"""Filling containers of fixed capacity with items of varying size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.lineage import cut

#: Bins that a packer keeps open, and items that one packer takes.
OPEN_BINS, ITEMS = 64, 200_000


class BestFit:
    """Online best fit over a bounded number of open bins.

    A bit of ``free`` is set for each amount of free space that some open bin has; the best bin for an item is the lowest set bit at
    or above its size. If none fits and all bins are in use, the fullest closes.
    """

    def __init__(self, capacity: int, bins: int) -> None:
        self.capacity, self.bins, self.free = capacity, bins, 0
        self.open: dict[int, list[int]] = {}
        self.count = self.made = 0

    def put(self, size: int) -> int:
        """The number of the bin that takes an item of 0 < size <= capacity."""
        fits = self.free >> size
        if fits:
            space = size + ((fits & -fits).bit_length() - 1)
            number = self._take(space)
        else:
            if self.count == self.bins:
                self._take((self.free & -self.free).bit_length() - 1)
            number, space = self.made, self.capacity
            self.made += 1
        if left := space - size:
            self.open.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.count += 1
        return number

    def _take(self, space: int) -> int:
        held = self.open[space]
        number = held.pop()
        self.count -= 1
        if not held:
            del self.open[space]
            self.free &= ~(1 << space)
        return number

    def unfilled(self) -> Iterator[tuple[int, int]]:
        """Number and fill of the bins that are still open."""
        return ((n, self.capacity - space) for space, held in self.open.items() for n in held)


def sized_pieces(items: DataFrame, specs: DataFrame, item: str, size: str) -> DataFrame:
    """``spec_id``, ``capacity``, ``item``, ``piece``, ``first``, ``size``: items cut to the capacity where they exceed it.

    ``specs`` (spec_id, capacity_tokens) must be small; it is read to the driver and its size is checked. Specs without a positive capacity are left out.
    """
    rows = specs.where("capacity_tokens > 0 AND spec_id IS NOT NULL").select("spec_id", "capacity_tokens").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 specs; pack them in several calls")
    each = F.array(*(F.struct(F.lit(r[0]).alias("spec_id"), F.lit(r[1]).cast("long").alias("capacity")) for r in rows)) if rows else F.array().cast("array<struct<spec_id:int,capacity:bigint>>")
    out = items.where(F.col(item).isNotNull() & (F.col(size) > 0)).select(item, F.col(size).cast("long").alias("_size"), F.explode(each).alias("_s"))
    cutting = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / F.col("_s.capacity")))).alias("piece")
    pieces = out.select("_s.spec_id", "_s.capacity", item, "_size", cutting).withColumn("first", F.col("piece") * F.col("capacity"))
    return pieces.select("spec_id", "capacity", item, F.col("piece").cast("int").alias("piece"), "first", F.least("capacity", F.col("_size") - F.col("first")).alias("size"))


def _packed(rows: Iterable[pd.DataFrame], bins: int, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches of pieces of one partition; a packer for each ``_cell`` in turn. The bins left open are marked ``_tail``."""
    packer, now, held = None, None, []

    def done() -> Iterator[pd.DataFrame]:
        if held:
            whole = pd.concat(held)
            fill = dict(packer.unfilled())
            whole["_tail"] = whole["_bin"].map(fill).fillna(0).astype("int64")
            yield whole[columns]

    for batch in rows:
        for cell, part in batch.groupby("_cell", sort=False):
            if cell != now:
                yield from done()
                packer, now, held = BestFit(int(part["capacity"].iat[0]), bins), cell, []
            put = packer.put
            held.append(part.assign(_bin=[put(int(s)) for s in part["size"]]))
    yield from done()


def pack(items: DataFrame, specs: DataFrame, item: str = "doc_id", size: str = "n_tokens", bins: int = OPEN_BINS, per_packer: int = ITEMS) -> DataFrame:
    """Every piece of every item in a container of each spec: ``spec_id``, ``capacity``, ``container``, ``item``, ``piece``, ``first``, ``size``.

    Items (unique keys) go in hash order to packers of about ``per_packer`` items each, bounded-space online best fit with ``bins`` open bins.
    The bins a packer leaves open count as items of the next round, with their fill as size, until one packer takes all that is left;
    its open bins stay. So the waste does not grow with the number of packers. Only an item above the capacity is split.
    ``container`` is a string, unique within the spec. Items with a null key, null or zero size need no room and have no row.
    """
    pieces = cut(sized_pieces(items, specs, item, size))
    spark = pieces.sparkSession
    name = "_item"
    level = pieces.select("spec_id", "capacity", F.concat_ws("/", F.col(item).cast("string"), F.col("piece").cast("string")).alias(name), "size")
    sizes = {r[0]: r[1] for r in level.groupBy("spec_id").count().collect()}
    left, depth, homes = max(sizes.values(), default=0), 0, None
    while True:
        cells = max(1, -(-left // per_packer))
        put = cut(_round(spark, level, cells, bins))
        link = put.select("spec_id", F.col(name).alias("_from"), F.concat_ws(".", F.lit(depth), "_cell", "_bin").alias("_to"), "capacity", "_tail")
        step = link.select("spec_id", F.col("_from"), F.col("_to"))
        homes = step if homes is None else homes.join(step.select("spec_id", F.col("_from").alias("_to"), F.col("_to").alias("_next")), ["spec_id", "_to"], "left").select("spec_id", "_from", F.coalesce("_next", "_to").alias("_to"))
        if cells == 1:
            break
        level = link.where("_tail > 0").groupBy("spec_id", "capacity", F.col("_to").alias(name)).agg(F.first("_tail").alias("size"))
        left = max((r[1] for r in level.groupBy("spec_id").count().collect()), default=0)
        depth += 1
        if not left:
            break
    placed = pieces.withColumn("_from", F.concat_ws("/", F.col(item).cast("string"), F.col("piece").cast("string"))).join(homes, ["spec_id", "_from"])
    return placed.select("spec_id", "capacity", F.col("_to").alias("container"), item, "piece", "first", "size")


def _round(spark: SparkSession, level: DataFrame, cells: int, bins: int) -> DataFrame:
    """One round of packers: the rows of ``level`` with ``_cell``, ``_bin`` and ``_tail`` (the fill of a bin left open, else 0)."""
    cell = F.concat_ws("-", "spec_id", F.pmod(F.xxhash64("_item"), F.lit(cells)))
    order = F.xxhash64("_item", F.lit(7))
    rows = level.withColumn("_cell", cell).withColumn("_order", order).repartition("_cell").sortWithinPartitions("_cell", "_order", "_item")
    columns = ["spec_id", "capacity", "_item", "size", "_cell", "_bin", "_tail"]
    kinds = dict(level.dtypes)
    schema = f"spec_id {kinds['spec_id']}, capacity long, _item string, size long, _cell string, _bin long, _tail long"
    return rows.drop("_order").mapInPandas(lambda it: _packed(it, bins, columns), schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """``spec_id``, ``capacity``, ``containers``, ``tokens``, ``unused_share`` of each spec."""
    bins = packed.groupBy("spec_id", "capacity", "container").agg(F.sum("size").alias("_fill"))
    unused = 1 - F.sum("_fill") / (F.count("*") * F.col("capacity"))
    return bins.groupBy("spec_id", "capacity").agg(F.count("*").alias("containers"), F.sum("_fill").alias("tokens"), unused.alias("unused_share"))


def container_order(packed: DataFrame) -> DataFrame:
    """``packed`` with ``slot``: the place of a piece in its container, by item and piece, from 0."""
    window = Window.partitionBy("spec_id", "container").orderBy(*[c for c in packed.columns if c not in {"spec_id", "capacity", "container", "first", "size"}])
    return packed.withColumn("slot", F.row_number().over(window) - 1)
