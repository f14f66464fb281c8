"""Sharding by a hierarchical weighted hash tree: regions hold racks, racks hold shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engagelake.llm.common import query, read, unit

SHARDS = 8
#: Rows that one slot-numbering group holds on average.
GROUP_ROWS = 50_000

#: Region -> rack -> shard -> weight.
Tree = dict[int, dict[int, dict[int, float]]]


def topology(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """A tree of ``shards`` equal leaves, filled in order: a new shard opens a new rack, or a new region, when all are full."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // per_rack
        tree.setdefault(rack // racks, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def _winner(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The node whose exponential draw, of rate ``weight``, comes first."""
    draws = [
        F.struct((-F.log(unit(key, F.lit(level), F.lit(node))) / F.lit(float(weight))).alias("draw"), F.lit(node).alias("node"))
        for node, weight in weights.items() if weight > 0
    ]
    return F.array_min(F.array(*draws))["node"] if draws else F.lit(None).cast("int")


def _descend(at: Column, children: dict[int, Column]) -> Column:
    chosen = F.lit(None).cast("int")
    for node, child in children.items():
        chosen = F.when(at == node, child).otherwise(chosen)
    return chosen


def place(df: DataFrame, key: str, tree: Tree, into: str) -> DataFrame:
    """Add the shard of each row as ``into``.

    At every level a row draws an exponential variate per child, hashed from the key and the child, divided by the
    child's weight, and goes to the smallest. A child whose weight does not change keeps its draws, so a change of
    weight moves rows only into or out of the subtrees on the path of that change; a shard that opens a region of
    its own (as the ninth does in ``topology``) takes rows only into itself.
    The key and the tree alone decide. Rows with a null key share one shard; rows with equal keys share theirs.
    """
    region, rack = f"{into}__region", f"{into}__rack"
    col = F.col(key)
    total = {r: sum(sum(leaf.values()) for leaf in racks.values()) for r, racks in tree.items()}
    df = df.withColumn(region, _winner(col, "region", total))
    df = df.withColumn(rack, _descend(F.col(region), {
        r: _winner(col, "rack", {k: sum(leaf.values()) for k, leaf in racks.items()}) for r, racks in tree.items()}))
    leaves = {k: leaf for racks in tree.values() for k, leaf in racks.items()}
    df = df.withColumn(into, _descend(F.col(rack), {k: _winner(col, "shard", leaf) for k, leaf in leaves.items()}))
    return df.drop(region, rack)


def number_slots(df: DataFrame, shard: str, order: list[str], into: str = "slot", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Number the rows of each shard 0, 1, 2, … without a gap, with no task that holds a whole shard.

    Rows are dealt into hash groups of about ``group_rows``; a group's first slot is the count of the groups before it.
    Equal rows stay together and get slots in any order.
    """
    groups = max(1, math.ceil(df.count() / group_rows))
    df = df.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    counts = df.groupBy(shard, "__group").agg(F.count("*").alias("__rows"))
    before = W.partitionBy(shard).orderBy("__group").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        F.col(shard).alias("__shard"), F.col("__group").alias("__at"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(W.partitionBy(shard, "__group").orderBy(*order))
    numbered = df.withColumn(into, own.cast("long"))
    return numbered.join(
        starts, (F.col(shard) == F.col("__shard")) & (F.col("__group") == F.col("__at"))
    ).withColumn(into, F.col("__start") + F.col(into) - 1).drop("__group", "__shard", "__at", "__start")


def write_shards(df: DataFrame, shard: str, folder: str) -> None:
    """Write the rows, one directory per shard, in slot order within each file where a slot is there."""
    parts = df.repartition(F.col(shard), F.pmod(F.xxhash64("slot"), F.lit(16))) if "slot" in df.columns else df
    parts.write.partitionBy(shard).parquet(folder)


@query("op6_sharding")
def _sharding(spark, folder):
    """All documents in shards 0 to 7 under the law ``key``, and where nine shards would put them.

    A null text has 0 bytes (size 1, checksum of no bytes). Equal texts need not meet.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = read(spark, folder, "documents").select(
        "doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = place(rows, "doc_id", topology(SHARDS), "shard")
    rows = place(rows, "doc_id", topology(SHARDS + 1), "grown_shard")
    rows = number_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
