"""Average-linkage merges of topics: parallel rounds of mutual nearest pairs, and a chain of neighbours for the last few.

Average linkage never makes a merged topic nearer to another than both its parts were, so pairs that are each other's
nearest can be merged in any order. While many topics are left, every round merges all such pairs at once over tables;
FEW topics or less are settled by a nearest-neighbour chain over their matrix. Both give the same merges.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engagelake.session import written

#: Topics whose similarities one task may hold (a matrix of 32 MB).
FEW = 2048
STEPS = "topic_a long, topic_b long, similarity double, size double"


def chain(labels: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> list[tuple[int, int, float, float]]:
    """All merges (label, label, similarity, weight) of labels with weights and similarities s of pairs (a, b), else 0.

    From any topic the chain goes to its nearest, on to that one's nearest, until two are each other's; these merge, and
    the similarities of the merged topic are the weighted means of its parts'. A pair of smaller labels wins a tie, and
    a merged topic goes by its smaller label.
    """
    order = np.argsort(labels)
    labels, weights, n = labels[order], weights[order].astype(float), len(labels)
    m = np.zeros((n, n))
    i, j = np.searchsorted(labels, a), np.searchsorted(labels, b)
    m[i, j] = m[j, i] = s
    np.fill_diagonal(m, -np.inf)
    alive, path, out = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not path:
            path.append(int(alive.argmax()))
        while True:
            near = int(m[path[-1]].argmax())  # the first, so the smallest label, of equal ones
            if len(path) > 1 and near == path[-2]:
                break
            path.append(near)
        low, high = sorted((path.pop(), path.pop()))
        out.append((int(labels[low]), int(labels[high]), float(m[low, high]), float(weights[low] + weights[high])))
        m[low] = (weights[low] * m[low] + weights[high] * m[high]) / (weights[low] + weights[high])
        m[:, low], m[low, low] = m[low], -np.inf
        m[high], m[:, high] = -np.inf, -np.inf
        weights[low] += weights[high]
        alive[high] = False
    return out


def _few(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = chain(right["topic"].to_numpy(), right["w"].to_numpy(), *[left[c].to_numpy() for c in "abs"])
        return pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])

    one = F.lit(0).alias("one")
    left, right = pairs.where("a < b").select(one, "a", "b", "s"), weights.select(one, "topic", "w")
    return left.groupBy("one").cogroup(right.groupBy("one")).applyInPandas(work, STEPS)


def _round(pairs: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merges, pairs, weights) after all mutual nearest pairs are merged."""
    rank = F.struct("s", -F.least("a", "b"), -F.greatest("a", "b"))  # one order for both ends: the first pair is mutual
    nearest = written(pairs.groupBy("a").agg(F.max_by("b", rank).alias("b"), F.max("s").alias("s")))
    back = nearest.select(F.col("a").alias("b"), F.col("b").alias("back"))
    mutual = nearest.where("a < b").join(back, "b").where(F.col("back") == F.col("a")).select("a", "b", "s")
    into = mutual.select(F.col("b").alias("topic"), F.col("a").alias("into"))
    # Where every topic goes, its own weight, and the weight of what it becomes.
    moves = weights.join(into, "topic", "left").withColumn("into", F.coalesce("into", "topic"))
    moves = written(moves.withColumn("whole", F.sum("w").over(Window.partitionBy("into"))))
    steps = mutual.join(moves.select(F.col("topic").alias("a"), F.col("whole").alias("size")), "a")
    steps = written(steps.select(F.col("a").alias("topic_a"), F.col("b").alias("topic_b"), F.col("s").alias("similarity"), "size"))
    for side in "ab":
        names = {"topic": side, "into": f"n{side}", "w": f"w{side}", "whole": f"t{side}"}
        pairs = pairs.join(moves.withColumnsRenamed(names), side)
    mean = F.sum(F.col("s") * F.col("wa") * F.col("wb")) / F.first("ta") / F.first("tb")
    pairs = pairs.where("na <> nb").groupBy(F.col("na").alias("a"), F.col("nb").alias("b")).agg(mean.alias("s"))
    return steps, written(pairs), written(moves.groupBy(F.col("into").alias("topic")).agg(F.sum("w").alias("w")))


def merge_steps(similarity: DataFrame, sizes: DataFrame, few: int = FEW) -> DataFrame:
    """All merges (topic_a, topic_b, similarity, size) for (topic_a, topic_b, cosine), both ways, and (topic, count).

    A merged topic goes by its smallest number, pairs that are not there (or below 0) count as 0, so topics that share
    nothing are joined to the smallest one at the end. Every round is stored, so no plan grows with the rounds.
    """
    weights = written(sizes.select(F.col("topic").cast("long").alias("topic"), F.col("count").cast("double").alias("w")))
    pairs = similarity.select(F.col("topic_a").alias("a"), F.col("topic_b").alias("b"), F.col("cosine").alias("s")).where("a <> b and s > 0")
    for side in "ab":
        pairs = pairs.join(weights.select(F.col("topic").alias(side)), side, "left_semi")
    pairs, steps = written(pairs), []
    while (left := weights.count()) > few and not pairs.isEmpty():
        made, pairs, weights = _round(pairs, weights)
        steps.append(made)
    if left <= few:
        return reduce(DataFrame.unionByName, steps, _few(pairs, weights))
    # Nothing is alike any more: one row per topic that is left.
    order = Window.orderBy("topic").rowsBetween(Window.unboundedPreceding, 0)
    rest = weights.select(F.min("topic").over(Window.partitionBy()).alias("topic_a"), F.col("topic").alias("topic_b"),
                          F.lit(0.0).alias("similarity"), F.sum("w").over(order).alias("size"))
    return reduce(DataFrame.unionByName, steps, rest.where("topic_a < topic_b"))


def ordered(steps: DataFrame) -> DataFrame:
    """Merges in the order in which average linkage makes them, numbered from 0 by ``step``; one row per topic."""
    order = Window.orderBy(F.desc("similarity"), "size", "topic_a", "topic_b")
    return steps.withColumn("step", (F.row_number().over(order) - 1).cast("bigint"))


def cut(steps: DataFrame, topics: DataFrame, merges: int) -> DataFrame:
    """(topic, root): what every topic has become after so many steps. The way to the root halves with each round."""
    made = steps.where(F.col("step") < merges).select(F.col("topic_b").alias("topic"), F.col("topic_a").alias("root"))
    now = written(topics.select("topic").join(made, "topic", "left").select("topic", F.coalesce("root", "topic").alias("root")))
    while True:
        above = now.select(F.col("topic").alias("root"), F.col("root").alias("next"))
        jumped = written(now.join(above, "root").select("topic", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        now = jumped.select("topic", "root")
        if jumped.where("moved").isEmpty():
            return now
