"""Centre-based clustering, validity scores and seeded model selection."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engagelake.operators.density import MAX_DIMENSIONS, NOISE, dbscan, single_linkage
from engagelake.operators.distribution import standardize
from engagelake.operators.frequency import sample_per_group
from engagelake.schemas import quoted
from engagelake.session import broadcast_if_small, cut_lineage, written

BLOCK_POINTS = 4096
#: Points that one task of a K-means fit holds about.
POINTS_PER_TASK = 500_000
#: Share of the norm by which the first two centres of a split lie apart from the middle, at most, and rounds of a split.
SPLIT_STEP, SPLIT_ROUNDS = 1e-4, 20
#: Blocks of an all-pairs job: wider blocks for more rows, so that copies of the rows grow no faster than the rows, up to a width.
BLOCKS, MOST_POINTS = 24, 32768
#: Columns from which distances go through a matrix product, and the share of the squared norms below which they are measured anew.
PRODUCT_COLUMNS, CLOSE = 8, 1e-6


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="skip").transform(df)


def _weighted(df: DataFrame, columns: list[Column]) -> DataFrame:
    """(__c0, …, __w), stored: each distinct point of the rows once, with its rows as weight. Every pass of a fit reads these.

    Rows with a null or NaN in a column are left out.
    """
    names = [f"__c{i}" for i in range(len(columns))]
    cells = df.select(*[c.cast("double").alias(n) for c, n in zip(columns, names, strict=True)]).dropna()
    return written(cells.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("__w")))


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 42, label: str = "cluster") -> DataFrame:
    """Rows with their K-means cluster; rows with a null in a column are left out.

    Equal rows are fitted as one weighted point. The points are dealt out so that a task, which keeps its part as objects
    during the fit, holds POINTS_PER_TASK about, however large the files of the rows are.
    """
    from pyspark.ml.clustering import KMeans

    points = _weighted(df, [quoted(c) for c in columns])
    names, tasks = points.columns[:-1], max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(points.count() / POINTS_PER_TASK))
    data = _assembled(points.repartition(tasks, *names), names)
    fit = KMeans(k=k, seed=seed, featuresCol="__x", weightCol="__w", predictionCol=label).fit(data)
    return fit.transform(_assembled(df, columns)).drop("__x").withColumn(label, F.col(label).cast("bigint"))


def _uniform(seed: int) -> Iterator[float]:
    """Numbers from 0 to 1 as Spark's bisecting fit draws them, so that equal rows give the clusters of that fit."""
    state = (seed ^ 0x5DEECE66D) % (1 << 48)
    while True:
        drawn = 0
        for bits in (26, 27):
            state = (state * 0x5DEECE66D + 0xB) % (1 << 48)
            drawn = (drawn << bits) + (state >> (48 - bits))
        yield drawn / (1 << 53)


def _apart(values: list[Column], centre: list[Column]) -> Column:
    """Squared distance; infinite to a centre of nulls, which no row came to."""
    return F.coalesce(reduce(lambda a, b: a + b, [(v - c) * (v - c) for v, c in zip(values, centre, strict=True)]), F.lit(math.inf))


def _place(values: list[Column], centres: dict[int, list[float]], names: dict[int, int], node: int = 1) -> Column:
    """The name of the node a row ends in, going from the top to the nearer of two parts 2i and 2i + 1; null without a name."""
    parts = [p for p in (2 * node, 2 * node + 1) if p in centres]
    if not parts:
        return F.lit(names.get(node)).cast("int")
    below = [_place(values, centres, names, p) for p in parts]
    left, right = [_apart(values, [F.lit(x) for x in centres[p]]) for p in (parts[0], parts[-1])]
    return F.when(right < left, below[-1]).otherwise(below[0])


def bisecting_kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 42, label: str = "cluster") -> DataFrame:
    """Rows with their cluster from repeated two-way splits; rows with a null or NaN in a column are left out.

    Level by level every cluster is split, or those of the most rows where fewer splits are left: two centres a step from
    its own, then SPLIT_ROUNDS rounds of means. Spark ML has the same method, but keeps every row as an object and, given
    weights, takes the clusters of the most points for the largest; here rounds are aggregations over weighted points. The
    step is in proportion to the norm of a centre, and standardised data has a centre at the origin, which would never
    split: the copy that is fitted is moved away from it, which changes no distance.
    """
    cells = [F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    limits = [f(c).alias(f"{n}{i}") for i, c in enumerate(cells) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    range_ = df.agg(F.struct(*limits).alias("limits")).scalar()
    moved = [c + range_.getField(f"hi{i}") - 2 * range_.getField(f"lo{i}") for i, c in enumerate(cells)]
    points = _weighted(df, moved)
    values, draw = [F.col(c) for c in points.columns[:-1]], _uniform(seed)

    def summed(part: Column, rows: DataFrame) -> dict[int, tuple[float, int, list[float]]]:
        """Per part its rows, its points and its centre."""
        sums = [F.sum("__w"), F.count(F.lit(1)), *[F.sum(v * F.col("__w")) for v in values]]
        return {r[0]: (r[1], r[2], [x / r[1] for x in r[3:]]) for r in rows.groupBy(part.alias("__part")).agg(*sums).collect()}

    active, centres, needed = summed(F.lit(1), points), {}, k - 1
    while needed > 0 and (able := sorted(n for n, (_, some, _) in active.items() if some > 1)):
        if len(able) > needed:
            able = sorted(able, key=lambda n: -active[n][0])[:needed]
        split, rows = {}, points.withColumn("__at", _place(values, centres, {n: i for i, n in enumerate(able)})).where("__at is not null")
        for n in able:
            middle = active[n][2]
            step = [SPLIT_STEP * math.hypot(*middle) * next(draw) for _ in middle]
            split[2 * n], split[2 * n + 1] = ([m + sign * s for m, s in zip(middle, step, strict=True)] for sign in (-1, 1))
        for _ in range(SPLIT_ROUNDS):
            left, right = [
                [F.get(F.array(*[F.lit(split[2 * n + side][i] if 2 * n + side in split else None).cast("double") for n in able]), F.col("__at"))
                 for i in range(len(values))] for side in (0, 1)
            ]
            found = summed(2 * F.col("__at") + F.when(_apart(values, right) < _apart(values, left), 1).otherwise(0), rows)
            active = {2 * able[p // 2] + p % 2: some for p, some in found.items()}
            before, split = split, {n: some[2] for n, some in active.items()}
            if split == before:
                break
        centres |= split
        needed -= len(able)
    parts = {n // 2 for n in centres}
    leaves = sorted({1, *centres} - parts, key=lambda n: bin(n)[3:])
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in cells])
    return df.where(present).withColumn(label, _place(moved, centres, {n: i for i, n in enumerate(leaves)}).cast("bigint"))


def _pair_blocks(
    df: DataFrame, key: str, rows: int, work: Callable, schema: str, block_rows: int = BLOCK_POINTS, half: bool = False
) -> DataFrame:
    """Run ``work(left, right)`` for every pair of row blocks; each task sees two blocks, never the table.

    With ``half``, two different blocks meet once, and ``work`` gets their numbers (i <= j) before them.
    """
    count = max(1, math.ceil(rows / block_rows))
    numbered = df.withColumn("__own", F.pmod(F.xxhash64(quoted(key)), F.lit(count)).cast("int"))
    own, first, last = F.col("__own"), F.lit(0), F.lit(count - 1)
    left = numbered.withColumn("__i", own).withColumn("__j", F.explode(F.sequence(own if half else first, last)))
    right = numbered.withColumn("__j", own).withColumn("__i", F.explode(F.sequence(first, own if half else last)))
    return left.groupBy("__i", "__j").cogroup(right.groupBy("__i", "__j")).applyInPandas(work, schema)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b.

    With many columns by one matrix product; it loses digits where two rows are close, so those pairs are measured by their
    differences, as all pairs are if they are many or a number is not finite.
    """
    if a.shape[1] >= PRODUCT_COLUMNS and len(a) and len(b):
        centre = b.mean(0)
        p, q = a - centre, b - centre
        pp, qq = np.einsum("ij,ij->i", p, p), np.einsum("ij,ij->i", q, q)
        largest = pp.max() + qq.max()
        if np.isfinite(largest):
            total = p @ q.T
            total *= -2
            total += pp[:, None]
            total += qq
            close = total <= CLOSE * largest
            many = np.count_nonzero(close)
            if many * 16 <= total.size:
                if many:
                    i, j = np.nonzero(close)
                    for at in range(0, many, 1 << 16):
                        i_, j_ = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
                        total[i_, j_] = ((a[i_] - b[j_]) ** 2).sum(1)
                return np.sqrt(total, out=total)
    total = np.zeros((len(a), len(b)))
    for column in range(a.shape[1]):
        total += (a[:, column, None] - b[None, :, column]) ** 2
    return np.sqrt(total)


def _summed_distances(target: pd.DataFrame, source: pd.DataFrame, names: list[str], both: bool) -> list[pd.DataFrame]:
    """(k, c, other, total): of each target row, the distances to the rows of every cluster of the source; ``both``: and the other way round."""
    sides = []
    for pdf in (target, source):
        clusters, code = np.unique(pdf["c"].to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        sides.append((pdf["k"].to_numpy()[order], clusters, code[order], np.ascontiguousarray(pdf[names].to_numpy(dtype=float)[order])))
    (keys, clusters, code, points), (other_keys, other_clusters, other_code, other_points) = sides
    there, back = np.zeros((len(keys), len(other_clusters))), np.zeros((len(other_keys), len(clusters)))
    for s in range(0, len(points), 512):
        own = np.unique(code[s:s + 512], return_index=True)
        for t in range(0, len(other_points), 2048):
            near = _distances(points[s:s + 512], other_points[t:t + 2048])
            others = np.unique(other_code[t:t + 2048], return_index=True)
            there[s:s + 512, others[0]] += np.add.reduceat(near, others[1], axis=1)
            if both:
                back[t:t + 2048, own[0]] += np.add.reduceat(near, own[1], axis=0).T
    out = [(keys, clusters[code], other_clusters, there)] + [(other_keys, other_clusters[other_code], clusters, back)] * bool(both)
    return [pd.DataFrame({
        "k": np.repeat(k, len(to)), "c": np.repeat(c, len(to)), "other": np.tile(to, len(k)), "total": table.ravel(),
    }) for k, c, to, table in out]


def _squared_distance(a: list[Column], b: list[Column]) -> Column:
    """Generated code for a few dimensions, one array expression for many (one method cannot hold them all)."""
    if len(a) <= 8:
        return reduce(lambda x, y: x + y, [(p - q) ** 2 for p, q in zip(a, b)])
    steps = F.zip_with(F.array(*a), F.array(*b), lambda p, q: (p - q) * (p - q))
    return F.aggregate(steps, F.lit(0.0), lambda total, step: total + step)


def silhouette_samples(
    labelled: DataFrame, columns: list[str], key: str, label: str = "cluster", block_rows: int = BLOCK_POINTS
) -> DataFrame:
    """Exact Euclidean silhouette per row: (key, label, silhouette). The work is quadratic and distributed."""
    names = [f"x{i}" for i in range(len(columns))]
    data = labelled.select(
        quoted(key).alias("k"), quoted(label).alias("c"), *[quoted(c).cast("double").alias(n) for c, n in zip(columns, names)]
    )
    kinds = {f.name: f.dataType.simpleString() for f in data.schema}

    def work(blocks: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_summed_distances(left, right, names, both=blocks[0] != blocks[1]))

    schema = f"k {kinds['k']}, c {kinds['c']}, other {kinds['c']}, total double"
    rows = data.count()
    width = max(block_rows, min(math.ceil(rows / BLOCKS), MOST_POINTS))
    sums = _pair_blocks(data, "k", rows, work, schema, width, half=True).groupBy("k", "c", "other").agg(F.sum("total").alias("total"))
    sizes = data.groupBy(F.col("c").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    return _silhouettes(sums, sizes).select(F.col("k").alias(key), F.col("c").alias(label), "silhouette")


def _silhouettes(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """(k, c, silhouette) from the summed distances (k, c, other, total) of a row to every cluster of n rows (other, n)."""
    same = F.col("c") == F.col("other")
    mean = F.col("total") / F.nullif(F.when(same, F.col("n") - 1).otherwise(F.col("n")), F.lit(0))
    sides = sums.join(sizes, "other").groupBy("k", "c").agg(
        F.max(F.when(same, mean)).alias("a"), F.min(F.when(~same, mean)).alias("b")
    )
    value = (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))
    return sides.select("k", "c", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


#: Rows of the sample, and rows whose sums travel together.
TARGETS, TARGET_CHUNK = 4096, 512


def silhouette_estimate(
    labelled: DataFrame, columns: list[str], key: str, label: str = "cluster", targets: int = TARGETS, seed: int = 42,
    z: float = 1.959964,
) -> DataFrame:
    """Mean Euclidean silhouette with its error, linear in the rows: (silhouette, error, low, high, sampled, rows).

    A sampling operator: each cluster gives an equal share of at most ``targets`` rows, drawn by a seeded digest of the key.
    The silhouette of a drawn row is exact, against all rows; only the mean over rows is estimated, cluster by cluster, and
    ``error`` is its standard error (0 when every row was drawn, and the result is the exact mean); low and high lie
    ``z`` errors off. A cluster that is sampled by one row has no error to tell and gives null. The drawn rows go to all
    tasks, at most ``targets`` of them; more clusters than half of that are refused. Rows with a null label or coordinate
    are left out.
    """
    names = [f"x{i}" for i in range(len(columns))]
    data = labelled.select(
        quoted(key).alias("k"), quoted(label).alias("c"), *[quoted(c).cast("double").alias(n) for c, n in zip(columns, names)]
    )
    # A test per column: the optimizer takes one test of many columns apart in exponentially many ways.
    data = data.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in ["c", *names]]))
    sizes = written(data.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    clusters = sizes.count()
    if clusters * 2 > targets:
        raise ValueError(f"{clusters} clusters need at least {2 * clusters} targets; use silhouette_squared")
    drawn = sample_per_group(data, "c", "k", targets // max(clusters, 1), seed).toPandas() if clusters else data.limit(0).toPandas()
    points = drawn[names].to_numpy(dtype=float)
    chunks = range(0, len(points), TARGET_CHUNK)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for cluster, part in batch.groupby("c", sort=False):
                source = part[names].to_numpy()
                total = sums.setdefault(cluster, np.zeros(len(points)))
                for start in chunks:
                    for at in range(0, len(source), TARGET_CHUNK):
                        near = _distances(points[start:start + TARGET_CHUNK], source[at:at + TARGET_CHUNK])
                        total[start:start + TARGET_CHUNK] += near.sum(axis=1)
        for cluster, total in sums.items():
            yield pd.DataFrame({
                "other": [cluster] * len(chunks), "chunk": list(chunks), "totals": [total[s:s + TARGET_CHUNK] for s in chunks],
            })

    def add(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """One row per task comes in."""
        total = np.sum(np.stack(pdf["totals"].to_numpy()), axis=0)
        return pd.DataFrame({"other": key_[0], "t": key_[1] + np.arange(len(total)), "total": total})

    kind = data.schema["c"].dataType.simpleString()
    spark = labelled.sparkSession
    sums = data.mapInPandas(measure, f"other {kind}, chunk int, totals array<double>").groupBy("other", "chunk").applyInPandas(
        add, f"other {kind}, t int, total double"
    )
    labels = pd.DataFrame({"k": np.arange(len(drawn), dtype="int32"), "c": drawn["c"]})
    chosen = spark.createDataFrame(labels, f"k int, c {kind}")
    rows = _silhouettes(sums.join(F.broadcast(chosen), F.col("t") == F.col("k")), sizes.withColumnRenamed("c", "other"))
    strata = rows.groupBy("c").agg(
        F.count(F.lit(1)).alias("m"), F.avg("silhouette").alias("mean"), F.var_samp("silhouette").alias("variance")
    ).join(sizes, "c")
    variance = F.when(F.col("m") == F.col("n"), 0.0).otherwise(F.col("n") * (F.col("n") - F.col("m")) * F.col("variance") / F.col("m"))
    unknown = F.max(F.isnull(variance))
    whole = strata.agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("silhouette"),
        F.when(~unknown, F.sqrt(F.sum(variance)) / F.sum("n")).alias("error"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("sampled"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    )
    reach = F.lit(z) * F.col("error")
    return whole.select(
        "silhouette", "error", (F.col("silhouette") - reach).alias("low"), (F.col("silhouette") + reach).alias("high"), "sampled", "rows"
    )


def silhouette_squared(labelled: DataFrame, columns: list[str], label: str = "cluster") -> float:
    """Mean silhouette on squared distances, linear in the rows."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    data = _assembled(labelled.withColumn("__c", quoted(label).cast("double")), columns)
    return float(ClusteringEvaluator(featuresCol="__x", predictionCol="__c").evaluate(data))


def centre_indices(labelled: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    """One row: rows, clusters, Calinski–Harabasz and Davies–Bouldin; two passes over the rows, any size."""
    names = [f"x{i}" for i in range(len(columns))]
    data = labelled.select(quoted(label).alias("c"), *[quoted(c).cast("double").alias(n) for c, n in zip(columns, names)])
    centres = data.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m{n}") for n in names])
    square = _squared_distance([F.col(n) for n in names], [F.col(f"m{n}") for n in names])
    away = data.join(broadcast_if_small(centres), "c").select("c", "n", square.alias("q"))
    radii = away.groupBy("c").agg(F.sum("q").alias("within"), F.avg(F.sqrt("q")).alias("radius"))
    spread = cut_lineage(centres.join(radii, "c"))
    k = spread.count()

    def worst(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        centre = [f"m{n}" for n in names]
        apart = _distances(left[centre].to_numpy(), right[centre].to_numpy())
        other = left["c"].to_numpy()[:, None] != right["c"].to_numpy()[None, :]
        radii = left["radius"].to_numpy()[:, None] + right["radius"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(other & (apart > 0), radii / apart, 0.0)
        return pd.DataFrame({"c": left["c"].to_numpy(), "worst": value.max(axis=1, initial=0.0)})

    kind = spread.schema["c"].dataType.simpleString()
    blocks = _pair_blocks(spread.select("c", "radius", *[f"m{n}" for n in names]), "c", k, worst, f"c {kind}, worst double")
    ratio = blocks.groupBy("c").agg(F.max("worst").alias("worst")).agg(F.avg("worst").alias("davies_bouldin")).scalar()
    # Per dimension: sum of n·(centre − grand mean)², from one row per cluster and dimension.
    cells = F.array(*[F.struct(F.lit(i).alias("d"), F.col(f"m{n}").alias("m")) for i, n in enumerate(names)])
    whole = Window.partitionBy("d")
    grand = F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole)
    per_dimension = spread.select("n", F.inline(cells)).withColumn("grand", grand).groupBy("d").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between")
    )
    between = per_dimension.agg(F.sum("between").alias("between")).scalar()
    sums = spread.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"), F.sum("within").alias("within"))
    sums = sums.withColumn("between", between)
    per_cluster = F.col("between") / F.nullif(F.col("clusters") - 1, F.lit(0))
    per_row = F.col("within") / F.nullif(F.col("n") - F.col("clusters"), F.lit(0))
    return sums.select(
        "n", "clusters",
        F.when(F.col("within") == 0, 1.0).otherwise(per_cluster / F.nullif(per_row, F.lit(0.0))).alias("calinski_harabasz"),
        ratio.alias("davies_bouldin"),
    )


# Fixed values of the score: the divisor under the squashed index, and equal weights of the three parts.
def combine_scores(silhouette: float, calinski_harabasz: float, davies_bouldin: float) -> float:
    """Mean of the silhouette and the two squashed indices."""
    tightness = math.tanh(1.0 / davies_bouldin) if 0 < davies_bouldin < math.inf else 0.0
    return (silhouette + math.tanh(calinski_harabasz / 10000.0) + tightness) / 3.0


def validity(
    labelled: DataFrame, columns: list[str], key: str, label: str = "cluster", distance: str = "euclidean"
) -> dict[str, float]:
    """Combined validity of a labelling, noise left out; −inf with fewer than two clusters.

    ``distance="squared"`` takes the silhouette on squared distances, which is linear in the rows.
    """
    kept = labelled.where(quoted(label) != NOISE)
    shape = kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(quoted(label)).alias("k")).first()
    out = {"n": shape["n"], "clusters": shape["k"]}
    if shape["k"] < 2 or shape["n"] < 2:
        return {**out, "silhouette": math.nan, "calinski_harabasz": math.nan, "davies_bouldin": math.nan, "score": -math.inf}
    if shape["k"] >= shape["n"]:
        parts = (-1.0, 0.0, math.inf)
    else:
        row = centre_indices(kept, columns, label).first()
        if distance == "euclidean":
            s = silhouette_samples(kept, columns, key, label).agg(F.avg("silhouette")).first()[0]
        else:
            s = silhouette_squared(kept, columns, label)
        parts = (float(s), float(row["calinski_harabasz"]), float(row["davies_bouldin"]))
    return {**out, **dict(zip(["silhouette", "calinski_harabasz", "davies_bouldin"], parts)), "score": combine_scores(*parts)}


@dataclass
class Selection:
    """Outcome of a model search; without a valid model there are no labels and the score is −inf."""

    trials: DataFrame | None
    labelled: DataFrame | None
    algorithm: str | None = None
    config: dict = field(default_factory=dict)
    score: float = -math.inf


# Fixed values of the search: cluster limits here, ranges of eps, minimum samples and distances below.
def cluster_limit(rows: int, given: int | None = None) -> int:
    """Exclusive upper bound for the number of clusters: half the rows plus one, at most 21, at least 4."""
    return max(4, given if given is not None else min(21, int(rows * 0.5) + 1))


def _candidates(rows: int, dimensions: int, trials: int, seed: int, max_clusters: int | None) -> list[tuple[str, dict]]:
    """Seeded draws from the search spaces, without repeats."""
    draw = random.Random(seed)
    ks = [k for k in range(3, cluster_limit(rows, max_clusters)) if 2 <= k < rows]
    out: list[tuple[str, dict]] = []
    for algorithm in ("kmeans", "bisecting"):
        for k in sorted(draw.sample(ks, min(trials, len(ks)))):
            out.append((algorithm, {"k": k}))
    if dimensions <= MAX_DIMENSIONS:
        for _ in range(trials):
            out.append(("density", {"eps": draw.uniform(0.1, 2.0), "min_samples": draw.randrange(2, 20)}))
        for _ in range(trials):
            out.append(("single linkage", {"distance": draw.uniform(0.1, 2.0)}))
    return out


def auto_cluster(
    df: DataFrame,
    columns: list[str],
    key: str,
    trials: int = 50,
    seed: int = 42,
    max_clusters: int | None = None,
    distance: str = "squared",
    parallel: int = 4,
) -> Selection:
    """Search K-means, bisecting K-means, density clustering and single linkage on standardised columns.

    The features are computed once and checkpointed; trials run as Spark jobs from a small thread pool. Models are
    compared by squared distances, which are linear in the rows; ``distance="euclidean"`` is quadratic. Density methods
    need at most three columns; beyond that ``trials`` names them without a score. ``labelled`` is the input with the
    cluster of the best model.
    """
    scaled_names = [f"{c}_z" for c in columns]
    rows = df.na.drop(subset=columns)
    features = cut_lineage(standardize(rows, columns).select(quoted(key), *[quoted(c) for c in scaled_names]))
    n = features.count()
    if n == 0:
        return Selection(None, None)

    def label(algorithm: str, config: dict) -> DataFrame:
        if algorithm == "kmeans":
            return kmeans(features, scaled_names, config["k"], seed)
        if algorithm == "bisecting":
            return bisecting_kmeans(features, scaled_names, config["k"], seed)
        if algorithm == "density":
            found = dbscan(features, scaled_names, key, config["eps"], config["min_samples"])
        else:
            found = single_linkage(features, scaled_names, key, config["distance"])
        return features.join(found.drop("is_core"), key)

    def run(candidate: tuple[str, dict]) -> tuple[str, dict, float]:
        labelled = cut_lineage(label(*candidate))
        return (*candidate, validity(labelled, scaled_names, key, distance=distance)["score"])

    with ThreadPoolExecutor(parallel) as pool:
        results = list(pool.map(run, _candidates(n, len(columns), trials, seed, max_clusters)))
    left_out = [] if len(columns) <= MAX_DIMENSIONS else ["density", "single linkage"]
    table = df.sparkSession.createDataFrame(
        [(i, a, {k: float(v) for k, v in c.items()}, float(s)) for i, (a, c, s) in enumerate(results)]
        + [(len(results) + i, a, {}, None) for i, a in enumerate(left_out)],
        "trial int, algorithm string, config map<string,double>, score double",
    )
    valid = [r for r in results if math.isfinite(r[2])]
    if not valid:
        return Selection(table, None)
    algorithm, config, score = max(valid, key=lambda r: r[2])
    labels = label(algorithm, config).select(quoted(key), "cluster")
    return Selection(table, df.join(labels, key), algorithm, config, score)
