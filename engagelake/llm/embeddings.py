"""Embedding near-dedup by sorted projection passes.

Every pass orders the distinct vectors of a label lexicographically by the concatenated signs of their projections on random
directions, and compares each with its WINDOW followers, across the seams of partitions too. What moves are bytes per
component with their exact error: most pairs are decided by them, the others by the vectors. Links found in any pass are
united; links are then counted exactly inside each component, in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engagelake.llm.common import in_blocks, query, read, stored
from engagelake.operators.components import connected_components

COSINE = 0.98
#: Followers a vector is compared with, sign bits of a key, and the chance to miss a link that is allowed.
WINDOW, BITS, MISS = 256, 62, 1e-4
#: Rows of a sorted partition, on average, and of a block in which links are counted.
PART_ROWS, BLOCK_ROWS = 8192, 512


def passes_for(shared: int, cosine: float = COSINE, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold is missed with a chance below ``miss``.

    A bit differs with the chance angle / pi; a pair that agrees in ``shared`` bits and one more is inside the window.
    """
    share = (1 - math.acos(min(cosine, 1.0)) / math.pi) ** (shared + 1)
    return max(1, math.ceil(math.log(miss) / math.log(max(1 - share, 1e-9))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def prepare(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, node, dim, grp, vec): the vector scaled to length 1, and a digest of label and vector as its node.

    node is null where the vector can't be linked: no id, no label, no vector, length 0, or a component that is null or
    not finite.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v, lab in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x = np.array(v if i is not None and lab is not None and v is not None and None not in v else [], np.float64)
                top = np.abs(x).max() if len(x) else 0.0
                if not (np.isfinite(top) and top > 0):
                    rows.append((i, None, 0, None, None))
                    continue
                x = x + 0.0
                group = f"{len(x)}|{lab}"
                node = hashlib.blake2b(x.tobytes() + group.encode(), digest_size=16).hexdigest()
                x = x / top  # large components would overflow in the square
                rows.append((i, node, len(x), group, (x / np.linalg.norm(x)).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["vec_id", "node", "dim", "grp", "vec"])

    narrow = df.select(F.col(key).cast("long"), F.col(vector), F.col(label).cast("string"))
    return narrow.mapInArrow(work, "vec_id long, node string, dim int, grp string, vec binary")


def _keys(x: np.ndarray, number: int, bits: int = BITS) -> np.ndarray:
    """The sort key of every row in pass ``number``: the signs of its projections, the first in the highest bit."""
    directions = np.random.default_rng(1000 + number).normal(size=(x.shape[1], bits))
    return ((x @ directions > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).astype(np.int64)


def _roots(rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of the linked set of every place."""
    root = np.arange(rows)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def shared_bits(distinct: DataFrame, window: int) -> int:
    """The median number of leading bits that a vector shares with the one ``window`` places on in the order of a pass.

    A vector without one so far on shares none. Only counts per number of bits come to the driver.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                yield pa.RecordBatch.from_arrays([part.column("grp"), pa.array(_keys(_matrix(part.column("vec"), int(dim)), 0))], ["grp", "key"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("grp", pa.string()), ("key", pa.int64())]))
        grp, key = np.asarray(table["grp"].to_pylist(), object), table["key"].to_numpy()
        bits = np.zeros(len(key), np.int64)
        if len(key) > window:
            other = key[:-window] ^ key[window:]
            length = np.zeros(len(other), np.int64)
            for k in range(BITS):  # leading bits that are equal
                length += (other >> (BITS - 1 - k)) == 0
            bits[:-window] = np.where(grp[:-window] == grp[window:], length, 0)
        found, times = np.unique(bits, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], ["bits", "n"])

    parts = max(1, math.ceil(distinct.count() / PART_ROWS))
    ordered = distinct.select("grp", "dim", "vec").mapInArrow(keys, "grp string, key long")
    ordered = ordered.repartitionByRange(parts, "grp", "key") if parts > 1 else ordered.coalesce(1)
    counts = ordered.sortWithinPartitions("grp", "key").mapInArrow(measure, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n"))
    rows = sorted((r["bits"], r["n"]) for r in counts.collect())
    half, total = sum(n for _, n in rows) / 2, 0
    for bits, n in rows:
        total += n
        if total >= half:
            return bits
    return 0


def _expand(distinct: DataFrame, passes: int) -> DataFrame:
    """Every distinct vector once per pass: its key, a byte per component, the factor of the bytes, and what they miss."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = _matrix(part.column("vec"), int(dim))
                scale = np.abs(x).max(axis=1) / 127
                small = np.rint(x / scale[:, None]).astype(np.int8)
                missed = np.linalg.norm(x - small * scale[:, None], axis=1)
                shared = [part.column("node"), part.column("dim"), pa.array([r.tobytes() for r in small], pa.binary()), pa.array(scale), pa.array(missed)]
                for number in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), number, np.int32)), part.column("grp"), pa.array(_keys(x, number)), *shared],
                        ["turn", "grp", "key", "node", "dim", "small", "scale", "missed"])

    return distinct.select("node", "grp", "dim", "vec").mapInArrow(work, ROWS)


ROWS = "turn int, grp string, key long, node string, dim int, small binary, scale double, missed double"
FOUND = f"a string, b string, sure boolean, seam int, side int, {ROWS}"


def compared(rows: pd.DataFrame, cosine: float, window: int, side: np.ndarray | None = None) -> list[tuple[str, str, bool]]:
    """(a, b, sure) for sorted rows, each with its ``window`` followers of the same turn and group.

    The bytes give the cosine but for what they miss. Sure links come as a span of every set they link; pairs that may be
    links come where no sure link joins their ends. With ``side``, only pairs of different sides count.
    """
    out: list[tuple[str, str, bool]] = []
    turn, grp, nodes = rows["turn"].to_numpy(), rows["grp"].to_numpy(), rows["node"].to_numpy()
    heads = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (grp[1:] != grp[:-1])])) if len(rows) else []
    for low, high in zip(heads, [*heads[1:], len(rows)], strict=True):
        x = np.frombuffer(b"".join(rows["small"].iloc[low:high]), np.int8).reshape(high - low, -1) * rows["scale"].to_numpy()[low:high, None]
        missed, sure, maybe = rows["missed"].to_numpy()[low:high], [], []
        for i in range(0, high - low, 128):
            some = slice(i, min(i + 128 + window, high - low))
            dots = x[i:i + 128] @ x[some].T
            e, f = missed[i:i + 128, None], missed[None, some]
            margin = e + f + e * f + 1e-12
            gap = np.arange(dots.shape[1])[None, :] - np.arange(dots.shape[0])[:, None]
            near = (gap > 0) & (gap <= window) & (dots >= cosine - margin)
            if side is not None:
                near &= side[low + i:low + i + dots.shape[0], None] != side[None, low + i:low + i + dots.shape[1]]
            certain = near & (dots >= cosine + margin)
            sure.append(np.stack(np.nonzero(certain)) + i)
            maybe.append(np.stack(np.nonzero(near & ~certain)) + i)
        root = _roots(high - low, *np.concatenate(sure, axis=1))
        out += [(nodes[low + r], nodes[low + i], True) for i, r in enumerate(root.tolist()) if r != i]
        a, b = np.concatenate(maybe, axis=1)
        apart = root[a] != root[b]
        out += [(nodes[low + i], nodes[low + j], False) for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True)]
    return out


def window_links(distinct: DataFrame, passes: int, cosine: float = COSINE, window: int = WINDOW, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b): links between neighbours in the order of any pass, enough of them to span every linked set.

    The order of a pass is cut into ranges; equal keys are ordered by the digest of the vector, so no range grows with
    them. The last and the first ``window`` rows of neighbour ranges meet once more at their seam.
    """
    parts = max(1, math.ceil(distinct.count() * passes / part_rows))
    order = ["turn", "grp", "key", "node"]
    rows = _expand(distinct, passes)
    ranged = (rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)).sortWithinPartitions(*order)
    names, blank = [c.split()[0] for c in FOUND.split(", ")], [None] * 8

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        pdf = pd.concat([b for b in batches if len(b)] or [pd.DataFrame()], ignore_index=True)
        if not len(pdf):
            return
        out = [(a, b, sure, None, None, *blank) for a, b, sure in compared(pdf, cosine, window)]
        for seam, side, some in ((part, 0, pdf.iloc[-window:]), (part - 1, 1, pdf.iloc[:window])):
            if 0 <= seam < parts - 1:
                out += [(None, None, None, seam, side, *r) for r in some.itertuples(index=False, name=None)]
        yield pd.DataFrame(out, columns=names).astype({"seam": "Int32", "side": "Int32", "turn": "Int32", "dim": "Int32", "key": "Int64"})

    found = stored(ranged.mapInPandas(look, FOUND), "windows")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", *order], ignore_index=True)
        return pd.DataFrame(compared(pdf, cosine, window, pdf["side"].to_numpy()), columns=["a", "b", "sure"])

    seams = found.where("seam is not null").groupBy("seam").applyInPandas(meet, "a string, b string, sure boolean")
    pairs = stored(found.where("seam is null").select("a", "b", "sure").union(seams).distinct(), "pairs")
    doubtful = pairs.where("not sure").select("a", "b")
    for end in "ab":
        doubtful = doubtful.join(distinct.select(F.col("node").alias(end), F.col("vec").alias(f"v{end}")), end)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)
            linked = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) >= cosine for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(linked, pa.bool_())) for c in "ab"], ["a", "b"])

    return pairs.where("sure").select("a", "b").union(doubtful.select("a", "b", "va", "vb").mapInArrow(verify, "a string, b string"))


def _counted(members: DataFrame, cosine: float, block: int = BLOCK_ROWS) -> DataFrame:
    """(node, links): for members (node, component, copies, dim, vec), the copies of all other members within reach.

    A component above ``block`` rows is cut into blocks and each pair of blocks is a group; small components share
    groups. A group holds some thousand rows at most, and gives one count per row, never pairs.
    """
    sizes = stored(members.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    shared = sizes.where(F.col("size") <= block).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    rows = in_blocks(members.join(sizes, "component"), "component", "size", "node", block, shared)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in pdf.groupby("dim"):
            x = np.frombuffer(b"".join(part["vec"]), np.float64).reshape(-1, int(dim))
            comp = np.unique(part["component"], return_inverse=True)[1]
            side, pair = part["own"].to_numpy(), part["component"].nunique() == 1 and bool(part["pair"].any())
            copies, links = part["copies"].to_numpy(), np.zeros(len(part), np.int64)
            for low in range(0, len(part), block):
                rows = slice(low, low + block)
                near = (x[rows] @ x.T >= cosine) & (comp[rows, None] == comp[None, :])
                if pair:  # within a block is counted in the block's own group
                    near &= side[rows, None] != side[None, :]
                near[np.arange(near.shape[0]), low + np.arange(near.shape[0])] = False
                links[rows] = near @ copies
            out.append(pd.DataFrame({"node": part["node"].to_numpy(), "links": links}))
        return pd.concat(out)

    columns = ["node", "component", "copies", "dim", "vec", "own", "pair", "grp"]
    counted = rows.select(*columns).groupBy("grp").applyInPandas(count, "node string, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE, window: int = WINDOW, miss: float = MISS, part_rows: int = PART_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows are compared where labels and dimensions are equal and not null. Vectors that are null, of length 0, or hold
    null or non-finite components, and rows without an id, link with nothing; the latter have a null component and are
    kept. Equal vectors are one node with a number of copies, so a large group of copies costs no more than one.
    n_links counts rows, so a repeated row links with its repetition.
    """
    rows = stored(prepare(df, key, vector, label), "vectors")
    usable = rows.where("node is not null")
    distinct = stored(usable.groupBy("node").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("grp").alias("grp"), F.first("dim").alias("dim"),
        F.first("vec").alias("vec")), "distinct")
    passes = passes_for(shared_bits(distinct, window), cosine, miss)
    edges = stored(window_links(distinct, passes, cosine, window, part_rows).distinct(), "links")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    component = stored(connected_components(ends, edges), "components")
    members = component.join(distinct.select("node", "copies", "dim", "vec", "first"), "node")
    links = _counted(members.drop("first"), cosine)
    smallest = members.groupBy("component").agg(F.min("first").alias("smallest"))
    linked = component.join(smallest, "component").join(links, "node")
    facts = stored(distinct.select("node", "first", "copies").join(linked, "node", "left").select(
        F.col("node").alias("__node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("smallest", "first").alias("component_id")), "facts")
    out = rows.select("vec_id", F.coalesce("node", F.concat(F.lit("-"), F.xxhash64("vec_id"))).alias("node"))
    out = out.join(facts, F.col("node") == F.col("__node"), "left")
    whole = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"),
                      F.coalesce(F.col("vec_id") == whole, F.lit(True)).alias("kept"))


@query("op4_embedding_dedup")
def _embedding_dedup(spark, folder):
    """All embeddings with the number of their links and the component they are in."""
    return near_duplicates(read(spark, folder, "embeddings"))
