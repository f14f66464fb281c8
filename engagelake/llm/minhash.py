"""Near-duplicate documents: fast similarity sketches of word shingles, banding, exact verification.

The sketch throws every element of a set into hashed bins, round after round, until each bin is filled; after as many
rounds as bins, each further round fills one bin from all elements. The earliest and smallest value of a bin counts, so
every coordinate is filled, and the share of equal coordinates of two sketches is close to the similarity of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engagelake.llm.common import in_blocks, query, read, stored
from engagelake.llm.shingles import exact_shingles, mixed, set_digests, shingle_sets, slices
from engagelake.operators.components import connected_components

#: Bands and rows of a band: a pair at 0.8 shares no band with the chance (1 - 0.8^5)^40 = 1e-7.
BANDS, ROWS = 40, 5
SIMILARITY, WORDS = 80, 5
#: Share of equal coordinates below which a pair is not compared: 0.8 less over six standard deviations.
LEAST_SHARE = 0.62
BLOCK_ROWS = 512
#: Shingles that a worker holds before it forgets the sets it has built.
HELD = 300_000
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
SKETCH_SCHEMA = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary"


def sketches(hashes: np.ndarray, rows: np.ndarray, number: int, size: int) -> np.ndarray:
    """The sketch of each of ``number`` sets, ``size`` coordinates; sets without elements stay EMPTY."""
    out = np.full((number, size), EMPTY)
    flat = out.reshape(-1)
    low = np.uint64((1 << 40) - 1)
    h, at = hashes, rows
    for turn in range(size):
        if not len(h):
            return out
        m = mixed(h, turn + 1)
        place = ((m >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        np.minimum.at(flat, at * size + place.astype(np.int64), (np.uint64(turn) << np.uint64(40)) | (mixed(m) & low))
        here = np.unique(at)
        open_rows = here[(out[here] == EMPTY).any(1)]
        still = np.zeros(number, bool)
        still[open_rows] = True
        keep = still[at]
        h, at = h[keep], at[keep]
    for place in range(size):
        if not len(h):
            return out
        need = out[at, place] == EMPTY
        if need.any():
            m = mixed(mixed(h[need], size + place + 1)) & low
            np.minimum.at(flat, at[need] * size + place, (np.uint64(size + place) << np.uint64(40)) | m)
    return out


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands, sig): set size, digest of the set, band keys, low bytes of the sketch."""
    size = BANDS * ROWS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for first, data, offsets in slices(texts):
                rows = len(offsets) - 1
                h, at, sizes, whole = shingle_sets(data, offsets, words)
                digests = set_digests(at, whole, rows)
                s = sketches(h, at, rows, size)
                keys = np.zeros((rows, BANDS), np.uint64)
                for k in range(ROWS):
                    keys = mixed(keys + s[:, k::ROWS], k)
                keys = mixed(keys ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                sig = pa.array([r.tobytes() for r in (s & np.uint64(255)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, rows), pa.array(sizes.astype(np.int64)), *map(pa.array, digests), keys, sig],
                    [c.split()[0] for c in SKETCH_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SKETCH_SCHEMA)


def _forest(a: np.ndarray, b: np.ndarray, rows: int, check=None) -> list[tuple[int, int]]:
    """Edges (a, b), in the given order, that join two sets so far apart and pass ``check``."""
    root = list(range(rows))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q and (check is None or check(i, j)):
            root[p] = q
            out.append((i, j))
    return out


def _likely(part: pd.DataFrame, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose sketches and sizes allow ``similarity``, the most alike first; between blocks in a pair of them."""
    sig = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(part), -1)
    n, side, pair = part["n_shingles"].to_numpy(), part["own"].to_numpy(), bool(part["pair"].to_numpy()[0])
    a, b, shares = [], [], []
    for i in range(len(part) - 1):
        at = np.arange(i + 1, len(part))
        at = at[100 * np.minimum(n[at], n[i]) >= similarity * np.maximum(n[at], n[i])]
        at = at[side[at] != side[i]] if pair else at
        share = (sig[at] == sig[i]).mean(1)
        keep = share >= LEAST_SHARE
        a.append(np.full(keep.sum(), i))
        b.append(at[keep])
        shares.append(share[keep])
    if not a:
        return np.zeros(0, int), np.zeros(0, int)
    order = np.argsort(-np.concatenate(shares), kind="stable")
    return np.concatenate(a)[order], np.concatenate(b)[order]


def likely_links(keys: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """(a, b): for members of one band key whose sketches are alike, enough pairs to span every set of them.

    Keys are compared in blocks; a block gives fewer pairs than it has rows.
    """
    shared = keys.where(F.col("size") <= BLOCK_ROWS).count()
    rows = in_blocks(keys.join(nodes.select("doc_id", "n_shingles", "sig"), "doc_id"), "key", "size", "doc_id", BLOCK_ROWS, shared)

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_id"], ignore_index=True)
        ids, cuts = pdf["doc_id"].to_numpy(), np.flatnonzero(np.diff(pdf["key"].to_numpy())) + 1
        out = []
        for low, high in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            a, b = _likely(pdf.iloc[low:high], similarity)
            out += [(ids[low + i], ids[low + j]) for i, j in _forest(a, b, high - low)]
        return pd.DataFrame(out, columns=["a", "b"])

    columns = ["key", "doc_id", "n_shingles", "sig", "own", "pair", "grp"]
    return rows.select(*columns).groupBy("grp").applyInPandas(look, "a long, b long").distinct()


def verified_links(families: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """(a, b): links inside the families (node, component), confirmed on the full sets of words.

    Every pair of a family whose sketches allow a link is settled: it is compared word by word, or both ends are linked
    already. Families are compared in blocks, and a block gives fewer pairs than it has rows.
    """
    families = families.select(F.col("node").alias("doc_id"), "component")
    ids = stored(families.select(F.col("doc_id").alias("id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id"])
    sizes = stored(families.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    shared = sizes.where(F.col("size") <= BLOCK_ROWS).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows = families.join(sizes, "component").join(nodes.select("doc_id", "n_shingles", "sig"), "doc_id").join(texts, "doc_id")
    rows = in_blocks(rows, "component", "size", "doc_id", BLOCK_ROWS, shared)

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["component", "doc_id"], ignore_index=True)
        ids, texts, cuts = pdf["doc_id"].to_numpy(), list(pdf["text"]), np.flatnonzero(np.diff(pdf["component"].to_numpy())) + 1
        out = []
        for low, high in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            sets: dict[int, set] = {}

            def shingles(i, low=low, sets=sets):
                if i not in sets:
                    if sum(map(len, sets.values())) > HELD:
                        sets.clear()
                    sets[i] = exact_shingles(texts[low + i], words)
                return sets[i]

            def linked(i, j, shingles=shingles):
                one, other = shingles(i), shingles(j)
                common = len(one & other)
                return 100 * common >= similarity * (len(one) + len(other) - common)

            a, b = _likely(pdf.iloc[low:high], similarity)
            out += [(ids[low + i], ids[low + j]) for i, j in _forest(a, b, high - low, linked)]
        return pd.DataFrame(out, columns=["a", "b"])

    columns = ["component", "doc_id", "n_shingles", "sig", "text", "own", "pair", "grp"]
    return rows.select(*columns).groupBy("grp").applyInPandas(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    Sets that are equal are one node: their digests have 128 bits, of hashes with 128 bits of the words. Nodes that share a band key and have sketches alike form families; inside a family
    every link is settled on the full sets, block by block, so no link is lost and no group is written as pairs.
    Null, empty and blank texts have no shingles and link with nothing. Rows without an id have a null component and are
    kept. Rows that repeat an id are one document.
    """
    rows = stored(sketch(docs, words), "sketches")
    usable = rows.where("doc_id is not null and n_shingles > 0")
    classes = stored(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    copies = stored(classes.where("copies > 1").select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), "node"), "copies")
    same = (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2"))
    nodes = stored(usable.join(copies, same, "left").where(F.coalesce(F.col("node") == F.col("doc_id"), F.lit(True))).select(
        "doc_id", "n_shingles", "bands", "sig"), "nodes")
    keyed = nodes.select("doc_id", F.explode("bands").alias("key"))
    several = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("key", "__key"), "several")
    keys = stored(keyed.join(several, F.col("key") == F.col("__key")).select("key", "size", "doc_id"), "keys")
    likely = stored(likely_links(keys, nodes, similarity), "likely")
    ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    families = stored(connected_components(ends, likely), "families")
    links = stored(verified_links(families, nodes, docs, words, similarity), "links")
    component = connected_components(families.select("node"), links)
    found = component.where("node <> component").select(F.col("node").alias("__node"), "component")
    # Only documents with a copy or a link need looking up.
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(copies, same & (F.col("n_shingles") > 0), "left")
    out = out.withColumn("node", F.coalesce("node", "doc_id")).select("doc_id", "n_shingles", "node")
    out = out.join(stored(found, "found"), F.col("node") == F.col("__node"), "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"))


@query("op2_minhash_dedup")
def _minhash_dedup(spark, folder):
    """All documents with the component of near duplicates they are in, on shingles of two words."""
    return near_duplicates(read(spark, folder, "documents"), words=2)
