"""Best-fit packing of documents into sequences, with conflicts between sources and between duplicates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engagelake.llm.common import query, read, words_of

#: Words a sequence holds, and pieces that are packed together on average.
CAPACITY, GROUP_ROWS = 2048, 8_000
SCHEMA = "doc_id long, piece int, words long, bin string, place int, filled long"


def bitmaps(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(word, bit, words): a bit of its own for every value that occurs twice or more; word is -1 for the others."""
    codes, counts = np.unique(values, return_inverse=True, return_counts=True)[1:]
    number = np.cumsum(counts > 1) - 1
    number = np.where(counts > 1, number, -1)[codes]
    return np.where(number < 0, -1, number // 64), np.uint64(1) << (np.maximum(number, 0) % 64).astype(np.uint64), int(number.max(initial=-1)) // 64 + 1


def best_fit(sizes: np.ndarray, conflicts: list[np.ndarray], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, bin size): every piece, largest first, into the fullest bin that has room and no conflict, or a new one.

    Bins stand in the order of their room. The search starts at the first with room enough and goes on to larger ones,
    block by block, until one's bitmaps hold neither the source nor the cluster of the piece.
    """
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    marks = [bitmaps(c) for c in conflicts]
    held = [np.zeros((n, max(words, 1)), np.uint64) for _, _, words in marks]
    room, bins = np.empty(n, np.int64), np.empty(n, np.int64)  # of the open bins, by room
    opened, number, filled = 0, np.empty(n, np.int64), np.zeros(n, np.int64)
    count = 0
    for i in order:
        size, found = sizes[i], -1
        at, step = int(np.searchsorted(room[:opened], size)), 32
        while at < opened:
            some = bins[at:min(at + step, opened)]
            free = np.ones(len(some), bool)
            for (word, bit, _), bits in zip(marks, held, strict=True):
                if word[i] >= 0:
                    free &= (bits[some, word[i]] & bit[i]) == 0
            hit = int(free.argmax())
            if free[hit]:
                found = at + hit
                break
            at, step = at + step, step * 2
        if found < 0:
            target, left = count, capacity - size
            count += 1
        else:
            target, left = bins[found], room[found] - size
            room[found:opened - 1], bins[found:opened - 1] = room[found + 1:opened].copy(), bins[found + 1:opened].copy()
            opened -= 1
        number[i] = target
        filled[target] += size
        for (word, bit, _), bits in zip(marks, held, strict=True):
            if word[i] >= 0:
                bits[target, word[i]] |= bit[i]
        if left > 0:
            place = int(np.searchsorted(room[:opened], left))
            room[place + 1:opened + 1], bins[place + 1:opened + 1] = room[place:opened].copy(), bins[place:opened].copy()
            room[place], bins[place] = left, target
            opened += 1
    return number, filled[number]


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, words, bin, place, filled) for docs (doc_id, source, cluster, size).

    A document longer than ``capacity`` is cut into full pieces and a rest. No bin holds two pieces of one source or of
    one cluster; null sources (clusters) conflict with nothing. Rows are dealt by hash into groups of about
    ``group_rows`` pieces, and each group is packed by itself: sources and clusters spread evenly over the groups, and
    what best fit loses at the edge of a group is one bin in thousands. Rows of size 0 take no room: one row each, with
    neither bin nor place. ``place`` numbers the pieces of a bin from 0; ``filled`` is the size of the bin. Equal rows
    are packed as often as they occur, and dealt by the place they are read from too, so that no group gets them all.
    """
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("cluster").cast("string"), size.alias("size"),
                       F.monotonically_increasing_id().alias("at"))
    pieces = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn(
        "words", F.least(F.col("size") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("long"))
    total = rows.count()
    groups = max(1, math.ceil(total / group_rows))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "size", "at"), F.lit(groups)).cast("int"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], ignore_index=True)
        full = pdf["words"].to_numpy() > 0
        some = pdf[full]
        # A null conflicts with nothing, so every null is a value of its own.
        own = [some[c].where(some[c].notna(), pd.Series([f"\0{i}" for i in some.index], some.index, dtype=object)).to_numpy(str) for c in ("source", "cluster")]
        number, filled = best_fit(some["words"].to_numpy(), own, capacity)
        out = pdf[["doc_id", "piece", "words"]].copy()
        out["bin"], out["place"], out["filled"] = None, None, None
        out.loc[full, "bin"] = [f"{pdf['grp'].iloc[0]}-{k}" for k in number]
        out.loc[full, "place"] = pd.Series(number).groupby(number).cumcount().to_numpy()
        out.loc[full, "filled"] = filled
        return out.astype({"place": "Int32", "filled": "Int64"})

    return rows.select("grp", "doc_id", "piece", "words", "source", "cluster").groupBy("grp").applyInPandas(work, SCHEMA)


def pack_texts(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` over documents (doc_id, text, source): words count, and equal texts are a cluster."""
    return pack(docs.select("doc_id", "source", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("cluster"), words_of(F.col("text")).alias("size")), capacity)


@query("op5_packing")
def _packing(spark, folder):
    """All documents in bins of 2048 words."""
    return pack_texts(read(spark, folder, "documents"))
