"""Suffix-array dedup: bytes covered by a long string that also starts in an earlier document are removed.

1. Every window of LENGTH bytes belongs to the smallest hashed gram in it. Runs of windows with one such gram are dealt by
   the gram; equal windows have equal grams, so windows whose gram occurs in one document alone are done with.
2. The bytes of the other runs meet in buckets of the gram; whether a gram is too common for that is settled once for all
   its runs, so equal windows still meet. Runs with the same bytes are one. Each bucket is sorted as a suffix array of the
   places that start a window, and windows whose common prefix with their neighbour reaches LENGTH belong to one string.
3. A window is removed where the string starts in a document with a smaller id.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engagelake.llm.common import query, read, stored
from engagelake.llm.shingles import mixed, slices

LENGTH = 50
#: Bytes of a gram. A window holds LENGTH - GRAM + 1 of them. Results do not depend on it: the shorter it is, the more runs have
#: a gram that other documents have by chance, and the more so the more documents there are.
GRAM = 24
#: Text bytes per part and per bucket of grams; each bucket is sorted in SUBS pieces (a power of two).
PART_BYTES, SUBS = 16 << 20, 8
#: Text bytes and rows whose runs are dealt together: every bucket gets a value from each such lot, so fewer and longer ones.
LOT_BYTES, LOT_ROWS = 8 << 20, 60_000
#: Windows in one run at most, and runs of one gram that still meet in one bucket. The windows of a more common gram are
#: dealt one by one, by their content.
RUN, COMMON = 200, 2_000
BROADCAST_IDS = 2_000_000
NOTHING = hashlib.sha256(b"").hexdigest()


# --- the suffix array -------------------------------------------------------------------------------------------------

def leading_words(data: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each position on as a number that sorts like them, up to ``more`` positions past the end."""
    padded = np.concatenate([data, np.zeros(more + 8, np.uint8)]).tobytes()
    return np.ndarray((len(data) + more,), ">u8", padded, strides=(1,)).astype(np.uint64)


def by_words(s: np.ndarray, words: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes ``s`` in the order of their first ``depth`` bytes or more.

    Eight bytes settle most. Those still tied are numbered by their group, and a number and as many further bytes as fit into
    64 bits with it are sorted at once.
    """
    s = s[np.argsort(words[s])]
    at, head, k = np.arange(len(s)), np.ones(len(s), bool), 8
    head[1:] = words[s[1:]] != words[s[:-1]]
    while k < depth:
        tied = ~(head & np.append(head[1:], True))
        at, head = at[tied], head[tied]
        if not len(at):
            break
        group = np.cumsum(head).astype(np.uint64)
        more = (64 - int(group[-1]).bit_length()) // 8
        some = s[at]
        key = (group << np.uint64(8 * more)) | (words[some + k] >> np.uint64(64 - 8 * more))
        o = np.argsort(key)
        s[at], key = some[o], key[o]
        head[1:] = key[1:] != key[:-1]
        k += more
    return s


def two_stage(data: np.ndarray, words: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes of ``data`` in the order of their first ``depth`` bytes or more.

    Stage one sorts the suffixes that are smaller than their successors, by their bytes. Stage two scans the
    buckets of the first byte in order: the suffix before a scanned one that starts with a larger byte, or continues
    a run of the bucket's byte, is larger than its successor and takes the next place of its bucket.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    turn = np.full(n, n - 1)
    differ = np.flatnonzero(data[:-1] != data[1:])
    turn[differ] = differ
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    smaller = (turn < n - 1) & (data[turn] < data[np.minimum(turn + 1, n - 1)])

    s = by_words(np.flatnonzero(smaller), words, depth)
    ends = np.concatenate([[0], np.cumsum(np.bincount(data[s], minlength=256))])
    waiting: dict[int, list[np.ndarray]] = defaultdict(list)
    waiting[int(data[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        bucket = [np.concatenate(waiting.pop(c))] if c in waiting else []
        run = bucket[0] if bucket else np.zeros(0, np.int64)
        while len(run):
            run = run[run > 0] - 1
            run = run[data[run] == c]
            bucket.append(run)
        full = np.concatenate([*bucket, s[ends[c]:ends[c + 1]]])
        if not len(full):
            continue
        out.append(full)
        before = full[full > 0] - 1
        byte = data[before]
        before, byte = before[byte > c], byte[byte > c]
        o = np.argsort(byte, kind="stable")
        before, byte = before[o], byte[o]
        cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for piece, b in zip(np.split(before, cuts), byte[np.concatenate([[0], cuts])] if len(byte) else [], strict=False):
            waiting[int(b)].append(piece)
    return np.concatenate(out)


def common_prefixes(words: np.ndarray, order: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``cap``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for k in range(0, cap, 8):
        x = words[order[at] + k] ^ words[order[at - 1] + k]
        same = np.full(len(at), 8)
        cut = np.flatnonzero(x)
        same[cut] = sum((x[cut] < np.uint64(1 << b)).astype(np.int64) for b in range(56, 0, -8))
        out[at] += same
        at = at[x == 0]
    return np.minimum(out, cap)


def repeated_windows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Positions of the windows, inside one context each, whose string also lies in a context of a smaller document.

    The last ``length - 1`` bytes of a context start no window. Two stages sort half of all suffixes to place the rest, which
    pays where most of them start windows; else only those that do are sorted.
    """
    words = leading_words(data, length + 8)
    owner = np.repeat(np.arange(len(starts)), lengths)
    window = np.arange(len(data)) <= np.repeat(starts + lengths - length, lengths)
    if 2 * np.count_nonzero(window) > len(data):
        order = two_stage(data, words, length)
        order = order[window[order]]
    else:
        order = by_words(np.flatnonzero(window), words, length)
    if not len(order):
        return order
    heads = np.flatnonzero(common_prefixes(words, order, length) < length)
    doc = docs[owner[order]]
    first = np.minimum.reduceat(doc, heads)
    return order[doc > np.repeat(first, np.diff(np.concatenate([heads, [len(order)]])))]


# --- packing ----------------------------------------------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length or another as one compressed value."""
    body = b"".join(a.tobytes() for a in arrays)
    head = struct.pack(f"<I{len(arrays)}I", len(arrays), *[a.nbytes for a in arrays])
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    sizes = struct.unpack_from(f"<{len(kinds)}I", raw, 4)
    at, out = 4 * (len(kinds) + 1), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _pieces(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of the equal keys."""
    o = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[o])) + 1
    for piece in np.split(o, cuts) if len(o) else []:
        yield int(keys[piece[0]]), piece


# --- runs of windows and their grams ----------------------------------------------------------------------------------

def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, row, first, number): runs of windows of one row that have the same smallest gram."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty, empty, empty
    size = max(8, min(GRAM, length))
    padded = np.concatenate([data, np.zeros(size, np.uint8)]).tobytes()
    w = np.ndarray((len(data) + size - 7,), "<u8", padded, strides=(1,)).copy()
    h = np.full(len(data), 0x5851F42D4C957F2D, np.uint64)
    for at in sorted({*range(0, size - 7, 8), size - 8}):
        h ^= w[at:at + len(data)]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    span, wide = length - size + 1, 1
    while 2 * wide <= span:
        h = np.minimum(h[:-wide], h[wide:])
        wide *= 2
    h = np.minimum(h[:len(h) - (span - wide)], h[span - wide:])
    stops = offsets[1:] - length + 1  # first place of a row that starts no window
    starts = np.unique(np.concatenate([np.flatnonzero(h[1:] != h[:-1]) + 1, offsets[:-1]]))
    starts = starts[starts < len(h)]
    row = np.searchsorted(offsets, starts, "right") - 1
    keep = starts < stops[row]
    starts, row = starts[keep], row[keep]
    if not len(starts):
        return empty.astype(np.uint64), empty, empty, empty
    after = np.concatenate([starts[1:], [len(h)]])
    number = np.minimum(after, stops[row]) - starts
    times = -(-number // RUN)
    which = np.repeat(np.arange(len(starts)), times)
    step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    first = starts[which] + step * RUN
    return mixed(h[starts[which]]), row[which], first - offsets[row[which]], np.minimum(number[which] - step * RUN, RUN)


def lots_of_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[np.ndarray]]:
    """[gram, row, document, part, first, number] of the runs of up to LOT_BYTES of text and LOT_ROWS rows, or of one slice."""
    lot: list[list[np.ndarray]] = []
    size = rows = 0
    for batch in batches:
        ids, parts = batch.column("doc_id").to_numpy(), batch.column("part").to_numpy()
        for row, data, offsets in slices(batch.column("text")):
            if lot and (size + len(data) > LOT_BYTES or rows + len(offsets) > LOT_ROWS):
                yield [np.concatenate(c) for c in zip(*lot, strict=True)]
                lot, size, rows = [], 0, 0
            gram, at, first, number = runs_of(data, offsets, length)
            if len(gram):
                lot.append([gram, (at + rows).astype(np.int32), ids[at + row], parts[at + row], first.astype(np.int32), number.astype(np.uint8)])
            size, rows = size + len(data), rows + len(offsets) - 1
    if lot:
        yield [np.concatenate(c) for c in zip(*lot, strict=True)]


def deal_runs(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, part, blob): the runs of all documents by gram.

    Of grams that several documents of a lot share, only a mark with the number of runs is dealt; the runs are known to
    be needed and go on at once (bucket -1 - part). So a gram that is everywhere sends a few bytes per lot.
    """
    bits = buckets.bit_length() - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, at, ids, parts, first, number in lots_of_runs(batches, length):
            bucket = (gram >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(gram), np.int64)
            rest = ((gram >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            o = np.argsort(gram, kind="stable")
            heads = np.concatenate([[0], np.flatnonzero(np.diff(gram[o])) + 1])
            sizes = np.diff(np.concatenate([heads, [len(o)]]))
            several = np.minimum.reduceat(ids[o], heads) < np.maximum.reduceat(ids[o], heads)
            common = np.zeros(len(o), bool)
            common[o] = np.repeat(several, sizes)
            out = []
            for key, piece in _pieces(np.where(common, -1, bucket)):
                if key < 0:
                    for part, some in _pieces(parts[piece]):
                        some = piece[some]
                        out.append((-1 - part, part, replies(ids[some], first[some], number[some], places(bucket[some], rest[some]))))
                    marks, runs = o[heads[several]], sizes[several]
                    for place, some in _pieces(bucket[marks]):
                        out.append((place, -1, pack(rest[marks[some]], runs[some].astype(np.uint32))))
                    continue
                _, where, index = np.unique(at[piece], return_index=True, return_inverse=True)
                step = np.diff(first[piece], prepend=0).astype(np.int32)
                out.append((key, -2, pack(rest[piece], index.astype(np.uint16), step, number[piece],
                                          ids[piece[where]], parts[piece[where]].astype(np.int32))))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["bucket", "part", "blob"])

    return docs.select("doc_id", "part", "text").mapInArrow(work, "bucket int, part int, blob binary")


def places(bucket: np.ndarray | int, rest: np.ndarray) -> np.ndarray:
    """The target that sorts the runs of a gram, and 16 more of its bits, as one number. Equal grams have equal places."""
    return ((bucket * SUBS + (rest >> np.uint32(33 - SUBS.bit_length()))).astype(np.int64) << 16) | (rest & np.uint32(0xFFFF)).astype(np.int64)


def replies(ids: np.ndarray, first: np.ndarray, number: np.ndarray, place: np.ndarray) -> bytes:
    """Runs that are needed: document, first window, windows, and the place of their gram."""
    return pack(ids.astype(np.int64), first.astype(np.int32), number.astype(np.uint8), (place >> 16).astype(np.int32), place.astype(np.uint16))


def shared_runs(dealt: DataFrame) -> DataFrame:
    """(part, blob): the runs whose gram lies in two documents or more; of part -1, the places of common grams."""
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["part"].to_numpy()
        bucket = int(pdf["bucket"].iloc[0])
        if bucket < 0:
            return pdf[["part", "blob"]]
        rest, runs, ids, parts, first, number = [], [], [], [], [], []
        for mark, blob in zip(kind == -1, pdf["blob"], strict=True):
            if mark:  # one row for all runs of a lot, which are not here
                r, n = unpack(blob, "u4", "u4")
                rest.append(r)
                runs.append(n)
                ids.append(np.zeros(len(r), np.int64))
                parts.append(np.full(len(r), -1, np.int32))
                first.append(np.zeros(len(r), np.int64))
                number.append(np.zeros(len(r), np.uint8))
                continue
            r, index, step, n, rows, own = unpack(blob, "u4", "u2", "i4", "u1", "i8", "i4")
            rest.append(r)
            runs.append(np.ones(len(r), np.uint32))
            ids.append(rows[index])
            parts.append(own[index])
            first.append(np.cumsum(step))
            number.append(n)
        rest, runs, ids, parts, first, number = map(np.concatenate, (rest, runs, ids, parts, first, number))
        o = np.argsort(rest, kind="stable")
        heads = np.concatenate([[0], np.flatnonzero(np.diff(rest[o])) + 1])
        sizes = np.diff(np.concatenate([heads, [len(o)]]))
        needed = np.minimum.reduceat(ids[o], heads) < np.maximum.reduceat(ids[o], heads)
        needed |= np.minimum.reduceat(parts[o], heads) < 0
        take = o[np.repeat(needed, sizes)]
        take = take[parts[take] >= 0]
        common = rest[o[heads]][needed & (np.add.reduceat(runs[o], heads, dtype=np.int64) > COMMON)]
        out = [(-1, pack(places(bucket, common)))] if len(common) else []
        for part, some in _pieces(parts[take]):
            at = take[some]
            out.append((part, replies(ids[at], first[at], number[at], places(bucket, rest[at]))))
        return pd.DataFrame(out, columns=["part", "blob"])

    return dealt.groupBy("bucket").applyInPandas(find, "part int, blob binary")


def common_places(needed: DataFrame) -> np.ndarray:
    """The places of grams with more than COMMON runs, in order: eight bytes for so many runs at most."""
    blobs = needed.where("part = -1").select("blob").collect()
    return np.unique(np.concatenate([np.zeros(0, np.int64), *[unpack(b[0], "i8")[0] for b in blobs]]))


# --- contexts, sorting, removal ---------------------------------------------------------------------------------------

def _texts(table: pa.Table) -> list[tuple[int, bytes]]:
    return [(i, (t or "").encode("utf-8", "surrogatepass")) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)]


def deal_contexts(docs: DataFrame, needed: DataFrame, buckets: int, length: int) -> DataFrame:
    """(target, part, blob): the bytes of the needed runs for the buckets that sort them.

    A run whose bytes an earlier document of the part has too is removed here (target -1 - part), and is not sent. All other
    runs of a common place are dealt by content, window by window, however they came here.
    """
    common = common_places(needed)

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        part = key[0].as_py()
        texts = dict(_texts(left))
        found = [unpack(b, "i8", "i4", "u1", "i4", "u2") for b in right["blob"].to_pylist()]
        seen: dict[bytes, int] = {}
        sent: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
        gone: list[tuple[int, int, int]] = []
        if found and texts:
            ids, first, number, target, more = map(np.concatenate, zip(*found, strict=True))
            target = np.where(np.isin((target.astype(np.int64) << 16) | more, common), -1, target)
            o = np.lexsort((first, ids))
            for doc, at, n, goal in zip(ids[o].tolist(), first[o].tolist(), number[o].tolist(), target[o].tolist(), strict=True):
                run = texts[doc][at:at + n + length - 1]
                if len(run) == n + length - 1:  # else of another text with this id
                    owner = seen.setdefault(run, doc)
                    if owner < doc:
                        gone.append((doc, at, at + n + length - 1))
                        continue
                    if goal >= 0:
                        sent[goal].append((doc, at, run))
                if goal >= 0:
                    continue
                for low in range(len(run) - length + 1):
                    context = run[low:low + length]
                    owner = seen.setdefault(context, doc)
                    if owner < doc:
                        gone.append((doc, at + low, at + low + length))
                        continue
                    place = int.from_bytes(hashlib.blake2b(context, digest_size=4).digest(), "little") % (buckets * SUBS)
                    sent[place].append((doc, at + low, context))
        rows = [(place, part, contexts_blob(some)) for place, some in sent.items()]
        if gone:
            rows.append((-1 - part, part, pack(*[np.array(c, np.int64) for c in zip(*gone, strict=True)])))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table({"target": pa.array(columns[0], pa.int32()), "part": pa.array(columns[1], pa.int32()), "blob": pa.array(columns[2], pa.binary())})

    return docs.groupBy("part").cogroup(needed.where("part >= 0").groupBy("part")).applyInArrow(
        work, "target int, part int, blob binary")


def contexts_blob(some: list[tuple[int, int, bytes]]) -> bytes:
    docs, firsts, contexts = zip(*some, strict=True)
    return pack(np.array(docs, np.int64), np.array(firsts, np.int32), np.array([len(c) for c in contexts], np.int32),
                np.frombuffer(b"".join(contexts), np.uint8))


def first_of_equals(contexts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """The smallest document that has the bytes of each context."""
    first: dict[bytes, int] = {}
    for context, doc in zip(contexts, docs.tolist(), strict=True):
        if first.setdefault(context, doc) > doc:
            first[context] = doc
    return np.array([first[context] for context in contexts], np.int64)


def removed_spans(contexts: DataFrame, length: int) -> DataFrame:
    """(part, blob): document, first byte, byte after the last, of what the suffix array of each bucket removes.

    A context that an earlier document has byte for byte goes as a whole and is not sorted.
    """
    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf["target"].iloc[0]) < 0:
            return pdf[["part", "blob"]]
        docs, firsts, lengths, found, parts = [], [], [], [], []
        for part, blob in zip(pdf["part"], pdf["blob"], strict=True):
            d, f, n, b = unpack(blob, "i8", "i4", "i4", "u1")
            docs.append(d)
            firsts.append(f)
            lengths.append(n)
            ends = np.cumsum(n).tolist()
            b = b.tobytes()
            found += [b[low:high] for low, high in zip([0, *ends], ends, strict=False)]
            parts.append(np.full(len(d), part))
        docs, firsts, lengths, parts = map(np.concatenate, (docs, firsts, lengths, parts))
        again = first_of_equals(found, docs) < docs
        kept = np.flatnonzero(~again)
        data = np.frombuffer(b"".join([found[i] for i in kept.tolist()]), np.uint8)
        starts = np.cumsum(lengths[kept]) - lengths[kept]
        gone = np.sort(repeated_windows(data, starts, lengths[kept], docs[kept], length))
        owner = np.searchsorted(starts, gone, "right") - 1
        cuts = np.flatnonzero((np.diff(gone) > 1) | (np.diff(owner) > 0)) + 1
        heads, lasts = np.concatenate([[0], cuts])[:len(gone)], np.concatenate([cuts, [len(gone)]])[:len(gone)] - 1
        at = firsts[kept[owner]] + gone - starts[owner]  # where the windows that go start in their documents
        row = np.concatenate([np.flatnonzero(again), kept[owner[heads]]])
        low = np.concatenate([firsts[again], at[heads]]).astype(np.int64)
        high = np.concatenate([firsts[again] + lengths[again], at[lasts] + length]).astype(np.int64)
        out = [(part, pack(docs[row[some]], low[some], high[some])) for part, some in _pieces(parts[row])]
        return pd.DataFrame(out, columns=["part", "blob"])

    return contexts.groupBy("target").applyInPandas(sort, "part int, blob binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters that they cover in part only."""
    inside = lambda at: at < len(text) and text[at] & 0xC0 == 0x80
    out = []
    for low, high in spans:
        while low < high and inside(low):
            low += 1
        while high > low and inside(high):
            high -= 1
        if high > low:
            out.append((low, high))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs (doc_id, text).

    A byte goes where it is covered by ``length`` bytes that also start in a document with a smaller id. ``with_text``
    adds ``text``, what is left, which keeps every character that would lose some of its bytes only, and ``row``, the
    other columns of docs (null for whole copies, which have no text left); all other columns count bytes.
    Null texts are empty. Texts shorter than ``length`` stay whole. Rows without an id stay whole and remove nothing.
    Rows that repeat an id are one document, must have one text, and remove nothing from each other. Whole copies of an earlier text are removed by their digest.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = stored(docs.select(
        F.col("doc_id").cast("long"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha256")), "facts")
    copies = stored(facts.where(F.col("n_bytes") >= length).groupBy("sha256").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha256").alias("__sha"), "first"), "copies")
    copied = stored(facts.where("doc_id is not null").join(copies, F.col("sha256") == F.col("__sha")).where("doc_id > first").select(
        F.col("doc_id").alias("__id"), "n_bytes"), "copied")
    total = facts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = 1 << max(0, math.ceil(math.log2(max(total, 1) / PART_BYTES)))
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row")
    carried = [others] * with_text
    own = docs.select(F.col("doc_id").cast("long"), "text", *carried).where("doc_id is not null")
    if copied.count() <= BROADCAST_IDS:  # beyond that they take part like any other text
        own = own.join(F.broadcast(copied), F.col("doc_id") == F.col("__id"), "left_anti")
        rest = copied.select(F.col("__id").alias("doc_id"), "n_bytes", F.col("n_bytes").alias("n_removed"),
                             F.lit(1).cast("long").alias("n_spans"), F.lit(NOTHING).alias("kept_sha256"))
    else:
        rest = None
    own = own.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    needed = stored(shared_runs(deal_runs(own, buckets, length)), "runs")
    # Both cogroups take the same columns, so the texts are shuffled once for both.
    own = own.select("part", "doc_id", "text", *["row"] * with_text)
    spans = removed_spans(deal_contexts(own, needed, buckets, length), length)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text", "row"] * with_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += f", text string, row {own.schema['row'].dataType.simpleString()}"

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for blob in right["blob"].to_pylist():
            for doc, low, high in zip(*[a.tolist() for a in unpack(blob, "i8", "i8", "i8")], strict=True):
                found[doc].append((low, high))
        out = []
        for (doc, text), given in zip(_texts(left), left["text"], strict=True):
            gone = merged(found[doc]) if doc in found else []
            kept = without(text, gone)
            row = (doc, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
            if with_text:
                row += (without(text, whole_characters(text, gone)).decode("utf-8", "surrogatepass") if gone else given.as_py(),)
            out.append(row)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        table = pa.table({n: pa.array(c, k) for n, c, k in zip(columns[:len(cols) if out else 5 + with_text], cols, kinds, strict=False)})
        return table.append_column("row", left["row"]) if with_text else table

    result = own.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(cut, schema)
    if rest is not None:
        no_row = [F.lit("").alias("text"), F.lit(None).cast(own.schema["row"].dataType).alias("row")] if with_text else []
        result = result.union(rest.select(*columns[:5], *no_row))
    lost = docs.where("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), *([F.col("text"), others] if with_text else []))
    return result.union(lost)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for low, high in spans:
        out.append(text[at:low])
        at = high
    out.append(text[at:])
    return b"".join(out)


@query("op3_suffix_dedup")
def _suffix_dedup(spark, folder):
    """All documents with the bytes they lose to earlier ones."""
    return remove_repeats(read(spark, folder, "documents"))
