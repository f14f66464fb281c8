"""Word shingles of whole texts, hashed with array operations over the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.default_rng(20)
#: A number for each byte, in two independent hashes.
BYTE = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
#: Bits of a shingle's hash that are kept; the others number the texts of a slice while it is sorted.
KEPT = 52
SLICE_BYTES = 2 << 20
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift), salted."""
    h = h ^ np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about SLICE_BYTES; a longer text is a run of its own."""
    texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        after = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        after = min(max(after, first + 1), len(texts), first + (1 << (64 - KEPT)))
        yield first, data[offsets[first]:offsets[after]], offsets[first:after + 1] - offsets[first]
        first = after


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every lower-cased word (2 rows), and the row it is in."""
    if not len(data):
        return np.zeros((2, 0), np.uint64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _power(len(data))
    lowered, size, h = LOWER[data], (ends - starts).astype(np.uint64), []
    sums = np.zeros(len(data) + 1, np.uint64)
    for values in BYTE:
        np.multiply(values[lowered], up, out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        h.append(mixed((sums[ends] - sums[starts]) * down[starts] ^ size))
    return np.stack(h), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, sizes, whole): the distinct shingles of ``words`` words of each row, by row and hash, and their number.

    A row with fewer words has one shingle, the whole sequence; one without words has none. Hashes keep KEPT bits; a row
    that is alone in its slice is counted with all 64. ``whole``: 128 bits of each shingle, in two rows.
    """
    h, row = word_hashes(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    found, where = [], []
    if h.shape[1] >= words:
        n = h.shape[1] - words + 1
        inside = row[:n] == row[words - 1:]
        s = h[:, :n]
        for k in range(1, words):
            s = mixed(s * np.uint64(BASE) + h[:, k:k + n])
        found.append(s[:, inside])
        where.append(row[:n][inside])
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        s = h[:, first[short]]
        for k in range(1, words - 1):
            more = count[short] > k
            s = np.where(more, mixed(s * np.uint64(BASE) + h[:, np.minimum(first[short] + k, h.shape[1] - 1)]), s)
        found.append(mixed(s, 1) ^ count[short].astype(np.uint64))
        where.append(short)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows, np.int64), np.zeros((2, 0), np.uint64)
    s, at = np.concatenate(found, axis=1), np.concatenate(where)
    low = np.uint64(64 - KEPT)
    if rows == 1:
        sizes = np.array([len(np.unique(s[0]))])
    key = (at.astype(np.uint64) << np.uint64(KEPT)) | (s[0] >> low)
    order = np.argsort(key)
    key = key[order]
    order = order[np.concatenate([[True], key[1:] != key[:-1]])]
    at = at[order]
    if rows > 1:
        sizes = np.bincount(at, minlength=rows)
    return mixed(s[0, order] >> low), at, sizes, s[:, order]


def set_digests(at: np.ndarray, whole: np.ndarray, rows: int) -> list[np.ndarray]:
    """Two 64-bit digests of the set of each row, each over another hash of its shingles."""
    out = []
    for values, salt in zip(whole, (101, 102), strict=True):
        d = np.zeros(rows, np.uint64)
        np.add.at(d, at, mixed(values, salt))
        out.append(d.view(np.int64))
    return out


def exact_shingles(text: str | None, words: int) -> set[tuple[bytes, ...]]:
    """The shingle set of one text, from the words themselves."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if len(found) < words:
        return {tuple(found)} if found else set()
    return set(zip(*[found[k:] for k in range(words)], strict=False))
