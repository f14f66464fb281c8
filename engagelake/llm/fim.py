"""Fill-in-middle: documents as piece tables whose pieces are cut, arranged, and put back.

A piece is a descriptor (buffer, first, after) over a buffer that never changes: the text or the sentinels. Cutting
splits a descriptor, an arrangement lists descriptors in another order, and hashes and texts stream over them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engagelake.llm.common import query, read

#: What marks the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Where each sentinel lies in the buffer that holds all of them.
PLACES = {s: (3 * i, 3 * i + 3) for i, s in enumerate(SENTINELS)}
SENTINEL, TEXT = 0, 1
#: Order of (prefix, middle, suffix) by form, each behind its sentinel; spm starts with the suffix.
ARRANGEMENTS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
#: Shares in hundredths: documents that are rearranged, and those of them that start with the suffix.
RATE, SPM_RATE = 90, 20
#: Characters looked at together while units are counted.
STRETCH = 1 << 20


@dataclass(frozen=True)
class Piece:
    """Characters ``first`` to ``after`` of a buffer."""

    buffer: int
    first: int
    after: int


class PieceTable:
    """Pieces over a text and the sentinels; the text is never copied until it is asked for."""

    def __init__(self, text: str, pieces: list[Piece] | None = None):
        self.buffers = ("".join(SENTINELS), text)
        self.pieces = [Piece(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, *places: int) -> PieceTable:
        """Pieces split at the given characters, in ascending order; a cut at an end leaves an empty piece."""
        out, at = [], 0
        todo = list(places)
        for piece in self.pieces:
            size = piece.after - piece.first
            while todo and todo[0] <= at + size:
                middle = piece.first + todo.pop(0) - at
                out.append(Piece(piece.buffer, piece.first, middle))
                at, piece = at + middle - piece.first, Piece(piece.buffer, middle, piece.after)
                size = piece.after - piece.first
            out.append(piece)
            at += size
        return PieceTable(self.buffers[TEXT], out)

    def arranged(self, form: str) -> PieceTable:
        """Three pieces (prefix, middle, suffix) in the order of ``form``, each behind its sentinel."""
        out = []
        for mark, number in ARRANGEMENTS[form]:
            out += [Piece(SENTINEL, *PLACES[mark]), self.pieces[number]]
        return PieceTable(self.buffers[TEXT], out)

    def restored(self, form: str) -> PieceTable:
        """The pieces of an arrangement in their first order, without the sentinels."""
        back = sorted((number, 2 * k + 1) for k, (_, number) in enumerate(ARRANGEMENTS[form]))
        return PieceTable(self.buffers[TEXT], [self.pieces[k] for _, k in back])

    def spans(self) -> Iterator[str]:
        """The characters of the pieces, a stretch at a time."""
        for p in self.pieces:
            for first in range(p.first, p.after, STRETCH):
                yield self.buffers[p.buffer][first:min(first + STRETCH, p.after)]

    def text(self) -> str:
        return "".join(self.spans())

    def sha256(self) -> str:
        """Lower-case hex SHA-256 of the UTF-8 of all pieces, streamed."""
        digest = hashlib.sha256()
        for span in self.spans():
            digest.update(span.encode("utf-8", "surrogatepass"))
        return digest.hexdigest()


def _unit_starts(text: str, first: int, after: int) -> np.ndarray:
    """Which characters from ``first`` on start a unit: all but letters A-Z, a-z that follow one."""
    codes = np.frombuffer(text[max(first - 1, 0):after].encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (codes | 32) - 97 < 26  # unsigned, so smaller codes wrap to large ones
    inner = np.zeros(len(codes), bool)
    inner[1:] = letter[1:] & letter[:-1]
    return ~inner[min(first, 1):]


def units(text: str) -> tuple[int, list[int]]:
    """(units, units before each stretch): a run of letters A-Z, a-z is one unit, every other character one."""
    before = [0]
    for first in range(0, len(text), STRETCH):
        before.append(before[-1] + int(np.count_nonzero(_unit_starts(text, first, first + STRETCH))))
    return before[-1], before


def place_of(text: str, before: list[int], unit: int) -> int:
    """The character that starts the unit of this number; the end of the text after the last unit."""
    if unit >= before[-1]:
        return len(text)
    stretch = int(np.searchsorted(before, unit, "right")) - 1
    starts = np.flatnonzero(_unit_starts(text, stretch * STRETCH, (stretch + 1) * STRETCH))
    return stretch * STRETCH + int(starts[unit - before[stretch]])


def draws(key: int | None, salt: str = "1") -> tuple[int, ...]:
    """Four numbers of 32 bits from the SHA-256 of salt and key (nothing for null)."""
    digest = hashlib.sha256(f"{salt}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[8 * i:8 * i + 8], 16) for i in range(4))


def arrange(key: int | None, text: str, rate: int = RATE, spm_rate: int = SPM_RATE, salt: str = "1") -> tuple[int, str, PieceTable]:
    """(units, form, piece table) of one document."""
    n, before = units(text)
    h1, h2, h3, h4 = draws(key, salt)
    table = PieceTable(text)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return n, "plain", table
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return n, form, table.cut(place_of(text, before, low), place_of(text, before, high)).arranged(form)


def disarrange(output: str, form: str) -> PieceTable:
    """The document of an output, as pieces of it. Each sentinel is there once, since texts that hold one stay plain."""
    table = PieceTable(output)
    if form not in ARRANGEMENTS:
        return table
    at = [output.index(mark) for mark, _ in ARRANGEMENTS[form]]
    parts = table.cut(*[c for place in at for c in (place, place + 3)]).pieces[1:]  # an empty piece leads
    return PieceTable(output, parts).restored(form)


# --- over tables ------------------------------------------------------------------------------------------------------

RESULT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                    ("output", pa.string()), ("output_sha256", pa.string())])
BACK = pa.struct([("restored", pa.string()), ("restored_sha256", pa.string())])


def with_fim(df: DataFrame, key: str = "doc_id", text: str = "text", into: str = "fim", rate: int = RATE, spm_rate: int = SPM_RATE,
             salt: str = "1") -> DataFrame:
    """Add ``into``: (n, form, prefix_chars, middle_chars, output, output_sha256) of every row.

    Cuts and forms hang on the key alone, so repeated ids are cut alike and reruns agree; a null key draws like an empty
    one. Null and empty texts are plain with an empty output. A column of this name is replaced, all others stay.
    """

    @F.arrow_udf("struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string,output_sha256:string>")
    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, texts in batches:
            out = []
            for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True):
                n, form, table = arrange(k, t or "", rate, spm_rate, salt)
                sizes = [None, None]
                if form != "plain":
                    order = [number for _, number in ARRANGEMENTS[form]]
                    sizes = [p.after - p.first for p in (table.pieces[2 * order.index(i) + 1] for i in (0, 1))]
                out.append((n, form, *sizes, table.text(), table.sha256()))
            columns = list(zip(*out, strict=True)) or [[]] * len(RESULT)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], fields=list(RESULT))

    return df.withColumn(into, work(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))))


def with_restored(df: DataFrame, output: str, form: str, into: str = "back") -> DataFrame:
    """Add ``into``: (restored, restored_sha256), the text rebuilt from an output and its form alone."""

    @F.arrow_udf("struct<restored:string,restored_sha256:string>")
    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            tables = [disarrange(o or "", f) for o, f in zip(outputs.to_pylist(), forms.to_pylist(), strict=True)]
            columns = [[t.text() for t in tables], [t.sha256() for t in tables]]
            yield pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(BACK))

    return df.withColumn(into, work(F.col(output), F.col(form)))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
h AS (
  SELECT *, len(t) AS n, CAST('0x' || substr(k, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(k, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(k, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(k, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(t[1:a], '') AS pre, array_to_string(t[a + 1:b], '') AS mid, array_to_string(t[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


@query("op12_fim", SQL)
def _fim(spark, folder):
    """All documents rearranged, and restored from what came out."""
    rows = with_fim(read(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    rows = with_restored(rows, "output", "form")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "back.restored_sha256")
