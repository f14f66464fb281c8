"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engagelake.llm.common import query, read

#: Characters of a chunk, and of the first overlap; longer texts are spliced from chunks.
CHUNK, OVERLAP = 32_768, 512
LIMIT = 2048
#: Pieces of text whose counts a worker remembers before it starts anew.
REMEMBERED = 400_000

#: (token id, first character, character after the last)
Token = tuple[int, int, int]


class Vocabulary:
    """One interface to both tokenizer libraries. The file is loaded once per worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def tokens(self, text: str) -> list[Token]:
        if self.pieces:
            # This library's offsets count bytes.
            at = [0, *accumulate(len(c.encode()) for c in text)]
            chars = {b: i for i, b in enumerate(at)}
            found = self.model.encode(text, return_type="proto").pieces
            # A piece that is a part of a character covers the whole of it.
            first = lambda b: chars[max(k for k in range(b, b - 4, -1) if k in chars)]
            after = lambda b: chars[min(k for k in range(b, b + 4) if k in chars)]
            return [(p.id, first(p.begin), after(p.end)) for p in found]
        e = self.model.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _around(tokens: list[Token], shift: int, low: int, high: int) -> dict[int, tuple[Token | None, Token | None]]:
    """Positions in [low, high) that no token covers, each with the token before and the token after it."""
    found: dict[int, tuple[Token | None, Token | None]] = {}
    last: Token | None = None
    for token, a, b in tokens:
        here = (token, a + shift, b + shift)
        if last is None or last[2] <= here[1]:
            for at in range(max(low, last[2] if last else low), min(high, here[1] + 1)):
                found[at] = (last, here)
        last = here if last is None or here[2] >= last[2] else last
    return found


def boundary(text: str, left: list[Token], left_at: int, right: list[Token], right_at: int, end: int) -> int | None:
    """The last position in the overlap [right_at, end) where the encodings of two chunks can be joined.

    It stands before a single blank between two letters: pre-tokenization ends a run of letters there whatever comes
    before, and nothing that normalization composes reaches over a blank, so the tokens on either side do not depend
    on the text beyond. Both encodings must also have a boundary there, with the same tokens before and after.
    """
    spots = [
        x for x in range(right_at + 1, end - 1) if text[x] == " " and text[x - 1].isalpha() and text[x + 1].isalpha()
    ]
    if not spots:
        return None
    low, high = spots[0], spots[-1] + 1
    one, other = _around(left, left_at, low, high), _around(right, right_at, low, high)
    for x in reversed(spots):
        # The first token of the right chunk and the last of the left one may be cut; agreement shows they are not.
        if x in one and x in other and one[x] == other[x]:
            return x
    return None


def spliced_count(text: str, encode: Callable[[str], list[Token]], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, encoded in chunks of ``chunk`` characters that overlap by ``overlap``.

    Where no joint boundary is found the overlap doubles; when it has eaten the whole chunk, the chunk itself doubles,
    up to the whole text. The count is that of the whole text.
    """
    n, total = len(text), 0
    start, since, length = 0, 0, chunk + overlap
    tokens = encode(text[:length])
    while start + length < n:
        end, wide, joined = start + length, overlap, None
        while joined is None and end - wide > since:
            after = end - wide
            following = encode(text[after:after + chunk + overlap])
            joined = boundary(text, tokens, start, following, after, end)
            wide *= 2
        if joined is None:
            length *= 2
            tokens = encode(text[start:start + length])
            continue
        total += sum(1 for _, a, b in tokens if a + start >= since and b + start <= joined)
        start, since, length, tokens = after, joined, chunk + overlap, following
    return total + sum(1 for _, a, _ in tokens if a + start >= since)


@lru_cache(maxsize=4)
def counter(path: str, cut: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> Callable[[list[str]], list[int]]:
    """A function from texts to their token counts; a worker keeps it from task to task.

    ``cut``: characters that the vocabulary drops and that nothing it matches or composes reaches over, so the count of
    a text is the sum of the counts of its pieces, and a piece seen before needs no encoding. None: no such character.
    """
    known: dict[str, int] = {"": 0}

    def count(texts: list[str]) -> list[int]:
        words = vocabulary(path)
        out: list[int | None] = [spliced_count(t, words.tokens, chunk, overlap) if len(t) > chunk else None for t in texts]
        small = [i for i, n in enumerate(out) if n is None]
        if cut is None:
            for i, n in zip(small, words.counts([texts[i] for i in small]), strict=True):
                out[i] = n
            return out
        if len(known) > REMEMBERED:
            known.clear()
            known[""] = 0
        split, fresh = {}, set()
        for i in small:
            text = texts[i]
            for other in cut[1:]:
                text = text.replace(other, cut[0])
            split[i] = text.split(cut[0])
            fresh.update(set(split[i]).difference(known))
        todo = list(fresh)
        known.update(zip(todo, words.counts(todo), strict=True))
        for i in small:
            out[i] = sum(map(known.__getitem__, split[i]))
        return out

    return count


def with_token_counts(df: DataFrame, path: str, text: str = "text", cut: str | None = None, limit: int = LIMIT,
                      chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of the whole text.

    ``path``: the vocabulary file, at the same place on every executor. Null and empty texts have no tokens. Columns of
    these names are replaced, all others stay. ``cut`` is for vocabularies that drop blanks (see ``counter``); the default
    is right for all. Texts with special strings count as the library counts them.
    """

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(path, cut, chunk, overlap)
        for batch in batches:
            yield pa.array(count([t or "" for t in batch.to_pylist()]), pa.int64())

    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("n_bytes", F.octet_length(whole).cast("long")).withColumn("n_tokens", tokens(whole)).withColumn(
        "over_limit", F.col("n_tokens") > limit)


@query("op10_token_counts")
def _token_counts(spark, folder):
    """Tokens of every document in the word vocabulary, which drops blanks and line feeds."""
    import public_tokenizers

    docs = read(spark, folder, "documents").select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), cut=" \n").drop("text")
