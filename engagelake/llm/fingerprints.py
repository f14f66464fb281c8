"""I-Match fingerprints: terms of a band of document frequency, in randomised subsets of the lexicon. Native."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engagelake.llm.common import query, read, stored

#: Shares of the documents that a term of the lexicon is in (inverse document frequency 3.0 to 6.2).
LEAST_SHARE, MOST_SHARE = 0.002, 0.05
#: Subsets of the lexicon: at each level a quarter of the terms of the level before, dealt into places.
LEVELS, PLACES = 5, 16
#: What an empty subset hashes to (the seed of the hash).
EMPTY = 42
#: Text bytes in a part of the order of documents, cut points that the parts are laid between, parts that may be broadcast.
PART_BYTES, CUTS, BROADCAST_PARTS = 2 << 20, 256, 1_000_000
TERM_BREAK = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """The hashes of the distinct lower-cased terms of the text."""
    hashed = F.transform(F.split(F.lower(text), TERM_BREAK), lambda t: F.xxhash64(t))
    return F.array_remove(F.array_distinct(hashed), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> list[int]:
    """The hashes of the terms whose share of all documents lies in the band, counted over all of them.

    They are few at any size: a term of the band is in ``least`` of the documents at least, so there are no more than
    the mean number of terms per document divided by ``least``.
    """
    total = docs.count()
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    low, high = max(2, math.ceil(least * total)), most * total
    return sorted(counts.where((F.col("df") >= low) & (F.col("df") <= high)).select("term").toArrow()["term"].to_pylist())


def with_subset_hashes(df: DataFrame, text: str, kept: list[int], into: str) -> DataFrame:
    """Add one number per subset: a hash of the sorted terms of the text that are in it, or EMPTY.

    A level keeps the terms whose hash ends in two zero bits more than the level before asks for, and other bits deal
    its terms into places; so long texts have levels with few terms, and an edit changes some subsets and not others.
    """
    own = df.withColumn("__terms", terms(F.col(text)))
    # One list of numbers in SQL: the optimizer turns it into a hash set.
    inside = f"filter(__terms, x -> x IN ({', '.join(f'{k}L' for k in kept)}))" if kept else "cast(array() as array<bigint>)"
    own = own.withColumn("__terms", F.array_sort(F.expr(inside)))
    rare = lambda k: F.filter(F.col("__terms"), lambda x: x.bitwiseAND(F.lit((1 << (2 * k)) - 1)) == 0)
    levels = F.array(F.col("__terms"), *[rare(k) for k in range(1, LEVELS)])
    place = lambda x: F.shiftright(x, 20).bitwiseAND(F.lit(PLACES - 1))
    subset = lambda some, b: F.pmod(F.xxhash64(F.filter(some, lambda x: place(x) == b)), F.lit(65536)).cast("int")
    places = F.sequence(F.lit(0), F.lit(PLACES - 1))
    return own.withColumn(into, F.flatten(F.transform(levels, lambda some: F.transform(places, lambda b: subset(some, b))))).drop("__terms")


def written(text: Column, hashes: Column) -> Column:
    """The fingerprint as a string: four digits per subset, or a digest of the text where it has no term of the lexicon."""
    digits = F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 4, "0")), "")
    return F.when(F.forall(hashes, lambda h: h == EMPTY), F.concat(F.lit("="), F.md5(text))).otherwise(digits)


def likeness(one: Column, other: Column, print_one: Column, print_other: Column) -> Column:
    """Share of equal subsets among those that are not empty on both sides; 1 for equal fingerprints.

    Only levels that leave a place empty on one side count: in a full level every subset has many terms, and any edit
    changes them all. So likeness means the same for short and long texts.
    """
    level = lambda side, k: F.slice(side, k * PLACES + 1, F.lit(PLACES))
    sparse = lambda k: F.array_contains(level(one, k), EMPTY) | F.array_contains(level(other, k), EMPTY)
    verdict = lambda x, y: F.when((x == EMPTY) & (y == EMPTY), 0).when(x == y, 1).otherwise(2)
    alike = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), sparse),
                                  lambda k: F.zip_with(level(one, k), level(other, k), verdict)))
    same, differ = F.size(F.filter(alike, lambda v: v == 1)), F.size(F.filter(alike, lambda v: v == 2))
    return F.when(print_one == print_other, 1.0).when(same + differ == 0, 0.0).otherwise(same / (same + differ))


def with_fingerprints(df: DataFrame, kept: list[int], text: str = "text") -> DataFrame:
    """Add subset hashes (``subsets``) and the ``fingerprint`` of the whole text; a null text counts as empty."""
    own = df.withColumn("__whole", F.coalesce(F.col(text), F.lit("")))
    own = with_subset_hashes(own, "__whole", kept, "subsets")
    return own.withColumn("fingerprint", written(F.col("__whole"), F.col("subsets"))).drop("__whole")


def part_of(doc_id: Column, cuts: list[int], per_cut: int) -> Column:
    """The part of an id: parts follow the order of ids, ``per_cut`` of equal width between two cut points."""
    points = F.array(*[F.lit(c) for c in cuts])
    at = F.size(F.filter(points, lambda c: c <= doc_id))  # 1 to len(cuts)
    low, high = F.element_at(points, F.greatest(at, F.lit(1))), F.element_at(points, F.least(at + 1, F.lit(len(cuts))))
    share = (doc_id - low).cast("double") / (high - low + 1)
    inner = F.least(F.greatest(F.floor(share * per_cut), F.lit(0)), F.lit(per_cut - 1))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(at * per_cut + inner).cast("long")


def with_next(df: DataFrame, order: str, text_bytes: int, columns: list[str], tie: str) -> DataFrame:
    """Add ``next_<column>`` of the next row in descending ``order``; the last row is followed by the first.

    Rows are dealt into parts that follow the order, small enough to sort. The first row of every part also visits the
    part above it, where it follows the last row, so each text moves once. Equal places are ordered by ``tie``, and null
    places come last.
    """
    ids = df.select(F.col(order).cast("long").alias("id"))
    parts = max(1, math.ceil(text_bytes / PART_BYTES))
    cuts = ids.agg(F.percentile_approx("id", [i / min(CUTS, parts) for i in range(min(CUTS, parts) + 1)], 10_000)).first()[0]
    cuts = sorted(set(cuts or [0]))
    part = part_of(F.col("id"), cuts, math.ceil(parts / len(cuts)))
    firsts = stored(ids.withColumn("part", part).groupBy("part").agg(F.max("id").alias("first")), "firsts")
    above = F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.orderBy("part")))
    seams = firsts.select("part", "first", above.alias("visits")).where("part >= 0 or visits >= 0")
    seams = stored(seams.select(F.col("first").alias("__first"), F.col("part").alias("__own"), F.col("visits").alias("__visits")), "seams")
    if seams.count() <= BROADCAST_PARTS:
        seams = F.broadcast(seams)
    rows = df.withColumn("id", F.col(order).cast("long")).withColumn("part", part)
    rows = rows.join(seams, F.col("id").eqNullSafe(F.col("__first")) & (F.col("part") == F.col("__own")), "left")
    here = F.struct(F.col("part").alias("at"), F.lit(False).alias("visitor"))
    there = F.struct(F.col("__visits").alias("at"), F.lit(True).alias("visitor"))
    rows = rows.withColumn("__place", F.explode(F.when(F.col("__visits").isNull(), F.array(here)).otherwise(F.array(here, there))))
    rows = rows.select(*[c for c in rows.columns if not c.startswith("__") and c != "part"], "__place.at", "__place.visitor")
    following = W.partitionBy("at").orderBy("visitor", F.col("id").desc_nulls_last(), tie)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(following) for c in columns})
    return rows.where(~F.col("visitor")).drop("id", "at", "visitor")


def with_edited(docs: DataFrame, kept: list[int]) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they and the next document's are.

    The edited text is the text with its last third replaced by the start of the next document, in descending doc_id.
    A single document is its own next. Null texts are empty. Equal ids are ordered by their texts; documents without an
    id come last.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    rows = with_fingerprints(rows, kept)
    rows = with_next(rows, "doc_id", size, ["text", "subsets", "fingerprint"], "text")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    rows = with_subset_hashes(rows, "edited", kept, "edited_subsets")
    rows = rows.withColumn("edited_fingerprint", written(F.col("edited"), F.col("edited_subsets")))
    near = lambda other: likeness(F.col("subsets"), F.col(f"{other}_subsets"), F.col("fingerprint"), F.col(f"{other}_fingerprint"))
    return rows.withColumns({"near_edited": near("edited"), "near_next": near("next")})


@query("op8_fingerprints")
def _fingerprints(spark, folder):
    """Fingerprints of all documents, and how they take an edit of a third of the text."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    rows = with_edited(docs, lexicon(docs))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
                       "edited_fingerprint", "near_edited", "near_next")
