"""From raw documents to packed sequences, in five stages that each write their result.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engagelake.llm import language, minhash, mixing, packing, suffixes
from engagelake.llm.common import read, settings, shared_folder, stored

#: A document whose language is less sure than this is rejected.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: no letter in the text (or no text), or no language that is likely at all.

    Documents without an id or a lang are judged like all others, and not learned from. Columns of any name pass through.
    Where no document has a lang to learn from, every text with a letter stays.
    """
    settings(spark)
    model = language.learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct("*").alias("__row"), "text")
    found = language.with_language(rows, model)
    sure = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(sure).select("__row.*")


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of every group of near duplicates, on shingles of five words.

    Documents without an id or without words stay; rows that repeat an id stay or go together.
    """
    settings(spark)
    found = minhash.near_duplicates(docs)
    gone = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= minhash.BROADCAST_IDS else gone
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more out that an earlier document has too; n_chars follows.

    A character that would lose some of its bytes only stays whole. A document that loses all its text goes; texts that
    were null or empty before stay, and so do documents without an id, untouched.
    """
    settings(spark)
    found = suffixes.remove_repeats(docs, with_text=True).where("n_removed = 0 or text <> ''")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))
    kept = {"text": F.col("text"), "n_chars": n_chars}
    return found.select(*[kept.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix asks for: as many equal rows, or none.

    A null source is a source of its own. Documents without words come once per whole epoch of their source. Rows with
    the same id and text are told apart by nothing and each take the most of theirs.
    """
    settings(spark)
    taken = mixing.mix(mixing.sized(docs, read(spark, sf_dir, "labels"), keep={"__text": F.xxhash64("text")})).where("copies > 0")
    taken = taken.groupBy(F.col("doc_id").alias("__id"), "__text").agg(F.max("copies").alias("__copies"))
    # One plan at every size: the texts go through one shuffle and are not sorted; the counts are the side that is hashed.
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text"))
    rows = docs.join(stored(taken, "copies").hint("shuffle_hash"), same)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into bins of 2048 words; copies of a document, and documents of one source, are apart.

    A document without words gets one row without a bin.
    """
    settings(spark)
    return packing.pack_texts(docs)


STAGES = [
    ("language", language_stage),
    ("minhash", minhash_stage),
    ("suffixes", suffix_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL has neither the language model nor sketches nor suffix arrays; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = read(settings(spark), sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir.rstrip("/"))
