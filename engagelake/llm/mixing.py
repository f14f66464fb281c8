"""Mixing sources to target weights: water-filled targets, whole epochs, then Efraimidis–Spirakis sampling. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engagelake.llm.common import query, read, stored, words_of

#: Weights of the sources in code point order, repeating.
SOURCE_WEIGHTS = (3, 1, 2)
#: The mix takes so many times all sizes, and at most so many times a source's.
SHARE, MOST_EPOCHS = 1.5, 2
#: Documents in one bucket of sampling keys, on average.
BUCKET_ROWS = 2_000
#: Sampling weight of a document by its quality label; documents without a label weigh 1.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}


def targets(df: DataFrame, source: str, size: str, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: words, documents, weight and target.

    ``share`` of all words is dealt by weight; no source goes above ``most`` times its own words, and what it cannot
    take is dealt again among the others. With sources in the order of cap over weight, the level at which the rest
    share is settled where the first source stays below its cap.
    """
    sums = df.groupBy(F.col(source).alias("source")).agg(
        F.sum(size).alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in SOURCE_WEIGHTS]), (F.pmod(place - 1, F.lit(len(SOURCE_WEIGHTS))) + 1).cast("int"))
    rows = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / heavy).withColumn("nr", F.row_number().over(order))
    settled = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("nr", "level"))
    level = F.min(settled).over(whole)["level"]
    return rows.select("source", "source_size", "source_rows", F.least("cap", F.coalesce(level * F.col("weight"), "cap")).alias("target"))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) hashed from the id and the text."""
    digest = F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(df: DataFrame, size: str = "size", source: str = "source", key: str = "key", share: float = SHARE,
        most: int = MOST_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add source_size, target and copies (how often the mix takes the document).

    Every source takes whole epochs while its target lasts, then documents in the order of ``key`` for what is left:
    a document is in while more than half of it fits, so a source ends within half a document of its target.
    Documents of one source are numbered in buckets of the key, whose totals are summed first; no task holds a source.
    A null source is a source of its own, after all others. Documents of size 0 take no words and get one copy per
    whole epoch. Equal rows share a key; which of them is cut off does not show.
    """
    plan = targets(df, source, size, share, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    plan = plan.select(
        F.col("source").alias("__source"), F.col("source_size"), "target", "epochs",
        (F.col("target") - F.col("epochs") * F.col("source_size")).alias("__rest"),
        F.ceil(F.col("source_rows") / F.lit(bucket_rows)).alias("__buckets"))
    rows = df.join(plan, F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("__bucket", F.floor((1 - F.exp(-F.col(key))) * F.col("__buckets")))
    sums = rows.groupBy(F.col(source).alias("__source"), F.col("__bucket").alias("__at")).agg(F.sum(size).alias("__sum"))
    ahead = W.partitionBy("__source").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("__source", "__at", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    own = W.partitionBy(source, "__bucket").orderBy(key, size).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum(size).over(own), F.lit(0)))
    rows = rows.join(sums, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__at")))
    fits = (F.col(size) > 0) & ((F.col("__ahead") + F.col("__own")) * 2.0 + F.col(size) <= F.col("__rest") * 2.0)
    rows = rows.withColumn("copies", F.col("epochs") + F.when(fits, 1).otherwise(0))
    return rows.drop("__source", "__at", "__ahead", "__own", "__bucket", "__buckets", "__rest", "epochs")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(__doc, __weight) from the labels; the best label counts where a document has several."""
    best = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__doc")).agg(F.max("quality").alias("__best"))
    weight = F.lit(1.0)
    for label, value in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("__best") == label, F.lit(value)).otherwise(weight)
    return best.select("__doc", weight.alias("__weight"))


def sized(docs: DataFrame, labels: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, source, size, key) of the documents, ready for ``mix``; key is -ln(u) / weight, small keys first.

    The texts are read once: sizes, draws and the expressions of ``keep`` are stored before anything is joined or sorted.
    """
    more = [c.alias(name) for name, c in (keep or {}).items()]
    rows = stored(docs.select(
        "doc_id", "source", words_of(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text")).alias("__u"), *more), "sizes")
    rows = rows.join(quality_weights(labels), F.col("doc_id") == F.col("__doc"), "left")
    key = -F.log("__u") / F.coalesce("__weight", F.lit(1.0))
    return rows.select("doc_id", "source", "size", key.alias("key"), *(keep or {}))


SQL = r"""
WITH docs AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || md5(coalesce(d.text, ''))), 1, 13) AS BIGINT) + 0.5)
             / 4503599627370496.0) / CASE l.best WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS best FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY 1),
weighed AS (
  SELECT *, 2.0 * source_size AS cap,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM sums),
levels AS (
  SELECT *, row_number() OVER o AS nr,
         (1.5 * (SELECT sum(source_size) FROM sums) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
plan AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, nr) FROM levels WHERE cap / w > level) * w, cap)) AS target FROM levels),
taken AS (
  SELECT d.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (epochs + CASE WHEN size > 0 AND 2.0 * ahead + size <= 2.0 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM taken"""


@query("op9_mixing", SQL)
def _mixing(spark, folder):
    """All documents with the words the mix takes of each."""
    rows = mix(sized(read(spark, folder, "documents"), read(spark, folder, "labels")))
    taken = (F.col("size") * F.col("copies")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
