"""Topics over a text corpus: assignment, class-based TF-IDF, names, similarity, reduction, document info."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType

from engagelake.functions.text import demojize, remove_stopwords, tokens
from engagelake.operators import merging
from engagelake.operators.density import dbscan
from engagelake.operators.frequency import sample_per_group
from engagelake.operators.ordering import dense_index, null_safe_join
from engagelake.operators.varying_density import varying_density
from engagelake.schemas import quoted
from engagelake.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage, written

OUTLIERS = -1
GRAM_BLOCK = 1024


def term_counts(docs: DataFrame, topic: str = "Topic", text: str = "text") -> DataFrame:
    """Occurrences per (topic, term), summed before the shuffle."""
    terms = docs.where(quoted(topic).isNotNull()).select(
        quoted(topic).alias("topic"), F.explode(tokens(quoted(text))).alias("term")
    )
    return terms.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))


def class_tfidf(counts: DataFrame, normalize: bool = False) -> DataFrame:
    """tf * ln(1 + A/f): A the mean number of tokens per topic, f the occurrences of the term in all topics.

    ``normalize`` divides tf by the tokens of the topic.
    """
    mean = counts.agg(F.sum("tf") / F.countDistinct("topic")).scalar()
    f = F.sum("tf").over(Window.partitionBy("term"))  # one row per topic in each partition
    weighted = counts.withColumn("idf", F.log(1 + mean / f))
    if normalize:
        lengths = broadcast_if_small(counts.groupBy("topic").agg(F.sum("tf").alias("__length")))
        weighted = weighted.join(lengths, "topic")
        share = F.col("tf") / F.col("__length")
    else:
        share = F.col("tf")
    return weighted.select("topic", "term", "tf", (share * F.col("idf")).alias("weight"))


def top_words(weights: DataFrame, n: int = 10) -> DataFrame:
    """The n heaviest words per topic, with their rank."""
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    ranked = weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select("topic", "rank", "term", "weight")


def topic_names(words: DataFrame, first: int = 4) -> DataFrame:
    """Name of each topic: its number and first words; and the list of its top words."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "term")))  # top words only, at most n per topic
    return words.groupBy("topic").agg(listed.alias("__w")).select(
        F.col("topic"),
        F.concat_ws("_", F.col("topic").cast("string"),
                    F.transform(F.slice("__w", 1, first), lambda w: w["term"])).alias("Name"),
        F.transform("__w", lambda w: w["term"]).alias("Representation"),
    )


def topic_sizes(docs: DataFrame, names: DataFrame, topic: str = "Topic") -> DataFrame:
    """(Topic, Name, Count), largest first."""
    sizes = docs.groupBy(quoted(topic).cast("bigint").alias("Topic")).agg(F.count(F.lit(1)).alias("Count"))
    named = sizes.join(names.select(F.col("topic").cast("bigint").alias("Topic"), "Name"), "Topic", "left")
    return named.select("Topic", "Name", "Count").orderBy(F.desc("Count"), "Topic")


def _gram(vectors: DataFrame, size: int, left: int, right: int) -> DataFrame:
    """Sum over terms of the outer products of one pair of topic blocks.

    Each task keeps one block of at most GRAM_BLOCK² sums and emits it once, so no pairs are written per term.
    """
    n_left, n_right = min(GRAM_BLOCK, size - left), min(GRAM_BLOCK, size - right)

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_left, n_right))
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start:start + 1000]
                rows = np.repeat(np.arange(len(part)), part["topics"].map(len))
                columns = np.concatenate(part["topics"].to_numpy())
                values = np.concatenate(part["weights"].to_numpy())
                dense = [np.zeros((len(part), n)) for n in (n_left, n_right)]
                for matrix, low, n in zip(dense, (left, right), (n_left, n_right)):
                    inside = (columns >= low) & (columns < low + n)
                    matrix[rows[inside], columns[inside] - low] = values[inside]
                total += dense[0].T @ dense[1]
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i + left, "j": j + right, "v": total[i, j]})

    partial = vectors.mapInPandas(accumulate, "i int, j int, v double")
    return partial.groupBy("i", "j").agg(F.sum("v").alias("v"))


def topic_similarity(weights: DataFrame) -> DataFrame:
    """Cosine between the weight vectors of all topics, long form (topic_a, topic_b, cosine).

    The weights are read several times, so they are written once.
    """
    weights = cut_lineage(weights)
    norms = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    norms = cut_lineage(dense_index(norms, "topic", "n").withColumn("i", F.col("n").cast("int")).drop("n"))
    index, count = norms.select("i", "topic"), norms.count()
    unit = weights.join(broadcast_if_small(norms), "topic")
    vectors = unit.groupBy("term").agg(
        F.collect_list("i").alias("topics"), F.collect_list(F.col("weight") / F.col("norm")).alias("weights")
    )
    vectors = cut_lineage(vectors)
    starts = range(0, max(count, 1), GRAM_BLOCK)
    gram = reduce(DataFrame.unionByName, [_gram(vectors, count, a, b) for a in starts for b in starts])
    named = index
    return (
        gram.join(named.withColumnRenamed("topic", "topic_a"), "i")
        .join(named.select(F.col("i").alias("j"), F.col("topic").alias("topic_b")), "j")
        .select("topic_a", "topic_b", F.col("v").alias("cosine"))
    )


def _merges(docs: DataFrame, topic: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(merges in order, sizes of the topics); the outlier topic takes no part."""
    sizes = docs.where(quoted(topic).isNotNull()).groupBy(quoted(topic).cast("bigint").alias("topic")).count()
    sizes = written(sizes.where(F.col("topic") != OUTLIERS))
    steps = merging.merge_steps(topic_similarity(class_tfidf(term_counts(docs, topic, text))), sizes)
    return written(merging.ordered(steps)), sizes


def reduce_topics(docs: DataFrame, target: int = 50, topic: str = "Topic", text: str = "text") -> DataFrame:
    """Merge similar topics until at most ``target`` are left; documents get the new number, 0 for the largest topic."""
    steps, known = _merges(docs, topic, text)
    roots = merging.cut(steps, known, known.count() - max(1, target))
    merged = roots.join(known, "topic")
    ranks = merged.groupBy("root").agg(F.sum("count").alias("n"))
    number = (F.row_number().over(Window.orderBy(F.desc("n"), "root")) - 1).cast("bigint")  # one row per topic
    table = merged.join(ranks.select("root", number.alias("__to")), "root").select(F.col("topic").alias("__from"), "__to")
    # One row per topic.
    joined = docs.join(broadcast_if_small(table), quoted(topic) == F.col("__from"), "left")
    fixed = F.when(quoted(topic) == OUTLIERS, F.lit(OUTLIERS).cast("bigint")).otherwise(F.col("__to"))
    return joined.withColumn(topic, fixed).drop("__from", "__to")


def topic_hierarchy(docs: DataFrame, topic: str = "Topic", text: str = "text") -> DataFrame:
    """Merge list down to one topic: (step, topic_a, topic_b, similarity, size)."""
    steps, _ = _merges(docs, topic, text)
    return steps.select("step", "topic_a", "topic_b", "similarity", "size")


def number_by_size(assigned: DataFrame, cluster: str, min_size: int) -> DataFrame:
    """Cluster numbers to topics: 0 for the largest, −1 for clusters under ``min_size``."""
    sizes = assigned.where(F.col(cluster) != OUTLIERS).groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"))
    kept = sizes.where(F.col("__n") >= min_size)
    number = F.row_number().over(Window.orderBy(F.desc("__n"), cluster)) - 1  # one row per cluster
    numbered = broadcast_if_small(kept.select(cluster, number.cast("bigint").alias("Topic")))
    return assigned.drop("Topic").join(numbered, cluster, "left").withColumn("Topic", F.coalesce("Topic", F.lit(OUTLIERS)))


def clean_corpus(docs: DataFrame, stopwords: list[str], text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """Add ``text clean`` (no stop words) and ``text_demojized`` (emoji spelled out)."""
    cleaned = docs.withColumn("text clean", remove_stopwords(quoted(text), stopwords))
    return cleaned.withColumn("text_demojized", demojize(names)(quoted("text clean")))


def embed_words(docs: DataFrame, text: str = "text", dims: int = 50, min_count: int = 5, seed: int = 42) -> DataFrame:
    """Add ``embedding``: the mean word vector of each text, for corpora that come without embeddings."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    tokenized = docs.withColumn("__t", tokens(F.coalesce(quoted(text), F.lit(""))))
    model = Word2Vec(vectorSize=dims, minCount=min_count, seed=seed, inputCol="__t", outputCol="__v").fit(tokenized)
    return model.transform(tokenized).withColumn("embedding", vector_to_array("__v")).drop("__t", "__v")


def _reduced(docs: DataFrame, embedding: str, dims: int) -> DataFrame:
    """Unit vectors on their first principal components, as column ``__p``."""
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector

    prepared = docs.withColumn("__v", array_to_vector(quoted(embedding).cast("array<double>")))
    unit = Normalizer(inputCol="__v", outputCol="__u").transform(prepared)
    return PCA(k=dims, inputCol="__u", outputCol="__p").fit(unit).transform(unit).drop("__v", "__u")


def topics_from_embeddings(
    docs: DataFrame, embedding: str = "embedding", k: int = 20, dims: int = 5, min_size: int = 15, seed: int = 42
) -> DataFrame:
    """Unit vectors, PCA, K-means; adds ``Topic`` and ``Probability`` (closeness to the centre of the topic)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array

    reduced = _reduced(docs, embedding, dims)
    model = KMeans(k=k, seed=seed, featuresCol="__p", predictionCol="__c").fit(reduced)
    centres = np.array(model.clusterCenters())

    @F.pandas_udf("double")
    def closeness(points: pd.Series) -> pd.Series:
        matrix = np.stack(points.to_numpy()) if len(points) else np.zeros((0, centres.shape[1]))
        distance = ((matrix[:, None, :] - centres[None]) ** 2).sum(axis=2)
        inverse = 1.0 / np.maximum(distance, 1e-12)
        return pd.Series(inverse.max(axis=1) / inverse.sum(axis=1))

    scored = model.transform(reduced).withColumn("Probability", closeness(vector_to_array("__p")))
    return number_by_size(scored, "__c", min_size).drop("__p", "__c")


def topics_by_density(
    docs: DataFrame, key: str, eps: float, embedding: str = "embedding", dims: int = 2, min_samples: int = 5,
    min_size: int = 15,
) -> DataFrame:
    """Unit vectors, PCA, density clusters; noise and small clusters are the outlier topic.

    ``Probability`` is 1 for a core document, one half for a document at the border of a topic, 0 for an outlier.
    """
    from pyspark.ml.functions import vector_to_array

    reduced = _reduced(docs, embedding, dims).withColumn("__a", vector_to_array("__p"))
    columns = [f"__x{i}" for i in range(dims)]
    points = cut_lineage(reduced.select(quoted(key), *[F.get("__a", F.lit(i)).alias(c) for i, c in enumerate(columns)]))
    found = dbscan(points, columns, key, eps, min_samples)
    numbered = number_by_size(docs.join(found, key), "cluster", min_size)
    inside = F.when(F.col("Topic") == OUTLIERS, 0.0).when(F.col("is_core"), 1.0).otherwise(0.5)
    return numbered.withColumn("Probability", inside).drop("cluster", "is_core")


def unit_vector(vector: Column) -> Column:
    """The vector over its length; null where that is 0.

    The length comes in as a variable: written into the inner function, it would be summed anew for every number of a vector.
    """
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v))
    scaled = F.transform(F.array(length), lambda n: F.when(n > 0, F.transform(vector.cast("array<double>"), lambda v: v / n)))
    return F.get(scaled, F.lit(0))


def topics_by_stability(
    docs: DataFrame, key: str, embedding: str = "embedding", min_size: int = 15, min_samples: int = 5, neighbours: int = 15, seed: int = 42
) -> DataFrame:
    """Topics of varying density in the whole embedding space: adds ``Topic`` (−1 for outliers) and ``Probability``.

    Unit vectors are clustered by the stability of the branches of their density tree (see ``varying_density``); the
    largest topic is 0. Documents without a usable embedding are outliers.
    """
    unit = docs.select(quoted(key), unit_vector(quoted(embedding)).alias("__u"))
    found = varying_density(unit, key, "__u", min_size, min_samples, neighbours, seed=seed)
    found = found.withColumnsRenamed({key: "__key", "probability": "__p"})
    joined = docs.join(found, quoted(key) == F.col("__key"), "left").drop("__key", "Probability")
    numbered = number_by_size(joined.withColumn("cluster", F.coalesce("cluster", F.lit(OUTLIERS).cast("bigint"))), "cluster", min_size)
    return numbered.withColumn("Probability", F.coalesce("__p", F.lit(0.0))).drop("cluster", "__p")


#: Places of hashed terms; a topic model keeps a number for each place and topic on the driver.
HASHED_TERMS = 1 << 18


def topics_from_words(
    docs: DataFrame, text: str = "text", k: int = 10, vocabulary: int = 1 << 14, min_size: int = 15,
    iterations: int = 10, seed: int = 42,
) -> DataFrame:
    """Bag-of-words topics by LDA; ``Probability`` is the share of the leading topic.

    Every term counts: up to ``vocabulary`` terms have a place each, more are hashed into HASHED_TERMS places.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, HashingTF
    from pyspark.ml.functions import vector_to_array

    tokenized = docs.withColumn("__t", tokens(F.coalesce(quoted(text), F.lit(""))))
    counter = CountVectorizer(inputCol="__t", outputCol="__f", vocabSize=vocabulary + 1).fit(tokenized)
    if len(counter.vocabulary) > vocabulary:
        counter = HashingTF(inputCol="__t", outputCol="__f", numFeatures=HASHED_TERMS)
    # Every iteration reads the counts; without this each would cut all texts into words again.
    counted = written(counter.transform(tokenized).drop("__t"))
    model = LDA(k=k, maxIter=iterations, seed=seed, featuresCol="__f", topicDistributionCol="__d").fit(counted.select("__f"))
    shares = model.transform(counted).withColumn("__a", vector_to_array("__d"))
    leading = shares.withColumns(
        {"Probability": F.array_max("__a"), "__c": (F.array_position("__a", F.array_max("__a")) - 1).cast("int")}
    )
    # The sizes and the rows both read what the model says of every text; stored, it says so once.
    return number_by_size(written(leading.drop("__f", "__d", "__a")), "__c", min_size).drop("__c")


@F.pandas_udf(MapType(StringType(), LongType()))
def _counted(words: pd.Series) -> pd.Series:
    return words.map(lambda row: None if row is None else dict(Counter(row)))


#: Terms of topics whose weights go to all tasks.
FREQUENT = BROADCAST_ROWS


def with_closeness(
    docs: DataFrame, key: str, text: str = "text", topic: str = "Topic", column: str = "Probability", frequent: int = FREQUENT
) -> DataFrame:
    """Add how close each document is to its own topic: the cosine of both in the class-based TF-IDF space.

    The topic's vector holds its term weights, the document's its term counts times the same inverse frequencies. The words
    of a row are counted where the row is, and the weights of the most frequent terms go to them; shuffled are the words of
    rows that repeat a key, rarer terms, and one pair of sums per document, never texts. Rounded to nine digits, so equal texts tie whatever order their words were added in. A document without a topic or
    without words has null; rows that repeat a key within a topic count as one document.
    """
    inner = docs.select(quoted(key).alias("__key"), quoted(topic).alias("topic"), quoted(text).alias("__text"))
    inner = inner.where("topic is not null")
    weights = written(class_tfidf(term_counts(inner, "topic", "__text")))
    norms = broadcast_if_small(weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("__norm")))
    shared = inner.groupBy("__key", "topic").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("__key", "topic")
    shared = written(shared)
    alone, together = inner, None
    if not shared.isEmpty():
        alone, together = (null_safe_join(inner, shared, ["__key", "topic"], how) for how in ("left_anti", "left_semi"))
    counted = alone.select("__key", "topic", F.explode(_counted(tokens(F.col("__text")))).alias("term", "n"))
    if together is not None:
        terms = together.select("__key", "topic", F.explode(tokens(F.col("__text"))).alias("term"))
        counted = counted.union(terms.groupBy("__key", "topic", "term").agg(F.count(F.lit(1)).alias("n")))
    if weights.count() <= frequent:
        parts = [counted.join(F.broadcast(weights), ["topic", "term"])]
    else:
        hot = written(weights.orderBy(F.desc("tf"), "topic", "term").limit(frequent))
        rest = weights.join(F.broadcast(hot.select("topic", "term")), ["topic", "term"], "left_anti")
        rare = counted.join(F.broadcast(hot.select("topic", "term")), ["topic", "term"], "left_anti")
        parts = [counted.join(F.broadcast(hot), ["topic", "term"]), rare.join(rest, ["topic", "term"])]
    own = F.col("n") * F.col("weight") / F.col("tf")
    sums = (
        reduce(DataFrame.unionByName, [p.select("__key", "topic", own.alias("own"), "weight") for p in parts])
        .groupBy("__key", "topic")
        .agg(F.sum(F.col("own") * F.col("weight")).alias("__dot"), F.sqrt(F.sum(F.col("own") ** 2)).alias("__length"))
        .join(norms, "topic")
    )
    close = sums.select(
        "__key", F.col("topic").alias("__topic"),
        F.round(F.col("__dot") / F.nullif(F.col("__length") * F.col("__norm"), F.lit(0.0)), 9).alias(column),
    )
    match = (quoted(key).eqNullSafe(F.col("__key"))) & (quoted(topic) == F.col("__topic"))
    return docs.join(close, match, "left").drop("__key", "__topic")


def representatives(docs: DataFrame, key: str, n: int = 3, topic: str = "Topic", probability: str = "Probability") -> DataFrame:
    """(topic, place, key, probability): the n documents closest to each topic; ties by key."""
    w = Window.partitionBy(quoted(topic)).orderBy(quoted(probability).desc_nulls_last(), quoted(key))
    ranked = docs.where(quoted(topic).isNotNull()).select(
        quoted(topic), F.row_number().over(w).alias("place"), quoted(key), quoted(probability)
    )
    return ranked.where(F.col("place") <= n)


def document_info(
    docs: DataFrame, words: DataFrame, key: str, text: str = "text", topic: str = "Topic",
    probability: str = "Probability", representatives: int = 3,
) -> DataFrame:
    """Per document: topic name, words, probability, whether it represents its topic, and the representatives.

    Documents that come without a probability get their closeness to the topic.
    """
    if probability not in docs.columns:
        docs = with_closeness(docs, key, text, topic, probability)
    names = topic_names(words).withColumn("Top_n_words", F.concat_ws(" - ", "Representation"))
    names = names.withColumnRenamed("topic", "__topic")
    w = Window.partitionBy(quoted(topic)).orderBy(quoted(probability).desc_nulls_last(), quoted(key))
    best = (
        docs.select(quoted(topic).alias("__topic"), quoted(key).alias("__key"), quoted(text).alias("__text"), F.row_number().over(w).alias("__r"))
        .where(F.col("__r") <= representatives)
    )
    listed = best.groupBy("__topic").agg(F.array_sort(F.collect_list(F.struct("__r", "__text"))).alias("__d")).select(
        "__topic", F.transform("__d", lambda d: d["__text"]).alias("Representative_Docs")
    )
    topics = names.join(listed, "__topic", "left")
    flags = best.select(F.col("__key").alias(key), F.lit(True).alias("Representative_document"))
    return (
        docs.join(topics, quoted(topic) == F.col("__topic"), "left").drop("__topic")
        .join(flags, key, "left")
        .withColumn("Representative_document", F.coalesce("Representative_document", F.lit(False)))
    )


DEFAULT_PROMPT = "Descreva, em um parágrafo, o que há em comum entre os comentários deste tópico:\n- {documents}"


def topic_prompts(
    docs: DataFrame, key: str, text: str = "text", topic: str = "Topic", samples: int = 10,
    template: str = DEFAULT_PROMPT, seed: int = 42,
) -> DataFrame:
    """(topic, prompt): a template filled with a sample of each topic's documents; none for the outliers."""
    head, _, tail = template.partition("{documents}")
    chosen = sample_per_group(docs.where(quoted(topic) != OUTLIERS), topic, key, samples, seed)
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct(quoted(key).alias("k"), quoted(text).alias("t")))), lambda d: d["t"]
    )
    body = F.array_join(listed, "\n- ")
    return chosen.groupBy(quoted(topic).alias("topic")).agg(
        F.concat(F.lit(head), body, F.lit(tail)).alias("prompt")
    )


def apply_labels(words: DataFrame, labels: DataFrame) -> DataFrame:
    """Put a label (topic, label) in front of the words of its topic, with weight 1; keywords alone otherwise."""
    usable = labels.where(
        F.col("label").isNotNull() & (F.trim("label") != "") & (F.col("topic") != OUTLIERS)
    ).select("topic", F.lit(0).alias("rank"), F.trim("label").alias("term"), F.lit(1.0).alias("weight"))
    return words.unionByName(usable.join(words.select("topic").distinct(), "topic", "left_semi"))
