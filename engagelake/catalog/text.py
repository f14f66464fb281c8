"""Text functions, sentiment and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from engagelake.catalog.registry import SCORED, query, rounded
from engagelake.functions.text import EMOJI_BLOCKS, default_stopwords, demojize, remove_stopwords, tokens
from engagelake.operators import topics
from engagelake.operators.frequency import collect_per_group, sample_per_group
from engagelake.operators.sentiment import apply_default, train_default, with_sentiment
from engagelake.sources.adapters import scored_comments, table

# The corpus has four languages; a short list that touches three of them keeps the SQL twin readable.
STOPS = ["the", "and", "of", "de", "que", "la", "und", "der", "die", "to", "in", "a", "o", "e"]
_STOP_LIST = ", ".join(f"'{w}'" for w in STOPS)
_TOKEN = r"[\p{L}\p{N}_]{2,}|[" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in EMOJI_BLOCKS) + "]"


def corpus(spark, folder):
    """Documents with their language as topic 0…3."""
    docs = table(spark, folder, "documents")
    languages = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    return docs.withColumn("Topic", F.array_position(languages, F.col("lang")) - 1)


_TOPIC = "list_position(['de', 'en', 'es', 'fr'], lang) - 1"
_TERMS = f"""
terms AS (SELECT CAST({_TOPIC} AS BIGINT) AS topic, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM documents),
counts AS (SELECT topic, term, count(*) AS tf FROM terms GROUP BY 1, 2),
weights AS (SELECT topic, term, tf,
              tf * ln(1 + (SELECT sum(tf) / count(DISTINCT topic) FROM counts) / sum(tf) OVER (PARTITION BY term)) AS weight
            FROM counts),
words AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank, term, weight FROM weights)"""


@query("stopwords_removed", f"""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'),
       lambda w: w <> '' AND NOT list_contains([{_STOP_LIST}], lower(w))), ' ') AS clean FROM documents""")
def _stops(spark, folder):
    return table(spark, folder, "documents").select("doc_id", remove_stopwords(F.col("text"), STOPS).alias("clean"))


@query("clean_corpus", f"""
WITH c AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'),
       lambda w: w <> '' AND NOT list_contains([{_STOP_LIST}], lower(w))), ' ') AS clean FROM documents)
SELECT doc_id, clean AS "text clean", clean AS text_demojized FROM c""")
def _corpus(spark, folder):
    cleaned = topics.clean_corpus(table(spark, folder, "documents"), STOPS)
    return cleaned.select("doc_id", "`text clean`", "text_demojized")


_SHIPPED = ", ".join(f"'{w}'" for w in default_stopwords())


@query("default_stopwords_removed", f"""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'),
       lambda w: w <> '' AND NOT list_contains([{_SHIPPED}], lower(w))), ' ') AS clean FROM documents""")
def _default_stops(spark, folder):
    return table(spark, folder, "documents").select("doc_id", remove_stopwords(F.col("text"), default_stopwords()).alias("clean"))


@query("emoji_names", """
SELECT conv_id, turn, replace(text, chr(128514), ':face_with_tears_of_joy:') || ':face_with_tears_of_joy:'
       || ':rolling_on_the_floor_laughing:' || ':smiling_face_with_hearts:' || ':red_heart:' || ':flag_br:' || ':white_medium_star:' AS body
FROM conversations""")
def _emoji(spark, folder):
    laughing = F.concat("text", F.lit("\U0001F602\U0001F923\U0001F970\u2764\ufe0f\U0001F1E7\U0001F1F7\u2b50"))
    return table(spark, folder, "conversations").select("conv_id", "turn", demojize()(laughing).alias("body"))


@query("tokens", f"""
SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{_TOKEN}')) AS INTEGER) AS n,
       regexp_extract_all(lower(text), '{_TOKEN}')[1] AS first_token FROM documents""")
def _tokens(spark, folder):
    found = table(spark, folder, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").alias("n"), F.get("t", F.lit(0)).alias("first_token"))


@query("term_counts", f"WITH {_TERMS} SELECT topic, term, tf FROM counts")
def _counts(spark, folder):
    return topics.term_counts(corpus(spark, folder))


@query("class_tfidf", f"WITH {_TERMS} SELECT topic, term, tf, round(weight, 6) + 0.0 AS weight FROM weights")
def _ctfidf(spark, folder):
    return rounded(topics.class_tfidf(topics.term_counts(corpus(spark, folder))), 6, "weight")


def _words(spark, folder, n=10):
    return topics.top_words(topics.class_tfidf(topics.term_counts(corpus(spark, folder))), n)


@query("top_words", f"WITH {_TERMS} SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM words WHERE rank <= 10")
def _top_words(spark, folder):
    return rounded(_words(spark, folder), 6, "weight")


_NAMES = """
names AS (SELECT topic, CAST(topic AS VARCHAR) || '_' || string_agg(term, '_' ORDER BY rank) AS name FROM words WHERE rank <= 4 GROUP BY 1)"""


@query("topic_names", f"WITH {_TERMS}, {_NAMES} SELECT topic, name AS \"Name\" FROM names")
def _names(spark, folder):
    return topics.topic_names(_words(spark, folder)).select("topic", "Name")


@query("topic_sizes", f"""
WITH {_TERMS}, {_NAMES}, sizes AS (SELECT CAST({_TOPIC} AS BIGINT) AS topic, count(*) AS n FROM documents GROUP BY 1)
SELECT topic AS "Topic", name AS "Name", n AS "Count" FROM sizes LEFT JOIN names USING (topic)""")
def _sizes(spark, folder):
    return topics.topic_sizes(corpus(spark, folder), topics.topic_names(_words(spark, folder)))


def sourced(spark, folder):
    """Documents with their source as one of twenty topics."""
    return table(spark, folder, "documents").withColumn("Topic", F.expr("substring(source, 4)").cast("bigint"))


_SOURCE_TERMS = _TERMS.replace(_TOPIC, "substr(source, 4)")


@query("topic_similarity", f"""
WITH {_SOURCE_TERMS}, norms AS (SELECT topic, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY 1)
SELECT a.topic AS topic_a, b.topic AS topic_b,
       round(sum(a.weight * b.weight) / any_value(m.norm) / any_value(n.norm), 6) + 0.0 AS cosine
FROM weights a JOIN weights b USING (term) JOIN norms m ON m.topic = a.topic JOIN norms n ON n.topic = b.topic
GROUP BY 1, 2""")
def _similarity(spark, folder):
    weights = topics.class_tfidf(topics.term_counts(sourced(spark, folder)))
    return rounded(topics.topic_similarity(weights), 6, "cosine")


# One merge of the nearest two groups per step, from the similarities of all their topics.
_MERGES = f"""
WITH RECURSIVE {_SOURCE_TERMS.strip()},
norms AS (SELECT topic, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY 1),
alike AS MATERIALIZED (
  SELECT CAST(a.topic AS BIGINT) AS x, CAST(b.topic AS BIGINT) AS y, sum(a.weight * b.weight) / any_value(m.norm) / any_value(n.norm) AS s
  FROM weights a JOIN weights b USING (term) JOIN norms m ON m.topic = a.topic JOIN norms n ON n.topic = b.topic WHERE a.topic <> b.topic GROUP BY 1, 2),
sized AS MATERIALIZED (SELECT CAST(substr(source, 4) AS BIGINT) AS topic, count(*) AS n FROM documents GROUP BY 1),
state(step, topic, grp, n, a, b, s) AS (
  SELECT 0, topic, topic, n, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM sized
  UNION ALL
  SELECT w.step + 1, w.topic, CASE WHEN w.grp = best.b THEN best.a ELSE w.grp END, w.n, best.a, best.b, best.s
  FROM state w,
       (SELECT p.grp AS a, q.grp AS b, sum(coalesce(l.s, 0) * p.n * q.n) / sum(p.n * q.n) AS s
        FROM state p JOIN state q ON p.grp < q.grp LEFT JOIN alike l ON l.x = p.topic AND l.y = q.topic
        GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1) best),
steps AS MATERIALIZED (SELECT CAST(step - 1 AS BIGINT) AS step, any_value(a) AS topic_a, any_value(b) AS topic_b, any_value(s) AS similarity,
                 CAST(sum(n) FILTER (grp = a) AS DOUBLE) AS size FROM state WHERE step > 0 GROUP BY step)"""


@query("reduced_topics", f"""{_MERGES},
groups AS (SELECT topic, grp, sum(n) OVER (PARTITION BY grp) AS whole FROM state WHERE step = greatest((SELECT count(*) FROM sized) - 8, 0)),
numbers AS (SELECT grp, row_number() OVER (ORDER BY whole DESC, grp) - 1 AS number FROM (SELECT DISTINCT grp, whole FROM groups))
SELECT doc_id, number AS "Topic" FROM documents JOIN groups ON topic = CAST(substr(source, 4) AS BIGINT) JOIN numbers USING (grp)""")
def _reduced(spark, folder):
    return topics.reduce_topics(sourced(spark, folder), 8).select("doc_id", "Topic")


@query("topic_hierarchy", f"""{_MERGES}
SELECT step, topic_a, topic_b, round(similarity, 6) + 0.0 AS similarity, size FROM steps""")
def _hierarchy(spark, folder):
    return rounded(topics.topic_hierarchy(sourced(spark, folder)), 6, "similarity")


@query("document_info", f"""
WITH {_TERMS}, {_NAMES},
ten AS (SELECT topic, string_agg(term, ' - ' ORDER BY rank) AS tops FROM words WHERE rank <= 10 GROUP BY 1),
d AS (SELECT doc_id, CAST({_TOPIC} AS BIGINT) AS topic, (doc_id * 7919 % 1000) / 1000.0 AS probability FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY probability DESC, doc_id) AS place FROM d)
SELECT doc_id, topic AS "Topic", name AS "Name", tops AS "Top_n_words", probability AS "Probability",
       place <= 3 AS "Representative_document"
FROM r LEFT JOIN names USING (topic) LEFT JOIN ten USING (topic)""")
def _document_info(spark, folder):
    docs = corpus(spark, folder).withColumn("Probability", (F.col("doc_id") * 7919 % 1000) / F.lit(1000.0))
    info = topics.document_info(docs, _words(spark, folder), "doc_id")
    return info.select("doc_id", "Topic", "Name", "Top_n_words", "Probability", "Representative_document")


_CLOSE = f"""
{_TERMS},
owned AS (SELECT doc_id, CAST({_TOPIC} AS BIGINT) AS topic, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM documents),
per AS (SELECT doc_id, topic, term, count(*) AS n FROM owned WHERE topic IS NOT NULL GROUP BY 1, 2, 3),
norm AS (SELECT topic, sqrt(sum(weight * weight)) AS whole FROM weights GROUP BY 1),
close AS (SELECT doc_id, p.topic, round(sum(n * weight / tf * weight) / sqrt(sum((n * weight / tf) ** 2)) / any_value(whole), 9) AS close
          FROM per p JOIN weights w ON w.topic = p.topic AND w.term = p.term JOIN norm m ON m.topic = p.topic GROUP BY 1, 2)"""


@query("document_closeness", f"""
WITH {_CLOSE}
SELECT d.doc_id, CAST({_TOPIC} AS BIGINT) AS "Topic", round(close, 6) + 0.0 AS "Probability"
FROM documents d LEFT JOIN close c ON c.doc_id = d.doc_id""")
def _closeness(spark, folder):
    return rounded(topics.with_closeness(corpus(spark, folder), "doc_id").select("doc_id", "Topic", "Probability"), 6, "Probability")


@query("representative_documents", f"""
WITH {_CLOSE}, placed AS (
  SELECT CAST({_TOPIC} AS BIGINT) AS topic, d.doc_id, close FROM documents d LEFT JOIN close c ON c.doc_id = d.doc_id WHERE lang IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY close DESC NULLS LAST, doc_id) AS place FROM placed)
SELECT topic AS "Topic", CAST(place AS INTEGER) AS place, doc_id, round(close, 6) + 0.0 AS "Probability" FROM r
WHERE place <= 3 AND topic IS NOT NULL""")
def _representatives(spark, folder):
    close = topics.with_closeness(corpus(spark, folder), "doc_id")
    return rounded(topics.representatives(close, "doc_id"), 6, "Probability")


@query("labelled_topics", f"""
WITH {_TERMS}
SELECT topic, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM words WHERE rank <= 10
UNION ALL SELECT CAST(t AS BIGINT), 0, 'tema ' || CAST(t AS VARCHAR), 1.0 FROM range(3) r(t)""")
def _labelled(spark, folder):
    labels = corpus(spark, folder).select("Topic").distinct().select(
        F.col("Topic").alias("topic"),
        F.when(F.col("Topic") < 3, F.concat(F.lit("tema "), F.col("Topic").cast("string"))).alias("label"),
    )
    return rounded(topics.apply_labels(_words(spark, folder), labels), 6, "weight")


_SAMPLE = f"""
picked AS (
  SELECT CAST({_TOPIC} AS BIGINT) AS topic, doc_id, text FROM documents
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) <= 10)"""
_HEAD = topics.DEFAULT_PROMPT.partition("{documents}")[0].replace("'", "''")


@query("topic_prompts", f"""
WITH {_SAMPLE.strip()} SELECT topic, '{_HEAD}' || string_agg(text, chr(10) || '- ' ORDER BY doc_id) AS prompt FROM picked GROUP BY 1""")
def _prompts(spark, folder):
    return topics.topic_prompts(corpus(spark, folder), "doc_id")


@query("sampled_per_topic", f"""WITH {_SAMPLE.strip()} SELECT topic AS "Topic", doc_id FROM picked""")
def _sampled(spark, folder):
    return sample_per_group(corpus(spark, folder), "Topic", "doc_id").select("Topic", "doc_id")


@query("documents_per_topic", f"""
SELECT CAST({_TOPIC} AS BIGINT) AS "Topic", count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents GROUP BY 1""")
def _collected(spark, folder):
    parts = collect_per_group(corpus(spark, folder), "Topic", "text", "doc_id", chunk=100)
    chars = F.aggregate("values", F.lit(None).cast("bigint"), lambda n, t: F.coalesce(n + F.length(t), n, F.length(t).cast("bigint")))
    return parts.groupBy("Topic").agg(
        F.sum(F.size("values")).alias("documents"), F.sum(chars).alias("n_chars")
    )


def _length_model():
    """A stand-in model: short texts are positive, long ones negative, by their whole length."""

    def predict(texts):
        return [("Positive" if len(t) < 500 else "Negative", 1.0 / (1 + len(t))) for t in texts]

    return predict


@query("scored_by_model", """
SELECT doc_id, CASE WHEN length(text) < 500 THEN 'positive' ELSE 'negative' END AS sentiment_label,
       round(1.0 / (1 + length(text)), 9) AS sentiment_score FROM documents""")
def _scored(spark, folder):
    scored = with_sentiment(table(spark, folder, "documents"), _length_model)
    return rounded(scored.select("doc_id", "sentiment_label", "sentiment_score"), 9, "sentiment_score")


@query("scored_by_default_model")
def _default(spark, folder):
    comments = scored_comments(spark, folder).withColumnRenamed("sentiment_label", "label")
    model = train_default(comments, label="label")
    return apply_default(model, comments).groupBy("sentiment_label").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("sentiment_score"), 3).alias("mean_score")
    )


@query("topics_from_words")
def _lda(spark, folder):
    return topics.topics_from_words(table(spark, folder, "documents"), k=6, min_size=5, iterations=5).groupBy("Topic").agg(
        F.count(F.lit(1)).alias("Count")
    )


@query("topics_from_embeddings")
def _embedded(spark, folder):
    found = topics.topics_from_embeddings(table(spark, folder, "embeddings"), k=10)
    return found.groupBy("Topic").agg(F.count(F.lit(1)).alias("Count"), F.round(F.avg("Probability"), 3).alias("p"))


@query("topics_by_density")
def _dense(spark, folder):
    found = topics.topics_by_density(table(spark, folder, "embeddings"), "vec_id", eps=0.05, min_samples=5)
    return found.groupBy("Topic").agg(F.count(F.lit(1)).alias("Count"))


@query("sentiment_table", f"""
WITH {SCORED}
SELECT id_reel, id_comment, text, "inputUrl", "repliesCount", "likesCount", sentiment_label,
       CAST(NULL AS DOUBLE) AS sentiment_score, CAST(NULL AS DOUBLE) AS "Topic", CAST(NULL AS VARCHAR) AS "Name",
       'r1' AS _run_id FROM scored""")
def _table(spark, folder):
    from engagelake.operators.gold import sentiment_table

    gold = sentiment_table(scored_comments(spark, folder), "r1").drop("_generated_at")
    return gold.withColumn("Topic", F.col("Topic").cast("double"))


@query("topics_by_stability")
def _stability(spark, folder):
    """Topic and probability of every embedding, from density topics in the whole space."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topics.topics_by_stability(vectors, "vec_id").select("vec_id", "Topic", F.round("Probability", 6).alias("Probability"))
