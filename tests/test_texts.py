import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from engagelake.operators import merging, topics
from engagelake.operators.sentiment import (
    apply_default,
    sentiment_by,
    top_by_class,
    train_default,
    with_sentiment,
)

DOCS = [
    (1, 0, "escola escola professor"), (2, 0, "professor aula escola"), (3, 1, "hospital saude medico"),
    (4, 1, "saude hospital"), (5, 2, "escola aula"), (6, -1, "nada"), (7, -1, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "k long, Topic long, text string")


@pytest.fixture(scope="module")
def words(docs):
    return topics.top_words(topics.class_tfidf(topics.term_counts(docs)), 3)


def test_class_tfidf_by_hand(docs):
    counts = topics.term_counts(docs)
    assert {(r["topic"], r["term"]): r["tf"] for r in counts.collect()}[0, "escola"] == 3
    tokens = sum(len(t.split()) for _, _, t in DOCS)
    got = {(r["topic"], r["term"]): r["weight"] for r in topics.class_tfidf(counts).collect()}
    assert got[0, "escola"] == pytest.approx(3 * np.log(1 + (tokens / 4) / 4))
    share = {(r["topic"], r["term"]): r["weight"] for r in topics.class_tfidf(counts, normalize=True).collect()}
    assert share[0, "escola"] == pytest.approx(got[0, "escola"] / 6)


def test_names_and_labels(words, spark):
    names = {r["topic"]: r for r in topics.topic_names(words, 2).collect()}
    assert names[0]["Name"].startswith("0_") and len(names[0]["Representation"]) == 3
    labels = spark.createDataFrame([(0, " ensino "), (1, ""), (-1, "x"), (9, "y")], "topic long, label string")
    out = topics.apply_labels(words, labels)
    first = {r["topic"]: (r["term"], r["weight"]) for r in out.where("rank = 0").collect()}
    assert first == {0: ("ensino", 1.0)} and out.count() == words.count() + 1


def test_similarity_blocks_agree(docs, monkeypatch):
    weights = topics.class_tfidf(topics.term_counts(docs))
    whole = {(r["topic_a"], r["topic_b"]): r["cosine"] for r in topics.topic_similarity(weights).collect()}
    monkeypatch.setattr(topics, "GRAM_BLOCK", 2)
    split = {(r["topic_a"], r["topic_b"]): r["cosine"] for r in topics.topic_similarity(weights).collect()}
    assert whole == pytest.approx(split) and whole[0, 0] == pytest.approx(1) and whole[0, 2] == whole[2, 0] > 0
    assert (0, 1) not in whole


def test_reduction_merges_the_similar_topics(docs):
    got = {r["k"]: r["Topic"] for r in topics.reduce_topics(docs, 2).collect()}
    assert got[1] == got[2] == got[5] == 0 and got[3] == got[4] == 1 and got[6] == got[7] == -1
    steps = topics.topic_hierarchy(docs).orderBy("step").collect()
    assert [(r["topic_a"], r["topic_b"], r["size"]) for r in steps] == [(0, 2, 3.0), (0, 1, 5.0)]


def brute_merges(pairs, counts):
    """Average linkage, one merge at a time."""
    known = {frozenset(p[:2]): p[2] for p in pairs}
    groups = {t: [t] for t in counts if t != -1}
    out = []
    while len(groups) > 1:
        def mean(a, b):
            whole = sum(counts[x] for x in groups[a]) * sum(counts[y] for y in groups[b])
            return sum(known.get(frozenset((x, y)), 0) * counts[x] * counts[y] for x in groups[a] for y in groups[b]) / whole

        best = max(((mean(a, b), -a, -b) for a in groups for b in groups if a < b))
        a, b = -best[1], -best[2]
        groups[a] += groups.pop(b)
        out.append((a, b, best[0], sum(counts[x] for x in groups[a])))
    return out


@pytest.mark.parametrize("seed, few", [(1, 2048), (2, 2048), (1, 1), (2, 4)])
def test_merges_use_average_linkage(spark, seed, few):
    rng = np.random.default_rng(seed)
    counts = {t: int(rng.integers(1, 20)) for t in range(9)}
    pairs = [(a, b, float(rng.uniform(0.05, 1))) for a in range(7) for b in range(a) if rng.random() < 0.8] + [(7, 8, 0.3), (-1, 2, 0.99), (8, 8, 1.0)]
    both = spark.createDataFrame([*pairs, *[(b, a, c) for a, b, c in pairs]], "topic_a long, topic_b long, cosine double")
    sizes = spark.createDataFrame(list(counts.items()), "topic long, count long")
    steps = merging.ordered(merging.merge_steps(both, sizes, few))
    got = [tuple(r) for r in steps.orderBy("step").select("topic_a", "topic_b", "similarity", "size").collect()]
    want = brute_merges(pairs, counts)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2:] for g in got] == [pytest.approx(w[2:]) for w in want]
    # A cut after any number of merges.
    for made in (0, 3, 8):
        root = {t: t for t in counts}
        for a, b, _, _ in want[:made]:
            root = {t: a if r == b else r for t, r in root.items()}
        assert {r["topic"]: r["root"] for r in merging.cut(steps, sizes, made).collect()} == root


def test_merges_with_ties_and_nothing(spark):
    pairs = [(a, b, [0.5, 0.25][(a + b) % 2]) for a in range(8) for b in range(a)]
    both = spark.createDataFrame([*pairs, *[(b, a, c) for a, b, c in pairs]], "topic_a long, topic_b long, cosine double")
    sizes = spark.createDataFrame([(t, 2) for t in range(8)], "topic long, count long")
    want = sorted(brute_merges(pairs, dict.fromkeys(range(8), 2)))
    for few in (2048, 1):
        got = sorted(tuple(r) for r in merging.merge_steps(both, sizes, few).collect())
        assert got == [pytest.approx(w) for w in want]
    assert merging.merge_steps(both.where("false"), sizes.where("topic < 3")).count() == 2
    assert merging.merge_steps(both.where("false"), sizes.where("false")).count() == 0


def test_two_thousand_topics_merge_in_seconds(spark):
    rng = np.random.default_rng(6)
    n = 2000
    points = rng.normal(size=(n, 12)) + 4 * np.eye(12)[rng.integers(0, 12, n)]
    points /= np.linalg.norm(points, axis=1)[:, None]
    a, b = np.triu_indices(n, 1)
    s = np.maximum((points @ points.T)[a, b], 0)
    weights = rng.integers(1, 50, n)
    start = time.time()
    merges = merging.chain(np.arange(n), weights, a, b, s)
    assert time.time() - start < 20 and len(merges) == n - 1
    # Every merge has the mean similarity of the members, and no pair is nearer than a later merge needs.
    members = {i: [i] for i in range(n)}
    dense = np.zeros((n, n))
    dense[a, b] = dense[b, a] = s
    for x, y, similarity, size in merges:
        p, q = members[x], members.pop(y)
        mean = weights[p] @ dense[np.ix_(p, q)] @ weights[q] / weights[p].sum() / weights[q].sum()
        assert similarity == pytest.approx(mean, abs=1e-9) and size == weights[p].sum() + weights[q].sum()
        members[x] = p + q


def test_document_info(docs, words):
    scored = docs.withColumn("Probability", F.col("k") / 10)
    rows = {r["k"]: r for r in topics.document_info(scored, words, "k", representatives=1).collect()}
    assert len(rows) == len(DOCS)
    assert rows[2]["Representative_document"] and not rows[1]["Representative_document"]
    assert rows[1]["Representative_Docs"] == [DOCS[1][2]] and rows[1]["Name"].startswith("0_")


def test_closeness_shuffles_rare_terms_only(spark):
    """Same values whichever terms travel; words of a row are counted where the row is, those of a repeated key together."""
    rows = [(i % 37 if i % 9 else None, i % 3 if i % 11 else None, " ".join(f"w{(i * j) % 13}" for j in range(i % 17))) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, Topic long, text string")
    seen = [sorted(topics.with_closeness(d, "k", **more).collect(), key=str) for d, more in ((df, {}), (df, {"frequent": 5}), (df.repartition(7), {}))]
    assert seen[0] == seen[1] == seen[2] and sum(r["Probability"] is not None for r in seen[0]) > 40
    plan = topics.with_closeness(df.dropDuplicates(["k"]), "k")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not any("term" in keys for keys in dealt)


def test_closeness_against_brute_force(spark, words):
    rows = [(1, 0, "casa rua casa"), (2, 0, "rua rua porta"), (3, 1, "saude casa"), (4, 0, "casa rua casa"), (5, 0, ""),
            (6, None, "casa rua"), (7, 1, None), (8, 1, "saude saude " * 400 + "medico")]
    df = spark.createDataFrame(rows, "k long, Topic long, text string").withColumn("topic_note", F.lit("x"))
    got = {r["k"]: r["Probability"] for r in topics.with_closeness(df, "k").collect()}
    counts = {}
    for _, t, text in rows:
        for word in (text or "").split() if t is not None else ():
            counts[t, word] = counts.get((t, word), 0) + 1
    mean = sum(counts.values()) / 2
    idf = {w: np.log(1 + mean / sum(n for (_, v), n in counts.items() if v == w)) for _, w in counts}
    for k, t, text in rows:
        if t is None or not text:
            assert got[k] is None
            continue
        vocabulary = sorted(idf)
        whole = np.array([counts.get((t, w), 0) * idf[w] for w in vocabulary])
        own = np.array([text.split().count(w) * idf[w] for w in vocabulary])
        assert got[k] == pytest.approx(own @ whole / np.linalg.norm(own) / np.linalg.norm(whole), abs=1e-9)
    close = topics.with_closeness(df, "k")
    best = [(r["Topic"], r["place"], r["k"]) for r in topics.representatives(close, "k", 2).orderBy("Topic", "place").collect()]
    assert best == [(0, 1, 1), (0, 2, 4), (1, 1, 8), (1, 2, 3)]
    info = {r["k"]: r for r in topics.document_info(df, words, "k", representatives=1).collect()}
    assert len(info) == len(rows) and info[1]["Representative_document"] and not info[4]["Representative_document"]
    assert topics.with_closeness(df.limit(0), "k").count() == 0


def test_sizes_and_prompts(docs, words):
    sizes = topics.topic_sizes(docs, topics.topic_names(words)).collect()
    assert sum(r["Count"] for r in sizes) == len(DOCS) and sizes[0]["Count"] == 2
    prompts = {r["topic"]: r["prompt"] for r in topics.topic_prompts(docs, "k", samples=1, template="<{documents}>").collect()}
    assert set(prompts) == {0, 1, 2} and prompts[2] == "<escola aula>"
    two = {r["topic"]: r["prompt"] for r in topics.topic_prompts(docs, "k").collect()}
    assert two[1].endswith("- hospital saude medico\n- saude hospital")


def test_topics_from_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(6)[:3] * 5
    rows = [(i, [float(v) for v in centres[i % 3] + rng.normal(size=6) * 0.05]) for i in range(60)]
    rows += [(100, [0.0, 0.0, 0.0, 0.0, 0.0, -5.0])]
    df = spark.createDataFrame(rows, "k long, embedding array<double>")
    got = topics.topics_from_embeddings(df, k=4, dims=3, min_size=5).collect()
    sizes = pd.Series([r["Topic"] for r in got]).value_counts().to_dict()
    assert sizes == {0: 20, 1: 20, 2: 20, -1: 1} and all(0 < r["Probability"] <= 1 for r in got)


def test_topics_by_density(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(5)[:2] * 3
    rows = [(i, [float(v) for v in centres[i % 2] + rng.normal(size=5) * 0.01]) for i in range(40)]
    rows += [(100, [0.0, 0.0, -3.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, embedding array<double>")
    got = topics.topics_by_density(df, "k", eps=0.2, min_size=5).collect()
    assert pd.Series([r["Topic"] for r in got]).value_counts().to_dict() == {0: 20, 1: 20, -1: 1}
    assert {r["Probability"] for r in got if r["Topic"] >= 0} == {1.0}


def test_word_vectors_and_clean_corpus(docs):
    embedded = topics.embed_words(docs, dims=3, min_count=1).collect()
    assert all(len(r["embedding"]) == 3 for r in embedded)
    row = topics.clean_corpus(docs.where("k = 1").withColumn("text", F.lit("A escola 😂 de")), ["a", "de"]).first()
    assert (row["text clean"], row["text_demojized"]) == ("escola 😂", "escola :face_with_tears_of_joy:")


def test_topics_from_words_count_rare_terms(spark):
    rows = [(i, "alpha beta gamma delta") for i in range(10)] + [(10 + i, f"rare{i} seldom{i}") for i in range(5)]
    got = topics.topics_from_words(spark.createDataFrame(rows, "id long, text string"), k=2, vocabulary=4, min_size=1, iterations=2).collect()
    assert len(got) == len(rows) and all(r["Probability"] > 0 for r in got)


def test_topics_from_words_cut_texts_and_ask_the_model_once(spark, monkeypatch):
    """What the model fits on is stored, and so is what it says of the texts: the result reads no text again."""
    stored = []
    monkeypatch.setattr(topics, "written", lambda df, w=topics.written: stored.append(df.columns) or w(df))
    rows = [(i, " ".join(f"w{i % 2}{j}" for j in range(8))) for i in range(20)]
    got = topics.topics_from_words(spark.createDataFrame(rows, "id long, text string"), k=2, min_size=1, iterations=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert stored == [["id", "text", "__f"], ["id", "text", "Probability", "__c"]]
    assert "UDF" not in plan and "LocalTableScan" not in plan and got.columns == ["id", "text", "Probability", "Topic"]


def test_topics_from_words(docs):
    got = topics.topics_from_words(docs, k=2, min_size=1, iterations=3).collect()
    assert len(got) == len(DOCS) and {r["Topic"] for r in got} <= {0, 1}


def test_scorer_gives_null_pairs(spark):
    def load():
        def predict(batch):
            if any("falha" in t for t in batch):
                raise RuntimeError("model error")
            return [("Positive" if "bom" in t else "Negative", 0.9) for t in batch]

        return predict

    df = spark.createDataFrame([(1, "bom"), (2, "ruim"), (3, None), (4, "  "), (5, "falha")], "k int, text string").coalesce(1)
    got = {r["k"]: (r["sentiment_label"], r["sentiment_score"]) for r in with_sentiment(df, load).collect()}
    assert got == {1: ("positive", 0.9), 2: ("negative", 0.9), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_default_model(spark):
    rows = [(f"muito bom {i}", "positive") for i in range(20)] + [(f"muito ruim {i}", "negative") for i in range(20)]
    df = spark.createDataFrame(rows, "text string, label string")
    model = train_default(df, label="label")
    scored = apply_default(model, df.union(spark.createDataFrame([(None, None), (" ", None)], df.schema)))
    assert scored.where("sentiment_label = label").count() == 40
    assert scored.where("sentiment_label IS NULL AND sentiment_score IS NULL").count() == 2


def test_sentiment_percentages(spark):
    rows = [("a", "Positive")] * 3 + [("a", "negative"), ("a", "neutral")] + [("b", "positive")] + [("a", None)]
    df = spark.createDataFrame(rows, "who string, sentiment_label string")
    got = {r["who"]: r for r in sentiment_by(df, "who").collect()}
    assert (got["a"]["% positive"], got["a"]["Qtd Comentários"]) == (60.0, 5) and got["b"]["% positive"] is None
    filled = sentiment_by(df, "who", fill=0)
    assert [r["who"] for r in top_by_class(filled, "who", "positive").collect()] == ["b", "a"]
