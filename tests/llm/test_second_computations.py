"""Second computations of fingerprints, the language model, set digests, and odd rows of single operators."""

import hashlib
import math
import os
import random
import struct

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from engagelake.llm import fingerprints, language, minhash, packing, shingles, tokens
from engagelake.llm.common import QUERIES, settings
from tests.llm.test_corpus import FOLDER, WORDS, prose, vocabulary_files

here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


# --- 8 -------------------------------------------------------------------------------------------------------------------
def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_terms(text):
    return {signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t}


def plain_subsets(text, lexicon):
    kept, out = sorted(plain_terms(text) & lexicon), []
    for level in range(5):
        rare = [t for t in kept if t % 4**level == 0]
        for place in range(16):
            h = 42
            for t in rare:
                if (t >> 20) % 16 == place:
                    h = xxhash.xxh64_intdigest(struct.pack("<q", t), h)
            out.append(h % 65536)
    return out


def plain_print(text, subsets):
    return "=" + hashlib.md5(text.encode()).hexdigest() if set(subsets) == {42} else "".join(f"{h:04x}" for h in subsets)


def plain_likeness(one, other, print_one, print_other):
    if print_one == print_other:
        return 1.0
    same = differ = 0
    for level in range(0, 80, 16):
        a, b = one[level:level + 16], other[level:level + 16]
        if 42 in a or 42 in b:
            pairs = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != (42, 42)]
            same += sum(x == y for x, y in pairs)
            differ += sum(x != y for x, y in pairs)
    return same / (same + differ) if same + differ else 0.0


@here
def test_fingerprints_equal_a_plain_i_match(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    counts: dict[int, int] = {}
    for text in texts.values():
        for t in plain_terms(text):
            counts[t] = counts.get(t, 0) + 1
    low, high = max(2, math.ceil(0.002 * len(texts))), 0.05 * len(texts)
    lexicon = {t for t, n in counts.items() if low <= n <= high}
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in QUERIES["op8_fingerprints"](spark, folder).collect()}
    assert set(rows) == set(texts)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        text, nearby, row = texts[i], texts[after], rows[i]
        third = len(text) // 3
        edited = text[:len(text) - third] + nearby[:third]
        own, changed, other = (plain_subsets(t, lexicon) for t in (text, edited, nearby))
        prints = [plain_print(t, s) for t, s in ((text, own), (edited, changed), (nearby, other))]
        assert (row["n_chars"], row["fingerprint"], row["edited_fingerprint"]) == (len(text), *prints[:2])
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_edited"] == pytest.approx(plain_likeness(own, changed, prints[0], prints[1]))
        assert row["near_next"] == pytest.approx(plain_likeness(own, other, prints[0], prints[2]))


def test_fingerprints_keep_other_lexicons_apart():
    assert plain_print("x", plain_subsets("x", set())) == "=" + hashlib.md5(b"x").hexdigest()
    assert fingerprints.LEVELS == 5 and fingerprints.PLACES == 16 and fingerprints.EMPTY == 42


# --- 7 -------------------------------------------------------------------------------------------------------------------
def dense_ftrl(rows, idf, classes, epochs, alpha, beta, l1, l2):
    """The same learner, one coordinate at a time over dense rows."""
    size = len(idf) + 1
    z, n = [[0.0] * classes for _ in range(size)], [[0.0] * classes for _ in range(size)]

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    dense = [np.zeros(len(idf)) for _ in rows]
    for x, (places, share, _) in zip(dense, rows, strict=True):
        x[places] = share * idf[places]
    scale = sum(math.sqrt((x**2).sum()) for x in dense) / len(rows)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            x = [*(dense[r] / scale), 1.0]
            scores = [sum(x[i] * weight(i, c) for i in range(size)) for c in range(classes)]
            total = sum(math.exp(s) for s in scores)
            for i in range(size):
                if x[i] == 0.0:
                    continue
                old = [weight(i, c) for c in range(classes)]
                for c in range(classes):
                    g = x[i] * (math.exp(scores[c]) / total - (rows[r][2] == c))
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * old[c]
                    n[i][c] += g * g
    table = np.array([[weight(i, c) for c in range(classes)] for i in range(size)])
    return table[:-1] * (idf / scale)[:, None], table[-1]


@pytest.mark.parametrize("l1, l2", [(0.0, 0.0), (0.05, 0.3), (0.4, 1.0)])
def test_ftrl_equals_a_dense_twin(l1, l2):
    rng = np.random.default_rng(5)
    idf, rows = rng.uniform(1, 4, 30), []
    for _ in range(40):
        places = np.sort(rng.choice(30, rng.integers(2, 9), replace=False))
        share = rng.uniform(0.1, 1, len(places))
        rows.append((places, share / share.sum(), int(places[0] % 3)))
    settings_ = {"epochs": 3, "alpha": 0.4, "beta": 1.0, "l1": l1, "l2": l2}
    got, want = language.fit_ftrl(rows, idf, 3, **settings_), dense_ftrl(rows, idf, 3, **settings_)
    assert got[0] == pytest.approx(want[0], abs=1e-9) and got[1] == pytest.approx(want[1], abs=1e-9)
    if l1 == 0.4:
        assert (got[0] == 0).mean() > (language.fit_ftrl(rows, idf, 3, epochs=3, alpha=0.4, beta=1.0, l1=0.0, l2=0.0)[0] == 0).mean()


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 4, 400)
    logits = rng.normal(size=(400, 4)) + 2.0 * np.eye(4)[labels]
    for factor in (0.3, 1.0, 6.0):
        loss = lambda t, z=logits * factor: -np.log(language.softmax(z / t)[np.arange(400), labels]).mean()
        grid = np.exp(np.linspace(math.log(0.05), math.log(20), 2000))
        assert loss(language.fit_temperature(logits * factor, labels)) <= min(map(loss, grid)) + 1e-9


def test_a_repeated_id_is_sampled_once(spark):
    rng = random.Random(1)
    rows = [(i, prose(20, rng), "ab"[i % 2]) for i in range(40)] + [(7, "same text here", "b")] * 300 + [(7, "another text", "b")] * 30
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = language.labelled_sample(train, 30).collect()
    assert len({tuple(r)[:3] for r in picked}) == len(picked)
    assert sum(r["doc_id"] == 7 for r in picked) <= 3 and max(r["rank"] for r in picked) <= 30
    assert sum(r["lang"] == "a" for r in picked) == 20
    model = language.train_model(train, 20, 5)
    assert set(model.languages) == {"a", "b"}


# --- 2 -------------------------------------------------------------------------------------------------------------------
def sets_of(texts, words):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    return shingles.shingle_sets(data, offsets, words)


def test_equal_sets_are_told_by_all_bits(monkeypatch):
    texts = [f"{a} {b}" for a in WORDS for b in WORDS[:9]] + ["anta bero", "Anta  Bero", "bero anta"]
    _, at, sizes, whole = sets_of(texts, 2)
    full = list(zip(*shingles.set_digests(at, whole, len(texts)), strict=True))
    monkeypatch.setattr(shingles, "KEPT", 52)
    assert full[-3] == full[-2] != full[-1] and set(sizes) == {1}
    # With eight bits of a hash nearly all sets clash in what sorts and sketches them, and still none in the digests.
    monkeypatch.setattr(shingles, "KEPT", 8)
    few, at, _, whole = sets_of(texts, 2)
    assert len(set(few.tolist())) < 257
    digests = list(zip(*shingles.set_digests(at, whole, len(texts)), strict=True))
    assert digests == full and len(set(digests)) == len({tuple(t.lower().split()) for t in texts})


def test_digests_follow_sets_not_order_or_repeats():
    texts = ["a b c a b c", "c a b c a b", "a b c", "a b c a", "", "x", "X ", "x y z w"]
    _, at, sizes, whole = sets_of(texts, 2)
    d = list(zip(*shingles.set_digests(at, whole, len(texts)), strict=True))
    want = [frozenset(shingles.exact_shingles(t, 2)) for t in texts]
    assert [[a == b for b in d] for a in d] == [[a == b for b in want] for a in want]
    assert sizes.tolist() == [len(s) for s in want]


def test_two_runs_of_near_duplicates_agree(spark):
    rows = [(i, f"{WORDS[i % 7]} {WORDS[i % 5]}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 2).collect()}
    assert out == {i: min(j for j, t in rows if t == text) for i, text in rows}


# --- 5, 9, 10 ------------------------------------------------------------------------------------------------------------
def test_equal_rows_are_spread_over_the_groups(spark):
    rows = [(None, None, "c", 700)] * 300 + [(5, "s", "d", 900)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, cluster string, size long").repartition(4)
    out = packing.pack(docs, group_rows=50).toPandas()
    groups = out["bin"].str.split("-").str[0]
    assert len(out) == 600 and groups.value_counts().max() < 120 and groups.nunique() > 8
    assert out.groupby("bin")["words"].sum().max() <= 2048
    assert (out[out["doc_id"] == 5].groupby("bin").size() == 1).all()  # copies are apart


def test_rows_of_one_id_with_other_texts_are_mixed_apart(spark, tmp_path):
    settings(spark)
    rng = random.Random(4)
    rows = [(1, prose(20, rng), "en", "a", 1) for _ in range(40)] + [(i, prose(60, rng), "en", "b", 1) for i in range(2, 60)]
    rows += [rows[0]] * 3
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from engagelake.llm import mixing

    out = corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).groupBy("doc_id", "text").count().toPandas()
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    plan = mixing.mix(mixing.sized(docs, labels, keep={"t": F.xxhash64("text")})).toPandas()
    times = pd.Series([r[1] for r in rows]).value_counts()
    texts = docs.select("text", F.xxhash64("text").alias("t")).distinct().toPandas().set_index("t")["text"]
    want = plan.groupby("t")["copies"].max()
    got = {r.text: r["count"] for _, r in out.iterrows()}
    assert got == {texts[t]: n * times[texts[t]] for t, n in want.items() if n}


@pytest.mark.parametrize("path", vocabulary_files())
def test_default_counts_are_right_for_every_vocabulary(spark, path):
    texts = ["the quick brown fox jumps over it", "a  b\n\nc", "  lead", None, "", "one\ntwo three 12 345"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = tokens.vocabulary(path)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.with_token_counts(docs, path).collect()}
    assert got == {i: words.counts([t or ""])[0] for i, t in enumerate(texts)}
