"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies cover every training document. The weights are fitted by follow-the-regularised-leader with
elastic-net penalties on a bounded sample of labelled rows, and scores are calibrated by a temperature on another one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engagelake.llm.common import query, read, stored

#: Features: n-grams of these lengths, hashed into so many places.
ORDERS, PLACES = (2, 3), 1 << 15
#: Labelled documents per language that are fitted on, and that the temperature is settled on.
FIT_ROWS, CALIBRATION_ROWS = 400, 100
#: Passes over the sample, FTRL step and smoothing, and the two penalties.
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 2e-4, 1e-4
#: Characters that are worked on at once in a worker.
SLICE = 1 << 20
UNKNOWN = "und"


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts one after another, each text between blanks, and where each text starts.

    ASCII characters other than letters all count as a blank.
    """
    joined = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = np.arange(128, dtype=np.uint32)
    plain[[c for c in range(128) if not chr(c).isalpha()]] = 32
    codes = np.where(codes < 128, plain[np.minimum(codes, 127)], codes)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in joined])])


def _places(codes: np.ndarray, order: int, places: int = PLACES) -> np.ndarray:
    """The hashed place of the n-gram that starts at each position; the last ``order - 1`` reach past the end."""
    padded = np.concatenate([codes, np.full(order - 1, 32, np.uint32)])
    h = np.full(len(codes), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ padded[k:k + len(codes)]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - places.bit_length() + 1)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters; a longer text is a range of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def _terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of a text and their shares of its n-grams."""
    codes, _ = _codes([text])
    places, counts = np.unique(np.concatenate([_places(codes, k)[:len(codes) - k + 1] for k in ORDERS]), return_counts=True)
    return places, counts / counts.sum()


def document_frequencies(train: DataFrame) -> DataFrame:
    """(place, df): in how many texts each place occurs, over all rows. A batch sends each place once at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first, after in _slices(texts):
                codes, starts = _codes(texts[first:after])
                doc = np.repeat(np.arange(after - first, dtype=np.int64), np.diff(starts))
                for low in range(0, after - first, 256):
                    a, b = starts[low], starts[min(low + 256, after - first)]
                    seen = np.zeros((min(256, after - first - low), PLACES), bool)
                    for k in ORDERS:
                        inside = doc[a:b - k + 1] == doc[a + k - 1:b]
                        seen[(doc[a:b - k + 1] - low)[inside], _places(codes[a:b], k)[:b - a - k + 1][inside]] = True
                    total += seen.sum(0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["place", "df"])

    return train.select("text").mapInArrow(count, "place int, df long").groupBy("place").agg(F.sum("df").alias("df"))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # place x language, idf included
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row per text: bias + the mean of the weights of its n-grams. All n-grams of the whole text count."""
        out = np.empty((len(texts), len(self.languages)))
        for first, after in _slices(texts):
            codes, starts = _codes(texts[first:after])
            lengths = np.diff(starts)
            sums, n = np.zeros((after - first, len(self.languages))), np.zeros(after - first)
            for k in ORDERS:
                places = _places(codes, k)
                # The k - 1 n-grams that reach into the next text don't count.
                stop = np.maximum(starts[1:] - k + 1, starts[:-1])
                for lang in range(len(self.languages)):
                    run = np.concatenate([[0.0], np.cumsum(self.weights[:, lang].take(places), dtype=np.float64)])
                    sums[:, lang] += run[stop] - run[starts[:-1]]
                n += np.maximum(lengths - k + 1, 0)
            out[first:after] = self.bias + sums / np.maximum(n, 1)[:, None]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return [self.languages[i] for i in best], p[np.arange(len(best)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, classes: int, epochs: int = EPOCHS,
             alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over sparse rows (places, shares, class), in a seeded order. Returns weights and bias.

    A weight is 0 while its gradient sum stays within ``l1``; ``l2`` shrinks the rest. Rows are scaled to length 1
    in TF-IDF for the steps; the weights returned apply to the mean over n-grams, whose scale they take on.
    """
    z, n = np.zeros((len(idf) + 1, classes)), np.zeros((len(idf) + 1, classes))

    def weights(at):
        s, m = z[at], n[at]
        w = -(s - np.sign(s) * l1) / ((beta + np.sqrt(m)) / alpha + l2)
        return np.where(np.abs(s) <= l1, 0.0, w)

    rng = np.random.default_rng(7)
    scale = np.mean([np.linalg.norm(share * idf[places]) for places, share, _ in rows])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            places, share, label = rows[i]
            at = np.append(places, len(idf))
            x = np.append(share * idf[places] / scale, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p
            m = n[at]
            z[at] += g - (np.sqrt(m + g * g) - np.sqrt(m)) / alpha * w
            n[at] = m + g * g
    final = weights(slice(None))
    return final[:-1] * (idf / scale)[:, None], final[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least mean negative log-likelihood, by golden section over its logarithm."""
    def loss(t):
        return -np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, r = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def labelled_sample(train: DataFrame, per_language: int) -> DataFrame:
    """(doc_id, lang, t, rank): the ``per_language`` different rows of each language whose hash is smallest.

    ``t`` is the hash of the text: rows that repeat id and text count once. Rows far beyond the hash at which a language
    has enough are dropped before they are ranked, so no task ranks a language as a whole.
    """
    keyed = train.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(1)).alias("h"), F.xxhash64("text").alias("t"))
    share = (F.col("h") / F.lit(float(1 << 64)) + 0.5)
    sizes = stored(keyed.groupBy(F.col("lang").alias("__lang")).agg(F.approx_count_distinct("h").alias("n")), "languages")
    near = keyed.join(sizes, F.col("lang") == F.col("__lang")).where(
        share * F.col("n") <= per_language + 6 * math.sqrt(per_language) + 20).select("doc_id", "lang", "h", "t").distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "t"))
    return near.withColumn("rank", rank).where(F.col("rank") <= per_language).select("doc_id", "lang", "t", "rank")


def train_model(train: DataFrame, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """Fit on (doc_id, text, lang) with neither text nor lang null; None where there are no such rows.

    The sample is at most fit_rows + calibration_rows whole texts per language; what comes to the driver are their
    n-gram counts, at most PLACES numbers each. A language with fewer rows is fitted on those it has.
    """
    total = train.count()
    if not total:
        return None
    picked = labelled_sample(train, fit_rows + calibration_rows)
    ids = stored(picked, "sample")
    texts = train.select("doc_id", "text", "lang", F.xxhash64("text").alias("t"))
    chosen = texts.join(F.broadcast(ids), ["doc_id", "lang", "t"]).dropDuplicates(["doc_id", "lang", "t"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_terms(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("lang"), batch.column("rank"), batch.column("doc_id"),
                pa.array([p.astype(np.int32) for p, _ in pairs], pa.list_(pa.int32())),
                pa.array([s.astype(np.float32) for _, s in pairs], pa.list_(pa.float32()))], ["lang", "rank", "doc_id", "places", "shares"])

    sample = chosen.select("doc_id", "text", "lang", "rank").mapInArrow(
        terms, "lang string, rank int, doc_id long, places array<int>, shares array<float>").toArrow().to_pandas()
    sample = sample.sort_values(["lang", "rank", "doc_id"], kind="stable")
    counts = document_frequencies(train).toArrow()
    df = np.zeros(PLACES)
    df[counts["place"].to_numpy()] = counts["df"].to_numpy()
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    languages = sorted(sample["lang"].unique())
    code = {lang: i for i, lang in enumerate(languages)}
    size = sample.groupby("lang")["rank"].transform("max")
    # A language with few rows gives the same share of them to the calibration.
    fitting = sample["rank"] <= np.maximum(1, size * fit_rows // (fit_rows + calibration_rows))
    rows = [(np.asarray(r.places), np.asarray(r.shares, float), code[r.lang]) for r in sample.itertuples()]
    fitted = [r for r, ok in zip(rows, fitting, strict=True) if ok]
    rest = [r for r, ok in zip(rows, fitting, strict=True) if not ok] or fitted
    weights, bias = fit_ftrl(fitted, idf, len(languages))
    logits = np.array([bias + share @ weights[places] for places, share, _ in rest])
    temperature = fit_temperature(logits, np.array([label for *_, label in rest]))
    return Model(languages, np.ascontiguousarray(weights.astype(np.float32)), bias, temperature)


def with_language(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1) from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, and so are all where no language was learned.
    """
    legible = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        found: Column = nothing
    else:
        shared = df.sparkSession.sparkContext.broadcast(model)

        @F.arrow_udf("struct<lang: string, score: double>")
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                langs, scores = shared.value.predict([t or "" for t in batch.to_pylist()]) if len(batch) else ([], [])
                yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

        found = F.when(legible, predict(F.col(text))).otherwise(nothing)
    rows = df.withColumn("__found", found)
    return rows.withColumn("lang_pred", F.col("__found.lang")).withColumn("score", F.col("__found.score")).drop("__found")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents never learned from: the checksum of the id as text is a multiple of 5. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame) -> Model | None:
    """The model from text and lang of the documents that are not held out."""
    known = docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return train_model(known.select("doc_id", "text", "lang"))


@query("op7_language")
def _language(spark, folder):
    """The language of every document, from a model that saw four in five of them."""
    docs = read(spark, folder, "documents")
    found = with_language(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
