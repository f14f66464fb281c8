"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engagelake.llm import embeddings, fingerprints, language, minhash, mixing, packing, sharding, suffixes, tokens, warc
from engagelake.llm.common import QUERIES, settings
from engagelake.llm.shingles import exact_shingles

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
RNG = random.Random(11)
WORDS = [w + s for w in ("anta", "bero", "culi", "dono", "efri", "gala", "homi", "iste") for s in ("", "n", "rs", "tta", "lo", "mi")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, part string, node long, key double, copies int"


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def awkward():
    """Documents with every awkward case, and columns that no operator may trip over."""
    passage, base = prose(30), [prose(120) for _ in range(6)]
    texts = [None, "", " \t\n", "Ein", "a b", prose(6000), "é" * 400, "日本語 " * 90, passage, f"{base[0]} {passage}", f"{passage} {base[1]}"]
    texts += [base[2], base[2], base[2].upper(), base[2] + " tail", base[3], base[3].replace("a", "e", 2), *base, "x", "x", "<|endoftext|> it's", "!!! ???"]
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "b", "a", ""][i % 4], len(t or ""), 1, "p", 2, 0.5, 3) for i, t in enumerate(texts)]
    return [*rows, rows[11], rows[0], (None, base[4], "en", "a", 5, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    settings(spark)
    folder = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(awkward(), SCHEMA).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < -1")


def ids(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect() if r[0] is not None}


def texts_of(docs):
    return {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect() if r[0] is not None}


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- 1 -------------------------------------------------------------------------------------------------------------------

def pages_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))


def test_warc_round_trip(spark, tmp_path):
    big, other = prose(300), "ü" * 700
    rows = [(1, "http://a/\r\nb c", big), (2, None, big), (9, "u", big), (9, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "same"), (6, "u", "same"),
            (7, "u", other), (8, "u", other), (None, "u", big), (None, None, prose(900))]
    pages = warc.with_revisits(pages_of(spark, rows))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    folder = str(tmp_path / "archives")
    warc.write_warc(pages.select(urn("page_id").alias("record_id"), "record_type", F.col("url").alias("target_uri"), "payload",
                                 "payload_digest", urn("refers_to").alias("refers_to")), folder)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    kinds = Counter((r["record_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds[("urn:page:9", "response", None)] == 2
    for page in (1, 2):
        assert kinds[(f"urn:page:{page}", "revisit", "urn:page:9")] == 1
    assert kinds[("urn:page:7", "revisit", "urn:page:8")] == 1 and kinds[("urn:page:5", "response", None)] == 1
    assert kinds[("urn:uuid:0", "revisit", "urn:page:9")] == 1
    digests = Counter((hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for _, _, h in rows)
    assert Counter((r["payload_digest"], r["payload_bytes"]) for r in got) == digests
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")


def test_warc_dictionary_leads_each_archive_and_damage_is_found():
    records = [warc.record(f"urn:page:{i}", "response", "u", prose(200).encode(), "", None) for i in range(400)]
    records = [r.replace(b"sha1:", b"sha1:" + hashlib.sha1(r[:-4].partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2]).hexdigest().encode()) for r in records]
    made = list(warc.archives(iter(records), archive_bytes=40_000))
    assert len(made) > 2 and all(a[:4] == warc.DICTIONARY_MAGIC for a in made)
    assert [f for a in made for f in warc.frames(a + warc.EMPTY_SKIPPABLE.encode("latin-1"))] == records
    assert all(warc.parse(r)[1] == "response" for r in records)
    for bad in (records[0][:-3], records[0].replace(b"WARC-Date", b"WARC Date"), records[0].replace(b"WARC/1.1", b"WARC/9"), records[0].replace(b"an", b"en", 1)):
        if bad != records[0]:
            with pytest.raises(ValueError):
                warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.frames(made[0][:-2]))


def test_warc_query_keeps_a_null_page_id(spark, tmp_path):
    rows = [(0, "u", "a"), (None, "u", "b"), (None, "u", prose(300)), (7, "u", "c")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op1_warc"](spark, str(tmp_path)).collect()
    assert Counter((r["page_id"], r["payload_bytes"]) for r in got) == Counter((i, len(h)) for i, _, h in rows)


def test_warc_of_no_pages(spark, tmp_path):
    pages = pages_of(spark, [(1, "u", "x")]).where("page_id < 0")
    warc.write_warc(warc.with_revisits(pages).select(
        F.lit("a").alias("record_id"), "record_type", F.col("url").alias("target_uri"), "payload", "payload_digest",
        F.col("refers_to").cast("string").alias("refers_to")), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


# --- 2 -------------------------------------------------------------------------------------------------------------------

def near_copies():
    base = [prose(80) for _ in range(3)]
    out = []
    for text in base:
        for _ in range(25):
            words = text.split()
            for _ in range(RNG.randint(0, 12)):
                words[RNG.randrange(len(words))] = RNG.choice(WORDS)
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("words, block", [(2, 512), (5, 4)])
def test_minhash_equals_brute_force(spark, docs, monkeypatch, words, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(near_copies())], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(more)
    got = ids(minhash.near_duplicates(every, words=words), "n_shingles", "component_id", "kept")
    sets = {i: exact_shingles(t, words) for i, t in texts_of(every).items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = roots(sets, links)
    assert got == {i: (len(s), component[i], component[i] == i) for i, s in sets.items()}


def test_minhash_keeps_rows_without_an_id_and_takes_empty_tables(docs, nothing):
    out = minhash.near_duplicates(docs)
    assert out.count() == docs.count() and out.where("doc_id is null and component_id is null and kept").count() == 2
    assert minhash.near_duplicates(nothing).count() == 0


def test_sketch_share_is_close_to_the_similarity():
    rng = np.random.default_rng(3)
    for n, common in ((3, 2), (40, 32), (2000, 1500)):
        pool = rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64)
        a, b = pool[:n], pool[n - common:2 * n - common]
        s = minhash.sketches(np.concatenate([a, b]), np.repeat([0, 1], n), 2, 200)
        assert (s != minhash.EMPTY).all()
        assert abs((s[0] == s[1]).mean() - common / (2 * n - common)) < 0.15


# --- 3 -------------------------------------------------------------------------------------------------------------------

def brute_repeats(texts, length=50):
    first, out = {}, {}
    for i in sorted(texts):
        raw = texts[i].encode()
        marks = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first.setdefault(raw[k:k + length], i) < i:
                marks[k:k + length] = b"\1" * length
        kept = bytes(c for c, m in zip(raw, marks, strict=True) if not m)
        out[i] = (len(raw), sum(marks), sum(1 for run in bytes(marks).split(b"\0") if run), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("part_bytes, common", [(16 << 20, 2000), (4000, 2)])
def test_suffixes_equal_brute_force(docs, monkeypatch, part_bytes, common):
    monkeypatch.setattr(suffixes, "PART_BYTES", part_bytes)
    monkeypatch.setattr(suffixes, "COMMON", common)
    out = suffixes.remove_repeats(docs, with_text=True)
    assert ids(out, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(texts_of(docs))
    assert out.count() == docs.count() and out.where("doc_id is null and n_removed > 0").count() == 0


def sliced(spark, slices, texts):
    """(doc_id, text) with the documents of each slice in a partition of their own."""
    rows = spark.sparkContext.parallelize([[(i, texts[i]) for i in some] for some in slices], len(slices)).flatMap(list)
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_runs_of_a_common_gram_meet_from_slices_of_one_and_of_several_documents(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "COMMON", 2)
    rng = random.Random(21)
    passage = prose(40, rng)
    slices = [[10], [11], [12], [13], [1, 2], [20, 21], [5], [30, 31, 32]]
    texts = {i: f"{prose(25, rng)} {passage} {prose(25, rng)}" for some in slices for i in some}
    out = suffixes.remove_repeats(sliced(spark, slices, texts))
    assert ids(out, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(texts)


def test_windows_of_a_gram_that_every_slice_shares_are_dealt_by_content(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "COMMON", 1)
    rng = random.Random(22)
    passage = rng.randbytes(100).hex()
    slices = [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(4)]
    texts = {i: rng.randbytes(60).hex() + chr(65 + i) + passage + chr(65 + i) + rng.randbytes(60).hex() for some in slices for i in some}
    df = sliced(spark, slices, texts)
    assert ids(suffixes.remove_repeats(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(texts)
    own = df.withColumn("part", F.pmod("doc_id", F.lit(4)).cast("int"))
    needed = suffixes.stored(suffixes.shared_runs(suffixes.deal_runs(own, 4, 50)), "runs")
    sent = suffixes.deal_contexts(own, needed, 4, 50).where("target >= 0").collect()
    assert {n for r in sent for n in suffixes.unpack(r["blob"], "i8", "i4", "i4", "u1")[2].tolist()} == {50}
    assert len({r["target"] for r in sent}) > 16


def test_short_phrases_that_documents_share_by_chance_send_no_runs(spark):
    rng = random.Random(23)
    phrases = [rng.randbytes(10).hex() for _ in range(5)]
    texts = {i: "".join(rng.randbytes(30).hex() + p for p in phrases) for i in range(40)}
    own = sliced(spark, [[i, i + 1] for i in range(0, 40, 2)], texts).withColumn("part", F.pmod("doc_id", F.lit(4)).cast("int"))
    assert suffixes.shared_runs(suffixes.deal_runs(own, 4, 50)).count() == 0


def test_only_places_that_start_windows_are_sorted(monkeypatch):
    rng = random.Random(24)
    bodies = [rng.randbytes(67) for _ in range(20)]
    contexts = [*bodies, *[rng.randbytes(5) + b[5:] for b in bodies], b"\0" * 120, b"\0" * 90]
    docs = np.array([rng.randrange(1000) for _ in contexts])
    lengths = np.array([len(c) for c in contexts])
    starts = np.cumsum(lengths) - lengths
    first = {}
    for doc, c in zip(docs.tolist(), contexts, strict=True):
        for k in range(len(c) - 49):
            first[c[k:k + 50]] = min(doc, first.get(c[k:k + 50], doc))
    later = [int(at) + k for doc, at, c in zip(docs, starts, contexts, strict=True) for k in range(len(c) - 49) if first[c[k:k + 50]] < doc]
    data = np.frombuffer(b"".join(contexts), np.uint8)
    placed = []
    kept = suffixes.common_prefixes
    monkeypatch.setattr(suffixes, "two_stage", lambda data, *_: pytest.fail(f"{len(data)} suffixes are sorted"))
    monkeypatch.setattr(suffixes, "common_prefixes", lambda words, order, *a: placed.append(len(order)) or kept(words, order, *a))
    assert sorted(suffixes.repeated_windows(data, starts, lengths, docs).tolist()) == later and len(later) > 200
    assert placed == [sum(len(c) - 49 for c in contexts)]


@pytest.mark.parametrize("common", [1, 2_000])
def test_equal_passages_in_many_parts_and_twice_in_one_document(spark, monkeypatch, common):
    monkeypatch.setattr(suffixes, "PART_BYTES", 400)
    monkeypatch.setattr(suffixes, "COMMON", common)
    rng = random.Random(25)
    passage, other = prose(20, rng), prose(12, rng)
    texts = {i: f"{prose(6, rng)} {passage} {i:03d} {other[i % 7:]} {passage if i % 3 == 0 else ''} {prose(6, rng)}" for i in range(24)}
    out = suffixes.remove_repeats(sliced(spark, [list(range(k, 24, 5)) for k in range(5)], texts))
    assert ids(out, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(texts)


@pytest.mark.parametrize("length", [16, 20, 24, 30])
def test_strings_as_short_as_a_gram(spark, length):
    rng = random.Random(26)
    texts = {i: " ".join(rng.choice(WORDS) for _ in range(60)) for i in range(12)}
    out = suffixes.remove_repeats(sliced(spark, [[i, i + 1, i + 2] for i in range(0, 12, 3)], texts), length)
    assert ids(out, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(texts, length)


def test_batches_of_a_task_are_dealt_together(spark, monkeypatch):
    rng = random.Random(27)
    rows = [(i, rng.randbytes(40).hex(), i % 3) for i in range(2500)]
    own = spark.createDataFrame(rows, "doc_id long, text string, part int").coalesce(1)
    dealt = suffixes.deal_runs(own, 4, 50).groupBy("bucket").count().collect()
    assert {r["bucket"]: r["count"] for r in dealt} == dict.fromkeys(range(4), 1)

    batches = [pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows[k:k + 500]], "text": [r[1] for r in rows[k:k + 500]],
                                           "part": [r[2] for r in rows[k:k + 500]]}) for k in range(0, 2500, 500)]
    for name, most, lots in (("LOT_ROWS", 1100, 3), ("LOT_BYTES", 500 * 80, 5), ("LOT_BYTES", 1, 5)):
        with monkeypatch.context() as m:
            m.setattr(suffixes, name, most)
            found = list(suffixes.lots_of_runs(iter(batches), 50))
        assert len(found) == lots and np.concatenate([x[4] for x in found]).min() == 0
        assert Counter(np.repeat(np.concatenate([x[2] for x in found]), np.concatenate([x[5] for x in found])).tolist()) == {r[0]: 31 for r in rows}
        assert all(len(np.unique(x[1])) == len(np.unique(x[2])) and x[1].max() < 65_536 and (x[3] == x[2] % 3).all() for x in found)


def test_suffixes_of_nothing(nothing):
    assert suffixes.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(256))])
def test_two_stage_order_and_prefixes(alphabet):
    for n in (1, 2, 63, 400):
        raw = bytes(RNG.choice(alphabet) for _ in range(n))
        data = np.frombuffer(raw, np.uint8)
        words = suffixes.leading_words(data, 64)
        order = suffixes.two_stage(data, words, 50)
        assert sorted(order) == list(range(n))
        heads = [raw[i:i + 50] for i in order]
        assert heads == sorted(heads)
        prefixes = suffixes.common_prefixes(words, order, 50)
        for a, b, k in zip(heads, heads[1:], prefixes[1:], strict=False):
            a, b = a.ljust(50, b"\0"), b.ljust(50, b"\0")
            assert k == next((i for i in range(50) if a[i] != b[i]), 50)


# --- 4 -------------------------------------------------------------------------------------------------------------------

def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.12).tolist(), int(i % 3)) for i in range(400)]
    rows += [(400 + i, rows[7][1], rows[7][2]) for i in range(30)]
    odd = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0, None], 1), (904, rows[7][1], None), (905, [], 1),
           (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [1e300, 2e300], 1)]
    df = spark.createDataFrame([*rows, *odd, (None, rows[7][1], 1)], "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, window=40, part_rows=150).collect()}
    usable = [r for r in [*rows, *odd[6:]]]
    links = []
    for (i, x, a), (j, y, b) in itertools.combinations(usable, 2):
        if a == b and len(x) == len(y):
            x, y = np.array(x) / max(np.abs(x)), np.array(y) / max(np.abs(y))
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links.append((i, j))
    degree = Counter(itertools.chain(*links))
    component = roots([r[0] for r in [*rows, *odd]], links)
    assert got == {i: (degree[i], c, i == c) for i, c in component.items()} | {None: (0, None, True)}
    assert embeddings.near_duplicates(df.where("vec_id < -1")).count() == 0


def test_embeddings_of_a_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 256)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(unit(rng.normal(size=64)) + rng.normal(size=(3000, 64)) * 0.03)  # cosine 0.95
    y = unit(x[:600] + rng.normal(size=(600, 64)) * 0.0245)  # about 0.981 to the vector it is made of
    x = np.concatenate([x, y])
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    root = roots(range(len(x)), zip(*np.nonzero(np.triu(near)), strict=True))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df, part_rows=2000).collect()}
    wrong = [i for i in got if got[i] != (near[i].sum(), root[i])]
    assert near.sum() > 200 and not wrong, (near.sum(), len(wrong))


# --- 5 -------------------------------------------------------------------------------------------------------------------

def brute_best_fit(pieces, capacity):
    """Every piece, largest first, into the fullest bin with room and no conflict."""
    bins = []
    for size, source, cluster in pieces:
        fit = [b for b in bins if b[0] + size <= capacity and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
        if fit:
            best = max(b[0] for b in fit)
            chosen = next(b for b in fit if b[0] == best)
        else:
            chosen = [0, set(), set()]
            bins.append(chosen)
        chosen[0] += size
        chosen[1].add(source)
        chosen[2].add(cluster)
    return sorted(b[0] for b in bins)


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(9)
    sizes = -np.sort(-rng.choice(np.arange(1, 1000), 300, replace=False))
    sources, clusters = rng.integers(0, 9, 300).astype(str), rng.integers(0, 80, 300).astype(str)
    number, filled = packing.best_fit(sizes, [sources, clusters], 1000)
    frame = pd.DataFrame({"bin": number, "size": sizes, "source": sources, "cluster": clusters, "filled": filled})
    assert not frame.duplicated(["bin", "source"]).any() and not frame.duplicated(["bin", "cluster"]).any()
    assert (frame.groupby("bin")["size"].sum() == frame.groupby("bin")["filled"].first()).all() and filled.max() <= 1000
    used = sorted(frame.groupby("bin")["size"].sum())
    brute = brute_best_fit(list(zip(sizes, sources, clusters, strict=True)), 1000)
    assert abs(len(used) - len(brute)) <= 2 and sum(used) == sum(brute)  # equal room leaves a choice


def test_packing_of_awkward_documents(docs, nothing):
    out = packing.pack_texts(docs, capacity=100).toPandas()
    sizes = {i: len(t.split()) for i, t in texts_of(docs).items()}
    assert out["words"].sum() == sum((r[0] or 0) * 0 + len((r[1] or "").split()) for r in docs.select("doc_id", "text").collect())
    assert set(out["doc_id"].dropna().astype(int)) == set(sizes)
    assert (out["bin"].isna() == (out["words"] == 0)).all() and out.groupby("bin")["words"].sum().max() <= 100
    assert not out[out["bin"].notna()].duplicated(["bin", "place"]).any()
    assert packing.pack_texts(nothing).count() == 0


# --- 6 -------------------------------------------------------------------------------------------------------------------

def brute_shard(doc_id, tree):
    import struct

    import xxhash

    def draw(level, node, weight):
        seed = 42 if doc_id is None else xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()
        seed = xxhash.xxh64(level.encode(), seed=seed).intdigest()
        h = xxhash.xxh64(struct.pack("<i", node), seed=seed).intdigest()
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight

    weight = lambda t: t if isinstance(t, float) else sum(map(weight, t.values()))
    at, branch = None, tree
    for level in ("region", "rack", "shard"):
        at = min(branch, key=lambda n, level=level, branch=branch: draw(level, n, weight(branch[n])))
        branch = branch[at]
    return at


def test_shards_follow_the_tree_and_growth_moves_only_into_the_new_shard(spark, docs, nothing):
    rows = spark.range(3000).withColumnRenamed("id", "doc_id").union(docs.select("doc_id"))
    rows = sharding.place(rows, "doc_id", sharding.topology(8), "shard")
    rows = sharding.place(rows, "doc_id", sharding.topology(9), "grown")
    out = sharding.number_slots(rows, "shard", ["doc_id"], group_rows=100).toPandas()
    for shard, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part))) and abs(len(part) - len(out) / 8) < 100
    assert ((out["shard"] == out["grown"]) | (out["grown"] == 8)).all() and (out["grown"] == 8).sum() > 250
    some = out.dropna().head(200)
    assert [brute_shard(int(i), sharding.topology(8)) for i in some["doc_id"]] == some["shard"].tolist()
    empty = sharding.place(nothing, "doc_id", sharding.topology(8), "shard")
    assert sharding.number_slots(empty, "shard", ["doc_id"]).count() == 0


def test_a_weight_moves_rows_only_in_its_subtree(spark):
    tree, heavier = sharding.topology(8), sharding.topology(8)
    heavier[0][0][1] = 3.0
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    rows = sharding.place(sharding.place(rows, "doc_id", tree, "a"), "doc_id", heavier, "b")
    moved = rows.where("a <> b").groupBy("a", "b").count().collect()
    assert moved and all(r["b"] in (0, 1, 2, 3) for r in moved) and all(r["b"] in (0, 1) for r in moved if r["a"] in (2, 3))


# --- 7 -------------------------------------------------------------------------------------------------------------------

@here
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.learn(docs)
    out = language.with_language(docs.withColumn("score", F.lit("clash")), model).toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]]
    assert len(held) > 20 and (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert out["score"].between(0, 1).all()


def test_language_of_awkward_texts(docs, nothing):
    model = language.learn(docs)
    out = language.with_language(docs, model).toPandas()
    legible = [any(c.isalpha() for c in t or "") for t in out["text"]]
    assert [p != "und" for p in out["lang_pred"]] == legible and set(out["lang_pred"]) <= {"en", "fr", "und"}
    assert language.learn(nothing) is None
    assert language.with_language(docs, None).where("lang_pred = 'und' and score = 0").count() == docs.count()
    assert language.with_language(nothing, model).count() == 0


def test_language_counts_every_ngram_of_the_text():
    texts = ["Ab", "é", prose(50), "x" * 3]
    weights = np.random.default_rng(1).normal(size=(language.PLACES, 2)).astype(np.float32)
    got = language.Model(["a", "b"], weights, np.zeros(2), 1.0).logits(texts)
    for text, row in zip(texts, got, strict=True):
        places, shares = language._terms(text)
        assert row == pytest.approx(shares @ weights[places], abs=1e-5)


def test_document_frequencies(spark, docs):
    known = docs.where("text is not null").select("text")
    got = {r["place"]: r["df"] for r in language.document_frequencies(known).collect()}
    want = Counter(p for r in known.collect() for p in language._terms(r["text"])[0].tolist())
    assert got == want


# --- 8 -------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("part_bytes, cuts", [(2 << 20, 256), (3000, 4)])
def test_edited_texts_and_fingerprints(docs, monkeypatch, part_bytes, cuts):
    monkeypatch.setattr(fingerprints, "PART_BYTES", part_bytes)
    monkeypatch.setattr(fingerprints, "CUTS", cuts)
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    kept = fingerprints.lexicon(rows, least=0.05, most=0.9)
    out = fingerprints.with_edited(rows, kept).toPandas().set_index("doc_id")
    texts = texts_of(rows)
    order = sorted(texts, reverse=True)
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[i])
        assert out["n_chars"][i] == n and out["edited"][i] == texts[i][:n - n // 3] + texts[after][:n // 3]
        assert (out["near_next"][i] == 1.0) >= (texts[i] == texts[after])
    assert out.groupby("text")["fingerprint"].nunique().max() == 1
    assert out[["near_edited", "near_next"]].stack().between(0, 1).all()


def test_fingerprints_take_nulls_repeats_and_nothing(docs, nothing):
    kept = fingerprints.lexicon(docs, least=0.05, most=0.9)
    assert fingerprints.with_edited(docs, kept).count() == docs.count()
    assert fingerprints.with_edited(nothing, fingerprints.lexicon(nothing)).count() == 0


def test_lexicon_band(spark):
    rows = spark.createDataFrame([(i, "all " + ("half " if i % 2 else "") + f"one{i}") for i in range(20)], "doc_id long, text string")
    kept = fingerprints.lexicon(rows, least=0.3, most=0.6)
    assert kept == [rows.select(F.xxhash64(F.lit("half"))).first()[0]]


# --- 9 -------------------------------------------------------------------------------------------------------------------

def brute_targets(sums, share=1.5, most=2.0):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}
    target, left, open_ = dict.fromkeys(sums, 0.0), share * sum(sums.values()), set(sums)
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total + target[s] >= most * sums[s]}
        given = {s: left * weights[s] / total for s in open_}
        left = 0.0
        for s in open_:
            target[s] += given[s]
            if s in over:
                left += target[s] - most * sums[s]
                target[s] = most * sums[s]
        open_ -= over
    return target


def test_targets_are_reshared(spark):
    sums = {None: 40, "a": 1000, "b": 90, "ç": 10, "z": 0, "": 500, "q": 333}
    rows = [(s, n // 4) for s, n in sums.items() for _ in range(4)]
    sums = {s: n // 4 * 4 for s, n in sums.items()}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long"), "source", "size").collect()}
    assert got == pytest.approx(brute_targets(sums)) and sum(got.values()) == pytest.approx(1.5 * sum(sums.values()))


def test_mix_takes_epochs_first_and_comes_near(spark, docs, nothing):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, prose(rng.randint(0, 60), rng), rng.choice(["a", "b", "c", None])) for i in range(800)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 800, 3)] + [(0, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    sized = mixing.sized(rows, labels)
    out = mixing.mix(sized, bucket_rows=7).toPandas()
    again = mixing.mix(sized, bucket_rows=10_000).toPandas()
    assert out.sort_values("doc_id")["copies"].tolist() == again.sort_values("doc_id")["copies"].tolist()
    assert len(out) == 800 and out["copies"].max() <= 2
    out["taken"] = out["copies"] * out["size"]
    for _, part in out.fillna({"source": "?"}).groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 60
        assert part[part["size"] > 0]["copies"].max() - part[part["size"] > 0]["copies"].min() <= 1
    assert mixing.mix(mixing.sized(docs, labels)).count() == docs.count()
    assert mixing.mix(mixing.sized(nothing, labels)).count() == 0


# --- 10 ------------------------------------------------------------------------------------------------------------------

def vocabulary_files():
    try:
        import public_tokenizers as files
    except ImportError:
        return []
    return [files.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.mark.parametrize("path", vocabulary_files())
def test_spliced_counts_are_those_of_the_whole_text(path):
    words = tokens.vocabulary(path)
    rng = random.Random(8)
    extra = ["<|endoftext|>", "  ", "\n\n", "é", "́", "'s", "中文", "\U0001F600", "1234", "<s>"]
    for _ in range(120):
        text = list(prose(rng.randint(1, 300), rng))
        for _ in range(rng.randint(0, 40)):
            text.insert(rng.randint(0, len(text)), rng.choice(extra))
        text = "".join(text)
        text = text.replace(" ", "") if rng.random() < 0.2 else text
        assert tokens.spliced_count(text, words.tokens, rng.choice([40, 200, 500]), rng.choice([8, 30, 60])) == words.counts([text])[0]


@pytest.mark.skipif(not vocabulary_files(), reason="no vocabulary files")
def test_token_counts_of_awkward_texts(docs, nothing):
    path = vocabulary_files()[0]
    out = tokens.with_token_counts(docs.withColumn("n_tokens", F.lit("clash")), path, chunk=2000, overlap=64)
    words = tokens.vocabulary(path)
    for r in out.collect():
        text = r["text"] or ""
        assert r["n_tokens"] == words.counts([text])[0] and r["n_bytes"] == len(text.encode())
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    assert tokens.with_token_counts(nothing, path).count() == 0
