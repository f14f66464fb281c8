"""The pipeline's stages: columns, decisions, awkward and empty tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engagelake.llm.common import settings
from engagelake.llm.shingles import exact_shingles
from tests.llm.test_corpus import FOLDER, SCHEMA, awkward, brute_repeats, texts_of

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What every stage made of the awkward documents, written and read again."""
    settings(spark)
    docs, out = spark.createDataFrame(awkward(), SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("stages") / name)
        out[name] = (docs, stage(spark, docs, FOLDER))
        out[name][1].write.parquet(folder)
        docs = spark.read.parquet(folder)
        out[name] = (out[name][0], docs)
    return out


def test_all_but_the_last_keep_the_columns(kept):
    for name in list(STAGES)[:-1]:
        assert kept[name][1].columns == kept[name][0].columns


def test_language_rejects_what_has_no_letter(kept):
    before, after = (texts_of(d) for d in kept["language"])
    assert set(after) == {i for i, t in before.items() if any(c.isalpha() for c in t)}


def test_near_copies_leave_one(kept):
    before, after = (texts_of(d) for d in kept["minhash"])
    sets = {i: exact_shingles(t, 5) for i, t in before.items()}
    for i in set(before) - set(after):
        assert any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in before)
    for i in after:
        assert not any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in after)


def test_repeats_are_cut_from_the_text(kept):
    before, after = (texts_of(d) for d in kept["suffixes"])
    want = brute_repeats(before)
    for i, text in before.items():
        size, removed = want[i][:2]
        assert (i in after) == (removed < size or not removed)
        if i in after:
            assert len(after[i].encode()) - (size - removed) in range(0, 7) and (removed or after[i] == text)
    rows = kept["suffixes"][1].where("doc_id is not null")
    assert rows.where(F.char_length("text") != F.col("n_chars")).where("doc_id <> 0").count() == 0


def test_mix_and_packing_hold_together(kept):
    mixed, packed = kept["mixing"][1], kept["packing"][1].toPandas()
    words = sum(len((r[0] or "").split()) for r in mixed.select("text").collect())
    assert packed["words"].sum() == words and packed.groupby("bin")["words"].sum().max() <= 2048


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_an_empty_table(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    out = STAGES[name](spark, empty, FOLDER)
    assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


def test_run_is_the_registered_query(spark):
    import __spark_entry__ as driver

    out = driver.queries()["pipeline"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert out.columns == ["doc_id", "piece", "words", "bin", "place", "filled"] and out.count() > 0.5 * docs.count()
