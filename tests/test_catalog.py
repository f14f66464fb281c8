"""The driver contract, and a cross-section of the SQL twins on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
SAMPLE = ["engagement", "engagement_strict_nulls", "clean_profiles", "clean_comments", "local_times", "sentiment_by_profile",
          "describe_by_type", "spearman_matrix", "kendall_matrix", "boxplot_by_type", "residual_autocorrelation",
          "class_tfidf", "topic_similarity", "category_counts", "default_stopwords_removed", "density_clusters", "silhouette_samples", "as_of_version", "running_engagement"]


def test_entry_runs(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and "FREQUENCIA" in df.columns


def test_every_twin_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) > 100


@pytest.mark.parametrize("left_out", [["engagelake/llm"], ["engagelake/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_imports_without_the_corpus_operators(tmp_path, left_out):
    here, copy = os.path.dirname(os.path.abspath(driver.__file__)), tmp_path / "copy"
    for name in ["__spark_entry__.py", "corpus_pipeline.py"]:
        copy.mkdir(exist_ok=True)
        shutil.copy(f"{here}/{name}", copy / name)
    shutil.copytree(f"{here}/engagelake", copy / "engagelake", ignore=shutil.ignore_patterns("__pycache__"))
    for name in left_out:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else os.remove(copy / name)
    code = "import __spark_entry__ as e; print('pipeline' in e.queries(), len(set(e.queries()) & set(e.catalog.QUERIES)))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, check=False)
    from engagelake import catalog

    assert done.stdout.split() == ["False", str(len(catalog.QUERIES))], done.stderr


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_values_agree(spark, duck, name):
    from tools.check_oracles import rows_of

    ours = driver.queries()[name](spark, FOLDER).toPandas()
    theirs = duck.execute(driver.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
