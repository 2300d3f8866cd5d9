import os
import shutil
import subprocess
import sys

import corpus_pipeline
from tests.llm import test_decontaminate, test_near_dedup
from tracelake.llm import registry
from tracelake.llm.common import filter_words, fresh, hot_size, passes, split_by, table

DATA = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "benchmark", "mixing"]
    docs = table(spark, DATA, "documents").cache()
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["language"](spark, docs, DATA).cache()
    assert docs.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = stages["exact"](spark, docs, DATA).cache()
    last = {}
    for d, t in rows:
        last[t] = max(d, last.get(t, d))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert docs.columns == columns and sorted(d for d, _ in rows) == sorted(last.values())
    docs = stages["near"](spark, docs, DATA).cache()
    kept = {d for d, _, _, k in test_near_dedup.brute(rows) if k}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert docs.columns == columns and {d for d, _ in rows} == kept and len(rows) == len(kept)
    docs = stages["benchmark"](spark, docs, DATA).cache()
    assert docs.columns == columns and docs.count() == len(kept)
    assert docs.where("n_chars <> char_length(text)").isEmpty()
    largest = max(len((r["text"] or "").split()) for r in docs.collect())
    mixed = stages["mixing"](spark, docs, DATA)
    assert set(columns) <= set(mixed.columns)
    got = mixed.collect()
    taken = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    target = {r["source"]: r["target"] for r in got}
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1 for s in taken)  # the cut is at the nearest document


def test_pipeline_on_odd_tables(spark, documents, tmp_path):
    rows = [(i, t, "en", s) for i, (t, s) in enumerate([("the of and a b c d", "a"), (None, None), ("", "a"), ("the of and a b c d", "b"), ("the of it is so very odd", None)])]
    table_path = str(tmp_path / "d")
    os.mkdir(table_path)
    documents([*rows, rows[0]]).write.parquet(f"{table_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{table_path}/benchmark.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, table_path).collect()} <= {3, 4}
    shutil.rmtree(f"{table_path}/documents.parquet")
    documents([]).write.parquet(f"{table_path}/documents.parquet")
    assert corpus_pipeline.run(spark, table_path).collect() == []


def test_registered_queries():
    names = registry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)


def test_rest_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert q and not any(n.startswith("op") or n == "pipeline" for n in q) and set(e.oracle_sql()) <= set(q)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0 and q["track_summary"](spark, e.SMOKE_DIR).count() > 0
"""
    env = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_functions.py", "tests/test_tracking.py"], cwd=copy, check=True, env=env)


def test_row_filter(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(500), None]], "id long").selectExpr("id", "'x' as _word")
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 7)], "k long")
    inside, outside = split_by(rows, "id", ids, "k")
    assert {r["id"] for r in inside.collect()} >= set(range(0, 500, 7))
    assert inside.count() + outside.count() == 501 and inside.columns == rows.columns
    assert None in {r["id"] for r in outside.collect()} and fresh(rows, "_word") == "__word"


def test_filter_and_hot_groups_follow_the_number_of_rows():
    assert filter_words(0) == 1 << 10 and filter_words(10**12) == 1 << 22
    assert passes(10**5) < 0.13 and passes(10**8) < 0.35  # most other rows are turned away
    assert hot_size(10) == 1 and hot_size(10**6) == 1000 and hot_size(10**9) == 100_000 and hot_size(10**11) == 10**6


def test_benchmark_windows_are_gone(spark):
    items = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    docs = table(spark, DATA, "documents").where("doc_id < 150")
    left = dict(corpus_pipeline.STAGES)["benchmark"](spark, docs, DATA)
    assert not any(r[5] for r in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in left.collect()], items))


def test_clashing_names_and_ties(spark, documents, tmp_path):
    """Columns with the names the stages make themselves, equal texts, equal ids: the last stage's columns win, nothing fails."""
    path = str(tmp_path / "d")
    text = "the thing of that and this with from the other one of them"
    rows = [(1, text), (2, text), (2, text), (3, text + " more"), (4, "und der die das nicht mit sich auch " * 3), (None, "the last of that thing and this")]
    os.mkdir(path)
    documents(rows, extra=True).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "no such words here at all in any of these texts")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, path)
    assert {"kept", "sha", "_word", "doc", "size", "copies"} <= set(got.columns) and {r["doc_id"] for r in got.collect()} <= {2, 3, 4, None}
