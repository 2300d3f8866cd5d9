"""Toxicity index: every labelled row on all its terms, and an even sample over class and language."""

from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_models import terms_of
from tracelake.llm import toxicity_knn as op
from tracelake.llm.common import held_out, table

DATA = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def ids(n):
    return [i for i in range(10 * n) if crc32(str(i).encode()) % 4 != 2][:n]


def test_every_labelled_row_is_indexed_on_all_its_terms(spark, documents):
    words = ["sun", "rain", "river", "mountain"]
    rows = [(i, f"{words[k % 4]} own{chr(97 + k)}") for k, i in enumerate(ids(20))]
    rows += [(100_000 + i, "grubble slob") for i in range(40) if crc32(str(100_000 + i).encode()) % 4 != 2][:1]  # one toxic example only
    labels = [(i, 0, int(i >= 100_000)) for i, _ in rows]
    index = op.train(documents(rows), spark.createDataFrame(labels, LABELS))
    assert sorted(index.ids.tolist()) == sorted(i for i, _ in rows)
    assert len(index.terms) == len({t for _, text in rows for t in terms_of(text)})
    got = {r["doc_id"]: r for r in op.score(documents([(1, "grubble"), (2, "ownb"), (3, "zzz")]), index).collect()}
    assert got[1]["evidence"] == [rows[-1][0]] and got[2]["evidence"] == [rows[1][0]] and got[3]["evidence"] == []


def test_other_languages_are_caught(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    index = op.train(docs, labels)
    rows = docs.join(labels, "doc_id").where(held_out(F.col("doc_id")) & (F.col("toxic") == 1) & (F.col("lang") != "en"))
    scores = [r["score"] for r in op.score(rows.select("doc_id", "text"), index).collect()]
    assert len(scores) == 5 and np.mean([s >= op.THRESHOLD for s in scores]) >= 0.6


def test_sample_is_even_over_class_and_language(spark, documents):
    own = ids(1000)
    rows = [(i, f"w{chr(97 + i % 20)} x", "de" if k < 20 else "en") for k, i in enumerate(own)]
    labels = [(i, 0, int(k % 10 == 0)) for k, i in enumerate(own)]
    index = op.train(documents(rows), spark.createDataFrame(labels, LABELS), max_labelled=200)
    kept = set(index.ids.tolist())
    assert set(own[:20]) <= kept and 120 < len(kept) < 280 and 50 < index.toxic.sum() < 100
