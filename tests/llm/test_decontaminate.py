import hashlib
import re

import numpy as np
import pytest

from tracelake.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, t in items:
            b = words(t)
            for k in range(max(1, len(b) - window + 1) if b else 0):
                piece = b[k : k + window]
                for at in range(len(w) - len(piece) + 1):
                    if w[at : at + len(piece)] == piece:
                        hit.update(range(at, at + len(piece)))
                        names.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,size", [(60, 3), (400, 6), (3000, 50)])
def test_index_counts_and_locates(n, size):
    rng = np.random.default_rng(n)
    text = np.append(rng.integers(1, size, n), 0)
    assert op.suffix_array(text, size).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = op.FMIndex(text, size)
    for length in (1, 2, 5):
        phrases = np.array([text[i : i + length] for i in rng.integers(0, n - length, 10)] + [rng.integers(1, size, length)])
        low, high = index.ranges(phrases.reshape(-1), np.arange(len(phrases)) * length, np.full(len(phrases), length))
        for a, b, p in zip(low, high, phrases, strict=True):
            want = [i for i in range(n - length + 1) if (text[i : i + length] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def corpus():
    rng = np.random.default_rng(4)
    vocabulary = ["ab", "cd", "é1", "x", "yy", "über", "q"]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) for _ in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary[:5], int(rng.integers(1, 14))))) for k in range(8)] + [(None, "x yy x yy x"), (3, "zz"), (9, None), (10, " .,")]
    texts += [items[0][1].upper() + "!", "pre " + items[1][1].replace(" ", "--") + " post", None, "", "...", items[2][1] * 3, items[2][1]]
    return [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, items[0][1])], items


def test_against_brute_force(spark, documents):
    docs, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = op.decontaminate(documents(docs, extra=True), benchmark)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(docs, items)


def test_small_shards_and_blocks_give_the_same(spark, documents):
    docs, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = op.decontaminate(documents(docs), benchmark, shard=40, block_bytes=60)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(docs, items)


def test_removal_leaves_no_window(spark, documents):
    docs, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = documents(docs, extra=True)
    left = op.without_hits(table, benchmark)
    assert left.columns == table.columns and left.count() == len(docs)
    assert not any(r["contaminated"] for r in op.decontaminate(left, benchmark).collect())
    clean = {r[0] for r in brute(docs, items) if not r[5]}
    texts = dict(docs)
    assert all(r["text"] == texts[r["doc_id"]] for r in left.collect() if r["doc_id"] in clean)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.decontaminate(documents([]), none).collect() == []
    assert [r["contaminated"] for r in op.decontaminate(documents([(1, "a b")]), none).collect()] == [False]


def test_removal_does_not_depend_on_the_blocks(spark, documents):
    docs, items = corpus()
    w = [f"w{i}" for i in range(40)]
    items += [(100 + i, " ".join(w[i : i + 10])) for i in range(0, 25, 3)]  # overlapping phrases, of different blocks
    items += [(200, "aa1 bb1 cc1 dd1"), (201, "zz1 yy1 xx1")]
    docs += [(500, "start " + " ".join(w) + " end"), (501, "aa1 bb1 zz1 yy1 xx1 cc1 dd1 left"), (502, "zz1 aa1 bb1 cc1 dd1 yy1 xx1 left")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {(r["doc_id"], r["text"]) for r in op.without_hits(documents(docs), benchmark).collect()}
    left = op.without_hits(documents(docs), benchmark, block_bytes=150)
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == want
    texts = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert not any(r[5] for r in brute(texts, items))


def test_items_larger_than_a_block(spark, documents):
    rng = np.random.default_rng(8)
    long = [f"w{i}" for i in rng.integers(0, 400, 700)]
    items = [(1, " ".join(long)), (2, "short one"), (3, "x" * 900), (4, " ".join(long[:30]))]
    docs = [(1, "pre " + " ".join(long[93:130]) + " post"), (2, "a short one here"), (3, "x" * 900), (4, " ".join(long) + " and " + " ".join(long)), (5, " ".join(long[60:69]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for limit in (op.BLOCK_BYTES, 300):
        assert sorted([tuple(r) for r in op.decontaminate(documents(docs), benchmark, block_bytes=limit).collect()], key=str) == brute(docs, items)


def test_very_long_text(spark, documents):
    """A text of some MB in one row, with a passage at its end."""
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "the of and " * 400_000 + passage), (2, passage.upper())]
    got = {r["doc_id"]: r for r in op.decontaminate(documents(docs), spark.createDataFrame([(7, passage)], "item_id long, text string"), shard=100_000).collect()}
    assert got[1]["n_words"] == 1_200_012 and got[1]["n_hit"] == got[2]["n_hit"] == 12


def test_phrases_stay_small():
    """A block holds about 16 bytes for each word of the benchmark."""
    rng = np.random.default_rng(1)
    texts = [(str(k), " ".join(f"w{i}" for i in rng.integers(0, 5000, 400)).encode()) for k in range(250)]
    block = op.Phrases(texts)
    held = sum(getattr(block, n).nbytes for n in ("stream", "start", "lengths", "item", "item_begin", "vocabulary"))
    assert held < 25 * 100_000 and len(block.start) == 250 * 391
