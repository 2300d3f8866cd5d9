import hashlib

import numpy as np
import pyarrow as pa

from tracelake.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep, seen = (max(named) if named else None), False
        for i in ids:
            first = i == keep and not seen
            seen |= first
            out.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(documents):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (5, ""), (6, "é " * 4000), (7, "é " * 4000), (None, "a"), (None, "z"), (9, " a"), (10, "A")]
    got = exact_dedup.exact_dedup(documents(rows, extra=True))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_rounds_do_not_matter(documents):
    rows = [(i, f"t{i % 37}") for i in range(300)]
    for radix in (2, 4, 16):
        got = exact_dedup.exact_dedup(documents(rows).repartition(7), radix)
        assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_empty_table(documents):
    assert exact_dedup.exact_dedup(documents([])).collect() == []
    assert exact_dedup.deduplicate(documents([])).collect() == []


def test_deduplicate_keeps_columns_and_one_row(documents):
    rows = [(1, "a"), (3, "a"), (3, "a"), (4, None), (5, ""), (None, "a"), (None, "q"), (None, "q"), (8, "b")]
    docs = documents(rows, extra=True)
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in left.collect()], key=str) == sorted([(3, "a"), (5, ""), (None, "q"), (8, "b")], key=str)


def test_runs_merge_across_batches():
    def batch(ids):
        sha = pa.array([hashlib.sha256(str(i // 3).encode()).digest() for i in ids], pa.binary())
        one = pa.array(np.ones(len(ids), np.int64))
        cols = [pa.array([0] * len(ids), pa.int32()), sha, one, one, pa.array(ids, pa.int64()), one, pa.array(ids, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=exact_dedup._RUN_COLUMNS)

    out = pa.Table.from_batches(list(exact_dedup._merge_runs(0, 4, False)([batch([0, 1]), batch([2]), batch([]), batch([3, 4, 5, 6])])))
    assert out.to_pydict()["keep_id"] == [2, 5, 6]
    assert out.to_pydict()["rows"] == [3, 3, 1]
