import random
import re

import numpy as np
import pyarrow as pa

from tracelake.llm import near_dedup as op
from tracelake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if sets[i] and sets[j] and (same_id or 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)], key=str)


def near_copies(seed, groups, size):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(40, 160))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    return rows


def edge_cases(first):
    texts = ["a b", "A  b\n", "a b c", None, "", " \t ", "a b c d e", "a b c d e f", "Q w e r t y", "q w e r t y", "long " * 60_000]
    return [(first + i, t) for i, t in enumerate(texts)] + [(first, "zz yy xx ww vv uu"), (first + 40, "zz yy xx ww vv uu"), (None, "a b"), (None, None), (None, "only here without an id at all")]


def test_against_brute_force(documents):
    rows = near_copies(1, 25, 4) + edge_cases(100_000)
    got = op.near_duplicates(documents(rows, extra=True))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_full_regions_are_settled(documents):
    rows = near_copies(2, 2, 60)
    got = op.near_duplicates(documents(rows))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_links_within_a_group():
    rng = random.Random(5)
    texts = [t for _, t in near_copies(6, 4, 12)]
    rng.shuffle(texts)
    rep, comp = np.arange(len(texts)), np.arange(len(texts))
    links = op._links_within([t.encode() for t in texts], rep, comp)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    want = {d: c for d, _, c, _ in brute(list(enumerate(texts)))}
    for i in range(len(texts)):
        for j in range(i):
            assert (find(i) == find(j)) == (want[i] == want[j])


def test_long_region_across_batches():
    """A region that spans many batches: members are all noted, memory stays small."""
    n = 500
    key = np.zeros((n, op.DEPTH), ">u4")
    key[:, op.DEPTH - 1] = np.arange(n)

    def batch(a, b):
        cols = [pa.array(np.zeros(b - a, np.int32)), pa.array([k.tobytes() for k in key[a:b]], pa.binary()), pa.array(np.arange(a, b)), pa.array(np.full(b - a, 9, np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["tree", "key", "rep", "n"])

    out = pa.Table.from_batches(list(op._neighbours([batch(i, i + 50) for i in range(0, n, 50)])))
    noted = {a for a, r in zip(out["a"].to_pylist(), out["region"].to_pylist(), strict=True) if r is not None}
    assert noted == set(range(n))
    pairs = {(a, b) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True) if b is not None}
    assert {(i, i + 1) for i in range(n - 1)} <= pairs


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in parent}


def test_empty_and_deduplicate(documents):
    assert op.near_duplicates(documents([])).collect() == []
    rows = near_copies(4, 5, 3) + [(9001, None), (9002, "")]
    docs = documents(rows, extra=True)
    left = op.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _, _, kept in brute(rows) if kept)


def test_repeated_id_with_two_sets_of_one_size(documents):
    base = [[f"{c}{i}" for i in range(60)] for c in "xy"]
    copy = [[*b[:59], f"new{k}"] for k, b in enumerate(base)]
    rows = [(1, " ".join(base[0])), (1, " ".join(base[1])), (8, " ".join(copy[0])), (9, " ".join(copy[1]))]
    got = op.near_duplicates(documents(rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows) and {r["component_id"] for r in got} == {1}
