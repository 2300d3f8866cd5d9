import hashlib
import time

import numpy as np
import pytest

from tracelake.llm import suffix_dedup as op
from tracelake.sources import staging


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        if d is not None:
            for i in range(len(raw) - length + 1):
                w = raw[i : i + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if d is not None and first[raw[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(8))
def test_interval_expansion(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(1, 7))
    blocks = [bytes(rng.integers(97, 97 + rng.integers(1, 4), int(rng.integers(0, 30))).astype(np.uint8)) for _ in range(int(rng.integers(2, 12)))]
    docs = rng.integers(0, 6, len(blocks))
    block, offset = op.shared_windows(blocks, docs, length)
    want = sorted(
        (i, a) for i, b in enumerate(blocks) for a in range(len(b) - length + 1)
        if any(blocks[j].find(b[a : a + length]) >= 0 and docs[j] < docs[i] for j in range(len(blocks)))
    )
    assert sorted(zip(block.tolist(), offset.tolist(), strict=True)) == want


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 49, 50, 51, 400, 3000)] + [b"a" * 200]
    found = op.Anchors(texts, True)
    for i, t in enumerate(texts):
        own = found.owner == i
        covered = [s for a, span in zip(found.at[own].tolist(), found.span[own].tolist(), strict=True) for s in range(a, a + (span >> 8) + 1)]
        assert covered == list(range(max(0, len(t) - 49)))
        for a, span in zip(found.at[own].tolist(), found.span[own].tolist(), strict=True):
            place = a + (span & 255)
            assert all(s <= place <= s + op.MIN_LENGTH - op.K for s in range(a, a + (span >> 8) + 1))


def corpus():
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdeéfg"), int(rng.integers(1, 8))))
    prose = lambda n: " ".join(word() for _ in range(n))
    line = prose(14)
    texts = []
    for i in range(50):
        parts = [prose(int(rng.integers(0, 30)))]
        if i % 2:
            parts.append(line[: int(rng.integers(30, len(line)))])
        if i % 5 == 0 and texts:
            old = texts[int(rng.integers(len(texts)))]
            a = int(rng.integers(0, max(1, len(old) - 60)))
            parts.append(old[a : a + int(rng.integers(40, 140))])
        texts.append(" ".join([*parts, prose(int(rng.integers(0, 10)))]))
    texts += [texts[3], texts[3], texts[8][5:], "ab" * 300, "ab" * 100, "x" * 49, "x" * 50, "x" * 50, "", None, "é" * 40, "é" * 40, "y" * 30 + "x" * 60]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    return rows + [(rows[3][0], rows[3][1]), (rows[4][0], rows[9][1]), (None, rows[3][1]), (None, None)]


def test_against_brute_force(documents):
    rows = corpus()
    got = op.suffix_dedup(documents(rows, extra=True)).drop("kept")
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_hot_keys_go_by_window(documents):
    rows = corpus()
    got = op.suffix_dedup(documents(rows), hot_key=1).drop("kept")
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)


def test_shards_are_cut_between_keys(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(op, "SHARD", 300)
    rng = np.random.default_rng(2)
    rows = sorted((int(rng.integers(0, 6)), int(rng.integers(0, 9)), 0, int(rng.integers(0, 5)), bytes(rng.integers(97, 99, 55).astype(np.uint8))) for _ in range(90))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def batch(part):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=["key", "doc", "mark", "first", "bytes"])

    whole = [r for b in op._compare(4)([batch(rows)]) for r in b.to_pylist()]
    parts = [r for b in op._compare(4)([batch(rows[i : i + 7]) for i in range(0, 90, 7)]) for r in b.to_pylist()]
    gone = lambda out: {(r["doc"], a, b) for r in out for a, b in np.frombuffer(r["payload"], np.int32).reshape(-1, 2).tolist()}
    assert gone(whole) == gone(parts)


def test_hot_windows_are_collapsed_where_they_are_read():
    import pyarrow as pa

    text = "q" * 10 + "".join(chr(97 + i % 23) for i in range(60)) + "r" * 10
    ask = np.array([(0, 5, 20)], op._REQUEST).tobytes()
    cols = [pa.array([3, 1, 2]), pa.array([0, 0, 0], pa.int32()), pa.array([text] * 3), pa.array([ask] * 3, pa.binary())]
    out = pa.Table.from_batches(list(op._fetch([pa.RecordBatch.from_arrays(cols, names=["doc", "mark", "text", "payload"])])))
    rows = list(zip(out["doc"].to_pylist(), out["first"].to_pylist(), out["bytes"].to_pylist(), strict=True))
    assert sorted((d, f) for d, f, b in rows if not b) == [(d, f) for d in (2, 3) for f in range(5, 21)]
    assert sorted((d, f, b.decode()) for d, f, b in rows if b) == [(1, f, text[f : f + 50]) for f in range(5, 21)]


def test_empty_table(documents):
    assert op.suffix_dedup(documents([])).collect() == []


def test_classes_whose_first_hashes_collide():
    """With all first class hashes equal the second one still tells runs apart."""
    class Colliding(op.Anchors):
        def __init__(self, texts, full):
            super().__init__(texts, full)
            if full:
                self.ctx = np.zeros(len(self.ctx), np.uint64)

    rows = [(i, t) for i, t in corpus() if i is not None]
    texts = [(t or "").encode() for _, t in rows]
    plain, odd = op.Anchors(texts, True), Colliding(texts, True)
    for found in (plain, odd):
        rec = np.zeros(len(found.at), op._RECORD)
        rec["ctx"], rec["more"] = found.ctx, found.more
        order = np.lexsort((rec["more"], rec["ctx"]))
        group = np.empty(len(rec), np.int64)
        group[order] = np.cumsum(op._opens(rec[order]))
        content = [texts[o][a : a + (s >> 8) + 50] + bytes([s & 255]) for o, a, s in zip(found.owner.tolist(), found.at.tolist(), found.span.tolist(), strict=True)]
        assert len(set(group.tolist())) == len(set(content)) == len(set(zip(group.tolist(), content, strict=True)))


def test_a_text_of_some_megabytes(documents):
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdefgh "), 3000))
    filler = "".join(rng.choice(list("ijklmnop "), 2_500_000))
    rows = [(1, passage), (2, filler[:1_200_000] + passage[100:2900] + filler[1_200_000:]), (3, filler[5000:6000])]
    got = {r["doc_id"]: r for r in op.suffix_dedup(documents(rows)).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[3]["n_removed"]) == (0, 2800, 1000)
    assert got[2]["kept"] == filler.encode()


def shuffled(spark):
    """Bytes of the shuffle files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    own = [files.apply(i) for i in range(files.length())]
    return {f.getName(): f.length() for f in own if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_steps_leave_no_shuffle_files(spark, documents):
    """Texts and anchors are shuffled several times over; what a finished step has shuffled must not wait for the driver's garbage collection."""
    rng = np.random.default_rng(9)
    passages = ["".join(rng.choice(list("abcdefghijklmnop "), 4000)) for _ in range(100)]
    docs = documents([(i, passages[i % 100][i // 100 :] + str(i)) for i in range(400)]).repartition(4)
    size = 400 * 4000
    before = shuffled(spark)
    got = op.suffix_dedup(docs)
    for _ in range(20):  # files go a moment after the write
        left = sum(n for f, n in shuffled(spark).items() if f not in before)
        if left < size / 20:
            break
        time.sleep(0.5)
    assert left < size / 20
    assert spark.conf.get(staging.CLEANUP) == "false"  # the caller's own writes go on as they were
    assert got.where("n_removed >= 3000").count() == 300
