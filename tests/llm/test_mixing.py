import re

from tracelake.llm import mixing


def test_targets_and_limits(documents):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{i % 4}") for i in range(600)] + [(1000, None, "en", None), (1001, "", "en", "s1"), (1002, "x y", "en", None)]
    got = mixing.mix(documents(rows, extra=True)).collect()
    assert len(got) == len(rows)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    taken, target, total = {}, {}, {}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r["size"] == words[r["doc_id"]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s], total[s] = r["target"], r["source_size"]
    everything = sum(words.values())
    assert abs(sum(target.values()) - everything) < 1e-6 * everything
    for s in target:
        assert target[s] <= 3 * total[s] + 1e-9
        assert abs(taken[s] - target[s]) <= 50


def test_closed_form_shares_match_water_filling(spark, documents):
    sizes = {"a": 10, "b": 1000, "c": 4, "d": 700, "e": 1}
    rows = [(i, "w " * n, "en", s) for i, (s, n) in enumerate(sizes.items())]
    got = {r["source"]: r["target"] for r in mixing.source_targets(mixing.sizes(documents(rows))).collect()}
    weight = dict(zip(sorted(sizes), (5, 2, 1, 5, 2), strict=True))
    left, open_, want = sum(sizes.values()), set(sizes), {}
    while True:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] >= 3 * sizes[s]]
        if not full:
            want |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            want[s] = 3 * sizes[s]
            left -= want[s]
            open_.remove(s)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_reruns_agree_and_empty_table(documents):
    rows = [(i, "w " * (i % 9), "en", f"s{i % 3}") for i in range(90)]
    first = sorted(map(tuple, mixing.mix(documents(rows)).collect()))
    assert first == sorted(map(tuple, mixing.mix(documents(rows).repartition(5)).collect()))
    assert mixing.mix(documents([])).collect() == []


def test_sample_keeps_columns(documents):
    docs = documents([(i, "w " * (i % 9), "en", f"s{i % 3}") for i in range(60)] + [(3, "w " * 3, "en", "s0")])
    rows = mixing.sample(docs)
    assert set(docs.columns) <= set(rows.columns)
    assert all(r["copies"] >= 1 and r["taken"] == r["copies"] * r["size"] for r in rows.collect())


def test_sizes_beyond_a_long(spark, documents):
    rows = mixing.sizes(documents([(1, "w " * 9, "en", "a")])).drop("size")
    huge = rows.selectExpr("doc_id", "source", "10000000 as size", "tie", "name").union(spark.range(3).selectExpr("id", "'b'", "id + 1", "id", "null"))
    got = huge.groupBy("source").agg(mixing.F.sum("size").alias("source_size"))
    per = got.selectExpr("source", "source_size * 100000000 as size")
    assert all(r["target"] > 0 for r in mixing.source_targets(per).collect())
    wide = spark.sql("select cast(1000000 as decimal(20, 0)) * cast(20000000000 as decimal(18, 0)) as x")
    score = wide.selectExpr("(1024 * x) div (x + 9000000000000000) as s").first()["s"]
    assert score == 1024 * 10**6 * 2 * 10**10 // (10**6 * 2 * 10**10 + 9 * 10**15)


def test_inclusion_rates_follow_the_probabilities(documents):
    """One source of 6000 documents of three lengths beside a large one: its rate is a fraction; longer texts lead."""
    rows = [(i, "w " * (20, 40, 80)[i % 3], "en", "a") for i in range(6000)] + [(10_000 + i, "w " * 60, "en", "b") for i in range(1000)]
    got = [r for r in mixing.mix(documents(rows)).collect() if r["doc_id"] < 10_000]
    rate = got[0]["target"] / got[0]["source_size"]
    mean = 140 / 3
    score = {s: 1024 * s * 6000 // (s * 6000 + int(mean * 6000)) for s in (20, 40, 80)}
    centre = sum(score[s] * s for s in score) / 140
    for s in score:
        own = [r["copies"] for r in got if r["size"] == s]
        want = rate + min(rate, 3 - rate) * 0.5 * (score[s] - centre) / 1024
        assert abs(sum(own) / len(own) - want) < 4 * (0.25 / len(own)) ** 0.5 + 0.01, (s, want)


def test_null_ids_are_drawn_one_by_one(documents):
    rows = [(None, f"w{i} " * 10, "en", "a") for i in range(400)] + [(i, "w " * 10, "en", "b") for i in range(900)]
    copies = [r["copies"] for r in mixing.mix(documents(rows)).collect() if r["doc_id"] is None]
    assert len(copies) == 400 and len(set(copies)) > 1
