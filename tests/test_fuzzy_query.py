import random

from tests.test_functions import common
from tracelake.operators import channels
from tracelake.plans import catalog

PHRASE = "that and onesen erblest"


def plain(query, text):
    """Best of the whole ratio and that of every stretch, by the plain LCS."""
    if not query or not text:
        return 0.0
    if query in text:
        return 100.0
    short, long = sorted((query, text), key=len)
    pieces = [long[max(0, stop - len(short)) : stop] for stop in range(1, len(long) + len(short))]
    return max(200 * common(short, p) / (len(short) + len(p)) for p in [*pieces, long] if p)


def test_fuzzy_topk_scores_whole_texts(spark, tmp_path):
    filler = "quick zebras jump over my lazy fox bodily "
    items = [(i, filler * (1 + i % 3) + PHRASE[: 3 + i] + " xyz" * (i % 4)) for i in range(20)] + [(20, filler * 3 + PHRASE + " tail"), (21, None), (22, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r["item_id"], r["similarity"]) for r in catalog.text_fuzzy_topk(spark, str(tmp_path)).collect()]
    squeezed = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())
    want = sorted(((-round(plain(squeezed(PHRASE), squeezed(t)), 4), i) for i, t in items))[:10]
    assert [i for i, _ in got] == [i for _, i in want] and got[0] == (20, 100.0)
    assert all(abs(s + w) < 1e-3 for (_, s), (w, _) in zip(got, want, strict=True))


def test_no_text_is_lost_before_it_is_scored(spark):
    """All texts of at least the cut-off stay, short ones and such that share few characters too."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 24))) for _ in range(300)] + ["ab", "fgh", "zzz", "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    for query in ("abcdefgh", "ab", "hgfedcbaabcdefghhgfe"):
        got = {r["n"]: r["similarity"] for r in channels.scored_texts(rows, query).collect()}
        want = {n: plain(query, t.replace(" ", "")) for n, t in enumerate(texts)}
        want = {n: s for n, s in want.items() if s >= channels.OCR_CUTOFF}
        assert got.keys() == want.keys() and all(abs(got[n] - s) < 1e-9 for n, s in want.items())
