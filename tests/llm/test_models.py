"""Language mixture, toxicity and PII: models held to held-out rows, exact search and plain patterns."""

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import language_mixture, pii_tagger, toxicity_knn
from tracelake.llm.common import held_out, table

DATA = "/root/testdata/sf0.01"


def test_held_out_rule(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


# ---- language --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def languages(spark):
    return language_mixture.train(table(spark, DATA, "documents"))


def test_language_accuracy_on_held_out_rows(spark, languages):
    docs = table(spark, DATA, "documents")
    found = language_mixture.identify(docs, languages).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.where(held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98


def test_language_edge_cases(spark, documents, languages):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the of and to"), (4, "the of and to"), (5, "x"), (6, "the and of " * 60_000), (None, "der die und das"), (7, "日本語")]
    got = {r["doc_id"]: r for r in language_mixture.identify(documents(rows, extra=True), languages).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[4]["lang_pred"] == got[6]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    assert got[7]["lang_pred"] in languages.languages and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_mixture.identify(documents([]), languages).collect() == []
    kept = language_mixture.accepted(documents(rows, extra=True), languages)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, (4, 4, 6, None)))


def test_mixture_proportions(languages):
    english, german = "the thing of that and this with from " * 12, "der und nicht mit sich auch keit lich " * 12
    names, score, k, shares, _ = language_mixture.infer(languages, pa.array([english, german, english + german, english * 3 + german]))
    assert names[:2] == ["en", "de"] and k[0] == k[1] == 1 and k[2] == k[3] == 2
    de, en = languages.languages.index("de"), languages.languages.index("en")
    assert abs(shares[2][de] - 0.5) < 0.1 and abs(shares[3][en] - 0.75) < 0.1


def plain_mixture(model, text):
    """EM, nested sets and the background share of one text, number by number."""
    words = re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())
    log = []
    for word in words:
        framed = b" " + word + b" "
        grams = [((framed[i] << 16 | framed[i + 1] << 8 | framed[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(word))]
        log.append(([sum(float(model.table[g, k]) for g in grams) for k in range(len(model.languages))], -len(grams) * np.log(language_mixture.BUCKETS)))
    like = [[np.exp(max(v - max(own), -60)) for v in own] for own, _ in log]
    noise = [np.exp(min(max(even - max(own), -60), 60)) for own, even in log]

    def em(rows, pi, rounds):
        for _ in range(rounds):
            total = [0.0] * len(pi)
            for row in rows:
                joint = [v * p for v, p in zip(row, pi, strict=True)]
                total = [t + j / sum(joint) for t, j in zip(total, joint, strict=True)]
            pi = [max(t / len(rows), 1e-6) for t in total]
            pi = [p / sum(pi) for p in pi]
        return pi, sum(np.log(sum(v * p for v, p in zip(row, pi, strict=True))) for row in rows)

    langs = len(model.languages)
    pi, _ = em(like, [1 / langs] * langs, 6)
    order = sorted(range(langs), key=lambda k: -pi[k])
    best = (-np.inf, None, None)
    for k in range(1, langs + 1):
        top = order[:k]
        start = [pi[j] / sum(pi[i] for i in top) for j in top]
        fit, value = em([[row[j] for j in top] for row in like], start, 3 if k > 1 else 0)
        value -= 0.5 * (k - 1) * np.log(len(words) + 1)
        if value > best[0]:
            best = (value, k, {j: f for j, f in zip(top, fit, strict=True)})
    mixed = [[sum(f * row[j] for j, f in best[2].items()), u] for row, u in zip(like, noise, strict=True)]
    return best[1], [best[2].get(j, 0.0) for j in range(langs)], em(mixed, [0.5, 0.5], 8)[0][1]


def test_inference_against_plain_numbers(spark, languages):
    texts = [r["text"][:600] for r in table(spark, DATA, "documents").orderBy("doc_id").limit(40).collect()]
    texts += [a[:150] + " " + b[:300] for a, b in zip(texts, texts[7:], strict=False)] + ["xq zzkw vvjq the", "token 0b9a3c6a43eb78aa99cbd7049c"]
    names, score, k, shares, unknown = language_mixture.infer(languages, pa.array(texts))
    for i, text in enumerate(texts):
        size, want, noise = plain_mixture(languages, text)
        assert k[i] == size and np.allclose(shares[i], want, atol=1e-3) and abs(unknown[i] - noise) < 1e-3
        assert names[i] == languages.languages[int(np.argmax(shares[i]))] and abs(score[i] - max(want)) < 1e-3


def test_accepted_rejects_text_of_no_language(spark, documents, languages):
    rng = np.random.default_rng(4)
    odd = [" ".join("".join(rng.choice(list("bcdfghjkqwxz"), 7)) for _ in range(60)) for _ in range(20)]
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    assert docs.count() - language_mixture.accepted(docs, languages).count() <= 0.005 * docs.count()
    rows = [(i, t) for i, t in enumerate(odd)] + [(100, "the thing of that and this with from")]
    assert [r["doc_id"] for r in language_mixture.accepted(documents(rows), languages).collect()] == [100]


def test_without_labels_everything_is_unknown(spark, documents):
    model = language_mixture.train(documents([(1, "a b", None)]))
    assert [r["lang_pred"] for r in language_mixture.identify(documents([(1, "a b")]), model).collect()] == ["und"]


# ---- toxicity --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark):
    return toxicity_knn.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"))


def test_toxicity_on_held_out_rows(spark, index):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    rows = toxicity_knn.score(docs, index).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    caught = [r["score"] >= 0.3 for r in rows if r["toxic"]]
    wrong = [r["score"] >= 0.3 for r in rows if not r["toxic"]]
    assert np.mean(caught) >= 0.9 and np.mean(wrong) < 0.05


def terms_of(text):
    """Words and word prefixes of a text with their counts, by plain Python."""
    out = Counter()
    for word in re.findall("[a-z\x80-\U0010ffff]+", (text or "").lower()):
        out.update([word, *(word[:size] + "*" for size in toxicity_knn.PREFIXES if len(word) > size)])
    return out


def test_nearest_against_all_pairs_of_texts(spark, index):
    """Cosines of some texts with every example, computed from the texts alone."""
    docs = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    examples = [terms_of(docs[i]) for i in index.ids.tolist()]
    bad, fine = Counter(), Counter()
    for own, y in zip(examples, index.toxic, strict=True):
        (bad if y else fine).update(list(own))
    names = sorted({*bad, *fine})
    assert len(names) == len(index.terms)
    n1 = index.toxic.sum()
    weight = toxicity_knn.term_weights(np.array([bad[t] for t in names]), np.array([fine[t] for t in names]), n1, len(examples) - n1, *index.sharp)
    idf = dict(zip(names, weight.tolist(), strict=True))

    def unit(own):
        made = {t: (1 + np.log(n)) * idf[t] for t, n in own.items() if t in idf}
        size = sum(v * v for v in made.values()) ** 0.5
        return {t: v / size for t, v in made.items()}

    every = [unit(own) for own in examples]
    asked = [docs[d] for d in sorted(docs)[::25]]
    got = index.search(index.vectors(pa.array(asked, pa.string())))
    for text, (near, cosines) in zip(asked, got, strict=True):
        own = unit(terms_of(text))
        exact = np.array([sum(v * other.get(t, 0.0) for t, v in own.items()) for other in every])
        want = np.sort(exact)[::-1][: toxicity_knn.NEIGHBOURS]
        want = want[want > 0]
        assert len(cosines) == len(want) and np.allclose(cosines, want, atol=1e-5) and np.allclose(exact[near], cosines, atol=1e-5)


def test_toxicity_edge_cases(spark, documents, index):
    rows = [(1, None), (2, ""), (3, "nothing here"), (3, "nothing here"), (4, "idiot moron clown " * 20_000), (None, "idiot moron scum trash")]
    got = [(r["doc_id"], r["score"]) for r in toxicity_knn.score(documents(rows, extra=True), index).collect()]
    assert all(0 <= s <= 1 for _, s in got) and all(s < 0.3 for d, s in got if d in (1, 2, 3)) and all(s >= 0.3 for d, s in got if d in (4, None))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity_knn.score(documents([(1, "a")]), toxicity_knn.train(documents([(1, "a")]), none)).collect()] == [0.0]


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.random(200)
    at, fit = toxicity_knn.isotonic(x, (rng.random(200) < x).astype(float))
    assert (np.diff(at) >= 0).all() and (np.diff(fit) >= -0.2).all() and fit[-1] > fit[0]


# ---- personal data ---------------------------------------------------------------------------------------------------

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                kind == 0
                or kind == 1 and all(int(v) <= 255 for v in m[0].split("."))
                or kind == 2 and 14 <= len(digits) <= 19 and pii_tagger.luhn(digits)
                or kind == 3 and 10 <= len(digits) <= 15
            )
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(0)
    for _ in range(20_000):
        text = "".join(rng.choice(list("aB0123 .@+-()%\n1é"), int(rng.integers(0, 40))))
        assert pii_tagger.base_spans(text) == plain_spans(text), text
    texts = ["a@b.c@d.e f", "1.2.3.4.5.6.7.8", "+1 (386) 555-1832", "4111 1111 1111 1111", "x.y@z", "a@@b.cc", "0256.1.1.1 00000001.2.3.4"]
    assert all(pii_tagger.base_spans(t) == plain_spans(t) for t in texts)


def test_long_texts_scan_in_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "1." * 150_000, "+1" * 150_000, "a." * 150_000 + "@"):
        pii_tagger.base_spans(text)


def test_gradients():
    tagger = pii_tagger.Tagger()
    chars, tags, mask = (x[:4] for x in pii_tagger._training_windows(pii_tagger.examples(5)))
    _, grads = tagger.gradients(chars, tags, mask)
    for name, g in grads.items():
        w, at = tagger.w[name], np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = tagger.gradients(chars, tags, mask)[0]
        w[at] = old - 1e-5
        down = tagger.gradients(chars, tags, mask)[0]
        w[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at])), name


def test_tagger_on_held_out_examples():
    tagger, labelled = pii_tagger.trained(), pii_tagger.examples(200, seed=99)
    found = pii_tagger.added_spans(tagger, [t for t, _ in labelled], [[] for _ in labelled])
    hit = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, labelled, strict=True))
    assert hit / sum(map(len, found)) > 0.95 and hit / sum(len(b) for _, b in labelled) > 0.9


def plain_tags(tagger, text):
    """Window scores averaged over the whole text, then Viterbi by plain loops."""
    code = pii_tagger.codes(text)
    size, total, weight = len(code), np.zeros((len(code), pii_tagger.TAGS)), np.zeros(len(code))
    for at in range(0, max(1, size - pii_tagger.STEP), pii_tagger.STEP):
        window = np.zeros((1, pii_tagger.WINDOW), np.uint8)
        window[0, : len(code[at : at + pii_tagger.WINDOW])] = code[at : at + pii_tagger.WINDOW]
        emit = tagger.emissions(window)[0][:, 0]
        for i in range(min(pii_tagger.WINDOW, size - at)):
            near = 1 + min(i, pii_tagger.WINDOW - 1 - i)
            total[at + i] += near * emit[i]
            weight[at + i] += near
    score = total / weight[:, None]
    best = [{k: score[0, k] + tagger.w["start"][k] for k in range(pii_tagger.TAGS) if k == 0 or k % 2}]
    back = []
    for t in range(1, size):
        now, come = {}, {}
        for k in range(pii_tagger.TAGS):
            way = {j: v + tagger.w["move"][j, k] for j, v in best[-1].items() if tagger.allowed[j, k]}
            if way:
                come[k] = max(way, key=way.get)
                now[k] = way[come[k]] + score[t, k]
        best.append(now)
        back.append(come)
    out = [max(best[-1], key=best[-1].get)]
    for come in reversed(back):
        out.append(come[out[-1]])
    return out[::-1]


def test_streamed_decoding_against_plain_loops(monkeypatch):
    tagger = pii_tagger.trained()
    texts = [t for t, _ in pii_tagger.examples(25, seed=3)] + [" ".join(t for t, _ in pii_tagger.examples(6, seed=4)), "7", "a" * 24, "1" * 48, "x" * 49]
    want = [plain_tags(tagger, t) for t in texts]
    for batch in (512, 7, 1):
        monkeypatch.setattr(pii_tagger, "BATCH", batch)
        assert [t.tolist() for t in pii_tagger.tagged(tagger, texts)] == want


def test_loose_forms_in_held_out_documents(spark):
    """Base spans of held-out documents, rewritten into loose forms where they stand, are added; nothing else is."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    tagger = pii_tagger.train(docs)
    texts = [r["text"] for r in docs.where(held_out(F.col("doc_id")) & F.col("text").rlike("[0-9@]")).select("text").collect()]
    labelled = pii_tagger.stretch_examples(texts, 2000, 17)
    base = [pii_tagger.base_spans(t) for t, _ in labelled]
    found = pii_tagger.added_spans(tagger, [t for t, _ in labelled], base)
    for kind in range(4):
        planted = [(n, s) for n, (_, spans) in enumerate(labelled) for s in spans if s[2] == kind and s not in base[n]]
        assert len(planted) > 20 and sum(s in found[n] for n, s in planted) >= 0.9 * len(planted), pii_tagger.KINDS[kind]
    made = {(n, s) for n, own in enumerate(found) for s in own}
    right = {(n, s) for n, (_, spans) in enumerate(labelled) for s in spans}
    assert len(made - right) <= 0.03 * len(made)


def test_long_words_are_spanned_whole():
    long = "abcdefgh" * 12
    text = f"write {long} (at) {long} (dot) com or call"
    a, b = pii_tagger.stretches(text)[0]
    assert a <= 6 and text[:b].endswith(long)
    assert pii_tagger.stretches("x" * 500 + "7" + "y" * 500 + " z" * 60) == [(0, 1001)]


def test_a_text_full_of_seeds_is_decoded_as_a_stream():
    import tracemalloc

    text = "12 345 a@ 6.7 " * 20_000
    tracemalloc.start()
    pii_tagger.added_spans(pii_tagger.trained(), [text], [pii_tagger.base_spans(text)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * len(text)


def test_tag_query_edge_cases(spark, documents):
    text = "é mail a.b@c.de or john [at] host [dot] com, call +1 (386) 555-1832"
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "no data"), (None, "9.9.9.9"), (5, "word " * 50_000 + "x@y.zz")]
    got = [r for r in pii_tagger.tag(documents(rows, extra=True)).collect()]
    first = [r for r in got if r["doc_id"] == 1]
    assert len(first) == 2 and first[0] == first[1] and (first[0]["n_email"], first[0]["n_phone"]) == (1, 1)
    base = set(pii_tagger.joined_spans(pii_tagger.base_spans(text)).split(","))
    assert base <= set(first[0]["spans"].split(",")) and first[0]["n_added"] == len(first[0]["spans"].split(",")) - 2 == first[0]["n_spans"] - 2
    assert all(r["spans"] == "" for r in got if r["doc_id"] in (2, 3, 4))
    assert [r["n_ip"] for r in got if r["doc_id"] is None] == [1] and [r["n_email"] for r in got if r["doc_id"] == 5] == [1]
    assert pii_tagger.tag(documents([])).collect() == []
    assert "@" not in pii_tagger.redact(text) and pii_tagger.redact(None) is None
