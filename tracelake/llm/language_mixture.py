"""Multilingual mixture inference: expectation-maximisation over n-gram likelihoods.

Each learned language is a smoothed distribution over hashed byte trigrams.  A word's likelihood under a
language is the product over its trigrams (word borders included).  For every document EM estimates
the proportions of the languages its words come from; nested sets (the strongest language, the two strongest, ...)
are refitted and the set with the best log-likelihood less log(words) / 2 per free
proportion (BIC) is selected.  The prediction is the largest proportion of that set, the score is
that proportion.  A further EM weighs the found mixture against a background under which all trigrams are alike: the
background's proportion is the share of words that fit no learned language (`unknown`), by which `accepted` rejects documents.

Training reads text and lang of rows that are not held out, at most TRAIN_PER_LANGUAGE documents of a
language (chosen by a hash of the id); every label is learned, so the table has BUCKETS x labels numbers.  Inference is a map over whole texts; nothing is shuffled.

Defined results: a null text or one without a letter is `und` with score 0, as is everything when there
is no labelled row (`accepted` then keeps nothing); labels that are null are not learned from; equal texts get equal
predictions; ties go to the language first in code point order; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import documents, held_out, small_batches
from tracelake.llm.textbytes import byte_texts, chunks, joined, word_edges

BUCKETS = 1 << 16
TRAIN_PER_LANGUAGE = 3000
#: Sets of up to TRIED languages are always tried, larger ones while each improves on the one before.
TRIED = 4
CHUNK_BYTES = 3 << 20
UNKNOWN = "und"
#: A document is rejected if a larger share of its words than this fits no learned language.
MAX_UNKNOWN = 0.5
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of words in lower-cased text: a-z and everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x61:0x7B] = _WORD[0x80:] = True
_CLEAN = np.where(_WORD, np.arange(256), 0x20).astype(np.uint32)


def _words(column: pa.Array):
    """Trigram bucket of every word byte, the start of each word in them, the document of each word."""
    texts = byte_texts(pc.utf8_lower(column))
    data, text_start = joined([b" " + t for t in texts])
    start, end = word_edges(data, _WORD)
    codes = _CLEAN[data]
    hashed = np.zeros(len(codes), np.uint32)
    hashed[1:-1] = (codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * np.uint32(2654435761) >> 16
    size = end - start
    first = np.cumsum(size) - size
    grams = hashed[_WORD[data]]
    return grams, first, np.searchsorted(text_start, start, side="right") - 1


def _count(languages: list[str]):
    place = {name: i for i, name in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in chunks(batches, CHUNK_BYTES):
            grams, first, owner = _words(batch.column(0))
            lang = np.array([place[x] for x in batch.column(1).to_pylist()])
            size = np.diff(np.append(first, len(grams)))
            by_gram = np.repeat(lang[owner], size)
            total += np.bincount(by_gram * BUCKETS + grams, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        names = ["lang", "bucket", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket])], names=names)

    return count


class Model:
    """Languages and the log-probability of each trigram bucket under each."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smoothed = counts.astype(np.float64) + 0.5
        self.table = np.log(smoothed / smoothed.sum(0)).astype(np.float32)


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, max_languages: int | None = None) -> Model:
    """Learn from text and lang of rows that are not held out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    found = (found.limit(max_languages) if max_languages else found).collect()
    languages = sorted(r["lang"] for r in found)
    counts = np.zeros((BUCKETS, len(languages)), np.int64)
    if not languages:
        return Model([], counts)
    share = F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, per_language / r["count"]))]), F.col("lang"))
    ticket = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    kept = rows.where(F.col("lang").isin(languages)).where(ticket < share).select("text", "lang")
    grams = kept.mapInArrow(_count(languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = grams.toPandas()  # at most BUCKETS x labels numbers
    counts[got["bucket"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts)


def _em(like: np.ndarray, first: np.ndarray, size: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over words (rows of like), documents being stretches of them; proportions and log-likelihood of each."""
    for _ in range(rounds):
        joint = like * np.repeat(pi, size, axis=0)
        joint /= joint.sum(1, keepdims=True)
        pi = np.add.reduceat(joint, first, axis=0) / size[:, None]
        pi = np.maximum(pi, 1e-6)
        pi /= pi.sum(1, keepdims=True)
    total = (like * np.repeat(pi, size, axis=0)).sum(1)
    return pi, np.add.reduceat(np.log(total), first)


def infer(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, list[list[float]], np.ndarray]:
    """Per text: language, score, size of the selected set, proportions (by model.languages), share of words of no language."""
    n, langs = len(column), len(model.languages)
    names, score, chosen, unknown = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64), np.ones(n)
    shares = np.zeros((n, langs))
    letters = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
    grams, start, owner = _words(column)
    if not langs or not len(start):
        # letters outside the learned alphabet only, or nothing learned
        return names, score, chosen, shares.tolist(), unknown
    like = np.add.reduceat(model.table[grams], start, axis=0)
    best = like.max(1)
    even = np.diff(np.append(start, len(grams))) * -np.log(BUCKETS)
    noise = np.exp(np.clip(even - best, -60.0, 60.0))
    like = np.exp(np.maximum(like - best[:, None], -60.0))
    docs, first = np.unique(owner, return_index=True)
    size = np.diff(np.append(first, len(owner)))
    pi, _ = _em(like, first, size, np.full((len(docs), langs), 1.0 / langs, np.float32), 6)
    order = np.argsort(-pi, axis=1, kind="stable")
    best_value, best_pi, best_k = np.full(len(docs), -np.inf), np.zeros((len(docs), langs)), np.ones(len(docs), np.int64)
    for k in range(1, langs + 1):
        going = (best_k == k - 1) | (k <= TRIED)
        if not going.any():
            break
        top = order[:, :k]
        part = np.take_along_axis(like, np.repeat(top, size, axis=0), axis=1)
        start_pi = np.take_along_axis(pi, top, axis=1)
        fit, value = _em(part, first, size, start_pi / start_pi.sum(1, keepdims=True), 3 if k > 1 else 0)
        value = value - 0.5 * (k - 1) * np.log(size + 1.0)
        better = going & (value > best_value)
        best_value[better], best_k[better] = value[better], k
        best_pi[better] = 0
        rows = np.flatnonzero(better)
        best_pi[rows[:, None], top[rows]] = fit[rows]
    mixed = (like * np.repeat(best_pi, size, axis=0)).sum(1)
    unknown[docs] = _em(np.stack([mixed, noise], 1), first, size, np.full((len(docs), 2), 0.5), 8)[0][:, 1]
    for row, d in enumerate(docs.tolist()):
        if letters[d]:
            best = int(best_pi[row].argmax())
            names[d], score[d], chosen[d] = model.languages[best], min(1.0, float(best_pi[row, best])), best_k[row]
            shares[d] = best_pi[row]
    return names, score, chosen, shares.tolist(), unknown


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, lang_pred, score, n_languages (of the selected set), unknown, proportions."""
    names = model.languages
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels floats

    def run(batches):
        for batch in chunks(batches, CHUNK_BYTES):
            lang, score, k, shares, unknown = infer(held.value, batch.column(1))
            made = [[(a, b) for a, b in zip(names, own, strict=True) if b > 0] for own in shares]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang), pa.array(score), pa.array(k), pa.array(unknown), pa.array(made, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "n_languages", "unknown", "proportions"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, n_languages long, unknown double, proportions map<string,double>")


def accepted(docs: DataFrame, model: Model, max_unknown: float = MAX_UNKNOWN) -> DataFrame:
    """The documents written in learned languages, with all their columns: lang_pred is not `und` and at most max_unknown of the
    words fit none of the languages found in them. """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels floats
    at = docs.columns.index("text")

    def run(batches):
        for batch in chunks(batches, CHUNK_BYTES):
            lang, _, _, _, unknown = infer(held.value, batch.column(at))
            yield batch.filter(pa.array([x != UNKNOWN and u <= max_unknown for x, u in zip(lang, unknown.tolist(), strict=True)]))

    return docs.mapInArrow(run, docs.schema)


def op1_language_mixture(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_languages", "unknown")


QUERIES = {"op1_language_mixture": op1_language_mixture}
ORACLE_SQL: dict[str, str] = {}
