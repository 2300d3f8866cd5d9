"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words (runs of a-z and of characters beyond ASCII) and their prefixes of 4 to 6 characters (so that
inflected forms share terms), held as 64-bit hashes.  Every example is indexed on all its terms.  A term's weight is its idf times a
factor that grows with the log-odds (in standard errors) of the term in toxic examples against the others and is
FLOOR for terms that do not speak for toxicity, so that these count, but little.

Rare terms are postings, summed up in full.  Frequent terms, which cost most, are held by blocks of BLOCK examples that are alike, with the
largest weight of each term in each block: the sum of those bounds what a block can add, and a block is scored for a text only if its
bound reaches the text's k-th best cosine so far.  Examples that may be among the k nearest are then scored again in
double precision, so the k nearest are exact.  Votes are weighted by a power of the cosine;
an isotonic fit over leave-one-out votes of the examples turns them into probabilities (of two steepnesses of the factor
the one whose votes fit better is kept).  The nearest
examples' ids are the evidence.

Training uses about MAX_LABELLED labelled rows at most (by a hash of the id, as evenly over class and language as their
numbers allow), never held-out ones; an example stands in votes and in the fit for all rows of its class and
language that it was drawn from.  The index is broadcast and bounded by that number.  Scoring is a map over whole texts.

Defined results: rows without an indexed term (empty and null texts too) get the rate of toxic rows among the
examples without one (with little to count, that of a prior of 1 %); a doc_id labelled twice counts as toxic if any label says so; null
labels are not used; without usable labels every score is 0; equal texts get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import documents, held_out, staged, table
from tracelake.llm.textbytes import U64, byte_texts, chunks, joined, mix64, noise64, word_edges

MAX_LABELLED = 3000
NEIGHBOURS = 15
BLOCK = 64
POWER = 4
THRESHOLD = 0.3
CHUNK_BYTES = 1 << 20
FLOOR = 0.1
#: The factor of a term is FLOOR + odds ** power / scale, with the pair that fits the left-out examples best.
SHARPNESS = ((3, 10.0), (2, 3.0))
FOLDS = 5
#: A term that at least one in FREQUENT examples has is a row of the dense matrix, MAX_DENSE terms at most.
FREQUENT, MAX_DENSE = 32, 2048
#: Rough cosines and bounds are within SLACK of the exact ones.
SLACK = 1e-4
QUERIES_AT_ONCE = 128
PREFIXES = (4, 5, 6)
#: Bytes of words in lower-cased text: a-z and everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x61:0x7B] = _WORD[0x80:] = True
_BYTE = noise64(256, 21)
_PLACE = noise64(1 << 14, 22)
_PREFIX = U64(0x5851F42D4C957F2D)


def hashed_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term of the texts: their words, and the words' prefixes (told apart from equal words)."""
    data, text_start = joined(byte_texts(pc.utf8_lower(column)))
    start, end = word_edges(data, _WORD)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row = np.searchsorted(text_start, start, side="right") - 1
    inside = np.flatnonzero(_WORD[data])
    place = inside - np.repeat(start, end - start)
    with np.errstate(over="ignore"):
        value = np.zeros(len(data) + 1, U64)
        value[inside + 1] = _BYTE[data[inside]] * _PLACE[place & (len(_PLACE) - 1)] * (U64(2) * (place >> 14).astype(U64) + U64(1))
        upto = np.cumsum(value)  # hashes are differences of sums, modulo 2 ** 64
        char = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(char, start)
        size = np.searchsorted(char, end) - first
        rows, hashes = [row], [mix64(upto[end] - upto[start] + (end - start).astype(U64))]
        for n in PREFIXES:
            some = np.flatnonzero(size > n)
            stop = char[first[some] + n]
            rows.append(row[some])
            hashes.append(mix64(upto[stop] - upto[start[some]] + (stop - start[some]).astype(U64) + _PREFIX))
    return np.concatenate(rows), np.concatenate(hashes).view(np.int64)


def _counted(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) in order, and how often each occurs; rows are few, so their sort is a radix sort."""
    order = np.argsort(value)
    row, value = row[order], value[order]
    order = np.argsort(row.astype(np.uint16) if row.max(initial=0) < 1 << 16 else row, kind="stable")
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + size[i] - 1 of all i, one after the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def term_weights(bad: np.ndarray, fine: np.ndarray, n1: float, n0: float, power: int, scale: float) -> np.ndarray:
    """Idf times the factor of terms in `bad` of n1 toxic and `fine` of n0 other examples."""
    odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((fine + 0.5) / (n0 + 1))
    odds = np.maximum(odds / np.sqrt(1 / (bad + 0.5) + 1 / (fine + 0.5)), 0)
    return np.log(1 + (n0 + n1) / (1 + bad + fine)) * (FLOOR + odds**power / scale)


class Index:
    """Inverted index of labelled examples, each on all its terms.

    hashes and counts hold the terms of all examples one after the other, sizes[i] of example i; stands is the
    number of labelled rows an example stands for."""

    def __init__(self, ids=(), toxic=(), sizes=(), hashes=(), counts=(), stands=(), empty_rate: float = 0.0):
        sizes, hashes = np.array(sizes, np.int64), np.asarray(hashes, np.int64)
        self.ids, self.toxic = np.array(ids, np.int64), np.array(toxic, np.float64)
        self.stands = np.array(stands, np.float64) / max(np.mean(stands), 1e-9) if len(self.ids) else np.empty(0)
        self.empty_rate = empty_rate
        self.begin = np.append(0, np.cumsum(sizes))
        self.terms = np.unique(hashes)
        self.number = np.empty(len(hashes), np.int32)
        often = np.empty(len(hashes), np.float32)
        fine, bad = np.zeros(len(self.terms)), np.zeros(len(self.terms))
        for i, y in enumerate(self.toxic.tolist()):
            part = slice(self.begin[i], self.begin[i + 1])
            number = np.searchsorted(self.terms, hashes[part])
            order = np.argsort(number)
            self.number[part] = number[order]
            often[part] = 1 + np.log(np.asarray(counts[part], np.float64)[order])
            (bad if y else fine)[number] += 1
        del hashes, counts
        n1 = self.toxic.sum()
        n0 = len(self.ids) - n1
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        least, sharp = np.inf, SHARPNESS[0]
        for pair in SHARPNESS if len(self.ids) else ():
            self._weigh(often, term_weights(bad, fine, n1, n0, *pair))
            raw = self._left_out(bad, fine, n1, n0, *pair)
            if (loss := fit_loss(raw, self.toxic, self.stands)) < least:
                least, sharp, self.knots = loss, pair, isotonic(raw, self.toxic, self.stands)
        self.sharp = sharp
        self._weigh(often, term_weights(bad, fine, n1, n0, *sharp))

    def _weigh(self, often: np.ndarray, idf: np.ndarray):
        """Unit weights of all examples' terms."""
        self.__dict__.update(idf=idf, weight=None, dense=None, posted=None, owner=None)
        self.weight = often * idf[self.number].astype(np.float32)
        for i in range(len(self.ids)):
            part = self.weight[self.begin[i] : self.begin[i + 1]]
            part /= np.sqrt((part.astype(np.float64) ** 2).sum())
        self._derive()

    def _left_out(self, bad, fine, n1, n0, power, scale) -> np.ndarray:
        """The vote of each example by the others, its terms weighed without its own label."""
        raw: list[float] = []
        for at in range(0, len(self.ids), QUERIES_AT_ONCE):
            part, queries = range(at, min(at + QUERIES_AT_ONCE, len(self.ids))), []
            for i in part:
                number, weight = self.example(i)
                y = self.toxic[i]
                weight *= term_weights(bad[number] - y, fine[number] - (1 - y), n1 - y, n0 - (1 - y), power, scale) / self.idf[number]
                queries.append((number, weight / np.sqrt((weight**2).sum())))
            raw += [self.vote(*near) for near in self.search(queries, skips=list(part))]
        return np.array(raw)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("dense", "bound", "place", "row", "first", "size", "owner", "posted")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._derive()

    def _derive(self):
        """Postings of rare terms; of frequent ones the matrix by blocks and the largest weight in each block."""
        n, df = len(self.ids), np.bincount(self.number, minlength=len(self.terms))
        often = np.flatnonzero(df > max(n / FREQUENT, 1))
        often = np.sort(often[np.argsort(-df[often], kind="stable")][:MAX_DENSE])
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[often] = np.arange(len(often))
        # examples that are alike stand together: by class, then by their two strongest frequent terms
        strong = np.zeros((2, n), np.int32)
        for i in range(n):
            part = slice(self.begin[i], self.begin[i + 1])
            row = self.row[self.number[part]]
            best = row[row >= 0][np.argsort(-self.weight[part][row >= 0], kind="stable")[:2]]
            strong[: len(best), i] = best + 1
        order = np.lexsort((strong[1], strong[0], self.toxic))
        self.place = np.empty(n, np.int64)  # column of each example
        self.place[order] = np.arange(n)
        self.dense = np.zeros((len(often), n), np.float32)
        for i in range(n):
            part = slice(self.begin[i], self.begin[i + 1])
            row = self.row[self.number[part]]
            self.dense[row[row >= 0], self.place[i]] = self.weight[part][row >= 0]
        heads = np.arange(0, n, BLOCK)
        self.bound = np.maximum.reduceat(self.dense, heads, axis=1) if n else self.dense
        rest = np.flatnonzero(self.row[self.number] < 0).astype(np.int32)
        rest = rest[np.argsort(self.number[rest], kind="stable").astype(np.int32)]
        self.owner = self.place[np.searchsorted(self.begin, rest, side="right") - 1].astype(np.int32)
        self.posted = self.weight[rest]
        self.size = np.where(self.row < 0, df, 0)
        self.first = np.cumsum(self.size) - self.size

    def example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.begin[i], self.begin[i + 1])
        return self.number[part], self.weight[part].astype(np.float64)

    def _rough(self, queries, k: int, skips: list[int] | None) -> np.ndarray:
        """Cosines (queries x columns) within SLACK / 2; -1 in blocks that cannot hold one of a query's k best."""
        n, heads = len(self.ids), np.arange(0, len(self.ids), BLOCK)
        known, out = np.zeros((len(queries), len(self.dense)), np.float32), np.zeros((len(queries), n), np.float32)
        for q, (number, weight) in enumerate(queries):
            row = self.row[number]
            known[q, row[row >= 0]] = weight[row >= 0]
            size = self.size[number]
            at = _ranges(self.first[number], size)
            out[q] = np.bincount(self.owner[at], self.posted[at] * np.repeat(weight, size), n)
        if skips:
            out[np.arange(len(queries)), self.place[skips]] = -np.inf
        bound = known @ self.bound + np.maximum.reduceat(out, heads, axis=1)
        best = np.full((len(queries), k), -np.inf, np.float32)
        for b in np.argsort(-bound.max(0), kind="stable").tolist():
            block = slice(heads[b], heads[b] + BLOCK)
            some = np.flatnonzero(bound[:, b] >= np.maximum(best[:, 0] - SLACK, 0))
            skipped = np.ones(len(queries), bool)
            skipped[some] = False
            out[skipped, block] = -1
            if len(some):
                found = known[some] @ self.dense[:, block] + out[some, block]
                out[some, block] = found
                both = np.concatenate([best[some], found], 1)
                best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        return out

    def search(self, queries, k: int = NEIGHBOURS, skips: list[int] | None = None):
        """Per query (term numbers, weights) its k examples of largest cosine: (examples, cosines), exact."""
        rough = self._rough(queries, k, skips)
        example = np.argsort(self.place)
        full = np.zeros(len(self.terms))
        out = []
        for q, (number, weight) in enumerate(queries):
            cosine = rough[q]
            least = np.partition(cosine, -k)[-k] if len(cosine) > k else 0.0
            some = np.sort(example[np.flatnonzero(cosine > max(least - SLACK, 0))])
            full[number] = weight
            size = self.begin[some + 1] - self.begin[some]
            at = _ranges(self.begin[some], size)
            exact = np.bincount(np.repeat(np.arange(len(some)), size), self.weight[at] * full[self.number[at]], len(some))
            full[number] = 0
            best = np.lexsort((some, -exact))[:k]
            best = best[exact[best] > 0]
            out.append((some[best].tolist(), exact[best].tolist()))
        return out

    def nearest(self, number: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, skip: int | None = None):
        """The k examples of largest cosine: (examples, cosines), exact; skip leaves one example out."""
        return self.search([(number, weight)], k, None if skip is None else [skip])[0]

    def vote(self, examples: list[int], cosines: list[float]) -> float:
        share = np.array(cosines) ** POWER * self.stands[examples]
        return float((share * self.toxic[examples]).sum() / (share.sum() + 0.05)) if examples else 0.0

    def vectors(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Unit TF-IDF vectors (term numbers in order, weights) of texts."""
        row, hashes, n = _counted(*hashed_terms(column))
        order = np.argsort(hashes)  # sorted needles are found several times faster
        at = np.empty(len(hashes), np.int64)
        at[order] = np.minimum(np.searchsorted(self.terms, hashes[order]), len(self.terms) - 1)
        known = self.terms[at] == hashes
        row, number, n = row[known], at[known], n[known]
        weight = (1 + np.log(n)) * self.idf[number]
        edge = np.searchsorted(row, np.arange(len(column) + 1))
        parts = [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return [(number[p], weight[p] / np.sqrt((weight[p] ** 2).sum()) if p.stop > p.start else weight[p]) for p in parts]

    def score(self, texts) -> list[tuple[float, list[int]]]:
        """Per text the calibrated score and the ids of the nearest examples."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(self.terms):
            return [(self.empty_rate, [])] * len(column)
        out = []
        for at in range(0, len(column), QUERIES_AT_ONCE):
            for near, cosines in self.search(self.vectors(column.slice(at, QUERIES_AT_ONCE))):
                value = float(np.interp(self.vote(near, cosines), *self.knots)) if near else self.empty_rate
                out.append((value, self.ids[near[:5]].tolist()))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a non-decreasing fit of y on x with weights w, as knots for interpolation."""
    order = np.argsort(x, kind="stable")
    w = np.ones(len(x)) if w is None else w
    pools: list[list[float]] = []  # weight, weighted sum of y, weighted sum of x
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([c, b * c, a * c])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0] or pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]):
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    fit = np.array([(s / n) for n, s, _ in pools])
    at = np.array([t / n for n, _, t in pools])
    weight = np.array([p[0] for p in pools])
    return at, (fit * weight + 0.5 * np.average(y, weights=w)) / (weight + 0.5)  # a little shrinkage for tiny pools


def fit_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Log loss of y under isotonic fits that did not see it."""
    fold, p = np.arange(len(x)) % FOLDS, np.full(len(x), 0.5)
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            p[fold == k] = np.interp(x[fold == k], *isotonic(x[fold != k], y[fold != k], w[fold != k]))
    p = np.clip(p, 0.002, 0.998)
    return float(-np.average(y * np.log(p) + (1 - y) * np.log(1 - p), weights=w))


def _even(sizes: list[tuple[int, int]], most: int) -> float:
    """The largest share c with the sum of min(size, c) over strata, given as (size, strata of it), at most `most`."""
    left, strata = most, sum(n for _, n in sizes)
    for size, n in sorted(sizes):
        if size * strata >= left:
            return left / strata
        left, strata = left - size * n, strata - n
    return float(max((size for size, _ in sizes), default=1))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Index:
    """Index examples from labelled rows that are not held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("_id")))
    marked = marked.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    spoken = docs.select(F.col("doc_id").cast("long").alias("_doc"), lang.alias("lang")).join(marked, F.col("_doc") == F.col("_id"))
    spoken = spoken.groupBy("_id").agg(F.max("toxic").alias("toxic"), F.min("lang").alias("lang"))
    strata = staged(spoken.groupBy("toxic", "lang").agg(F.count("*").alias("size")), "toxicity-strata")
    classes = {r[0] for r in strata.select("toxic").distinct().collect()}
    if classes != {0, 1}:
        return Index(empty_rate=float(classes == {1}))
    even = _even([tuple(r) for r in strata.groupBy("size").count().collect()], max_labelled)
    ticket = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    some = spoken.join(strata, ["toxic", "lang"]).where(ticket < F.lit(even) / F.col("size"))
    some = some.select("_id", "toxic", F.greatest(F.lit(1.0), F.col("size") / F.lit(even)).alias("stands"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(some), text["doc_id"] == some["_id"]).select("doc_id", "toxic", "stands", "text")  # max_labelled rows

    def hashed(batches):
        for batch in chunks(batches, CHUNK_BYTES):
            row, value, n = _counted(*hashed_terms(batch.column(3)))
            edge = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            own = [pa.ListArray.from_arrays(edge, pa.array(value, pa.int64())), pa.ListArray.from_arrays(edge, pa.array(n, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *own], names=["doc_id", "toxic", "stands", "hashes", "counts"])

    got = rows.mapInArrow(hashed, "doc_id long, toxic int, stands double, hashes array<long>, counts array<int>").toArrow()
    full = pc.greater(pc.list_value_length(got["hashes"]), 0)
    bare, got = got.filter(pc.invert(full)), got.filter(full)
    every, bad = sum(bare["stands"].to_pylist()), sum(s for s, y in zip(bare["stands"].to_pylist(), bare["toxic"].to_pylist(), strict=True) if y)
    empty_rate = (bad + 0.5) / (every + 50.0)
    got = got.take(np.lexsort([got[c].to_numpy() for c in ("toxic", "doc_id")]))
    ids, toxic, stands = (got[c].to_numpy() for c in ("doc_id", "toxic", "stands"))
    sizes = pc.list_value_length(got["hashes"]).to_numpy()
    return Index(ids, toxic, sizes, *(pc.list_flatten(got[c]).to_numpy() for c in ("hashes", "counts")), stands, empty_rate)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """Per document: doc_id, score, evidence (ids of the nearest examples)."""
    held = docs.sparkSession.sparkContext.broadcast(index)  # MAX_LABELLED examples, about

    def run(batches):
        own = held.value
        for batch in chunks(batches, CHUNK_BYTES):
            got = own.score(batch.column(1))
            cols = [batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, evidence array<long>")


def op10_toxicity_knn(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"),
    )


QUERIES = {"op10_toxicity_knn": op10_toxicity_knn}
ORACLE_SQL: dict[str, str] = {}
