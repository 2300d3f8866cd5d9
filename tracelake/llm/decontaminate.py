"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded stretch of the training words of a partition.  Its symbols are the benchmark's
words; every run of other words is one symbol of its own (no test phrase contains it), and so is the
end of a document.  The shard's suffix array (prefix doubling on packed symbols) gives its Burrows-Wheeler transform, held
in a wavelet matrix.  All test phrases (windows of WINDOW words) are backward-searched at once through
wavelet ranks; each occurrence is located by walking LF steps to the nearest sampled suffix position.
Occurrences are merged into removal spans.

Shards are cut at SHARD symbols with an overlap of one phrase less a word, so a very long document is
searched whole.  Of the phrases only those are searched all of whose words occur in the shard.  Training rows never
move: the operator is a map.  Only phrases are broadcast, in
blocks of at most BLOCK_BYTES of benchmark text (some 16 bytes a word: the words once, and where each phrase starts; a larger item is cut
between words with the overlap of a phrase); a larger benchmark takes several passes whose spans are merged per row.

Defined results: a null or wordless text has no words and no hits; a null, empty or wordless item has
no window; a null item_id counts as the empty string; an item_id that comes with several texts
has the windows of all; repeated documents get repeated rows; empty tables give empty results or no hits.
Words are compared by 64-bit hashes of their lower-cased bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import documents, small_batches, table
from tracelake.llm.textbytes import ALNUM, LOWER, byte_texts, chunks, joined, word_edges, word_hashes

WINDOW = 10
SHARD = 1_000_000
SAMPLE = 16
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 3 << 20
#: Symbols: the one end of a shard (smallest), document ends, runs of other words, then phrase words.
_STOP, _END, _OTHER, _FIRST = 0, 1, 2, 3


class WaveletMatrix:
    """Ranks and symbols of an integer sequence."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        rest = symbols.astype(np.int32)
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1
            count = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append(count)
            self.zeros.append(len(rest) - int(count[-1]))
            mask = ones.astype(bool)
            rest = np.concatenate([rest[~mask], rest[mask]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before position `at` (both arrays)."""
        low, high = np.zeros_like(at), at
        for k, (count, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (len(self.levels) - 1 - k)) & 1 == 1
            a, b = count[low], count[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def symbol_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, low, high = np.zeros_like(at), np.zeros_like(at), at
        for count, zeros in zip(self.levels, self.zeros, strict=True):
            a, b = count[low], count[high]
            one = count[high + 1] > b
            symbol = symbol * 2 + one
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return symbol, high - low


def suffix_array(symbols: np.ndarray, size: int, enough: int | None = None) -> np.ndarray:
    """Suffix array by prefix doubling; the first sort packs as many symbols as fit 62 bits.

    With `enough`, suffixes are told apart by that many symbols at least, and equal ones stay in any order."""
    n = len(symbols)
    bits = max(1, int(size).bit_length())
    depth = max(1, 62 // bits)
    # the first `depth` symbols as one number, from stretches of 1, 2, 4, ... symbols; past the end stands 0, less than every symbol + 1
    part, span, key, done = symbols.astype(np.int64) + 1, 1, np.zeros(n, np.int64), 0
    while True:
        if depth & span:
            key <<= bits * span
            key[: max(0, n - done)] |= part[done:]
            done += span
        if 2 * span > depth:
            break
        wide = part << (bits * span)
        wide[: max(0, n - span)] |= part[span:]
        part, span = wide, 2 * span
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(new)
    rank[order] = first[np.cumsum(new) - 1]
    size_of = np.diff(np.append(first, n))
    open_at = np.flatnonzero(np.repeat(size_of > 1, size_of))
    while len(open_at) and (enough is None or depth < enough):  # sort what is still open by the rank `depth` further on
        suffix = order[open_at]
        after = suffix + depth
        behind = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + behind
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[open_at] = suffix
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        rank[suffix] = open_at[first][group]
        size = np.diff(np.append(first, len(key)))
        open_at = open_at[size[group] > 1]
        depth *= 2
    return order


class FMIndex:
    """FM-index of one shard: count by backward search, locate by sampled suffix positions.

    The last symbol must be _STOP and occur once."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = SAMPLE):
        order = suffix_array(symbols, size)
        self.n = len(symbols)
        self.wavelet = WaveletMatrix(symbols[order - 1], size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        kept = order % sample == 0
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.positions = order[kept]

    def ranges(self, stream: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) row of the suffixes that start with each phrase, phrase i being stream[start[i]:][:lengths[i]]."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        alive = np.arange(len(start))
        for back in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[(lengths[alive] >= back) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = stream[start[alive] + lengths[alive] - back].astype(np.int64)
            base = self.before[symbol]
            low[alive] = base + self.wavelet.rank(symbol, low[alive])
            high[alive] = base + self.wavelet.rank(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        out = np.empty(len(rows), np.int64)
        at, steps, todo = rows.astype(np.int64), 0, np.arange(len(rows))
        while len(todo):
            found = self.kept[at]
            out[todo[found]] = self.positions[self.kept_before[at[found]]] + steps
            todo, at = todo[~found], at[~found]
            if len(todo):
                symbol, rank = self.wavelet.symbol_rank(at)
                at = self.before[symbol] + rank
            steps += 1
        return out


class Phrases:
    """The distinct windows of a block of benchmark items, as stretches of the items' symbols, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        hashes = []
        for _, text in items:
            data = LOWER[joined([text])[0]]
            hashes.append(word_hashes(data, *word_edges(data, ALNUM)))
        size = np.array([len(h) for h in hashes], np.int64)
        every = np.concatenate([*hashes, np.empty(0, np.uint64)])
        self.longest = window
        self.vocabulary = np.unique(every)
        self.size = len(self.vocabulary) + _FIRST
        self.stream = (np.searchsorted(self.vocabulary, every) + _FIRST).astype(np.int32)
        many = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
        start = np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many) + np.arange(many.sum())
        lengths = np.repeat(np.minimum(size, window), many)
        self.names, name = np.unique(np.array([n for n, _ in items], object), return_inverse=True) if items else (np.empty(0, object), np.empty(0, np.int64))
        padded = np.append(self.stream, np.zeros(window, np.int32))
        rows = padded[start[:, None] + np.arange(window)] * (np.arange(window) < lengths[:, None])
        rows = np.ascontiguousarray(rows, np.int32).view(np.dtype((np.void, 4 * window))).reshape(-1)
        _, first, phrase = np.unique(rows, return_index=True, return_inverse=True) if len(rows) else (None, *[np.empty(0, np.int64)] * 2)
        self.start, self.lengths = start[first].astype(np.int32), lengths[first].astype(np.int32)
        pairs = np.unique(phrase.astype(np.int64) * max(1, len(self.names)) + np.repeat(name, many))
        self.item = (pairs % max(1, len(self.names))).astype(np.int32)
        self.item_begin = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(first) + 1)).astype(np.int32)

    def items_of(self, phrase: int) -> list[str]:
        return self.names[self.item[self.item_begin[phrase] : self.item_begin[phrase + 1]]].tolist()

    def met(self, symbols: np.ndarray) -> np.ndarray:
        """The phrases all of whose words are among the symbols."""
        there = np.zeros(self.size, bool)
        there[symbols] = True
        missing = np.concatenate([[0], np.cumsum(~there[self.stream])])
        return np.flatnonzero(missing[self.start + self.lengths] == missing[self.start])

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; those not in any phrase are _OTHER."""
        if not len(self.vocabulary):
            return np.full(len(hashes), _OTHER, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + _FIRST, _OTHER).astype(np.int32)


def search(phrases: Phrases, texts: list[bytes], shard: int = SHARD):
    """Per text: number of words, hit spans in words and in bytes, item names."""
    data, text_start = joined(texts)
    data = LOWER[data]
    start, end = word_edges(data, ALNUM)
    owner = np.searchsorted(text_start, start, side="right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    symbols = phrases.encode(word_hashes(data, start, end))
    # the stream: words and document ends; a run of other words is kept as one symbol
    new_doc = np.diff(owner, prepend=owner[:1]) != 0
    keep = (symbols != _OTHER) | new_doc
    keep[1:] |= symbols[:-1] != _OTHER
    word = np.flatnonzero(keep)
    symbol = np.where(new_doc[word] & (symbols[word] == _OTHER), _END, symbols[word])
    ends = np.flatnonzero(new_doc[word] & (symbol != _END))  # a document that starts with a phrase word
    symbol = np.insert(symbol, ends, _END)
    word = np.insert(word, ends, -1)
    overlap = phrases.longest - 1
    hit_word, hit_size, hit_phrase = [], [], []
    at = 0
    while at < len(symbol) and len(phrases.lengths):
        stop = min(len(symbol), at + max(shard, 2 * overlap + 1))
        piece = np.append(symbol[at:stop], _STOP)
        asked = phrases.met(piece)
        if len(asked):
            index = FMIndex(piece, phrases.size)
            low, high = index.ranges(phrases.stream, phrases.start[asked], phrases.lengths[asked])
            some = np.flatnonzero(high > low)
            count = (high - low)[some]
            if len(some):
                rows = np.repeat(low[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                hit_word.append(word[at + index.locate(rows)])
                hit_phrase.append(np.repeat(asked[some], count))
                hit_size.append(phrases.lengths[hit_phrase[-1]])
        if stop == len(symbol):
            break
        at = stop - overlap
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    byte_spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    names: list[set[str]] = [set() for _ in texts]
    if hit_word:
        first, size, phrase = np.concatenate(hit_word), np.concatenate(hit_size), np.concatenate(hit_phrase)
        doc = owner[first]
        for d, p in np.unique(np.stack([doc, phrase]), axis=1).T.tolist():
            names[d].update(phrases.items_of(p))
        change = np.zeros(len(start) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + size, -1)
        hit = np.cumsum(change)[:-1] > 0
        turn = np.diff(hit.astype(np.int8), prepend=0)
        opens = np.flatnonzero((turn == 1) | (hit & new_doc))
        closes = np.flatnonzero(np.diff(hit.astype(np.int8), append=0) == -1)
        closes = np.union1d(closes, np.flatnonzero(hit & np.append(new_doc[1:], True)))
        word_base = np.cumsum(n_words) - n_words
        for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
            d = int(owner[a])
            spans[d].append((int(a - word_base[d]), int(b + 1 - word_base[d])))
            byte_spans[d].append((int(start[a] - text_start[d]), int(end[b] - text_start[d])))
    return n_words, spans, byte_spans, names


def _pieces(text: bytes, limit: int, window: int):
    """A text, or stretches of its words of about `limit` bytes that overlap by a window less a word."""
    start, end = word_edges(joined([text])[0], ALNUM) if len(text) > limit else (np.empty(0), np.empty(0))
    if len(start) <= window:
        yield text
        return
    at = 0
    while True:
        stop = min(len(start), max(at + window, int(np.searchsorted(end, start[at] + limit, side="right"))))
        yield text[int(start[at]) : int(end[stop - 1])]
        if stop == len(start):
            return
        at = stop - window + 1


def _blocks(spark, benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcast blocks of the benchmark's phrases, at least one; the driver reads a partition of items at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    out, held, size = [], [], 0
    for r in items.where("text is not null and text <> ''").toLocalIterator():
        for piece in _pieces(r["text"].encode(), block_bytes, window):
            if held and size + len(piece) > block_bytes:
                out.append(spark.sparkContext.broadcast(Phrases(held, window)))
                held, size = [], 0
            held.append((r["item"], piece))
            size += len(piece)
    return [*out, spark.sparkContext.broadcast(Phrases(held, window))]


_FOUND = "doc_row long, doc_id long, n_words long, words array<int>, bytes array<int>, items array<string>"


def _scan(phrases, shard: int):
    def scan(batches):
        block = phrases.value
        for batch in chunks(batches, CHUNK_BYTES):
            n_words, spans, byte_spans, names = search(block, byte_texts(batch.column(2)), shard)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n_words, pa.int64()),
                    pa.array([[x for s in own for x in s] for own in spans], pa.list_(pa.int32())),
                    pa.array([[x for s in own for x in s] for own in byte_spans], pa.list_(pa.int32())),
                    pa.array([sorted(own) for own in names], pa.list_(pa.string())),
                ],
                names=["doc_row", "doc_id", "n_words", "words", "bytes", "items"],
            )

    return scan


def _merged(flat: list[int]) -> list[int]:
    """Merge the overlapping or touching spans of a flat list [a, b, a, b, ...]."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _merge(batches):
    for batch in batches:
        for name in ("words", "bytes"):
            at = batch.schema.get_field_index(name)
            batch = batch.set_column(at, name, pa.array([_merged(x) for x in batch.column(at).to_pylist()], pa.list_(pa.int32())))
        yield batch


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_row, doc_id, n_words, words and bytes (flat hit spans), items."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("doc_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passes = [rows.mapInArrow(_scan(block, shard), _FOUND) for block in _blocks(spark, benchmark, window, block_bytes)]
    if len(passes) == 1:
        return passes[0]
    every = passes[0]
    for other in passes[1:]:
        every = every.unionByName(other)
    merged = every.groupBy("doc_row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("words")).alias("words"),
        F.flatten(F.collect_list("bytes")).alias("bytes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select("doc_row", "doc_id", "n_words", "words", "bytes", "items").mapInArrow(_merge, _FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs, benchmark, **options)
    lengths = F.transform("words", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda n, x: n + x)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"),
    )


def _cut(text: str | None, edges: list[int]) -> str | None:
    if not text or not edges:
        return text
    raw, out, at = text.encode(), [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out).decode()


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with every hit span removed from their text; all columns stay.

    The spans of all blocks are found on the same text and cut at once, again until no block hits.  Of a benchmark of
    several blocks a task holds one at a time and loads them anew for every chunk of rows."""
    spark = docs.sparkSession
    small_batches(spark)
    every = _blocks(spark, benchmark, window, block_bytes)
    at = docs.columns.index("text")

    def remove(batches):
        for batch in chunks(batches, CHUNK_BYTES):
            made = batch.column(at).to_pylist()
            todo = list(range(len(made)))
            while todo:  # what a cut joins may be a phrase again, of any block
                texts = [(made[i] or "").encode() for i in todo]
                spans: list[list[int]] = [[] for _ in todo]
                for phrases in every:
                    for flat, own in zip(spans, search(phrases.value, texts, shard)[2], strict=True):
                        flat += [x for s in own for x in s]
                    if len(every) > 1:
                        phrases.__dict__.pop("_value", None)  # read again from its file when needed
                for i, flat in zip(todo, spans, strict=True):
                    made[i] = _cut(made[i], _merged(flat))
                todo = [i for i, flat in zip(todo, spans, strict=True) if flat]
            yield batch.set_column(at, batch.schema.field(at), pa.array(made, batch.schema.field(at).type))

    return docs.mapInArrow(remove, docs.schema)


def op3_decontaminate(spark, sf_dir):
    return decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE_SQL = {
    "op3_decontaminate": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (
          SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS k
          FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (
          SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
          FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
        hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (k, n)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
        its AS (
          SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
    """
}
