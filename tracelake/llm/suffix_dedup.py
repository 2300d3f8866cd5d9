"""Suffix dedup: remove bytes of 50-byte strings that also start in a document with a smaller doc_id.

Shared strings are found with a threshold-bounded interval expansion over Burrows-Wheeler transforms:
a breadth-first backward extension sets common prefixes by increasing value and stops at
MIN_LENGTH; suffixes between which nothing was set share MIN_LENGTH bytes (see `equal_windows`).
What must be compared is brought together first, exactly (later copies of a whole text are set aside before: they lose all):

1. Every 50-byte window picks one anchor, the K-gram of smallest hash in it (leftmost on ties), so equal windows
   have equal anchors, and the windows of a text fall into runs by anchor.  Anchor hashes are
   deduplicated per task and shuffled as packed 5-byte values; those of two documents or more go into a filter of
   fixed size (FILTER_BYTES, false hits only cost work).
2. Anchors that pass the filter are classed by a hash of their whole run.  A run whose class has a smaller document is a
   candidate, with that document as its source: found per task first, then per bucket of hashes, so a class sends one document per task
   however many hold it.  A document's candidates of one source are joined to stretches and keyed by pieces of the source.
3. Where the smallest documents of different classes share an anchor and at least SIDE more bytes before or after it, the runs
   are partly equal at most, and are keyed by what they share.  Keys of more than HOT_KEY runs are split by window content.
4. The bytes of all keyed stretches are fetched and compared by transform, in shards of about SHARD bytes cut between keys: only here it
   is decided what is removed.  (Of partly equal runs, those that equal a smaller document's byte for byte are taken out before.)

Removed runs are merged per document.  Texts move only for documents with partly equal runs or removals (chosen by a filter
of fixed size, then joined exactly).  Anchors, which only bring runs together, are compared by 64-bit hashes; classes of
runs, whose larger documents are asked for nothing but their source, by 96 bits of two (a wrong class, one to be expected among 10^14 runs, can hide a match, not make one).
There are as many buckets as shuffle partitions, more where a bucket would otherwise stand for over BUCKET_BYTES of text.
Every step is written before the next begins and its shuffle files go then: disk holds those of one step at a time.

Defined results: null text counts as empty; a null doc_id is neither smaller nor larger than another, its row
keeps all bytes; rows that repeat a doc_id are one document, never smaller than itself;
empty tables give empty results; extra columns are ignored.  Removal may cut UTF-8 characters: what
remains is bytes, as is its digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import attach_groups, documents, maybe_in, shuffle_partitions, split_by, staged
from tracelake.llm.decontaminate import WaveletMatrix, suffix_array
from tracelake.llm.textbytes import U64, byte_texts, chunks, joined, mix64, noise64

MIN_LENGTH = 50
K = 26
SIDE = (MIN_LENGTH - K) // 2
FILTER_BYTES = 16 << 20
FLUSH = 500_000
SHARD = 1 << 18
HOT_KEY = 20_000
#: Windows of a source that make one key, and documents of a class that share a key at most (about).
PIECE, PER_SALT = 4096, 512
CHUNK_BYTES = 1 << 18
BUCKET_BYTES = 256 << 20
_BYTE, _OTHER_BYTE = noise64(256, 5), noise64(256, 7)
_MUL = noise64(8, 6) | U64(1)
#: Columns of a packed run: class hash and 32 bits of another one, document, mark of its text, first window, windows << 8 | anchor offset, side hashes.
_RECORD = np.dtype([("ctx", "u8"), ("more", "u4"), ("doc", "i8"), ("mark", "i4"), ("at", "i4"), ("span", "u2"), ("l", "u4"), ("r", "u4")])
_REQUEST = np.dtype([("key", "u8"), ("first", "i4"), ("last", "i4")])
#: A stretch of windows that a source should have too, `shift` further on.
_CANDIDATE = np.dtype([("src", "i8"), ("smark", "i4"), ("salt", "i4"), ("shift", "i4"), ("first", "i4"), ("last", "i4")])


# ---- the transform ---------------------------------------------------------------------------------------------


def _children(wavelet: WaveletMatrix, before: np.ndarray, low: np.ndarray, high: np.ndarray):
    """All non-empty backward extensions of the intervals [low, high) by one symbol."""
    symbol = np.zeros(len(low), np.int64)
    base_low, base_high = low, high  # positions as the levels permute them
    first = np.zeros(len(low), np.int64)  # start of the symbol's stretch on the level
    for count, zeros in zip(wavelet.levels, wavelet.zeros, strict=True):
        a, b, s = count[base_low], count[base_high], count[first]
        left = np.flatnonzero(base_high - b > base_low - a)
        right = np.flatnonzero(b > a)
        symbol = np.concatenate([symbol[left] * 2, symbol[right] * 2 + 1])
        first, base_low, base_high = (
            np.concatenate([(first - s)[left], (zeros + s)[right]]),
            np.concatenate([(base_low - a)[left], (zeros + a)[right]]),
            np.concatenate([(base_high - b)[left], (zeros + b)[right]]),
        )
    return before[symbol] + base_low - first, before[symbol] + base_high - first


def equal_windows(symbols: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and the group of each row: rows of a group share their first `length` symbols.

    symbols must end in 0, which occurs once.  border[i] says that rows i - 1 and i share less than `length`: interval
    ends get their common prefix level by level, each once, and expansion goes on only from intervals that set one."""
    order = suffix_array(symbols, size, length)  # intervals of up to `length` symbols need no more
    n = len(order)
    wavelet = WaveletMatrix(symbols[order - 1], size)
    before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
    border = np.zeros(n + 1, bool)
    border[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        low, high = _children(wavelet, before, low, high)
        new = ~border[high]
        # the last interval of a level ends at n: go on from it while it is the only one that reaches there
        new |= high == n
        low, high = low[new], high[new]
        border[high] = True
        if not len(low) or border[1:].all():
            break
    border[0] = True
    return order, np.cumsum(border[:n]) - 1


def shared_windows(blocks: list[bytes], docs: np.ndarray, length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(block, offset) of windows that also start in a block of a smaller document."""
    sizes = np.fromiter((len(b) + 1 for b in blocks), np.int64, len(blocks))
    start = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\0".join(blocks) + b"\0\0", np.uint8)
    number = np.zeros(256, np.int32)  # symbols: 0 the end, 1 after each block, then the bytes that occur
    used = np.unique(data)
    number[used] = np.arange(len(used)) + 2
    data = number[data]
    data[start + sizes - 1], data[-1] = 1, 0
    order, group = equal_windows(data, len(used) + 2, length)
    owner = np.append(np.repeat(np.arange(len(blocks)), sizes), len(blocks) - 1)[order]
    offset = order - start[owner]
    valid = (offset + length <= sizes[owner] - 1) & (order < len(data) - 1)
    order, group, owner, offset = order[valid], group[valid], owner[valid], offset[valid]
    if not len(order):
        return owner, offset
    head = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(docs[owner], head)
    lost = docs[owner] > least[np.cumsum(np.diff(group, prepend=-1) != 0) - 1]
    return owner[lost], offset[lost]


# ---- anchors -----------------------------------------------------------------------------------------------------


class Anchors:
    """Anchors of a list of texts: owner, at (first window), span (windows << 8 | anchor offset), hashes."""

    def __init__(self, texts: list[bytes], full: bool):
        data, text_start = joined(texts)
        sizes = np.diff(text_start) - 1
        n = len(data)
        padded = np.zeros(n + 64, np.uint8)
        padded[:n] = data
        with np.errstate(over="ignore"):
            x1 = _BYTE[padded]
            x2 = x1[:-1] * _MUL[0] + x1[1:]
            x4 = x2[:-2] * _MUL[1] + x2[2:]
            x8 = x4[:-4] * _MUL[2] + x4[4:]
            x16 = x8[:-8] * _MUL[3] + x8[8:]
            gram = mix64((x16[:n] * _MUL[4] + x8[16 : n + 16]) * _MUL[5] + x2[24 : n + 24])
        pick = (gram & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
        window = MIN_LENGTH - K + 1
        reach = 1
        while reach * 2 <= window:
            pick = np.minimum(pick[: len(pick) - reach], pick[reach:])
            reach *= 2
        if window > reach:
            pick = np.minimum(pick[: len(pick) - (window - reach)], pick[window - reach :])
        count = np.maximum(0, sizes - MIN_LENGTH + 1)
        some = np.flatnonzero(count)
        starts = np.repeat(text_start[some] - (np.cumsum(count[some]) - count[some]), count[some]) + np.arange(count.sum())
        chosen = (pick[starts] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.diff(chosen, prepend=-1) != 0
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(chosen)) - 1
        place, s0, s1 = chosen[first], starts[first], starts[last] if len(first) else starts[:0]
        self.owner = np.searchsorted(text_start, s0, side="right") - 1
        with np.errstate(over="ignore"):
            self.k = mix64(gram[place] + _MUL[0])  # chosen grams have small hashes: spread them again
        if not full:
            return
        self.at = (s0 - text_start[self.owner]).astype(np.int32)
        self.span = ((s1 - s0) << 8 | (place - s0)).astype(np.int32)
        with np.errstate(over="ignore"):

            def fifty(i):
                return (x16[i] * _MUL[6] + x16[i + 16]) * _MUL[7] + x16[i + 32] * _MUL[5] + x2[i + 48]

            self.ctx = mix64(fifty(s0) ^ mix64(fifty(s1) + self.span.astype(U64)))
            # the same of another family, over the places that are asked for alone
            y16 = _OTHER_BYTE[padded]
            for k in range(4):
                y16 = y16[: -(1 << k)] * _MUL[7 - k] + y16[1 << k :]

            def other(i):
                return (y16[i] * _MUL[0] + y16[i + 16]) * _MUL[1] + y16[i + 32] * _MUL[2] + y16[i + 34]

            self.more = (mix64(other(s0) ^ mix64(other(s1) + self.span.astype(U64))) >> U64(32)).astype(np.uint32)
            left, right = place - s0 >= SIDE, s1 >= place - SIDE + 1
            lead, tail = np.maximum(place - SIDE, 0), place + K
            self.l = np.where(left, mix64(x8[lead] * _MUL[6] + x4[lead + 8] + self.k) >> U64(32) | U64(1), U64(0)).astype(np.uint32)
            self.r = np.where(right, mix64(x8[tail] * _MUL[7] + x4[tail + 8] + self.k) >> U64(32) | U64(1), U64(0)).astype(np.uint32)


def _bucket(k: np.ndarray, buckets: int) -> np.ndarray:
    return ((k >> U64(40)) * U64(buckets) >> U64(24)).astype(np.int64)


def _pack(k: np.ndarray) -> bytes:
    return k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _collect_anchors(buckets: int):
    def run(batches):
        held: list = []
        size = seq = 0

        def flush():
            k, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(k)
            k, owner = k[order], owner[order]
            first = np.flatnonzero(np.diff(k, prepend=k[:1] ^ U64(1)) != 0)
            many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
            k = k[first]
            bucket = _bucket(k, buckets)
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(b, _pack(k[i:j][~many[i:j]]), _pack(k[i:j][many[i:j]])) for b, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if j > i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                names=["bucket", "once", "often"],
            )

        for batch in chunks(batches, CHUNK_BYTES):
            found = Anchors(byte_texts(batch.column(batch.schema.get_field_index("text"))), False)
            held.append((found.k, found.owner + seq))
            size, seq = size + len(found.k), seq + batch.num_rows
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _bits(k: np.ndarray, bits: int):
    """Two bit positions of each value (the low 40 bits of an anchor hash) in a bucket's filter."""
    mixed = mix64((k & U64((1 << 40) - 1)) + U64(0x632BE59BD9B4E019))
    return (mixed % U64(bits)).astype(np.int64), ((mixed >> U64(32)) * U64(0x9E3779B1) % U64(bits)).astype(np.int64)


def _repeated(bits: int):
    def run(batches):
        once: dict[int, list] = {}
        filters: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, one, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once.setdefault(b, []).append(_unpack(one))
                filters.setdefault(b, np.zeros(bits, bool))
                for at in _bits(_unpack(many), bits):
                    filters[b][at] = True
                once[b].append(_unpack(many))
        for b, parts in once.items():
            k = np.sort(np.concatenate(parts))
            again = k[1:][k[1:] == k[:-1]]
            for at in _bits(again, bits):
                filters[b][at] = True
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(filters[b]).tobytes()], pa.binary())], names=["bucket", "bits"])

    return run


# ---- runs and classes ----------------------------------------------------------------------------------------------

_OUT = "kind int, bucket int, doc long, mark int, payload binary"
_SPANS, _RECORDS, _REQUESTS, _CANDIDATES = 0, 1, 2, 3


def _opens(rec: np.ndarray) -> np.ndarray:
    """Where a class of equal runs begins in sorted records."""
    new = np.ones(len(rec), bool)
    new[1:] = (rec["ctx"][1:] != rec["ctx"][:-1]) | (rec["more"][1:] != rec["more"][:-1])
    return new


def _packed(rec: np.ndarray) -> bytes:
    """Records column by column, by document, so that blocks compress."""
    rec = rec[np.argsort(rec["doc"], kind="stable")]
    return b"".join(np.ascontiguousarray(rec[name]).tobytes() for name in _RECORD.names)


def _unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // _RECORD.itemsize
    out, at = np.empty(n, _RECORD), 0
    for name in _RECORD.names:
        size = _RECORD[name].itemsize * n
        out[name] = np.frombuffer(raw, _RECORD[name], n, at)
        at += size
    return out


def _batch(kind, bucket, doc, mark, payload: pa.Array) -> pa.RecordBatch:
    n = len(doc)
    cols = [pa.array(np.full(n, kind, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(doc.astype(np.int64)), pa.array(mark.astype(np.int32)), payload]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "bucket", "doc", "mark", "payload"])


def _by_doc(kind: int, doc, mark, payload: np.ndarray, buckets: int):
    """One row per document with its payload rows packed."""
    if not len(doc):
        return
    order = np.lexsort((mark, doc))
    doc, mark, payload = doc[order], mark[order], payload[order]
    edge = np.flatnonzero((np.diff(doc, prepend=doc[:1] - 1) != 0) | (np.diff(mark, prepend=mark[:1] - 1) != 0))
    last = np.append(edge[1:], len(doc))
    for at in range(0, len(edge), 20_000):
        own, stop = edge[at : at + 20_000], last[at : at + 20_000]
        offset = np.append(own, stop[-1]) - own[0]
        raw = np.ascontiguousarray(payload[own[0] : stop[-1]]).tobytes()
        binary = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((offset * payload.itemsize).astype(np.int32).tobytes()), pa.py_buffer(raw)])
        yield _batch(kind, doc[own] % buckets, doc[own], mark[own], binary)


def _merged_spans(doc, mark, first, stop):
    """Merge overlapping or touching spans of the same document."""
    order = np.lexsort((first, mark, doc))
    doc, mark, first, stop = doc[order], mark[order], first[order].astype(np.int64), stop[order].astype(np.int64)
    if not len(doc):
        return doc, mark, np.empty((0, 2), np.int32)
    new = (np.diff(doc, prepend=doc[:1] - 1) != 0) | (np.diff(mark, prepend=mark[:1] - 1) != 0)
    part = np.cumsum(new) - 1
    lift = part * (1 << 33)  # documents far apart, so that one running maximum serves all
    reach = np.maximum.accumulate(stop + lift)
    opens = new.copy()
    opens[1:] |= first[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(opens)
    ends = reach[np.append(at[1:], len(doc)) - 1] - lift[at]
    return doc[at], mark[at], np.stack([first[at], ends], 1).astype(np.int32)


def _spans_out(doc, mark, first, stop, buckets):
    d, m, spans = _merged_spans(doc, mark, first, stop)
    yield from _by_doc(_SPANS, d, m, spans.view([("a", "i4"), ("b", "i4")]).reshape(-1), buckets)


def _joined_candidates(doc, mark, cand):
    """Candidates in order, touching ones of the same source and shift joined."""
    order = np.lexsort((cand["first"], cand["shift"], cand["salt"], cand["smark"], cand["src"], mark, doc))
    doc, mark, cand = doc[order], mark[order], cand[order]
    if not len(doc):
        return doc, mark, cand
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    for name in ("src", "smark", "salt", "shift"):
        new[1:] |= cand[name][1:] != cand[name][:-1]
    lift = (np.cumsum(new) - 1) * (1 << 33)
    reach = np.maximum.accumulate(cand["last"] + lift)
    opens = new.copy()
    opens[1:] |= cand["first"][1:] + lift[1:] > reach[:-1] + 1
    at = np.flatnonzero(opens)
    out = cand[at].copy()
    out["last"] = reach[np.append(at[1:], len(doc)) - 1] - lift[at]
    return doc[at], mark[at], out


def _candidates_out(rec, new, buckets: int):
    """Candidates of sorted records (new: where classes begin), and which records they are."""
    head = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    size = np.diff(np.append(head, len(rec)))
    lost = rec["doc"] > rec["doc"][head][of]
    own, source = rec[lost], rec[head[of[lost]]]
    cand = np.zeros(len(own), _CANDIDATE)
    cand["src"], cand["smark"], cand["shift"] = source["doc"], source["mark"], source["at"] - own["at"]
    cand["first"], cand["last"] = own["at"], own["at"] + (own["span"] >> 8)
    salts = U64(1) << np.maximum(0, np.ceil(np.log2(size[of[lost]] / PER_SALT))).astype(U64)
    cand["salt"] = (mix64(own["doc"].astype(U64)) & (salts - U64(1))).astype(np.int32)
    return lost, _by_doc(_CANDIDATES, *_joined_candidates(own["doc"], own["mark"], cand), buckets)


def _requested(batches):
    """What candidates ask for: (key, doc, mark, first, last) of a document and of its source, by pieces of the source."""
    for batch in batches:
        parts = [np.frombuffer(b"".join(p), _CANDIDATE) for p in batch.column(2).to_pylist()]
        if not parts:
            continue
        sizes = [len(p) for p in parts]
        doc, mark, cand = _joined_candidates(np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(1).to_numpy(), sizes), np.concatenate(parts))
        shift = cand["shift"].astype(np.int64)
        low, high = cand["first"] + shift, cand["last"] + shift
        many = high // PIECE - low // PIECE + 1
        row = np.repeat(np.arange(len(doc)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + (low // PIECE)[row]
        a, b, shift = np.maximum(low[row], piece * PIECE), np.minimum(high[row], piece * PIECE + PIECE - 1), shift[row]
        with np.errstate(over="ignore"):
            key = mix64(cand["src"][row].astype(U64) ^ mix64(cand["smark"][row].astype(U64) << U64(32) | piece.astype(U64)) + mix64(cand["salt"][row].astype(U64) + U64(1)))
        key = (key & ~U64(1) | U64(2)).view(np.int64)  # even: candidates; odd: partly equal runs
        for whose, own, first, last in ((doc[row], mark[row], a - shift, b - shift), (cand["src"][row], cand["smark"][row], a, b)):
            cols = [pa.array(key), pa.array(whose), pa.array(own), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "doc", "mark", "first", "last"])


def _packed_requests(batches):
    """Requests of a document as packed rows."""
    for batch in batches:
        asked = batch.column(2)
        rows = asked.flatten()
        out = np.zeros(len(rows), _REQUEST)
        for k, name in enumerate(_REQUEST.names):
            out[name] = rows.field(k).to_numpy().astype(_REQUEST[name])
        size = np.append(0, np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False)))
        raw = [out[i:j].tobytes() for i, j in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["doc", "mark", "payload"])


def _collect_runs(bits: int, buckets: int, held_filter):
    def run(batches):
        bitmap = held_filter.value
        held: list = []
        size = 0

        def flush():
            rec, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((rec["doc"], rec["more"], rec["ctx"]))
            rec, bucket = rec[order], bucket[order]
            lost, found = _candidates_out(rec, _opens(rec), buckets)
            yield from found
            rec, bucket = rec[~lost], bucket[~lost]
            order = np.argsort(bucket, kind="stable")
            rec, bucket = rec[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edge))
            raw = pa.array([_packed(rec[edge[b] : edge[b + 1]]) for b in some.tolist()], pa.binary())
            zero = np.zeros(len(some), np.int64)
            yield _batch(_RECORDS, some, zero, zero, raw)

        for batch in chunks(batches, CHUNK_BYTES):
            found = Anchors(byte_texts(batch.column(batch.schema.get_field_index("text"))), True)
            bucket = _bucket(found.k, buckets)
            keep = np.ones(len(found.k), bool)
            for at in _bits(found.k, bits):
                keep &= (bitmap[bucket, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            rec = np.zeros(int(keep.sum()), _RECORD)
            for name in ("ctx", "more", "at", "span", "l", "r"):
                rec[name] = getattr(found, name)[keep]
            rec["doc"] = batch.column(0).to_numpy()[found.owner[keep]]
            rec["mark"] = batch.column(1).to_numpy()[found.owner[keep]]
            held.append((rec, bucket[keep].astype(np.int32)))
            size += len(rec)
            if size >= FLUSH // 2:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _settle(buckets: int, hot_key: int):
    """Classes of a bucket: candidates for a smaller document of the class, and requests for partial comparison."""

    def run(batches):
        parts: list[np.ndarray] = []
        own_bucket = 0
        for batch in batches:
            if batch.num_rows:
                own_bucket = batch.column(1)[0].as_py()
            kind = batch.column(0).to_numpy()
            rest = np.flatnonzero(kind != _RECORDS)
            if len(rest):
                yield batch.take(pa.array(rest))
            for raw in batch.column(4).take(pa.array(np.flatnonzero(kind == _RECORDS))).to_pylist():
                parts.append(_unpacked(raw))
        if not parts:
            return
        rec = np.concatenate(parts)
        rec = rec[np.lexsort((rec["doc"], rec["more"], rec["ctx"]))]
        lost, found = _candidates_out(rec, _opens(rec), buckets)
        yield from found
        rec = rec[~lost]
        # sides that smallest documents of different classes share
        for side in ("l", "r"):
            own = rec[rec[side] != 0]
            key = mix64(own[side].astype(U64) | U64(own_bucket << 33 | (side == "l") << 32))
            order = np.lexsort((own["doc"], key))
            own, key = own[order], key[order]
            if not len(own):
                continue
            new = np.diff(key, prepend=key[:1] ^ U64(1)) != 0
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(key))
            group = np.cumsum(new) - 1
            ask = (own["doc"][head] != own["doc"][tail - 1])[group]
            hot = ((tail - head) > hot_key)[group][ask]
            own, key = own[ask], key[ask]
            place = own["at"] + (own["span"] & 255).astype(np.int64)
            end = own["at"] + (own["span"] >> 8).astype(np.int64)
            out = np.zeros(len(own), _REQUEST)
            out["key"] = np.where(hot, U64(0), key | U64(1))
            out["first"] = own["at"] if side == "l" else np.maximum(own["at"], place - SIDE + 1)
            out["last"] = np.minimum(end, place - SIDE) if side == "l" else end
            yield from _by_doc(_REQUESTS, own["doc"], own["mark"], out, buckets)

    return run


def _fetch(batches):
    """Bytes of requested runs: (key, doc, mark, first, bytes); hot keys window by window, by content."""
    for batch in batches:
        doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        asked = [np.frombuffer(p, _REQUEST) for p in batch.column(3).to_pylist()]
        if not asked:
            continue
        row = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
        req = np.concatenate(asked)
        key, first, size = req["key"].view(np.int64).copy(), req["first"].astype(np.int64), (req["last"] - req["first"] + MIN_LENGTH).astype(np.int64)
        hot = key == 0
        if hot.any():  # one block per window
            many = np.where(hot, size - MIN_LENGTH + 1, 1)
            part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, key, first, size, hot = (np.repeat(x, many) for x in (row, key, first, size, hot))
            first, size = np.where(hot, first + part, first), np.where(hot, MIN_LENGTH, size)
        data, text_start = joined(byte_texts(batch.column(2)))
        for at in range(0, len(row), 50_000):
            own = slice(at, at + 50_000)
            offset = np.concatenate([[0], np.cumsum(size[own])])
            where = np.arange(offset[-1]) - np.repeat(offset[:-1] - text_start[row[own]] - first[own], size[own])
            taken, keys, whose, some = data[where], key[own].copy(), doc[row[own]], np.flatnonzero(hot[own])
            for i in some.tolist():
                keys[i] = _content(taken[offset[i] : offset[i + 1]].tobytes()) | 1
            if len(some):  # equal windows of larger documents are lost here: an empty block says so
                _, same = np.unique(keys[some], return_inverse=True)
                least = np.full(same.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, same, whose[some])
                lost = some[whose[some] > least[same]]
                left = np.diff(offset)
                stay = np.ones(len(left), bool)
                stay[lost] = False
                taken = taken[np.repeat(stay, left)]
                left[lost] = 0
                offset = np.concatenate([[0], np.cumsum(left)])
                keys[lost] = mix64(whose[lost].view(U64) + U64(1)).view(np.int64) | 1
            raw = taken.tobytes()
            blocks = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offset.astype(np.int32).tobytes()), pa.py_buffer(raw)])
            cols = [pa.array(keys), pa.array(whose), pa.array(mark[row[own]]), pa.array(first[own].astype(np.int32)), blocks]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "doc", "mark", "first", "bytes"])


def _content(piece: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "big", signed=True)


def _compare(buckets: int):
    """Transforms over shards of keyed blocks sorted by key; spans lost."""

    def settle(parts):
        key, doc, mark, first = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(4))
        blocks = [b for p in parts for b in p.column(4).to_pylist()]
        least: dict[bytes, int] = {}
        partly = (key & 1).tolist()
        for b, d, odd in zip(blocks, doc.tolist(), partly, strict=True):
            if odd and d < least.get(b, d + 1):
                least[b] = d
        # lost whole: what _fetch says (empty blocks), and a partly equal run that a smaller document has as well
        size = np.fromiter((len(b) or MIN_LENGTH for b in blocks), np.int64, len(blocks))
        gone = np.fromiter((odd and (not b or d > least[b]) for b, d, odd in zip(blocks, doc.tolist(), partly, strict=True)), bool, len(blocks))
        spans = [(doc[gone], mark[gone], first[gone].astype(np.int64), (first + size)[gone])]
        rest = np.flatnonzero(~gone)
        if len(rest) > 1:
            which, offset = shared_windows([blocks[i] for i in rest.tolist()], doc[rest])
            which = rest[which]
            spans.append((doc[which], mark[which], first[which] + offset, first[which] + offset + MIN_LENGTH))
        yield from _spans_out(*(np.concatenate(x) for x in zip(*spans, strict=True)), buckets)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                cut = np.cumsum(np.diff(_offsets(batch.column(4))))
                if size >= SHARD:  # up to the end of the key that is being gathered
                    last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                    same = int(np.searchsorted(batch.column(0).to_numpy(), last, side="right"))
                    if same and last % 2 == 0:  # a source with many candidates: each needs no other than it
                        if size >= 2 * SHARD:
                            source = _first_of(held, last)
                            yield from settle(held)
                            held, size = [source], source.num_rows * (PIECE + MIN_LENGTH)
                        stop = min(same, int(np.searchsorted(cut, SHARD)) + 1)
                        held.append(batch.slice(0, stop))
                        size += int(cut[stop - 1])
                        batch = batch.slice(stop)
                        continue
                    if same:
                        held.append(batch.slice(0, same))
                    batch = batch.slice(same)
                    if batch.num_rows:
                        yield from settle(held)
                        held, size = [], 0
                    continue
                stop = min(batch.num_rows, int(np.searchsorted(cut, SHARD - size)) + 1)
                held.append(batch.slice(0, stop))
                size += int(cut[stop - 1])
                batch = batch.slice(stop)
        if held:
            yield from settle(held)

    return run


def _first_of(held: list[pa.RecordBatch], key: int) -> pa.RecordBatch:
    """The rows of the smallest document of a key, whose rows come by document."""
    for part in held:
        at = np.flatnonzero(part.column(0).to_numpy() == key)
        if len(at):
            doc = part.column(1).to_numpy()
            return part.take(pa.array(at[doc[at] == doc[at[0]]]))
    raise KeyError(key)


def _offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of the values of a binary column (a slice too)."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]


def _apply(text: bytes, payloads: list[bytes]) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed, what remains; no spans stand for the whole text."""
    if not payloads:
        return len(text), 1, b""
    spans = np.concatenate([np.frombuffer(p, np.int32).reshape(-1, 2) for p in payloads])
    zero = np.zeros(len(spans), np.int64)
    _, _, merged = _merged_spans(zero, zero, spans[:, 0], spans[:, 1])
    kept, at = [], 0
    for a, b in merged.tolist():
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return int((merged[:, 1] - merged[:, 0]).sum()), len(merged), b"".join(kept)


def first_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc, mark, text) that can share a string, without later copies of a text; those copies (doc, mark, n_bytes); bytes in all.

    All strings of a copy start in the first one too, so the copy loses everything and need not be searched."""
    rows = _keyed(docs).where("doc is not null and octet_length(text) >= %d" % MIN_LENGTH)
    digest = F.unhex(F.sha2("text", 256))
    small = staged(rows.select("doc", "mark", digest.alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "text-digests", free=True)
    groups = staged(small.groupBy("sha", "n_bytes").agg(F.min("doc").alias("least"), F.count("*").alias("rows")).where("rows > 1"), "text-classes", free=True)
    total, n_bytes = small.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    later = attach_groups(small, groups, ["sha", "n_bytes"], "rows", total).where("doc > least").select("doc", "mark", "n_bytes").distinct()
    later = staged(later, "text-copies", free=True)
    unsure, sure = split_by(rows, "doc", later, "doc")
    unsure = unsure.join(later.select("doc", "mark"), ["doc", "mark"], "left_anti")
    return sure.unionByName(staged(unsure.select("doc", "mark", "text"), "unsure-copies", free=True)), later, n_bytes


def removed_spans(rows: DataFrame, hot_key: int = HOT_KEY, n_bytes: int = 0) -> DataFrame:
    """doc, mark (low bits of the text's hash), spans: packed (first, stop) byte spans to remove, several per document.

    n_bytes: the size of all texts, if known; it sets the least number of buckets."""
    spark = rows.sparkSession
    buckets = max(shuffle_partitions(spark), n_bytes // BUCKET_BYTES)
    bits = FILTER_BYTES * 8 // buckets // 8 * 8
    seen = rows.mapInArrow(_collect_anchors(buckets), "bucket int, once binary, often binary")
    seen = staged(seen.repartitionById(buckets, F.col("bucket")).mapInArrow(_repeated(bits), "bucket int, bits binary"), "anchor-filter", free=True)
    bitmap = np.zeros((buckets, bits // 8), np.uint8)
    for row in seen.toLocalIterator():  # FILTER_BYTES in all
        bitmap[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    runs = rows.mapInArrow(_collect_runs(bits, buckets, spark.sparkContext.broadcast(bitmap)), _OUT)
    settled = staged(runs.repartitionById(buckets, F.col("bucket")).mapInArrow(_settle(buckets, hot_key), _OUT), "runs", free=True)
    mine = settled.where(F.col("kind") == _CANDIDATES).groupBy("doc", "mark").agg(F.collect_list("payload").alias("payloads"))
    mine = mine.mapInArrow(_requested, "key long, doc long, mark int, first int, last int")
    mine = mine.groupBy("key", "doc", "mark").agg(F.min("first").alias("first"), F.max("last").alias("last"))  # a source is asked for once a key
    mine = mine.groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "first", "last")).alias("asked")).mapInArrow(_packed_requests, "doc long, mark int, payload binary")
    asked = staged(settled.where(F.col("kind") == _REQUESTS).select("doc", "mark", "payload").unionByName(mine), "requests", free=True)
    wanted = maybe_in(rows, "doc", asked, "doc")
    met = wanted.dropDuplicates(["doc", "mark"]).join(asked, ["doc", "mark"]).select("doc", "mark", "text", "payload")
    blocks = met.mapInArrow(_fetch, "key long, doc long, mark int, first int, bytes binary")
    blocks = blocks.repartition(buckets, "key").sortWithinPartitions("key", "doc")
    return staged(blocks.mapInArrow(_compare(buckets), _OUT), "shared-runs", free=True).select("doc", "mark", F.col("payload").alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int").alias("mark"), text.alias("text"))


def _finish(batches):
    for batch in batches:
        doc, text, spans = (batch.column(i) for i in range(3))
        got = [_apply(t, s) for t, s in zip(byte_texts(text), spans.to_pylist(), strict=True)]
        cols = [
            doc,
            pa.array([n + len(kept) for n, _, kept in got]),
            pa.array([n for n, _, _ in got]),
            pa.array([m for _, m, _ in got]),
            pa.array([hashlib.sha256(kept).hexdigest() for _, _, kept in got]),
            pa.array([kept for _, _, kept in got], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null where nothing is removed)."""
    first, copies, n_bytes = first_copies(docs)
    spans = staged(removed_spans(first, hot_key, n_bytes), "spans", free=True)
    whole = copies.select("doc", "mark", F.lit(None).cast("binary").alias("spans"))  # an empty list of spans: all of it
    every = spans.unionByName(whole).groupBy("doc", "mark").agg(F.collect_list("spans").alias("spans"))
    rows = _keyed(docs)
    hit = spans.select("doc").unionByName(copies.select("doc"))
    touched, rest = split_by(rows, "doc", hit, "doc")
    cut = touched.join(every, ["doc", "mark"], "left").select("doc", "text", "spans")
    done = cut.where("spans is not null").mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    rest = cut.where("spans is null").select("doc", "text").unionByName(rest.select("doc", "text"))
    zero = F.lit(0).cast("long")
    rest = rest.select(
        F.col("doc").alias("doc_id"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
        F.lit(None).cast("binary").alias("kept"),
    )
    return done.unionByName(rest)


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup(documents(spark, sf_dir)).drop("kept")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE_SQL = {
    "op7_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49, 1000)) AS base,
                     unnest(list_transform(range(0, length(h) // 2 - 49, 1000), lambda a: substr(h, 2 * a + 1, 2098))) AS piece FROM d),
        w AS (SELECT doc_id, base + unnest(range(0, length(piece) // 2 - 49)) AS i,
                     unnest(list_transform(range(0, length(piece) // 2 - 49), lambda a: substr(piece, 2 * a + 1, 100))) AS k FROM c),
        m AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY k) AS lost FROM w),
        o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM m WHERE lost),
        g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
        r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
        e AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS prev FROM r),
        k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS last,
                     list([prev, a] ORDER BY run) AS keep FROM e GROUP BY doc_id)
        SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE
                 array_to_string(list_transform(keep, lambda x: substr(h, 2 * x[1] + 1, 2 * (x[2] - x[1]))), '') || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """
}
