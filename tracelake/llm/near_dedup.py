"""MinHash near-duplicates by an LSH forest.

A document's set is its distinct five-word shingles (words `[^\\x20\\x09-\\x0D]+` of the text with A-Z
lower-cased; fewer than five words: the whole sequence).  Each distinct set gets a signature of TREES x DEPTH minimum
hashes.  Every tree is one sorted order of the sets by its DEPTH hashes; neighbours with a common prefix of at least
MIN_DEPTH hashes form a region.  The depth adapts to the region: candidates are all neighbours within the shallowest
prefix, from MIN_DEPTH on, that at most FULL sets share.  Of a region fuller than that (in the first STAR_TREES trees)
the first set and the next in order are candidates too, and its members are noted.  Candidates whose sizes allow it are confirmed on full
sets (100 * intersection >= 75 * union), and confirmed links make components.  Then the noted regions
are settled exactly: wherever members of one region are still in different components, all its sets are
compared at once by matrix products, in blocks of BLOCK sets, and the links that join components come out.

A pair of similarity 0.75 shares a region of some tree with probability 1 - (1 - 0.75**3)**24, over 0.999997.

Scale: equal sets are collapsed before anything else (their rows are attached by broadcast where a set has
over a thousandth of all rows); signatures, not texts, are sorted; a long region is read as a stream with
a bounded memory; only the texts of candidates are shuffled.

Defined results: null, empty and blank texts have no set, are kept and linked with nothing; a doc_id
that is repeated is one document (it is linked if any of its texts is), and its rows get the same
component; a null doc_id is never the smallest, and a document without other members and without id
has a null component and is kept.  Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import attach_groups, documents, drop_rows, maybe_in, shuffle_partitions, staged
from tracelake.llm.components import components
from tracelake.llm.textbytes import LOWER, NOT_SPACE, U64, byte_texts, chunks, joined, mix64, noise64, word_edges, word_hashes

SHINGLE = 5
TREES, DEPTH, MIN_DEPTH = 24, 6, 3
FULL, STAR_TREES, BLOCK = 8, 6, 1024
THRESHOLD = 75
CHUNK_BYTES = 3 << 20
_FACTORS = noise64(TREES * DEPTH, 3) | U64(1)
_PLACES = noise64(SHINGLE, 4) | U64(1)


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and how many each text has."""
    data, text_start = joined(texts)
    data = LOWER[data]
    start, end = word_edges(data, NOT_SPACE)
    owner = np.searchsorted(text_start, start, side="right") - 1
    words = word_hashes(data, start, end)
    n_words = np.bincount(owner, minlength=len(texts))
    with np.errstate(over="ignore"):
        if len(words) >= size:
            rolled = sum(words[i : len(words) - size + 1 + i] * _PLACES[i] for i in range(size))
            same = owner[size - 1 :] == owner[: len(owner) - size + 1]
            hashed, at = mix64(rolled[same]), owner[: len(owner) - size + 1][same]
        else:
            hashed, at = np.empty(0, U64), np.empty(0, np.int64)
        first = np.cumsum(n_words) - n_words
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        whole = [mix64((words[first[d] : first[d] + n_words[d]] * _PLACES[: n_words[d]]).sum(dtype=U64, keepdims=True) + U64(n_words[d])) for d in short]
    if len(short):
        hashed, at = np.concatenate([hashed, *whole]), np.concatenate([at, short])
    order = np.lexsort((hashed, at))
    hashed, at = hashed[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (at[1:] != at[:-1])
    return hashed[new], np.bincount(at[new], minlength=len(texts))


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minimum hashes (32 bits) of each non-empty set."""
    start = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(start), TREES * DEPTH), ">u4")
    with np.errstate(over="ignore"):
        for k in range(TREES * DEPTH):
            out[:, k] = np.minimum.reduceat((hashes * _FACTORS[k]) >> U64(32), start)
    return out


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def _sign(batches):
    for batch in chunks(batches, CHUNK_BYTES):
        hashes, counts = shingle_hashes(byte_texts(batch.column(1)))
        some = counts > 0
        start = (np.cumsum(counts) - counts)[some]
        digest = np.zeros((2, len(counts)), np.int64)
        sign: list[bytes | None] = [None] * len(counts)
        if len(start):
            with np.errstate(over="ignore"):
                digest[0, some] = np.add.reduceat(mix64(hashes), start).view(np.int64)
                digest[1, some] = np.add.reduceat(mix64(hashes ^ U64(0x5851F42D4C957F2D)), start).view(np.int64)
            for row, own in zip(np.flatnonzero(some).tolist(), signatures(hashes, counts), strict=True):
                sign[row] = own.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts.astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]), pa.array(sign, pa.binary())],
            names=["doc_id", "n_shingles", "set_a", "set_b", "signature"],
        )


_FOUND = "a long, b long, region long"


def _neighbours(batches):
    """Candidates (a, b, null) and members of regions still to settle (a, null, region) of sorted trees."""
    carry, carry_over = None, False  # the open region: all members, or its first and last when it is over-full
    opening = True
    pieces: list = []

    def emit(low, high, region):
        if len(low):
            yield pa.RecordBatch.from_arrays(
                [pa.array(low), pa.array(high) if high is not None else pa.nulls(len(low), pa.int64()), pa.nulls(len(low), pa.int64()) if region is None else pa.array(region)],
                names=["a", "b", "region"],
            )

    def pairs(i, j, rows):
        n, rep = rows["n"], rows["rep"]
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (100 * small >= THRESHOLD * large) & (rep[i] != rep[j])
        i, j = i[ok], j[ok]
        yield from emit(np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j]), None)

    def regions(rows, over_first, first_open, last_open):
        """All regions of rows; over_first: the first goes on from an over-full one."""
        place, sizes, start = {}, {}, {}
        new = np.ones(len(rows["rep"]), bool)
        new[1:] = (rows["tree"][1:] != rows["tree"][:-1]) | (rows["key"][1:, : MIN_DEPTH - 1] != rows["key"][:-1, : MIN_DEPTH - 1]).any(1)
        for depth in range(MIN_DEPTH, DEPTH + 1):
            new[1:] |= rows["key"][1:, depth - 1] != rows["key"][:-1, depth - 1]
            first = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            place[depth] = np.arange(len(new)) - first[number]
            sizes[depth], start[depth] = np.diff(np.append(first, len(new)))[number], first[number]
        over = sizes[MIN_DEPTH] > FULL
        if over_first:
            over |= start[MIN_DEPTH] == 0
        # all neighbours within the shallowest prefix that at most FULL sets share
        todo = np.ones(len(new), bool)
        for depth in range(MIN_DEPTH, DEPTH + 1):
            own = todo & (sizes[depth] <= FULL)
            if depth == MIN_DEPTH:
                own &= ~over
            else:
                own &= rows["tree"] < STAR_TREES
            for step in range(1, FULL):
                i = np.flatnonzero(own & (place[depth] >= step))
                if not len(i):
                    break
                yield from pairs(i - step, i, rows)
            todo &= ~own
        i = np.flatnonzero(over & (place[MIN_DEPTH] > 0) & (rows["tree"] < STAR_TREES))
        yield from pairs(start[MIN_DEPTH][i], i, rows)
        yield from pairs(i - 1, i, rows)
        note = over.copy()
        if first_open:
            note |= start[MIN_DEPTH] == 0
        if last_open:
            note |= start[MIN_DEPTH] == start[MIN_DEPTH][-1]
        i = np.flatnonzero(note)
        if len(i):
            with np.errstate(over="ignore"):
                head = rows["key"][i, :MIN_DEPTH].astype(U64)
                ids = mix64(rows["tree"][i].astype(U64) + U64(1))
                for k in range(MIN_DEPTH):
                    ids = mix64(ids ^ head[:, k]) * U64(0x9E3779B97F4A7C15)
            yield from emit(rows["rep"][i], None, ids.view(np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint32)
        rows = {"tree": batch.column(0).to_numpy(), "key": key, "rep": batch.column(2).to_numpy(), "n": batch.column(3).to_numpy()}
        if carry is not None:
            rows = {k: np.concatenate([carry[k], v]) for k, v in rows.items()}
        same = (rows["tree"] == rows["tree"][-1]) & (rows["key"][:, :MIN_DEPTH] == rows["key"][-1, :MIN_DEPTH]).all(1)
        tail = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
        if tail:
            yield from regions({k: v[:tail] for k, v in rows.items()}, carry_over, opening, False)
            opening = False
            rows, carry_over = {k: v[tail:] for k, v in rows.items()}, False
        if len(rows["rep"]) > 4 * FULL:  # a long open region: give out what is known, keep its ends
            yield from regions(rows, True, False, True)
            carry_over = True
            rows = {k: v[[0, -1]] for k, v in rows.items()}
        carry = rows
    if carry is not None:
        yield from regions(carry, carry_over, opening, True)


def _similar(batches):
    """Keep the pairs whose full sets are similar enough."""
    known: dict[int, np.ndarray] = {}

    def of(key, text):
        if key not in known:
            if len(known) > 256:
                known.clear()
            known[key] = shingle_hashes([text.encode()])[0]
        return known[key]

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            one, two = of((a[i], hash(x)), x.as_py()), of((b[i], hash(y)), y.as_py())
            shared = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * shared >= THRESHOLD * (len(one) + len(two) - shared):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (doc_id, text) are linked."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    near = maybe_in(texts, "doc_id", ids, "id")
    own = staged(near.join(ids, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id", "text"]), "candidate-texts")
    left = own.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = own.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(_similar, "a long, b long").distinct()


def _links_within(texts: list[bytes], rep: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of one group of texts: exact, a spanning set of them.

    Intersections are counted for all members at once, as products of 0/1 matrices over the shingles that occur twice."""
    hashes, counts = shingle_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    new = np.diff(hashes, prepend=hashes[:1] ^ U64(1)) != 0
    number = np.cumsum(new) - 1
    often = np.bincount(number) > 1
    keep = often[number]
    column, owner = (np.cumsum(often) - 1)[number[keep]], owner[keep]
    shared = np.zeros((len(texts), len(texts)), np.float32)
    width = 4096
    edge = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + width, width)) if len(column) else np.zeros(1, np.int64)
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        part = np.zeros((len(texts), width), np.float32)
        part[owner[i:j], column[i:j] % width] = 1
        shared += part @ part.T
    linked = 100 * shared >= THRESHOLD * (counts[:, None] + counts[None] - shared)
    out, seen = [], np.zeros(len(texts), bool)
    for first in range(len(texts)):
        if seen[first]:
            continue
        queue, seen[first] = [first], True
        while queue:
            i = queue.pop()
            # members of one component are known to be connected: they need no link between them
            for j in np.flatnonzero((linked[i] | (comp == comp[i])) & ~seen).tolist():
                seen[j] = True
                queue.append(j)
                if comp[j] != comp[i]:
                    out.append((min(int(rep[i]), int(rep[j])), max(int(rep[i]), int(rep[j]))))
    return out


def _settle(batches):
    """Links across components of each (region, block pair), whose rows stand together."""
    held: list = []
    current = None

    def flush():
        links = _links_within([t.encode() for _, _, t in held], np.array([r for r, _, _ in held]), np.array([c for _, c, _ in held])) if len(held) > 1 else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links]), pa.array([b for _, b in links])], names=["a", "b"])

    for batch in batches:
        for region, x, y, rep, comp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (region, x, y) != current:
                yield from flush()
                held, current = [], (region, x, y)
            held.append((rep, comp, text))
    yield from flush()


def settle_regions(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components that meet in a noted region; none is missed within a region.

    Only regions with several components are looked at.  A region of m sets is cut into blocks; each pair of blocks is one
    group of at most 2 * BLOCK sets, whose texts are compared in one task."""
    known = members.join(labels, members["a"] == labels["node"], "left")
    known = known.select("region", F.col("a").alias("rep"), F.coalesce("component", "a").alias("component"))
    split = known.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low <> high")
    split = split.select("region", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    own = staged(known.join(split, "region"), "open-regions")
    if own.isEmpty():
        return own.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    ids = own.select("rep").distinct()
    wanted = maybe_in(texts, "doc_id", ids, "rep").join(ids, F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id", "text"])
    own = own.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a member takes part in the block pairs (x, y), x <= y, of its block
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    spread = own.withColumn("m", F.explode(meet)).select("region", "m.x", "m.y", "rep", "component")
    met = spread.join(wanted, F.col("rep") == F.col("doc_id")).select("region", "x", "y", "rep", "component", "text")
    met = met.repartition(shuffle_partitions(members.sparkSession), "region", "x", "y").sortWithinPartitions("region", "x", "y", "rep")
    return met.mapInArrow(_settle, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = staged(texts.mapInArrow(_sign, _SIGNED), "signatures")
    key = ["n_shingles", "set_a", "set_b"]
    rows = signed.select("doc_id", *key).where("n_shingles > 0")
    classes = staged(rows.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("group_size")), "set-classes")
    total = classes.agg(F.sum("group_size")).first()[0] or 0
    reps = classes.where("rep is not null").select("rep", *[F.col(k).alias(f"_{k}") for k in key])
    first = signed.join(reps, (signed["doc_id"] == reps["rep"]) & (signed["set_a"] == reps["_set_a"]) & (signed["set_b"] == reps["_set_b"]))
    first = first.select("rep", F.col("n_shingles").alias("n"), "set_a", "set_b", "signature").dropDuplicates(["rep", "n", "set_a", "set_b"])
    width = 4 * DEPTH
    cut = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.col("signature"), t * width + 1, F.lit(width)))
    trees = first.select(F.posexplode(cut).alias("tree", "key"), "rep", "n")
    trees = trees.repartitionByRange(shuffle_partitions(spark), "tree", "key").sortWithinPartitions("tree", "key", "rep")
    found = staged(trees.select("tree", "key", "rep", "n").mapInArrow(_neighbours, _FOUND), "neighbours")
    pairs = staged(found.where("b is not null").select("a", "b").distinct(), "candidates")
    links = staged(confirm(pairs, texts), "links")
    labels = components(links)
    members = found.where("region is not null").select("a", "region").distinct()
    more = staged(settle_regions(members, labels, texts), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    # a repeated doc_id joins its sets: the class of each of its texts gets the same component
    repeated = rows.groupBy("doc_id").agg(F.count_distinct(*[F.col(k) for k in key]).alias("k")).where("k > 1 and doc_id is not null")
    if not repeated.isEmpty():
        tied = rows.join(repeated.select("doc_id"), "doc_id").join(classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(tied.distinct()))
    named = classes.join(labels, classes["rep"] == labels["node"], "left")
    named = named.select(*key, "group_size", F.coalesce("component", "rep").alias("component_id"))
    joined = attach_groups(rows, named, key, "group_size", total)
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = joined.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns."""
    lost = staged(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "near-copies")
    return drop_rows(docs, lost, "doc_id")


def op9_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLE_SQL = {
    "op9_near_dedup": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
          SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k
          FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
        r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
        c AS (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node)
        SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM c LEFT JOIN n USING (doc_id)
    """
}
